"""Exact top-k by inner product: columnar branch and bound.

Candidates are held in vertical layout, one row of the matrix per dimension.  For a
tile of queries the inner products are added up dimension block by dimension block, the
dimensions with most query mass first.  After each block a pair's score is bounded by
what it has plus the product of both vectors' remaining mass (their norms over the
dimensions to come).  Pairs whose bound is below their query's floor are dropped and the
survivors compacted: whole candidates and queries while many pairs are left, single
pairs once few are.  Floors come from the best so far, and before the first block from
the exact scores of the candidates of largest norm; candidates whose norm alone can't
reach any floor are never multiplied.  All sums are of integers, so nothing is rounded.

Queries come in blocks of at most about QUERY_BLOCK, each broadcast; candidates are
read in place, each task keeps k rows per query, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import shared_folder, ship
from ledgerloom.llm.learning import flat

QUERY_BLOCK = 4096  # queries broadcast at once
TILE = 128  # queries of a block handled at once against a batch of candidates
BATCH = 4096  # candidates of a batch
STEP = 16  # dimensions of a block
SEEDS = 64  # candidates of largest norm whose exact scores make the first floors
FEW = 0.02  # share of pairs left below which they are followed one by one


def integers(column: str) -> Column:
    """floor(256 * x) of each component, as doubles; null unless all are finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def scaled(x: Column) -> Column:  # doubles from 2**52 on are whole numbers
        y = x.cast("double") * 256
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.when(finite, F.transform(column, scaled))


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th highest value; -inf where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def best_pairs(queries: np.ndarray, columns: np.ndarray, floor: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, work: list | None = None) -> tuple:
    """Pairs (query, candidate, score) that may be among their query's k best.

    ``queries`` is (m, d), ``columns`` (d, n), both of integers; ``floor`` the score that
    each query's pairs have to reach; ``ids`` differ.  A query isn't paired with its own
    id.  ``work`` gets the number of products each step made.
    """
    m, n, d = len(queries), columns.shape[1], len(columns)
    work = [] if work is None else work
    order = np.argsort(-(queries**2).sum(axis=0), kind="stable")
    queries, columns = queries[:, order], columns[order]
    q_left, c_left = (queries**2).sum(axis=1), (columns**2).sum(axis=0)
    q_norm, c_norm = np.sqrt(q_left), np.sqrt(c_left)
    # Floors from the candidates most likely to be best.
    heavy = np.argpartition(-c_norm, SEEDS - 1)[:SEEDS] if n > SEEDS else np.arange(n)
    seeds = np.where(own[:, None] == ids[heavy][None, :], -np.inf, queries @ columns[:, heavy])
    work.append(m * len(heavy) * d)
    bar = np.maximum(floor, _kth(seeds, k))
    # A pair's score is at most the product of its norms; the one is for their rounding.
    with np.errstate(divide="ignore", invalid="ignore"):
        asked = np.where(q_norm > 0, (bar - 1) / q_norm, np.where(bar <= 0, -np.inf, np.inf))
    rows, cols = np.arange(m), np.flatnonzero(c_norm >= asked.min(initial=np.inf))
    score = np.zeros((m, len(cols)))
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    for lo in range(0, d, STEP):
        part, more = slice(lo, lo + STEP), lo + STEP < d
        q_left = q_left - (queries[:, part] ** 2).sum(axis=1)
        c_left = c_left - (columns[part] ** 2).sum(axis=0)
        q_rest, c_rest = np.sqrt(np.maximum(q_left, 0)), np.sqrt(np.maximum(c_left, 0))
        if pairs is None:
            work.append(len(rows) * len(cols) * (min(lo + STEP, d) - lo))
            score += queries[rows, part] @ columns[part][:, cols]
            reach = score + q_rest[rows][:, None] * c_rest[cols][None, :] + more
            alive = (reach >= bar[rows][:, None]) & (own[rows][:, None] != ids[cols][None, :])
            if alive.sum() <= FEW * m * n or not more:
                q, c = np.nonzero(alive)
                score, pairs = score[q, c], (rows[q], cols[c])
            else:
                keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
                rows, cols = rows[keep_rows], cols[keep_cols]
                score = score[np.ix_(keep_rows, keep_cols)]
        else:
            q, c = pairs
            work.append(len(q) * (min(lo + STEP, d) - lo))
            score = score + np.einsum("ij,ji->i", queries[q, part], columns[part][:, c])
            keep = score + q_rest[q] * c_rest[c] + more >= bar[q]
            score, pairs = score[keep], (q[keep], c[keep])
    if pairs is None:  # no dimension: every score is 0
        pairs = np.nonzero((own[:, None] != ids[None, :]) & (bar[:, None] <= 0))
        score = np.zeros(len(pairs[0]))
    q, c = pairs
    by = np.lexsort((-score, q))
    place = np.arange(len(q)) - np.searchsorted(q[by], q[by])
    last = np.full(m, -np.inf)
    last[q[by][place == k - 1]] = score[by][place == k - 1]
    keep = score >= last[q]  # ties with the k-th stay
    return q[keep], c[keep], score[keep]


def _exact(queries: np.ndarray, columns: np.ndarray) -> bool:
    """Whether double sums of these integers are exact."""
    top = lambda a: float(np.abs(a).max(initial=0.0))
    return max(top(queries), top(columns)) ** 2 * max(len(columns), 1) < 2.0**53


class _Best:
    """The k best of each query so far; a vector's score is its highest."""

    def __init__(self, m: int, k: int):
        self.k, self.q, self.id, self.score = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        self.floor = np.full(m, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        q, ids = np.concatenate([self.q, q]), np.concatenate([self.id, ids])
        score = np.concatenate([self.score, score])
        for drop_repeats in (True, False):
            by = np.lexsort((-score.astype(np.float64), ids, q)) if drop_repeats else np.lexsort((ids, -score.astype(np.float64), q))
            q, ids, score = q[by], ids[by], score[by]
            if drop_repeats:
                new = np.ones(len(q), bool)
                new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
            else:
                new = np.arange(len(q)) - np.searchsorted(q, q) < self.k
            q, ids, score = q[new], ids[new], score[new]
        self.q, self.id, self.score = q, ids, score
        last = np.searchsorted(q, np.arange(len(self.floor)), side="right") - 1
        full = np.bincount(q, minlength=len(self.floor)) >= self.k
        self.floor[full] = score[last[full]].astype(np.float64)


def _search(batches: Iterator[pa.RecordBatch], block, k: int) -> Iterator[pa.RecordBatch]:
    """Each task's k best of all queries of the block, by number of dimensions."""
    tops: dict[int, list[_Best]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            piece = batch.slice(at, BATCH)
            all_ids, lists = piece.column(0).to_numpy(), piece.column(1)
            values, offsets = flat(lists)
            lengths = np.diff(offsets)
            for d in set(lengths.tolist()) & set(block):
                rows = np.flatnonzero(lengths == d)
                rest = rows
                while len(rest):  # an id once in each pass: bounds count different ids
                    rows = rest[np.unique(all_ids[rest], return_index=True)[1]]
                    rest = np.setdiff1d(rest, rows)
                    columns = values[offsets[rows][:, None] + np.arange(d)].T.copy()
                    own, queries = block[d]
                    tiles = range(0, len(own), TILE)
                    best = tops.setdefault(d, [_Best(len(own[t : t + TILE]), k) for t in tiles])
                    for top, t in zip(best, tiles, strict=True):
                        tile = queries[t : t + TILE]
                        if _exact(tile, columns):
                            q, c, score = best_pairs(tile, columns, top.floor, own[t : t + TILE], all_ids[rows], k)
                            score = score.astype(np.int64)
                        else:  # beyond doubles: whole numbers of any size, ends of long where they don't fit
                            big = np.array([[int(x) for x in r] for r in tile], object) @ np.array([[int(x) for x in r] for r in columns], object)
                            q, c = np.nonzero(own[t : t + TILE][:, None] != all_ids[rows][None, :])
                            score = np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in big[q, c]], object)
                        top.add(q, all_ids[rows][c], score)
    for d, best in tops.items():
        own = block[d][0]
        for i, top in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[i * TILE + top.q], pa.int64()), pa.array(top.id, pa.int64()), pa.array([int(x) for x in top.score], pa.int64())],
                ["query_id", "vec_id", "score"],
            )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates.

    Scores are inner products of floor(256 * x); ties go to the smaller vec_id.  A query
    is every row for which ``is_query`` holds, against all rows of other ids and as many
    dimensions.  Vectors that are null, or hold null or non-finite components, and null
    ids take no part.  Where an id is repeated, a pair's score is its highest.  A query
    without candidates has no row; an empty table gives none.  Other columns aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", integers("embedding").alias("x"), is_query.alias("_q"))
    rows = rows.where(F.col("x").isNotNull())
    asked = rows.where("_q").groupBy("vec_id", "x").count().drop("count")
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    schema = "query_id long, vec_id long, score long"
    folder = shared_folder(spark, "topk") if blocks > 1 else None
    found = spark.createDataFrame([], schema)
    for b in range(blocks if n else 0):
        table = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().sort_by("vec_id")
        ids, (values, offsets) = table["vec_id"].to_numpy(), flat(table["x"])
        lengths = np.diff(offsets)
        block = {
            int(d): (ids[lengths == d], values[offsets[:-1][lengths == d][:, None] + np.arange(d)]) for d in np.unique(lengths)
        }
        sent = spark.sparkContext.broadcast(block)
        found = rows.select("vec_id", "x").mapInArrow(lambda it, s=sent: _search(it, s.value, k), schema)
        if folder:
            found.write.mode("append").parquet(folder)
    if folder:
        found = spark.read.schema(schema).parquet(folder)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
