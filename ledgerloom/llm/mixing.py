"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are hashed into a fixed number of blocks, put in a permuted
order.  A source's target is met by whole passes over its blocks and one partial
pass, in rounds: each takes documents that fit what is left, in the blocks' order, as
far as they go, until no document that is left out fits.
The blocks taken from all sources are split exactly among the output shards: at
each node of a binary tree over the shards, the number of blocks of each source
that go left is drawn from the multivariate hypergeometric law.  Each shard then
draws the next run of every source's permuted blocks, so draws are disjoint, and is
shuffled by a hash of its rows.

The driver holds one row per source (name, words, target, quotas) and one cut per
round, never blocks or documents.  A round at least halves what is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, text_or_empty, word_count

BLOCKS = 4096  # blocks per source; bounds every per-source group below
END = 1 << 30  # rank beyond all blocks
CUTS = "array<struct<fit:long,rank:int,nth:int,one:boolean>>"


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), most: int = 3) -> dict[str | None, float]:
    """Words to take of each source.

    Sources by code point, null last, get the weights in turn and share the sum of
    all sizes; a target above ``most`` times its source's size stops there and the
    excess is shared again by weight, until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, active = float(sum(sizes.values())), list(names)
    while active:
        unit = left / sum(weight[s] for s in active)
        full = [s for s in active if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in active}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        active = [s for s in active if s not in set(full)]
    return {s: max(0.0, out[s]) for s in names}


def split(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Block quotas, one row per shard, whose columns sum to ``counts``.

    The tree halves the shards; a node's left part gets its share of the node's
    blocks, their sources drawn without replacement.
    """
    quotas = np.zeros((shards, len(counts)), dtype=np.int64)

    def node(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            quotas[lo] = have
            return
        mid = (lo + hi) // 2
        n = int(have.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, n, method="marginals") if n else np.zeros_like(have)
        node(lo, mid, left)
        node(mid, hi, have - left)

    if counts:
        node(0, shards, np.asarray(counts, dtype=np.int64))
    return quotas


def plan(docs: DataFrame, weights=(5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """One row per document with what the mix takes of it.

    Columns: doc_id, source, size (words), source_size, target, passes (how often the
    document is taken), taken (= size * passes), and _crc, _block, _rank, _blocks,
    _full for :func:`draw`.  A null text has no words and is taken as a document of
    size 0; null sources are one source.  Repeated rows are documents of their own.
    Other columns are not read.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = staged(
        docs.select("doc_id", "source", word_count().alias("size"), F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("_crc"))
        .withColumn("_order", F.xxhash64(F.lit(seed), "doc_id", "_crc"))
        .withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "_crc"), F.lit(BLOCKS)).cast("int")),
        "mix-rows",
    )
    blocks = staged(
        rows.groupBy("source", "_block").agg(F.sum("size").alias("_words")), "mix-blocks"
    )
    sizes = {
        r["source"]: r["words"] for r in blocks.groupBy("source").agg(F.sum("_words").alias("words")).collect()
    }
    goal = targets(sizes, weights, most)
    whole = {s: min(most, int(goal[s] // sizes[s])) if sizes[s] else 0 for s in sizes}
    rest = {s: int(round(goal[s] - whole[s] * sizes[s])) for s in sizes}
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 2), "_block"), "_block")
    ranked = blocks.select(
        F.col("source").alias("_s"),
        F.col("_block").alias("_b"),
        (F.row_number().over(permuted) - 1).alias("_rank"),
        F.count(F.lit(1)).over(Window.partitionBy("source")).alias("_blocks"),
    )
    in_block = Window.partitionBy("source", "_block").orderBy("_order", "doc_id", "_crc")
    placed = staged(
        rows.join(ranked, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
        .drop("_s", "_b")
        .withColumn("_nth", F.row_number().over(in_block))
        .drop("_order"),
        "mix-placed",
    )
    cuts = _cuts(placed, rest)
    known = spark.createDataFrame(
        [(s, sizes[s], goal[s], whole[s], cuts[s]) for s in sizes],
        f"source string, source_size long, target double, _full int, _cuts {CUTS}",
    )
    return (
        _with_sources(placed, known)
        .withColumn("passes", F.col("_full") + F.when(_taken(), 1).otherwise(0))
        .withColumn("taken", F.col("size") * F.col("passes"))
        .select(
            "doc_id", "source", "size", "source_size", "target", "passes", "taken",
            "_crc", "_block", "_nth", "_rank", "_blocks", "_full",
        )
    )


def _with_sources(rows: DataFrame, known: DataFrame, most: int = 100_000) -> DataFrame:
    """Joins the row of each source; broadcast only where there are at most ``most``."""
    right = known.withColumnRenamed("source", "_s")
    right = F.broadcast(right) if known.count() <= most else right
    return rows.join(right, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _taken() -> Column:
    """Whether one of the cuts takes a document: those of at most ``fit`` words before a
    place, or the one at that place."""
    return F.expr(
        "exists(_cuts, c -> if(c.one, _rank = c.rank and _nth = c.nth,"
        " size <= c.fit and (_rank < c.rank or (_rank = c.rank and _nth < c.nth))))"
    )


def _cuts(placed: DataFrame, rest: dict) -> dict[str | None, list[tuple]]:
    """What the partial pass takes of each source, ``rest`` words: (fit, rank, nth, one).

    In each round the documents that fit the gap are summed in order up to the first
    that crosses it.  That one or those before it are taken, whichever is more: as they
    are more than the gap together, it halves.  When none fits, the smallest document
    left out is taken if the source is then closer to its target.
    """
    spark = placed.sparkSession
    gap = {s: n for s, n in rest.items() if n > 0}
    cuts: dict[str | None, list[tuple]] = {s: [] for s in rest}
    while gap:
        state = spark.createDataFrame(
            [(s, g, cuts[s]) for s, g in gap.items()], f"source string, _gap long, _cuts {CUTS}"
        )
        left = _with_sources(placed, state).where((F.col("size") > 0) & ~_taken())
        fit = F.col("size") <= F.col("_gap")
        by_rank = Window.partitionBy("source").orderBy("_rank")
        blocks = left.groupBy("source", "_rank", "_gap").agg(
            F.sum(F.when(fit, F.col("size"))).alias("_sum"),
            F.min(F.when(~fit, F.struct("size", "_rank", "_nth"))).alias("_over"),
        )
        blocks = blocks.withColumn("_to", F.sum(F.coalesce("_sum", F.lit(0))).over(by_rank))
        found = blocks.groupBy("source").agg(
            F.max("_to").alias("all"),
            F.min("_over").alias("over"),
            F.min(F.when(F.col("_to") > F.col("_gap"), F.struct("_rank", (F.col("_to") - F.col("_sum")).alias("before")))).alias("at"),
        ).collect()
        at = {r["source"]: r["at"] for r in found if r["at"]}
        crossed = _crossing(placed, {s: (gap[s], cuts[s], *at[s]) for s in at}) if at else {}
        after: dict[str | None, int] = {}
        for r in found:
            s, g = r["source"], gap[r["source"]]
            if s in crossed:
                nth, size, before = crossed[s]
                one = size > before
                cuts[s].append((g, at[s]["_rank"], nth, one))
                after[s] = g - max(size, before)
            elif r["all"]:
                cuts[s].append((g, END, 0, False))
                after[s] = g - r["all"]
            elif r["over"] and r["over"]["size"] < 2 * g:
                cuts[s].append((g, r["over"]["_rank"], r["over"]["_nth"], True))
        gap = {s: g for s, g in after.items() if g > 0}
    return cuts


def _crossing(placed: DataFrame, at: dict) -> dict[str | None, tuple[int, int, int]]:
    """In the block of each source where its gap is crossed: number and size of the
    document that crosses it, and the words of those before it."""
    blocks = placed.sparkSession.createDataFrame(
        [(s, *v) for s, v in at.items()], f"source string, _gap long, _cuts {CUTS}, _at int, _before long"
    )
    upto = F.col("_before") + F.sum("size").over(Window.partitionBy("source").orderBy("_nth"))
    inside = _with_sources(placed, blocks).where("_rank = _at and size > 0 and size <= _gap").where(~_taken())
    over = inside.withColumn("_to", upto).where("_to > _gap").groupBy("source")
    first = over.agg(F.min(F.struct("_nth", "size", F.expr("_to - size").alias("before"))).alias("m")).collect()
    return {r["source"]: tuple(r["m"]) for r in first}


def draw(planned: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """The mix itself: a row for each document taken and each pass, with its shard.

    Adds to the rows of :func:`plan`: copy (0, 1, ...), shard and _shuffle, the hash
    that orders a shard.  A document outside the blocks that a pass takes whole goes
    with its block's number in that pass.
    """
    spark = planned.sparkSession
    units = planned.where("passes > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("copy"))
    # Units of a source: its blocks, pass after pass, in permuted order.
    units = units.withColumn("_unit", F.col("copy") * F.col("_blocks") + F.col("_rank"))
    have = {
        r["source"]: r["n"]
        for r in units.groupBy("source", "_unit").agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("*").alias("n")).collect()
    }
    names = sorted((s for s in have if s is not None)) + [s for s in have if s is None]
    quotas = split([have[s] for s in names], shards, seed)
    ends = quotas.cumsum(axis=0)
    table = spark.createDataFrame(
        [(s, k, int(ends[k, i] - quotas[k, i]), int(ends[k, i])) for i, s in enumerate(names) for k in range(shards)],
        "_s string, shard int, _begin long, _end long",
    )
    # Numbers of the units that are taken, without gaps.
    numbered = units.select("source", "_unit").distinct().withColumn(
        "_number", F.row_number().over(Window.partitionBy("source").orderBy("_unit")) - 1
    )
    numbered = numbered.join(
        F.broadcast(table) if len(names) * shards <= 100_000 else table,
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("_number") >= F.col("_begin")) & (F.col("_number") < F.col("_end")),
    ).select(F.col("source").alias("_s"), F.col("_unit").alias("_u"), "shard")
    return (
        units.join(numbered, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_unit") == F.col("_u")))
        .drop("_s", "_u", "_unit")
        .withColumn("_shuffle", F.xxhash64(F.lit(seed + 3), "doc_id", "_crc", "_nth", "copy"))
    )


def counted(planned: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """The rows of :func:`plan` with passes and taken counted from what :func:`draw` draws.

    Adds shards: the shard of each time that a document is drawn, in order of the copies.
    """
    key = ["source", "_block", "_nth"]
    drawn = draw(planned, shards, seed).groupBy(*key).agg(
        F.count("*").cast("int").alias("passes"),
        F.sum("size").alias("taken"),
        F.sort_array(F.collect_list(F.struct("copy", "shard"))).getField("shard").alias("shards"),
    )
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_d{c}"))
    drawn = drawn.select(*(F.col(c).alias(f"_d{c}") for c in key), "passes", "taken", "shards")
    return (
        planned.drop("passes", "taken").join(drawn, same, "left").drop(*(f"_d{c}" for c in key))
        .withColumn("passes", F.coalesce("passes", F.lit(0)))
        .withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        .withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
    )


def mixed(docs: DataFrame, weights=(5, 2, 1), most: int = 3, seed: int = 7, shards: int = 8) -> DataFrame:
    """The rows of ``docs``, whole, each as often as :func:`draw` draws it, ordered by
    shard and inside it by the shuffle.

    Documents that aren't drawn go.  Rows with one id, source and text are numbered, so
    that each gets the draws of one of them.
    """
    key = ["doc_id", "source", "_crc"]
    crc = F.crc32(F.encode(text_or_empty(), "UTF-8"))
    nth = Window.partitionBy(*key)
    planned = plan(docs, weights, most, seed)
    planned = planned.withColumn("_k", F.row_number().over(nth.orderBy("_nth")))
    drawn = draw(planned, shards, seed)
    drawn = staged(
        drawn.select(*(F.col(c).alias(f"_t{c}") for c in key), F.col("_k").alias("_tk"), "shard", "_shuffle"), "mix-drawn"
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", crc.alias("_crc"))
    rows = rows.withColumn("_k", F.row_number().over(nth.orderBy(F.lit(1))))
    same = F.col("_k") == F.col("_tk")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_t{c}"))
    copies = rows.join(drawn, same).select("row", F.col("shard").alias("_shard"), "_shuffle")
    return copies.orderBy("_shard", "_shuffle").select("row.*")
