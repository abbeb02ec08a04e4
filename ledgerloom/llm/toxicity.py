"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) over the distinct terms of a
text.  The pair term lets words that are harmless alone raise the score together: terms
get weights and factors if their own share of toxic texts is beyond chance, or that of a
pair with another term is.
Terms are lower-cased runs of letters or digits, and the beginnings of longer ones,
hashed into 2**BITS buckets.

The machine is fitted on a bounded sample of labelled rows (PER_CLASS of each class)
on the driver; its size is fixed, so it is broadcast.  Scoring is one narrow pass over
whole texts: terms are hashed by Spark, summed per text in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import text_or_empty
from ledgerloom.llm.learning import flat, log_odds_shift, remainder, rounded, sampled, sigmoid, sums, training_labels

BITS = 16
RANK = 6
BEGINNINGS = (4, 6)  # letters
PER_CLASS = 6000  # bound of the labelled sample, per class
MIN_DOCS = 3  # terms in fewer documents of the sample get no weight
BOUND = 3.5  # least z score of a term that gets weights by itself
PAIRED = 2048  # terms of most texts of the sample that are tried in pairs
PAIR_BOUND = 10.0  # least z score of a pair; two million are tried
DECAY = 1e-4
EPOCHS = 15
LEAST_ASIDE = 20
BATCH = 128


def hashed_terms(bits: int = BITS) -> Column:
    """Distinct buckets of a text's words and of the beginnings of its longer words."""
    words = F.array_distinct(F.filter(F.split(F.lower(text_or_empty()), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(1 << bits)).cast("int")

    def begun(n: int) -> Column:
        longer = F.filter(words, lambda w: F.length(w) > n)
        return F.transform(longer, lambda w: bucket(F.concat(F.lit("^"), F.substring(w, 1, n))))

    return F.array_distinct(F.concat(F.transform(words, bucket), *(begun(n) for n in BEGINNINGS)))


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = self.bias + sums(self.linear[terms], offsets)
        for f in range(self.factors.shape[1]):
            v = self.factors[:, f][terms]
            out += 0.5 * (sums(v, offsets) ** 2 - sums(v * v, offsets))
        return out

    def scores(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.raw(terms, offsets) + self.shift)


def telling(terms: np.ndarray, offsets: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Buckets whose share of toxic texts differs from the rest's beyond chance.

    A term's z score compares the texts that hold it, by class; the bound grows with the
    number of buckets tried, so that a few of 65,536 pass by chance.
    """
    label_of = np.repeat(y, np.diff(offsets))
    seen = np.bincount(terms, minlength=size).astype(float)
    ones = np.bincount(terms[label_of == 1], minlength=size)
    share = y.mean()
    expected = seen * share
    z = (ones - expected) / np.sqrt(np.maximum(expected * (1 - share), 0.25))
    return (seen >= MIN_DOCS) & (np.abs(z) >= BOUND)


def interacting(terms: np.ndarray, offsets: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that tell by pairs what they don't tell alone, and the pairs' z scores.

    Of the PAIRED buckets in most texts of the sample every two are compared: the share of
    toxic texts among those that hold both, against what their shares alone add up to.
    Pairs of two buckets that tell by themselves need no test.  (buckets, z) with z zero
    where a pair is within chance.
    """
    seen = np.bincount(terms, minlength=len(known))
    often = np.argsort(-seen, kind="stable")[:PAIRED]
    often = np.sort(often[seen[often] >= MIN_DOCS])
    place = np.full(len(known), -1)
    place[often] = np.arange(len(often))
    row_of = np.repeat(np.arange(len(y)), np.diff(offsets))
    held = place[terms] >= 0
    grid = np.zeros((len(y), len(often)), np.float32)
    grid[row_of[held], place[terms][held]] = 1
    both, ones = grid.T @ grid, grid.T @ (grid * y[:, None].astype(np.float32))
    share = y.mean()
    alone = np.diag(ones) / np.maximum(np.diag(both), 1)
    expected = np.clip(alone[:, None] + alone[None, :] - share, 0, 1)
    spread = both * share * (1 - share)
    z = (ones - both * expected) / np.sqrt(np.maximum(spread, 1))
    z[(spread < 3) | (np.abs(z) < PAIR_BOUND) | (known[often][:, None] & known[often][None, :])] = 0
    np.fill_diagonal(z, 0)
    some = z.any(axis=0)
    return often[some], z[np.ix_(some, some)]


def fit(terms: np.ndarray, offsets: np.ndarray, y: np.ndarray, counts: dict[int, int], bits: int = BITS, rank: int = RANK, seed: int = 11) -> Machine:
    """Logistic loss with adaptive steps over the terms that tell, alone or in pairs; other
    terms stay at zero.

    A fifth of the rows is kept aside to fit scale and shift of the score; with fewer than
    LEAST_ASIDE of a class there, only the shift between the labels' shares and the
    sample's is made.  With no row, or rows of one class only, there is nothing to learn:
    the score is that class's smoothed share (0.5 without rows) for every text.
    """
    size = 1 << bits
    rng = np.random.default_rng(seed)
    linear, factors = np.zeros(size), np.zeros((size, rank))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Machine(float(np.log(share / (1 - share))), linear, factors)
    aside = rng.random(len(y)) < 0.2
    if min(np.bincount(y[aside], minlength=2)) < LEAST_ASIDE:
        aside[:] = False
    all_terms, all_offsets, all_y = terms, offsets, y
    terms, offsets = _rows(terms, offsets, np.flatnonzero(~aside))
    y = y[~aside]
    known = telling(terms, offsets, y, size)
    factors[known] = rng.normal(0, 0.02, (int(known.sum()), rank))
    paired, z = interacting(terms, offsets, y, known)
    if len(paired):  # factors whose products have the signs of the pairs' scores
        value, vector = np.linalg.eigh(z / np.abs(z).max())
        top = np.argsort(-value)[:rank]
        factors[paired] = 0
        factors[paired[:, None], np.arange(len(top))] = 0.5 * vector[:, top] * np.sqrt(np.maximum(value[top], 0))
        known[paired] = True
    row_of = np.repeat(np.arange(len(y)), np.diff(offsets))[known[terms]]
    terms = terms[known[terms]]
    begins = np.searchsorted(row_of, np.arange(len(y) + 1))
    bias, g_bias = 0.0, 1e-8
    g_linear, g_factors = np.full(size, 1e-8), np.full((size, rank), 1e-8)
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
            own = np.concatenate([terms[begins[r] : begins[r + 1]] for r in rows])
            row = np.repeat(np.arange(len(rows)), begins[rows + 1] - begins[rows])
            v = factors[own]
            pooled = np.stack([np.bincount(row, v[:, f], len(rows)) for f in range(rank)], axis=1)
            squares = np.bincount(row, (v * v).sum(axis=1), len(rows))
            z = bias + np.bincount(row, linear[own], len(rows)) + 0.5 * ((pooled**2).sum(axis=1) - squares)
            g = (sigmoid(z) - y[rows]) / len(rows)
            g_bias += g.sum() ** 2
            bias -= 0.3 * g.sum() / np.sqrt(g_bias)
            used, at = np.unique(own, return_inverse=True)
            per = g[row]
            step = np.bincount(at, per, len(used)) + DECAY * linear[used]
            g_linear[used] += step**2
            linear[used] -= 0.2 * step / np.sqrt(g_linear[used])
            grad = per[:, None] * (pooled[row] - v)
            step = np.stack([np.bincount(at, grad[:, f], len(used)) for f in range(rank)], axis=1) + DECAY * factors[used]
            g_factors[used] += step**2
            factors[used] -= 0.03 * step / np.sqrt(g_factors[used])
    machine = Machine(bias, linear, factors)
    if aside.any():
        z = machine.raw(*_rows(all_terms, all_offsets, np.flatnonzero(aside)))
        machine.scale, machine.shift = _calibrated(z, all_y[aside])
    else:
        machine.shift = log_odds_shift(counts, y)
    return machine


def _rows(terms: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept = [terms[offsets[r] : offsets[r + 1]] for r in rows]
    return np.concatenate([terms[:0], *kept]), np.concatenate([[0], np.cumsum([len(k) for k in kept], dtype=np.int64)])


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of least logistic loss on a grid, both classes weighing the same:
    toxic texts are few, and missing one costs as much as flagging a clean one."""
    weight = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())
    sign = np.where(y == 1, -1.0, 1.0)
    best = min(
        (float((weight * np.logaddexp(0, sign * (a * z + b))).sum()), float(a), float(b))
        for a in np.geomspace(0.5, 4, 25)
        for b in np.linspace(-6, 6, 97)
    )
    return best[1], best[2]


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = 0.7, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Learns ``labels.toxic`` only from ids whose crc32 modulo ``modulus`` is not ``held``.
    Null and empty texts have no terms and get the score of the bias alone.  A null id is
    never held out and never learnt from.  Repeated rows get equal scores each.  Other
    columns of ``docs`` are not read.  Empty tables give no rows; without labels every
    score is 0.5.
    """
    spark = docs.sparkSession
    picked, counts = training_labels(labels, "toxic", remainder(modulus) != held, per_class)
    sample = sampled(docs, picked, hashed_terms())
    terms, offsets = flat(sample["x"])
    machine = spark.sparkContext.broadcast(fit(terms, offsets, sample["_y"].to_numpy(), counts))

    @F.arrow_udf("double")
    def score(lists: pa.Array) -> pa.Array:
        return pa.array(rounded(machine.value.scores(*flat(lists))))

    scored = docs.select(
        "doc_id", F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), score(hashed_terms()).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
