"""Quality scores from random-indexing word vectors and a small network.

Every context word has a fixed sparse random vector of +1 and -1.  A word's vector is
the sum of the vectors of the words near it, counted over the whole corpus; sums are of
integers, hence the same on every run.  Words are hashed into WORDS buckets, so the
table has a fixed size: each task adds up its own and Spark sums them per bucket.  A
document is the mean and spread of its words' vectors; a network of two layers, whose
outputs are divided by a temperature fitted on rows kept aside, gives the probability.

The network is fitted on a bounded sample of labelled rows (PER_CLASS of each class).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship, text_or_empty
from ledgerloom.llm.learning import flat, log_odds_shift, remainder, rounded, sampled, sigmoid, training_labels

WORDS = 8192
WIDTH = 64
ONES = 2  # entries of a context word's vector
REACH = 2  # words to either side that count as context
PER_CLASS = 6000  # bound of the labelled sample, per class
HIDDEN = 24
EPOCHS = 40
CHUNK = 1 << 20  # words handled at once inside a batch


def hashed_words(words: int = WORDS) -> Column:
    """Buckets of a text's words in order; runs of symbols are words too."""
    found = F.regexp_extract_all(text_or_empty(), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0))
    return F.transform(found, lambda w: F.pmod(F.xxhash64(w), F.lit(words)).cast("int"))


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each context bucket's sparse vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((WORDS, WIDTH)), axis=1)[:, :ONES]
    return places, np.tile([1, -1], ONES // 2) * np.ones((WORDS, 1), dtype=np.int64)


def context_sums(words: np.ndarray, offsets: np.ndarray, total: np.ndarray) -> None:
    """Adds the context vectors of all words of a batch of texts to ``total``."""
    places, signs = index_vectors()
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for gap in range(1, REACH + 1):
        for lo in range(0, max(len(words) - gap, 0), CHUNK):
            hi = min(lo + CHUNK, len(words) - gap)
            same = text_of[lo:hi] == text_of[lo + gap : hi + gap]
            left, right = words[lo:hi][same].astype(np.int64), words[lo + gap : hi + gap][same].astype(np.int64)
            for word, context in ((left, right), (right, left)):
                for j in range(ONES):
                    added = np.bincount(word * WIDTH + places[context, j], minlength=WORDS * WIDTH)
                    total += added * int(signs[0, j])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets, from all rows of ``docs``: centred, of length 1."""
    ship(docs.sparkSession)
    names = [f"v{i}" for i in range(WIDTH)]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(WORDS * WIDTH, dtype=np.int64), np.zeros(WORDS, dtype=np.int64)
        for batch in batches:
            words, offsets = flat(batch.column(0))
            context_sums(words, offsets, total)
            seen += np.bincount(words, minlength=WORDS)
        rows = np.flatnonzero(seen)
        table = total.reshape(WORDS, WIDTH)[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), pa.array(seen[rows]), *(pa.array(c) for c in table.T.copy())],
            ["word", "seen", *names],
        )

    parts = docs.select(hashed_words().alias("w")).mapInArrow(
        per_task, "word int, seen long, " + ", ".join(f"{n} long" for n in names)
    )
    rows = parts.groupBy("word").agg(*(F.sum(n).alias(n) for n in ["seen", *names])).toArrow()
    seen, vectors = np.zeros(WORDS), np.zeros((WORDS, WIDTH))
    at = rows["word"].to_numpy()
    seen[at] = rows["seen"].to_numpy()
    vectors[at] = np.stack([rows[n].to_numpy() for n in names], axis=1)
    vectors /= np.maximum(seen, 1)[:, None]
    vectors -= (vectors * seen[:, None]).sum(axis=0) / max(seen.sum(), 1)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
    vectors[seen == 0] = 0
    return vectors.astype(np.float32)


def pool(words: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the vectors of each text; zeros without words."""
    lengths = np.maximum(np.diff(offsets), 1)[:, None]
    both = np.concatenate([vectors, vectors * vectors], axis=1, dtype=np.float64)
    out = np.zeros((len(offsets) - 1, 2 * WIDTH))
    for i in range(len(out)):  # a text at a time: its different words, weighed by their counts
        own, counts = np.unique(words[offsets[i] : offsets[i + 1]], return_counts=True)
        out[i] = counts.astype(np.float64) @ both[own]
    mean = out[:, :WIDTH] / lengths
    spread = np.sqrt(np.maximum(out[:, WIDTH:] / lengths - mean**2, 0))
    return np.concatenate([mean, spread], axis=1)


class Network:
    """Two layers with a temperature and the shift to the labels' class balance."""

    def __init__(self, x: np.ndarray, y: np.ndarray, counts: dict[int, int], seed: int = 3):
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = (y.sum() + 1) / (len(y) + 2)
            return
        rng = np.random.default_rng(seed)
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.centre) / self.scale
        aside = rng.random(len(y)) < 0.2
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside[:] = False
        self.p = [
            rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1),
        ]
        self._train(x[~aside], y[~aside], rng)
        kept = aside if aside.any() else ~aside
        z = self._raw(x[kept])
        loss = lambda t: np.mean(np.logaddexp(0, np.where(y[kept] == 1, -z, z) / t))
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        self.shift = log_odds_shift(counts, y)

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def _train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(y)), -(-len(y) // 128)):
                h = np.tanh(x[rows] @ self.p[0] + self.p[1])
                g = (sigmoid(h @ self.p[2] + self.p[3][0]) - y[rows]) / len(rows)
                back = np.outer(g, self.p[2]) * (1 - h * h)
                t += 1
                for i, d in enumerate((x[rows].T @ back + 1e-3 * self.p[0], back.sum(axis=0), h.T @ g + 1e-3 * self.p[2], np.array([g.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * d
                    v[i] = 0.999 * v[i] + 0.001 * d * d
                    self.p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self._raw((x - self.centre) / self.scale) / self.temperature + self.shift)


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Learns ``labels.quality`` only from ids whose crc32 modulo ``modulus`` is not
    ``held``.  Null and empty texts are pooled to zeros and get the network's score of
    that.  A null id is never held out and never learnt from.  Repeated rows get equal
    scores each.  Other columns of ``docs`` are not read.  Empty tables give no rows;
    without labels every score is 0.5.
    """
    score = scorer(docs, labels, modulus, held, per_class)
    scored = docs.select(
        "doc_id", F.coalesce(remainder(modulus) == held, F.lit(False)).alias("held_out"), score.alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scorer(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = PER_CLASS) -> Column:
    """The fitted score as a column over ``text``."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))  # WORDS x WIDTH, whatever the input

    @F.arrow_udf("array<double>")
    def pooled(lists: pa.Array) -> pa.Array:
        x = pool(*flat(lists), vectors.value)
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 2 * WIDTH).cast(pa.list_(pa.float64()))

    picked, counts = training_labels(labels, "quality", remainder(modulus) != held, per_class)
    sample = sampled(docs, picked, pooled(hashed_words()))
    x = flat(sample["x"])[0].reshape(-1, 2 * WIDTH)
    network = context.broadcast(Network(x, sample["_y"].to_numpy(), counts))

    @F.arrow_udf("double")
    def score(lists: pa.Array) -> pa.Array:
        return pa.array(rounded(network.value.scores(pool(*flat(lists), vectors.value))))

    return score(hashed_words())
