"""Bounded labelled samples and flat arrays for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship, text_or_empty


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.encode(F.col(column).cast("string"), "UTF-8")) % modulus


def training_labels(labels: DataFrame, target: str, train: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled ids of each class, and how many each class has.

    Null ids and labels are left out; an id labelled more than once counts as 1 if any
    of its labels is 1.  The sample is the ids that come first by a hash.
    """
    known = (
        labels.select("doc_id", F.col(target).cast("int").alias("_y"))
        .where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & train)
        .groupBy("doc_id")
        .agg(F.max("_y").alias("_y"))
    )
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    picked = [
        known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    return picked[0].unionByName(picked[1]), counts


def sampled(docs: DataFrame, picked: DataFrame, feature: Column) -> pa.Table:
    """Feature and label of the picked documents, on the driver: a row per picked id.

    Of rows that share an id the one whose text comes first by a hash counts, whatever
    the number of its copies; they are reduced where they are read.
    """
    ship(docs.sparkSession)
    text = text_or_empty()
    rows = docs.select("doc_id", F.xxhash64(text).alias("_h"), text.alias("text")).join(F.broadcast(picked), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("_h", "text")).alias("_m"), F.first("_y").alias("_y"))
    return one.select("doc_id", F.col("_m.text").alias("text"), "_y").select("doc_id", feature.alias("x"), "_y").toArrow().sort_by("doc_id")


def flat(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list array; a null list counts as empty."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):  # no chunk at all
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each run of rows of ``values``; an empty run gives zeros."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def log_odds_shift(counts: dict[int, int], used: np.ndarray) -> float:
    """What the sample's balance of classes has to be shifted by to be the labels'."""
    if not counts.get(0) or not counts.get(1) or used.min() == used.max():
        return 0.0
    ones = int(used.sum())
    return float(np.log(counts[1] / counts[0]) - np.log(ones / (len(used) - ones)))


def rounded(scores: np.ndarray) -> np.ndarray:
    """To nine digits: sums of doubles depend on how rows fall into batches."""
    return np.round(scores, 9)
