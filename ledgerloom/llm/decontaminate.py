"""Benchmark decontamination by size-partitioned MinHash containment search.

A short test item hides inside a long document, where the two sets' Jaccard similarity
is tiny.  So containment is searched from the item's side: an item's sketch is its
smallest shingle hashes (bottom-s MinHash), looked up in the document's full set.
Items are partitioned by size; a partition whose items have at most Q shingles uses
s = floor((1 - containment) * Q) + 1.  A document that holds the asked share of an item
lacks fewer of its shingles than that, so at least one of the sketch is found: no leak
is missed.  Every document with a sketch hash is then checked by exact containment.

Items come in blocks of about BLOCK, each broadcast; documents are read in place and
nothing of them is shuffled.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship
from ledgerloom.llm.shingles import Shingler, texts_of

BLOCK = 20_000  # items broadcast at once
MATCHES = "array<struct<item_id:long,n_shingles:int,n_shared:int>>"


class Sketches:
    """Sketches and shingle sets of a block of items."""

    def __init__(self, items: list[tuple[int, str]], k: int, containment: float):
        self.k, self.containment = k, containment
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        partitions: dict[tuple[int, int], list[int]] = defaultdict(list)
        shingler = Shingler(k)
        for item_id, text in items:
            words = shingler.words(text.encode())
            if len(words):
                self.ids.append(item_id)
                self.sets.append(np.unique(shingler.of_words(words)))
                # Items shorter than k words are one shingle of that many words.
                partitions[min(k, len(words)), len(self.sets[-1]).bit_length()].append(len(self.ids) - 1)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        entries: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for (length, _), members in partitions.items():
            most = max(len(self.sets[i]) for i in members)
            s = int((1 - containment) * most + 1e-9) + 1
            entries[length] += [(self.sets[i][:s], i) for i in members]
        for length, own in entries.items():
            hashes = np.concatenate([h for h, _ in own])
            of = np.repeat([i for _, i in own], [len(h) for h, _ in own])
            by = np.argsort(hashes, kind="stable")
            self.tables[length] = hashes[by], of[by]

    def matches(self, words: np.ndarray, shinglers: dict[int, Shingler]) -> list[dict]:
        found = []
        for length, (hashes, of) in self.tables.items():
            if len(words) < length:
                continue
            own = np.unique(shinglers[length].of_words(words))
            at, end = np.searchsorted(hashes, own), np.searchsorted(hashes, own, side="right")
            hit = np.flatnonzero(end > at)
            candidates = {int(i) for j in hit for i in of[at[j] : end[j]]}
            for i in sorted(candidates):
                asked = self.sets[i]
                where = np.minimum(np.searchsorted(own, asked), len(own) - 1)
                shared = int((own[where] == asked).sum())
                if shared >= self.containment * len(asked) - 1e-9:
                    found.append({"item_id": self.ids[i], "n_shingles": len(asked), "n_shared": shared})
        return sorted(found, key=lambda m: m["item_id"])


def match_columns(benchmark: DataFrame, k: int = 5, containment: float = 0.8) -> list[Column]:
    """For each block of items, a column over ``text`` with the items it holds."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    blocks = max(1, -(-items.count() // BLOCK))
    return [
        _column(spark.sparkContext.broadcast(Sketches([tuple(r) for r in own.collect()], k, containment)), k)
        for own in (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks))
    ]


def _column(sketches, k: int) -> Column:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int32()), ("n_shared", pa.int32())]))

    @F.arrow_udf(MATCHES)
    def held(texts: pa.Array) -> pa.Array:
        shinglers = {n: Shingler(n) for n in range(1, k + 1)}
        return pa.array([sketches.value.matches(shinglers[k].words(t), shinglers) for t in texts_of(texts)], kind)

    return held("text")


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, containment: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared and containment of each leaked item.

    A document holds an item if at least ``containment`` of the item's distinct k-word
    shingles are among its own; an item of fewer than k words is one shingle.  Items
    without id or words are in no document, null and empty texts hold nothing.  Repeated
    rows are reported each; an item id with several texts is reported for each text.
    Empty tables give no rows.  Other columns aren't read.
    """
    found = None
    for column in match_columns(benchmark, k, containment):
        rows = docs.select("doc_id", F.explode(column).alias("m")).select("doc_id", "m.*")
        found = rows if found is None else found.unionByName(rows)
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, containment: float = 0.8) -> DataFrame:
    """The rows of ``docs``, whole, that hold no item."""
    for column in match_columns(benchmark, k, containment):
        docs = docs.where(F.size(column) == 0)
    return docs
