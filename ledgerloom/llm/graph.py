"""Connected components of a distributed edge list, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long): root is the smallest node
    that it is connected with.

    Each round links every node's larger neighbours, then its smaller ones, to the
    smallest neighbour; after about log(nodes) rounds only stars are left.  Edges are
    written to the shared folder each round and never collected.
    """
    now = staged(_clean(edges.select("a", "b")), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _clean(large)
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = staged(_clean(small), "edges")
        was, mark = mark, _mark(now)
        if was == mark:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _clean(edges: DataFrame) -> DataFrame:
    """Larger node first, no loops, no repeats."""
    return (
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first()
    return tuple(row)
