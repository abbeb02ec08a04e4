"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Keys lie on a ring of 65,536 slots by the MD5 of their id; each shard owns
``vnodes`` places of the ring and takes the keys up to each of its places.  No
shard may hold more than its bound; keys that find it full continue clockwise to
the next shard with room.  The bounds sum to the number of rows, so shard sizes
differ by at most one (law ``rows``).

Rows are only counted and ranked per slot by Spark; the ring itself is settled on
the driver from the counts of the 65,536 slots, a fixed number whatever the input.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged, text_or_empty

SLOTS = 1 << 16
CHUNK = 1 << 14  # copies of a row that one task writes out
SUBS = 16  # parts of a slot: spreads one id that has many different texts


def _place_of(shard: int, node: int) -> int:
    return int(hashlib.md5(f"shard {shard} node {node}".encode()).hexdigest()[:4], 16)


def settle(counts: dict[int, int], shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of each slot go to which shard.

    ``counts`` holds the keys per slot.  Returns (slot, first rank, end rank, shard,
    number of the first of them in its shard).
    """
    ring = sorted((_place_of(s, v), s) for s in range(shards) for v in range(vnodes))
    places = [p for p, _ in ring]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    pieces: list[tuple[int, int, int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []

    # Clockwise from each place, the next one whose shard may have room: paths are halved
    # as they are walked, so all walks together take about one step a place.
    onward = list(range(len(ring)))

    def with_room(at: int) -> int:
        while True:
            while onward[at] != at:
                onward[at] = onward[onward[at]]
                at = onward[at]
            if used[ring[at][1]] < room[ring[at][1]]:
                return at
            onward[at] = (at + 1) % len(ring)

    def put(slot: int, begin: int, end: int, shard: int) -> int:
        n = min(end - begin, room[shard] - used[shard])
        if n > 0:
            pieces.append((slot, begin, begin + n, shard, used[shard]))
            used[shard] += n
        return begin + max(n, 0)

    # Slots come in scattered order, so that what overflows is spread over the ring.
    for slot in sorted(counts, key=lambda s: (s * 40503) % SLOTS):
        at = bisect_left(places, slot) % len(ring)
        rest = put(slot, 0, counts[slot], ring[at][1])
        if rest < counts[slot]:
            waiting.append((slot, rest, at))
    for slot, begin, at in waiting:
        while begin < counts[slot]:  # the rooms sum to the rows, so there is one
            begin = put(slot, begin, counts[slot], ring[with_room(at)][1])
    return pieces


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 64) -> DataFrame:
    """One row per document with its shard and its number there.

    Columns: doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot
    (0, 1, ... without gaps in each shard).  Other columns of ``docs`` are not read.
    A null text counts as empty; a null id is a key like any other.  Repeated rows
    are counted together and numbered one by one.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = text_or_empty()
    keys = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    keys = staged(
        keys.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("_key", digest)
        .withColumn("_slot", F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"))
        .withColumn("_sub", F.pmod(F.xxhash64("size", "text_crc32"), F.lit(SUBS)).cast("int")),
        "ring-keys",
    )
    parts = keys.groupBy("_slot", "_sub").agg(F.sum("copies").alias("_n"))
    counts = {r["_slot"]: r["n"] for r in parts.groupBy("_slot").agg(F.sum("_n").alias("n")).collect()}
    pieces = spark.createDataFrame(
        settle(counts, shards, vnodes),
        "_slot int, _from long, _to long, shard int, _base long",
    )
    before = Window.partitionBy("_slot").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "_slot", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    order = Window.partitionBy("_slot", "_sub").orderBy("_key", "doc_id", "text_crc32", "size")
    ends = F.col("_offset") + F.sum("copies").over(order)
    ranked = keys.join(parts, ["_slot", "_sub"]).withColumn("_end", ends).drop("_sub", "_key")
    ranked = ranked.withColumn("_start", F.col("_end") - F.col("copies"))
    # At most one piece for each slot and one more for each full shard.
    placed = ranked.join(F.broadcast(pieces), "_slot").where((F.col("_start") < F.col("_to")) & (F.col("_end") > F.col("_from")))
    placed = placed.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_base") - F.col("_from")).alias("_shift"),
        F.greatest("_start", "_from").alias("_lo"), F.least("_end", "_to").alias("_hi"),
    )
    # Rows become single ones in runs of CHUNK, dealt over tasks: one row may be repeated
    # as often as a third of the table.
    runs = placed.withColumn("_at", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1, F.lit(CHUNK).cast("long"))))
    runs = runs.repartition("doc_id", "_at")
    each = F.sequence(F.col("_at"), F.least(F.col("_at") + CHUNK, F.col("_hi")) - 1)
    return runs.withColumn("_rank", F.explode(each)).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_shift") + F.col("_rank")).alias("slot")
    )
