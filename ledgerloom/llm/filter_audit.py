"""What filters of a corpus remove, in every order they could run in.

A document's failures are a mask of bits, one per filter.  The corpus is reduced to
cells: how many documents of each part have each mask, and how many of those are good
or toxic.  A recursive query then extends prefixes of filter orders by one unused
filter a level, carries the bits applied so far, and says for each mask what that step
does to it; joined with the cells this gives every step's counts.

Only the cells grow with the corpus, by parts: prefixes and masks are at most 326 x 32.
"""

from __future__ import annotations

import hashlib
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import ship, staged, text_or_empty

FILTERS = {"A": 1, "B": 2, "C": 4, "D": 8, "E": 16}  # letter and bit
MIN_WORDS = 200
MIN_DISTINCT = 50  # per cent of the words
MAX_CAPITALS = 2  # per cent of the code points
MARKS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that don't begin a code point


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails.  Words are parted by ASCII white space."""
    words = text.split()
    size = len(text)
    capitals = size - len(text.translate(None, _CAPITALS))
    return (
        FILTERS["A"] * (len(words) < MIN_WORDS)
        | FILTERS["B"] * (100 * len(set(words)) < MIN_DISTINCT * len(words))
        | FILTERS["C"] * (100 * capitals > MAX_CAPITALS * len(text.translate(None, _INNER)))
        | FILTERS["D"] * (len(text.translate(None, MARKS)) < size)
    )


def _read(texts: pa.Array) -> pa.Array:
    """Mask and SHA-256 of each text."""
    found = [(failures(t), hashlib.sha256(t).digest()) for t in texts.cast(pa.binary()).to_pylist()]
    columns = [pa.array([m for m, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())]
    return pa.StructArray.from_arrays(columns, ["mask", "digest"])


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by what they fail.

    A null text is empty; a null source and an empty one are one part.  Filter E fails a
    text that a smaller doc_id has too, anywhere in the table; a row without an id has
    none smaller, nor is it smaller than any.  Repeated rows count each.  A document is
    good (toxic) if any of its labels says so.
    """
    ship(docs.sparkSession)
    read = F.arrow_udf(_read, "struct<mask:int,digest:binary>")(text_or_empty())
    seen = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), read.alias("r"))
    rows = staged(
        seen.select("doc_id", "part", "r.mask", "r.digest").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n")),
        "filter-rows",
    )
    # Whoever has a text first passes E, so rows meet the first by id and not by the
    # text, of which there may be any number of copies.
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    told = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"),
    )
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (
        rows.join(first.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
        .join(told, "doc_id", "left")
        .withColumn("mask", F.col("mask") + F.when(later, FILTERS["E"]).otherwise(0))
        .groupBy("part", "mask")
        .agg(*(F.sum(F.col("n") * x).alias(name) for name, x in (
            ("n", F.lit(1)), ("good", F.coalesce("good", F.lit(0))), ("toxic", F.coalesce("toxic", F.lit(0))))))
    )


_KNOWN = ", ".join(f"named_struct('letter', '{k}', 'bit', {b})" for k, b in FILTERS.items())
_LEVELS = f"""
WITH RECURSIVE levels (filter_order, letter, bit, earlier, step, mask) AS (
  SELECT '', '', 0, 0, 0, mask FROM {{masks}}
  UNION ALL
  SELECT filter_order || next.letter, next.letter, next.bit, earlier | bit, step + 1, mask
  FROM (
    SELECT filter_order, bit, earlier, step, mask,
           explode(filter(array({_KNOWN}), f -> ((earlier | bit) & f.bit) = 0)) AS next
    FROM levels
  )
), steps AS (
  SELECT filter_order, letter, step, mask,
         mask & (earlier | bit) = 0 AS kept,
         mask & earlier = 0 AND mask & bit <> 0 AS removed,
         mask & earlier <> 0 AND mask & bit <> 0 AS redundant,
         mask = bit AS alone
  FROM levels WHERE step > 0
)
SELECT part, filter_order, letter, step,
       sum(if(kept, n, 0)) AS kept, sum(if(removed, n, 0)) AS removed, sum(if(redundant, n, 0)) AS redundant,
       sum(if(alone, n, 0)) AS unique_fails, sum(if(removed, good, 0)) AS good_lost, sum(if(removed, toxic, 0)) AS toxic_lost
FROM steps JOIN {{cells}} USING (mask)
GROUP BY part, filter_order, letter, step
"""


def steps(counted: DataFrame) -> DataFrame:
    """Counts of every step of every prefix of an order, per part; ``counted`` as ``cells`` gives it.

    Columns: part, filter_order (the prefix), letter (its last filter), step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost.
    """
    # At most 32 rows, and so are the partitions of every level.
    masks = counted.select("mask").distinct().coalesce(1)
    return counted.sparkSession.sql(_LEVELS, cells=counted, masks=masks)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of all filters and step in it.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (what the step's filter removes, summed over all
    orders).  A table without rows gives none.
    """
    found = staged(steps(staged(cells(docs, labels), "filter-cells")), "filter-steps")
    n = len(FILTERS)
    # A prefix of k filters begins (n - k)! orders.
    orders = F.element_at(F.array(*(F.lit(factorial(n - k)).cast("long") for k in range(1, n + 1))), F.col("step"))
    share = found.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    whole = found.where(F.col("step") == n).select("part", F.col("filter_order").alias("whole"))
    whole = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    whole = whole.withColumn("filter_order", F.expr("left(whole, step)"))
    return (
        whole.join(found, ["part", "filter_order", "step"]).join(share, ["part", "letter"])
        .select(
            "part", F.col("whole").alias("filter_order"), "step",
            *(F.col(c).cast("long").alias(c) for c in (
                "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")),
        )
    )
