import itertools
import random
from collections import Counter

import fixtures
from ledgerloom.llm import filter_audit as A
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int, part string, mask int, n int"


def mask_of(text: str | None) -> int:
    text = text or ""
    words = fixtures.words(text)
    return (
        (len(words) < 200)
        + 2 * (100 * len(set(words)) < 50 * len(words))
        + 4 * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text))
        + 8 * any(c in "#$%&*|" for c in text)
    )


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    docs = []
    for d, text, source in rows:
        mask = mask_of(text) + 16 * (d is not None and least[text or ""] < d)
        docs.append((source or "", mask, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        removed = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            gone = []
            for step, letter in enumerate(order, 1):
                bit = A.FILTERS[letter]
                now = [x for x in left if x[0] & bit]
                left = [x for x in left if not x[0] & bit]
                removed[letter] += len(now)
                out[part, "".join(order), step] = [
                    len(left), len(now), sum(bool(x[0] & bit) for x in gone), sum(x[0] == bit for x in mine),
                    sum(x[1] for x in now), sum(x[2] for x in now), letter,
                ]
                gone = gone + now
        for key, row in out.items():
            if key[0] == part:
                row[6] = removed[row[6]]
    return {k: tuple(v) for k, v in out.items()}


def table(spark, rows):
    return fixtures.documents(spark, rows).withColumnRenamed("blob", "mask").withColumnRenamed("row", "digest").withColumnRenamed("slot", "n")


def test_every_order_against_running_the_filters(spark):
    rng = random.Random(3)
    rows = fixtures.odd_texts()
    rows += [(400 + i, ("The #WORD " if i % 3 else "x y ") * rng.randrange(1, 300), "src0" if i % 2 else "") for i in range(40)]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in rows for _ in range(rng.randrange(3))]
    told = spark.createDataFrame([(*x, "p", 1, 2) for x in labels], LABELS)
    got = A.audit(table(spark, rows), told).collect()
    mine = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(mine) == len(got) and mine == brute(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert A.audit(table(spark, []), none).count() == 0
    one = A.audit(table(spark, [(1, None, None)]), none).collect()
    assert len(one) == 600 and all((r.part, r.kept + r.removed + r.redundant) in (("", 1), ("", 2)) for r in one if r.filter_order[r.step - 1] == "A") and {
        r.shapley for r in one if r.filter_order[r.step - 1] == "A"
    } == {120}


def test_a_text_that_fills_a_third_of_the_table(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"w{i}", "s") for i in range(3000)] + [(0, "same text", "s")] * 500
    docs = table(spark, rows)
    cells = A.cells(docs, spark.createDataFrame([], LABELS)).collect()
    assert {(c.part, c["mask"]): c.n for c in cells} == {("s", 1): 2000 + 501, ("s", 17): 999}


def test_the_levels_hold_a_bounded_number_of_rows(spark):
    cells = spark.range(32).select(F.lit("p").alias("part"), F.col("id").cast("int").alias("mask"), *(F.lit(1).alias(c) for c in ("n", "good", "toxic")))
    found = A.steps(cells).collect()
    assert len(found) == 5 + 20 + 60 + 120 + 120
    assert all(r.kept + r.removed + r.redundant <= 32 and r.kept == 32 >> r.step and r.removed == 32 >> r.step for r in found)
