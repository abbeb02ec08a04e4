import random

import fixtures
import pytest
from ledgerloom.llm import decontaminate

ITEMS = "item_id long, text string, doc_id int, n_shared int"


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(8)
    items = [(i, fixtures.prose(rng, rng.randrange(8, 70))) for i in range(30)]
    items += [(30, "just three words"), (31, "w1"), (32, None), (33, ""), (None, "no id at all here ok"), (34, items[0][1]), (5, items[6][1])]
    rows = fixtures.odd_texts()
    for j in range(60):
        i, t = items[rng.randrange(30)]
        hidden = fixtures.edited(rng, t, j % 4)
        around = fixtures.prose(rng, rng.randrange(1, 3000)).split()
        at = rng.randrange(len(around))
        rows.append((1000 + j, " ".join([*around[:at], hidden.upper() if j % 5 == 0 else hidden, *around[at:]]), "s"))
    rows += [(2000, "say JUST\tthree words\nplease", "s"), (2001, items[2][1], "s"), (2001, items[2][1], "s"), (None, items[3][1], "s")]
    return items, rows


def brute(items, rows, k, share):
    out = []
    sets = [(i, fixtures.shingle_set(t, k), min(k, len(fixtures.words(t)))) for i, t in dict.fromkeys(items) if i is not None and fixtures.words(t)]
    for d, t in rows:
        own = {n: fixtures.shingle_set(t, n) if len(fixtures.words(t)) >= n else set() for n in range(1, k + 1)}
        for i, s, n in sets:
            shared = len(s & own[n])
            if shared >= share * len(s):
                out.append((d, i, len(s), shared))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [0.8, 0.5, 1.0])
def test_against_brute_force(spark, case, share, monkeypatch):
    items, rows = case
    monkeypatch.setattr(decontaminate, "BLOCK", 10)
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    got = decontaminate.find_leaks(fixtures.documents(spark, rows), bench, containment=share)
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()), key=str) == brute(
        items, [(d, t) for d, t, _ in rows], 5, share
    )


def test_without_leaks_keeps_whole_clean_rows(spark, case):
    items, rows = case
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    docs = fixtures.documents(spark, rows)
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns
    leaky = {(d, t) for d, t, _ in rows if brute(items, [(d, t)], 5, 0.8)}
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(str((d, t)) for d, t, _ in rows if (d, t) not in leaky)


def test_empty_tables(spark, case):
    items, rows = case
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    assert decontaminate.find_leaks(fixtures.documents(spark, []), bench).count() == 0
    assert decontaminate.find_leaks(fixtures.documents(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(fixtures.documents(spark, rows), bench.limit(0)).count() == len(rows)
