import math
import random

import numpy as np
import pytest
from ledgerloom.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, query_id int, rank int, score string, x int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "s", 3) for i, v in rows], SCHEMA)


def brute(rows, k=5):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in good if i % 50 == 0}:
        best = {}
        for i, a in good:
            if i == q:
                for j, b in good:
                    if j != q and len(a) == len(b):
                        best[j] = max(best.get(j, -(2**70)), sum(x * y for x, y in zip(a, b, strict=True)))
        for rank, (s, j) in enumerate(sorted((-s, j) for j, s in best.items())[:k], 1):
            out.add((q, rank, j, -s))
    return out


def run(spark, rows, parts=3, k=5):
    got = topk.top_k(table(spark, rows).repartition(parts), F.col("vec_id") % 50 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return [tuple(r) for r in got.collect()]


def test_against_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(40)]) for i in range(400)]
    rows += [(i, rows[9][1]) for i in range(400, 460)]  # ties
    rows += [rows[50], rows[50], rows[7], (7, rows[8][1]), (100, rows[3][1])]  # repeats
    rows += [(None, rows[0][1]), (500, None), (501, [None] * 40), (502, [float("nan")] * 40), (550, [float("inf")] * 40)]
    rows += [(600, [0.5, 0.5]), (601, [1.0, 1.0]), (650, []), (651, []), (700, [1.0] * 7), (750, [1e20, 1.0]), (751, [1e-3, 3.0])]
    rows += [(800, [0.0] * 40)]
    expected = brute([(i, v) for i, v in rows if i not in (750, 751)])
    got = [r for r in run(spark, [(i, v) for i, v in rows if i not in (750, 751)])]
    assert len(got) == len(set(got)) and set(got) == expected


def test_scores_beyond_doubles_are_exact(spark):
    big = 2.0**31
    rows = [(50, [big, 1.0]), (1, [big, 1.0]), (2, [big, 2.0]), (3, [-1.0, 0.25])]
    ends = 2**63 - 1
    assert set(run(spark, rows)) == {(50, 1, 1, ends), (50, 2, 2, ends), (50, 3, 3, -(2**47) + 64 * 256)}


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i * 10, [rng.uniform(-1, 1) for _ in range(20)]) for i in range(150)]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    assert set(run(spark, rows)) == brute(rows)


def test_bounds_drop_most_pairs_early():
    rng = np.random.default_rng(0)
    spread = np.linspace(3, 0.02, 64)
    queries, columns = np.floor(256 * spread * rng.normal(size=(8, 64))), np.floor(256 * spread * rng.normal(size=(3000, 64))).T
    q, c, s = topk.best_pairs(queries, columns, np.full(8, -np.inf), np.full(8, -1), np.arange(3000), 5)
    assert len(q) < 100
    whole = queries @ columns
    for i in range(8):
        assert set(np.argsort(-whole[i], kind="stable")[:5]) <= set(c[q == i])
        assert (whole[i][c[q == i]] == s[q == i]).all()


@pytest.mark.parametrize("rows", [[], [(1, [0.5])], [(50, [0.5])]])
def test_nothing_to_find(spark, rows):
    assert run(spark, rows, parts=1) == []


def test_products_are_few_and_columns_go_whole():
    rng = np.random.default_rng(1)
    norms = rng.lognormal(0, 1, 4000)
    columns = np.floor(256 * norms * rng.normal(size=(64, 4000)) / 8)
    queries = np.floor(256 * rng.normal(size=(32, 64)) / 8)
    work = []
    q, c, s = topk.best_pairs(queries, columns, np.full(32, -np.inf), np.full(32, -1), np.arange(4000), 5, work)
    whole = queries @ columns
    assert sum(work) < whole.size * 64 / 4
    for i in range(32):
        best = np.argsort(-whole[i], kind="stable")[:5]
        assert set(best) <= set(c[q == i]) and (whole[i][c[q == i]] == s[q == i]).all()
    again = []
    floors = np.sort(whole, axis=1)[:, -5]
    topk.best_pairs(queries, columns, floors, np.full(32, -1), np.arange(4000), 5, again)
    assert sum(again) <= sum(work)


@pytest.mark.parametrize("n,d", [(3, 8), (70, 1), (200, 33), (5, 0)])
def test_tiles_of_all_shapes(n, d):
    rng = np.random.default_rng(n)
    queries, columns = np.floor(8 * rng.normal(size=(4, d))), np.floor(8 * rng.normal(size=(d, n)))
    own = np.array([0, 1, 500, 501])
    q, c, s = topk.best_pairs(queries, columns, np.full(4, -np.inf), own, np.arange(n), 5)
    whole = queries @ columns
    for i in range(4):
        others = [j for j in range(n) if j != own[i]]
        best = sorted((-whole[i, j] for j in others))[:5]
        assert sorted(-s[q == i])[:5] == best and own[i] not in c[q == i]
