from collections import Counter, defaultdict

import fixtures
import numpy as np
import pytest
from ledgerloom.llm import mixing


def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        whole = sum(weight[s] for s in names if s not in capped)
        goal = {s: 3 * sizes[s] if s in capped else left * weight[s] / whole for s in names}
        above = {s for s in names if goal[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not above:
            return goal
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 500}, {"a": 1, "b": 1, "c": 100_000, None: 5}, {"a": 0, "b": 7}, {"￿": 4, "\U00010000": 4, None: 4},
])
def test_targets(sizes):
    got, expected = mixing.targets(sizes), brute_targets(sizes)
    assert got.keys() == expected.keys()
    for s in got:
        assert got[s] == pytest.approx(expected[s])
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_targets_of_nothing():
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0.0}


def test_split_is_exact_and_even():
    counts = [1000, 10, 0, 333]
    quotas = mixing.split(counts, 6, seed=1)
    assert quotas.sum(axis=0).tolist() == counts
    assert quotas.sum(axis=1).max() - quotas.sum(axis=1).min() <= 3
    assert (quotas >= 0).all()
    assert (mixing.split(counts, 6, seed=1) == quotas).all()
    means = np.mean([mixing.split(counts, 4, seed=s)[0] for s in range(300)], axis=0)
    assert means == pytest.approx(np.array(counts) / 4, rel=0.15, abs=0.5)


def test_plan_meets_targets_and_limits(spark):
    rows = fixtures.odd_texts()
    got = mixing.plan(fixtures.documents(spark, rows)).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((i, len(fixtures.words(t)), s) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(fixtures.words(t))
    goal = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.taken == r["size"] * r.passes and 0 <= r.passes <= 3
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        smallest = [len(fixtures.words(t)) for _, t, x in rows if x == s]
        assert abs(taken[s] - goal[s]) <= max(smallest) / 2 + 1


def test_reruns_and_other_partitions_agree(spark):
    docs = fixtures.documents(spark, fixtures.odd_texts())
    key = lambda r: (str(r.doc_id), r["size"], str(r.source), r.taken)
    assert sorted(map(key, mixing.plan(docs).collect())) == sorted(map(key, mixing.plan(docs.repartition(5)).collect()))


def test_draw_is_the_plan_cut_into_shards(spark):
    planned = mixing.plan(fixtures.documents(spark, fixtures.odd_texts())).cache()
    drawn = mixing.draw(planned, shards=4).collect()
    assert len(drawn) == sum(r.passes for r in planned.collect())
    assert {r.shard for r in drawn} <= set(range(4))
    # A source's block in a pass is in one shard.
    where = defaultdict(set)
    for r in drawn:
        where[r.source, r._block, r.copy].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_mixed_rows_are_whole_and_repeated(spark):
    docs = fixtures.documents(spark, fixtures.odd_texts())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    expected = Counter()
    for r in mixing.plan(docs).collect():
        expected[r.doc_id, r["size"]] += r.passes
    assert Counter((r.doc_id, len(fixtures.words(r.text))) for r in out.collect()) == +expected


def test_empty_table(spark):
    empty = fixtures.documents(spark, [])
    assert mixing.plan(empty).count() == 0 and mixing.mixed(empty).count() == 0 and mixing.draw(mixing.plan(empty)).count() == 0


def left_out(got):
    """Of each source, by how much the mix misses its target and the smallest document of
    some words that the partial pass leaves out."""
    gap, least, full = defaultdict(float), {}, {}
    for r in got:
        gap[r.source] += r.taken
        full[r.source] = min(full.get(r.source, r.passes), r.passes)
    for r in got:
        if r["size"] and r.passes == full[r.source]:
            least[r.source] = min(least.get(r.source, r["size"]), r["size"])
    return {r.source: (abs(gap[r.source] - r.target), least.get(r.source)) for r in got}


def test_no_document_left_out_would_bring_a_source_closer(spark):
    long = ("a long one " * 7000).strip()
    for seed in range(4):  # the long document comes early in some orders
        rows = [(0, long, "b")] + [(i, f"{i} " * 100, "b") for i in range(1, 201)] + [(1000 + i, "w " * 40, "a") for i in range(900)]
        for r in (fixtures.odd_texts(), rows):
            for off, least in left_out(mixing.plan(fixtures.documents(spark, r), seed=seed).collect()).values():
                assert least is None or off <= least / 2 + 1


def test_the_tree_decides_what_is_returned(spark, monkeypatch):
    docs = fixtures.documents(spark, fixtures.odd_texts())
    drawn = mixing.draw(mixing.plan(docs)).orderBy("shard", "_shuffle").collect()
    assert [(r.doc_id, r.source, len(fixtures.words(r.text))) for r in mixing.mixed(docs).collect()] == [(r.doc_id, r.source, r["size"]) for r in drawn]
    where = Counter((r.doc_id, r.source, s) for r in mixing.counted(mixing.plan(docs)).collect() for s in r.shards)
    assert where == Counter((r.doc_id, r.source, r.shard) for r in drawn) and len({s for _, _, s in where}) == 8
    # With quotas that leave the last shard's blocks out, their documents go.
    whole = mixing.split
    monkeypatch.setattr(mixing, "split", lambda c, n, seed: whole(c, n, seed) * (np.arange(n) < n - 1)[:, None])
    assert mixing.mixed(docs).count() < len(drawn)
    assert sum(r.passes for r in mixing.counted(mixing.plan(docs)).collect()) < len(drawn)


def test_the_query_counts_what_is_drawn(spark):
    from ledgerloom.llm.queries import op4_mixing

    got = op4_mixing(spark, "/root/testdata/sf0.001").collect()
    assert all(len(r.shards) == r.passes and r.taken == r.passes * r["size"] for r in got)
    assert {s for r in got for s in r.shards} == set(range(8))
