import random
from collections import Counter

import fixtures
import pytest
from ledgerloom.llm import graph, ngram_join
from pyspark.sql import functions as F


def brute(rows, k, num, den):
    """(doc_id, n, component) of each row by comparing all pairs."""
    sets = [fixtures.shingle_set(t, k) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows)]


def family(rng, base, first, sizes, edits):
    return [(first + i, fixtures.edited(rng, base, edits[i % len(edits)]) if i else base, "s") for i in range(sizes)]


def corpus():
    rng = random.Random(9)
    rows = fixtures.odd_texts()
    common = fixtures.prose(rng, 50)
    rows += [(1000 + i, f"{fixtures.prose(rng, 30)} {common} {fixtures.prose(rng, 30)}", "s") for i in range(40)]
    rows += family(rng, fixtures.prose(rng, 150), 2000, 80, [1, 2, 3, 4, 5, 6, 8])  # many near copies, few links
    rows += family(rng, fixtures.prose(rng, 150), 3000, 40, [0, 1])
    chain = fixtures.prose(rng, 100).split()  # each links with the next only
    for i in range(30):
        rows.append((4000 + i, " ".join(chain), "s"))
        chain = [*chain[1:], f"c{i}"] if i % 2 else [*chain, f"c{i}"]
    rows += [(5000 + i, " ".join(["la"] * n), "s") for i, n in enumerate([3, 4, 50, 2, 1])]
    rows += [(6000 + i, t, "s") for i, t in enumerate(["a b", "A B", "a b c", "a  b\tc", "b a"])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (3, 60, 100)])
def test_against_all_pairs(spark, k, num, den):
    rows = corpus()
    got = ngram_join.join_documents(fixtures.documents(spark, rows).repartition(5), k, num, den)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(brute(rows, k, num, den))


def link_counts(rows, k, num, den):
    """(doc_id, links) of each row by comparing all pairs."""
    sets = [fixtures.shingle_set(t, k) for _, t, _ in rows]
    linked = lambda a, b: bool(a and b) and den * len(a & b) >= num * len(a | b)
    return Counter((d, sum(linked(sets[i], b) for j, b in enumerate(sets) if i != j)) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("k,num,den,block,spread", [(3, 90, 100, 512, 1024), (5, 80, 100, 7, 5), (3, 60, 100, 3, 1)])
def test_links_are_counted_whole(spark, monkeypatch, k, num, den, block, spread):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SPREAD", spread)
    rows = corpus()
    got = ngram_join.join_documents(fixtures.documents(spark, rows).repartition(4), k, num, den)
    assert Counter((r.doc_id, r.n_links) for r in got.collect()) == link_counts(rows, k, num, den)


@pytest.mark.parametrize("kind", ["int", "string", "decimal(20,0)"])
def test_ids_of_other_types_lose_no_link(spark, kind):
    rows = list({r[0]: r for r in corpus() if r[0] is not None}.values())
    docs = fixtures.documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind))
    got = ngram_join.join_documents(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    sizes = Counter(r.component_id for r in got.collect() if r.n_shingles)
    assert Counter(sizes.values()) == Counter(Counter(c for _, n, c in brute(rows, 3, 90, 100) if n).values())
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    assert Counter(r.n_links for r in ngram_join.join_documents(named).collect()) == Counter(n for _, n in link_counts(rows, 3, 90, 100).elements())


def test_counters_do_not_change_the_answer(spark, monkeypatch):
    rows = corpus()
    expected = Counter(brute(rows, 3, 90, 100))
    monkeypatch.setattr(ngram_join, "word_counts", lambda docs, k: __import__("numpy").zeros(ngram_join.COUNTERS, dtype="int32"))
    got = ngram_join.join_documents(fixtures.documents(spark, rows), 3, 90, 100)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == expected


def test_one_of_each_group_stays_whole(spark):
    rows = corpus()
    docs = fixtures.documents(spark, rows)
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    answer = brute(rows, 5, 80, 100)
    wordless = [d for (d, n, _) in answer if n == 0 and d is not None]
    groups = {c for (d, n, c) in answer if n and c is not None}
    named = [r.doc_id for r in got if r.doc_id is not None and fixtures.words(r.text)]
    assert set(named) == groups
    assert Counter(r.doc_id for r in got if r.doc_id is not None and not fixtures.words(r.text)) == Counter(wordless)
    assert sum(r.doc_id is None for r in got) == sum(d is None for d, _, _ in rows)


def test_empty_table(spark):
    assert ngram_join.join_documents(fixtures.documents(spark, [])).count() == 0
    assert ngram_join.one_of_each_group(fixtures.documents(spark, [])).count() == 0


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1100)]
    edges += [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
