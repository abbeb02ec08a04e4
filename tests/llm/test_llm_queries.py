"""The registered queries, their SQL twins and the pipeline's stages."""

from collections import Counter

import __spark_entry__ as contract
import corpus_pipeline
import duckdb
import fixtures
import pytest
from ledgerloom.llm import common, decontaminate, mixing, ngram_join, quality
from ledgerloom.llm.oracle import ORACLE
from ledgerloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())
    assert [n.split("_")[0] for n in QUERIES] == [*(f"op{i}" for i in range(1, 14)), "pipeline"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    expected = con.execute(ORACLE[name])
    names = [d[0] for d in expected.description]
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r) for r in got.select(names).collect()) == Counter(expected.fetchall())


def test_ngram_join_of_the_table_against_all_pairs(spark):
    from test_ngram_join import brute, link_counts

    docs = common.read(spark, SF_DIR, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = QUERIES["op10_ngram_join"](spark, SF_DIR).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows, 3, 90, 100))
    assert Counter((r.doc_id, r.n_links) for r in got) == link_counts(rows, 3, 90, 100)


def test_secrets_of_the_table_against_plain_rules(spark):
    import hashlib

    from test_secret_scan import brute

    rows = common.read(spark, SF_DIR, "documents").collect()
    got = {r.doc_id: r for r in QUERIES["op6_secrets"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    for r in rows:
        found = brute(r.text)
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        mine = got[r.doc_id]
        assert (mine.spans, mine.base_sha256) == (spans, hashlib.sha256(spans.encode()).hexdigest())
        assert (mine.n_assign, mine.n_access, mine.n_hex) == tuple(sum(k == kind for k, _, _ in found) for kind in ("assign", "access", "hex"))


def test_pipeline_is_its_stages_one_after_another(spark):
    docs = common.read(spark, SF_DIR, "documents").cache()
    labels = common.read(spark, SF_DIR, "labels")
    keep = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r.predicted == 1}
    first = corpus_pipeline.reject_low_quality(spark, docs, SF_DIR).cache()
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == keep
    second = corpus_pipeline.drop_near_duplicates(spark, first, SF_DIR).cache()
    from test_ngram_join import brute

    rows = [(r.doc_id, r.text, r.source) for r in first.collect()]
    assert {r.doc_id for r in second.collect()} == {c for _, _, c in brute(rows, 5, 80, 100)}
    third = corpus_pipeline.drop_leaks(spark, second, SF_DIR).cache()
    leaky = {r.doc_id for r in decontaminate.find_leaks(second, common.read(spark, SF_DIR, "benchmark")).collect()}
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - leaky
    fourth = corpus_pipeline.mix_sources(spark, third, SF_DIR).cache()
    passes = {r.doc_id: r.passes for r in mixing.plan(third).collect()}
    assert Counter(r.doc_id for r in fourth.collect()) == +Counter(passes)
    last = corpus_pipeline.shard_rows(spark, fourth, SF_DIR).collect()
    assert Counter(r.doc_id for r in last) == +Counter(passes)
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, last))


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_bear_odd_rows_and_empty_tables(spark, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    docs = fixtures.documents(spark, fixtures.odd_texts())
    out = function(spark, docs, SF_DIR)
    assert out.count() > 0
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert function(spark, fixtures.documents(spark, []), SF_DIR).count() == 0


def test_ngram_join_has_no_python_between_the_lists_and_the_links():
    assert "applyInPandas" not in open(ngram_join.__file__).read()
