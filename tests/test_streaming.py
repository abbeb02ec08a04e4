import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reports
from ledgerloom.plans.activity import activity, monthly_rollup
from ledgerloom.sources.testbed import load_ledger
from ledgerloom.streaming import refresh
from ledgerloom.streaming import signups as onboarding
from small import ledger, profile, rows

SF_DIR = "/root/testdata/sf0.001"
KEYS = ("user_id", "month", "type", "total_amount", "transaction_count")


def totals(df):
    return sorted(tuple(row) for row in refresh.monthly_totals(df).select(*KEYS).collect())


@pytest.fixture
def arriving(spark, tmp_path):
    """Transactions landing as several files, one micro-batch each."""
    book = load_ledger(spark, SF_DIR)
    source = str(tmp_path / "arriving")
    book.transactions.repartition(6, "id").write.parquet(source)
    stream = (
        spark.readStream.schema(book.transactions.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(source)
    )
    return book, stream, source, str(tmp_path / "store"), str(tmp_path / "checkpoint")


def run(stream, store, checkpoint):
    refresh.start_refresh(stream, store, checkpoint, availableNow=True).awaitTermination()


def test_batches_and_compaction(spark, arriving):
    book, stream, source, store, checkpoint = arriving
    expected = totals(activity(book))
    run(stream, store, checkpoint)
    assert totals(refresh.read_activity(spark, store)) == expected
    # A batch without rows adds nothing.
    refresh.write_batch(book.transactions.limit(0), 99, store)
    assert totals(refresh.read_activity(spark, store)) == expected
    assert refresh.compact(spark, store) == 99
    assert refresh.compact(spark, store) == 99
    assert totals(refresh.read_activity(spark, store)) == expected
    # An unfinished base is ignored.
    (spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")).parquet(
        f"{store}/base/through=100"
    )
    assert totals(refresh.read_activity(spark, store)) == expected


def test_restart_picks_up_new_files_only(spark, arriving):
    book, stream, source, store, checkpoint = arriving
    run(stream, store, checkpoint)
    refresh.compact(spark, store)
    more = book.transactions.where("id < 100").withColumn("id", F.col("id") + 1000000)
    more.coalesce(1).write.mode("append").parquet(source)
    run(stream, store, checkpoint)
    both = book.with_tables(transactions=book.transactions.unionByName(more))
    assert totals(refresh.read_activity(spark, store)) == totals(activity(both))


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    book, store = load_ledger(spark, SF_DIR), str(tmp_path / "store")
    for _ in range(2):
        refresh.write_batch(book.transactions, 0, store)
    assert totals(refresh.read_activity(spark, store)) == totals(activity(book))


def test_stored_totals_serve_reports(spark, tmp_path):
    book, store = load_ledger(spark, SF_DIR), str(tmp_path / "store")
    refresh.write_batch(book.transactions.where("id % 2 = 0"), 0, store)
    refresh.write_batch(book.transactions.where("id % 2 = 1"), 1, store)
    served = book.with_tables(monthly_activity=refresh.read_activity(spark, store))
    for report in (reports.all_time_balance, reports.top_categories_all_time):
        assert sorted(map(str, report(served).collect())) == sorted(map(str, report(book).collect()))
    same = monthly_rollup(activity(book)).select("n").groupBy().sum().first()[0]
    assert same == book.transactions.count()


def test_empty_store(spark, tmp_path):
    with pytest.raises(ValueError):
        refresh.read_activity(spark, str(tmp_path))


def test_folding_and_cleaning_while_running(spark, arriving):
    book, stream, _, store, checkpoint = arriving
    query = refresh.start_refresh(stream, store, checkpoint, fold_every=2, keep=1, availableNow=True)
    assert query.awaitTermination(300)
    assert totals(refresh.read_activity(spark, store)) == totals(activity(book))
    assert refresh._finished(spark, f"{store}/base", "through") == [5]
    assert refresh._finished(spark, f"{store}/deltas", "batch_id") == [4, 5]


def redelivered(book):
    """Batches with rows again in the same batch, in later ones, and late rows of old months."""
    rows = book.transactions
    return [
        rows.where("id % 4 = 0"), rows.where("id % 4 IN (0, 1)").unionByName(rows.where("id % 4 = 1")),
        rows.where("id % 4 = 2 AND date >= '1997-01-01'"), rows.where("id % 4 IN (2, 3)"), rows.where("id % 9 = 0"), rows.limit(0),
    ]


def test_rows_delivered_again_count_once(spark, tmp_path):
    book, store = load_ledger(spark, SF_DIR), str(tmp_path / "store")
    for n, batch in enumerate(redelivered(book)):
        refresh.write_batch(batch, n, store, once=True)
        if n == 3:  # done again, as after a crash
            refresh.write_batch(batch, n, store, once=True)
    assert totals(refresh.read_activity(spark, store)) == totals(activity(book))


def test_rows_of_months_seen_before(spark, tmp_path):
    book, store = load_ledger(spark, SF_DIR), str(tmp_path / "store")
    refresh.write_batch(book.transactions.where("date < '1998-03-01'"), 0, store, once=True)
    again = book.transactions.where("date >= '1998-02-01' AND date < '1998-04-01'")
    assert refresh._not_seen(again, 1, store).count() == book.transactions.where("date >= '1998-03-01' AND date < '1998-04-01'").count()


def test_a_batch_is_dealt_and_sorted_once(spark, tmp_path):
    """Its rows meet earlier ids where they were dealt by id, and serve ids and totals."""
    book, store = load_ledger(spark, SF_DIR), str(tmp_path / "store")
    refresh.write_batch(book.transactions.where("id % 4 = 0"), 0, store, once=True)
    late = refresh._not_seen(book.transactions.unionByName(book.transactions), 1, store)
    try:
        text = late._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" in text and "SortMergeJoin" in text and "Broadcast" not in text
        assert text.count("Exchange hashpartitioning(id") <= 2 * text.count("SortMergeJoin")
        assert late.count() == book.transactions.where("id % 4 <> 0").count()
    finally:
        late.unpersist()
    refresh.write_batch(book.transactions, 1, store, once=True)
    assert not late.is_cached
    assert totals(refresh.read_activity(spark, store)) == totals(activity(book))


def test_rows_without_an_id_are_not_counted_once(spark, tmp_path):
    book, store = load_ledger(spark, SF_DIR), str(tmp_path / "store")
    damaged = book.transactions.withColumn("id", F.when(F.col("id") % 5 != 0, F.col("id")))
    refresh.write_batch(damaged, 0, store, once=True)
    kept = book.with_tables(transactions=damaged.where("id IS NOT NULL"))
    assert totals(refresh.read_activity(spark, store)) == totals(activity(kept))


def signups(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, email string, metadata string")


def test_signups_in_batches(spark, tmp_path):
    book, root = ledger(spark, profiles=[profile("old")]), str(tmp_path / "new")
    assert onboarding.read_onboarded(book, root).profiles.count() == 1
    first = signups(spark, ("a", "a@x", '{"name": "Ann"}'), ("a", "z@x", None), ("old", "o@x", None), ("b", "b@x", "no json"))
    second = signups(spark, ("a", "a@x", '{"name": "Ann"}'), ("c", None, None))
    onboarding.write_signups(book, first, 0, root)
    for _ in range(2):  # the second time as after a crash
        onboarding.write_signups(book, second, 1, root)
        after = onboarding.read_onboarded(book, root)
        found = sorted(rows(after.profiles, "id", "name", "email", "currency"), key=str)
        assert found == [("a", "Ann", "a@x", "USD"), ("b", "", "b@x", "USD"), ("c", "", None, "USD"), ("old", None, None, "USD")]
        per_user = after.categories.groupBy("user_id").agg(F.count("*"), F.countDistinct("id"))
        assert sorted(rows(per_user)) == [(u, 11, 11) for u in "abc"]


def test_a_batch_is_seen_once_it_is_whole(spark, tmp_path, monkeypatch):
    book, root = ledger(spark, profiles=[profile("old")]), str(tmp_path / "new")
    onboarding.write_signups(book, signups(spark, ("a", "a@x", None)), 0, root)
    real = onboarding.changes.seed_default_categories
    monkeypatch.setattr(onboarding.changes, "seed_default_categories", lambda *a: (_ for _ in ()).throw(OSError("died")))
    batch = signups(spark, ("b", "b@x", None))
    with pytest.raises(OSError):
        onboarding.write_signups(book, batch, 1, root)
    assert sorted(rows(onboarding.read_onboarded(book, root).profiles, "id")) == [("a",), ("old",)]
    monkeypatch.setattr(onboarding.changes, "seed_default_categories", real)
    onboarding.write_signups(book, batch, 1, root)
    assert sorted(rows(onboarding.read_onboarded(book, root).profiles, "id")) == [("a",), ("b",), ("old",)]
