"""The shape of plans: what reaches the scan, what is shuffled, what is never there."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.operators import listings, recurring, reports
from ledgerloom.sources.parquet import read_ledger, write_ledger, write_rollup
from ledgerloom.sources.testbed import AS_OF, load_ledger

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The adapter's ledger, stored with text ids and a rollup."""
    root = str(tmp_path_factory.mktemp("ledger"))
    book = load_ledger(spark, SF_DIR)
    ids = ("id", "user_id", "category_id")
    book = book.with_tables(
        **{
            name: t.select(
                *[F.col(c).cast("string").alias(c) if c in ids else F.col(c) for c in t.columns]
            )
            for name, t in book.tables().items()
        }
    )
    typed = book.transactions.withColumn("created_at", F.col("created_at").cast("timestamp"))
    book = book.with_tables(transactions=typed)
    write_ledger(book, root)
    write_rollup(book, root)
    return root


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"refresh_monthly_totals", "refresh_redelivered", "onboard_stream", "run_due_schedules"}))
def test_no_python_cross_joins_or_single_tasks(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF_DIR))
    for banned in ("Python", "CartesianProduct", "NestedLoop", "SinglePartition", "GlobalLimit"):
        assert banned not in text, banned


def test_periods_reach_the_scan(spark, stored):
    book = read_ledger(spark, stored)
    for df in (
        reports.monthly_calendar(book, 1998, 3),
        reports.monthly_report(book, 1998, 3),
        reports.annual_report(book, 1998, AS_OF),
        listings.list_transactions_by_date(book, date(1998, 3, 15)),
    ):
        text = plan(df)
        assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(date", text)
        assert re.search(r"PartitionFilters: \[[^]]*date_year", text)


def test_scans_read_only_what_is_needed(spark, stored):
    text = plan(reports.all_time_balance(read_ledger(spark, stored)))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any(s.startswith("user_id:string,amount") for s in scans)
    assert all("note" not in s and "category_id" not in s for s in scans)


def test_user_filter_reaches_the_scan(spark, stored):
    text = plan(reports.all_time_balance(read_ledger(spark, stored), user_id="7"))
    assert text.count("EqualTo(user_id,7)") >= 1


def test_top_k_prunes_before_the_shuffle(spark, stored):
    book = read_ledger(spark, stored)
    for df in (reports.top_categories_all_time(book), reports.recent_years_summary(book)):
        text = plan(df)
        partial = text.index("WindowGroupLimit", text.index("WindowGroupLimit") + 1)
        assert "Exchange" in text[text.index("WindowGroupLimit") : partial]


def test_expansion_needs_no_shuffle(spark, stored):
    text = plan(recurring.expand_all_schedules(read_ledger(spark, stored), AS_OF))
    assert "Exchange" not in text


def test_rollup_gives_the_same_reports(spark, stored):
    raw, rolled = read_ledger(spark, stored), read_ledger(spark, stored, rollup=True)
    for report in (
        lambda book: reports.monthly_report(book, 1998, 3),
        lambda book: reports.category_trend(book, 2001, AS_OF),
        lambda book: reports.annual_report(book, 2001, AS_OF),
        lambda book: reports.annual_trend(book, 1998),
        lambda book: reports.annual_categories(book, 1998),
        lambda book: reports.all_time_balance(book),
        lambda book: reports.all_time_categories(book),
        lambda book: reports.top_categories_all_time(book),
        lambda book: reports.recent_years_summary(book),
        lambda book: reports.top_categories_recent_years(book),
        lambda book: reports.yearly_trends(book, "expense"),
        lambda book: reports.all_time_totals(book),
        lambda book: reports.monthly_summary_nested(book, 1998, 3),
    ):
        a, b = report(raw), report(rolled)
        assert "monthly_activity" in plan(b)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_stored_ledger_is_the_same(spark, stored):
    book, origin = read_ledger(spark, stored), load_ledger(spark, SF_DIR)
    for name, table in book.tables().items():
        assert table.count() == getattr(origin, name).count()
    assert book.transactions.where("id = '1'").count() == 1


def test_constraints_read_each_table_twice(spark, stored):
    """Once for row rules and references together, once for keys; parents' ids besides."""
    from ledgerloom.operators import quality

    text = plan(quality.check_constraints(read_ledger(spark, stored)))
    for name in ("transactions", "financial_goals", "fixed_costs", "fixed_investments"):
        assert len(re.findall(rf"FileScan parquet [^\n]*/{name}\]", text)) == 2, name


def test_constraints_merge_rows_with_parents(spark, stored):
    """Ids of profiles and categories grow with the users, so they are not broadcast."""
    from ledgerloom.operators import quality

    text = plan(quality.check_constraints(read_ledger(spark, stored)))
    assert "Broadcast" not in text and len(re.findall(r"SortMergeJoin [^\n]*LeftOuter", text)) >= 10


def test_guarded_changes_read_the_categories_once(spark, stored):
    from ledgerloom.operators import changes

    book = read_ledger(spark, stored)
    batch = spark.createDataFrame([("1", "1", "x")], "id string, user_id string, color string")
    text = plan(changes.category_changes_guarded(book.categories, batch, batch))
    assert len(re.findall(r"FileScan parquet [^\n]*/categories\]", text)) == 1


def test_recent_years_read_the_transactions_once(spark, stored):
    text = plan(reports.top_categories_recent_years(read_ledger(spark, stored)))
    assert len(re.findall(r"FileScan parquet [^\n]*ReadSchema: struct<[^>]*date:date", text)) == 1
    assert text.count("Exchange hashpartitioning") <= 6


def test_balances_are_merged_with_profiles(spark, stored):
    """Their number is not known from their compressed size, so they are not broadcast."""
    from ledgerloom.plans import balance

    book = read_ledger(spark, stored)
    for df in (
        reports.all_time_balance(book), balance.report(balance.balance_of(book.transactions), book.profiles)
    ):
        joins = re.findall(r"(\w+Join) [^\n]*LeftOuter", plan(df))
        assert joins == ["SortMergeJoin"]
