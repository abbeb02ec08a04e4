"""Properties that hold on any ledger, checked on the provided tables."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import recurring, reports
from ledgerloom.sources.testbed import AS_OF, load_ledger


@pytest.fixture(scope="module")
def book(spark):
    return load_ledger(spark, "/root/testdata/sf0.01")


def test_last_running_total_is_the_years(book):
    last = reports.annual_trend(book, 1998).where("month_number = 12")
    odd = last.where(
        "income_running_total <> income_year_total OR expense_running_total <> expense_year_total"
        " OR investment_running_total <> investment_year_total"
    )
    assert odd.count() == 0


def test_shares_of_a_type_add_up(book):
    sums = (
        reports.all_time_categories(book)
        .groupBy("user_id", "transaction_type")
        .agg(F.sum("percentage").alias("pct"), F.sum("total_amount").alias("amount"))
    )
    assert sums.where("amount > 0 AND abs(pct - 100) > 0.05").count() == 0
    assert sums.where("amount = 0 AND pct <> 0").count() == 0


def test_top_and_others_make_a_whole(book):
    sums = reports.top_categories_all_time(book).groupBy("user_id").agg(F.sum("percentage").alias("p"))
    assert sums.where("p <> 100").count() == 0


def test_last_balance(book):
    latest = reports.all_time_balance(book).groupBy("user_id").agg(
        F.max_by("cumulative_balance", F.struct("year", "month")).alias("balance"),
        F.sum("net_amount").alias("net"),
        F.first("initial_balance").alias("opening"),
    )
    assert latest.where("balance <> opening + net").count() == 0
    assert latest.count() == book.transactions.select("user_id").distinct().count()


def test_anchored_run_twice_adds_nothing(book):
    texts = book.transactions.withColumn("id", F.col("id").cast("string"))
    book = book.with_tables(transactions=texts)
    once = recurring.advance_schedules(book, AS_OF)
    assert recurring.expand_all_schedules(once, AS_OF, "anchored").count() == 0
