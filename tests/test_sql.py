"""Reports as table functions."""

import re
from collections import Counter
from datetime import date

import pytest

from ledgerloom.operators import reports
from ledgerloom.sources.parquet import read_ledger, write_ledger
from ledgerloom.sql import FUNCTIONS, register_reports
from small import category, ledger, profile, transaction

AS_OF = date(2024, 3, 31)
DAY = f"DATE'{AS_OF}'"
CALLS = {
    "monthly_calendar": ("2024, 3", lambda b, u: reports.monthly_calendar(b, 2024, 3, u)),
    "monthly_report": ("2024, 3", lambda b, u: reports.monthly_report(b, 2024, 3, u)),
    "annual_report": (f"2024, {DAY}", lambda b, u: reports.annual_report(b, 2024, AS_OF, u)),
    "annual_trend": ("2024", lambda b, u: reports.annual_trend(b, 2024, u)),
    "annual_categories": ("2024", lambda b, u: reports.annual_categories(b, 2024, u)),
    "all_time_balance": ("", lambda b, u: reports.all_time_balance(b, u)),
    "all_time_categories": ("", lambda b, u: reports.all_time_categories(b, u)),
    "top_categories_all_time": ("", lambda b, u: reports.top_categories_all_time(b, u)),
    "recent_years_summary": ("", lambda b, u: reports.recent_years_summary(b, u)),
    "top_categories_recent_years": ("", lambda b, u: reports.top_categories_recent_years(b, u)),
}


def book(spark):
    """Negative sums, a zero grand total, foreign and missing categories, empty users."""
    return ledger(
        spark,
        profiles=[profile("u", 3), profile("v", None), profile("empty"), profile("zero")],
        categories=[
            category("c", "u", "expense", "Food"), category("d", "u", "income", "Pay"), category("e", "v", "expense", "Food"),
            category("f", "u", "expense", "Food"), category("z", "zero", "income"),
            *[category(f"k{i}", "u", "investment") for i in range(7)],
        ],
        transactions=[
            transaction(1, "u", "expense", 10, "2024-03-01", "c"), transaction(2, "u", "income", 7.5, "2024-03-31", "d"),
            transaction(3, "u", "expense", 3, "2024-03-15", "e"), transaction(4, "u", "expense", -4, "2024-03-15", "f"),
            transaction(5, "u", "investment", 2, "2024-02-29"), transaction(6, "v", "income", 1, "2024-04-01", "gone"),
            transaction(7, "ghost", "income", 5, "2020-01-01", "c"), transaction(8, "zero", "income", 5, "2023-01-01", "z"),
            transaction(9, "zero", "expense", -5, "2023-01-01", "z"),
            *[transaction(20 + i, "u", "investment", i + 1, f"{2015 + i}-06-01", f"k{i}") for i in range(7)],
        ],
    )


def same(a, b):
    return a.columns == b.columns and Counter(map(str, a.collect())) == Counter(map(str, b.collect()))


def test_every_report_is_a_function():
    assert set(FUNCTIONS) == {*CALLS, "category_trend"}


@pytest.fixture(scope="module")
def opened(spark):
    b = book(spark)
    register_reports(b, "t_")
    return b


@pytest.mark.parametrize("name", sorted(CALLS))
def test_for_one_user_and_for_all(spark, opened, name):
    arguments, report = CALLS[name]
    more = f", {arguments}" if arguments else ""
    for user in ("u", "zero", "ghost"):
        got = spark.sql(f"SELECT '{user}' AS user_id, * FROM t_{name}('{user}'{more})")
        if (name, user) != ("top_categories_all_time", "ghost"):
            assert same(got, report(opened, user)), user
    users = "(SELECT id FROM t_profiles UNION SELECT user_id FROM t_transactions)"
    got = spark.sql(f"SELECT p.id AS user_id, r.* FROM {users} p, LATERAL t_{name}(p.id{more}) r")
    assert same(got, report(opened, None))


def test_category_trend(spark, opened):
    got = spark.sql(
        f"SELECT c.user_id, c.id AS category_id, r.* FROM t_categories c, LATERAL t_category_trend(c.user_id, 2024, {DAY}, c.id) r"
    )
    assert same(got, reports.category_trend(opened, 2024, AS_OF))
    assert spark.sql(f"SELECT * FROM t_category_trend('u', 2024, {DAY}, 'e')").count() == 0  # another user's


def test_user_and_period_reach_the_scan(spark, tmp_path):
    write_ledger(book(spark), str(tmp_path / "l"))
    register_reports(read_ledger(spark, str(tmp_path / "l")), "stored_")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    for call in ("monthly_report('u', 2024, 3)", f"annual_report('u', 2024, {DAY})", "annual_categories('u', 2024)"):
        text = spark.sql(f"SELECT * FROM stored_{call}")._jdf.queryExecution().executedPlan().toString()
        pushed = [p for p in re.findall(r"PushedFilters: \[([^]]*)\]", text) if "(date," in p]
        assert pushed and all("EqualTo(user_id,u)" in p and "GreaterThanOrEqual(date" in p for p in pushed), call
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_functions_follow_their_ledger(spark):
    b = book(spark)
    register_reports(b.with_tables(transactions=b.transactions.where("id = '2'")), "again_")
    assert spark.sql("SELECT * FROM again_all_time_balance('u')").count() == 1
    register_reports(b, "again_")
    assert spark.sql("SELECT * FROM again_all_time_balance('u')").count() == 9
