from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reports
from small import category, ledger, profile, rows, transaction

AS_OF = date(2024, 12, 15)
KINDS = ("income", "expense", "investment")


def test_calendar_totals_cover_uncategorised_rows(spark):
    book = ledger(
        spark,
        categories=[category("s", "u", "income"), category("f", "u", "expense")],
        transactions=[
            transaction(1, "u", "income", 5000, "2024-03-01", "s"),
            transaction(2, "u", "expense", 1500, "2024-03-31", "f"),
            transaction(3, "u", "expense", 500, "2024-03-10"),
            transaction(4, "u", "investment", 1000, "2024-03-11"),
            transaction(5, "u", "income", 7, "2024-04-01", "s"),
            transaction(6, "v", "income", 9, "2024-03-05"),
        ],
    )
    found = rows(
        reports.monthly_calendar(book, 2024, 3, ordered=True),
        "transaction_id",
        "month_total_income",
        "month_total_expense",
        "month_total_investment",
        "month_net_balance",
    )
    totals = ("5000.00", "2000.00", "1000.00", "2000.00")
    assert found == [("2", *totals), ("1", *totals)]


def test_monthly_report(spark):
    book = ledger(
        spark,
        categories=[category("s", "u", "income", "Salary"), category("f", "u", "expense", "Food")],
        transactions=[
            transaction(1, "u", "income", 5000, "2024-03-01", "s"),
            transaction(2, "u", "expense", 23535, "2024-03-02", "f"),
        ],
    )
    assert rows(
        reports.monthly_report(book, 2024, 3, "u"),
        "category_name",
        "net_balance",
        "category_percentage",
    ) == [("Food", "-18535.00", "100.00"), ("Salary", "-18535.00", "100.00")]


def test_shares_of_own_categories_only(spark):
    """A row in someone else's category counts for its user's rankings only."""
    book = ledger(
        spark,
        profiles=[profile("u"), profile("v")],
        categories=[category("mine", "u", "expense"), category("theirs", "v", "expense")],
        transactions=[
            transaction(1, "u", "expense", 30, "2024-03-01", "mine"),
            transaction(2, "u", "expense", 10, "2024-03-02", "theirs"),
        ],
    )
    assert rows(reports.monthly_calendar(book, 2024, 3, "u"), "category_name") == [
        ("theirs",),
        ("mine",),
    ]
    report = rows(
        reports.monthly_report(book, 2024, 3), "user_id", "total_expense", "category_amount"
    )
    assert report == [("u", "40.00", "30.00")]
    assert rows(reports.annual_categories(book, 2024, "v"), "total_amount") == [("0.00",)]
    top = rows(reports.top_categories_all_time(book, "u"), "category", "percentage")
    assert top == [("mine", "75.00"), ("theirs", "25.00"), ("Others", "0.00")]


def test_type_shares_and_zero_types(spark):
    amounts = {"a": 24000, "b": 18000, "c": 12000, "d": 6000}
    book = ledger(
        spark,
        categories=[category(c, "u", "expense") for c in amounts] + [category("z", "u", "income")],
        transactions=[
            transaction(i, "u", "expense", a, "2024-01-05", c)
            for i, (c, a) in enumerate(amounts.items())
        ],
    )
    expected = [
        ("a", "24000.00", "40.00"),
        ("b", "18000.00", "30.00"),
        ("c", "12000.00", "20.00"),
        ("d", "6000.00", "10.00"),
        ("z", "0.00", "0.00"),
    ]
    columns = ("category_name", "total_amount", "percentage")
    assert rows(reports.annual_categories(book, 2024, "u"), *columns) == expected
    assert rows(reports.all_time_categories(book, "u"), *columns) == expected
    shown = rows(reports.monthly_report(book, 2024, 1, "u"), "category_name")
    assert [name for (name,) in shown] == ["a", "b", "c", "d"]


def test_negative_type_total(spark):
    book = ledger(
        spark,
        categories=[category("a", "u", "expense"), category("b", "u", "expense")],
        transactions=[
            transaction(1, "u", "expense", -30, "2024-01-05", "a"),
            transaction(2, "u", "expense", 10, "2024-01-05", "b"),
        ],
    )
    year = rows(reports.annual_categories(book, 2024, "u"), "category_name", "percentage")
    assert year == [("b", "-50.00"), ("a", "150.00")]
    month = rows(reports.monthly_report(book, 2024, 1, "u"), "category_name", "category_percentage")
    assert month == [("b", "0.00")]


def test_annual_running_totals(spark):
    book = ledger(
        spark,
        profiles=[profile("u"), profile("idle")],
        transactions=[
            transaction(f"{kind}{m}", "u", kind, amount, f"2024-{m:02}-05")
            for m in range(1, 13)
            for kind, amount in (("income", 5000), ("expense", 2000), ("investment", 1000))
        ],
    )
    as_of = date(2024, 4, 1)
    found = rows(
        reports.annual_report(book, 2024, as_of, ordered=True),
        "user_id",
        "month_number",
        *[f"running_{k}_total" for k in KINDS],
        *[f"year_to_date_{k}_total" for k in KINDS],
    )
    assert found == [("idle", m, *["0.00"] * 6) for m in range(1, 5)] + [
        ("u", m, f"{5000 * m}.00", f"{2000 * m}.00", f"{1000 * m}.00", "60000.00", "24000.00", "12000.00")
        for m in range(1, 5)
    ]
    trend = rows(
        reports.annual_trend(book, 2024, ordered=True),
        "user_id",
        "month_number",
        "income_running_total",
        "investment_year_total",
    )
    assert trend == [("u", m, f"{5000 * m}.00", "12000.00") for m in range(1, 13)]
    # A past year shows all months, a future one those up to the current month.
    assert reports.annual_report(book, 2023, as_of, "u").count() == 12
    assert reports.annual_report(book, 2025, as_of, "u").count() == 4


def test_category_trend_labels(spark):
    book = ledger(
        spark,
        categories=[category("f", "u", "expense"), category("quiet", "u", "income")],
        transactions=[
            transaction(1, "u", "expense", 10, "2024-12-01", "f"),
            transaction(2, "u", "expense", 20, "2024-12-07", "f"),
            transaction(3, "u", "expense", 5, "2024-02-29", "f"),
        ],
    )
    found = rows(
        reports.category_trend(book, 2024, AS_OF, "f", "u"),
        "month",
        "month_name",
        "amount",
        "date_label",
        "latest_transaction_date",
    )
    assert len(found) == 12
    assert found[1] == (2, "February", "5.00", "", date(2024, 12, 7))
    assert found[11] == (12, "December", "30.00", "07.12 2024 (Sat)", date(2024, 12, 7))
    assert reports.category_trend(book, 2024, AS_OF, "f", "someone").count() == 0
    quiet = rows(
        reports.category_trend(book, 2024, AS_OF, "quiet"), "date_label", "latest_transaction_date"
    )
    assert quiet == [("", None)] * 12


def test_cumulative_balance(spark):
    book = ledger(
        spark,
        profiles=[profile("u", 1000), profile("blank", None)],
        transactions=[
            transaction(1, "u", "income", 900, "2023-11-05"),
            transaction(2, "u", "expense", 400, "2023-11-06"),
            transaction(3, "u", "investment", 100, "2023-11-07"),
            transaction(4, "u", "income", 400, "2023-12-05"),
            transaction(5, "u", "income", 300, "2024-02-05"),
            transaction(6, "blank", "income", 1, "2024-02-05"),
            transaction(7, "stranger", "income", 1, "2024-02-05"),
        ],
    )
    found = rows(
        reports.all_time_balance(book, ordered=True),
        "user_id",
        "year",
        "month",
        "net_amount",
        "cumulative_balance",
    )
    assert found == [
        ("blank", 2024, 2, "1.00", "1.00"),
        ("stranger", 2024, 2, "1.00", None),
        ("u", 2023, 11, "400.00", "1400.00"),
        ("u", 2023, 12, "400.00", "1800.00"),
        ("u", 2024, 2, "300.00", "2100.00"),
    ]


def test_others_of_equal_groups_and_of_nothing(spark):
    book = ledger(
        spark,
        profiles=[profile("u"), profile("empty"), profile("zero")],
        categories=[category(c, "u", "expense") for c in "abc"],
        transactions=[transaction(c, "u", "expense", 1, "2024-01-05", c) for c in "abc"]
        + [
            transaction("p", "zero", "income", 5, "2024-01-05", "a"),
            transaction("n", "zero", "income", -5, "2024-01-06", "a"),
        ],
    )
    found = rows(
        reports.top_categories_all_time(book, ordered=True), "user_id", "category", "percentage", "is_others"
    )
    assert found == [
        ("empty", "Others", None, 1),
        ("u", "a", "33.33", 0),
        ("u", "b", "33.33", 0),
        ("u", "c", "33.33", 0),
        ("u", "Others", "0.01", 1),
        ("zero", "a", None, 0),
        ("zero", "Others", None, 1),
    ]


def test_top_five_merges_equal_looks(spark):
    names = ["a", "b", "c", "d", "e", "f"]
    book = ledger(
        spark,
        profiles=[profile("u")],
        categories=[category(n, "u", "expense") for n in names]
        + [category("a2", "u", "income", "a")],
        transactions=[
            transaction(i, "u", "expense", 10, "2024-01-05", n) for i, n in enumerate(names)
        ]
        + [transaction("x", "u", "income", 40, "2024-01-05", "a2")],
    )
    found = rows(reports.top_categories_all_time(book, "u"), "category", "percentage")
    assert found == [
        ("a", "50.00"),
        ("b", "10.00"),
        ("c", "10.00"),
        ("d", "10.00"),
        ("e", "10.00"),
        ("Others", "10.00"),
    ]


def test_recent_years(spark):
    book = ledger(
        spark,
        profiles=[profile("u")],
        categories=[category("f", "u", "expense")],
        transactions=[
            transaction(y, "u", "income", y, f"{y}-06-01", "f") for y in range(2016, 2022)
        ]
        + [
            transaction("i", "u", "investment", 5, "2023-06-01"),
            transaction("n", "nobody", "income", 5, "2023-06-01"),
        ],
    )
    summary = rows(reports.recent_years_summary(book, ordered=True))
    assert summary[0] == ("u", 2023, "0.00", "0.00", "0.00")
    assert [year for _, year, *_ in summary] == [2023, 2021, 2020, 2019, 2018]
    nested = reports.top_categories_recent_years(book, "u").collect()
    assert [row.year for row in nested] == [2023, 2021, 2020, 2019, 2018]
    assert nested[0].categories == []
    assert [(c.category, str(c.percentage), c.icon) for c in nested[1].categories] == [
        ("f", "100.00", "i"),
        ("Others", "0.00", "ellipsis-h"),
    ]


def test_documented_reports(spark):
    book = ledger(
        spark,
        profiles=[profile("u", 100), profile("idle", 7)],
        categories=[category("f", "u", "expense", "Food"), category("g", "u", "expense", "Gas")],
        transactions=[
            transaction(1, "u", "income", 200, "2024-03-01"),
            transaction(2, "u", "expense", 10, "2024-03-02", "f"),
            transaction(3, "u", "expense", 20, "2024-03-03", "g"),
            transaction(4, "u", "expense", 20.01, "2024-03-04", "g"),
        ],
    )
    trends = rows(reports.yearly_trends(book, "expense", "u"))
    assert trends == [("u", 2024, 3, "50.01", 3, "16.67")]
    totals = rows(reports.all_time_totals(book, ordered=True))
    assert totals == [
        ("idle", "0.00", "0.00", "0.00", "7.00", None),
        ("u", "200.00", "50.01", "0.00", "249.99", "75.00"),
    ]
    breakdown = rows(reports.category_breakdown(book, 2024, 3, "u"), "category_name", "percentage")
    assert breakdown == [("Gas", "80.00"), ("Food", "20.00")]
    (summary,) = reports.monthly_summary_of_user(book, 2024, 3, "u").collect()
    assert str(summary.net_savings) == "149.99"
    assert [c.category_name for c in summary.categories] == ["Gas", "Food"]


def test_summary_has_a_row_per_category(spark):
    """One shape at every size: a row per category, 2 or 2,000 of them."""
    for n in (2, 2000):
        names = [f"c{i:04}" for i in range(n)]
        book = ledger(
            spark,
            categories=[category(c, "u", "expense") for c in names],
            transactions=[transaction(c, "u", "expense", 1, "2024-03-02", c) for c in names],
        )
        summary = reports.monthly_summary_nested(book, 2024, 3)
        assert sorted(r[0] for r in summary.select("category_id").collect()) == names
        assert summary.where(f"total_expense = {n}").count() == n
        (nested,) = reports.monthly_summary_of_user(book, 2024, 3, "u").collect()
        assert [c.category_id for c in nested.categories] == names


def test_summary_of_a_user_without_categories(spark):
    book = ledger(spark, transactions=[transaction(1, "u", "income", 5, "2024-03-02")])
    assert rows(reports.monthly_summary_nested(book, 2024, 3)) == [("u", "5.00", "0.00", "5.00", None, None, None)]
    (nested,) = reports.monthly_summary_of_user(book, 2024, 3, "u").collect()
    assert nested.categories == []


@pytest.mark.parametrize("part,whole", [
    ("10000000000000.05", "20000000000000.00"), ("3333333333333.33", "9999999999999999.99"),
    ("1.00", "20000.00"), ("-1.00", "20000.00"), ("0.01", "0.00"), ("1234567890123.45", "-1234567890123456.78"),
])
def test_percents_are_exact(spark, part, whole):
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    from ledgerloom.functions.money import percent

    got = spark.range(1).select(percent(F.lit(Decimal(part)), F.lit(Decimal(whole)))).first()[0]
    with localcontext() as context:
        context.prec = 60
        expected = (Decimal(part) * 100 / Decimal(whole)).quantize(Decimal("0.01"), ROUND_HALF_UP) if Decimal(whole) else None
    assert got == expected


def test_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        reports.monthly_report(ledger(spark), 2024, 13)
