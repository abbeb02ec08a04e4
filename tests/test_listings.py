from datetime import date, datetime

import pytest

from ledgerloom.operators import listings
from small import category, ledger, profile, rows, schedule, transaction


def book(spark):
    return ledger(
        spark,
        profiles=[profile("u"), profile("v")],
        categories=[category("c", "u", "expense", "Fun"), category("s", "u", "income", "Pay")],
        transactions=[
            transaction(1, "u", "expense", 1, "2024-01-01", "c", created_at=datetime(2024, 1, 1, 9)),
            transaction(2, "u", "expense", 2, "2024-01-01", None, created_at=datetime(2024, 1, 1, 8)),
            transaction(3, "u", "expense", 3, "2024-02-01", "missing"),
            transaction(4, "v", "expense", 4, "2024-01-01", "c"),
        ],
        financial_goals=[
            {"id": i, "user_id": "u", "name": i, "deadline": d}
            for i, d in (("a", date(2024, 2, 2)), ("b", None), ("c", date(2024, 1, 1)))
        ],
        fixed_costs=[
            schedule("low", "u", 1, "daily", "2024-01-01", category_id="c"),
            schedule("high", "u", 2, "daily", "2024-01-01"),
        ],
    )


def test_transactions_with_category(spark):
    found = listings.list_transactions(book(spark), "u").collect()
    assert [(r.id, r.categories and r.categories.name) for r in found] == [
        ("3", None),
        ("2", None),
        ("1", "Fun"),
    ]
    assert found[2].categories.user_id == "u"
    assert listings.list_transactions(book(spark)).count() == 4


def test_by_date(spark):
    found = listings.list_transactions_by_date(book(spark), date(2024, 1, 1), "u")
    assert rows(found, "id") == [("1",), ("2",)]


def test_lookup_needs_the_owner(spark):
    keys = spark.createDataFrame([("1", "u"), ("4", "u"), ("1", "u")], "id string, user_id string")
    found = listings.lookup_by_key(book(spark).transactions, keys)
    assert rows(found, "id") == [("1",)]


def test_goals_without_deadline_last(spark):
    assert rows(listings.list_goals(book(spark), "u"), "id") == [("c",), ("a",), ("b",)]


def test_categories_by_type(spark):
    assert rows(listings.list_categories(book(spark), "income"), "id") == [("s",)]
    assert listings.list_categories(book(spark), user_id="v").count() == 0
    with pytest.raises(ValueError):
        listings.list_categories(book(spark), "gift")


def test_schedules_by_amount(spark):
    found = listings.list_schedules(book(spark), "fixed_costs", "u")
    assert rows(found, "id", "categories.name") == [("high", None), ("low", "Fun")]


def test_scoping(spark):
    users = spark.createDataFrame([("v",), ("v",)], "user_id string")
    scoped = listings.scope_ledger(book(spark), users)
    assert {n: t.count() for n, t in scoped.tables().items() if t.count()} == {
        "profiles": 1,
        "transactions": 1,
    }
    assert rows(listings.get_profiles(book(spark), "u"), "id") == [("u",)]


def test_few_keys_read_few_row_groups(spark, tmp_path):
    """100 keys of a ledger of 64 files: most files are excluded by their filters."""
    from pyspark.sql import functions as F

    from ledgerloom.sources.parquet import read_ledger, write_ledger

    rows_ = spark.range(64_000).select(
        F.md5(F.col("id").cast("string")).alias("id"), (F.col("id") % 50).cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("category_id"), F.lit(1).cast("decimal(12,2)").alias("amount"), F.lit(None).cast("string").alias("note"),
        F.make_date(F.lit(1960) + (F.col("id") % 64).cast("int"), F.lit(1), F.lit(1)).alias("date"), F.lit("income").alias("type"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )
    book = ledger(spark).with_tables(transactions=rows_)
    write_ledger(book, str(tmp_path / "l"))
    table = read_ledger(spark, str(tmp_path / "l")).transactions
    some = [(r.id, r.user_id) for r in rows_.where("date_format(date, 'yyyy') IN ('1960', '1999') AND user_id < '2'").limit(100).collect()]
    keys = [*some, ("none", "1"), (some[0][0], "49"), (None, "1"), some[1]]
    found = listings.lookup_few(table, keys)
    assert {(r.id, r.user_id) for r in found.collect()} == set(some) and found.count() == len(some)
    by_join = listings.lookup_by_key(table, spark.createDataFrame(keys, "id string, user_id string"))
    assert {r.id for r in by_join.collect()} == {i for i, _ in some}
    plan = found._jdf.queryExecution().executedPlan()
    found.collect()
    (scan,) = [p for p in (plan.collectLeaves().apply(i) for i in range(plan.collectLeaves().size()))]
    plan.execute().count()
    assert scan.metrics().apply("numOutputRows").value() < 64_000 / 8
    assert listings.lookup_few(table, []).count() == 0
    with pytest.raises(ValueError, match="lookup_by_key"):
        listings.lookup_few(table, keys, most=5)
