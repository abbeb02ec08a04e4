import json
from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog import QUERIES
from ledgerloom.operators import changes, recurring, reports
from ledgerloom.session import shared_dir
from ledgerloom.sources import testbed
from ledgerloom.sources.parquet import read_ledger, to_json_rows, write_ledger, write_report, write_rollup
from small import category, ledger, profile, rows, schedule, transaction


def stored(spark, tmp_path, ledger_):
    root = str(tmp_path / "stored")
    write_ledger(ledger_, root)
    return root, read_ledger(spark, root)


def test_changed_rows_of_a_stored_ledger_are_in_its_periods(spark, tmp_path):
    _, opened = stored(spark, tmp_path, book(spark))
    new = spark.createDataFrame([("9", "u", "expense", 8, date(2024, 5, 5))], "id string, user_id string, type string, amount int, date date")
    appended = changes.append_transactions(opened.transactions, new, date(2024, 1, 1))
    expense = lambda table, year: rows(
        reports.annual_report(opened.with_tables(transactions=table), year, date(2025, 1, 1)).where("month_number = 12"),
        "year_to_date_expense_total",
    )
    assert expense(opened.transactions, 2024) == [("6.00",)]
    assert expense(appended, 2024) == [("14.00",)]
    moved = spark.createDataFrame([("1", "u", date(2024, 2, 2))], "id string, user_id string, date date")
    updated = changes.apply_updates(opened.transactions, moved)
    assert expense(updated, 2024) == [("7.00",)] and expense(updated, 2023) == [("0.00",)]
    due = [schedule("s", "u", 100, "monthly", "2024-11-15")]
    with_due = opened.with_tables(fixed_costs=ledger(spark, fixed_costs=due).fixed_costs)
    ran = recurring.run_schedules(with_due, date(2024, 12, 31))
    assert expense(ran.transactions, 2024) == [("206.00",)]


def test_a_rollup_of_older_tables_is_refused(spark, tmp_path):
    root, opened = stored(spark, tmp_path, book(spark))
    write_rollup(opened, root)
    assert read_ledger(spark, root, rollup=True).monthly_activity.count() == 3
    write_ledger(book(spark), root)
    with pytest.raises(ValueError, match="older tables"):
        read_ledger(spark, root, rollup=True)


def test_shuffles_start_from_many_partitions(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(key, "300")
    try:
        totals = spark.range(1000).groupBy(F.col("id") % 7).count()
        assert totals.rdd.getNumPartitions() < 10  # merged down at run time
    finally:
        spark.conf.unset(key)


def book(spark):
    return ledger(
        spark,
        profiles=[profile("u", 3)],
        categories=[category("c", "u", "expense")],
        transactions=[
            transaction(1, "u", "expense", 1, "2023-12-31", "c"),
            transaction(2, "u", "expense", 2, "2024-01-01", "c"),
            transaction(3, "u", "expense", 4, "2024-12-31"),
        ],
    )


def test_round_trip_and_year_directories(spark, tmp_path):
    root = str(tmp_path / "ledger")
    write_ledger(book(spark), root)
    again = read_ledger(spark, root)
    expected = sorted(rows(book(spark).transactions), key=str)
    assert sorted(rows(again.transactions.drop("date_year")), key=str) == expected
    assert sorted(p.name for p in (tmp_path / "ledger" / "transactions").glob("date_year=*")) == [
        "date_year=2023",
        "date_year=2024",
    ]
    found = rows(reports.annual_trend(again, 2024, "u"), "month_number", "expense_running_total")
    assert (found[0], found[-1]) == ((1, "2.00"), (12, "6.00"))
    # Written again elsewhere, from a ledger that has the partition column.
    write_ledger(again, str(tmp_path / "copy"))
    assert read_ledger(spark, str(tmp_path / "copy")).transactions.count() == 3


def test_json_rows_keep_nulls(spark):
    (line,) = to_json_rows(reports.top_categories_all_time(ledger(spark, profiles=[profile("x")]))).collect()
    assert json.loads(line.value) == {
        "user_id": "x",
        "category": "Others",
        "percentage": None,
        "icon": "more-horiz",
        "color": "#808080",
        "is_others": 1,
    }


def test_report_replaces_only_its_years(spark, tmp_path):
    path = str(tmp_path / "report")
    report = reports.all_time_balance(book(spark))
    write_report(report, path, ["year"])
    write_report(report.where("year = 2024 AND month = 1"), path, ["year"])
    stored = spark.read.parquet(path)
    assert sorted(rows(stored, "year", "month")) == [(2023, 12), (2024, 1)]


def test_views(spark):
    book(spark).create_views("my_")
    query = "SELECT sum(amount) FROM my_transactions WHERE date >= DATE '2024-01-01'"
    assert str(spark.sql(query).first()[0]) == "6.00"


def test_shared_folder_comes_from_the_session():
    session = SimpleNamespace(conf={"spark.checkpoint.dir": "/shared"})
    assert shared_dir(session) == "/shared"


def test_future_year_is_cut_at_the_current_month(spark):
    assert reports.annual_report(book(spark), 2025, date(2024, 2, 1), "u").count() == 2


def _estimate(df) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_size_estimates_count_all_categories(spark):
    """Fifteen rows a customer: a table taken for as small as its keys would be broadcast."""
    customer = testbed.read_table(spark, "/root/testdata/sf0.001", "customer")
    keys, categories = customer.select("c_custkey"), testbed.categories(customer)
    assert categories.count() == 15 * keys.count()
    assert _estimate(categories.select("id")) > 14 * _estimate(keys)


def test_users_of_sql_reports_are_not_broadcast_by_a_share_of_their_file(spark, tmp_path):
    """As one of five declared columns, keys of millions of customers passed for a few megabytes."""
    customer = "id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "CAST(1 AS DOUBLE) AS c_acctbal", "'s' AS c_mktsegment"
    orders = (
        "id AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
        "TIMESTAMP_NTZ'1998-03-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    part = (
        "id AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size",
        "CAST(1 AS DOUBLE) AS p_retailprice",
    )
    for name, columns in {"customer": customer, "orders": orders, "part": part}.items():
        spark.range(20_000).selectExpr(*columns).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    size = sum(p.stat().st_size for p in (tmp_path / "customer.parquet").glob("*.parquet"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, str(size // 2))
    try:
        for name in ("sql_all_time_categories", "sql_annual_categories"):
            report = QUERIES[name](spark, str(tmp_path))
            plan = report._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name
        assert report.count() == 15 * 20_000
    finally:
        spark.conf.unset(key)


def test_categories_are_made_by_many_tasks(spark):
    """One small file of keys is one task's; what is made of it is not."""
    customer = testbed.read_table(spark, "/root/testdata/sf0.001", "customer")
    made_by = testbed.categories(customer).select("id", F.spark_partition_id().alias("task"))
    rows = [r["count"] for r in made_by.groupBy("task").count().collect()]
    assert len(rows) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(rows) < sum(rows) / 2


def test_categories_of_odd_customers(spark):
    rows = spark.createDataFrame([(7,), (7,), (None,)], "c_custkey long")
    found = testbed.categories(rows).orderBy(F.desc_nulls_last("id")).collect()
    assert len(found) == 45 and [r["id"] for r in found[:4]] == [735, 735, 734, 734]
    assert all(r["id"] is None and r["user_id"] is None and r["name"] for r in found[30:])
    assert tuple(found[0]) == (735, 7, "Misc", "investment", "more", "#808080", False)
    assert tuple(found[28]) == (711, 7, "income 1", "income", "icon-11", "#110000", True)
