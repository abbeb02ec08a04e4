"""Constraints on new rows: what is refused, and that stored tables stay where they are."""

import re
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import gate
from ledgerloom.sources.parquet import read_ledger, write_ledger
from small import category, ledger, profile, rows, schedule, table, transaction


def book(spark):
    return ledger(
        spark,
        profiles=[profile("u"), profile("v")],
        categories=[category("c", "u", "expense"), category("d", "v", "income")],
        transactions=[transaction(1, "u", "expense", 1, "2024-01-01", "c")],
        fixed_costs=[schedule("s", "u", 1, "monthly", "2024-01-01")],
    )


def broken(checked):
    return {r["id"]: sorted(r["broken_rules"]) for r in checked.collect()}


def loose(spark, data):
    schema = "id string, user_id string, category_id string, amount decimal(20,2), note string, date date, type string"
    typed = [tuple(None if v is None else Decimal(v) if i == 3 else v for i, v in enumerate(r)) for r in data]
    return spark.createDataFrame(typed, schema)


def test_each_rule(spark):
    day = date(2024, 1, 1)
    new = loose(spark, [
        ("2", "u", "c", 1, None, day, "expense"), ("3", "v", None, 2, "x", day, "income"),
        ("4", "u", "d", 3, None, day, "gift"), ("5", "w", "e", None, None, None, "expense"),
        ("1", "u", "c", 10**11, None, day, "expense"), (None, None, "c", 1, None, day, None),
        ("6", "u", "", -5, None, day, "expense"),
    ])
    accepted, refused = gate.gate(book(spark), "transactions", new)
    assert sorted(r["id"] for r in accepted.collect()) == ["2", "3"] and accepted.columns == new.columns
    assert broken(refused) == {
        "4": ["type domain"],
        "5": ["amount not null", "category_id reference", "date not null", "user_id reference"],
        "1": ["amount range", "id unique"],
        None: ["id not null", "type not null", "user_id not null"],
        "6": ["category_id reference"],
    }


def test_repeated_ids(spark):
    day = date(2024, 1, 1)
    new = loose(spark, [("7", "u", None, n, None, day, "income") for n in (3, 1, 2)] + [("8", "u", None, 1, None, day, "income")])
    accepted, refused = gate.gate(book(spark), "transactions", new)
    assert rows(accepted, "id") == [("8",)] and refused.count() == 3
    accepted, refused = gate.gate(book(spark), "transactions", new, order_by="amount")
    assert sorted(rows(accepted, "id", "amount")) == [("7", "1.00"), ("8", "1.00")] and refused.count() == 2


def test_every_table_has_a_gate(spark):
    b = book(spark)
    for name, stored in b.tables().items():
        checked = gate.check_new_rows(b, name, stored)
        assert checked.count() == stored.count()
        assert all(r == ["id unique"] for r in broken(checked).values()), name
        assert gate.check_new_rows(b, name, stored.limit(0)).count() == 0
    fresh = table(spark, "fixed_costs", [{**schedule("t", "u", 1, "hourly", "2024-01-01"), "category_id": "x"}])
    assert broken(gate.check_new_rows(b, "fixed_costs", fresh)) == {"t": ["category_id reference", "frequency domain"]}


@pytest.mark.parametrize("words", [1, 64, 1 << 12])
def test_a_filter_too_full_changes_no_answer(spark, words):
    stored = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("id"))
    keys = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    expected = {str(i) for i in range(0, 1000, 3)}
    passed = [r["id"] for r in gate.passing(stored, keys, words).collect()]
    assert expected <= set(passed) and len(passed) == len(set(passed))
    if words == 1 << 12:
        assert len(passed) < len(expected) + 60


def test_stored_tables_are_not_shuffled(spark, tmp_path):
    root = str(tmp_path / "ledger")
    write_ledger(book(spark), root)
    stored = read_ledger(spark, root)
    new = loose(spark, [("2", "u", "c", 1, None, date(2024, 1, 1), "expense")])
    text = gate.check_new_rows(stored, "transactions", new)._jdf.queryExecution().executedPlan().toString()
    scans = [i for i, line in enumerate(text.splitlines()) if "FileScan parquet" in line]
    assert len(scans) == 3
    for i in scans:  # upwards from each scan the filter comes before any exchange
        above = text.splitlines()[:i]
        nearest = next(line for line in reversed(above) if re.search(r"BroadcastHashJoin|Exchange hash", line))
        assert "BroadcastHashJoin [__word" in nearest
    assert all("ReadSchema: struct<id:string>" in line for line in text.splitlines() if "FileScan parquet" in line)
