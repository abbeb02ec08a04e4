from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import changes, quality
from small import category, ledger, profile, rows, schedule, table, transaction

AS_OF = date(2024, 6, 30)


def book(spark):
    return ledger(
        spark,
        profiles=[profile("u", 5, name="Una", email="u@x"), profile("v", 6)],
        categories=[
            category("d", "u", "expense", "Food", is_default=True),
            category("c", "u", "expense", "Fun"),
            category("n", "u", "expense", "Odd", is_default=None),
            category("w", "v", "expense", "Fun"),
        ],
        transactions=[
            transaction(1, "u", "expense", 1, "2024-01-01", "c", note="old"),
            transaction(2, "u", "expense", 2, "2024-01-02", "d", note="old"),
            transaction(3, "v", "expense", 3, "2024-01-03", "w"),
        ],
        financial_goals=[
            {"id": "g", "user_id": "v", "name": "Car", "current_amount": Decimal(1)}
        ],
        fixed_costs=[schedule("f", "u", 1, "daily", "2024-01-01", category_id="c")],
    )


def test_append_defaults(spark):
    new = spark.createDataFrame(
        [("u", "income", Decimal("5.00"), None), ("u", "income", Decimal("6.00"), date(2024, 1, 9))],
        "user_id string, type string, amount decimal(12,2), date date",
    )
    found = changes.append_transactions(book(spark).transactions, new, AS_OF)
    added = rows(found.where("type = 'income'").orderBy("amount"), "amount", "date")
    assert added == [("5.00", AS_OF), ("6.00", date(2024, 1, 9))]
    assert found.where("id is null").count() == 0


def test_sparse_updates(spark):
    patch = spark.createDataFrame(
        [
            ("1", "u", None, Decimal("9.00"), ["note"]),
            ("2", "u", None, Decimal("9.00"), ["amount"]),
            ("3", "u", "hacked", Decimal("9.00"), ["amount", "note"]),
        ],
        "id string, user_id string, note string, amount decimal(12,2), set_fields array<string>",
    )
    found = changes.apply_updates(book(spark).transactions, patch).orderBy("id")
    assert rows(found, "id", "note", "amount") == [
        ("1", None, "1.00"),
        ("2", "old", "9.00"),
        ("3", None, "3.00"),
    ]


def test_several_changes_of_a_row(spark):
    patch = spark.createDataFrame(
        [
            ("1", "u", 1, "first", Decimal("7.00"), ["note", "amount"]),
            ("1", "u", 3, None, Decimal("8.00"), ["amount"]),
            ("1", "u", 2, "second", None, ["note"]),
        ],
        "id string, user_id string, seq int, note string, amount decimal(12,2),"
        " set_fields array<string>",
    )
    found = changes.apply_updates(book(spark).transactions, patch, order_by="seq")
    assert rows(found.where("id = '1'"), "note", "amount") == [("second", "8.00")]
    assert found.count() == 3
    assert changes.apply_updates(book(spark).transactions, patch).count() == 3


def test_blank_profile_fields_are_absent(spark):
    patch = spark.createDataFrame(
        [("u", "", None, Decimal("0.00"))],
        "id string, name string, email string, initial_balance decimal(12,2)",
    )
    found = changes.update_profiles(book(spark).profiles, patch)
    assert rows(found.where("id = 'u'"), "name", "email", "initial_balance") == [
        ("Una", "u@x", "0.00")
    ]


def test_deletes_are_scoped(spark):
    wanted = spark.createDataFrame([("1", "u"), ("3", "u")], "id string, user_id string")
    left = changes.apply_deletes(book(spark).transactions, wanted)
    assert sorted(rows(left, "id")) == [("2",), ("3",)]


def test_guarded_categories(spark):
    everything = book(spark).categories
    recolored = everything.select("id", "user_id", F.lit("red").alias("color"))
    updated = changes.update_categories(everything, recolored)
    assert sorted(rows(updated, "id", "color")) == [
        ("c", "red"),
        ("d", "c"),
        ("n", "c"),
        ("w", "red"),
    ]
    assert sorted(rows(changes.delete_categories(everything, everything), "id")) == [("d",), ("n",)]


def test_deleting_categories_detaches_rows(spark):
    before = book(spark)
    wanted = before.categories.where("id in ('c', 'd')")
    after = changes.delete_categories_set_null(before, wanted)
    assert sorted(rows(after.transactions, "id", "category_id")) == [
        ("1", None),
        ("2", "d"),
        ("3", "w"),
    ]
    assert rows(after.fixed_costs, "category_id") == [(None,)]
    assert sorted(rows(after.categories, "id")) == [("d",), ("n",), ("w",)]


def test_cascade(spark):
    gone = spark.createDataFrame([("u",)], "user_id string")
    after = changes.delete_profiles_cascade(book(spark), gone)
    assert {name: df.count() for name, df in after.tables().items()} == {
        "profiles": 1,
        "categories": 1,
        "transactions": 1,
        "financial_goals": 1,
        "fixed_costs": 0,
        "periodic_income": 0,
        "fixed_investments": 0,
    }


def test_seeds(spark):
    users = spark.createDataFrame([("x",), ("y",)], "user_id string")
    seeded = changes.seed_default_categories(users, book(spark).categories)
    counts = dict(rows(seeded.groupBy("type").count()))
    assert counts == {"expense": 10, "income": 6, "investment": 6}
    assert seeded.select("id").distinct().count() == 22
    assert sorted(rows(seeded)) == sorted(rows(seeded))


def test_onboarding(spark):
    signups = spark.createDataFrame(
        [
            ("x", "x@x", '{"name": "Xi"}'),
            ("y", None, "{}"),
            ("y", None, "{}"),
            ("u", "new@x", '{"name": "Imposter"}'),
        ],
        "id string, email string, metadata string",
    )
    after = changes.onboard_users(book(spark), signups)
    assert sorted(rows(after.profiles, "id", "name", "currency", "initial_balance"), key=str) == [
        ("u", "Una", "USD", "5.00"),
        ("v", None, "USD", "6.00"),
        ("x", "Xi", "USD", "0.00"),
        ("y", "", "USD", "0.00"),
    ]
    assert after.categories.count() == 4 + 22


def test_initial_balances(spark):
    asked = spark.createDataFrame(
        [("u", "12.50"), ("v", None), ("v", "lots"), ("v", "99999999999")],
        "id string, initial_balance string",
    )
    profiles, rejected = changes.update_initial_balances(book(spark).profiles, asked)
    assert sorted(rows(profiles, "id", "initial_balance")) == [("u", "12.50"), ("v", "6.00")]
    assert sorted(e for (e,) in rows(rejected, "error")) == [
        "Initial balance is out of range",
        "Initial balance is required",
        "Initial balance must be a valid number",
    ]


def test_insert_defaults(spark):
    new = spark.createDataFrame(
        [("k", "u", "Bike", None, None), ("l", "u", "Boat", Decimal("3.00"), "completed")],
        "id string, user_id string, name string, current_amount decimal(12,2), status string",
    ).withColumn("target_amount", F.lit(9))
    goals = table(spark, "financial_goals", [])
    found = changes.insert_with_defaults(goals, new, changes.INSERT_DEFAULTS["financial_goals"])
    assert rows(found.orderBy("id"), "current_amount", "status") == [
        ("0.00", "in_progress"),
        ("3.00", "completed"),
    ]


def test_change_and_inverse(spark):
    before = book(spark).transactions
    new = before.withColumn("id", F.concat(F.lit("n"), "id"))
    back = changes.apply_deletes(changes.append_transactions(before, new, AS_OF), new)
    assert sorted(rows(back), key=str) == sorted(rows(before), key=str)
    raised = before.select("id", "user_id", (F.col("amount") + 1).alias("amount"))
    undone = changes.apply_updates(
        changes.apply_updates(before, raised), before.select("id", "user_id", "amount")
    )
    assert sorted(rows(undone), key=str) == sorted(rows(before), key=str)


def test_repeated_changes_without_an_order_raise(spark):
    book = ledger(spark, transactions=[transaction(1, "u", "expense", 1, "2024-01-01")])
    twice = spark.createDataFrame([("1", "u", 5, 1), ("1", "u", 3, 2)], "id string, user_id string, amount int, at int")
    with pytest.raises(Exception, match="order_by"):
        changes.apply_updates(book.transactions, twice.drop("at")).collect()
    last = changes.apply_updates(book.transactions, twice, order_by="at")
    assert rows(last, "amount") == [("3.00",)]


def test_cascade_detaches_rows_of_others(spark):
    book = ledger(
        spark,
        profiles=[profile("gone"), profile("stays")],
        categories=[category("g", "gone", "expense"), category("s", "stays", "expense")],
        transactions=[
            transaction(1, "gone", "expense", 1, "2024-01-01", "g"),
            transaction(2, "stays", "expense", 1, "2024-01-01", "g"),
            transaction(3, "stays", "expense", 1, "2024-01-01", "s"),
        ],
        fixed_costs=[schedule("f", "stays", 1, "monthly", "2024-01-01", category_id="g")],
    )
    users = spark.createDataFrame([("gone",), ("gone",)], "user_id string")
    left = changes.delete_profiles_cascade(book, users)
    assert sorted(rows(left.transactions, "id", "category_id")) == [("2", None), ("3", "s")]
    assert rows(left.fixed_costs, "id", "category_id") == [("f", None)]
    assert quality.check_constraints(left).count() == 0


def test_generated_ids_need_text(spark):
    from ledgerloom.functions.ids import stable_id
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    with pytest.raises(ValueError, match="text ids"):
        stable_id(F.lit(1), id_type=T.LongType())
