"""Owner policies: who sees and changes what."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.model import SCHEMAS
from ledgerloom.operators import policies as P
from small import category, ledger, profile, rows, transaction


def book(spark):
    return ledger(
        spark,
        profiles=[profile("u", 3), profile("v")],
        categories=[category("c", "u", "expense"), category("d", "v", "income")],
        transactions=[transaction(1, "u", "expense", 1, "2024-01-01", "c"), transaction(2, "v", "income", 2, "2024-01-02")],
    )


def test_every_table_has_a_policy():
    assert set(P.POLICIES) == set(SCHEMAS)
    assert "delete" not in P.POLICIES["profiles"].allows
    assert all(p.allows == ("select", "insert", "update", "delete") for t, p in P.POLICIES.items() if t != "profiles")


def test_reads(spark):
    actors = spark.createDataFrame([("u",), ("u",), (None,)], "actor_id string")
    assert rows(P.visible(book(spark), "transactions", actors), "id") == [("1",)]
    assert rows(P.visible(book(spark), "profiles", actors), "id") == [("u",)]
    none = {"profiles": P.Policy("id", ())}
    assert P.visible(book(spark), "profiles", actors, none).count() == 0


def test_inserts_belong_to_who_asks(spark):
    new = spark.createDataFrame(
        [("u", "u", "a"), ("u", "v", "b"), (None, None, "c"), ("u", None, "d"), (None, "u", "e")],
        "actor_id string, user_id string, name string",
    ).withColumns({"id": F.col("name"), "type": F.lit("income"), "icon": F.lit("i"), "color": F.lit("c")})
    after, refused = P.insert_as(book(spark), "categories", new)
    assert sorted(rows(after, "id", "user_id", "is_default")) == [("a", "u", False), ("c", "u", False), ("d", "v", False)]
    assert sorted(rows(refused, "name", "reason")) == [(n, P.NOT_OWNED) for n in "bcde"]


def test_updates_reach_own_rows_only_and_give_nothing_away(spark):
    batch = spark.createDataFrame(
        [("1", "u", Decimal(9), None, ["amount"]), ("2", "u", Decimal(9), None, ["amount"]), ("3", "u", Decimal(9), None, ["amount"]),
         ("2", "v", Decimal(8), "u", ["amount", "new_owner"]), ("1", None, Decimal(7), None, ["amount"])],
        "id string, actor_id string, amount decimal(12,2), new_owner string, set_fields array<string>",
    )
    after, refused = P.update_as(book(spark), "transactions", batch)
    assert sorted(rows(after, "id", "user_id", "amount")) == [("1", "u", "9.00"), ("2", "v", "2.00")]
    assert sorted(rows(refused, "id", "actor_id", "reason"), key=str) == [
        ("1", None, P.NOT_VISIBLE), ("2", "u", P.NOT_VISIBLE), ("2", "v", P.NOT_OWNED), ("3", "u", P.NOT_VISIBLE),
    ]
    kept = batch.where("id = '2' AND actor_id = 'v'").withColumn("new_owner", F.lit("v"))
    assert ("2", "v", "8.00") in rows(P.update_as(book(spark), "transactions", kept)[0], "id", "user_id", "amount")
    nobody = kept.withColumn("new_owner", F.lit(None).cast("string"))
    assert rows(P.update_as(book(spark), "transactions", nobody)[1], "reason") == [(P.NOT_OWNED,)]


def test_profiles_are_their_own(spark):
    batch = spark.createDataFrame([("u", "u", "new"), ("v", "u", "stolen")], "id string, actor_id string, name string")
    after, refused = P.update_as(book(spark), "profiles", batch)
    assert sorted(rows(after, "id", "name")) == [("u", "new"), ("v", None)]
    assert rows(refused, "id", "reason") == [("v", P.NOT_VISIBLE)]
    left, refused = P.delete_as(book(spark), "profiles", batch)
    assert left.count() == 2 and {r.reason for r in refused.collect()} == {P.NO_POLICY}


@pytest.mark.parametrize("table", ["transactions", "categories"])
def test_deletes(spark, table):
    ids = ("1", "2") if table == "transactions" else ("c", "d")
    batch = spark.createDataFrame([(ids[0], "u"), (ids[1], "u"), ("none", "u"), (None, None)], "id string, actor_id string")
    left, refused = P.delete_as(book(spark), table, batch)
    assert rows(left, "id") == [(ids[1],)]
    assert sorted(rows(refused, "id"), key=str) == sorted([(ids[1],), ("none",), (None,)], key=str)


def test_policies_are_data(spark):
    shared = {"transactions": P.Policy("user_id", ("select", "insert"))}
    batch = spark.createDataFrame([("1", "u", date(2020, 1, 1))], "id string, actor_id string, date date")
    assert rows(P.update_as(book(spark), "transactions", batch, shared)[1], "reason") == [(P.NO_POLICY,)]
    assert P.delete_as(book(spark), "transactions", batch, shared)[0].count() == 2
    assert P.insert_as(book(spark), "categories", batch, policies=shared)[1].count() == 1
