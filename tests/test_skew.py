"""One user, and one category, holding a third of all rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import listings, reports
from ledgerloom.sources.testbed import AS_OF, load_ledger

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000",
    "spark.sql.shuffle.partitions": "16",
    # One file per task.
    "spark.sql.files.openCostInBytes": "134217728",
}


@pytest.fixture
def small_pieces(spark):
    old = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def skewed_ledger(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("skewed") / "transactions")
    book = load_ledger(spark, "/root/testdata/sf0.01")
    hot = F.col("id") % 3 == 0
    moved = book.transactions.withColumns(
        {
            "user_id": F.when(hot, 7).otherwise(F.col("user_id")),
            "date": F.when(hot, F.lit(date(1998, 3, 9))).otherwise(F.col("date")),
            "category_id": F.when(F.col("category_id").isNull(), None)
            .when(F.col("id") % 9 == 0, 723)
            .otherwise(F.col("category_id")),
        }
    )
    # Several files, so several map tasks: splitting works by map output.
    moved.repartition(16, "id").write.parquet(path)
    stored = spark.read.schema(moved.schema).parquet(path)
    return book.with_tables(transactions=stored)


def users(book):
    return book.profiles.select(F.col("id").alias("user_id"))


def executed(df):
    rows = df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return rows, final


@pytest.mark.parametrize(
    ("query", "key"),
    [
        (lambda book: reports.monthly_calendar(book, 1998, 3), "__join_key"),
        (lambda book: reports.monthly_calendar(book, 1998, 3), "category_id"),
        (lambda book: listings.list_transactions(book, ordered=False), "category_id"),
        (lambda book: listings.scope_to_users(book.transactions, users(book)), "user_id"),
    ],
)
def test_hot_keys_are_split(small_pieces, skewed_ledger, query, key):
    book = skewed_ledger
    rows, final = executed(query(book))
    assert f"Join(skew=true) [{key}#" in final
    for key in list(SETTINGS)[:2]:
        small_pieces.conf.unset(key)
    small_pieces.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    plain = query(book).collect()
    small_pieces.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert sorted(map(str, rows)) == sorted(map(str, plain))


def test_hot_user_totals(skewed_ledger):
    """Totals of the hot user against one plain aggregate."""
    book = skewed_ledger
    expected = {
        r.type: r.total
        for r in book.transactions.where("user_id = 7").groupBy("type").agg(F.sum("amount").alias("total")).collect()
    }
    (found,) = reports.all_time_totals(book, 7).collect()
    assert found.total_income == expected["income"]
    assert found.total_expense == expected["expense"]
    assert found.total_investments == expected["investment"]
    year = reports.annual_report(book, 1998, AS_OF, 7).collect()
    assert year[-1].running_expense_total == year[-1].year_to_date_expense_total
