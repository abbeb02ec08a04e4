"""A ledger derived from the provided order, customer and part tables.

The formulas are those of FIXTURES.md section 2.  There are no joins
here, so predicates and pruning still reach the scans.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.model import Ledger

AS_OF = date(2001, 8, 1)

# Declared schemas of the tables used: opening a table reads no footers.
TABLES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,"
    " c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,"
    " o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,"
    " p_retailprice DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,"
    " l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,"
    " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def user_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of ``profiles``, for joins that carry nothing else of them.

    Read by a schema of the key alone, so that size estimates count the whole file: as a
    share of all declared columns, keys of millions of customers pass for few enough to
    be broadcast.
    """
    return spark.read.schema("c_custkey BIGINT").parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id")


def profiles(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS id",
        "c_name AS name",
        "CAST(NULL AS STRING) AS email",
        "'USD' AS currency",
        "CAST(c_acctbal AS DECIMAL(12,2)) AS initial_balance",
    )


# Type t and priority p of a customer's fifteen categories, as the number 10 t + p.
SLOTS = [10 * t + p for t in (1, 2, 3) for p in (1, 2, 3, 4, 5)]


def _shuffle_partitions(spark: SparkSession) -> int:
    """The number that shuffles start from, as set for the size of the input."""
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(initial or spark.conf.get("spark.sql.shuffle.partitions"))


def categories(customer: DataFrame) -> DataFrame:
    """Fifteen categories per customer: three types t, five priorities p.

    Keys compress to little, so a few megabytes of them become gigabytes of categories
    here: they are spread over tasks first, by an explicit number that is not merged by
    size, and multiplied by ``unpivot``, as Spark's size estimates count its rows, but
    not those of ``explode``, and would have the categories broadcast.
    """
    keys = customer.select("c_custkey").repartition(_shuffle_partitions(customer.sparkSession), "c_custkey")
    return (
        keys.selectExpr("c_custkey", *[f"{n} AS `{n}`" for n in SLOTS])
        .unpivot("c_custkey", [str(n) for n in SLOTS], "slot", "number")
        .selectExpr("c_custkey", "CAST(number div 10 AS INT) AS t", "number % 10 AS p")
        .selectExpr(
            "c_custkey", "t", "p", "elt(t, 'income', 'expense', 'investment') AS type"
        )
        .selectExpr(
            "c_custkey * 100 + t * 10 + p AS id",
            "c_custkey AS user_id",
            "IF(p = 5, 'Misc', concat_ws(' ', type, p)) AS name",
            "type",
            "IF(p = 5, 'more', concat('icon-', t, p)) AS icon",
            "IF(p = 5, '#808080', concat('#', t, p, '0000')) AS color",
            "p <= 2 AS is_default",
        )
    )


def transactions(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "*", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS t"
    ).selectExpr(
        "o_orderkey AS id",
        "o_custkey AS user_id",
        "CASE WHEN o_orderkey % 20 <> 0 THEN o_custkey * 100"
        " + ((t - 1 + IF(o_orderkey % 50 = 7, 1, 0)) % 3 + 1) * 10"
        " + CAST(substring(o_orderpriority, 1, 1) AS INT) END AS category_id",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS amount",
        "CAST(NULL AS STRING) AS note",
        "CAST(o_orderdate AS DATE) AS date",
        "elt(t, 'income', 'expense', 'investment') AS type",
        "o_orderdate AS created_at",
    )


def financial_goals(customer: DataFrame) -> DataFrame:
    return customer.selectExpr(
        "c_custkey AS id",
        "c_custkey AS user_id",
        "c_name AS name",
        "CAST(10000.00 AS DECIMAL(12,2)) AS target_amount",
        "greatest(CAST(c_acctbal AS DECIMAL(12,2)), CAST(0 AS DECIMAL(12,2))) AS current_amount",
        "IF(c_custkey % 10 <> 3, date_add(DATE '2001-01-01', CAST(c_custkey % 730 AS INT)), NULL)"
        " AS deadline",
        "elt(CAST(c_custkey % 3 + 1 AS INT), 'in_progress', 'completed', 'cancelled') AS status",
    )


def schedules(part: DataFrame, kind: int) -> DataFrame:
    """Schedules of one kind: 0 fixed costs, 1 periodic income, 2 fixed investments."""
    category = (2, 1, 3)[kind] * 10 + 1
    columns = [
        "p_partkey AS id",
        "p_partkey % 150 AS user_id",
        f"(p_partkey % 150) * 100 + {category} AS category_id",
        "CAST(p_retailprice AS DECIMAL(12,2)) AS amount",
        "elt(CAST(p_partkey % 6 + 1 AS INT), 'daily', 'weekly', 'biweekly', 'monthly',"
        " 'quarterly', 'annually') AS frequency",
        "start_date",
        "CASE p_partkey div 6 % 3 WHEN 1 THEN date_add(start_date, 730)"
        " WHEN 2 THEN DATE '2001-12-31' END AS end_date",
        "CAST(NULL AS STRING) AS note",
        "CASE p_partkey div 18 % 10 WHEN 9 THEN NULL WHEN 8 THEN false ELSE true END AS is_active",
        "CAST(NULL AS TIMESTAMP) AS created_at",
        "IF(p_partkey div 7 % 4 = 0, DATE '2001-05-31', NULL) AS last_generated_date",
    ]
    if kind == 2:
        columns += [
            "IF(p_partkey div 10 % 4 <> 0, CAST(p_partkey % 2000 / 100 AS DECIMAL(5,2)), NULL)"
            " AS expected_return_rate",
            "p_type AS investment_type",
        ]
    start = "date_add(DATE '1999-01-01', CAST(p_partkey % 1000 AS INT)) AS start_date"
    return part.where(f"p_partkey div 5 % 3 = {kind}").selectExpr("*", start).selectExpr(*columns)


def load_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    customer, orders, part = (
        read_table(spark, sf_dir, name) for name in ("customer", "orders", "part")
    )
    return Ledger(
        profiles=profiles(customer),
        categories=categories(customer),
        transactions=transactions(orders),
        financial_goals=financial_goals(customer),
        fixed_costs=schedules(part, 0),
        periodic_income=schedules(part, 1),
        fixed_investments=schedules(part, 2),
    )
