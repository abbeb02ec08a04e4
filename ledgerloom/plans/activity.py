"""The input shape shared by all summing reports, and its monthly rollup.

An activity row is (user_id, category_id, type, date, amount, n, last_date).
A transaction is an activity row as it stands (n = 1), at the cost of a
projection only.  A rollup row stands for all transactions of a user, category
and type in one month, dated the first of that month.  Reports cut time at
month boundaries, so both give the same answers; at scale the rollup saves
every report after the first its scan of the transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import total, type_totals
from ledgerloom.functions.periods import YEAR_PARTITION, Period, within
from ledgerloom.model import Ledger

_KEYS = ["user_id", "category_id", "type"]


def activity(
    ledger: Ledger, period: Period | None = None, user_id: object | None = None
) -> DataFrame:
    """Activity rows of a period, from the rollup if the ledger has one."""
    if ledger.monthly_activity is not None:
        rows = ledger.monthly_activity
    else:
        partition = [c for c in (YEAR_PARTITION,) if c in ledger.transactions.columns]
        rows = ledger.transactions.select(
            *_KEYS,
            "date",
            "amount",
            F.lit(1).cast("bigint").alias("n"),
            F.col("date").alias("last_date"),
            *partition,
        )
    if user_id is not None:
        rows = rows.where(F.col("user_id") == F.lit(user_id))
    return within(rows, period)


def monthly_rollup(rows: DataFrame) -> DataFrame:
    """Activity rows condensed to one per user, category, type and month."""
    return rows.groupBy(*_KEYS, F.trunc("date", "month").alias("date")).agg(
        total(F.col("amount")).alias("amount"),
        F.sum("n").alias("n"),
        F.max("last_date").alias("last_date"),
    )


def totals_by(rows: DataFrame, *keys) -> DataFrame:
    """Income, expense and investment per key; uncategorised rows count."""
    return rows.groupBy(*keys).agg(*type_totals())


def by_category(rows: DataFrame, *more_keys) -> DataFrame:
    """Amount per user and category; uncategorised rows are left out."""
    return (
        rows.where(F.col("category_id").isNotNull())
        .groupBy("user_id", "category_id", *more_keys)
        .agg(total(F.col("amount")).alias("amount"))
    )
