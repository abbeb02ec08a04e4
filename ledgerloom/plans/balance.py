"""R7 in two levels, so that a back-dated row leaves most of it alone.

``months`` holds each active month's sums with the net running inside its year, and
``carries`` what a user brings into each year.  A month's balance is the opening
balance, the carry of its year and the net so far.  A row that comes or goes anywhere
in the past changes the months of its own year, and the carries of its user's later
years: a row a year, instead of every later month.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import money, net_of_all, total
from ledgerloom.functions.periods import YEAR_PARTITION, month_name
from ledgerloom.model import MONEY
from ledgerloom.plans.activity import totals_by
from ledgerloom.plans.upkeep import RowChange

_YEAR = ["user_id", "year"]


@dataclass(frozen=True)
class Balance:
    """Both levels: (user_id, year, month, income, expense, investment, net_amount,
    net_so_far) and (user_id, year, net, carried)."""

    months: DataFrame
    carries: DataFrame


def _months(rows: DataFrame) -> DataFrame:
    keys = ["user_id", F.year("date").alias("year"), F.month("date").alias("month")]
    so_far = Window.partitionBy(*_YEAR).orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    monthly = totals_by(rows, *keys).withColumn("net_amount", net_of_all())
    return monthly.withColumn("net_so_far", F.sum("net_amount").over(so_far).cast(MONEY))


def _nets(months: DataFrame) -> DataFrame:
    return months.groupBy(*_YEAR).agg(total(F.col("net_amount")).alias("net"))


def _carried(nets: DataFrame) -> DataFrame:
    """Adds the sum of each user's earlier years: a window over a user's years."""
    earlier = Window.partitionBy("user_id").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    return nets.withColumn("carried", money(F.sum("net").over(earlier)))


def balance_of(transactions: DataFrame) -> Balance:
    months = _months(transactions)
    return Balance(months, _carried(_nets(months)))


def after(balance: Balance, change: RowChange, transactions_after: DataFrame) -> Balance:
    """The balance once a change is made.

    Of ``transactions_after`` only the touched users' touched years are read; of
    ``carries`` the rows of touched users are worked out again.
    """
    both = change.removed.select("user_id", "date").unionByName(change.added.select("user_id", "date"))
    touched = both.select("user_id", F.year("date").alias("year")).distinct()
    stored_year = YEAR_PARTITION in transactions_after.columns
    year = F.col(YEAR_PARTITION) if stored_year else F.year("date")
    rows = transactions_after.withColumn("year", year)
    anew = _months(rows.join(touched, _YEAR, "left_semi").drop("year"))
    kept = balance.months.join(touched, _YEAR, "left_anti").select(*anew.columns)
    users = touched.select("user_id").distinct()
    nets = balance.carries.join(users, "user_id", "left_semi").select(*_YEAR, "net")
    nets = nets.join(touched, _YEAR, "left_anti").unionByName(_nets(anew))
    carries = _carried(nets)
    others = balance.carries.join(users, "user_id", "left_anti").select(*carries.columns)
    return Balance(kept.unionByName(anew), others.unionByName(carries))


def report(balance: Balance, profiles: DataFrame) -> DataFrame:
    """The rows of ``reports.all_time_balance``."""
    # As in that report, profiles are merged: by their compressed size they would be broadcast.
    opening = profiles.select(
        F.col("id").alias("user_id"), money(F.col("initial_balance")).alias("initial_balance")
    ).hint("merge")
    reached = F.col("initial_balance") + F.col("carried") + F.col("net_so_far")
    return (
        balance.months.join(balance.carries.select(*_YEAR, "carried"), _YEAR)
        .join(opening, "user_id", "left")
        .select(
            "user_id",
            "year",
            "month",
            month_name(F.col("month")).alias("month_name"),
            F.col("income").alias("income_amount"),
            F.col("expense").alias("expense_amount"),
            F.col("investment").alias("investment_amount"),
            "net_amount",
            "initial_balance",
            reached.cast(MONEY).alias("cumulative_balance"),
        )
    )
