"""Row changes of the transactions, and the monthly rollup kept under them.

A change is what it takes away and what it adds, both as whole transactions: an
update takes the old version away and adds the new one.  The rollup follows by
signed sums over the groups (user, category, type, month) that are touched.  Only
for groups that something is taken from are transactions looked at again, for a
latest date in place of a lost one.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import total
from ledgerloom.functions.periods import YEAR_PARTITION, keep_year
from ledgerloom.model import Ledger
from ledgerloom.operators import changes

_GROUP = ["user_id", "category_id", "type", "date"]
# Latest dates of a group: as stored, added, removed, and found again.
_DATES = ("last_date", "__added", "__removed", "__latest")


@dataclass(frozen=True)
class RowChange:
    """Transactions taken away (by id and user) and added."""

    removed: DataFrame
    added: DataFrame

    def then(self, other: RowChange) -> RowChange:
        """Both changes, which must not touch the same rows."""
        return RowChange(self.removed.unionByName(other.removed), self.added.unionByName(other.added))


def _none(transactions: DataFrame) -> DataFrame:
    return transactions.where(F.lit(False))


def inserted(transactions: DataFrame, rows: DataFrame, as_of) -> RowChange:
    """M1 as a row change."""
    empty = _none(transactions)
    return RowChange(empty, changes.append_transactions(empty, rows, as_of))


def updated(transactions: DataFrame, batch: DataFrame, **options) -> RowChange:
    """M2 as a row change: the rows the batch names, before and after."""
    keys = options.get("keys", changes.KEYS)
    old = transactions.join(batch.select(*keys).distinct(), list(keys), "left_semi").select(*transactions.columns)
    return RowChange(old, changes.apply_updates(old, batch, **options))


def deleted(transactions: DataFrame, keys: DataFrame) -> RowChange:
    """M3 as a row change."""
    old = transactions.join(keys.select(*changes.KEYS), list(changes.KEYS), "left_semi").select(*transactions.columns)
    return RowChange(old, _none(transactions))


def detached(transactions: DataFrame, gone: DataFrame) -> RowChange:
    """M5 as a row change: rows of the categories ``gone`` (ids) become uncategorised."""
    ids = gone.select(F.col("id").alias("category_id"))
    old = transactions.join(ids, "category_id", "left_semi").select(*transactions.columns)
    nothing = F.lit(None).cast(transactions.schema["category_id"].dataType)
    return RowChange(old, old.withColumn("category_id", nothing))


def owned(transactions: DataFrame, users: DataFrame) -> RowChange:
    """M6 as a row change: everything ``users`` own goes."""
    old = transactions.join(users.select("user_id"), "user_id", "left_semi").select(*transactions.columns)
    return RowChange(old, _none(transactions))


def after(transactions: DataFrame, change: RowChange) -> DataFrame:
    """``transactions`` with the change made."""
    left = changes.apply_deletes(transactions, change.removed)
    return left.unionByName(keep_year(change.added))


def touched_years(change: RowChange) -> DataFrame:
    """The years (one column) that a change takes rows from or adds rows to."""
    both = change.removed.select("date").unionByName(change.added.select("date"))
    return both.select(F.year("date").alias(YEAR_PARTITION)).distinct()


def _signed(rows: DataFrame, sign: int, latest: str) -> DataFrame:
    """The rows of a change's side, to be added to the stored ones of the rollup."""
    dates = {c: F.col("date") if c == latest else F.lit(None).cast("date") for c in _DATES}
    return rows.select(
        "user_id", "category_id", "type", F.trunc("date", "month").alias("date"),
        (F.col("amount") * F.lit(sign)).alias("amount"), F.lit(sign).cast("bigint").alias("n"),
        *(d.alias(c) for c, d in dates.items()),
    )


def rollup_after(rollup: DataFrame, change: RowChange, transactions_after: DataFrame) -> DataFrame:
    """The monthly rollup of ``transactions_after``, from the one before the change.

    ``rollup`` may be cut to the months that the change touches.  ``transactions_after``
    is read only for groups that something is taken from: they are sought by user and
    month, and a change that takes nothing away reads none.  Groups left without
    transactions go.  Taking away what the rollup never held raises when the plan runs.

    Stored rows, changes and dates found again are summed in one grouping; no join follows.
    """
    nothing = F.lit(None).cast("date")
    stored = rollup.select(*_GROUP, "amount", "n", *((F.col(c) if c == "last_date" else nothing).alias(c) for c in _DATES))
    again = _latest_again(change.removed, transactions_after).select(
        *_GROUP, F.lit(0).cast(rollup.schema["amount"].dataType).alias("amount"), F.lit(0).cast("bigint").alias("n"),
        *(F.col(c) if c == "__latest" else nothing.alias(c) for c in _DATES),
    )
    parts = (stored, _signed(change.removed, -1, "__removed"), _signed(change.added, 1, "__added"), again)
    merged = (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*_GROUP)
        .agg(total(F.col("amount")).alias("amount"), F.sum("n").alias("n"), *(F.max(c).alias(c) for c in _DATES))
    )
    kept, new = F.col("last_date"), F.col("__added")
    lost = (F.col("__removed") >= kept) & (new.isNull() | (new < kept)) & (F.col("n") > 0)
    unheld = F.raise_error(F.lit("rows were removed that the rollup does not hold"))
    return merged.select(
        *_GROUP, "amount",
        F.when(F.col("n") < 0, unheld.cast("bigint")).otherwise(F.col("n")).alias("n"),
        F.when(lost, F.col("__latest")).otherwise(F.greatest(kept, new)).alias("last_date"),
    ).where("n > 0")


def _all(conditions: Iterable[Column]) -> Column:
    whole = F.lit(True)
    for c in conditions:
        whole = whole & c
    return whole


def _latest_again(removed: DataFrame, transactions: DataFrame) -> DataFrame:
    """The latest date of each group that ``removed`` has rows of, from its transactions."""
    month = F.trunc("date", "month").alias("date")
    rows = transactions.select("user_id", "category_id", "type", month, F.col("date").alias("__latest"))
    wanted = removed.select("user_id", "category_id", "type", month).distinct().select(*(F.col(c).alias(f"__{c}") for c in _GROUP))
    same = _all(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _GROUP)
    return rows.join(wanted, same, "left_semi")


def changed(ledger: Ledger, change: RowChange) -> Ledger:
    """``ledger`` with the change made, its rollup (if it has one) kept up."""
    rows = after(ledger.transactions, change)
    rollup = ledger.monthly_activity
    if rollup is not None:
        kept = rollup_after(rollup, change, rows).withColumn(YEAR_PARTITION, F.year("date"))
        rollup = kept.select(*rollup.columns)
    return ledger.with_tables(transactions=rows, monthly_activity=rollup)
