"""Calendar predicates and month columns.

Periods are half-open date ranges on the bare ``date`` column, so that they
reach the Parquet scan as pushed filters; ``year(date) = 1998`` would not.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Partition column of stored transactions (see sources.parquet).
YEAR_PARTITION = "date_year"

Period = tuple[date, date]

# Month names.
_MONTH_NAMES = (
    "January February March April May June July August September October November December"
).split()


def check_month(month: int) -> None:
    if not 1 <= month <= 12:
        raise ValueError(f"month must be in 1..12, got {month}")


def month_period(year: int, month: int) -> Period:
    check_month(month)
    following = (year + 1, 1) if month == 12 else (year, month + 1)
    return date(year, month, 1), date(*following, 1)


def year_period(year: int) -> Period:
    return date(year, 1, 1), date(year + 1, 1, 1)


def within(df: DataFrame, period: Period | None) -> DataFrame:
    """Rows dated in the period; also prunes year partitions where there are any."""
    if period is None:
        return df
    start, stop = period
    kept = df.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(stop)))
    if YEAR_PARTITION in df.columns:
        last = stop.year if stop > date(stop.year, 1, 1) else stop.year - 1
        kept = kept.where(F.col(YEAR_PARTITION).between(start.year, last))
    return kept


def keep_year(df: DataFrame) -> DataFrame:
    """``df`` with the year partition, where it has one, following from the date.

    Every change that adds rows or sets dates passes through here, so that period
    filters find the changed rows on a stored ledger.
    """
    return df.withColumn(YEAR_PARTITION, F.year("date")) if YEAR_PARTITION in df.columns else df


def months_shown(year: int, as_of: date) -> int:
    """How many months a year report shows: all of a past year, else up to now.

    A future year is cut at the current month number too.
    """
    return 12 if year < as_of.year else as_of.month


def month_name(month: Column) -> Column:
    """The English name; a lookup, as formatting a date per row is slow."""
    return F.elt(month, *[F.lit(name) for name in _MONTH_NAMES])
