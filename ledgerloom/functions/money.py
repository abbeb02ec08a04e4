"""Sums and shares of decimal amounts.

Totals are added up in cents as 64-bit integers, several times faster than wide
decimals in an aggregation buffer.  That is exact, and any total that fits the
emitted decimal(18,2) fits; beyond it ANSI mode raises instead of wrapping.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.model import MONEY, PERCENT


def money(value: Column) -> Column:
    """A value as emitted: decimal(18,2), with NULL counted as 0."""
    return F.coalesce(value, F.lit(0)).cast(MONEY)


def _cents(amount: Column) -> Column:
    return (amount * F.lit(100)).cast("bigint")


def total(amount: Column) -> Column:
    """Aggregate: the sum of amounts, 0 if there are none."""
    cents = F.coalesce(F.sum(_cents(amount)), F.lit(0))
    return (cents.cast(T.DecimalType(18, 0)) * F.lit(Decimal("0.01"))).cast(MONEY)


def sum_of_type(kind: str, amount: str = "amount", by: str = "type") -> Column:
    return total(F.when(F.col(by) == kind, F.col(amount)))


def type_totals(by: str = "type", amount: str = "amount") -> list[Column]:
    """Aggregates ``income``, ``expense`` and ``investment`` in one pass."""
    return [sum_of_type(k, amount, by).alias(k) for k in ("income", "expense", "investment")]


def net_of_all() -> Column:
    return (F.col("income") - F.col("expense") - F.col("investment")).cast(MONEY)


def percent(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, half-up to 2 places; NULL if whole is 0.

    Worked out in whole hundredths, so ties round right for wholes of any size.
    """
    wide = T.DecimalType(38, 0)
    a, b = ((c.cast(MONEY) * F.lit(100)).cast(T.DecimalType(20, 0)) for c in (part, whole))
    twice = (F.abs(b) * F.lit(2)).cast(wide)
    shifted = (F.abs(a) * F.lit(20000) + F.abs(b)).cast(wide)
    hundredths = F.call_function("div", shifted, F.nullif(twice, F.lit(0).cast(wide)))
    signed = F.when((a < 0) != (b < 0), -hundredths).otherwise(hundredths)
    return (signed.cast(T.DecimalType(18, 0)) * F.lit(Decimal("0.01"))).cast(PERCENT)


def share(part: Column, whole: Column) -> Column:
    """Like ``percent``, but 0 where the whole is not positive."""
    return F.when(whole > 0, percent(part, whole)).otherwise(F.lit(0)).cast(PERCENT)
