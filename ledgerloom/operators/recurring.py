"""Expansion of recurring schedules into dated transactions.

Everything is computed within a schedule's own row: no shuffle, unless ``spread``
asks for one of the schedules themselves.

Modes
  reference  steps from the last generation mark (or the start date), that date
             included.  The mark is the day of the run, so each run repeats the
             previous run's date and steps on from there.
  anchored   always steps from the start date and keeps only dates after the
             mark: running twice adds nothing.  Recommended.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.ids import stable_id
from ledgerloom.functions.periods import keep_year
from ledgerloom.model import FREQUENCY_ALIASES, MONEY, SCHEDULES, Ledger

MODES = ("reference", "anchored")

# Step of each frequency.
DAY_STEPS = {"daily": 1, "weekly": 7, "biweekly": 14}
MONTH_STEPS = {"monthly": 1, "quarterly": 3, "annually": 12}


def normalise_frequency(frequency: Column) -> Column:
    for alias, name in FREQUENCY_ALIASES.items():
        frequency = F.when(frequency == alias, name).otherwise(frequency)
    return frequency


def eligible(as_of: date) -> Column:
    """Active and not ended.  An unknown activity flag is not active."""
    open_ended = F.col("end_date").isNull() | (F.col("end_date") >= F.lit(as_of))
    return F.coalesce(F.col("is_active"), F.lit(False)) & open_ended


def _step(steps: dict[str, int]) -> Column:
    frequency = normalise_frequency(F.col("frequency"))
    choice = F.lit(None).cast("int")
    for name, size in steps.items():
        choice = F.when(frequency == name, size).otherwise(choice)
    return choice


def _month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def _steps_until(first: Column, day: Column) -> Column:
    """Number of whole steps from ``first`` that cannot overshoot ``day``'s month or day.

    An unknown frequency never steps.
    """
    days, months = F.col("day_step"), F.col("month_step")
    by_days = F.floor(F.datediff(day, first) / days)
    by_months = F.floor((_month_number(day) - _month_number(first)) / months)
    return F.coalesce(by_days, by_months, F.lit(0)).cast("int")


def _date_after(first: Column, k: Column) -> Column:
    """The date k steps after ``first``, stepping one by one.

    A step into a shorter month clamps the day, and the clamped day is stepped
    on from: Jan 31, Feb 29, Mar 29.  So the day is the smallest month length
    met on the way.  Two years of steps meet every month there is to meet, and
    of two Februaries one is short, hence at most 24 / step + 1 months matter.
    """
    step = F.col("month_step")
    first_month = F.trunc(first, "month")

    def month_at(j: Column) -> Column:
        return F.add_months(first_month, (j * step).cast("int"))

    met = F.sequence(F.lit(0), F.least(k, (F.lit(24) / step).cast("int")))
    shortest = F.array_min(F.transform(met, lambda j: F.dayofmonth(F.last_day(month_at(j)))))
    clamped = F.date_add(month_at(k), F.least(F.dayofmonth(first), shortest) - 1)
    by_months = F.when(F.dayofmonth(first) <= 28, F.add_months(first, (k * step).cast("int")))
    return F.coalesce(
        F.date_add(first, (k * F.col("day_step")).cast("int")), by_months, clamped, first
    )


def next_due(mark: Column) -> Column:
    """The first date after ``mark`` on which a schedule is due, stepping from its start.

    The start itself where ``mark`` is NULL.  NULL if there is none: after the end, or
    after the one date of an unknown frequency.  Needs the columns of ``with_steps``.
    """
    start = F.col("start_date")
    k = F.greatest(F.coalesce(_steps_until(start, mark), F.lit(0)), F.lit(0))
    here, onward = _date_after(start, k), _date_after(start, k + 1)
    # Step k can't overshoot the mark's month or day, so step k + 1 is past it.
    first = F.when(mark.isNull(), start).when(here > mark, here).when(onward > mark, onward)
    return F.when(F.col("end_date").isNull() | (first <= F.col("end_date")), first)


def with_steps(schedules: DataFrame) -> DataFrame:
    return schedules.select(
        "*", _step(DAY_STEPS).alias("day_step"), _step(MONTH_STEPS).alias("month_step")
    )


def _amount_and_note(table: str) -> tuple[Column, Column]:
    amount, (_, default_note) = F.col("amount"), SCHEDULES[table]
    if table != "fixed_investments":
        return amount, F.coalesce("note", F.lit(default_note))
    # Both factors are exact decimals, so the rounding is exactly half-up.
    growth = (F.lit(100) + F.col("expected_return_rate")) * F.lit(Decimal("0.01"))
    grown = F.coalesce(F.round(amount * growth, 2), amount)
    return grown, F.coalesce("note", F.concat(F.lit(default_note), F.col("investment_type")))


def expand(
    ledger: Ledger,
    table: str,
    as_of: date,
    mode: str = "reference",
    spread: int | None = None,
) -> DataFrame:
    """Transactions due up to ``as_of`` from one schedule table.

    A back-fill turns one schedule into many rows within its task.  ``spread``
    first hashes the eligible schedules over that many tasks by their id.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    kind, _ = SCHEDULES[table]
    schedules = getattr(ledger, table)
    mark, start = F.col("last_generated_date"), F.col("start_date")
    last_day = F.least(F.lit(as_of), F.col("end_date"))  # ignores a NULL end
    due = with_steps(schedules.where(eligible(as_of)))
    if spread:
        due = due.repartition(spread, "id")
    if mode == "reference":
        due = due.withColumn("first", F.coalesce(mark, start)).withColumn("k0", F.lit(0))
        wanted = F.lit(True)
    else:
        due = due.withColumn("first", start).withColumn(
            "k0", F.greatest(F.coalesce(_steps_until(start, mark), F.lit(0)), F.lit(0))
        )
        wanted = mark.isNull() | (F.col("date") > mark)
    first = F.col("first")
    # The bounds are ordered inside the expression: explode is evaluated for
    # schedules that start in the future too.
    steps = F.sequence(F.col("k0"), F.greatest(_steps_until(first, last_day), F.col("k0")))
    amount, note = _amount_and_note(table)
    id_type = ledger.transactions.schema["id"].dataType
    # In reference mode the date stepped from tells repeated dates apart.
    anchor = [first] if mode == "reference" else []
    return (
        due.withColumn("k", F.explode(steps))
        .withColumn("date", _date_after(first, F.col("k")))
        .where((F.col("date") <= last_day) & wanted)
        .select(
            stable_id(
                F.lit(table), F.col("id"), F.col("date"), *anchor, id_type=id_type
            ).alias("id"),
            F.col("id").alias("schedule_id"),
            "user_id",
            "category_id",
            amount.cast(MONEY).alias("amount"),
            note.alias("note"),
            "date",
            F.lit(kind).alias("type"),
        )
    )


def expand_fixed_costs(
    ledger: Ledger, as_of: date, mode: str = "reference", spread: int | None = None
) -> DataFrame:
    """G1: due expenses."""
    return expand(ledger, "fixed_costs", as_of, mode, spread)


def expand_periodic_income(
    ledger: Ledger, as_of: date, mode: str = "reference", spread: int | None = None
) -> DataFrame:
    """Due income."""
    return expand(ledger, "periodic_income", as_of, mode, spread)


def expand_fixed_investments(
    ledger: Ledger, as_of: date, mode: str = "reference", spread: int | None = None
) -> DataFrame:
    """Due investments, each amount grown by the expected return rate."""
    return expand(ledger, "fixed_investments", as_of, mode, spread)


def expand_all_schedules(
    ledger: Ledger, as_of: date, mode: str = "reference", spread: int | None = None
) -> DataFrame:
    """Everything due."""
    return reduce(
        DataFrame.unionByName, [expand(ledger, table, as_of, mode, spread) for table in SCHEDULES]
    )


def advance_schedules(ledger: Ledger, as_of: date) -> Ledger:
    """The ledger with every eligible schedule marked as generated at ``as_of``."""
    moved = F.when(eligible(as_of), F.lit(as_of)).otherwise(F.col("last_generated_date"))
    return ledger.with_tables(
        **{t: getattr(ledger, t).withColumn("last_generated_date", moved) for t in SCHEDULES},
        monthly_activity=ledger.monthly_activity,
    )


def run_schedules(ledger: Ledger, as_of: date, mode: str = "anchored") -> Ledger:
    """Record everything due as transactions and advance the marks."""
    due = expand_all_schedules(ledger, as_of, mode).drop("schedule_id")
    stored = ledger.transactions.schema
    recorded = due.select(
        *[
            (F.col(f.name) if f.name in due.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in stored
            if not isinstance(f.dataType, T.NullType)
        ]
    )
    advanced = advance_schedules(ledger, as_of)
    return advanced.with_tables(
        transactions=ledger.transactions.unionByName(keep_year(recorded))
    )
