"""Validation of raw rows and integrity checks of stored tables.

Raw rows are text, as received.  A missing field is NULL; '' is a given value.
Validators add an array of errors, and ``typed_*`` gives valid rows their types, each in one projection, without
a shuffle and without Python code per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.model import (
    AMOUNT,
    FREQUENCIES,
    FREQUENCY_ALIASES,
    GOAL_STATUSES,
    RATE,
    SCHEDULES,
    TRANSACTION_TYPES,
    Ledger,
)

# Accepted forms of raw text.
NUMBER = r"^[+-]?([0-9]*[.])?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ISO_DATE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"
)
BASIC_DATE = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"
BOOLEANS = ("true", "false", "1", "0")

# Messages, by check.
TRANSACTION_MESSAGES = {
    "amount": "Amount must be a number",
    "amount range": "Amount is out of range",
    "type": "Invalid transaction type",
    "date": "Invalid date format",
    "category_id": "Invalid category ID",
}
GOAL_MESSAGES = {
    "name": "Name is required",
    "target_amount": "Target amount must be greater than 0",
    "current_amount": "Current amount must be 0 or greater",
    "deadline": "Deadline must be a valid date",
    "status": "Invalid status",
    "user_id": "User ID is required",
}
SCHEDULE_MESSAGES = {
    "amount": "Amount must be greater than 0",
    "frequency": "Invalid frequency",
    "start_date": "Start date must be a valid date",
    "end_date": "End date must be a valid date",
    "category_id": "Category ID must be a valid UUID",
    "is_active": "Is active must be a boolean",
    "expected_return_rate": "Expected return rate must be a valid percentage",
    "investment_type": "Investment type is required",
}
BALANCE_MESSAGES = {
    "missing": "Initial balance is required",
    "not a number": "Initial balance must be a valid number",
    "out of range": "Initial balance is out of range",
}

ERRORS = "errors"


# --- predicates on text ----------------------------------------------------


# Fixed value: what trimming takes off, Unicode spaces and the byte order mark too.
SPACES = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def trimmed(column: str) -> Column:
    return F.regexp_replace(column, f"^{SPACES}|{SPACES}$", "")


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def iso_date(text: Column) -> Column:
    """The date of an ISO 8601 text, else NULL.  The cast alone is too lenient."""
    extended = F.when(text.rlike(ISO_DATE), F.substring(text, 1, 10))
    basic = F.when(text.rlike(BASIC_DATE), F.regexp_replace(text, BASIC_DATE, "$1-$2-$3"))
    return F.coalesce(extended, basic).try_cast("date")


def float_value(text: Column) -> Column:
    return F.when(text.rlike(FLOAT), text.try_cast("double"))


def _optional(field: str, valid: Column) -> Column:
    return F.col(field).isNull() | valid


def _with_errors(
    rows: DataFrame, messages: dict[str, str], checks: dict[str, Column]
) -> DataFrame:
    """Adds an error for every check that is not true; unknown is not true.

    A check is named by its field, or by the field and what about it.
    """
    problems = [
        F.when(
            ~F.coalesce(valid, F.lit(False)),
            F.struct(F.lit(name.split(" ")[0]).alias("field"), F.lit(messages[name]).alias("msg")),
        )
        for name, valid in checks.items()
    ]
    return rows.withColumn(ERRORS, F.filter(F.array(*problems), lambda e: e.isNotNull()))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with their ``errors``."""
    valid = F.size(ERRORS) == 0
    return checked.where(valid).drop(ERRORS), checked.where(~valid)


# --- validators ------------------------------------------------------------


def validate_transactions(raw: DataFrame) -> DataFrame:
    """V1: raw transactions with ``errors``."""
    amount = F.col("amount")
    fits = amount.try_cast(AMOUNT).isNotNull()
    return _with_errors(
        raw,
        TRANSACTION_MESSAGES,
        {
            "amount": is_number(amount),
            "amount range": fits | ~F.coalesce(is_number(amount), F.lit(False)),
            "type": F.col("type").isin(*TRANSACTION_TYPES),
            "date": iso_date(F.col("date")).isNotNull(),
            "category_id": F.col("category_id").rlike(UUID),
        },
    )


def typed_transactions(valid: DataFrame) -> DataFrame:
    """Valid raw transactions with amount and date in their types."""
    return valid.withColumns(
        {"amount": F.col("amount").cast(AMOUNT), "date": iso_date(F.col("date"))}
    )


def _at_least(field: str, low: float) -> Column:
    return (float_value(F.col(field)) >= low) & F.col(field).try_cast(AMOUNT).isNotNull()


def validate_goals(raw: DataFrame) -> DataFrame:
    """V2: raw goals, names trimmed, with ``errors``."""
    # Emptiness is judged before trimming, so a blank name passes.
    checked = _with_errors(
        raw,
        GOAL_MESSAGES,
        {
            "name": F.length("name") > 0,
            "target_amount": _at_least("target_amount", 0.01),
            "current_amount": _optional("current_amount", _at_least("current_amount", 0)),
            "deadline": _optional("deadline", iso_date(F.col("deadline")).isNotNull()),
            "status": _optional("status", F.col("status").isin(*GOAL_STATUSES)),
            "user_id": F.length("user_id") > 0,
        },
    )
    return checked.withColumn("name", trimmed("name"))


def _schedule_checks() -> dict[str, Column]:
    return {
        "amount": _at_least("amount", 0.01),
        "frequency": F.col("frequency").isin(*FREQUENCIES, *FREQUENCY_ALIASES),
        "start_date": iso_date(F.col("start_date")).isNotNull(),
        "end_date": _optional("end_date", iso_date(F.col("end_date")).isNotNull()),
        "category_id": _optional("category_id", F.col("category_id").rlike(UUID)),
        "is_active": _optional("is_active", F.col("is_active").isin(*BOOLEANS)),
    }


def validate_schedules(raw: DataFrame) -> DataFrame:
    """V3: raw fixed costs or periodic income, notes trimmed, with ``errors``."""
    checked = _with_errors(raw, SCHEDULE_MESSAGES, _schedule_checks())
    return checked.withColumn("note", trimmed("note"))


def validate_investments(raw: DataFrame) -> DataFrame:
    """V4: raw fixed investments with ``errors``.

    Rates beyond 999.99 do not fit their column and are rejected too.
    """
    rate = F.col("expected_return_rate")
    fits = float_value(rate).between(-100, 1000) & rate.try_cast(RATE).isNotNull()
    checks = {
        **_schedule_checks(),
        "expected_return_rate": _optional("expected_return_rate", fits),
        "investment_type": F.length("investment_type") > 0,
    }
    return _with_errors(raw, SCHEDULE_MESSAGES, checks).withColumns(
        {"note": trimmed("note"), "investment_type": trimmed("investment_type")}
    )


def _flag(field: str) -> Column:
    return F.when(F.col(field).isin("true", "1"), True).when(F.col(field).isin("false", "0"), False)


def typed_goals(valid: DataFrame) -> DataFrame:
    """Valid raw goals with amounts and deadline in their types."""
    return valid.withColumns(
        {
            "target_amount": F.col("target_amount").cast(AMOUNT),
            "current_amount": F.col("current_amount").cast(AMOUNT),
            "deadline": iso_date(F.col("deadline")),
        }
    )


def typed_schedules(valid: DataFrame) -> DataFrame:
    """Valid raw schedules of any kind with typed fields and declared frequencies."""
    frequency = F.col("frequency")
    for other, name in FREQUENCY_ALIASES.items():
        frequency = F.when(frequency == other, name).otherwise(frequency)
    typed = valid.withColumns(
        {
            "amount": F.col("amount").cast(AMOUNT),
            "frequency": frequency,
            "start_date": iso_date(F.col("start_date")),
            "end_date": iso_date(F.col("end_date")),
            "is_active": _flag("is_active"),
        }
    )
    if "expected_return_rate" in typed.columns:
        typed = typed.withColumn("expected_return_rate", F.col("expected_return_rate").cast(RATE))
    return typed


# --- integrity of stored tables --------------------------------------------

_REQUIRED = {
    "profiles": ("id",),
    "categories": ("id", "user_id", "name", "type", "icon", "color"),
    "transactions": ("id", "user_id", "amount", "date", "type"),
    "financial_goals": ("id", "user_id", "name", "target_amount"),
    **{t: ("id", "user_id", "amount", "frequency", "start_date") for t in SCHEDULES},
}
_REQUIRED["fixed_investments"] = (*_REQUIRED["fixed_investments"], "investment_type")
_DOMAINS = {
    "categories": {"type": TRANSACTION_TYPES},
    "transactions": {"type": TRANSACTION_TYPES},
    "financial_goals": {"status": GOAL_STATUSES},
    **{t: {"frequency": FREQUENCIES} for t in SCHEDULES},
}
_AMOUNTS = {
    "profiles": ("initial_balance",),
    "transactions": ("amount",),
    "financial_goals": ("target_amount", "current_amount"),
    **{t: ("amount",) for t in SCHEDULES},
}
_AMOUNTS["fixed_investments"] = ("amount", "expected_return_rate")
_CATEGORISED = ("transactions", *SCHEDULES)


def _range_type(column: str) -> T.DataType:
    return RATE if column == "expected_return_rate" else AMOUNT


def _violations(table: str, ids: DataFrame, rule: str) -> DataFrame:
    return ids.select(
        F.lit(table).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.col("id").cast("string").alias("row_id"),
    )


def row_rules(table: str) -> list[Column]:
    """Names of broken rules that one row alone can show."""
    rules = [
        F.when(F.col(c).isNull(), f"{c} not null") for c in _REQUIRED[table]
    ] + [
        F.when(~F.col(c).isin(*values), f"{c} domain")
        for c, values in _DOMAINS.get(table, {}).items()
    ]
    return rules + [
        F.when(F.col(c).isNotNull() & F.col(c).try_cast(_range_type(c)).isNull(), f"{c} range")
        for c in _AMOUNTS.get(table, ())
    ]


def _with_known(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Marks rows whose reference exists, in a join that splits skewed keys.

    As in ``functions.skew``, joining on a struct keeps the planner from reusing the
    partitioning of the distinct keys.  Ids compress to little: their size as stored must
    not have them broadcast.
    """
    key, mark = f"__key_{column}", f"__known_{column}"
    known = parents.select("id").distinct().select(F.struct("id").alias(key), F.lit(True).alias(mark))
    given = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("id")))
    return rows.withColumn(key, given).join(known.hint("merge"), key, "left").drop(key)


def check_constraints(ledger: Ledger) -> DataFrame:
    """V5: every violated constraint as (table_name, rule, row_id).

    Each table is read twice: once for the rules of single rows and its references
    together, once for keys, which are counted with map-side combining and reported
    once.
    """
    found = []
    for name, table in ledger.tables().items():
        parents = {} if name == "profiles" else {"user_id": ledger.profiles}
        if name in _CATEGORISED:
            parents["category_id"] = ledger.categories
        rules, rows = row_rules(name), table
        for column, parent in parents.items():
            rows = _with_known(rows, column, parent)
            orphan = F.col(column).isNotNull() & F.col(f"__known_{column}").isNull()
            rules.append(F.when(orphan, f"{column} reference"))
        broken = F.filter(F.array(*rules), lambda r: r.isNotNull())
        rows = rows.select("id", F.explode(broken).alias("rule"))
        found.append(
            rows.select(
                F.lit(name).alias("table_name"),
                "rule",
                F.col("id").cast("string").alias("row_id"),
            )
        )
        repeated = table.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        found.append(_violations(name, repeated, "id unique"))
    return reduce(DataFrame.unionByName, found)


def warn_inconsistencies(ledger: Ledger) -> DataFrame:
    """Oddities the tables allow, as (table_name, rule, row_id)."""
    found = []
    for name in SCHEDULES:
        early = getattr(ledger, name).where(F.col("end_date") < F.col("start_date"))
        found.append(_violations(name, early, "end_date before start_date"))
    owners = ledger.categories.select(
        F.col("id").alias("category_id"),
        F.col("type").alias("category_type"),
        F.col("user_id").alias("category_owner"),
    )
    rows = ledger.transactions.where(F.col("category_id").isNotNull()).join(owners, "category_id")
    odd = F.array(
        F.when(F.col("type") != F.col("category_type"), "type differs from category"),
        F.when(F.col("user_id") != F.col("category_owner"), "category of another user"),
    )
    odd_rows = rows.select(
        F.lit("transactions").alias("table_name"),
        F.explode(F.filter(odd, lambda r: r.isNotNull())).alias("rule"),
        F.col("id").cast("string").alias("row_id"),
    )
    found.append(odd_rows)
    return reduce(DataFrame.unionByName, found)
