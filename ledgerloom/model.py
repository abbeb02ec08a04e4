"""Ledger tables: schemas, value domains and the holder passed to operators."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Domains of the enumerated columns, in their declared order.
TRANSACTION_TYPES = ("expense", "income", "investment")
FREQUENCIES = ("daily", "weekly", "biweekly", "monthly", "quarterly", "annually")
FREQUENCY_ALIASES = {"yearly": "annually"}
GOAL_STATUSES = ("in_progress", "completed", "cancelled")

# Categories every new user starts with (name, type, icon, color).
DEFAULT_CATEGORIES = (
    ("Food", "expense", "fastfood", "#FF5252"),
    ("Transportation", "expense", "directions-car", "#448AFF"),
    ("Houseware", "expense", "home-work", "#9C27B0"),
    ("Bills", "expense", "payments", "#FF9800"),
    ("Shopping", "expense", "shopping-bag", "#E91E63"),
    ("Salary", "income", "currency-exchange", "#4CAF50"),
    ("Freelance", "income", "work", "#8BC34A"),
    ("Bonus", "income", "money", "#CDDC39"),
    ("Stocks", "investment", "inventory", "#795548"),
    ("Real Estate", "investment", "domain", "#607D8B"),
    ("Crypto", "investment", "currency-bitcoin", "#9E9E9E"),
)

AMOUNT = T.DecimalType(12, 2)  # stored amounts
MONEY = T.DecimalType(18, 2)  # totals of amounts
# Shares of mixed-sign totals are unbounded, so percents are as wide as money.
PERCENT = T.DecimalType(18, 2)
RATE = T.DecimalType(5, 2)


def _schema(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in columns])


_SCHEDULE = (
    ("category_id", T.StringType(), True),
    ("amount", AMOUNT, False),
    ("frequency", T.StringType(), False),
    ("start_date", T.DateType(), False),
    ("end_date", T.DateType(), True),
    ("note", T.StringType(), True),
    ("is_active", T.BooleanType(), True),
    ("created_at", T.TimestampType(), True),
    ("last_generated_date", T.DateType(), True),
)
_OWNED = (("id", T.StringType(), False), ("user_id", T.StringType(), False))

# Ids are opaque to every operator; stored ledgers use UUID strings.
SCHEMAS: dict[str, T.StructType] = {
    "profiles": _schema(
        ("id", T.StringType(), False),
        ("name", T.StringType(), True),
        ("email", T.StringType(), True),
        ("currency", T.StringType(), True),
        ("initial_balance", AMOUNT, True),
    ),
    "categories": _schema(
        *_OWNED,
        ("name", T.StringType(), False),
        ("type", T.StringType(), False),
        ("icon", T.StringType(), False),
        ("color", T.StringType(), False),
        ("is_default", T.BooleanType(), True),
    ),
    "transactions": _schema(
        *_OWNED,
        ("category_id", T.StringType(), True),
        ("amount", AMOUNT, False),
        ("note", T.StringType(), True),
        ("date", T.DateType(), False),
        ("type", T.StringType(), False),
        ("created_at", T.TimestampType(), True),
    ),
    "financial_goals": _schema(
        *_OWNED,
        ("name", T.StringType(), False),
        ("target_amount", AMOUNT, False),
        ("current_amount", AMOUNT, True),
        ("deadline", T.DateType(), True),
        ("status", T.StringType(), True),
    ),
    "fixed_costs": _schema(*_OWNED, *_SCHEDULE),
    "periodic_income": _schema(*_OWNED, *_SCHEDULE),
    "fixed_investments": _schema(
        *_OWNED,
        *_SCHEDULE,
        ("expected_return_rate", RATE, True),
        ("investment_type", T.StringType(), False),
    ),
}

# Schedule table -> (type of the transactions it generates, default note).
SCHEDULES = {
    "fixed_costs": ("expense", "Auto-generated fixed cost"),
    "periodic_income": ("income", "Auto-generated periodic income"),
    "fixed_investments": ("investment", "Auto-generated investment: "),
}


@dataclass(frozen=True)
class Ledger:
    """The seven tables, plus an optional stored monthly rollup of transactions.

    With ``monthly_activity`` set, every report that only needs monthly sums
    reads the rollup instead of the transactions (see ``plans.activity``).
    """

    profiles: DataFrame
    categories: DataFrame
    transactions: DataFrame
    financial_goals: DataFrame
    fixed_costs: DataFrame
    periodic_income: DataFrame
    fixed_investments: DataFrame
    monthly_activity: DataFrame | None = None

    def with_tables(self, **tables: DataFrame) -> Ledger:
        """A ledger with some tables replaced.

        Replacing the transactions drops a rollup built from the old ones.
        """
        if "transactions" in tables:
            tables.setdefault("monthly_activity", None)
        return replace(self, **tables)

    def create_views(self, prefix: str = "") -> None:
        """Make the tables available to SQL as temporary views."""
        for name, table in self.tables().items():
            table.createOrReplaceTempView(prefix + name)

    def tables(self) -> dict[str, DataFrame]:
        return {
            f.name: getattr(self, f.name) for f in fields(self) if f.name != "monthly_activity"
        }
