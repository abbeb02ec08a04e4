"""Filtered listings with the category embedded as a struct.

One user's listing is ordered as documented; one of all users is not unless
``ordered=True``: then users come first, by a range shuffle over all sort keys,
so a user with many rows is spread over several tasks.  Joining rows to categories is a plain join of two
scans: a category (or the missing one) holding much of the rows is split by
adaptive execution.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.periods import within
from ledgerloom.model import SCHEDULES, TRANSACTION_TYPES, Ledger


def scope_to_user(df: DataFrame, user_id: object, column: str = "user_id") -> DataFrame:
    """The rows one user owns."""
    return df.where(F.col(column) == F.lit(user_id))


def scope_to_users(df: DataFrame, users: DataFrame, column: str = "user_id") -> DataFrame:
    """The rows owned by any of ``users`` (a table with a ``user_id``)."""
    wanted = users.select(F.col("user_id").alias(column))
    return df.join(wanted, column, "left_semi").select(*df.columns)


def scope_ledger(ledger: Ledger, users: DataFrame) -> Ledger:
    """Every table restricted to what ``users`` own."""
    return ledger.with_tables(
        **{
            name: scope_to_users(table, users, "id" if name == "profiles" else "user_id")
            for name, table in ledger.tables().items()
        }
    )


def embed_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows with their category as struct ``categories``; NULL if there is none."""
    nested = categories.select(
        F.col("id").alias("category_id"), F.struct(*categories.columns).alias("categories")
    )
    return rows.join(nested, "category_id", "left").select(*rows.columns, "categories")


def _mine(df: DataFrame, user_id: object | None, column: str = "user_id") -> DataFrame:
    return df if user_id is None else scope_to_user(df, user_id, column)


def _ordered(df: DataFrame, ordered: bool, *order: Column) -> DataFrame:
    return df.orderBy("user_id", *order) if ordered else df


def _default(ordered: bool | None, user_id: object | None) -> bool:
    return user_id is not None if ordered is None else ordered


def list_transactions(
    ledger: Ledger, user_id: object | None = None, ordered: bool | None = None
) -> DataFrame:
    """L1: transactions with category, latest first."""
    rows = embed_category(_mine(ledger.transactions, user_id), ledger.categories)
    return _ordered(rows, _default(ordered, user_id), F.desc("date"), F.desc("id"))


def list_transactions_by_date(
    ledger: Ledger, day: date, user_id: object | None = None, ordered: bool | None = None
) -> DataFrame:
    """L2: transactions of one day with category, last created first."""
    rows = within(_mine(ledger.transactions, user_id), (day, day + timedelta(days=1)))
    created = [F.desc_nulls_first("created_at")] if "created_at" in rows.columns else []
    rows = embed_category(rows, ledger.categories)
    return _ordered(rows, _default(ordered, user_id), *created, F.desc("id"))


def lookup_by_key(
    table: DataFrame, keys: DataFrame, columns: tuple[str, ...] = ("id", "user_id")
) -> DataFrame:
    """L3: the rows with one of the given keys, e.g. a batch of (id, user_id)."""
    return table.join(keys.select(*columns), list(columns), "left_semi").select(*table.columns)


def lookup_few(table: DataFrame, keys: list[tuple], columns: tuple[str, ...] = ("id", "user_id"), most: int = 1000) -> DataFrame:
    """L3 for at most ``most`` keys given as values: they reach the scan.

    On stored transactions the Bloom filters of ids then exclude the row groups that
    hold none of them.  Values are asked for in groups of IN_LIST, as longer lists come to
    Parquet as a range.  A null in a key matches nothing; repeated keys count once.
    """
    if len(keys) > most:
        raise ValueError(f"{len(keys)} keys are more than {most}: use lookup_by_key")
    wanted = sorted({k for k in keys if None not in k})
    asked = F.lit(False)
    for at in range(0, len(wanted), IN_LIST):
        group = wanted[at : at + IN_LIST]
        either = F.lit(True)
        for i, c in enumerate(columns):
            either = either & F.col(c).isin([k[i] for k in group])
        asked = asked | either
    # The pairs themselves; the lists above are what the scan can use.
    pair = F.struct(*columns)
    exact = F.lit(False)
    for k in wanted:
        exact = exact | (pair == F.struct(*(F.lit(v).alias(c) for c, v in zip(columns, k, strict=True))))
    return table.where(asked & exact) if wanted else table.where(F.lit(False))


IN_LIST = 10  # spark.sql.parquet.pushdown.inFilterThreshold


def list_categories(
    ledger: Ledger, kind: str | None = None, user_id: object | None = None
) -> DataFrame:
    """L4: categories, optionally of one type."""
    if kind is not None and kind not in TRANSACTION_TYPES:
        raise ValueError(f"type must be one of {TRANSACTION_TYPES}, got {kind!r}")
    rows = _mine(ledger.categories, user_id)
    return rows if kind is None else rows.where(F.col("type") == kind)


def list_goals(ledger: Ledger, user_id: object | None = None, ordered: bool | None = None) -> DataFrame:
    """Goals by deadline, those without one last."""
    rows = _mine(ledger.financial_goals, user_id)
    return _ordered(rows, _default(ordered, user_id), F.asc_nulls_last("deadline"), F.asc("id"))


def list_schedules(
    ledger: Ledger, table: str, user_id: object | None = None, ordered: bool | None = None
) -> DataFrame:
    """One kind of schedule with category, largest amount first."""
    if table not in SCHEDULES:
        raise ValueError(f"table must be one of {tuple(SCHEDULES)}, got {table!r}")
    rows = embed_category(_mine(getattr(ledger, table), user_id), ledger.categories)
    return _ordered(rows, _default(ordered, user_id), F.desc("amount"), F.asc("id"))


def get_profiles(
    ledger: Ledger, user_id: object | None = None, users: DataFrame | None = None
) -> DataFrame:
    """All profiles, one user's, or those of a table of users."""
    rows = _mine(ledger.profiles, user_id, "id")
    return rows if users is None else scope_to_users(rows, users, "id")
