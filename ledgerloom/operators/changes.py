"""Batches of changes applied to a snapshot: (snapshot, changes) -> new snapshot.

All are joins on the row key, so one shuffle per side (or a broadcast of a small
batch, by the usual size checks).  The new snapshot must be written to a new
location: Spark cannot overwrite what it is reading.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.ids import stable_id
from ledgerloom.functions.periods import keep_year
from ledgerloom.model import AMOUNT, DEFAULT_CATEGORIES, SCHEDULES, Ledger
from ledgerloom.operators.quality import BALANCE_MESSAGES, is_number

KEYS = ("id", "user_id")
# Optional array column of a change batch: the fields a change sets.
SET_FIELDS = "set_fields"

# Defaults of new rows, by table.
INSERT_DEFAULTS: dict[str, dict[str, object]] = {
    "profiles": {"currency": "USD", "initial_balance": 0},
    "categories": {"is_default": False},
    "transactions": {},
    "financial_goals": {"current_amount": 0, "status": "in_progress"},
    "fixed_costs": {"is_active": True},
    "periodic_income": {"is_active": True},
    "fixed_investments": {"is_active": True},
}


# --- inserts ---------------------------------------------------------------


def insert_with_defaults(
    table: DataFrame, rows: DataFrame, defaults: Mapping[str, object | Column]
) -> DataFrame:
    """``table`` with ``rows`` added, NULL or missing fields set to defaults.

    Rows without an id get a random UUID when the table has text ids.  Write
    the result before using such ids elsewhere: a recomputed task draws anew.
    """
    defaults = dict(defaults)
    if "id" in table.columns and table.schema["id"].dataType.typeName() == "string":
        defaults.setdefault("id", F.expr("uuid()"))
    columns = []
    for field in table.schema:
        given = F.col(field.name) if field.name in rows.columns else F.lit(None)
        value = given.cast(field.dataType)
        if field.name in defaults:
            default = defaults[field.name]
            default = default if isinstance(default, Column) else F.lit(default)
            value = F.coalesce(value, default.cast(field.dataType))
        columns.append(value.alias(field.name))
    return table.unionByName(keep_year(rows.select(*columns)))


def append_transactions(transactions: DataFrame, rows: DataFrame, as_of: date) -> DataFrame:
    """M1: new transactions, dated ``as_of`` unless they say otherwise."""
    return insert_with_defaults(transactions, rows, {"date": F.lit(as_of)})


# --- updates and deletes ---------------------------------------------------


def apply_updates(
    table: DataFrame,
    changes: DataFrame,
    keys: tuple[str, ...] = KEYS,
    order_by: str | None = None,
    blank_is_absent: tuple[str, ...] = (),
    allowed: Column | None = None,
) -> DataFrame:
    """M2: sparse updates by key.

    A change sets the fields named in its ``set_fields``, NULL included; without
    that column it sets every field the batch has.  Several changes of one row
    are folded field by field, the last by ``order_by`` winning, so no row is
    ever duplicated; without an order, repeated keys raise when the plan runs.
    Changes whose keys match no row do nothing; that is how foreign rows are
    protected.
    ``blank_is_absent`` names fields where NULL or '' leave the old value.
    ``allowed`` is a predicate on the old row.
    """
    fields = [c for c in changes.columns if c in table.columns and c not in keys]

    def present(c: str) -> Column:
        given = F.lit(True)
        if SET_FIELDS in changes.columns:
            given = F.coalesce(F.array_contains(SET_FIELDS, c), F.lit(False))
        if c in blank_is_absent:
            given = given & (F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
        return given

    def last_set(c: str) -> Column:
        value = F.struct(F.col(c).cast(table.schema[c].dataType).alias("value"))
        if order_by:
            return F.max_by(value, F.when(present(c), F.col(order_by))).alias(f"__new_{c}")
        # The count guards every field, as unused fields are pruned.
        repeated = F.raise_error(F.lit("several changes of one row need order_by"))
        only = F.max(F.when(present(c), value))
        return F.when(F.count(F.lit(1)) > 1, repeated.cast(only_type(c))).otherwise(only).alias(f"__new_{c}")

    def only_type(c: str) -> T.StructType:
        return T.StructType([T.StructField("value", table.schema[c].dataType)])

    # A NULL struct means the field is absent; a struct of NULL sets NULL.
    patch = changes.groupBy(*keys).agg(*[last_set(c) for c in fields])
    joined = table.join(patch, list(keys), "left")
    may_change = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))

    def updated(c: str) -> Column:
        if c not in fields:
            return F.col(c)
        new = F.col(f"__new_{c}")
        return F.when(may_change & new.isNotNull(), new["value"]).otherwise(F.col(c)).alias(c)

    result = joined.select(*[updated(c) for c in table.columns])
    return keep_year(result) if "date" in fields else result


def apply_deletes(table: DataFrame, deleted: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """M3: ``table`` without the rows whose key is in ``deleted``."""
    return table.join(deleted.select(*keys), list(keys), "left_anti").select(*table.columns)


def update_profiles(profiles: DataFrame, changes: DataFrame, **options) -> DataFrame:
    """M2 for profiles: blank name, email or currency mean 'leave as it is'."""
    return apply_updates(
        profiles,
        changes,
        keys=("id",),
        blank_is_absent=("name", "email", "currency"),
        **options,
    )


def update_categories(categories: DataFrame, changes: DataFrame, **options) -> DataFrame:
    """M4: updates that leave default categories alone, as an unknown flag does."""
    return apply_updates(categories, changes, allowed=~F.col("is_default"), **options)


def _deletable(categories: DataFrame, deleted: DataFrame) -> DataFrame:
    own = categories.where(~F.col("is_default"))
    return own.join(deleted.select(*KEYS), list(KEYS), "left_semi")


def delete_categories(categories: DataFrame, deleted: DataFrame) -> DataFrame:
    """M4: deletes that leave default categories alone, as an unknown flag does."""
    asked = deleted.select(*[F.col(k).alias(f"__{k}") for k in KEYS])
    own = (F.col("id") == F.col("__id")) & (F.col("user_id") == F.col("__user_id"))
    return categories.join(asked, own & ~F.col("is_default"), "left_anti")


def category_changes_guarded(
    categories: DataFrame, changes: DataFrame, deleted: DataFrame
) -> DataFrame:
    """M4: a batch of updates, then a batch of deletes, of non-default categories."""
    return delete_categories(update_categories(categories, changes), deleted)


def delete_categories_set_null(ledger: Ledger, deleted: DataFrame) -> Ledger:
    """M5: delete categories; rows that referred to them become uncategorised.

    Ids of deleted categories are unique, so the left join keeps row counts; a
    category with much of the rows is split by adaptive execution.
    """
    gone = _deletable(ledger.categories, deleted).select("id")
    referring = ("transactions", *SCHEDULES)
    return ledger.with_tables(
        categories=delete_categories(ledger.categories, deleted),
        **{name: _detached(getattr(ledger, name), gone) for name in referring},
    )


def _detached(table: DataFrame, gone: DataFrame) -> DataFrame:
    """``table`` with references to the categories of ``gone`` (ids) set to NULL."""
    marked = gone.select(F.col("id").alias("category_id"), F.lit(True).alias("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.col("category_id"))
    joined = table.join(marked, "category_id", "left")
    return joined.withColumn("category_id", kept).select(*table.columns)


def delete_profiles_cascade(ledger: Ledger, users: DataFrame) -> Ledger:
    """M6: delete the profiles of ``users`` and everything they own.

    Rows of other users that refer to a deleted category become uncategorised.
    """
    owners = users.select("user_id").distinct()
    gone = ledger.categories.join(owners, "user_id", "left_semi").select("id")
    left = _owned_by_others(ledger, users)
    referring = ("transactions", *SCHEDULES)
    return left.with_tables(**{name: _detached(getattr(left, name), gone) for name in referring})


def _owned_by_others(ledger: Ledger, users: DataFrame) -> Ledger:
    return ledger.with_tables(
        **{
            name: apply_deletes(
                table,
                users.select(F.col("user_id").alias(owner)),
                (owner,),
            )
            for name, table in ledger.tables().items()
            for owner in ("id" if name == "profiles" else "user_id",)
        }
    )


# --- new users -------------------------------------------------------------


def seed_default_categories(users: DataFrame, categories: DataFrame) -> DataFrame:
    """M7: the default categories of each user, shaped like ``categories``."""
    id_type = categories.schema["id"].dataType
    template = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(kind).alias("type"),
                F.lit(icon).alias("icon"),
                F.lit(color).alias("color"),
            )
            for name, kind, icon, color in DEFAULT_CATEGORIES
        ]
    )
    seeded = users.select("user_id", F.inline(template))
    return seeded.select(
        stable_id(
            F.col("user_id"), F.lit("default"), F.col("type"), F.col("name"), id_type=id_type
        ).alias("id"),
        "user_id",
        "name",
        "type",
        "icon",
        "color",
        F.lit(True).alias("is_default"),
    )


def onboard_users(ledger: Ledger, signups: DataFrame) -> Ledger:
    """M8: profiles and default categories for sign-ups not known yet.

    ``signups`` has id, email and metadata (JSON text); the name is taken from
    the metadata, '' if it has none.
    """
    name = F.coalesce(F.get_json_object("metadata", "$.name"), F.lit(""))
    new = signups.join(ledger.profiles.select("id"), "id", "left_anti").dropDuplicates(["id"])
    profiles = insert_with_defaults(
        ledger.profiles,
        new.select("id", "email", name.alias("name")),
        INSERT_DEFAULTS["profiles"],
    )
    seeds = seed_default_categories(new.select(F.col("id").alias("user_id")), ledger.categories)
    return ledger.with_tables(
        profiles=profiles,
        categories=ledger.categories.unionByName(seeds),
        monthly_activity=ledger.monthly_activity,
    )


def update_initial_balances(
    profiles: DataFrame, requests: DataFrame, order_by: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """M9: set initial balances; returns the profiles and the rejected requests.

    ``requests`` has the user's id and the balance as received, as text.
    """
    value = F.col("initial_balance")
    reason = (
        F.when(value.isNull(), BALANCE_MESSAGES["missing"])
        .when(~is_number(value), BALANCE_MESSAGES["not a number"])
        .when(value.try_cast(AMOUNT).isNull(), BALANCE_MESSAGES["out of range"])
    )
    checked = requests.withColumn("error", reason)
    accepted = checked.where(F.col("error").isNull()).drop("error")
    accepted = accepted.withColumn("initial_balance", value.try_cast(AMOUNT))
    updated = apply_updates(profiles, accepted, keys=("id",), order_by=order_by)
    return updated, checked.where(F.col("error").isNotNull())
