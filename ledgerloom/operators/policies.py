"""Who may change which rows: the owner policies of every table, as data.

A policy names what a user may do to a table's rows.  Reads, updates and deletes reach
only rows the user owns; what an insert or update leaves must be owned by the user too,
so that nobody gives rows away or takes others'.  What no policy allows is refused.

Batches carry ``actor_id``, the user who asks.  Each operator returns the table after
what was allowed, and the refused changes with the reason.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.model import Ledger
from ledgerloom.operators import changes

ACTOR = "actor_id"
REASON = "reason"
NO_POLICY, NOT_VISIBLE, NOT_OWNED = "no policy", "row not visible", "row of another user"


@dataclass(frozen=True)
class Policy:
    """``owner`` is the column that holds a row's user; ``allows`` the actions."""

    owner: str
    allows: tuple[str, ...]


_ALL = ("select", "insert", "update", "delete")
# What owners may do, by table.  Profiles go with the account.
POLICIES: dict[str, Policy] = {
    "profiles": Policy("id", ("select", "insert", "update")),
    "categories": Policy("user_id", _ALL),
    "transactions": Policy("user_id", _ALL),
    "financial_goals": Policy("user_id", _ALL),
    "fixed_costs": Policy("user_id", _ALL),
    "periodic_income": Policy("user_id", _ALL),
    "fixed_investments": Policy("user_id", _ALL),
}


def _policy(table: str, policies: Mapping[str, Policy] | None) -> Policy:
    return (policies or POLICIES).get(table, Policy("user_id", ()))


def visible(ledger: Ledger, table: str, actors: DataFrame, policies: Mapping[str, Policy] | None = None) -> DataFrame:
    """Rows of a table that any of ``actors`` (actor_id) may see."""
    policy, rows = _policy(table, policies), getattr(ledger, table)
    if "select" not in policy.allows:
        return rows.where(F.lit(False))
    wanted = actors.select(F.col(ACTOR).alias(policy.owner))
    return rows.join(wanted, policy.owner, "left_semi").select(*rows.columns)


def _judged(batch: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    judged = batch.withColumn(REASON, reason)
    return judged.where(F.col(REASON).isNull()).drop(REASON), judged.where(F.col(REASON).isNotNull())


def _own(batch: DataFrame, rows: DataFrame, policy: Policy) -> DataFrame:
    """``batch`` with ``__seen``: whether its actor owns the row it names.

    A join on the row's key, one row of the table each, as every change needs one.
    """
    key = F.struct("id", policy.owner).alias("__row")
    seen = rows.select(key, F.lit(True).alias("__seen"))
    asked = F.struct(F.col("id"), F.col(ACTOR).alias(policy.owner))
    return batch.withColumn("__row", asked).join(seen, "__row", "left").drop("__row")


def insert_as(
    ledger: Ledger, table: str, rows: DataFrame, defaults: Mapping[str, object] | None = None,
    policies: Mapping[str, Policy] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Inserts of rows that belong to who asks; an absent or other owner is refused."""
    policy, stored = _policy(table, policies), getattr(ledger, table)
    mine = F.col(policy.owner).eqNullSafe(F.col(ACTOR)) & F.col(ACTOR).isNotNull()
    reason = F.when(~mine, NOT_OWNED) if "insert" in policy.allows else F.lit(NO_POLICY)
    accepted, refused = _judged(rows, reason)
    filled = {**changes.INSERT_DEFAULTS[table], **(defaults or {})}
    return changes.insert_with_defaults(stored, accepted.drop(ACTOR), filled), refused


def update_as(
    ledger: Ledger, table: str, batch: DataFrame, policies: Mapping[str, Policy] | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Sparse updates (as ``changes.apply_updates``, with ``id`` and ``actor_id`` as key).

    Rows the actor doesn't own aren't visible to it.  A new owner other than the actor,
    NULL included, is refused with the whole change.
    """
    policy, stored = _policy(table, policies), getattr(ledger, table)
    if "update" not in policy.allows:
        return stored, batch.withColumn(REASON, F.lit(NO_POLICY))
    reason = F.when(F.col("__seen").isNull(), NOT_VISIBLE)
    gives = "new_owner" in batch.columns
    if gives:
        given = F.lit(True)
        if changes.SET_FIELDS in batch.columns:
            given = F.coalesce(F.array_contains(changes.SET_FIELDS, "new_owner"), F.lit(False))
        reason = reason.when(given & ~F.col("new_owner").eqNullSafe(F.col(ACTOR)), NOT_OWNED)
    accepted, refused = _judged(_own(batch, stored, policy), reason)
    accepted = accepted.drop("__seen", "new_owner")
    keys = ("id",) if policy.owner == "id" else ("id", policy.owner)
    accepted = accepted.drop(ACTOR) if policy.owner == "id" else accepted.withColumnRenamed(ACTOR, policy.owner)
    return changes.apply_updates(stored, accepted, keys=keys, **options), refused.drop("__seen")


def delete_as(
    ledger: Ledger, table: str, batch: DataFrame, policies: Mapping[str, Policy] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Deletes of rows (by id) that the actor owns."""
    policy, stored = _policy(table, policies), getattr(ledger, table)
    if "delete" not in policy.allows:
        return stored, batch.withColumn(REASON, F.lit(NO_POLICY))
    accepted, refused = _judged(_own(batch, stored, policy), F.when(F.col("__seen").isNull(), NOT_VISIBLE))
    keys = accepted.select("id", F.col(ACTOR).alias(policy.owner))
    return changes.apply_deletes(stored, keys, ("id", policy.owner)), refused.drop("__seen")
