"""Every operator as a query over the provided tables.

The ledger is derived from the tables by ``sources.testbed``; each query runs
over all of it.  Nested results are flattened here so that they can be compared
with SQL; the operators themselves return the nested shapes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.model import AMOUNT, SCHEDULES, Ledger
from ledgerloom.operators import changes, gate, listings, policies, quality, recurring, reports
from ledgerloom.plans import balance, upkeep
from ledgerloom.plans.activity import activity
from ledgerloom.session import shared_dir
from ledgerloom.sources import due, testbed
from ledgerloom.sources import upkeep as stored_upkeep
from ledgerloom.sources.parquet import read_ledger, write_ledger, write_rollup
from ledgerloom.sources.testbed import AS_OF, read_table
from ledgerloom.sql import register_reports
from ledgerloom.streaming import refresh
from ledgerloom.streaming import signups as onboarding

Query = Callable[[SparkSession, str], DataFrame]

YEAR, MONTH, DAY = 1998, 3, date(1998, 3, 15)
STREAM_SECONDS = 6 * 3600


def load_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger as the tables are now; nothing is kept between queries."""
    return testbed.load_ledger(spark, sf_dir)


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, sf_dir: str, ledger: Ledger | None = None, rollup: bool = False) -> Ledger:
    """The ledger written to the shared folder and opened again."""
    root = _scratch(spark, "ledger")
    ledger = ledger or load_ledger(spark, sf_dir)
    write_ledger(ledger, root)
    ids = ledger.transactions.schema["id"].dataType
    opened = read_ledger(spark, root, ids)
    if rollup:
        write_rollup(opened, root)
        opened = read_ledger(spark, root, ids, rollup=True)
    return opened


def _texts(ledger: Ledger) -> Ledger:
    """With text ids, as stored ledgers have: generated rows get UUID-shaped ones."""
    named = ("id", "user_id", "category_id")
    return ledger.with_tables(
        **{
            name: table.withColumns({c: F.col(c).cast("string") for c in named if c in table.columns})
            for name, table in ledger.tables().items()
        }
    )


def _on_stored(operator: Callable[..., DataFrame], *args, rollup: bool = False) -> Query:
    return lambda spark, sf_dir: operator(_stored(spark, sf_dir, rollup=rollup), *args)


def _on_ledger(operator: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: operator(load_ledger(spark, sf_dir), *args)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- flattened shapes ------------------------------------------------------


def _flat_category(rows: DataFrame) -> DataFrame:
    own = [c for c in rows.columns if c != "categories"]
    nested = rows.schema["categories"].dataType.names
    return rows.select(*own, *[F.col(f"categories.{n}").alias(f"category_{n}") for n in nested if n != "id"])


def _annual_report_full(ledger: Ledger) -> DataFrame:
    return reports.annual_report(ledger, YEAR, AS_OF)


def _top_recent_years(ledger: Ledger) -> DataFrame:
    rows = reports.top_categories_recent_years(ledger)
    return rows.select("user_id", "year", F.posexplode_outer("categories")).select(
        "user_id", "year", F.col("pos").alias("position"), "col.*"
    )


def _monthly_summary(ledger: Ledger) -> DataFrame:
    return reports.monthly_summary_nested(ledger, YEAR, MONTH)


# --- recurring -------------------------------------------------------------


def _expansion(table: str | None, mode: str = "reference") -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ledger = load_ledger(spark, sf_dir)
        texts = ledger.transactions.withColumn("id", F.col("id").cast("string"))
        ledger = ledger.with_tables(transactions=texts)
        # These are back-fills of several years.
        spread = spark.sparkContext.defaultParallelism
        if table is None:
            return recurring.expand_all_schedules(ledger, AS_OF, mode, spread)
        return recurring.expand(ledger, table, AS_OF, mode, spread)

    return query


# Days on which schedules are run that were filed by due date the day before the first.
RUN_DAYS = (date(2001, 6, 2), date(2001, 6, 3), date(2001, 7, 1), date(2001, 7, 31), AS_OF)


def _due_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules are filed, then run on some days; each run reads what is due alone."""
    ledger = _texts(load_ledger(spark, sf_dir))
    root = _scratch(spark, "due")
    due.file_schedules(ledger, root, date(2001, 6, 1))
    recorded = [due.run_due(ledger, root, day, f"{root}/recorded") for day in RUN_DAYS]
    return due.read_runs(spark, f"{root}/recorded", list(RUN_DAYS), recorded[0])


_SCHEDULE_COLUMNS = (
    "id", "user_id", "category_id", "amount", "frequency", "start_date", "end_date", "note", "is_active",
    "created_at", "last_generated_date",
)


def _run_then_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything due is recorded on a stored ledger, then the year is reported."""
    stored = _stored(spark, sf_dir, _texts(load_ledger(spark, sf_dir)))
    return reports.annual_report(recurring.run_schedules(stored, AS_OF), 2000, AS_OF)


def _advance(ledger: Ledger) -> DataFrame:
    moved = recurring.advance_schedules(ledger, AS_OF)
    return _union(
        [
            getattr(moved, t).select(F.lit(t).alias("schedule"), *_SCHEDULE_COLUMNS)
            for t in SCHEDULES
        ]
    )


# --- listings --------------------------------------------------------------


def _list_transactions(ledger: Ledger) -> DataFrame:
    return _flat_category(listings.list_transactions(ledger))


def _list_transactions_by_date(ledger: Ledger) -> DataFrame:
    return _flat_category(listings.list_transactions_by_date(ledger, DAY))


def _list_schedules(ledger: Ledger) -> DataFrame:
    return _union(
        [
            _flat_category(listings.list_schedules(ledger, t, ordered=False))
            .withColumn("schedule", F.lit(t))
            for t in SCHEDULES
        ]
    )


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys asked for: one per line item, with the customer of its order."""
    ledger = load_ledger(spark, sf_dir)
    lines = read_table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    orders = read_table(spark, sf_dir, "orders")
    keys = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("id"), F.col("o_custkey").alias("user_id")
    )
    return listings.lookup_by_key(ledger.transactions, keys)


def _segment_users(spark: SparkSession, sf_dir: str, segment: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    return customer.where(F.col("c_mktsegment") == segment).select(F.col("c_custkey").alias("user_id"))


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = load_ledger(spark, sf_dir)
    return listings.scope_to_users(
        ledger.transactions, _segment_users(spark, sf_dir, "MACHINERY")
    )


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = load_ledger(spark, sf_dir)
    return listings.get_profiles(ledger, users=_segment_users(spark, sf_dir, "MACHINERY"))


# --- changes ---------------------------------------------------------------


def _new_rows(ledger: Ledger) -> DataFrame:
    """Repeats of some transactions under new ids, half of them undated."""
    source = ledger.transactions.where(F.col("id") % 17 == 0)
    return source.select(
        (-F.col("id")).alias("id"),  # stored ids are positive
        "user_id",
        "category_id",
        "amount",
        F.when(F.col("id") % 2 == 0, F.col("date")).alias("date"),
        "type",
    )


def _append(ledger: Ledger) -> DataFrame:
    return changes.append_transactions(ledger.transactions, _new_rows(ledger), AS_OF)


def _append_then_report(ledger: Ledger) -> DataFrame:
    rows = changes.append_transactions(ledger.transactions, _new_rows(ledger), AS_OF)
    return reports.annual_report(ledger.with_tables(transactions=rows), YEAR, AS_OF)


def _update_date_then_report(ledger: Ledger) -> DataFrame:
    """Every eleventh transaction moves a year on."""
    moved = ledger.transactions.where(F.col("id") % 11 == 0).select(
        "id", "user_id", F.add_months("date", 12).alias("date")
    )
    rows = changes.apply_updates(ledger.transactions, moved)
    return reports.annual_report(ledger.with_tables(transactions=rows), YEAR, AS_OF)


def _transaction_changes(ledger: Ledger) -> DataFrame:
    """Amounts raised; every second change also sets, every third clears a field.

    Each third change comes from someone who does not own the row.
    """
    key = F.col("id")
    return ledger.transactions.where(key % 11 == 0).select(
        "id",
        F.when(key % 33 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        (F.col("amount") + 1).cast(AMOUNT).alias("amount"),
        F.when(key % 4 == 0, "reviewed").alias("note"),
        F.lit(None).cast("bigint").alias("category_id"),
        F.when(key % 5 == 0, F.array(F.lit("amount"), F.lit("note"), F.lit("category_id")))
        .otherwise(F.array(F.lit("amount"), F.lit("note")))
        .alias("set_fields"),
    )


def _update(ledger: Ledger) -> DataFrame:
    return changes.apply_updates(ledger.transactions, _transaction_changes(ledger))


def _delete(ledger: Ledger) -> DataFrame:
    deleted = ledger.transactions.where(F.col("id") % 13 == 0)
    return changes.apply_deletes(ledger.transactions, deleted)


def _misc_and_first(ledger: Ledger) -> DataFrame:
    """Categories users try to delete: 'Misc', and 'expense 1', a default."""
    return ledger.categories.where(F.col("name").isin("Misc", "expense 1"))


def _guarded(ledger: Ledger) -> DataFrame:
    recolored = ledger.categories.select(
        "id", "user_id", F.lit("#123456").alias("color"), F.upper("name").alias("name")
    )
    return changes.category_changes_guarded(ledger.categories, recolored, _misc_and_first(ledger))


def _set_null(ledger: Ledger) -> DataFrame:
    left = changes.delete_categories_set_null(ledger, _misc_and_first(ledger))
    rows = [
        getattr(left, t).select(F.lit(t).alias("table_name"), "id", "user_id", "category_id", "amount")
        for t in ("transactions", *SCHEDULES)
    ]
    kept = left.categories.select(F.lit("categories").alias("table_name"), "id", "user_id")
    return _union([*rows, kept])


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some transactions and schedules refer to the next user's categories."""
    ledger = load_ledger(spark, sf_dir)
    foreign = F.when(F.col("id") % 7 == 0, F.col("category_id") + 100).otherwise(F.col("category_id"))
    ledger = ledger.with_tables(
        **{t: getattr(ledger, t).withColumn("category_id", foreign) for t in ("transactions", *SCHEDULES)}
    )
    left = changes.delete_profiles_cascade(ledger, _segment_users(spark, sf_dir, "HOUSEHOLD"))
    return _union(
        [
            table.select(
                F.lit(name).alias("table_name"),
                "id",
                F.col("id" if name == "profiles" else "user_id").alias("user_id"),
                *[c for c in ("category_id",) if c in table.columns],
            )
            for name, table in left.tables().items()
        ]
    )


def _seed(ledger: Ledger) -> DataFrame:
    users = ledger.profiles.select(F.col("id").alias("user_id"))
    shape = ledger.categories.withColumn("id", F.col("id").cast("string"))
    return changes.seed_default_categories(users, shape)


def _signups(spark: SparkSession, sf_dir: str) -> tuple[Ledger, DataFrame]:
    """All customers sign up; those with a negative balance are known already."""
    customer = read_table(spark, sf_dir, "customer")
    ledger = load_ledger(spark, sf_dir)
    ledger = ledger.with_tables(categories=ledger.categories.withColumn("id", F.col("id").cast("string")))
    known = ledger.with_tables(profiles=ledger.profiles.where(F.col("initial_balance") < 0))
    signups = customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("email"),
        F.when(
            F.col("c_nationkey") > 4, F.to_json(F.struct(F.col("c_name").alias("name")))
        ).otherwise("{}").alias("metadata"),
    )
    return known, signups


def _onboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, signups = _signups(spark, sf_dir)
    return _profiles_and_categories(changes.onboard_users(known, signups))


def _onboard_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sign-ups arrive in several batches, a third of them again in a later one."""
    known, signups = _signups(spark, sf_dir)
    store = _scratch(spark, "signups")
    signups.repartition(3, "id").write.parquet(f"{store}/arriving")
    signups.where("id % 3 = 0").coalesce(1).write.mode("append").parquet(f"{store}/arriving")
    stream = spark.readStream.schema(signups.schema).option("maxFilesPerTrigger", 1).parquet(f"{store}/arriving")
    _to_its_end(onboarding.start_onboarding(known, stream, f"{store}/new", f"{store}/checkpoint", availableNow=True))
    return _profiles_and_categories(onboarding.read_onboarded(known, f"{store}/new"))


def _profiles_and_categories(result: Ledger) -> DataFrame:
    profiles = result.profiles.select(
        F.col("id").cast("string").alias("id"),
        F.col("id").alias("user_id"),
        F.lit("profile").alias("row_kind"),
        "name",
        F.col("email").alias("detail"),
        F.col("currency").alias("label"),
        F.col("initial_balance").cast("string").alias("value"),
    )
    categories = result.categories.select(
        "id",
        "user_id",
        F.lit("category").alias("row_kind"),
        "name",
        F.col("type").alias("detail"),
        F.col("icon").alias("label"),
        F.col("color").alias("value"),
    )
    return profiles.unionByName(categories)


def _balance_requests(customer: DataFrame) -> DataFrame:
    balance = F.col("c_acctbal").cast(AMOUNT) + F.lit(100).cast(AMOUNT)
    return customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "a lot")
        .when(F.col("c_mktsegment") != "MACHINERY", balance.cast("string"))
        .alias("initial_balance"),
    )


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balances after the requests, and what was rejected why."""
    requests = _balance_requests(read_table(spark, sf_dir, "customer"))
    profiles, rejected = changes.update_initial_balances(
        load_ledger(spark, sf_dir).profiles, requests
    )
    return profiles.select(
        "id", "initial_balance", F.lit(None).cast("string").alias("error")
    ).unionByName(rejected.select("id", F.lit(None).cast(AMOUNT).alias("initial_balance"), "error"))


def _insert_goals(ledger: Ledger) -> DataFrame:
    """A second goal for everyone, leaving amount saved and status to defaults."""
    goals = ledger.financial_goals
    new = goals.select(
        (-F.col("id")).alias("id"),
        "user_id",
        F.lit("Rainy days").alias("name"),
        "target_amount",
        F.when(F.col("current_amount") > 5000, F.col("current_amount")).alias("current_amount"),
    )
    return changes.insert_with_defaults(goals, new, changes.INSERT_DEFAULTS["financial_goals"])


def _other_updates(ledger: Ledger) -> DataFrame:
    """M2 on the other tables: profiles (blank leaves the old value, a balance of 0 counts),
    goals, categories and schedules, each by its own batch."""
    profiles = changes.update_profiles(
        ledger.profiles,
        ledger.profiles.select(
            "id",
            F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "renamed").alias("name"),
            F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("initial_balance")).cast(AMOUNT).alias("initial_balance"),
        ),
    )
    goals = changes.apply_updates(
        ledger.financial_goals,
        ledger.financial_goals.where(F.col("id") % 5 == 0).select(
            "id", "user_id", F.lit("cancelled").alias("status"), F.lit(None).cast("date").alias("deadline")
        ),
    )
    schedules = [
        changes.apply_updates(
            getattr(ledger, t),
            getattr(ledger, t).where(F.col("id") % 4 == 0).select(
                "id", "user_id", F.lit(False).alias("is_active"), F.lit("paused").alias("note")
            ),
        )
        for t in SCHEDULES
    ]
    return _union(
        [
            profiles.select(
                F.lit("profiles").alias("table_name"), "id", "name", F.col("initial_balance").cast("string").alias("value")
            ),
            goals.select(
                F.lit("financial_goals").alias("table_name"), "id", F.col("status").alias("name"),
                F.col("deadline").cast("string").alias("value"),
            ),
            *[
                s.select(
                    F.lit(t).alias("table_name"), "id", F.col("note").alias("name"),
                    F.col("is_active").cast("string").alias("value"),
                )
                for t, s in zip(SCHEDULES, schedules, strict=True)
            ],
        ]
    )


def _insert_valid_schedules(ledger: Ledger) -> DataFrame:
    """Raw costs are validated, typed and added under new ids; is_active has a default."""
    raw = _raw_schedules(ledger.fixed_costs).withColumn("user_id", F.lit(1))
    valid, _ = quality.split(quality.validate_schedules(raw))
    new = quality.typed_schedules(valid).select(
        (-F.col("id").cast("bigint")).alias("id"), "user_id", "amount", "frequency", "start_date", "end_date", "note", "is_active"
    )
    table = ledger.fixed_costs.select("id", "user_id", "amount", "frequency", "start_date", "end_date", "note", "is_active")
    return changes.insert_with_defaults(table, new, changes.INSERT_DEFAULTS["fixed_costs"])


# --- changes to a stored ledger, year by year ------------------------------


def _moves_and_relabels(transactions: DataFrame) -> DataFrame:
    """Every eleventh row moves a year on, every seventh gets the next user's category."""
    key = F.col("id")
    moves, relabels = key % 11 == 0, key % 7 == 0
    return transactions.where(moves | relabels).select(
        "id", "user_id", F.add_months("date", 12).alias("date"),
        ((F.col("user_id") + 1) * 100 + 11).alias("category_id"),
        F.filter(
            F.array(F.when(moves, "date"), F.when(relabels, "category_id")), lambda c: c.isNotNull()
        ).alias("set_fields"),
    )


def _changed_in_place(spark: SparkSession, sf_dir: str) -> Ledger:
    """A stored ledger with its rollup, after new rows, updates of dates and categories,
    and the deletion of some users, each rewriting the years it touches."""
    root = _scratch(spark, "ledger")
    ledger = load_ledger(spark, sf_dir)
    ids = ledger.transactions.schema["id"].dataType
    write_ledger(ledger, root)
    write_rollup(ledger, root)
    users = _segment_users(spark, sf_dir, "HOUSEHOLD")
    for make in (
        # Ids are unique: order 0 has no negative.
        lambda book: upkeep.inserted(book.transactions, _new_rows(book).where("id <> 0"), AS_OF),
        lambda book: upkeep.updated(book.transactions, _moves_and_relabels(book.transactions)),
        lambda book: stored_upkeep.cascade(book, users),
    ):
        stored_upkeep.change_stored(spark, root, make, ids)
    return read_ledger(spark, root, ids, rollup=True)


def _rollup_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = _changed_in_place(spark, sf_dir).monthly_activity
    return rollup.select("user_id", "category_id", "type", "date", "amount", "n", "last_date")


def _transactions_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _changed_in_place(spark, sf_dir).transactions
    return rows.select("id", "user_id", "category_id", "amount", "date", "type")


def _balance_after_backdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of a ledger in which every nineteenth row was entered late, and then was."""
    ledger = load_ledger(spark, sf_dir)
    late = ledger.transactions.where(F.col("id") % 19 == 0)
    early = ledger.transactions.where(F.col("id") % 19 != 0)
    change = upkeep.RowChange(late.where(F.lit(False)), late)
    kept = balance.after(balance.balance_of(early), change, ledger.transactions)
    return balance.report(kept, ledger.profiles)


def _report_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.annual_report(_changed_in_place(spark, sf_dir), YEAR, AS_OF)


# --- refused rows ----------------------------------------------------------


def _gate(ledger: Ledger) -> DataFrame:
    """New rows of which many break rules: stored and repeated ids, unknown users and
    categories, wrong types, missing and too large amounts."""
    key = F.col("id")
    rows = ledger.transactions.where(key % 5 == 0)
    rows = rows.unionByName(rows.where(key % 35 == 0)).select(
        F.when(key % 3 == 0, key).otherwise(-key).alias("id"),
        F.when(key % 25 == 0, key + 1_000_000_000).otherwise(F.col("user_id")).alias("user_id"),
        F.when(key % 4 == 0, -F.col("category_id")).otherwise(F.col("category_id")).alias("category_id"),
        F.when(key % 11 == 0, F.col("amount").cast(T.DecimalType(18, 2)) * 1000000)
        .when(key % 7 != 0, F.col("amount")).alias("amount"),
        "note",
        "date",
        F.when(key % 6 == 0, "gift").otherwise(F.col("type")).alias("type"),
    )
    accepted, refused = gate.gate(ledger, "transactions", rows)
    shown = ("id", "user_id", "category_id", "amount")
    return accepted.select(*shown, F.lit("").alias("broken_rules")).unionByName(
        refused.select(*shown, F.array_join("broken_rules", "; ").alias("broken_rules"))
    )


def _scoped_changes(ledger: Ledger) -> DataFrame:
    """Inserts, updates and deletes in users' names, some of them of others' rows and
    some that would give a row away: what is left, and what was refused why."""
    key, owner = F.col("id"), F.col("user_id")

    def asked_by(stranger: Column) -> Column:
        return F.when(stranger, owner + 1).otherwise(owner).alias("actor_id")

    rows = ledger.transactions
    new = _new_rows(ledger).where("id <> 0").withColumn("actor_id", asked_by(key % 34 == 0))
    edits = rows.where(key % 11 == 0).select(
        "id", F.lit("seen").alias("note"), asked_by(key % 33 == 0),
        F.when(key % 22 == 0, owner + 5).otherwise(owner).alias("new_owner"),
        F.when(key % 33 == 0, F.array(F.lit("note"))).otherwise(F.array(F.lit("note"), F.lit("new_owner"))).alias("set_fields"),
    )
    gone = rows.where(key % 13 == 0).select("id", asked_by(key % 39 == 0))
    left, refused_new = policies.insert_as(ledger, "transactions", new, {"date": F.lit(AS_OF)})
    left, refused_edits = policies.update_as(ledger.with_tables(transactions=left), "transactions", edits)
    left, refused_gone = policies.delete_as(ledger.with_tables(transactions=left), "transactions", gone)
    refused = [
        r.select(F.lit(action).alias("what"), "id", F.col("actor_id").alias("user_id"), F.col("reason").alias("detail"))
        for action, r in (("insert", refused_new), ("update", refused_edits), ("delete", refused_gone))
    ]
    return _union([left.select(F.lit("row").alias("what"), "id", "user_id", F.col("note").alias("detail")), *refused])


# --- reports from SQL ------------------------------------------------------


def _sql_report(name: str, arguments: str = "") -> Query:
    """A report as a table function, called for every profile in LATERAL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_reports(load_ledger(spark, sf_dir), "book_")
        testbed.user_ids(spark, sf_dir).createOrReplaceTempView("book_user_ids")
        given = ", ".join(a for a in ("p.id", arguments) if a)
        return spark.sql(f"SELECT p.id AS user_id, r.* FROM book_user_ids p, LATERAL book_{name}({given}) r")

    return query


def _sql_category_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_reports(load_ledger(spark, sf_dir), "book_")
    return spark.sql(
        "SELECT c.user_id, c.id AS category_id, r.* FROM book_categories c,"
        f" LATERAL book_category_trend(c.user_id, 2001, DATE'{AS_OF}', c.id) r"
    )


def _sql_top_recent_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sql_report("top_categories_recent_years")(spark, sf_dir)
    return rows.select("user_id", "year", F.posexplode_outer("categories")).select(
        "user_id", "year", F.col("pos").alias("position"), "col.*"
    )


# --- quality ---------------------------------------------------------------


def _uuid_text(number: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def _raw_transactions(ledger: Ledger) -> DataFrame:
    """Transactions as text, four ninths of them with one defect each."""
    defect = F.col("id") % 9
    return ledger.transactions.select(
        F.col("id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(defect == 1, "abc").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(defect == 2, "gift").otherwise(F.col("type")).alias("type"),
        F.when(defect == 3, "2001-13-01").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(defect == 4, "")
        .otherwise(F.coalesce(_uuid_text(F.col("category_id")), _uuid_text(F.lit(0))))
        .alias("category_id"),
        "note",
    )


def _raw_goals(ledger: Ledger) -> DataFrame:
    defect = F.col("id") % 9
    return ledger.financial_goals.select(
        F.col("id").cast("string").alias("id"),
        F.when(defect == 1, "").otherwise(F.col("user_id").cast("string")).alias("user_id"),
        F.when(defect == 2, "").otherwise(F.concat(F.lit("\t \u00a0"), F.col("name"), F.lit("\n"))).alias("name"),
        F.when(defect == 3, "0.00").otherwise(F.col("target_amount").cast("string")).alias("target_amount"),
        F.when(defect == 4, "-1")
        .when(defect != 5, F.col("current_amount").cast("string"))
        .alias("current_amount"),
        F.when(defect == 6, "next May").otherwise(F.col("deadline").cast("string")).alias("deadline"),
        F.when(defect == 7, "paused").otherwise(F.col("status")).alias("status"),
    )


def _raw_schedules(schedules: DataFrame) -> DataFrame:
    defect = F.col("id") % 9
    raw = schedules.select(
        F.col("id").cast("string").alias("id"),
        F.when(defect == 1, "0").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(defect == 2, "hourly")
        .when(F.col("frequency") == "annually", "yearly")
        .otherwise(F.col("frequency"))
        .alias("frequency"),
        F.when(defect == 3, "1999-02-30").otherwise(F.col("start_date").cast("string")).alias("start_date"),
        F.when(defect == 4, " 2001-1-5").otherwise(F.col("end_date").cast("string")).alias("end_date"),
        F.when(defect == 5, "none").when(defect != 6, _uuid_text(F.col("category_id"))).alias("category_id"),
        F.when(defect == 7, "maybe").otherwise(F.col("is_active").cast("string")).alias("is_active"),
        F.when(defect == 8, " \trent\n ").alias("note"),
        *[c for c in ("expected_return_rate", "investment_type") if c in schedules.columns],
    )
    if "investment_type" in raw.columns:
        rate = F.col("expected_return_rate")
        key = F.col("id").cast("bigint")
        raw = raw.withColumn(
            "expected_return_rate",
            F.when(key % 10 == 1, "1000").when(key % 10 == 2, "-101").otherwise(rate.cast("string")),
        ).withColumn("investment_type", F.when(key % 10 != 3, F.col("investment_type")))
    return raw


def _verdicts(checked: DataFrame, *shown: str) -> DataFrame:
    fields = F.transform(quality.ERRORS, lambda e: e["field"])
    return checked.select(
        "id",
        *shown,
        (F.size(quality.ERRORS) == 0).alias("is_valid"),
        F.array_join(fields, ",").alias("error_fields"),
        F.array_join(F.transform(quality.ERRORS, lambda e: e["msg"]), "; ").alias("messages"),
    )


def _validate_transactions(ledger: Ledger) -> DataFrame:
    return _verdicts(quality.validate_transactions(_raw_transactions(ledger)))


def _validate_goals(ledger: Ledger) -> DataFrame:
    return _verdicts(quality.validate_goals(_raw_goals(ledger)), "name")


def _validate_schedules(ledger: Ledger) -> DataFrame:
    both = _raw_schedules(ledger.fixed_costs).unionByName(_raw_schedules(ledger.periodic_income))
    return _verdicts(quality.validate_schedules(both), "note")


def _validate_investments(ledger: Ledger) -> DataFrame:
    raw = _raw_schedules(ledger.fixed_investments)
    return _verdicts(quality.validate_investments(raw), "investment_type")


def _typed_goals(ledger: Ledger) -> DataFrame:
    """The goals that pass, with their values in their types."""
    valid, _ = quality.split(quality.validate_goals(_raw_goals(ledger)))
    return quality.typed_goals(valid).select(
        "id", "user_id", "name", "target_amount", "current_amount", "deadline", "status"
    )


def _typed_investments(ledger: Ledger) -> DataFrame:
    valid, _ = quality.split(quality.validate_investments(_raw_schedules(ledger.fixed_investments)))
    return quality.typed_schedules(valid).select(
        "id", "amount", "frequency", "start_date", "end_date", "category_id", "is_active", "note",
        "expected_return_rate", "investment_type",
    )


def _check_constraints(ledger: Ledger) -> DataFrame:
    """A damaged ledger: profiles in the red and 'Misc' categories are gone,
    some transactions are stored twice, some types and amounts are wrong."""
    rows = ledger.transactions.select(
        "id",
        "user_id",
        "category_id",
        F.when(F.col("id") % 19 == 2, F.col("amount").cast(T.DecimalType(18, 2)) * 1000000)
        .when(F.col("id") % 19 != 1, F.col("amount"))
        .alias("amount"),
        "note",
        "date",
        F.when(F.col("id") % 9 == 2, "gift").otherwise(F.col("type")).alias("type"),
        "created_at",
    )
    repeated = rows.where(F.col("id") % 17 == 0)
    damaged = ledger.with_tables(
        profiles=ledger.profiles.where(F.col("initial_balance") >= 0),
        categories=ledger.categories.where(F.col("name") != "Misc"),
        transactions=rows.unionByName(repeated),
    )
    return quality.check_constraints(damaged)


# --- streaming -------------------------------------------------------------


def _to_its_end(query: StreamingQuery) -> None:
    query.awaitTermination(STREAM_SECONDS)
    if query.isActive:
        query.stop()
        raise TimeoutError(f"the stream took more than {STREAM_SECONDS} seconds")


def _refresh(spark: SparkSession, sf_dir: str, again: bool) -> DataFrame:
    """The orders, stored as a directory of parts, as a stream of several batches that
    are condensed one by one and folded in between, then read back.

    The stream runs to its end while the plan is made.
    """
    store = _scratch(spark, "monthly-totals")
    orders = read_table(spark, sf_dir, "orders")
    orders.repartition(5, "o_orderkey").write.parquet(f"{store}/orders.parquet")
    if again:
        repeated = orders.where("o_orderkey % 3 = 0")
        repeated.union(repeated).repartition(2).write.mode("append").parquet(f"{store}/orders.parquet")
    arriving = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1)
    stream = testbed.transactions(arriving.parquet(f"{store}/orders.parquet"))
    _to_its_end(refresh.start_refresh(
        stream, f"{store}/totals", f"{store}/checkpoint", fold_every=2, keep=1, once=again, availableNow=True
    ))
    return refresh.monthly_totals(refresh.read_activity(spark, f"{store}/totals"))


def _refresh_monthly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refresh(spark, sf_dir, again=False)


def _refresh_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the orders is delivered three times, across batches and within one."""
    return _refresh(spark, sf_dir, again=True)


def _monthly_totals(ledger: Ledger) -> DataFrame:
    return refresh.monthly_totals(activity(ledger))


QUERIES: dict[str, Query] = {
    # reports
    "monthly_calendar": _on_ledger(reports.monthly_calendar, YEAR, MONTH),
    "monthly_report": _on_ledger(reports.monthly_report, YEAR, MONTH),
    "category_trend": _on_ledger(reports.category_trend, 2001, AS_OF),
    "category_trend_full_year": _on_ledger(reports.category_trend, YEAR, AS_OF),
    "annual_report": _on_ledger(reports.annual_report, 2001, AS_OF),
    "annual_report_full_year": _on_ledger(_annual_report_full),
    "annual_trend": _on_ledger(reports.annual_trend, YEAR),
    "annual_categories": _on_ledger(reports.annual_categories, YEAR),
    "all_time_balance": _on_ledger(reports.all_time_balance),
    "all_time_categories": _on_ledger(reports.all_time_categories),
    "top_categories_all_time": _on_ledger(reports.top_categories_all_time),
    "recent_years_summary": _on_ledger(reports.recent_years_summary),
    "top_categories_recent_years": _on_ledger(_top_recent_years),
    "yearly_trends": _on_ledger(reports.yearly_trends),
    "yearly_trends_expense": _on_ledger(reports.yearly_trends, "expense"),
    "category_breakdown": _on_ledger(reports.category_breakdown, YEAR, MONTH),
    "all_time_totals": _on_ledger(reports.all_time_totals),
    "monthly_summary_nested": _on_ledger(_monthly_summary),
    # recurring schedules
    "expand_fixed_costs": _expansion("fixed_costs"),
    "expand_periodic_income": _expansion("periodic_income"),
    "expand_fixed_investments": _expansion("fixed_investments"),
    "expand_all_schedules": _expansion(None),
    "expand_all_schedules_anchored": _expansion(None, "anchored"),
    "advance_schedules": _on_ledger(_advance),
    "run_due_schedules": _due_runs,
    # listings
    "list_transactions": _on_ledger(_list_transactions),
    "list_transactions_by_date": _on_ledger(_list_transactions_by_date),
    "lookup_by_key": _lookup,
    "list_categories": _on_ledger(listings.list_categories, "expense"),
    "list_all_categories": _on_ledger(listings.list_categories),
    "list_goals": _on_ledger(listings.list_goals),
    "list_schedules": _on_ledger(_list_schedules),
    "get_profiles": _profiles,
    "scope_to_user": _scope,
    # changes
    "append_transactions": _on_ledger(_append),
    "apply_updates": _on_ledger(_update),
    "apply_deletes": _on_ledger(_delete),
    "category_changes_guarded": _on_ledger(_guarded),
    "delete_categories_set_null": _on_ledger(_set_null),
    "delete_profiles_cascade": _cascade,
    "seed_default_categories": _on_ledger(_seed),
    "onboard_users": _onboard,
    "update_initial_balances": _balances,
    "insert_with_defaults": _on_ledger(_insert_goals),
    "update_other_tables": _on_ledger(_other_updates),
    "insert_valid_schedules": _on_ledger(_insert_valid_schedules),
    # changes on a stored ledger, then reports of it
    "append_then_annual_report": _on_stored(_append_then_report),
    "update_date_then_annual_report": _on_stored(_update_date_then_report),
    "run_schedules_then_report": _run_then_report,
    "all_time_balance_stored": _on_stored(reports.all_time_balance),
    "all_time_balance_rollup": _on_stored(reports.all_time_balance, rollup=True),
    "top_categories_rollup": _on_stored(reports.top_categories_all_time, rollup=True),
    "rollup_after_changes": _rollup_after_changes,
    "transactions_after_changes": _transactions_after_changes,
    "annual_report_after_changes": _report_after_changes,
    "balance_after_backdated": _balance_after_backdated,
    # refused rows
    "gate_new_transactions": _on_ledger(_gate),
    "scoped_changes": _on_ledger(_scoped_changes),
    # reports from SQL
    "sql_monthly_calendar": _sql_report("monthly_calendar", f"{YEAR}, {MONTH}"),
    "sql_monthly_report": _sql_report("monthly_report", f"{YEAR}, {MONTH}"),
    "sql_category_trend": _sql_category_trend,
    "sql_annual_report": _sql_report("annual_report", f"2001, DATE'{AS_OF}'"),
    "sql_annual_trend": _sql_report("annual_trend", str(YEAR)),
    "sql_annual_categories": _sql_report("annual_categories", str(YEAR)),
    "sql_all_time_balance": _sql_report("all_time_balance"),
    "sql_all_time_categories": _sql_report("all_time_categories"),
    "sql_top_categories_all_time": _sql_report("top_categories_all_time"),
    "sql_recent_years_summary": _sql_report("recent_years_summary"),
    "sql_top_categories_recent_years": _sql_top_recent_years,
    # quality
    "validate_transactions": _on_ledger(_validate_transactions),
    "validate_goals": _on_ledger(_validate_goals),
    "validate_schedules": _on_ledger(_validate_schedules),
    "validate_investments": _on_ledger(_validate_investments),
    "typed_goals": _on_ledger(_typed_goals),
    "typed_investments": _on_ledger(_typed_investments),
    "check_constraints": _on_ledger(_check_constraints),
    "warn_inconsistencies": _on_ledger(quality.warn_inconsistencies),
    # kept up to date
    "refresh_monthly_totals": _refresh_monthly_totals,
    "refresh_redelivered": _refresh_redelivered,
    "onboard_stream": _onboard_stream,
    "monthly_totals": _on_ledger(_monthly_totals),
}
