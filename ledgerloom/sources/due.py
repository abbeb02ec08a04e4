"""Schedules filed by the day they are next due, so that a daily run reads those alone.

A run reads the schedules that came due since the run before, records their dates as
transactions, and files each again under its next due date, which a closed form gives.
All others are neither read nor written.  Run after run this gives the transactions of
``recurring.run_schedules`` with the same days (mode ``anchored``).

A store is (root)/(folder)/(table)/batch=N/week=DATE/, and a log with one entry per
batch; weeks start on Mondays and are sorted by due date inside, so a run reads a week's
files and of them the row groups of its days.  A filed schedule is current until a run covers its date; then the run's own batch holds
it under a later one.  Nothing is deleted or overwritten but a batch that is written
again: a broken-off run has no entry in the log, and running it again replaces what it
left.  Changed schedules are filed anew under a higher edition, which hides what was
filed before.  One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.model import SCHEDULES, Ledger
from ledgerloom.operators import recurring

_LOG = "batch long, kind string, day date, folder string"
_EDITIONS = "id string, edition long"
FILED, RUN, CHANGED = "filed", "run", "changed"


@dataclass(frozen=True)
class _State:
    """The last batch, the day that runs have covered, and the folder in use."""

    batch: int
    day: date
    folder: str


def _log(spark: SparkSession, root: str) -> list[Row]:
    try:
        entries = spark.read.schema(_LOG).parquet(f"{root}/log")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    # The last entry of each kind tells all; one a day is added.
    latest = entries.groupBy("kind").agg(F.max(F.struct("batch", "day", "folder")).alias("e"))
    return [r["e"] for r in latest.collect()]


def _state(spark: SparkSession, root: str) -> _State:
    entries = _log(spark, root)
    if not entries:
        raise ValueError(f"nothing is filed in {root}")
    last = max(entries, key=lambda e: e["batch"])
    return _State(last["batch"], max(e["day"] for e in entries), last["folder"])


def _note(spark: SparkSession, root: str, kind: str, state: _State) -> None:
    entry = [(state.batch, kind, state.day, state.folder)]
    spark.createDataFrame(entry, _LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")


def _schema(table: DataFrame) -> T.StructType:
    own = [T.StructField(f.name, f.dataType, True) for f in table.schema]
    return T.StructType([*own, T.StructField("edition", T.LongType()), T.StructField("due", T.DateType()),
                         T.StructField("batch", T.LongType()), T.StructField("week", T.DateType())])


def _file(schedules: DataFrame, edition: int | None, after: date, path: str, batch: int) -> None:
    """Writes active schedules under their next due dates, none before ``after`` has passed."""
    rows = recurring.with_steps(schedules.where("is_active"))
    due = recurring.next_due(F.col("last_generated_date"))
    # What is overdue already (a schedule made active again) is for the next run.
    due = F.when(due <= F.lit(after), F.date_add(F.lit(after), 1)).otherwise(due)
    rows = rows.withColumn("due", due).where("due IS NOT NULL").drop("day_step", "month_step")
    if edition is not None:
        rows = rows.withColumn("edition", F.lit(edition).cast("long"))
    _write(rows, f"{path}/batch={batch}")


def _write(rows: DataFrame, path: str) -> None:
    """By due date and id: a week is in few files, and one of many schedules in several."""
    weekly = rows.withColumn("week", F.trunc("due", "week").cast("date"))
    ordered = weekly.repartitionByRange("due", "id").sortWithinPartitions("week", "due", "id")
    ordered.write.mode("overwrite").partitionBy("week").parquet(path)


def file_schedules(ledger: Ledger, root: str, as_of: date) -> None:
    """Files all schedules; runs start on the day after ``as_of``."""
    spark = ledger.profiles.sparkSession
    if _log(spark, root):
        raise ValueError(f"there are schedules filed in {root} already")
    state = _State(0, as_of, f"{root}/first")
    for table in SCHEDULES:
        _file(getattr(ledger, table), 0, as_of, f"{state.folder}/{table}", 0)
    _note(spark, root, FILED, state)


def _editions(spark: SparkSession, folder: str, table: str, batch: int) -> DataFrame | None:
    try:
        rows = spark.read.schema(_EDITIONS + ", batch long").parquet(f"{folder}/{table}-editions")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return rows.where(F.col("batch") <= batch).groupBy("id").agg(F.max("edition").alias("newest"))


def _current(ledger: Ledger, table: str, state: _State, until: date | None) -> DataFrame:
    """Filed schedules that no run has covered, of the newest edition, due up to ``until``."""
    spark, schema = ledger.profiles.sparkSession, _schema(getattr(ledger, table))
    rows = spark.read.schema(schema).parquet(f"{state.folder}/{table}")
    monday = lambda day: day - timedelta(days=day.weekday())
    rows = rows.where((F.col("due") > F.lit(state.day)) & (F.col("batch") <= state.batch))
    rows = rows.where(F.col("week") >= F.lit(monday(state.day)))
    if until is not None:
        rows = rows.where((F.col("due") <= F.lit(until)) & (F.col("week") <= F.lit(monday(until))))
    rows = rows.drop("week")
    newest = _editions(spark, state.folder, table, state.batch)
    if newest is not None:
        newest = newest.select(F.col("id").alias("_id"), "newest")
        rows = rows.join(newest, F.col("id").cast("string") == F.col("_id"), "left")
        rows = rows.where(F.col("edition") >= F.coalesce("newest", F.lit(0))).drop("_id", "newest")
    return rows


def due_schedules(ledger: Ledger, root: str, as_of: date) -> Ledger:
    """``ledger`` with the schedules that a run on ``as_of`` has to look at, and no others."""
    state = _state(ledger.profiles.sparkSession, root)
    tables = {t: _current(ledger, t, state, as_of) for t in SCHEDULES}
    return replace(ledger, **{t: rows.select(*getattr(ledger, t).columns) for t, rows in tables.items()})


def run_due(ledger: Ledger, root: str, as_of: date, path: str) -> DataFrame:
    """Records everything due since the last run; returns it as stored in ``path``.

    ``ledger`` gives the shape of the tables; its schedules aren't read.  Transactions
    go to (path)/run=DAY, which a repeated run overwrites.  A day that runs have covered
    raises.
    """
    spark = ledger.profiles.sparkSession
    state = _state(spark, root)
    if as_of <= state.day:
        raise ValueError(f"runs have covered the days up to {state.day}")
    found = replace(ledger, **{t: _current(ledger, t, state, as_of) for t in SCHEDULES})
    recorded = recurring.expand_all_schedules(found, as_of, "anchored")
    out = f"{path}/run={as_of}"
    recorded.write.mode("overwrite").parquet(out)
    after = _State(state.batch + 1, as_of, state.folder)
    for table in SCHEDULES:
        moved = getattr(found, table).where(recurring.eligible(as_of)).drop("batch", "due")
        moved = moved.withColumn("last_generated_date", F.lit(as_of))
        _file(moved, None, as_of, f"{state.folder}/{table}", after.batch)
    _note(spark, root, RUN, after)
    return spark.read.schema(recorded.schema).parquet(out)


def refile(ledger: Ledger, root: str, table: str, schedules: DataFrame) -> None:
    """Files new or changed schedules (whole rows); what was filed under their ids no longer counts.

    A row that isn't active is taken out.  ``last_generated_date`` says from where a
    schedule goes on; what it has missed comes with the next run.
    """
    spark = ledger.profiles.sparkSession
    state = _state(spark, root)
    batch = state.batch + 1
    rows = schedules.select(*getattr(ledger, table).columns)
    ids = rows.select(F.col("id").cast("string").alias("id"), F.lit(batch).cast("long").alias("edition")).distinct()
    ids.write.mode("overwrite").parquet(f"{state.folder}/{table}-editions/batch={batch}")
    _file(rows, batch, state.day, f"{state.folder}/{table}", batch)
    _note(spark, root, CHANGED, _State(batch, state.day, state.folder))


def compact(ledger: Ledger, root: str) -> None:
    """Copies what is current to a folder of its own, where later runs go on; old folders
    can be cleared once no reader has them open."""
    spark = ledger.profiles.sparkSession
    state = _state(spark, root)
    after = _State(state.batch + 1, state.day, f"{root}/folder-{state.batch + 1}")
    for table in SCHEDULES:
        rows = _current(ledger, table, state, None).drop("batch").withColumn("edition", F.lit(0).cast("long"))
        _write(rows, f"{after.folder}/{table}/batch={after.batch}")
    _note(spark, root, FILED, after)


def read_runs(spark: SparkSession, path: str, days: list[date], like: DataFrame) -> DataFrame:
    """Transactions of several runs."""
    return reduce(DataFrame.unionByName, [spark.read.schema(like.schema).parquet(f"{path}/run={d}") for d in days])
