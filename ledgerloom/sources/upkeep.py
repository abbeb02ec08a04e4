"""Changes to a stored ledger that rewrite only the years they touch.

A change goes in steps, each of which can be done again:

1. what it takes away and adds is worked out and written to a folder of its own;
2. the years touched are found from that, and their new rows (and the new rows of the
   rollup, and other tables the change replaces) are written to that folder, as they are
   to lie in the ledger: one folder per year, without rows too;
3. the log of versions says that this folder is to be moved in;
4. the touched years' folders are renamed into the ledger, in place of the old ones; all
   other files stay;
5. the log says that it is done.

Before step 3 a crash leaves the ledger as it was.  After it, ``read_ledger`` refuses
the ledger until ``finish_changes`` has done the rest from the folder.  One writer at
a time; readers that opened the ledger before step 4 have to open it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.periods import YEAR_PARTITION
from ledgerloom.model import Ledger
from ledgerloom.operators import changes
from ledgerloom.plans import upkeep
from ledgerloom.plans.upkeep import RowChange
from ledgerloom.sources.parquet import (
    CLUSTERS,
    DONE,
    ROLLUP,
    VERSION,
    _write_by_year,
    append_version,
    read_ledger,
    read_version,
    stored_schema,
    write_table,
)

PENDING = "pending"


@dataclass(frozen=True)
class StoredChange:
    """What a change does to the transactions, and the other tables it replaces whole."""

    transactions: RowChange | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


def cascade(ledger: Ledger, users: DataFrame) -> StoredChange:
    """M6 on a stored ledger: ``users`` and all they own go; other users' rows lose
    references to categories that went."""
    left = changes.delete_profiles_cascade(ledger, users)
    owners = users.select("user_id").distinct()
    gone = ledger.categories.join(owners, "user_id", "left_semi").select("id")
    others = ledger.transactions.join(owners, "user_id", "left_anti").select(*ledger.transactions.columns)
    rows = upkeep.owned(ledger.transactions, owners).then(upkeep.detached(others, gone))
    return StoredChange(rows, {n: t for n, t in left.tables().items() if n != "transactions"})


def change_stored(
    spark: SparkSession,
    root: str,
    make: Callable[[Ledger], StoredChange | RowChange],
    id_type: T.DataType | None = None,
) -> list[int]:
    """Makes a change to the ledger in ``root``; returns the years that were rewritten.

    ``make`` gets the stored ledger and returns the change.  A rollup that is up to
    date is kept so; a stale or missing one is left as it is.
    """
    finish_changes(spark, root, id_type)
    entry = read_version(spark, f"{root}/{VERSION}")
    rolled = read_version(spark, f"{root}/{ROLLUP}_{VERSION}")
    keep_rollup = rolled is not None and rolled["state"] == DONE and rolled["version"] == entry["version"]
    ledger = read_ledger(spark, root, id_type, rollup=keep_rollup)
    made = make(ledger)
    if isinstance(made, RowChange):
        made = StoredChange(made)
    folder = f"{root}/changes/{uuid.uuid4().hex}"
    tables, years = list(made.tables), []
    for name, table in made.tables.items():
        write_table(name, table, f"{folder}/{name}")
    if made.transactions is not None:
        change = _staged_change(spark, made.transactions, folder)
        # A row per calendar year, whatever the size of the change.
        years = sorted(r[0] for r in upkeep.touched_years(change).collect() if r[0] is not None)
        in_years = F.col(YEAR_PARTITION).isin(years)
        rows = upkeep.after(ledger.transactions.where(in_years), change)
        _stage_years(spark, f"{folder}/transactions", rows, "transactions", years)
        tables.append("transactions")
        if keep_rollup:
            written = _read(spark, f"{folder}/transactions", "transactions", id_type)
            rollup = upkeep.rollup_after(ledger.monthly_activity.where(in_years), change, written)
            _stage_years(spark, f"{folder}/{ROLLUP}", rollup, ROLLUP, years)
            tables.append(ROLLUP)
    append_version(spark, f"{root}/{VERSION}", PENDING, folder=folder, years=years, tables=tables)
    finish_changes(spark, root, id_type)
    return years


def _staged_change(spark: SparkSession, change: RowChange, folder: str) -> RowChange:
    """The change as written: ids drawn for it stay what they are."""
    sides = {}
    for name in ("removed", "added"):
        rows = getattr(change, name)
        rows.write.parquet(f"{folder}/{name}")
        sides[name] = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
    return RowChange(**sides)


def _read(spark: SparkSession, path: str, name: str, id_type: T.DataType | None) -> DataFrame:
    return spark.read.schema(stored_schema(name, id_type)).parquet(path)


def finish_changes(spark: SparkSession, root: str, id_type: T.DataType | None = None) -> bool:
    """Moves in what a broken-off change had ready; returns whether there was anything."""
    entry = read_version(spark, f"{root}/{VERSION}")
    if entry is None or entry["state"] != PENDING:
        return False
    tables = entry["tables"]
    for name in tables:
        if name in CLUSTERS:
            _replace_years(spark, f"{root}/{name}", f"{entry['folder']}/{name}")
        else:
            _replace(spark, f"{root}/{name}", f"{entry['folder']}/{name}")
    if ROLLUP in tables:
        append_version(spark, f"{root}/{ROLLUP}_{VERSION}", DONE, entry["version"])
    append_version(spark, f"{root}/{VERSION}", DONE, entry["version"])
    return True


def _stage_years(spark: SparkSession, path: str, rows: DataFrame, name: str, years: list[int]) -> None:
    """Writes the new rows of ``years`` to ``path``; a year that has none left gets an empty file."""
    _write_by_year(rows.drop(YEAR_PARTITION), path, CLUSTERS[name])
    fields = [f for f in rows.schema if f.name != YEAR_PARTITION]
    nothing = spark.createDataFrame([], T.StructType(fields))
    for year in years:
        folder = f"{path}/{YEAR_PARTITION}={year}"
        if not _files(spark, folder).exists(_path(spark, folder)):
            nothing.write.parquet(folder)


def _replace_years(spark: SparkSession, path: str, staged: str) -> None:
    """Moves the years in ``staged`` to ``path``; those moved before are no longer there."""
    files = _files(spark, staged)
    for found in files.listStatus(_path(spark, staged)):
        year = found.getPath().getName()
        if year.startswith(f"{YEAR_PARTITION}="):
            _replace(spark, f"{path}/{year}", f"{staged}/{year}")


def _replace(spark: SparkSession, path: str, staged: str) -> None:
    """Puts the folder ``staged`` in place of ``path``, unless that was done before.

    The old one goes first: until the new one is moved it is still in ``staged``.
    """
    files, old, new = _files(spark, staged), _path(spark, path), _path(spark, staged)
    if not files.exists(new):
        return
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{staged} could not be renamed to {path}")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    """The file system of a path."""
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
