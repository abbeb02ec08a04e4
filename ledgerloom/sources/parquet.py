"""Stored ledgers: one Parquet directory per table.

Transactions are partitioned by year and range-clustered by (user_id, date, id)
inside.  Periods prune directories, a user's rows sit in few row groups whose
min/max statistics skip the rest, and a user too large for one file is cut by
date and id, which bucketing by user could not do.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.periods import YEAR_PARTITION
from ledgerloom.model import SCHEMAS, Ledger
from ledgerloom.plans.activity import activity, monthly_rollup

ROLLUP = "monthly_activity"
VERSION = "version"  # log of the tables' versions; the rollup keeps the one it was made from


# Columns looked up by single values: their row groups carry Bloom filters, as values are
# scattered over all of them and least and greatest values exclude none.
LOOKED_UP = ("id", "category_id")
VALUES = 200_000  # different values a filter is sized for, per row group: about 240 KB each

# How stored tables are ordered inside a year.
CLUSTERS = {"transactions": ["user_id", "date", "id"], ROLLUP: ["user_id", "date", "category_id"]}


def _write_by_year(df: DataFrame, path: str, cluster: list[str], overwrite: str = "static") -> None:
    """``overwrite``: static replaces all years, dynamic those that ``df`` has rows of."""
    (
        df.withColumn(YEAR_PARTITION, F.year("date"))
        .repartitionByRange(YEAR_PARTITION, *cluster)
        .sortWithinPartitions(YEAR_PARTITION, *cluster)
        .write.mode("overwrite")
        .options(**_bloom_filters(df))
        .option("partitionOverwriteMode", overwrite)
        .partitionBy(YEAR_PARTITION)
        .parquet(path)
    )


def _bloom_filters(df: DataFrame) -> dict[str, str]:
    found = [c for c in LOOKED_UP if c in df.columns]
    on = {f"parquet.bloom.filter.enabled#{c}": "true" for c in found}
    return on | {f"parquet.bloom.filter.expected.ndv#{c}": str(VALUES) for c in found}


def write_ledger(ledger: Ledger, root: str) -> None:
    """Store all tables.  ``root`` must not be where the ledger is read from.

    The log says first that a write is under way and last that it is done, with a new
    version.  So a rollup of older tables is known as stale, and so are tables whose
    writer died on the way.
    """
    spark = ledger.profiles.sparkSession
    log = f"{root}/{VERSION}"
    append_version(spark, log, WRITING)
    for name, table in ledger.tables().items():
        write_table(name, table, f"{root}/{name}")
    append_version(spark, log, DONE)


def write_table(name: str, table: DataFrame, path: str) -> None:
    """Store one table whole, clustered for its readers."""
    if name == "transactions":
        _write_by_year(table.drop(YEAR_PARTITION), path, CLUSTERS[name])
    elif name == "profiles":
        table.write.mode("overwrite").parquet(path)
    else:
        clustered = table.repartitionByRange("user_id", "id").sortWithinPartitions("user_id", "id")
        clustered.write.mode("overwrite").parquet(path)


# --- the log of versions ---------------------------------------------------

WRITING, DONE = "writing", "done"
_LOG = "number long, state string, version string, folder string, years array<int>, tables array<string>"


def read_version(spark: SparkSession, path: str) -> Row | None:
    """The last entry of a log of versions; None if there is no log."""
    try:
        entries = spark.read.schema(_LOG).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    # An entry per write; entries are only ever added, so none is lost by a crash.
    last = entries.orderBy(F.desc("number")).limit(2).collect()
    if len(last) == 2 and last[0]["number"] == last[1]["number"]:
        raise ValueError(f"two writers at once have written to {path}; write the ledger again")
    return last[0] if last else None


def append_version(
    spark: SparkSession, path: str, state: str, version: str | None = None, folder: str | None = None,
    years: list[int] | None = None, tables: list[str] | None = None,
) -> str:
    """Adds an entry; a new version is drawn unless one is given.  Returns the version."""
    before = read_version(spark, path)
    version = version or uuid.uuid4().hex
    entry = (0 if before is None else before["number"] + 1, state, version, folder, years, tables)
    spark.createDataFrame([entry], _LOG).coalesce(1).write.mode("append").parquet(path)
    return version


def _done_version(spark: SparkSession, path: str, what: str) -> str:
    entry = read_version(spark, path)
    if entry is None or entry["state"] != DONE:
        raise ValueError(f"{what} was never finished ({path})")
    return entry["version"]


def write_rollup(ledger: Ledger, root: str) -> None:
    """Store the monthly rollup of the transactions next to the tables in ``root``.

    It is made from what is stored there, whatever ``ledger`` holds, and keeps the
    version those tables had before they were read.  ``ledger`` tells the session and
    the type of ids.
    """
    spark = ledger.profiles.sparkSession
    version = _done_version(spark, f"{root}/{VERSION}", "the ledger")
    log = f"{root}/{ROLLUP}_{VERSION}"
    append_version(spark, log, WRITING)
    stored = read_ledger(spark, root, ledger.transactions.schema["user_id"].dataType)
    _write_by_year(monthly_rollup(activity(stored)), f"{root}/{ROLLUP}", CLUSTERS[ROLLUP])
    append_version(spark, log, DONE, version)


def stored_schema(name: str, id_type: T.DataType | None = None) -> T.StructType:
    """The declared schema of a stored table or of the rollup."""
    ids = ("id", "user_id", "category_id")
    schema = ROLLUP_SCHEMA if name == ROLLUP else SCHEMAS[name]
    columns = [
        T.StructField(f.name, (id_type or T.StringType()) if f.name in ids else f.dataType, True) for f in schema
    ]
    if name in CLUSTERS:
        columns.append(T.StructField(YEAR_PARTITION, T.IntegerType(), True))
    return T.StructType(columns)


def read_ledger(
    spark: SparkSession, root: str, id_type: T.DataType | None = None, rollup: bool = False
) -> Ledger:
    """Open a stored ledger with its declared schema; nothing is inferred.

    ``id_type`` is for ledgers whose ids are not UUID strings.  Tables whose writer was
    broken off raise; ``rollup`` also raises if the tables were written after the rollup.
    """
    def table(name: str) -> DataFrame:
        return spark.read.schema(stored_schema(name, id_type)).parquet(f"{root}/{name}")

    tables = {name: table(name) for name in SCHEMAS}
    entry = read_version(spark, f"{root}/{VERSION}")
    if entry is not None and entry["state"] != DONE:
        raise ValueError(f"a write to {root} was broken off; finish_changes or write the ledger again")
    if rollup:
        tables_version = _done_version(spark, f"{root}/{VERSION}", "the ledger")
        if tables_version != _done_version(spark, f"{root}/{ROLLUP}_{VERSION}", "the rollup"):
            raise ValueError(f"the rollup in {root} is of older tables; write it again")
        tables[ROLLUP] = table(ROLLUP)
    return Ledger(**tables)


def write_report(report: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Store a report; pass e.g. ``["year"]`` to replace only the years it holds."""
    writer = report.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def to_json_rows(report: DataFrame) -> DataFrame:
    """One JSON object per row, keys with NULL values kept."""
    row = F.struct(*[F.col(c) for c in report.columns])
    return report.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("category_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("amount", T.DecimalType(18, 2)),
        T.StructField("n", T.LongType()),
        T.StructField("last_date", T.DateType()),
    ]
)
