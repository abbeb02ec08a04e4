"""Monthly totals refreshed as transactions arrive.

Each micro-batch is condensed to one row per user, category, type and month and
written under its own ``batch_id`` directory.  A replayed batch overwrites its
directory, so nothing is counted twice, and the work per batch grows with the
batch, not with the history.  Reading adds up the batches.  Every ``fold_every``
batches the finished ones are folded into a base, so that reading stays cheap, and
what has been folded for ``keep`` folds is deleted, so that listings stay short.

A store is (root)/deltas/batch_id=N/ and (root)/base/through=N/, where a base
covers the batches up to N.  It belongs to one streaming query: batch numbers
come from that query's checkpoint.

Sources that deliver a row again, in the same batch or any later one, need ``once``:
the ids of what was counted are kept in (root)/seen/batch_id=N/year=Y/, and each
batch is compared with those of its own months, however late its rows are.  A row that
is delivered again is the same row; nothing is forgotten, so no row is too late.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.money import total
from ledgerloom.plans.activity import monthly_rollup

_KEYS = ("user_id", "category_id", "type", "date")


def _as_activity(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        "user_id",
        "category_id",
        "type",
        "date",
        "amount",
        F.lit(1).cast("bigint").alias("n"),
        F.col("date").alias("last_date"),
    )


def _not_seen(batch: DataFrame, batch_id: int, root: str) -> DataFrame:
    """The rows of a batch, each id once, that no earlier batch counted; notes their ids.

    They depend on the batch and on earlier ones alone, so a batch that is done again
    counts the same rows.  They are persisted, for the ids and for the totals; the caller
    lets them go.  Rows without an id can't be told apart and aren't counted.
    """
    spark, month = batch.sparkSession, F.trunc("date", "month").cast("date")
    kind = batch.schema["id"].dataType.simpleString()
    # A row per calendar month.
    months = [r["month"] for r in batch.select(month.alias("month")).distinct().collect()]
    # A file that arrives is read by few tasks: its rows are dealt by id before they are
    # sorted by it, and are met by earlier ids as they lie.
    rows = batch.select("id", *_KEYS, "amount").where(F.col("id").isNotNull()).repartition("id").dropDuplicates(["id"])
    if batch_id > 0 and months:
        stored = spark.read.schema(f"id {kind}, month date, batch_id long, year int").parquet(f"{root}/seen")
        stored = stored.where(F.col("year").isin(sorted({m.year for m in months})) & F.col("month").isin(months))
        # Ids compress to little, so their size as stored must not have them broadcast.
        rows = rows.join(stored.where(F.col("batch_id") < batch_id).select("id").hint("merge"), "id", "left_anti")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    # Persisted rows keep their partitions: ids are gathered by year into few files, and large years are cut.
    ids = rows.select("id", month.alias("month"), F.year("date").alias("year")).hint("rebalance", "year")
    ids.sortWithinPartitions("year", "month").write.mode("overwrite").partitionBy("year").parquet(f"{root}/seen/batch_id={batch_id}")
    return rows


def write_batch(batch: DataFrame, batch_id: int, root: str, once: bool = False) -> None:
    """Store one micro-batch's totals, replacing an earlier attempt's.

    ``once`` counts rows by id, however often they are delivered.
    """
    rows = _not_seen(batch, batch_id, root) if once else batch
    try:
        totals = monthly_rollup(_as_activity(rows))
        totals.write.mode("overwrite").parquet(f"{root}/deltas/batch_id={batch_id}")
    finally:
        if once:
            rows.unpersist()


def start_refresh(
    transactions: DataFrame,
    root: str,
    checkpoint: str,
    fold_every: int = 60,
    keep: int = 2,
    once: bool = False,
    **trigger,
) -> StreamingQuery:
    """Keep ``root`` up to date with a stream of transactions.

    ``root`` and ``checkpoint`` must be in storage that all executors share.
    ``once`` is for sources that may deliver rows again.  ``trigger`` is passed on, e.g.
    ``availableNow=True``.
    """

    def store(batch: DataFrame, n: int) -> None:
        write_batch(batch, n, root, once)
        if (n + 1) % fold_every == 0:
            compact(batch.sparkSession, root)
            clean(batch.sparkSession, root, keep)

    return (
        transactions.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger or {"processingTime": "1 minute"})
        .start()
    )


def _finished(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete directories ``prefix=N`` below ``path``."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    return sorted(
        int(status.getPath().getName().removeprefix(f"{prefix}="))
        for status in fs.listStatus(base)
        if status.getPath().getName().startswith(f"{prefix}=")
        and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
    )


def _parts(spark: SparkSession, root: str, through: int | None) -> tuple[list[str], int]:
    """Directories that together hold each batch once, and the last batch held."""
    bases = [n for n in _finished(spark, f"{root}/base", "through") if through is None or n <= through]
    covered = bases[-1] if bases else -1
    batches = [
        n
        for n in _finished(spark, f"{root}/deltas", "batch_id")
        if n > covered and (through is None or n <= through)
    ]
    paths = [f"{root}/base/through={covered}"] if bases else []
    paths += [f"{root}/deltas/batch_id={n}" for n in batches]
    return paths, batches[-1] if batches else covered


def read_activity(spark: SparkSession, root: str, through: int | None = None) -> DataFrame:
    """The rollup of all finished batches, usable as ``Ledger.monthly_activity``."""
    paths, _ = _parts(spark, root, through)
    if not paths:
        raise ValueError(f"no finished batch under {root}")
    rows = spark.read.parquet(*paths)
    return rows.groupBy(*_KEYS).agg(
        total(F.col("amount")).alias("amount"),
        F.sum("n").alias("n"),
        F.max("last_date").alias("last_date"),
    )


def compact(spark: SparkSession, root: str) -> int:
    """Fold all finished batches into a new base; returns the batch it covers.

    Older bases and folded batches are left in place, as readers that started
    before may still use them; ``clean`` deletes them later.
    """
    _, last = _parts(spark, root, None)
    if last not in _finished(spark, f"{root}/base", "through"):
        read_activity(spark, root, last).write.mode("overwrite").parquet(
            f"{root}/base/through={last}"
        )
    return last


def clean(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes bases before the last ``keep``, and the batches those already covered."""
    bases = _finished(spark, f"{root}/base", "through")
    if len(bases) <= keep:
        return
    folded = bases[-keep - 1]
    jvm = spark.sparkContext._jvm
    for n in (n for n in bases if n <= folded):
        _delete(spark, jvm.org.apache.hadoop.fs.Path(f"{root}/base/through={n}"))
    for n in _finished(spark, f"{root}/deltas", "batch_id"):
        if n <= folded:
            _delete(spark, jvm.org.apache.hadoop.fs.Path(f"{root}/deltas/batch_id={n}"))


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def monthly_totals(activity: DataFrame) -> DataFrame:
    """Totals per user, month and type; also the batch twin on plain activity."""
    return activity.groupBy("user_id", F.trunc("date", "month").alias("month"), "type").agg(
        total(F.col("amount")).alias("total_amount"), F.sum("n").alias("transaction_count")
    )
