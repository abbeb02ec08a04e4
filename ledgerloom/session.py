"""Session settings the plans are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Adaptive execution merges small shuffle partitions and splits skewed ones in joins,
# but never adds partitions to an aggregate or a window.  So shuffles start from many
# (``initial_partitions``) and are merged to the advisory size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(
    app: str = "ledgerloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    initial_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots.

    ``initial_partitions`` is the number that every shuffle starts from.  Take about
    the largest shuffle's bytes over 128 MB: 8,000 for 1 TB, 100,000 and more for
    inputs of 100 TB.  Small shuffles are merged down at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if initial_partitions:
        key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
        builder = builder.config(key, str(initial_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only with a local master it may be unset; a fresh local folder is used then.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="ledgerloom-")
