"""M8 as it happens: sign-ups arriving in a stream become profiles with default categories.

Each micro-batch is compared with the profiles there are: the ledger's, and those that
earlier batches added.  New ones go to (root)/profiles/batch_id=N/, and their categories,
made from what was written there, to (root)/categories/batch_id=N/.  A batch that is done
again replaces both with the same rows: ids come from the users, and what the batch
itself added before doesn't count as known.  Readers see a batch once both are written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.model import Ledger
from ledgerloom.operators import changes

_TABLES = ("profiles", "categories")


def _added(ledger: Ledger, root: str, table: str, before: int) -> DataFrame | None:
    """What the batches before ``before`` added to a table; None if there was no batch."""
    own = getattr(ledger, table)
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema]
    schema = ", ".join([*columns, "batch_id long"])
    try:
        rows = ledger.profiles.sparkSession.read.schema(schema).parquet(f"{root}/{table}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return rows.where(F.col("batch_id") < before).select(*own.columns)


def write_signups(ledger: Ledger, signups: DataFrame, batch_id: int, root: str) -> None:
    """One micro-batch of sign-ups (id, email, metadata), replacing an earlier attempt's.

    Of several sign-ups of one id the first by email and metadata counts.
    """
    spark = signups.sparkSession
    known, earlier = ledger.profiles.select("id"), _added(ledger, root, "profiles", batch_id)
    if earlier is not None:
        known = known.unionByName(earlier.select("id"))
    first = signups.groupBy("id").agg(F.min(F.struct("email", "metadata")).alias("s")).select("id", "s.*")
    nobody = ledger.profiles.where(F.lit(False))
    name = F.coalesce(F.get_json_object("metadata", "$.name"), F.lit(""))
    new = first.join(known, "id", "left_anti").select("id", "email", name.alias("name"))
    profiles = changes.insert_with_defaults(nobody, new, changes.INSERT_DEFAULTS["profiles"])
    path = {t: f"{root}/{t}/batch_id={batch_id}" for t in _TABLES}
    profiles.write.mode("overwrite").parquet(path["profiles"])
    written = spark.read.schema(ledger.profiles.schema).parquet(path["profiles"])
    seeds = changes.seed_default_categories(written.select(F.col("id").alias("user_id")), ledger.categories)
    seeds.select(*ledger.categories.columns).write.mode("overwrite").parquet(path["categories"])
    done = spark.createDataFrame([(batch_id,)], "batch long")
    done.coalesce(1).write.mode("append").parquet(f"{root}/done")


def start_onboarding(
    ledger: Ledger, signups: DataFrame, root: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Keeps ``root`` up to date with a stream of sign-ups.

    ``root`` and ``checkpoint`` must be in storage that all executors share and belong to
    this stream alone.
    """
    return (
        signups.writeStream.foreachBatch(lambda batch, n: write_signups(ledger, batch, n, root))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger or {"processingTime": "1 minute"})
        .start()
    )


def _last_done(spark: SparkSession, root: str) -> int:
    try:
        return spark.read.schema("batch long").parquet(f"{root}/done").agg(F.max("batch")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return -1


def read_onboarded(ledger: Ledger, root: str) -> Ledger:
    """``ledger`` with everyone that finished batches have added."""
    last = _last_done(ledger.profiles.sparkSession, root)
    if last < 0:
        return ledger
    tables = {t: getattr(ledger, t).unionByName(_added(ledger, root, t, last + 1)) for t in _TABLES}
    return ledger.with_tables(**tables, monthly_activity=ledger.monthly_activity)
