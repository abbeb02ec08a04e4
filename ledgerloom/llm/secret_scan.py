"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its content (SHA-256), so copies, moves and
reverts of a file are one blob.  The ledger holds, per blob and rule version, what was
found.  A scan works out which pairs of blob and rule version the ledger lacks, reads
only those texts, appends their findings, and joins the ledger back to all paths.

Only ids and digests are shuffled to find the unseen blobs; texts move only to meet
them, and not at all when the unseen ones are few enough for Spark to broadcast.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerloom.llm.common import ship, text_or_empty

# Kind, pattern, group whose length counts, least length.  Letters of assign match in
# either case, ASCII only.
RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
RULE_VERSION = "base-1"
FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rules string, findings {FINDINGS}"

_ASSIGN = re.compile(RULES[0][1])
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(RULES[1][1])
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is the same as a long enough run


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed.

    Matches of a kind are leftmost and don't overlap; those that are too short are
    dropped after matching.
    """
    found = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(RULES[k][0], a, b) for a, k, b in sorted(found)]


def _findings(column: str) -> Column:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    names = ("kind", "start", "end")

    @F.arrow_udf(FINDINGS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(
            [[dict(zip(names, x, strict=True)) for x in find_secrets(t)] for t in texts.to_pylist()], pa.list_(kind)
        )

    return found(column)


def versions(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """Path and content address of each row; a null text is the empty blob."""
    return docs.select(F.col(path), F.sha2(text_or_empty(), 256).alias("blob"))


def read_ledger(docs: DataFrame, ledger: str) -> DataFrame:
    """The ledger's rows; none if the folder doesn't exist yet."""
    spark = docs.sparkSession
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_unseen(docs: DataFrame, ledger: str, rules: str = RULE_VERSION, path: str = "doc_id") -> None:
    """Scans the blobs of ``docs`` that the ledger lacks for ``rules``; appends them.

    Each unseen blob is read once, at its smallest path.  Running it again appends
    nothing.  The append is one job: if it fails, the ledger is as before.
    """
    ship(docs.sparkSession)
    seen = read_ledger(docs, ledger).where(F.col("rules") == rules).select("blob")
    unseen = (
        versions(docs, path).groupBy("blob").agg(F.min(path).alias("_at")).join(seen, "blob", "left_anti")
        .withColumnRenamed("blob", "_blob")
    )
    texts = docs.select(F.col(path).alias("_path"), text_or_empty().alias("_text")).withColumn("blob", F.sha2("_text", 256))
    # On both keys: copies of a blob spread over tasks, and all but one drop out.
    found = (
        texts.join(unseen, (F.col("blob") == F.col("_blob")) & F.col("_path").eqNullSafe(F.col("_at")))
        .select("blob", F.lit(rules).alias("rules"), _findings("_text").alias("findings"))
    )
    found.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)


def findings_by_path(docs: DataFrame, ledger: str, rules: str = RULE_VERSION, path: str = "doc_id") -> DataFrame:
    """Every row's path with its blob and findings, from the ledger alone.

    Rows come back as often as they are in ``docs``, however often the ledger holds
    their blob; null texts are the empty blob and null paths are paths.
    """
    known = read_ledger(docs, ledger).where((F.col("rules") == rules) & (F.size("findings") > 0))
    # Two scans at once, or an append done again, may have stored a blob twice.
    known = known.groupBy("blob").agg(F.first("findings").alias("findings"))
    # As a struct the key is dealt anew for the join, so that rows of one blob are split.
    known = known.select(F.struct("blob").alias("_key"), "findings")
    return versions(docs, path).withColumn("_key", F.struct("blob")).join(known, "_key", "left").drop("_key")


def scan(docs: DataFrame, ledger: str, rules: str = RULE_VERSION, path: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: path, blob and findings (null if there are none).

    Null texts are empty, null paths are paths like any other, repeated rows come back
    as often as they are in ``docs``, other columns aren't read.  An empty table scans
    nothing and gives no rows.
    """
    scan_unseen(docs, ledger, rules, path)
    return findings_by_path(docs, ledger, rules, path)
