"""Constraints checked before rows are stored.

A batch of new rows is split into those that break no rule and those that do, with the
rules.  Rules of single rows are those of ``quality``; references must exist and ids be
new, which has to be looked up in stored tables that are much larger than the batch.

Stored tables aren't shuffled for that.  The batch's keys become a Bloom filter: a
table of at most ``words`` rows of 64 bits, so its broadcast has a fixed size however
large the batch.  Stored ids are tested against it where they are read, and only those
that pass (the batch's own, and a few per cent of others) go on to the exact join.  A
filter too full to help costs speed, never an answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.model import SCHEDULES, Ledger
from ledgerloom.operators.quality import row_rules

WORDS = 1 << 17  # of 64 bits: 3 MB as broadcast; fit for about a million keys
RULES = "broken_rules"


def _place(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("word")), F.lit(words)).alias("__word")


def _bits(key: Column) -> Column:
    """Three bits of a word, from another hash."""
    h = F.xxhash64(key, F.lit("bits"))
    picked = [F.pmod(F.shiftright(h, 20 * k), F.lit(64)).cast("int") for k in range(3)]
    one = F.lit(1).cast("bigint")
    ones = [F.call_function("shiftleft", one, p) for p in picked]
    return ones[0].bitwiseOR(ones[1]).bitwiseOR(ones[2])


def passing(stored: DataFrame, keys: DataFrame, words: int = WORDS) -> DataFrame:
    """The ``id`` of ``stored`` rows that may be among ``keys`` (column ``key``).

    All that are among them, and some others.  Nothing of ``stored`` is shuffled.
    """
    key = F.col("key")
    bloom = keys.where(key.isNotNull()).groupBy(_place(key, words)).agg(F.bit_or(_bits(key)).alias("__have"))
    ids = stored.select("id").withColumn("__word", _place(F.col("id"), words)).withColumn("__want", _bits(F.col("id")))
    # At most ``words`` rows of two numbers.
    tested = ids.join(F.broadcast(bloom), "__word")
    return tested.where(F.col("__have").bitwiseAND(F.col("__want")) == F.col("__want")).select("id")


def _found(stored: DataFrame, rows: DataFrame, column: str, words: int) -> DataFrame:
    """Which values of ``column`` are ids of ``stored``: (key struct, mark)."""
    id_type = stored.schema["id"].dataType
    keys = rows.select(F.col(column).cast(id_type).alias("key")).where("key IS NOT NULL").distinct()
    ids = passing(stored, keys, words).distinct()
    # The key as a struct is dealt anew for the join with the rows, see ``functions.skew``.
    return ids.select(F.struct("id").alias(f"__key_{column}"), F.lit(True).alias(f"__found_{column}"))


def _marked(rows: DataFrame, column: str, stored: DataFrame, words: int) -> DataFrame:
    id_type = stored.schema["id"].dataType
    key = F.when(F.col(column).isNotNull(), F.struct(F.col(column).cast(id_type).alias("id")))
    found = _found(stored, rows, column, words)
    return rows.withColumn(f"__key_{column}", key).join(found, f"__key_{column}", "left").drop(f"__key_{column}")


def _repeated(rows: DataFrame, order_by: str | None) -> DataFrame:
    """Marks rows whose id another row of the batch has (or has before it)."""
    if order_by is not None:
        earlier = Window.partitionBy("id").orderBy(order_by)
        return rows.withColumn("__again", F.col("id").isNotNull() & (F.row_number().over(earlier) > 1))
    often = rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("__n")).where("__n > 1")
    often = often.select(F.struct("id").alias("__key"), F.lit(True).alias("__again"))
    keyed = rows.withColumn("__key", F.when(F.col("id").isNotNull(), F.struct("id")))
    return keyed.join(often, "__key", "left").drop("__key")


def check_new_rows(
    ledger: Ledger, table: str, rows: DataFrame, order_by: str | None = None, words: int = WORDS
) -> DataFrame:
    """``rows`` with ``broken_rules``: an array of rules, empty if the row may be stored.

    ``rows`` are typed, defaults filled in, and have the table's columns (others stay
    as they are).  Rules: required fields, domains, amounts in range, user and category
    that exist, an id that is neither stored nor repeated in the batch.  Of rows with
    one id, that first by ``order_by`` counts as the row and the others as repeats;
    without it none of them is told from the others and all are repeats.
    """
    stored = getattr(ledger, table)
    parents = {} if table == "profiles" else {"user_id": ledger.profiles}
    if table in ("transactions", *SCHEDULES):
        parents["category_id"] = ledger.categories
    rules, marked = row_rules(table), _repeated(rows, order_by)
    for column, parent in parents.items():
        marked = _marked(marked, column, parent, words)
        absent = F.col(column).isNotNull() & F.col(f"__found_{column}").isNull()
        rules.append(F.when(absent, f"{column} reference"))
    marked = _marked(marked, "id", stored, words)
    taken = F.coalesce(F.col("__found_id"), F.lit(False)) | F.coalesce(F.col("__again"), F.lit(False))
    rules.append(F.when(taken, "id unique"))
    return marked.select(*rows.columns, F.filter(F.array(*rules), lambda r: r.isNotNull()).alias(RULES))


def gate(ledger: Ledger, table: str, rows: DataFrame, order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that may be stored, and refused rows with their ``broken_rules``."""
    checked = check_new_rows(ledger, table, rows, order_by)
    fine = F.size(RULES) == 0
    return checked.where(fine).drop(RULES), checked.where(~fine)
