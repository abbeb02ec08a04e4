"""Top-k groups per key with a remainder entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.money import percent, total
from ledgerloom.model import MONEY, PERCENT

TOP = 5
# The remainder entry.
OTHERS_NAME = "Others"
OTHERS_COLOR = "#808080"
OTHERS_ICON_ALL_TIME = "more-horiz"
OTHERS_ICON_BY_YEAR = "ellipsis-h"


def latest(df: DataFrame, order: Column, k: int = TOP) -> DataFrame:
    """The first k rows per user.

    The rank filter becomes a per-partition limit before the shuffle, so at
    most k rows per user and task travel.
    """
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def entry(category: Column, percentage: Column, icon: Column, color: Column, others: int) -> Column:
    return F.struct(
        category.alias("category"),
        percentage.cast(PERCENT).alias("percentage"),
        icon.alias("icon"),
        color.alias("color"),
        F.lit(others).alias("is_others"),
    )


def others_entry(percentage: Column, icon: str) -> Column:
    return entry(F.lit(OTHERS_NAME), percentage, F.lit(icon), F.lit(OTHERS_COLOR), 1)


def named_groups(per_category: DataFrame, categories: DataFrame, keys: list[str]) -> DataFrame:
    """Amounts per key and (name, icon, color); equal triples merge across ids."""
    labels = categories.select(F.col("id").alias("category_id"), "name", "icon", "color")
    return (
        per_category.join(labels, "category_id")
        .groupBy(*keys, "name", "icon", "color")
        .agg(total(F.col("amount")).alias("amount"))
    )


def top_with_others(groups: DataFrame, keys: list[str], icon: str) -> DataFrame:
    """Per key an array ``entries``: the top groups and what they leave of 100 %.

    Ties are broken by name, icon and color.  At most TOP rows per key survive
    the rank filter, so the arrays are bounded; the grand total is a separate
    aggregate with map-side combining instead of a window over all groups.
    """
    ranked = Window.partitionBy(*keys).orderBy(F.desc("amount"), "name", "icon", "color")
    top = groups.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP)
    grand = groups.groupBy(*keys).agg(total(F.col("amount")).alias("grand"))
    shares = top.join(grand, keys).withColumn("pct", percent(F.col("amount"), F.col("grand")))
    # Largest percentage first; rank decides ties.
    sortable = F.struct((-F.col("pct")).alias("order"), "rank", "pct", "name", "icon", "color")
    gathered = shares.groupBy(*keys).agg(
        F.sort_array(F.collect_list(sortable)).alias("top"), F.sum("pct").alias("covered")
    )
    listed = F.transform("top", lambda g: entry(g["name"], g["pct"], g["icon"], g["color"], 0))
    remainder = F.array(others_entry(F.lit(100) - F.col("covered"), icon))
    return gathered.select(*keys, F.concat(listed, remainder).alias("entries"))


def top_by_year(amounts: DataFrame, categories: DataFrame, icon: str) -> DataFrame:
    """Per user and year of the latest years an array ``categories``: the top groups and the rest.

    ``amounts`` has one row per user, category (or none) and year.  Windows run over a
    user's categories and years and over the groups of one year; a year whose rows have
    no known category has an empty array.
    """
    by_year = Window.partitionBy("user_id").orderBy(F.desc("year"))
    recent = amounts.withColumn("__rank", F.dense_rank().over(by_year)).where(F.col("__rank") <= TOP)
    labels = categories.select(
        F.col("id").alias("category_id"), F.struct("name", "icon", "color").alias("label")
    )
    groups = (
        recent.join(labels, "category_id", "left").groupBy("user_id", "year", "label")
        .agg(total(F.col("amount")).alias("amount"))
    )
    known = F.col("label").isNotNull()
    of_year = Window.partitionBy("user_id", "year")
    order = of_year.orderBy(known.desc(), F.desc("amount"), "label")
    ranked = groups.withColumn("rank", F.row_number().over(order)).withColumn(
        "grand", F.sum(F.when(known, F.col("amount"))).over(of_year)
    )
    pct = percent(F.col("amount"), F.col("grand").cast(MONEY))
    shown = ranked.where(~known | (F.col("rank") <= TOP)).withColumn("pct", F.when(known, pct))
    sortable = F.struct((-F.col("pct")).alias("order"), "rank", "pct", "label")
    gathered = shown.groupBy("user_id", "year").agg(
        F.sort_array(F.collect_list(F.when(known, sortable))).alias("top"), F.sum("pct").alias("covered")
    )
    listed = F.transform(
        "top", lambda g: entry(g["label"]["name"], g["pct"], g["label"]["icon"], g["label"]["color"], 0)
    )
    remainder = F.array(others_entry(F.lit(100) - F.col("covered"), icon))
    entries = F.when(F.size("top") > 0, F.concat(listed, remainder))
    empty = F.array().cast(T.ArrayType(T.StructType([
        T.StructField("category", T.StringType()), T.StructField("percentage", PERCENT), T.StructField("icon", T.StringType()),
        T.StructField("color", T.StringType()), T.StructField("is_others", T.IntegerType()),
    ])))
    return gathered.select("user_id", "year", F.coalesce(entries, empty).alias("categories"))
