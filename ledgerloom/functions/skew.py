"""Joins that stay balanced when one key holds a large part of the rows.

Adaptive execution splits a skewed partition of a join into pieces of the
advisory size, whatever the number of rows of the key, but only where both
inputs come straight from a shuffle made for the join.  Attaching an
*aggregate* to the rows it was computed from does not qualify: the aggregate is
already partitioned by the key, no shuffle is added on its side, and a third of
all rows would follow one user into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = "__join_key"


def attach_totals(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``totals``, which has one row per key.

    Joining on ``struct(key)`` rather than on the key itself keeps the planner
    from reusing the aggregate's partitioning, so both sides are shuffled for
    this join and skewed keys get split.  It costs one more shuffle of the
    totals, a row per key.  Small totals are broadcast by the usual size checks.
    """
    keyed_rows = rows.withColumn(_KEY, F.struct(key))
    keyed_totals = totals.withColumn(_KEY, F.struct(key)).drop(key)
    return keyed_rows.join(keyed_totals, _KEY).drop(_KEY)
