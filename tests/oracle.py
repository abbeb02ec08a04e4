"""Compares a query's rows with those of its SQL twin."""

from __future__ import annotations

import datetime
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.replace(tzinfo=None)
    return value


def _bag(rows, names: list[str]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> list[str]:
    """What differs; empty if the row bags are equal."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = _bag(result.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    actual = _bag(df.collect(), df.columns)
    missing, extra = expected - actual, actual - expected
    if not missing and not extra:
        return [] if expected else ["no rows on either side"]
    return [
        f"columns {sorted(names)}",
        f"rows {sum(actual.values())} vs {sum(expected.values())}",
        f"missing {sum(missing.values())}: {list(missing)[:3]}",
        f"extra {sum(extra.values())}: {list(extra)[:3]}",
    ]
