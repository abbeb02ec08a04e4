"""Reproducible ids for generated rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stable_id(*parts: Column, id_type: T.DataType | None = None) -> Column:
    """An id that depends on the parts only, so a recomputed task gives it again.

    UUID-shaped text.  Ledgers with other ids raise: 64 bits of a hash are too few
    to stay unique, and could hit an id that is already stored.
    """
    if id_type is not None and not isinstance(id_type, T.StringType):
        raise ValueError(f"generated rows need text ids, not {id_type.simpleString()}")
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digest = F.md5(text)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])
