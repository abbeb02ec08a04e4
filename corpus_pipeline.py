"""The corpus pipeline: the stages of ``ledgerloom.llm.pipeline``, and their run."""

from ledgerloom.llm.pipeline import (
    ORACLE_SQL,
    SHARDS,
    STAGES,
    drop_leaks,
    drop_near_duplicates,
    mix_sources,
    reject_low_quality,
    run,
    shard_rows,
)

__all__ = [
    "ORACLE_SQL", "SHARDS", "STAGES", "drop_leaks", "drop_near_duplicates", "mix_sources", "reject_low_quality", "run",
    "shard_rows",
]
