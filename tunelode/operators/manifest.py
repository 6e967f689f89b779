"""Resumable work from an append-only log: the latest row of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep


def latest(log: DataFrame, key: str = "track_id", order: str = "line_no") -> DataFrame:
    """The last row of each key; an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def todo(ids: DataFrame, log: DataFrame, retry_no_preview: bool = False, key: str = "track_id") -> DataFrame:
    """Ids whose latest status doesn't settle them; failed downloads are always tried again."""
    settled = ["ok"] if retry_no_preview else ["ok", "no_preview"]
    return ids.join(latest(log, key).where(F.col("status").isin(settled)), key, "left_anti")


def reconciled(log: DataFrame, files: DataFrame, key: str = "track_id") -> DataFrame:
    """Latest rows, where a file on disk makes its key's status ok."""
    both = latest(log, key).select(key, "status").join(files.select(key, F.lit(True).alias("_there")), key, "full_outer")
    return both.select(key, F.when(F.col("_there"), "ok").otherwise(F.col("status")).alias("status"), (F.col("_there") & ~F.coalesce(F.col("status") == "ok", F.lit(False))).alias("_f")).select(
        key, "status", F.coalesce("_f", F.lit(False)).alias("from_file")
    )


def compacted(log: DataFrame, key: str = "track_id") -> DataFrame:
    """The log with only its latest rows, in the order of their keys, written whole beside the old one before anyone reads it."""
    return keep(latest(log, key).orderBy(key), "manifest")
