"""Reading a user's library: range and top-k queries, exclusion, widening, first-wins unions, recents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import effective_vibe


def in_library(tracks: DataFrame, links: DataFrame, user: int) -> DataFrame:
    """The tracks that a user has; adaptive execution picks the join by the filtered links' size."""
    return tracks.join(links.where(F.col("user_id") == user).select(F.col("track_id").alias("id")), "id")


def matching(tracks: DataFrame, low: float, high: float, *more: Column) -> DataFrame:
    """Tracks whose effective score lies in a closed range and for which every further predicate holds."""
    return tracks.withColumn("vibe", effective_vibe()).where(reduce(lambda a, b: a & b, more, F.col("vibe").between(low, high)))


def not_excluded(tracks: DataFrame, ids: list[int], keep_null: bool = False) -> DataFrame:
    """Without the listed catalogue ids.  As in SQL, rows without an id go too unless the list is empty or keep_null."""
    if not ids:
        return tracks
    inside = F.col("apple_id").isin(ids)
    return tracks.where(~F.coalesce(inside, F.lit(False)) if keep_null else ~inside)


def hash_order(id_col: str, seed: str = "") -> Column:
    """A random-looking order that every engine gives alike."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)).cast("binary"))


def pick_near(tracks: DataFrame, vibe: float, tolerance: float, wider: float, exclude: list[int]) -> DataFrame:
    """One seeded-random track within the tolerance, else within the wider one; no rows if there is none."""
    off = F.abs(F.col("vibe") - vibe)
    near = not_excluded(tracks.withColumn("vibe", effective_vibe()), exclude).where(off <= wider)
    return near.withColumn("attempt", F.when(off <= tolerance, 0).otherwise(1)).orderBy("attempt", hash_order("id")).limit(1)


def first_of(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def recent(events: DataFrame, user: str, item: str, at: list[str], keep: int = 5) -> DataFrame:
    """Each user's `keep` latest distinct items, newest first, by their last occurrence."""
    desc = [F.desc(c) for c in at]
    last = first_of(events, [user, item], *desc)
    rank = F.row_number().over(Window.partitionBy(user).orderBy(*desc))
    return last.withColumn("place", rank).where(F.col("place") <= keep)


def orphans(links: DataFrame, user: int) -> DataFrame:
    """Tracks that only this user has: what is left over when the user's links go."""
    mine = links.where(F.col("user_id") == user).select("track_id").distinct()
    return mine.join(links.where(~F.col("user_id").eqNullSafe(F.lit(user))).select("track_id").distinct(), "track_id", "left_anti")
