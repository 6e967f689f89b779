"""New versions of tables: upserts, insert-or-ignore, defaults and additive schemas as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled


def insert_or_ignore(links: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """links and the rows of new whose key isn't there; of equal keys in new the first by `order` stays, else the least row."""
    row = F.struct(*new.columns)
    first = new.groupBy(*key).agg(F.min_by(row, F.struct(order, row) if order else row).alias("_row")).select("_row.*")
    return links.unionByName(first.join(links.select(*key), key, "left_anti"))


def update(rows: DataFrame, results: DataFrame, key: str, stamp: Column | None = None, stamp_col: str = "updated_at") -> DataFrame:
    """rows with the columns of results where results has their key; NULL results replace too, other rows stay.

    A key that results holds more than once takes its last row by the columns' order.  A stamp marks the changed rows.
    """
    cols = [c for c in results.columns if c != key]
    new = results.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*cols)).alias("_new"))
    out = rows.join(new, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    changed = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in cols}
    if stamp is not None:
        changed[stamp_col] = F.when(hit, stamp).otherwise(F.col(stamp_col))
    return out.withColumns(changed).drop("_key", "_new")


def with_defaults(new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """new with a default wherever a column is missing or NULL."""
    return new.withColumns({c: F.coalesce(F.col(c), d) if c in new.columns else d for c, d in defaults.items()})


def upsert(tracks: DataFrame, new: DataFrame) -> DataFrame:
    """tracks with new's rows: found by spotify_id, else by apple_id, all of new's columns replace the old ones, NULLs
    too; rows found by neither are added with ids after the largest.  Empty keys find nothing."""
    cols = [c for c in new.columns if c != "new_id"]
    by = lambda k: tracks.where(filled(F.col(k)).isNotNull()).groupBy(F.col(k).alias(f"_{k}")).agg(F.min("id").alias(f"_by_{k}"))
    hit = new.join(by("spotify_id"), F.col("spotify_id") == F.col("_spotify_id"), "left").join(by("apple_id"), F.col("apple_id") == F.col("_apple_id"), "left")
    hit = hit.withColumn("_id", F.coalesce("_by_spotify_id", "_by_apple_id")).select("new_id", "_id", *cols)
    renamed = hit.where("_id IS NOT NULL").groupBy("_id").agg(F.max_by(F.struct(*cols), "new_id").alias("_new"))
    kept = tracks.join(renamed, tracks["id"] == F.col("_id"), "left").select(
        "id", *[(F.when(F.col("_id").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in cols else F.col(c)).alias(c) for c in tracks.columns if c != "id"]
    )
    top = tracks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    added = hit.where("_id IS NULL").crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("new_id")).alias("id"), *cols)
    return kept.unionByName(added, allowMissingColumns=True)


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with the columns (name: type) that it lacks, all NULL."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def common_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that df has, in their order."""
    return df.select(*[c for c in columns if c in df.columns])
