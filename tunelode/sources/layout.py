"""Tables laid out so that the usual reads touch little: bucketed by key, and Bloom filters on the ids that are looked up.

A library's links are bucketed by user, so that a user's are one bucket's files; tracks, and links once more, by track, so
that they join without an exchange.  Lookups by other ids skip the row groups whose Bloom filters rule them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(rows: DataFrame, table: str, path: str, key: str, buckets: int, bloom: tuple[str, ...] = (), row_group: int | None = None) -> None:
    """rows as a table at a path, bucketed and sorted by a key; `bloom` names columns with a Bloom filter in each row group.

    A task writes a bucket, so a key must not be hot; row_group is a group's bytes, Parquet's default if None.
    """
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if row_group:
        writer = writer.option("parquet.block.size", row_group).option("parquet.page.size", min(row_group, 1 << 20))
    writer.mode("overwrite").saveAsTable(table)


def write_library(tracks: DataFrame, links: DataFrame, root: str, prefix: str, buckets: int = 16) -> None:
    """The tables {prefix}_tracks, {prefix}_links (by user) and {prefix}_listeners (links by track)."""
    write_bucketed(tracks, f"{prefix}_tracks", f"{root}/tracks", "id", buckets, bloom=("spotify_id", "apple_id"))
    write_bucketed(links, f"{prefix}_links", f"{root}/links", "user_id", buckets)
    write_bucketed(links, f"{prefix}_listeners", f"{root}/listeners", "track_id", buckets)


def library_of(spark: SparkSession, prefix: str, user: int) -> DataFrame:
    """A user's tracks: one bucket of links, and the tracks they name."""
    links = spark.table(f"{prefix}_links").where(f"user_id = {int(user)}")
    return links.join(spark.table(f"{prefix}_tracks"), links["track_id"] == spark.table(f"{prefix}_tracks")["id"])


def with_listeners(spark: SparkSession, prefix: str) -> DataFrame:
    """Every track beside every link to it, bucket by bucket."""
    tracks, links = spark.table(f"{prefix}_tracks"), spark.table(f"{prefix}_listeners")
    return tracks.join(links, tracks["id"] == links["track_id"])


def lookup(spark: SparkSession, prefix: str, key: str) -> DataFrame:
    """The track that a key names: a number finds an apple_id; what isn't one, or finds none, a spotify_id; the least id."""
    tracks = spark.table(f"{prefix}_tracks")
    if key.strip().lstrip("+-").isdigit():
        found = tracks.where(tracks["apple_id"] == int(key)).orderBy("id").limit(1)
        if not found.isEmpty():
            return found
    return tracks.where(tracks["spotify_id"] == key).orderBy("id").limit(1)
