"""File sources and sinks: typed CSV, append-only logs with line numbers, listings, JSON exports and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import keep

MANIFEST = "track_id string, status string, preview_url string, bytes long, attempted_at string"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header: typed by a schema, else all text; an unnamed first column is dropped."""
    rows = spark.read.option("header", True)
    df = (rows.schema(schema) if schema else rows).csv(path)
    return df.drop(df.columns[0]) if df.columns and df.columns[0] in ("", "_c0", "Unnamed: 0") else df


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """An append-only CSV log with line_no, which rises with the files' times, their names and the rows' places in a file.

    Files that are appended have random names, so their times tell which came later.
    """
    raw = spark.read.option("header", True).schema(MANIFEST).csv(path)
    place = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return raw.select("*", place.alias("line_no"))


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines of a one-header text file, without the header."""
    return max(0, spark.read.text(path).count() - 1)


def list_files(spark: SparkSession, path: str, pattern: str, least: int = 10_000) -> DataFrame:
    """(track_id, length) of files larger than `least` bytes; contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    return files.where(F.col("length") > least).select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("track_id"), "length")


def list_tree(spark: SparkSession, *roots: str, tasks: int = 64) -> DataFrame:
    """(path, name, length) of all files under some folders, by names and lengths alone.

    Folders are listed by tasks, a level of the tree at a time, so the driver holds neither files nor folders; the file
    systems are those that Arrow knows.  A folder that isn't there has no files.
    """
    from .listing import ENTRY, entries

    level = spark.createDataFrame([(r,) for r in roots], "path string")
    files = None
    while True:
        seen = keep(level.repartition(tasks, "path").mapInPandas(entries, ENTRY), "listing")
        here = seen.where("NOT is_folder").select("path", "name", "length")
        files = here if files is None else files.unionByName(here)
        level = seen.where("is_folder").select("path")
        if level.isEmpty():
            return files


def downloaded(files: DataFrame, suffix: str = ".mp3", least: int = 10_000) -> DataFrame:
    """(track_id, length) of listed files with a suffix and more than `least` bytes."""
    some = files.where(F.col("name").endswith(suffix) & (F.col("length") > least))
    return some.select(F.expr(f"substr(name, 1, length(name) - {len(suffix)})").alias("track_id"), "length")


def read_tracks_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested track documents, flattened by first elements; local items and items without an id go."""
    item = "struct<id:string,name:string,artists:array<struct<name:string>>,album:struct<name:string,images:array<struct<url:string>>>,duration_ms:bigint,external_ids:struct<isrc:string>,preview_url:string,is_local:boolean>"
    rows = spark.read.schema(f"track {item}, item {item}").json(path).select(F.coalesce("track", "item").alias("t"))
    rows = rows.where("t.id IS NOT NULL AND NOT coalesce(t.is_local, false)")
    first = lambda c, f: F.try_element_at(F.col(c), F.lit(1))[f]
    return rows.select(
        F.col("t.id").alias("spotify_id"), F.col("t.name").alias("title"), first("t.artists", "name").alias("artist"), F.col("t.album.name").alias("album"),
        first("t.album.images", "url").alias("artwork_url"), F.col("t.duration_ms").alias("duration_ms"), F.col("t.external_ids.isrc").alias("isrc"), F.col("t.preview_url").alias("preview_url"),
    )


def write_report(metrics: DataFrame, path: str) -> None:
    """A metrics table as one CSV file."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
