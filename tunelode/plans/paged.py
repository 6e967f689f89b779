"""Queries on listings in pages, which Spark writes from conversations: each one a playlist, its turns the items."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import keep, shared_dir, ship
from ..sources import paged
from ..sources.views import read
from .registry import query


def _address(listing: Column, page: Column, buckets: int) -> Column:
    return F.concat(F.lit("pages/bucket="), F.pmod(F.hash(listing), F.lit(buckets)), F.lit("#"), listing, F.lit(":"), page)


def write_pages(rows: DataFrame, root: str, page_size: int, buckets: int) -> None:
    """Pages of rows (listing, place, item) in bundles, each page naming the next."""
    page = F.floor(F.col("place") / page_size)
    made = rows.groupBy("listing", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("rows"))
    last = F.lead("page").over(Window.partitionBy("listing").orderBy("page")).isNull()
    name = lambda k: F.concat("listing", F.lit(":"), (F.col("page") + k).cast("string"))
    following = F.when(last, "null").otherwise(F.concat(F.lit('"#'), name(1), F.lit('"')))
    items = F.array_join(F.transform("rows", lambda r: r["item"]), ",")
    line = F.concat(F.lit('{"key":"'), name(0), F.lit('","items":['), items, F.lit('],"next":'), following, F.lit("}"))
    lines = made.select(F.pmod(F.hash("listing"), F.lit(buckets)).alias("bucket"), line.alias("value"))
    lines.hint("rebalance", "bucket").write.partitionBy("bucket").text(f"{root}/pages")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    track = F.struct(
        F.when(F.col("role") != "system", F.concat_ws("-", "conv_id", "turn")).alias("id"), F.concat(F.lit("Turn "), "turn").alias("name"), F.col("chars").alias("duration_ms"),
        F.array(F.struct(F.col("role").alias("name"))).alias("artists"), (F.col("turn") % 5 == 4).alias("is_local"),
    )
    shapes = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(track.alias("track")))).otherwise(F.to_json(F.struct(track.alias("item"))))
    return c.select(F.concat(F.lit("c"), "conv_id").alias("listing"), place.alias("place"), shapes.alias("item"))


def _playlists(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").groupBy((F.col("conv_id") % 3).alias("owner"), "conv_id").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("owner").orderBy("conv_id")) - 1
    item = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("List "), "conv_id").alias("name"), F.struct("total").alias("tracks")))
    return c.select(F.concat(F.lit("u"), "owner").alias("listing"), place.alias("place"), item.alias("item"))


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations),
p AS (SELECT conv_id, count(*) AS total, row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id) - 1 AS place FROM conversations GROUP BY conv_id)
SELECT conv_id % 3 AS user_id, 'playlist' AS source, place, place // 4 AS page, conv_id || '-' || turn AS item_id, 'Turn ' || turn AS title, role AS artist, length(text)::BIGINT AS duration_ms, NULL::BIGINT AS total
FROM t WHERE place < 7 AND role <> 'system' AND turn % 5 <> 4
UNION ALL SELECT conv_id % 3, 'playlists', place, place // 50, conv_id::VARCHAR, 'List ' || conv_id, NULL, NULL, total FROM p WHERE place < 200""")
def paged_library(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's list of playlists, at most 200, and the first 7 items of every playlist, by the paged source."""
    ship(spark)
    root = f"{shared_dir(spark)}/tunelode/{uuid.uuid4().hex}"
    c = keep(read(spark, sf, "conversations").select("conv_id", (F.col("conv_id") % 3).alias("user_id")).distinct(), "listings")
    buckets = 1 + c.count() // 500
    write_pages(_items(spark, sf), f"{root}/lists", 4, buckets)
    write_pages(_playlists(spark, sf), f"{root}/users", 50, 1)
    lists = c.select(F.concat(F.lit("lists/"), _address(F.concat(F.lit("c"), "conv_id"), F.lit("0"), buckets)).alias("url"), F.lit("playlist").alias("kind"), F.lit("playlist").alias("source"), "user_id", F.lit(7).alias("max_items"))
    users = c.select("user_id").distinct().select(F.concat(F.lit("users/"), _address(F.concat(F.lit("u"), "user_id"), F.lit("0"), 1)).alias("url"), F.lit("playlists").alias("kind"), F.lit("playlists").alias("source"), "user_id", F.lit(None).cast("int").alias("max_items"))
    lists.union(users).orderBy("url").write.json(f"{root}/index")
    spark.dataSource.register(paged.PagedLibrary)
    found = spark.read.format("paged_library").option("path", root).option("listings", 250).load()
    return found.select("user_id", "source", "place", F.col("page").cast("long").alias("page"), "item_id", "title", "artist", "duration_ms", "total")
