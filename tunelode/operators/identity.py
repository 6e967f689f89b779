"""Which records are the same item: keys, components over shared ids, canonical rows and merged values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import dedup_key, epoch, filled, item_keys, source_rank
from ..session import keep
from .components import connected_components, firsts, links, near


def shared_key_edges(tracks: DataFrame, keys: tuple[str, ...] = ("apple_id", "spotify_id", "isrc"), id_col: str = "id") -> DataFrame:
    """(a, b): each record and the least one with an equal key; chains, so a key of n records gives n - 1 edges."""
    edges = None
    for k in (*keys, "_dedup"):
        value = dedup_key() if k == "_dedup" else filled(F.col(k))
        keyed = tracks.select(F.col(id_col).alias("b"), value.cast("string").alias("k")).where("k IS NOT NULL")
        least = keyed.groupBy("k").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1").select("k", "a")
        pairs = keyed.join(least, "k").where("a < b").select("a", "b")
        edges = pairs if edges is None else edges.union(pairs)
    return edges.distinct()


def groups(tracks: DataFrame, id_col: str = "id") -> DataFrame:
    """tracks with group_id, the least id of the records that are the same item."""
    # an id that several rows have is a key as well
    keys = dict(enumerate([*item_keys(), F.concat(F.lit("id:"), F.col(id_col).cast("string"))]))
    rows, names = tracks.withColumns({f"_key{i}": k for i, k in keys.items()}), [f"_key{i}" for i in keys]
    rows = near(rows, names, keep(firsts(rows, names, id_col).where("n > 1"), "firsts"), id_col)
    found = connected_components(links(rows)).select(F.col("node").alias("_node"), "component")
    return rows.join(found, F.col("_first") == F.col("_node"), "left").withColumn("group_id", F.coalesce("component", "_first")).select(*tracks.columns, "group_id")


def _order() -> list:
    return [F.desc(source_rank(F.col("classification_source"))), F.desc(epoch(F.col("created_at"))), F.asc("id")]


def canonical(grouped: DataFrame) -> DataFrame:
    """The best record of each group: surest source, then latest, then least id."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(*_order()))
    return grouped.withColumn("_n", rank).where("_n = 1").drop("_n")


def merged(grouped: DataFrame, columns: list[str]) -> DataFrame:
    """(group_id, canonical_id, n_records, columns...): each value from the first record that has one.

    One grouped aggregate with min_by over the record order; '' and NULL are no values.
    """
    place = F.struct(-source_rank(F.col("classification_source")), -epoch(F.col("created_at")), F.col("id"))
    value = [F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("_place"))).alias(c) for c in columns]
    return grouped.withColumn("_place", place).groupBy("group_id").agg(F.min_by("id", "_place").alias("canonical_id"), F.count("*").alias("n_records"), *value)


def unique_key(rows: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """The key stays on the least id that has it and becomes NULL on the others; rows without a key aren't gathered."""
    alone = F.when(F.col(key).isNull(), F.col(id_col))
    first = F.row_number().over(Window.partitionBy(F.col(key), alone).orderBy(id_col)) == 1
    return rows.withColumn(key, F.when(F.col(key).isNotNull() & first, F.col(key)))


def remapped(links: DataFrame, grouped: DataFrame) -> DataFrame:
    """Links (user_id, track_id) carried over to the merged records, each once."""
    new = grouped.select(F.col("id").alias("track_id"), "group_id")
    return links.join(new, "track_id").select("user_id", F.col("group_id").alias("track_id")).distinct()
