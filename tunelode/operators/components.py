"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two joins on written edge tables; no task holds a component and the driver sees only two
totals a round.  A hub's edges meet only in equi-joins, which adaptive execution can split.

Rows that share keys needn't be nodes: a key stands for the least id that holds it, a row links the least ids of its
keys, and rows with equal keys give one link (`firsts`, `near`, `links`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a < b): link neighbours to the least one around each node."""
    pairs = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        pairs = pairs.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = pairs.join(least, "u")
    if large:
        linked = linked.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        linked = linked.select(F.col("m").alias("a"), F.col("v").alias("b")).union(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return linked.where("a < b").distinct()


def firsts(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """(k, a, n): every key in the columns `keys` of rows with an id, the least id that holds it, and how many rows do.

    Keys are texts that name their kind; NULL is none.
    """
    held = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.explode(F.array_compact(F.array(*keys))).alias("k"))
    return held.groupBy("k").agg(F.min("_id").alias("a"), F.count("*").alias("n"))


def near(rows: DataFrame, keys: list[str], shared: DataFrame, id_col: str = "id") -> DataFrame:
    """rows with `_near`, the ids `a` of their keys that are in shared (k, a), and `_first`, the least of them.

    Without such a key, `_first` is the row's own id.
    """
    ats = [f"_a{i}" for i in range(len(keys))]
    for key, at in zip(keys, ats, strict=True):
        # rows without the key are dealt by their id, not all to one task
        mine = F.coalesce(F.when(F.col(id_col).isNotNull(), F.col(key)), F.concat(F.lit("none:"), F.col(id_col).cast("string")))
        rows = rows.join(shared.select(F.col("k").alias("_k"), F.col("a").alias(at)), mine == F.col("_k"), "left").drop("_k")
    found = F.array_distinct(F.array_compact(F.array(*ats)))
    return rows.withColumn("_near", found).withColumn("_first", F.coalesce(F.array_min("_near"), id_col)).drop(*ats)


def links(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: the links between least ids that the rows of near() make, each once."""
    return rows.select(F.col("_first").alias("a"), F.explode("_near").alias("b")).where("a < b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Nulls and self-loops add nothing; repeated and reversed edges count once; no edges give no rows.
    """
    now = keep(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b")))
        .distinct(),
        "edges",
    )

    def totals(e: DataFrame) -> tuple:
        row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = totals(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = keep(_stars(_stars(now, True), False), "stars")
        new = totals(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
