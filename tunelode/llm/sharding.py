"""Minimax contiguous partition: shards of near equal bytes, equal texts together.

Texts are ordered by their SHA-256 digest.  The atomic units, in that order, are the 65,536 ranges of its first two
bytes: equal texts always share one, and their number doesn't grow with the data, so the driver's search is bounded.
The smallest feasible capacity is found by binary search with a greedy check; the cuts then go as near to equal sizes
as that capacity allows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import keep

UNITS = 1 << 16


def _needed(prefix: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the furthest end within capacity, and how many shards the greedy way takes from there on."""
    n = len(prefix) - 1
    reach = np.searchsorted(prefix, prefix + capacity, side="right") - 1
    need = np.zeros(n + 1, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        need[i] = 1 + need[reach[i]] if reach[i] > i else n + 1
    return reach, need


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least capacity with which the greedy way fills at most `shards` contiguous shards."""
    prefix = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    low, high = max(int(sizes.max(initial=0)), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        mid, at = (low + high) // 2, 0
        for _ in range(shards):
            at = int(np.searchsorted(prefix, prefix[at] + mid, side="right")) - 1
        low, high = (low, mid) if at == len(sizes) else (mid + 1, high)
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit.  No shard exceeds the smallest feasible capacity; each cut is the one nearest to an equal
    share of what is left that keeps the rest feasible."""
    prefix = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    n, total, at = len(sizes), int(prefix[-1]), 0
    reach, need = _needed(prefix, smallest_capacity(sizes, shards))
    out = np.zeros(n, dtype=np.int32)
    for k in range(shards):
        left = shards - k
        goal = prefix[at] + (total - prefix[at]) / left
        end = int(np.searchsorted(prefix, goal))
        if end > at and end <= n and goal - prefix[end - 1] < prefix[end] - goal:
            end -= 1
        end = min(max(end, at), int(reach[at]), n)
        while need[end] > left - 1:  # ends at reach[at], from where left - 1 shards are enough
            end += 1
        out[at:end] = k
        at = end
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, cell_rows: int = 256) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row.

    size is the text's UTF-8 bytes plus `overhead`; a null text has no bytes, CRC 0 and groups with other nulls.
    slot numbers a shard's rows from 0 without gaps, by hashed cells of about cell_rows rows, so neither a shard nor
    a group of copies is ever in one task.  Repeated rows get slots of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    digest = F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.lit("0" * 64))
    rows = keep(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(data) + overhead).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
            F.conv(F.substring(digest, 1, 4), 16, 10).cast("int").alias("unit"),
        ),
        "sized",
    )
    units = rows.groupBy("unit").agg(F.sum("size").alias("size"), F.count("*").alias("n")).toPandas().sort_values("unit")
    of = minimax_cuts(units["size"].to_numpy(dtype=np.int64), shards)
    cells = max(1, min(1_000_000, int(units["n"].sum()) // (shards * cell_rows)))
    table = spark.createDataFrame(list(zip(units["unit"].tolist(), of.tolist(), strict=True)), "unit int, shard int")
    placed = rows.join(F.broadcast(table), "unit").withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)))
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.join(base, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + at).alias("slot"))
