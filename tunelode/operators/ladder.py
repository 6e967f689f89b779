"""Searches in steps: each step sees only what the steps before left over, and none runs when nothing is left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, keep

Step = tuple[str, Callable[[DataFrame], DataFrame]]


@dataclass
class Climb:
    """rows: every wanted row's id, hit and outcome; seen: how many rows each step that ran was given; counts: rows by outcome."""

    rows: DataFrame
    seen: dict[str, int] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def summary(self) -> dict[str, int]:
        """already, matched, missed and total."""
        already, missed, total = self.counts.get("already", 0), self.counts.get("missed", 0), sum(self.counts.values())
        return {"already": already, "matched": total - already - missed, "missed": missed, "total": total}


def climb(wanted: DataFrame, steps: list[Step], hit_type: str = "string", already: Column | None = None, id_col: str = "id") -> Climb:
    """Find a hit for every wanted row by the first step that has one.

    A step takes the rows that are left and returns (id, hit); of several hits of a row the least counts, NULL is none.
    Rows whose `already` is not NULL have that as their hit and take no step.  What is left is written between steps, so a
    step's work grows with its own input only; ids are distinct.
    """
    spark = wanted.sparkSession
    have = F.lit(None).cast(hit_type) if already is None else already.cast(hit_type)
    rows = keep(wanted.withColumn("_have", have), "wanted")
    found = [rows.where("_have IS NOT NULL").select(id_col, F.col("_have").alias("hit"), F.lit("already").alias("outcome"))]
    counts = {"already": found[0].count()}
    left = rows.where("_have IS NULL").drop("_have")
    out, n_left, given = Climb(rows), left.count(), None
    for name, step in steps:
        if not n_left:
            break
        out.seen[name] = n_left
        hits = step(left).where("hit IS NOT NULL").groupBy(id_col).agg(F.min(F.col("hit").cast(hit_type)).alias("hit"))
        new = keep(left.select(id_col).join(hits, id_col).withColumn("outcome", F.lit(name)), "found")
        rest = keep(left.join(new.select(id_col), id_col, "left_anti"), "left")
        if given is not None:
            discard(spark, given)
        found.append(new)
        counts[name] = new.count()
        left, given = rest, rest
        n_left -= counts[name]
    found.append(left.select(id_col, F.lit(None).cast(hit_type).alias("hit"), F.lit("missed").alias("outcome")))
    counts["missed"] = n_left
    out.rows = found[0]
    for f in found[1:]:
        out.rows = out.rows.unionByName(f)
    out.counts = {k: n for k, n in counts.items() if n}
    return out
