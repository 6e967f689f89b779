"""Regression metrics, baselines, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import keep


def numbered(df: DataFrame, order: str, weight: str | None = None, out: str = "place") -> DataFrame:
    """df with running numbers from 1 in an order (or running sums of a weight), over sorted ranges.

    Rows are dealt by ranges of the order column and written; only one total a range is summed in one place.
    """
    cut = keep(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    add = F.lit(1) if weight is None else F.col(weight)
    totals = cut.groupBy("_p").agg(F.sum(add).alias("_t"))
    before = F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("_p", F.coalesce(before, F.lit(0)).alias("_b"))
    inside = F.sum(add).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(out, inside).join(F.broadcast(base), "_p").withColumn(out, F.col(out) + F.col("_b")).drop("_p", "_b")


def average_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """Ranks of a column, ties sharing their mean; values are counted first and numbered by ranges."""
    n = df.groupBy(col).agg(F.count("*").alias("_n"))
    ranks = numbered(n, col, "_n").select(F.col(col).alias("_v"), (F.col("place") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(col) == F.col("_v")).drop("_v")


def regression_metrics(pred: DataFrame, truth: str = "y", guess: str = "p") -> DataFrame:
    """One row: n, rmse, mae, r2, pearson and spearman."""
    err = F.col(guess) - F.col(truth)
    ranked = average_rank(average_rank(pred, truth, "_ry"), guess, "_rp")
    return ranked.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (1 - F.sum(err * err) / (F.var_pop(truth) * F.count("*"))).alias("r2"), F.corr(truth, guess).alias("pearson"), F.corr("_ry", "_rp").alias("spearman"),
    )


def baseline(train: DataFrame, test: DataFrame, truth: str = "y") -> DataFrame:
    """Errors on test of always guessing train's mean."""
    err = F.col(truth) - F.col("_mean")
    return test.crossJoin(F.broadcast(train.agg(F.avg(truth).alias("_mean")))).agg(F.sqrt(F.avg(err * err)).alias("base_rmse"), F.avg(F.abs(err)).alias("base_mae"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of equal bins from low to high; values outside fall into the first or last."""
    at = F.least(F.greatest(F.floor((value - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def group_split(df: DataFrame, group: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """df with `split`: whole groups go to train, val or test by a hash order of the groups; NULL is a group."""
    name = F.coalesce(F.col(group), F.lit("__unknown__"))
    ranked = numbered(df.select(name.alias("_g")).distinct().withColumn("_h", F.md5(F.col("_g").cast("binary"))), "_h")
    share = (F.col("place") - 1) / F.col("_groups")
    n = ranked.agg(F.count("*").alias("_groups"))
    split = ranked.crossJoin(F.broadcast(n)).select("_g", F.when(share < train, "train").when(share < train + val, "val").otherwise("test").alias("split"))
    return df.withColumn("_k", name).join(split, F.col("_k") == F.col("_g")).drop("_k", "_g")


def seeded_sample(df: DataFrame, n: int, id_col: str, seed: str) -> DataFrame:
    """n rows without replacement, or all of fewer, by a hash of the id."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(seed)).cast("binary")), id_col).limit(n)
