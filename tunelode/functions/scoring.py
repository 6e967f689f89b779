"""Scores of items from numeric features: axes, labels and the library-wide normalisation.  Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("tempo", "energy", "energy_mean", "energy_std", "brightness", "onset_rate", "tempo_stability", "valence_mode", "flatness", "spectral_contrast", "acousticness")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def feature(name: str) -> Column:
    """A feature as double; NULL and NaN are 0."""
    x = F.col(name).cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))


def _terms() -> dict[str, Column]:
    energy = F.coalesce(F.col("energy_mean"), F.col("energy")).cast("double")
    energy = F.coalesce(F.when(~F.isnan(energy), energy), F.lit(0.0))
    f = feature
    return {k: clamp(x, 0.0, 1.0) for k, x in {
        "tempo": (f("tempo") - 60.0) / 120.0, "energy": energy / 0.15, "dynamics": f("energy_std") * 8.0,
        "drive": f("tempo_stability") * f("onset_rate") / 10.0, "bright": (f("brightness") - 500.0) / 3500.0, "onset": f("onset_rate") / 3.0,
        "acoustic": f("acousticness"), "mode": (f("valence_mode") + 1.0) / 2.0, "flat": f("flatness") * 10.0, "contrast": f("spectral_contrast") / 30.0,
    }.items()}


def activation() -> Column:
    t = _terms()
    return 100.0 * (0.30 * t["energy"] + 0.25 * t["tempo"] + 0.20 * t["drive"] + 0.10 * t["onset"] + 0.10 * t["bright"] + 0.05 * t["dynamics"])


def valence() -> Column:
    t = _terms()
    return 100.0 * (0.50 * t["mode"] + 0.20 * (1.0 - t["flat"]) + 0.15 * t["contrast"] + 0.15 * (1.0 - 0.5 * t["acoustic"]))


def mood(a: Column, v: Column) -> Column:
    """Label of a point on both axes; without a valence the first label of each band."""
    high = v.isNull() | (v >= 50)
    return (
        F.when(a.isNull(), None).when(a < 20, "sleep").when(a < 40, F.when(high, "chill").otherwise("melancholy"))
        .when(a < 60, F.when(high, "steady").otherwise("moody")).when(a < 80, F.when(high, "hype").otherwise("aggressive")).otherwise("beast")
    )


def vibe_bucket(v: Column) -> Column:
    """Five bands of a score; 100 belongs to the last."""
    return F.when(v.isNull(), None).when(v < 20, "sleep").when(v < 40, "chill").when(v < 60, "steady").when(v < 80, "hype").otherwise("beast")


def effective_vibe() -> Column:
    """The predicted score as 0 to 100 if there is one, else the formula's."""
    return F.coalesce(F.col("vibe_score_ml") * 100.0, F.col("vibe_score"))


def predicted_vibe() -> Column:
    return 0.55 * F.coalesce("energy_pred", F.lit(0.0)) + 0.45 * F.coalesce("danceability_pred", F.lit(0.0))


def standardised(scored: DataFrame, by: str = "activation", out: str = "activation_relative", few: int = 1) -> DataFrame:
    """50 + 15 z of a column over all rows, within 0 to 100; fewer than `few` rows or no spread give 50.

    One global aggregate of a single row is joined back, so no window gathers the table in a task.
    """
    stats = scored.agg(F.avg(by).alias("_mean"), F.stddev_pop(by).alias("_std"), F.count(by).alias("_n"))
    z = clamp(50.0 + (F.col(by) - F.col("_mean")) / F.col("_std") * 15.0, 0.0, 100.0)
    flat = (F.col("_std") <= 1e-9) | (F.col("_n") < few)
    value = F.when(F.col(by).isNotNull(), F.when(flat, 50.0).otherwise(z))
    return scored.crossJoin(F.broadcast(stats)).withColumn(out, value).drop("_mean", "_std", "_n")
