"""Vectors as arrays of doubles: statistics, cropping, correlation and musical key profiles, all in higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Krumhansl-Kessler key profiles.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return total(x) / F.nullif(F.size(x), F.lit(0))


def std(x: Column) -> Column:
    """Population standard deviation."""
    m = mean(x)
    return F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m))))


def max_abs(x: Column, least: float = 0.0) -> Column:
    return F.greatest(F.lit(least), F.array_max(F.transform(x, F.abs)))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays, with 1e-12 added to the denominator."""
    ma, mb = mean(a), mean(b)
    da, db = F.transform(a, lambda v: v - ma), F.transform(b, lambda v: v - mb)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    return dot(da, db) / (F.sqrt(dot(da, da) * dot(db, db)) + 1e-12)


def _rolled(profile: tuple[float, ...], k: int) -> Column:
    return F.array(*[F.lit(profile[(i - k) % 12]) for i in range(12)])


def key_mode(chroma: Column) -> Column:
    """Best major minus best minor correlation over twelve rotations, within -1 to 1; 0 unless there are 12 numbers."""
    best = lambda p: F.greatest(*[pearson(chroma, _rolled(p, k)) for k in range(12)])
    clipped = F.least(F.greatest(best(MAJOR) - best(MINOR), F.lit(-1.0)), F.lit(1.0))
    return F.when(F.size(chroma) == 12, clipped).otherwise(0.0)


def crop_or_pad(x: Column, n: int) -> Column:
    """The middle n numbers, or all and zeros after them."""
    start = F.floor((F.size(x) - n) / 2).cast("int") + 1
    return F.when(F.size(x) >= n, F.slice(x, F.greatest(start, F.lit(1)), n)).otherwise(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(x), F.lit(0)))))


def peak_normalised(x: Column) -> Column:
    """Divided by the largest magnitude, where that isn't 0."""
    peak = max_abs(x)
    return F.when(peak > 0, F.transform(x, lambda v: v / peak)).otherwise(x)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, and not once for each number of a lambda over it."""
    return F.transform(F.array(value), use)[0]


def dataset_item(x: Column, least: int, most: int, crop: int, gain_db: Column | float = 0.0) -> Column:
    """A training item of a signal: NULL where it is shorter than `least`; else its first `most` numbers, the middle `crop` of
    them or all and zeros, times a gain in decibels, and divided by the largest magnitude where that is over 1."""
    gain = F.pow(F.lit(10.0), (F.lit(gain_db) if isinstance(gain_db, (int, float)) else gain_db) / 20.0)
    cut = _let(gain, lambda g: F.transform(crop_or_pad(F.slice(x, 1, most), crop), lambda v: v * g))
    item = _let(cut, lambda c: _let(max_abs(c, 1.0), lambda peak: F.transform(c, lambda v: v / peak)))
    return F.when(F.size(x) >= least, item)


def seeded_gain(id_col: Column, seed: str, db: float) -> Column:
    """A gain in decibels between -db and db that looks random and is the same on every run."""
    part = F.conv(F.substring(F.md5(F.concat(id_col.cast("string"), F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("double")
    return (part / float(0xFFFFFFFF) * 2 - 1) * db
