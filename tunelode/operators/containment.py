"""Which texts hold which others: an inverted index of character grams in place of a comparison of all pairs.

Where a text holds another, it holds each of its grams.  So a wanted row probes only the postings of its rarest gram, over
all of its fields, and what is found there is compared in full.  Texts shorter than a gram are grams themselves, and such
short ones are indexed only where a wanted text is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, q: int) -> Column:
    """Distinct stretches of q characters; a shorter text is its own one, an empty one has none."""
    size = F.length(text)
    cut = F.when(size >= q, F.transform(F.sequence(F.lit(1), F.greatest(size - q + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(q))))
    return F.array_distinct(F.coalesce(cut, F.when(size > 0, F.array(text)), F.array().cast("array<string>")))


def _short(text: Column, q: int) -> Column:
    """Distinct stretches of 1 to q - 1 characters."""
    if q < 2:
        return F.array().cast("array<string>")

    def of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(k)))

    each = [of(k) for k in range(1, q)]
    return F.array_distinct(F.concat(*each))


def _exploded(rows: DataFrame, fields: list[str], of) -> DataFrame:  # noqa: ANN001 - a function of a column
    parts = [rows.select("id", F.lit(n).alias("field"), F.explode(of(F.col(c))).alias("gram")) for n, c in enumerate(fields)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _keyed(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The distinct texts of rows, with a digest for each; without those that have a NULL."""
    some = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in fields)).select(*fields).distinct()
    return some.withColumn("id", F.unhex(F.sha2(F.to_json(F.array(*fields)), 256)))


def candidates(wanted: DataFrame, texts: DataFrame, fields: list[str], q: int = 4) -> DataFrame:
    """(asked, found): digests of distinct texts, where the found one holds the rarest gram of the asked one."""
    probes = _exploded(wanted, fields, lambda c: grams(c, q))
    short = probes.where(F.length("gram") < q).select("field", "gram").distinct()
    whole = _exploded(texts, fields, lambda c: F.filter(grams(c, q), lambda g: F.length(g) == q))
    brief = _exploded(texts, fields, lambda c: _short(c, q)).join(short, ["field", "gram"], "left_semi")
    postings = whole.unionByName(brief)
    counts = postings.groupBy("field", "gram").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))  # a gram that no text has rules the asked one out
    rated = probes.join(counts, ["field", "gram"], "left").groupBy("id").agg(F.min_by(F.struct("field", "gram"), F.struct(n, "field", "gram")).alias("rare"), F.min(n).alias("n"))
    rare = rated.where("n > 0").select(F.col("id").alias("asked"), "rare.field", "rare.gram")
    return rare.join(postings, ["field", "gram"]).select("asked", F.col("id").alias("found"))


def containing(wanted: DataFrame, texts: DataFrame, fields: list[str], q: int = 4) -> DataFrame:
    """(w_ fields, t_ fields): every distinct wanted row of texts beside every distinct row of texts that holds all of it,
    field by field; what rows have these texts is for the caller to join, so that copies make no pairs.

    Texts are compared as they are.  A row with a NULL finds nothing and is not found; nor does a wanted row with an empty
    text find anything.
    """
    asked = _keyed(wanted.where(" AND ".join(f"`{c}` <> ''" for c in fields)), fields)
    there = _keyed(texts, fields)
    w = asked.select(F.col("id").alias("asked"), *[F.col(c).alias(f"w_{c}") for c in fields])
    t = there.select(F.col("id").alias("found"), *[F.col(c).alias(f"t_{c}") for c in fields])
    met = candidates(asked, there, fields, q).join(w, "asked").join(t, "found")
    for c in fields:
        met = met.where(F.contains(F.col(f"t_{c}"), F.col(f"w_{c}")))
    return met.drop("asked", "found")
