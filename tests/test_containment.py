"""The containment join against a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tunelode.operators import containment

SCHEMA = "id long, title string, artist string, n int"


def table(n, seed, longest):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(longest)))
    return [(i, rng.choice([None, word(), word(), word()]), word() + rng.choice(["", "x" * rng.randrange(9)]), 0) for i in range(n)]


@pytest.mark.parametrize("q", [1, 2, 3, 5])
def test_equals_all_pairs(spark, q):
    wanted, texts = table(120, 1, 6), table(200, 2, 14)
    want = {
        (w[1], w[2], t[1], t[2]) for w in wanted for t in texts
        if w[1] and w[2] and t[1] is not None and t[2] is not None and w[1] in t[1] and w[2] in t[2]
    }
    got = containment.containing(spark.createDataFrame(wanted, SCHEMA), spark.createDataFrame(texts, SCHEMA), ["title", "artist"], q).select("w_title", "w_artist", "t_title", "t_artist").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 20


def test_copies_make_no_pairs_and_the_rarest_gram_probes(spark):
    texts = spark.range(4000).select("id", F.when(F.col("id") < 3000, "the same old song").otherwise(F.concat(F.lit("the song of "), "id")).alias("title"), F.lit("band").alias("artist"))
    wanted = spark.range(2000).select("id", F.when(F.col("id") < 1900, "song").otherwise(F.concat(F.lit("song of "), F.col("id") + 1500)).alias("title"), F.lit("band").alias("artist"))
    fields = ["title", "artist"]
    asked, there = containment._keyed(wanted, fields), containment._keyed(texts, fields)
    assert asked.count() == 101 and there.count() == 1001
    met = containment.candidates(asked, there, fields).groupBy("asked").count()
    assert met.orderBy(F.desc("count")).limit(2).collect()[1]["count"] <= 101  # 'song' alone meets all
    assert containment.containing(wanted, texts, fields).count() == 1001 + 100


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a", "b", 0)], SCHEMA)
    for w, t in ((none, none), (none, some), (some, none)):
        assert containment.containing(w, t, ["title", "artist"]).count() == 0
