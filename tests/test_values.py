"""Edge values of the client's scalars, headers, lists and write-backs."""

from pyspark.sql import functions as F

from tunelode.functions import client, text
from tunelode.operators import changes, identity


def test_filled_tells_texts_from_numbers(spark):
    row = spark.sql("SELECT '0' AS s, '' AS e, 0 AS i, 0.0D AS d, 0.00BD AS m, 10 AS t, false AS b")
    got = row.select(*[text.filled(F.col(c)).alias(c) for c in row.columns]).first()
    assert got.s == "0" and got.t == 10 and [got.e, got.i, got.d, got.m, got.b] == [None] * 5


def test_lists_stamps_and_ids(spark):
    rows = spark.createDataFrame([("-5, +7 ,4x,,9", "2024-03-01T10:00:05Z", "x" * 22, "try Spotify abcdefghijklmnopqrstuv"), (None, None, None, None)], "l string, t string, b string, u string")
    got = rows.select(text.int_list(F.col("l")).alias("l"), text.epoch(F.col("t")).alias("t"), text.playlist_id(F.col("b")).alias("b"), text.playlist_id(F.col("u")).alias("u")).collect()
    assert got[0].l == [-5, 7, 9] and got[0].t == 1709287205 and got[0].b == "x" * 22 and got[0].u == "abcdefghijklmnopqrstuv"
    assert (got[1].t, got[1].b, got[1].u) == (0, None, None)


def test_byte_ranges(spark):
    heads = ["bytes=0-9", "bytes=90-", "bytes=-200", "bytes=-0", "bytes=-", "bytes=100-", "bytes=5-100", "bytes=9-5", None, "bytes=99999999999999999999-5", "bytes=-99999999999999999999", "bytes=5-99999999999999999999", "bytes=0000000000000000000005-7", "bytes=--5"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string")
    got = [r.r and tuple(r.r) for r in rows.orderBy("i").select(client.byte_range(F.col("h"), F.lit(100)).alias("r")).collect()]
    assert got == [(0, 10), (90, 10), (0, 100), None, None, None, None, None, None, None, (0, 100), None, (5, 3), None]


def test_percents_and_labels(spark):
    rows = spark.createDataFrame([(1.5, "ada lovelace king"), (float("nan"), " "), (None, None), (-2.0, "bo")], "v double, n string")
    v = F.col("v")
    got = rows.select(client.percent(v).alias("p"), client.percent_of(v, F.lit(4.0), signed=True).alias("m"), client.lean(v).alias("l"), client.initials(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(100.0, 37.5, "major-leaning", "AK"), (None, None, "", "?"), (None, None, "", "?"), (0.0, 50.0, "minor-leaning", "B")]


def test_best_image_ties_and_nothing(spark):
    rows = spark.createDataFrame([(1, [("a", 2, 2), ("b", 4, 1), (None, 9, 9)]), (2, []), (3, None)], "i int, t array<struct<url:string,width:int,height:int>>")
    assert [r.u for r in rows.orderBy("i").select(client.best_image(F.col("t"), F.lit("none")).alias("u")).collect()] == ["a", "none", "none"]


def test_update_and_first_of_equal_keys(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "t0")], "id int, x string, updated_at string")
    new = spark.createDataFrame([(1, None), (3, "c")], "id int, x string")
    assert sorted(map(tuple, changes.update(old, new, "id", F.lit("t1")).collect())) == [(1, None, "t1"), (2, "b", "t0")]
    links, more = spark.createDataFrame([(1, "old", 0)], "k int, s string, n int"), spark.createDataFrame([(1, "x", 1), (2, "z", 2), (2, "y", 3)], "k int, s string, n int")
    assert sorted(map(tuple, changes.insert_or_ignore(links, more, ["k"], "n").collect())) == [(1, "old", 0), (2, "z", 2)]
    keyed = spark.createDataFrame([(1, None), (2, None), (3, "k"), (4, "k")], "id int, key string")
    assert [r.key for r in identity.unique_key(keyed, "key").orderBy("id").collect()] == [None, None, "k", None]
