"""Edge rows of the library operators, and the entry without the corpus subpackage."""

import math
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tunelode.functions import arrays, scoring, text
from tunelode.operators import changes, components, evaluation, library, manifest
from tunelode.sources import files

REPO = Path(__file__).resolve().parent.parent


def test_components_of_chains_and_loops(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (9, 8), (8, 9), (5, 5), (None, 4), (3, 4)], "a long, b long")
    assert sorted(map(tuple, components.connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    assert components.connected_components(edges.where("false")).count() == 0


def test_scores_of_null_and_nan(spark):
    row = ", ".join(f"cast(NULL AS double) AS {c}" if c != "tempo" else "double('NaN') AS tempo" for c in scoring.FEATURES)
    got = spark.sql(f"SELECT {row}").select(scoring.activation().alias("a"), scoring.valence().alias("v")).first()
    assert got.a == 0.0 and abs(got.v - 60.0) < 1e-9
    labels = spark.createDataFrame([(20.0, 50.0), (40.0, 49.9), (60.0, None), (80.0, 0.0), (None, 1.0)], "a double, v double")
    assert [r.m for r in labels.select(scoring.mood(F.col("a"), F.col("v")).alias("m")).collect()] == ["chill", "moody", "hype", "beast", None]
    one = scoring.standardised(spark.createDataFrame([(7.0,)], "activation double"))
    assert one.first().activation_relative == 50.0


def test_exclusion_of_null_ids(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id long, apple_id long")
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert ids(library.not_excluded(rows, [5])) == [3] and ids(library.not_excluded(rows, [5], True)) == [2, 3] and ids(library.not_excluded(rows, [])) == [1, 2, 3]


def test_parsing(spark):
    df = spark.createDataFrame([("a=1; b=x=y;; bare; a=", "12,x, 7 ,,", "abcdefghijk\n")], "c string, l string, v string")
    got = df.select(text.pairs(F.col("c")).alias("p"), text.int_list(F.col("l")).alias("l"), text.is_video_id(F.col("v")).alias("v")).first()
    assert [tuple(p) for p in got.p] == [("a", "1"), ("b", "x=y"), ("a", "")] and got.l == [12, 7] and got.v is False


def test_key_mode_edges(spark):
    rows = spark.createDataFrame([([1.0] * 11,), ([0.0] * 12,), (list(arrays.MAJOR),)], "c array<double>")
    got = [r.m for r in rows.select(arrays.key_mode(F.col("c")).alias("m")).collect()]
    assert got[0] == 0.0 and abs(got[1]) < 1e-9 and got[2] > 0.2


def test_manifest_last_row_wins(spark, tmp_path):
    log = spark.createDataFrame([(1, "download_failed", 1), (1, "ok", 2), (2, "no_preview", 3), (3, "ok", 4), (3, "download_failed", 5)], "track_id long, status string, line_no long")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "track_id long")
    todo = lambda retry: sorted(r.track_id for r in manifest.todo(ids, log, retry).collect())
    assert todo(False) == [3, 4] and todo(True) == [2, 3, 4]
    (tmp_path / "m.csv").write_text("track_id,status,preview_url,bytes,attempted_at\na,download_failed,,,t\na,ok,u,5,t\n")
    assert manifest.latest(files.read_manifest(spark, f"file://{tmp_path}/m.csv")).first().status == "ok"
    assert files.count_rows(spark, f"file://{tmp_path}/m.csv") == 2


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "s1", 5, "x"), (2, None, 6, "y")], "id long, spotify_id string, apple_id long, title string")
    new = spark.createDataFrame([(1, "s1", None, "X"), (2, "", 6, "Y"), (3, "s9", 0, "Z")], "new_id long, spotify_id string, apple_id long, title string")
    once = changes.upsert(old, new)
    rows = sorted(map(str, once.collect()))
    assert once.count() == 3 and {r.title for r in once.collect()} == {"X", "Y", "Z"}
    assert sorted(map(str, changes.upsert(once, new.where("spotify_id <> ''")).collect())) == rows


def test_average_ranks_and_split(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 3, 2, 3)], "v double")
    assert sorted((r.v, r.rank) for r in evaluation.average_rank(df, "v", "rank").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]
    groups = spark.range(400).select((F.col("id") % 21).cast("string").alias("g")).withColumn("g", F.when(F.col("g") != "0", F.col("g")))
    parts = evaluation.group_split(groups, "g").groupBy("g").agg(F.count_distinct("split").alias("n")).collect()
    assert len(parts) == 21 and all(r.n == 1 for r in parts)
    flat = evaluation.regression_metrics(spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "y double, p double")).first()
    assert math.isclose(flat.rmse, 1.0) and math.isclose(flat.spearman, 1.0)


def test_entry_without_the_corpus_part():
    code = "import importlib.util as u, sys; f = u.find_spec; u.find_spec = lambda n, *a: None if n in ('tunelode.llm', 'corpus_pipeline') else f(n, *a); import __spark_entry__ as e; assert len(e.queries()) > 50 and not [n for n in e.queries() if n.startswith('op')]; assert 'tunelode.llm' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
