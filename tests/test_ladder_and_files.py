"""Searches in steps, listings of sparse files, logs over several files, and the other file sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from tunelode.functions import arrays, text
from tunelode.operators import changes, ladder, manifest
from tunelode.sources import files


def climbed(spark, rows, *steps, **more):
    return ladder.climb(spark.createDataFrame(rows, "id long, have string, a string, b string"), list(steps), already=text.filled(F.col("have")), **more)


def by(spark, col, table):
    known = spark.createDataFrame(table, "k string, hit string")
    return lambda left: left.join(known, F.col(col) == F.col("k")).select("id", "hit")


ROWS = [(1, "x1", "p", "q"), (2, None, "p", "q"), (3, "", "none", "q"), (4, None, None, "r"), (5, None, "p", None), (6, None, None, None)]


def test_each_step_sees_only_what_is_left(spark):
    got = climbed(spark, ROWS, ("code", by(spark, "a", [("p", "P2"), ("p", "P1"), ("none", None)])), ("name", by(spark, "b", [("q", "Q")])))
    assert got.seen == {"code": 5, "name": 3}
    assert got.counts == {"already": 1, "code": 2, "name": 1, "missed": 2}
    assert got.summary() == {"already": 1, "matched": 3, "missed": 2, "total": 6}
    assert sorted(map(tuple, got.rows.collect())) == [(1, "x1", "already"), (2, "P1", "code"), (3, "Q", "name"), (4, None, "missed"), (5, "P1", "code"), (6, None, "missed")]


def test_no_step_runs_when_nothing_is_left(spark):
    def never(left):
        raise AssertionError

    got = climbed(spark, ROWS[:2], ("code", by(spark, "a", [("p", "P")])), ("name", never))
    assert got.seen == {"code": 1} and got.summary() == {"already": 1, "matched": 1, "missed": 0, "total": 2}
    assert climbed(spark, ROWS[:1], ("name", never)).counts == {"already": 1}
    assert climbed(spark, [], ("name", never)).rows.count() == 0


def sparse(path, size):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        f.truncate(size)


def test_listing_of_sparse_files(spark, tmp_path):
    for name, size in (("a/1.mp3", 10_000), ("a/2.mp3", 10_001), ("b/c/d/3.mp3", 5 << 30), ("b/4.wav", 20_000), ("5.mp3", 0), ("b/x.y.mp3", 10_001)):
        sparse(tmp_path / name, size)
    root = f"file://{tmp_path}"
    found = files.list_tree(spark, root, f"{root}/not there", tasks=3)
    assert {(r.path.removeprefix(root + "/"), r.length) for r in found.collect()} == {("a/1.mp3", 10_000), ("a/2.mp3", 10_001), ("b/c/d/3.mp3", 5 << 30), ("b/4.wav", 20_000), ("5.mp3", 0), ("b/x.y.mp3", 10_001)}
    there = files.downloaded(found)
    assert {(r.track_id, r.length) for r in there.collect()} == {("2", 10_001), ("3", 5 << 30), ("x.y", 10_001)}
    assert {r.track_id for r in files.list_files(spark, f"{root}/a", "*.mp3").collect()} == {"2"}
    log = spark.createDataFrame([("1", "ok", 1), ("2", "ok", 2), ("2", "download_failed", 3), ("9", "no_preview", 4)], "track_id string, status string, line_no long")
    assert sorted(map(tuple, manifest.reconciled(log, there).collect())) == [("1", "ok", False), ("2", "ok", True), ("3", "ok", True), ("9", "no_preview", False), ("x.y", "ok", True)]
    assert files.list_tree(spark, f"{root}/a/none").count() == 0


def test_later_files_of_a_log_win(spark, tmp_path):
    import os

    path = f"file://{tmp_path}/log"
    line = lambda key, status: spark.createDataFrame([(key, status, None, None, "2024-01-01T00:00:00")], files.MANIFEST).coalesce(1)
    for status in ("download_failed", "no_preview", "ok", "download_failed"):
        files.append_manifest(line("b", status), path)
        for f in (tmp_path / "log").glob("part-*"):  # as if each came a second after the one before
            os.utime(f, (os.stat(f).st_atime, os.stat(f).st_mtime - 1))
    files.append_manifest(line("a", "ok"), path)
    log = files.read_manifest(spark, path)
    assert {r.track_id: r.status for r in manifest.latest(log).collect()} == {"a": "ok", "b": "download_failed"}
    assert [r.track_id for r in manifest.compacted(log).collect()] == ["a", "b"] and files.count_rows(spark, f"{path}/part-*") >= 1


def test_csv_with_and_without_a_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text(',track_id,energy\n0,a,0.5\n1,b,\n')
    got = files.read_csv(spark, f"file://{tmp_path}/t.csv")
    assert got.columns == ["track_id", "energy"] and [tuple(r) for r in got.collect()] == [("a", "0.5"), ("b", None)]
    (tmp_path / "u.csv").write_text("track_id,energy\na,0.5\nb,x\n")
    assert [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/u.csv", "track_id string, energy double").collect()] == [("a", 0.5), ("b", None)]


def test_nested_tracks_and_reports(spark, tmp_path):
    track = {"id": "t1", "name": "N", "artists": [{"name": "A"}], "album": {"name": "L", "images": []}, "duration_ms": 5, "external_ids": {"isrc": "I"}}
    lines = [{"track": track}, {"item": {**track, "id": "t2", "artists": []}}, {"track": {**track, "is_local": True}}, {"track": {"name": "no id"}}, {}]
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, lines)))
    got = files.read_tracks_json(spark, f"file://{tmp_path}/t.json").orderBy("spotify_id").collect()
    assert [(r.spotify_id, r.artist, r.album, r.artwork_url, r.isrc) for r in got] == [("t1", "A", "L", None, "I"), ("t2", None, "L", None, "I")]
    files.write_report(spark.createDataFrame([("rmse", 0.5)], "name string, value double"), f"file://{tmp_path}/report")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/report").collect()] == [("rmse", "0.5")]


@pytest.mark.parametrize("path, stem, suffix, target", [("a/b.c.MP3", "b.c", ".mp3", "audio/7.mp3"), (".hidden", ".hidden", "", "audio/7.mp3"), ("x/", "", "", "audio/7.mp3"), ("x.m4a", "x", ".m4a", "audio/7.m4a"), ("d.d/f", "f", "", "audio/7.mp3"), (None, None, None, "audio/7.mp3")])
def test_file_names(spark, path, stem, suffix, target):
    p = F.lit(path).cast("string")
    got = spark.range(1).select(text.file_stem(p).alias("stem"), text.file_suffix(p).alias("suffix"), text.audio_target(F.lit(7), p).alias("target")).first()
    assert tuple(got) == (stem, suffix, target)


def test_dataset_items(spark):
    rows = spark.createDataFrame([(1, [1.0] * 9), (2, [float(i) for i in range(10)]), (3, [0.5] * 30), (4, []), (5, None)], "id int, x array<double>")
    got = {r.id: r.y for r in rows.select("id", arrays.dataset_item(F.col("x"), 10, 20, 4).alias("y")).collect()}
    assert got[1] is None and got[4] is None and got[5] is None
    assert got[2] == pytest.approx([3 / 6, 4 / 6, 5 / 6, 1.0]) and got[3] == [0.5] * 4
    loud = rows.where("id = 3").select(arrays.dataset_item(F.col("x"), 10, 20, 24, 6.0).alias("y")).first().y
    assert loud == pytest.approx([0.5 * 10**0.3] * 20 + [0.0] * 4) and max(loud) < 1
    gains = [r.g for r in spark.range(500).select(arrays.seeded_gain(F.col("id"), "s", 6.0).alias("g")).collect()]
    assert min(gains) < -5 and max(gains) > 5 and max(map(abs, gains)) <= 6


def test_common_columns(spark):
    assert changes.common_columns(spark.createDataFrame([(1, 2)], "b int, a int"), ["a", "c", "b"]).columns == ["a", "b"]
