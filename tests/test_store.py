"""Versioned tables: who wins, what a crash leaves, what is rewritten; resumed jobs and moments under change."""

import statistics

import pytest
from pyspark.sql import functions as F

from tunelode.operators import writeback
from tunelode.sources.store import Moments, StaleParent, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def tracks(spark, n=200):
    return spark.range(n).select("id", F.concat(F.lit("t"), "id").alias("title"), (F.col("id") * 1.5).alias("score"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def parts(store, table, version=None):
    return {b: p["path"] for b, p in store.entry(version)["tables"][table]["parts"].items()}


def test_of_two_writers_one_loses(spark, store):
    store.apply(lambda c: c.create("tracks", tracks(spark), ["id"]))
    one, two = store.begin(), store.begin()
    one.upsert("tracks", spark.createDataFrame([(1, "one")], "id long, title string"))
    two.upsert("tracks", spark.createDataFrame([(1, "two"), (2, "two")], "id long, title string"))
    assert one.commit(by="one") == 2
    with pytest.raises(StaleParent):
        two.commit(by="two")
    assert store.version == 2 and store.entry()["note"] == {"by": "one"} and store.entry()["parent"] == 1
    got = {r.id: r.title for r in store.read("tracks").where("id < 3").collect()}
    assert got == {0: "t0", 1: "one", 2: "t2"}
    assert sorted(n for n in store.files.names(f"{store.root}/log") if not n.startswith(".")) == [f"{v:020d}.json" for v in (1, 2)]


def test_apply_goes_again_on_the_winner(spark, store):
    store.apply(lambda c: c.create("tracks", tracks(spark, 3), ["id"]))
    tries = []

    def change(c):
        tries.append(c.parent)
        c.upsert("tracks", spark.createDataFrame([(0, "mine")], "id long, title string"))
        if len(tries) == 1:
            store.apply(lambda d: d.upsert("tracks", spark.createDataFrame([(1, "theirs")], "id long, title string")))

    assert store.apply(change) == 3 and tries == [1, 2]
    assert rows(store.read("tracks")) == [(0, "mine", 0.0), (1, "theirs", 1.5), (2, "t2", 3.0)]


def test_only_touched_buckets_are_written(spark, store):
    store.apply(lambda c: c.create("tracks", tracks(spark), ["id"], buckets=32))
    before = parts(store, "tracks")
    store.apply(lambda c: c.upsert("tracks", spark.createDataFrame([(7, "seven"), (900, "new")], "id long, title string")))
    after = parts(store, "tracks")
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 2
    assert rows(store.read("tracks", 1)) == rows(tracks(spark))
    assert rows(store.read("tracks").where("id IN (6, 7, 900)")) == [(6, "t6", 9.0), (7, "seven", 10.5), (900, "new", None)]
    assert store.rows("tracks", 1) == 200 and store.rows("tracks") == store.read("tracks").count() == 201


def test_added_columns_write_no_rows(spark, store):
    store.apply(lambda c: c.create("tracks", tracks(spark, 5), ["id"]))
    store.apply(lambda c: c.add_columns("tracks", "TITLE string, genre string, plays int"))
    assert parts(store, "tracks") == parts(store, "tracks", 1)
    assert store.read("tracks").columns == ["id", "title", "score", "genre", "plays"] and store.read("tracks", 1).columns == ["id", "title", "score"]
    store.apply(lambda c: c.upsert("tracks", spark.createDataFrame([(1, "pop")], "id long, genre string")))
    assert rows(store.read("tracks").where("id < 2")) == [(0, "t0", 0.0, None, None), (1, "t1", 1.5, "pop", None)]


def library(spark, store):
    links = [(1, t) for t in range(10)] + [(2, t) for t in range(5, 12)] + [(None, 0)]
    files = [(t, "a.mp3" if t % 2 else "" if t % 4 else None) for t in range(12)]

    def create(c):
        c.create("user_tracks", spark.createDataFrame(links, "user_id long, track_id long"), ["user_id", "track_id"], buckets=4)
        c.create("tracks", spark.createDataFrame(files, "id long, audio_path string"), ["id"], buckets=4)

    store.apply(create)


@pytest.mark.parametrize("at", ["tracks", "user_tracks"])
def test_a_crash_between_two_deletes_leaves_the_old_version_whole(spark, store, at):
    library(spark, store)
    old = rows(store.read("tracks")), rows(store.read("user_tracks"))

    def stop(step):
        if step == at:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writeback.clear_library(store, 1, stop)
    assert store.version == 1 and (rows(store.read("tracks")), rows(store.read("user_tracks"))) == old
    assert store.vacuum(older_than=0) >= 1  # what the crash left
    assert (rows(store.read("tracks")), rows(store.read("user_tracks"))) == old


def test_clearing_a_library(spark, store):
    library(spark, store)
    assert writeback.clear_library(store, 1) == {"cleared": 10, "tracks_pruned": 4, "audio_files_removed": 2}
    assert rows(store.read("user_tracks")) == sorted([(2, t) for t in range(5, 12)] + [(None, 0)], key=repr)
    assert {r.id for r in store.read("tracks").collect()} == {0, *range(5, 12)}
    assert writeback.clear_library(store, 99) == {"cleared": 0, "tracks_pruned": 0, "audio_files_removed": 0}


def test_vacuum_keeps_named_and_young_folders(spark, store):
    store.apply(lambda c: c.create("tracks", tracks(spark, 20), ["id"], buckets=4))
    for k in range(3):
        store.apply(lambda c, k=k: c.upsert("tracks", spark.createDataFrame([(i, f"v{k}") for i in range(20)], "id long, title string")))
    waiting = store.begin()
    waiting.upsert("tracks", spark.createDataFrame([(1, "late")], "id long, title string"))
    assert store.vacuum(keep=2) == 0  # all are younger than a day
    assert store.versions() == [3, 4]
    assert waiting.commit() == 5 and {r.title for r in store.read("tracks").collect()} == {"late", "v2"}
    assert store.vacuum(keep=1, older_than=0) >= 2 and store.versions() == [5] and store.read("tracks").count() == 20


def test_empty_tables_and_batches(spark, store):
    store.apply(lambda c: c.create("tracks", tracks(spark, 0), ["id"], track=("score",)))
    assert store.read("tracks").count() == 0 and store.rows("tracks") == 0 and store.moments("tracks", "score") == Moments()
    store.apply(lambda c: c.upsert("tracks", tracks(spark, 0)))
    store.apply(lambda c: c.delete("tracks", tracks(spark, 0)))
    store.apply(lambda c: c.upsert("tracks", spark.createDataFrame([(None, "no id"), (4, None)], "id long, title string")))
    assert rows(store.read("tracks")) == [(4, None, None), (None, "no id", None)]
    assert store.read("tracks", 3).count() == 0 and store.version == 4


def test_upserts_by_either_key(spark, store):
    have = [(1, "s1", 10, "a"), (2, "s2", 20, "b"), (3, "", 0, "c"), (4, "s2", 40, "d")]
    store.apply(lambda c: c.create("tracks", spark.createDataFrame(have, "id long, spotify_id string, apple_id long, title string"), ["id"]))
    new = [(1, "s2", 10, "by first key"), (2, "x", 10, None), (3, "", 0, "added"), (4, None, 40, "by second"), (5, "s2", None, "last")]
    writeback.upsert_tracks(store, spark.createDataFrame(new, "new_id long, spotify_id string, apple_id long, title string"))
    assert rows(store.read("tracks")) == [(1, "x", 10, None), (2, "s2", None, "last"), (3, "", 0, "c"), (4, None, 40, "by second"), (7, "", 0, "added")]


# jobs


def doubled(df):
    return df.withColumn("score", F.col("score") * 2 + 1)


def fresh(spark, path):
    store = Store(spark, f"file://{path}")
    store.apply(lambda c: c.create("tracks", tracks(spark).withColumn("score", F.when(F.col("id") % 3 > 0, F.col("score"))), ["id"], buckets=16, track=("score",)))
    return store


def test_a_killed_job_goes_on_where_it_stopped(spark, tmp_path):
    due, outcomes = F.col("id") % 2 == 0, {"ok": F.col("score").isNotNull(), "no_score": F.col("score").isNull()}
    whole = fresh(spark, tmp_path / "whole")
    total = writeback.run_job(whole, "tracks", "double", due, doubled, outcomes=outcomes)
    assert total == {"steps": 4, "rows": 200, "kept": 100, "computed": 100, "ok": 66, "no_score": 34}
    for k in range(4):
        store = fresh(spark, tmp_path / f"killed{k}")
        asked = []

        def compute(df, k=k, asked=asked):
            asked.append(1)
            if len(asked) > k:
                raise KeyboardInterrupt
            return doubled(df)

        with pytest.raises(KeyboardInterrupt):
            writeback.run_job(store, "tracks", "double", due, compute, outcomes=outcomes)
        assert writeback.progress(store, "double")["steps"] == k == store.version - 1
        done = parts(store, "tracks")
        assert writeback.run_job(store, "tracks", "double", due, doubled, outcomes=outcomes) == total
        assert rows(store.read("tracks")) == rows(whole.read("tracks"))
        finished = {str(b) for s in store.entry()["jobs"]["double"][:k] for b in s["buckets"]}
        assert all(parts(store, "tracks").get(b) == done.get(b) for b in finished)  # no finished step was redone
        assert writeback.run_job(store, "tracks", "double", due, doubled) == total and store.version == 5


def test_a_job_takes_in_what_another_writer_did(spark, tmp_path):
    store = fresh(spark, tmp_path)
    once = []

    def compute(df):
        if not once:
            once.append(store.apply(lambda c: c.upsert("tracks", tracks(spark).select("id", F.lit("other").alias("title")))))
        return doubled(df)

    writeback.run_job(store, "tracks", "double", F.col("id") >= 0, compute)
    want = [(i, "other", i * 3.0 + 1 if i % 3 else None) for i in range(200)]
    assert rows(store.read("tracks")) == sorted(want, key=repr)


# moments


def test_merged_moments_equal_a_full_pass(spark, store):
    import random

    rng = random.Random(4)
    values = {i: rng.choice([rng.gauss(1e6, 3.0), rng.gauss(0, 1), None]) for i in range(300)}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, activation double")
    store.apply(lambda c: c.create("tracks", frame(values), ["id"], track=("activation",)))
    for k in range(4):
        batch = {rng.randrange(400): rng.gauss(10**k, k + 0.1) for _ in range(60)}
        gone = {rng.randrange(400): None for _ in range(20)}
        values |= batch
        store.apply(lambda c, batch=batch: c.upsert("tracks", frame(batch)))
        values = {i: x for i, x in values.items() if i not in gone}
        store.apply(lambda c, gone=gone: c.delete("tracks", frame(gone)))
        there = [x for x in values.values() if x is not None]
        m = store.moments("tracks", "activation")
        assert (m.n, m.least, m.greatest) == (len(there), min(there), max(there))
        assert m.mean == pytest.approx(statistics.fmean(there), rel=1e-9) and m.std == pytest.approx(statistics.pstdev(there), rel=1e-9)
        z = {r[0]: r[1] for r in store.read("tracks").select("id", writeback.relative(store, "tracks", "activation")).collect()}
        assert z == {i: None if x is None else pytest.approx(min(max(50 + (x - m.mean) / m.std * 15, 0), 100)) for i, x in values.items()}


def test_relative_scores_of_few_or_equal_values(spark, store):
    one = spark.createDataFrame([(1, 7.0), (2, None)], "id long, score double")
    store.apply(lambda c: c.create("tracks", one, ["id"], track=("score",)))
    assert rows(store.read("tracks").select("id", writeback.relative(store, "tracks", "score", few=2))) == [(1, 50.0), (2, None)]
    assert rows(store.read("tracks").select("id", writeback.relative(store, "tracks", "score"))) == [(1, 50.0), (2, None)]
