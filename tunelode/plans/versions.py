"""Queries on a store of versioned tables: upserts, clearing a library, moments under change, and jobs that are resumed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import migration, writeback
from ..session import shared_dir
from ..sources import layout
from ..sources.store import Store
from ..sources.views import duck, read
from ..streaming import compaction
from . import entities, jobs
from . import library as lib
from .registry import query

T = "v_tracks"


def new_store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_dir(spark)}/tunelode/{uuid.uuid4().hex}/store")


_INCOMING = """SELECT p_partkey AS new_id, CASE WHEN p_partkey % 2 = 0 THEN 'sp' || cast(p_partkey * 3 % 3000 AS VARCHAR) END AS spotify_id,
 CASE WHEN p_partkey % 4 = 1 THEN p_partkey % 3400 END AS apple_id, upper(p_name) AS title FROM part"""


@query(duck(T, f"""WITH n AS ({_INCOMING}),
by_s AS (SELECT spotify_id, min(id) AS hit FROM v_tracks WHERE spotify_id <> '' GROUP BY 1), by_a AS (SELECT apple_id, min(id) AS hit FROM v_tracks WHERE apple_id <> 0 GROUP BY 1),
h AS (SELECT n.*, coalesce(by_s.hit, by_a.hit, (SELECT max(id) FROM v_tracks) + new_id) AS id FROM n LEFT JOIN by_s ON by_s.spotify_id = n.spotify_id LEFT JOIN by_a ON by_a.apple_id = n.apple_id),
last AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY new_id DESC) = 1)
SELECT id, CASE WHEN t.id IS NULL THEN 'added' ELSE 'changed' END AS change, t.title AS old_title, l.title AS new_title, t.spotify_id AS old_spotify_id, l.spotify_id AS new_spotify_id, l.apple_id AS new_apple_id
FROM last l LEFT JOIN v_tracks t USING (id) WHERE (t.id, t.spotify_id, t.apple_id, t.title) IS DISTINCT FROM (l.id, l.spotify_id, l.apple_id, l.title)"""))
def versions_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A whole table of incoming tracks put into a store; what the new version has that the one before hadn't."""
    store, cols = new_store(spark), ["id", "spotify_id", "apple_id", "title"]
    store.apply(lambda c: c.create("tracks", read(spark, sf, T).select(*cols), ["id"]))
    p = F.col("p_partkey")
    incoming = read(spark, sf, "part").select(
        p.alias("new_id"), F.when(p % 2 == 0, F.concat(F.lit("sp"), (p * 3 % 3000).cast("string"))).alias("spotify_id"), F.when(p % 4 == 1, p % 3400).alias("apple_id"), F.upper("p_name").alias("title")
    )
    n = writeback.upsert_tracks(store, incoming)
    old = store.read("tracks", n - 1).select(F.col("id").alias("_id"), F.struct(*cols).alias("old"))
    both = store.read("tracks", n).select("id", F.struct(*cols).alias("new")).join(old, F.col("id") == F.col("_id"), "left")
    change = F.when(F.col("_id").isNull(), "added").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select(
        "id", change.alias("change"), F.col("old.title").alias("old_title"), F.col("new.title").alias("new_title"),
        F.col("old.spotify_id").alias("old_spotify_id"), F.col("new.spotify_id").alias("new_spotify_id"), F.col("new.apple_id").alias("new_apple_id"),
    )


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS track_id FROM lineitem), m AS (SELECT track_id FROM l WHERE user_id = 3),
g AS (SELECT track_id FROM m WHERE track_id NOT IN (SELECT track_id FROM l WHERE user_id <> 3)), o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT track_id FROM g))
SELECT (SELECT count(*) FROM m) AS cleared, (SELECT count(*) FROM o) AS tracks_pruned, (SELECT count(*) FROM o WHERE o_orderstatus = 'F') AS audio_files_removed,
 (SELECT count(*) FROM l) AS links_before, (SELECT count(*) FROM l WHERE user_id <> 3) AS links_after, (SELECT count(*) FROM orders) AS tracks_before,
 (SELECT count(*) FROM orders) - (SELECT count(*) FROM o) AS tracks_after, (SELECT sum(o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT track_id FROM g))::BIGINT AS ids_after""")
def versions_clear_library(spark: SparkSession, sf: str) -> DataFrame:
    """One supplier's orders as a library that is cleared: links and orphans go in one version; counts of both versions."""
    store = new_store(spark)
    links = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("track_id")).distinct()
    path = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("audio/"), F.col("o_orderkey").cast("string")))

    def create(change) -> None:  # noqa: ANN001
        change.create("user_tracks", links, ["user_id", "track_id"])
        change.create("tracks", read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), path.alias("audio_path")), ["id"])

    store.apply(create)
    went = writeback.clear_library(store, 3)
    n = store.version
    sizes = {f"{name}_{when}": store.rows(table, v) for name, table in (("links", "user_tracks"), ("tracks", "tracks")) for when, v in (("before", n - 1), ("after", n))}
    return store.read("tracks", n).agg(*[F.lit(x).cast("long").alias(k) for k, x in {**went, **sizes}.items()], F.sum("id").alias("ids_after"))


_VERSIONS = {
    1: "SELECT a AS x FROM axes WHERE id % 3 <> 0",
    2: "SELECT a AS x FROM axes",
    3: "SELECT CASE WHEN id % 5 = 0 THEN v ELSE a END AS x FROM axes",
    4: "SELECT CASE WHEN id % 5 = 0 THEN v ELSE a END AS x FROM axes WHERE id % 7 <> 0",
}
_ROUNDED = "round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std, round(min(x), 8) AS least, round(max(x), 8) AS greatest"


@query(duck(T, f"WITH {lib._AXES} " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS version, count(x) AS n, {_ROUNDED} FROM ({x})" for k, x in _VERSIONS.items())))
def moments_by_version(spark: SparkSession, sf: str) -> DataFrame:
    """Library statistics of four versions, merged from the buckets' moments and never from a scan of the library."""
    store, rows = new_store(spark), lib.axes(spark, sf).select("id", "a", "v")
    store.apply(lambda c: c.create("tracks", rows.where("id % 3 <> 0").select("id", F.col("a").alias("activation")), ["id"], track=("activation",)))
    store.apply(lambda c: c.upsert("tracks", rows.where("id % 3 = 0").select("id", F.col("a").alias("activation"))))
    store.apply(lambda c: c.upsert("tracks", rows.where("id % 5 = 0").select("id", F.col("v").alias("activation"))))
    store.apply(lambda c: c.delete("tracks", rows.where("id % 7 = 0")))
    found = [(v, m.n, m.mean, m.std, m.least, m.greatest) for v in store.versions() for m in [store.moments("tracks", "activation", v)]]
    out = spark.createDataFrame(found, "version long, n long, mean double, std double, least double, greatest double")
    return out.select("version", "n", *[F.round(c, 8).alias(c) for c in ("mean", "std", "least", "greatest")])


@query(jobs.RECOMPUTED)
def recompute_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The recompute job over a store, ended after two of four steps and taken up again; relative scores by kept moments."""
    store, due = new_store(spark), ~jobs._complete()
    store.apply(lambda c: c.create("tracks", jobs.stored_scores(spark, sf), ["id"], track=("activation",)))
    for stop in (2, None):
        writeback.run_job(store, "tracks", "recompute", due, jobs.rescored, stop_after=stop)
    rows = store.read("tracks").withColumn("activation_relative", writeback.relative(store, "tracks", "activation"))
    outcome = F.when(due, "recomputed").otherwise("kept").alias("outcome")
    return rows.select("id", outcome, *[F.round(c, 6).alias(c) for c in ("activation", "valence", "activation_relative")], "mood")


@query(duck(T, """SELECT id, CASE WHEN audio_path IS NOT NULL AND (energy_pred IS NULL OR model_version IS NULL OR model_version <> 'v1') AND audio_path <> '' THEN round(coalesce(energy, 0.0) / 2, 6) ELSE round(vibe_score_ml, 6) END AS vibe_score_ml,
 CASE WHEN audio_path IS NOT NULL AND (energy_pred IS NULL OR model_version IS NULL OR model_version <> 'v1') AND audio_path <> '' THEN 'v1' ELSE model_version END AS model_version FROM v_tracks"""))
def predict_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction by a model's version over a store, ended after one step and taken up again; rows whose file is missing
    stay pending and are counted."""
    store = new_store(spark)
    cols = ["id", "audio_path", "energy", "energy_pred", "vibe_score_ml", "model_version"]
    store.apply(lambda c: c.create("tracks", read(spark, sf, T).select(*cols), ["id"]))
    due = F.col("audio_path").isNotNull() & (F.col("energy_pred").isNull() | ~F.col("model_version").eqNullSafe(F.lit("v1")))

    def predict(rows: DataFrame) -> DataFrame:
        there = F.col("audio_path") != ""
        return rows.withColumns({"vibe_score_ml": F.when(there, F.coalesce("energy", F.lit(0.0)) / 2).otherwise(F.col("vibe_score_ml")), "model_version": F.when(there, "v1").otherwise(F.col("model_version"))})

    outcomes = {"ok": F.col("audio_path") != "", "missing_audio": F.col("audio_path") == ""}
    for stop in (1, None):
        writeback.run_job(store, "tracks", "predict v1", due, predict, stop_after=stop, outcomes=outcomes)
    return store.read("tracks").select("id", F.round("vibe_score_ml", 6).alias("vibe_score_ml"), "model_version")


# Migration by batches

_MERGED = ["spotify_id", "apple_id", "preview_url"]


def migrated(spark: SparkSession, sf: str) -> Store:
    """All tracks in two batches, of which the second joins what the first left apart; a tenth of the records belongs to no user."""
    store, tracks = new_store(spark), read(spark, sf, T)
    user = F.when(F.col("id") % 10 > 0, F.col("id") * 7 % 90)
    rows = tracks.select("id", user.alias("user_id"), *_MERGED, "isrc", "title", "artist", "album", "audio_path", "classification_source", "created_at")
    types = dict(rows.dtypes)
    migration.create(store, _MERGED, types, buckets=4)
    for part in ("id % 3 = 2", "id % 3 <> 2"):
        migration.add(store, rows.where(part), _MERGED)
    return store


_NUMBERED = f"""n AS (SELECT *, CASE WHEN id % 10 > 0 THEN id * 7 % 90 END AS user_id, row_number() OVER o AS place, first_value(audio_path) OVER o AS own FROM t
 WINDOW o AS (PARTITION BY group_id ORDER BY {entities._RANK} DESC, {entities._EPOCH} DESC, id))"""
_first = lambda c: f"arg_min(CASE WHEN {c}::VARCHAR <> '' THEN {c} END, CASE WHEN {c}::VARCHAR <> '' THEN place END) AS {c}"
_CLASH = "count(*) FILTER (place > 1 AND audio_path <> '' AND own <> '' AND audio_path <> own) AS conflicts"


@query(entities._recursive(f""", {_NUMBERED} SELECT group_id AS id, arg_min(id, place) AS canonical_id, count(*) AS n_records,
 {', '.join(map(_first, _MERGED))}, {_CLASH} FROM n GROUP BY group_id"""))
def migration_by_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The merged tracks after two batches, the second merged into what the first left."""
    return migration.tracks(migrated(spark, sf), _MERGED)


@query(entities._recursive(f""", {_NUMBERED} SELECT (SELECT count(*) FROM t) AS old_rows, (SELECT count(DISTINCT group_id) FROM t) AS new_tracks, (SELECT count(*) - count(DISTINCT group_id) FROM t) AS saved,
 (SELECT count(user_id) FROM n) AS links_attempted, (SELECT count(*) FROM (SELECT DISTINCT user_id, group_id FROM n WHERE user_id IS NOT NULL)) AS links_inserted, (SELECT {_CLASH} FROM n) AS conflicts"""))
def migration_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the migration by batches says of itself, links asked for and links made among it."""
    return migration.summary(migrated(spark, sf))


# Streams into a store

@query(duck("v_manifest", "SELECT track_id, arg_max(status, line_no) AS status, max(line_no) AS line_no, arg_max(bytes, line_no) AS bytes FROM v_manifest GROUP BY track_id"))
def manifest_compacted_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream of four files, not in their order, kept down to its latest rows in a store."""
    store = new_store(spark)
    log = read(spark, sf, "v_manifest")
    root = store.root.rsplit("/", 1)[0]
    log.repartition(4, F.col("line_no") % 4).write.parquet(f"{root}/log")
    store.apply(lambda c: c.create("manifest", spark.createDataFrame([], log.schema), ["track_id"], buckets=4))
    rows = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    compaction.compact(rows, store, "manifest", f"{root}/checkpoint").awaitTermination()
    return store.read("manifest").select("track_id", "status", "line_no", "bytes")


# Layout

@query(duck("v_tracks v_user_tracks", "SELECT id, title, count(*) AS listeners FROM v_tracks JOIN v_user_tracks ON track_id = id GROUP BY id, title"))
def listeners_by_layout(spark: SparkSession, sf: str) -> DataFrame:
    """How many users have each track, over tables bucketed by track: joined and counted without an exchange."""
    prefix = f"t{uuid.uuid4().hex}"
    layout.write_library(read(spark, sf, T).select("id", "title", "spotify_id", "apple_id"), read(spark, sf, "v_user_tracks"), f"{shared_dir(spark)}/tunelode/{prefix}", prefix, buckets=8)
    return layout.with_listeners(spark, prefix).groupBy("id", "title").agg(F.count("*").alias("listeners"))
