"""Queries on the library: scores, ranges, exclusion, joins, counts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import changes, evaluation, library
from ..sources.views import duck, read
from .registry import query

VIBE = "coalesce(vibe_score_ml * 100.0, vibe_score)"
T, UT, BOTH = "v_tracks", "v_user_tracks", "v_tracks v_user_tracks"
_C = lambda x: f"least(greatest({x}, 0.0), 1.0)"
_F = lambda c: f"coalesce({c}, 0.0)"
_E = _C("coalesce(energy_mean, energy, 0.0) / 0.15")
_TERMS = {
    "t": _C(f"({_F('tempo')} - 60.0) / 120.0"), "y": _C(f"{_F('energy_std')} * 8.0"), "d": _C(f"{_F('tempo_stability')} * {_F('onset_rate')} / 10.0"),
    "b": _C(f"({_F('brightness')} - 500.0) / 3500.0"), "o": _C(f"{_F('onset_rate')} / 3.0"), "a": _C(_F("acousticness")), "v": _C(f"({_F('valence_mode')} + 1.0) / 2.0"),
    "f": _C(f"{_F('flatness')} * 10.0"), "c": _C(f"{_F('spectral_contrast')} / 30.0"),
}
_ACT = "100.0 * (0.30 * {e} + 0.25 * {t} + 0.20 * {d} + 0.10 * {o} + 0.10 * {b} + 0.05 * {y})".format(e=_E, **_TERMS)
_VAL = "100.0 * (0.50 * {v} + 0.20 * (1.0 - {f}) + 0.15 * {c} + 0.15 * (1.0 - 0.5 * {a}))".format(**_TERMS)
_MOOD = """CASE WHEN a IS NULL THEN NULL WHEN a < 20 THEN 'sleep' WHEN a < 40 THEN CASE WHEN v IS NULL OR v >= 50 THEN 'chill' ELSE 'melancholy' END
 WHEN a < 60 THEN CASE WHEN v IS NULL OR v >= 50 THEN 'steady' ELSE 'moody' END WHEN a < 80 THEN CASE WHEN v IS NULL OR v >= 50 THEN 'hype' ELSE 'aggressive' END ELSE 'beast' END"""
_AXES = f"axes AS (SELECT *, {_ACT} AS a, {_VAL} AS v FROM v_tracks)"
_ELIGIBLE = "coalesce(tempo, energy_mean, energy, energy_std, brightness, onset_rate, tempo_stability, valence_mode, flatness, spectral_contrast, acousticness)"


def axes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, T).withColumns({"a": scoring.activation(), "v": scoring.valence()})


@query(duck(BOTH, f"SELECT id, title, artist, round({VIBE}, 6) AS vibe FROM v_tracks JOIN v_user_tracks ON track_id = id WHERE user_id = 7 AND {VIBE} BETWEEN 20 AND 80 ORDER BY {VIBE}, id LIMIT 20"))
def tracks_in_vibe_range(spark: SparkSession, sf: str) -> DataFrame:
    """A user's tracks in a score range: the first 20 by score."""
    mine = library.in_library(read(spark, sf, T), read(spark, sf, UT), 7)
    return library.matching(mine, 20, 80).orderBy("vibe", "id").limit(20).select("id", "title", "artist", F.round("vibe", 6).alias("vibe"))


@query(duck(T, f"WITH {_AXES} SELECT id, round({VIBE}, 6) AS vibe, {_MOOD} AS mood FROM axes WHERE {VIBE} BETWEEN 10 AND 90 AND {_MOOD} = 'steady'"))
def tracks_in_vibe_range_by_mood(spark: SparkSession, sf: str) -> DataFrame:
    rows = axes(spark, sf).withColumn("mood", scoring.mood(F.col("a"), F.col("v")))
    return library.matching(rows, 10, 90, F.col("mood") == "steady").select("id", F.round("vibe", 6).alias("vibe"), "mood")


@query(duck(T, f"WITH {_AXES} SELECT id FROM axes WHERE {VIBE} BETWEEN 10 AND 90 AND v BETWEEN 30 AND 70 AND acousticness BETWEEN 0.2 AND 0.8 AND a < 60"))
def client_filters_extended(spark: SparkSession, sf: str) -> DataFrame:
    more = (F.col("v").between(30, 70), F.col("acousticness").between(0.2, 0.8), F.col("a") < 60)
    return library.matching(axes(spark, sf), 10, 90, *more).select("id")


@query(duck(T, f"SELECT id, md5(cast(id AS string) || 'x') AS h FROM v_tracks WHERE {VIBE} BETWEEN 30 AND 60 ORDER BY h LIMIT 25"))
def tracks_shuffled_seeded(spark: SparkSession, sf: str) -> DataFrame:
    rows = library.matching(read(spark, sf, T), 30, 60)
    return rows.select("id", library.hash_order("id", "x").alias("h")).orderBy("h").limit(25)


@query(duck(T, f"SELECT id, CASE WHEN abs({VIBE} - 50) <= 2 THEN 0 ELSE 1 END AS attempt FROM v_tracks WHERE abs({VIBE} - 50) <= 12 AND apple_id NOT IN (3, 17, 90) ORDER BY attempt, md5(cast(id AS string)) LIMIT 1"))
def random_pick_widening(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.range(1).select(text.int_list(F.lit("3, 17,,x,90")).alias("ids")).first().ids
    return library.pick_near(read(spark, sf, T), 50, 2, 12, ids).select("id", "attempt")


@query(duck(T, "SELECT id FROM v_tracks WHERE apple_id NOT IN (1, 2, 3, 4)"))
def exclude_list_null_trap(spark: SparkSession, sf: str) -> DataFrame:
    return library.not_excluded(read(spark, sf, T), [1, 2, 3, 4]).select("id")


@query(duck(T, "SELECT id FROM v_tracks WHERE apple_id IS NULL OR apple_id NOT IN (1, 2, 3, 4)"))
def exclude_list_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    return library.not_excluded(read(spark, sf, T), [1, 2, 3, 4], keep_null=True).select("id")


@query("SELECT event_id, user_id, c_name AS display_name FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'signup'")
def session_user_lookup(spark: SparkSession, sf: str) -> DataFrame:
    sessions = read(spark, sf, "events").where("event_type = 'signup'")
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("display_name"))
    return sessions.join(users, "user_id").select("event_id", "user_id", "display_name")


@query(duck(BOTH, "SELECT id FROM v_tracks WHERE EXISTS (SELECT 1 FROM v_user_tracks WHERE track_id = id AND user_id <= 20)"))
def already_linked_semi(spark: SparkSession, sf: str) -> DataFrame:
    links = read(spark, sf, UT).where("user_id <= 20").select(F.col("track_id").alias("id"))
    return read(spark, sf, T).join(links, "id", "left_semi").select("id")


@query(duck(BOTH, "SELECT id FROM v_tracks WHERE EXISTS (SELECT 1 FROM v_user_tracks WHERE track_id = id)"))
def already_linked_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks that any user has."""
    return read(spark, sf, T).join(read(spark, sf, UT).select(F.col("track_id").alias("id")), "id", "left_semi").select("id")


@query(duck(BOTH, "SELECT DISTINCT track_id FROM v_user_tracks m WHERE user_id = 7 AND NOT EXISTS (SELECT 1 FROM v_user_tracks o WHERE o.track_id = m.track_id AND o.user_id <> 7)"))
def orphan_tracks_anti(spark: SparkSession, sf: str) -> DataFrame:
    return library.orphans(read(spark, sf, UT), 7)


@query(duck(BOTH, """WITH mine AS (SELECT DISTINCT track_id FROM v_user_tracks WHERE user_id = 7),
gone AS (SELECT track_id FROM mine m WHERE NOT EXISTS (SELECT 1 FROM v_user_tracks o WHERE o.track_id = m.track_id AND o.user_id <> 7))
SELECT (SELECT count(*) FROM mine) AS cleared, (SELECT count(*) FROM gone) AS tracks_pruned,
 (SELECT count(*) FROM gone JOIN v_tracks ON id = track_id WHERE audio_path <> '') AS audio_files_removed"""))
def clear_library_counts(spark: SparkSession, sf: str) -> DataFrame:
    links = read(spark, sf, UT)
    mine = links.where("user_id = 7").select("track_id").distinct().withColumn("mine", F.lit(1))
    gone = library.orphans(links, 7).withColumn("gone", F.lit(1))
    files = read(spark, sf, T).select(F.col("id").alias("track_id"), F.coalesce(F.col("audio_path") != "", F.lit(False)).alias("file"))
    rows = mine.join(gone, "track_id", "left").join(files, "track_id", "left")
    return rows.agg(F.count("*").alias("cleared"), F.count("gone").alias("tracks_pruned"), F.count_if(F.col("file") & F.col("gone").isNotNull()).alias("audio_files_removed"))


@query(duck(T, "SELECT count(*) AS n FROM v_tracks"))
def library_count(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, T).agg(F.count("*").alias("n"))


@query(duck("v_links", "SELECT user_id, count(*) AS n FROM v_links GROUP BY user_id"))
def links_per_user(spark: SparkSession, sf: str) -> DataFrame:
    """A NULL user is a group."""
    return read(spark, sf, "v_links").groupBy("user_id").agg(F.count("*").alias("n"))


@query(duck(T, f"WITH {_AXES} SELECT id, round(a, 6) AS activation, round(v, 6) AS valence FROM axes"))
def axes_scores(spark: SparkSession, sf: str) -> DataFrame:
    return axes(spark, sf).select("id", F.round("a", 6).alias("activation"), F.round("v", 6).alias("valence"))


@query(duck(T, f"WITH {_AXES} SELECT id, {_MOOD} AS mood, CASE WHEN a < 20 THEN 'sleep' WHEN a < 40 THEN 'chill' WHEN a < 60 THEN 'steady' WHEN a < 80 THEN 'hype' ELSE 'beast' END AS mood_one_axis, CASE WHEN {VIBE} IS NULL THEN NULL WHEN {VIBE} < 20 THEN 'sleep' WHEN {VIBE} < 40 THEN 'chill' WHEN {VIBE} < 60 THEN 'steady' WHEN {VIBE} < 80 THEN 'hype' ELSE 'beast' END AS bucket FROM axes"))
def mood_labels(spark: SparkSession, sf: str) -> DataFrame:
    a, v = F.col("a"), F.col("v")
    return axes(spark, sf).select("id", scoring.mood(a, v).alias("mood"), scoring.mood(a, F.lit(None)).alias("mood_one_axis"), scoring.vibe_bucket(scoring.effective_vibe()).alias("bucket"))


def _zscore_sql(eligible: str, few: int) -> str:
    return duck(T, f"""WITH {_AXES}, e AS (SELECT * FROM axes WHERE {eligible}), s AS (SELECT avg(a) AS m, stddev_pop(a) AS sd, count(*) AS n FROM e)
SELECT id, round(CASE WHEN sd <= 1e-9 OR n < {few} THEN 50.0 ELSE least(greatest(50.0 + (a - m) / sd * 15.0, 0.0), 100.0) END, 6) AS activation_relative, {_MOOD} AS mood FROM e, s""")


def _zscore(rows: DataFrame, few: int) -> DataFrame:
    out = scoring.standardised(rows, "a", "activation_relative", few)
    return out.select("id", F.round("activation_relative", 6).alias("activation_relative"), scoring.mood(F.col("a"), F.col("v")).alias("mood"))


@query(_zscore_sql(f"{_ELIGIBLE} IS NOT NULL", 1))
def library_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Over rows that have any feature."""
    return _zscore(axes(spark, sf).where(F.coalesce(*scoring.FEATURES).isNotNull()), 1)


@query(_zscore_sql("a IS NOT NULL", 2))
def library_zscore_all(spark: SparkSession, sf: str) -> DataFrame:
    """Over all rows that have a score."""
    return _zscore(axes(spark, sf).where("a IS NOT NULL"), 2)


@query(duck(T, f"WITH {_AXES} SELECT {_MOOD} AS mood, count(*) AS n FROM axes GROUP BY 1"))
def mood_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return axes(spark, sf).groupBy(scoring.mood(F.col("a"), F.col("v")).alias("mood")).agg(F.count("*").alias("n"))


@query(duck(T, "SELECT id, round(0.55 * coalesce(energy_pred, 0.0) + 0.45 * coalesce(danceability_pred, 0.0), 6) AS vibe_score_ml FROM v_tracks"))
def ml_vibe_score(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, T).select("id", F.round(scoring.predicted_vibe(), 6).alias("vibe_score_ml"))


_ALL = ("tempo_stability", "onset_rate", "energy_mean", "energy_std", "flatness", "spectral_contrast", "valence_mode", "acousticness")


@query(duck(T, f"""SELECT id, audio_path IS NOT NULL AND audio_path <> '' AND NOT ({' AND '.join(f'{c} IS NOT NULL' for c in _ALL)}) AS features,
 energy_pred IS NULL OR model_version IS NULL OR model_version <> 'v1' AS predictions, youtube_id IS NULL AND youtube_queried_at IS NULL AS video FROM v_tracks"""))
def pending_work(spark: SparkSession, sf: str) -> DataFrame:
    """Which kinds of work a track still waits for."""
    full = F.lit(True)
    for c in _ALL:
        full &= F.col(c).isNotNull()
    file = F.coalesce(F.col("audio_path") != "", F.lit(False))
    stale = F.col("energy_pred").isNull() | ~F.col("model_version").eqNullSafe(F.lit("v1"))
    return read(spark, sf, T).select("id", (file & ~full).alias("features"), stale.alias("predictions"), (F.col("youtube_id").isNull() & F.col("youtube_queried_at").isNull()).alias("video"))


@query(duck(T, """SELECT id, CASE WHEN preview_url IS NULL OR preview_url = '' THEN 'none' WHEN contains(lower(preview_url), 'scdn.co') THEN 'spotify_preview'
 WHEN contains(lower(preview_url), 'itunes') THEN 'itunes_term_search' ELSE 'unknown' END AS source FROM v_tracks WHERE classification_source IS NULL OR classification_source = ''"""))
def source_backfill(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.coalesce(F.col("classification_source"), F.lit("")) == ""
    return read(spark, sf, T).where(empty).select("id", text.preview_source(F.col("preview_url")).alias("source"))


@query(duck(UT, """SELECT user_id, track_id, 'old' AS source FROM v_user_tracks WHERE user_id % 2 = 0 UNION ALL
SELECT DISTINCT user_id, track_id, 'new' FROM v_user_tracks WHERE user_id % 3 = 0 AND NOT (user_id % 2 = 0)"""))
def insert_or_ignore_links(spark: SparkSession, sf: str) -> DataFrame:
    links = read(spark, sf, UT)
    return changes.insert_or_ignore(links.where("user_id % 2 = 0").withColumn("source", F.lit("old")), links.where("user_id % 3 = 0").withColumn("source", F.lit("new")), ["user_id", "track_id"])


_NEW = """SELECT row_number() OVER (ORDER BY p_partkey) AS new_id, CASE WHEN p_partkey % 2 = 0 THEN 'sp' || cast(p_partkey % 1500 AS string) END AS spotify_id,
 CASE WHEN p_partkey % 4 = 1 THEN p_partkey % 1700 END AS apple_id, upper(p_name) AS title FROM part WHERE p_partkey % 20 < 3"""


@query(duck(T, f"""WITH n AS ({_NEW}), h AS (SELECT n.*, coalesce((SELECT min(id) FROM v_tracks t WHERE t.spotify_id = n.spotify_id AND n.spotify_id <> ''), (SELECT min(id) FROM v_tracks t WHERE t.apple_id = n.apple_id AND n.apple_id <> 0)) AS hit FROM n),
last AS (SELECT * FROM h WHERE hit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hit ORDER BY new_id DESC) = 1)
SELECT id, CASE WHEN hit IS NULL THEN t.spotify_id ELSE last.spotify_id END AS spotify_id, CASE WHEN hit IS NULL THEN t.apple_id ELSE last.apple_id END AS apple_id, CASE WHEN hit IS NULL THEN t.title ELSE last.title END AS title
FROM v_tracks t LEFT JOIN last ON hit = id UNION ALL SELECT (SELECT max(id) FROM v_tracks) + new_id, spotify_id, apple_id, title FROM h WHERE hit IS NULL"""))
def upsert_tracks(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    new = evaluation.numbered(read(spark, sf, "part").where("p_partkey % 20 < 3"), "p_partkey").select(
        F.col("place").cast("long").alias("new_id"), F.when(p % 2 == 0, F.concat(F.lit("sp"), (p % 1500).cast("string"))).alias("spotify_id"),
        F.when(p % 4 == 1, p % 1700).alias("apple_id"), F.upper("p_name").alias("title"),
    )
    return changes.upsert(read(spark, sf, T).select("id", "spotify_id", "apple_id", "title"), new)


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, event_id) AS n FROM events) WHERE n = 1""")
def source_union_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Several sources by rank, each id's first row winning."""
    e = read(spark, sf, "events")
    parts = [e.where("event_type = 'purchase'").withColumn("rank", F.lit(1)), e.where("event_type = 'view'").withColumn("rank", F.lit(2)), e.where("event_type NOT IN ('purchase', 'view')").withColumn("rank", F.lit(3))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return library.first_of(rows, "user_id", F.col("rank"), F.col("event_id")).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_type, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM
 (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1) WHERE place <= 3""")
def recent_trail(spark: SparkSession, sf: str) -> DataFrame:
    return library.recent(read(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], 3).select("user_id", "event_type", "event_id", "place")


@query("""WITH p AS (SELECT conv_id, count(*) AS listed, count(*) FILTER (role = 'user') AS found FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN found > 1 THEN found ELSE listed END AS total, conv_id % 2 = 0 AS mine FROM p""")
def library_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Resolved totals replace listed ones where there are any."""
    c = read(spark, sf, "conversations")
    listed = c.groupBy("conv_id").agg(F.count("*").alias("listed"))
    found = c.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("found")).where("found > 1")
    return listed.join(found, "conv_id", "left").select("conv_id", F.coalesce("found", "listed").alias("total"), (F.col("conv_id") % 2 == 0).alias("mine"))


@query(duck(T, "SELECT id, title FROM v_tracks ORDER BY md5(cast(id AS string) || 's1'), id LIMIT 100"))
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.seeded_sample(read(spark, sf, T), 100, "id", "s1").select("id", "title")


@query(duck(T, """WITH g AS (SELECT artist, row_number() OVER (ORDER BY md5(artist)) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT artist FROM v_tracks))
SELECT id, artist, CASE WHEN r / n < 0.8 THEN 'train' WHEN r / n < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM v_tracks JOIN g USING (artist)"""))
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    """Whole artists go to train, val or test."""
    return evaluation.group_split(read(spark, sf, T).select("id", "artist"), "artist")


_REG = "SELECT l_quantity / 50.0 AS y, l_extendedprice / 60000.0 AS p, l_orderkey, l_linenumber FROM lineitem"


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select((F.col("l_quantity") / 50.0).alias("y"), (F.col("l_extendedprice") / 60000.0).alias("p"), "l_orderkey", "l_linenumber")


_SPEAR = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"""WITH d AS ({_REG}), r AS (SELECT *, {_SPEAR.format('y')} AS ry, {_SPEAR.format('p')} AS rp FROM d)
SELECT count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2, round(corr(y, p), 6) AS pearson, round(corr(ry, rp), 6) AS spearman FROM r""")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluation.regression_metrics(_predictions(spark, sf))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"""WITH d AS ({_REG}), b AS (SELECT avg(y) AS m FROM d WHERE l_orderkey % 10 < 8)
SELECT round(sqrt(avg((y - m) * (y - m))), 6) AS base_rmse, round(avg(abs(y - m)), 6) AS base_mae, round(sqrt(avg((y - m) * (y - m))) - sqrt(avg((p - y) * (p - y))), 6) AS rmse_gain FROM d, b WHERE l_orderkey % 10 >= 8""")
def metrics_vs_baseline(spark: SparkSession, sf: str) -> DataFrame:
    d = _predictions(spark, sf)
    test = d.where("l_orderkey % 10 >= 8")
    base = evaluation.baseline(d.where("l_orderkey % 10 < 8"), test).withColumn("axis", F.lit("y"))
    own = evaluation.regression_metrics(test).withColumn("axis", F.lit("y")).select("axis", "rmse")
    both = base.join(own, "axis")
    return both.select(F.round("base_rmse", 6).alias("base_rmse"), F.round("base_mae", 6).alias("base_mae"), F.round(F.col("base_rmse") - F.col("rmse"), 6).alias("rmse_gain"))


@query(f"WITH d AS ({_REG}) SELECT cast(least(greatest(floor((p - y + 1.0) / ((1.0 + 1.0) / 50)), 0), 49) AS INTEGER) AS bin, count(*) AS n FROM d GROUP BY 1")
def residual_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.histogram(_predictions(spark, sf), F.col("p") - F.col("y"), -1.0, 1.0, 50)
