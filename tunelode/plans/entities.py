"""Queries on identity resolution and resumable logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import containment, identity, ladder, library, manifest
from ..session import shared_dir, ship
from ..sources import files, listing
from ..sources.views import duck, read
from .registry import query

T, M = "v_tracks", "v_manifest"
_KEY = """coalesce('s:' || nullif(spotify_id, ''), 'a:' || cast(nullif(apple_id, 0) AS VARCHAR), 'i:' || nullif(isrc, ''),
 't:' || coalesce(lower(trim(title)), '') || '|' || coalesce(lower(trim(artist)), '') || '|' || coalesce(lower(trim(album)), ''))"""
_RANK = "CASE WHEN classification_source IS NULL OR classification_source = '' THEN -1 WHEN classification_source = 'spotify_preview' THEN 4 WHEN classification_source = 'itunes_isrc' THEN 3 WHEN classification_source = 'itunes_term_search' THEN 2 WHEN classification_source = 'unknown' THEN 1 ELSE 0 END"
_EPOCH = "coalesce(cast(epoch(try_strptime(substr(created_at, 1, 19), '%Y-%m-%d %H:%M:%S')) AS BIGINT), 0)"
_GROUPS = f"""k AS (SELECT id, 'a' || cast(apple_id AS VARCHAR) AS k FROM v_tracks WHERE apple_id IS NOT NULL AND apple_id <> 0 UNION ALL SELECT id, 'p' || spotify_id FROM v_tracks WHERE spotify_id <> ''
 UNION ALL SELECT id, 'r' || isrc FROM v_tracks WHERE isrc <> '' UNION ALL SELECT id, {_KEY} FROM v_tracks),
l AS (SELECT id, min(id) OVER (PARTITION BY k) AS m FROM k), e AS (SELECT DISTINCT id AS a, m AS b FROM l WHERE id <> m UNION SELECT DISTINCT m, id FROM l WHERE id <> m),
r(id, c) AS (SELECT id, id FROM v_tracks UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b OR e.b > r.c),
g AS (SELECT id, min(c) AS group_id FROM r GROUP BY id), t AS (SELECT v_tracks.*, group_id FROM v_tracks JOIN g USING (id))"""


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    return identity.groups(read(spark, sf, T))


@query(duck(T, f"SELECT id, {_KEY} AS dedup_key FROM v_tracks"))
def dedup_keys(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, T).select("id", text.dedup_key().alias("dedup_key"))


def _recursive(body: str) -> str:
    return duck(T, f"WITH {_GROUPS} {body}").replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive("SELECT id, group_id FROM t"))
def component_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Records that share an id, directly or in chains, by their least id."""
    return _grouped(spark, sf).select("id", "group_id")


@query(_recursive(f"SELECT group_id, id AS canonical_id FROM t QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {_RANK} DESC, {_EPOCH} DESC, id) = 1"))
def canonical_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return identity.canonical(_grouped(spark, sf)).select("group_id", F.col("id").alias("canonical_id"))


_FILL = lambda c: f"arg_min(CASE WHEN CAST({c} AS VARCHAR) <> '' THEN {c} END, CASE WHEN CAST({c} AS VARCHAR) <> '' THEN n END) AS {c}"


@query(_recursive(f"""SELECT group_id, arg_min(id, n) AS canonical_id, count(*) AS n_records, {_FILL('spotify_id')}, {_FILL('apple_id')}, {_FILL('preview_url')}
FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {_RANK} DESC, {_EPOCH} DESC, id) AS n FROM t) GROUP BY group_id"""))
def merged_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each group's values, the first there is in canonical order."""
    return identity.merged(_grouped(spark, sf), ["spotify_id", "apple_id", "preview_url"])


@query(_recursive(f"""SELECT count(DISTINCT group_id) AS groups, count(*) AS records, count(*) - count(DISTINCT group_id) AS saved,
 count(*) FILTER (n > 1 AND audio_path <> '' AND own <> '' AND audio_path <> own) AS conflicts
FROM (SELECT *, first_value(audio_path) OVER (PARTITION BY group_id ORDER BY {_RANK} DESC, {_EPOCH} DESC, id) AS own, row_number() OVER (PARTITION BY group_id ORDER BY {_RANK} DESC, {_EPOCH} DESC, id) AS n FROM t)"""))
def migration_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What merging saves, and how many siblings disagree with their canonical record's file."""
    rows = _grouped(spark, sf)
    best = identity.canonical(rows).select("group_id", F.col("id").alias("best"), F.col("audio_path").alias("own"))
    clash = (F.col("id") != F.col("best")) & (F.col("audio_path") != "") & (F.col("own") != "") & (F.col("audio_path") != F.col("own"))
    groups = F.count_if(F.col("id") == F.col("best"))
    return rows.join(best, "group_id").agg(groups.alias("groups"), F.count("*").alias("records"), (F.count("*") - groups).alias("saved"), F.count_if(clash).alias("conflicts"))


@query(_recursive("SELECT DISTINCT user_id, group_id AS track_id FROM (SELECT o_custkey AS user_id, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <= 50) u JOIN t ON t.id = u.l_partkey"))
def remapped_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the first users carried over to the merged records."""
    return identity.remapped(read(spark, sf, "v_user_tracks").where("user_id <= 50"), _grouped(spark, sf))


@query(_recursive("SELECT DISTINCT user_id, group_id AS track_id FROM (SELECT o_custkey AS user_id, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL) u JOIN t ON t.id = u.l_partkey"))
def remapped_links_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's links carried over to the merged records."""
    return identity.remapped(read(spark, sf, "v_user_tracks").where("user_id IS NOT NULL"), _grouped(spark, sf))


@query(duck(T, "SELECT id, CASE WHEN row_number() OVER (PARTITION BY spotify_id ORDER BY id) = 1 THEN spotify_id END AS spotify_id FROM v_tracks"))
def dedupe_null_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return identity.unique_key(read(spark, sf, T).select("id", "spotify_id"), "spotify_id")


_LATEST = "(SELECT * FROM v_manifest QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY line_no DESC) = 1)"


@query(duck(M, f"SELECT track_id, status, line_no, bytes FROM {_LATEST}"))
def manifest_latest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.compacted(read(spark, sf, M)).select("track_id", "status", "line_no", "bytes")


@query(duck(M, f"SELECT c_custkey AS track_id FROM customer WHERE c_custkey NOT IN (SELECT track_id FROM {_LATEST} WHERE status IN ('ok', 'no_preview'))"))
def manifest_todo(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.todo(read(spark, sf, "customer").select(F.col("c_custkey").alias("track_id")), read(spark, sf, M))


@query(duck(M, f"SELECT c_custkey AS track_id FROM customer WHERE c_custkey NOT IN (SELECT track_id FROM {_LATEST} WHERE status = 'ok')"))
def manifest_todo_retry(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.todo(read(spark, sf, "customer").select(F.col("c_custkey").alias("track_id")), read(spark, sf, M), retry_no_preview=True)


@query(duck(M, f"""SELECT coalesce(l.track_id, f.track_id) AS track_id, CASE WHEN f.track_id IS NOT NULL THEN 'ok' ELSE status END AS status, f.track_id IS NOT NULL AND coalesce(status <> 'ok', true) AS from_file
FROM {_LATEST} l FULL JOIN (SELECT c_custkey AS track_id FROM customer WHERE c_custkey % 3 = 0) f ON f.track_id = l.track_id"""))
def manifest_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    files = read(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("track_id"))
    return manifest.reconciled(read(spark, sf, M), files)


@query("""SELECT user_id, min(event_id) AS first FROM (SELECT * FROM events ORDER BY event_id LIMIT 500) GROUP BY user_id""")
def ids_capped_then_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The cap counts rows before repeats go."""
    return read(spark, sf, "events").orderBy("event_id").limit(500).groupBy("user_id").agg(F.min("event_id").alias("first"))


@query(duck(M, """SELECT count(*) AS processed, count(*) FILTER (status = 'ok') AS matched, count(*) FILTER (status = 'no_preview') AS no_preview, count(*) FILTER (status = 'download_failed') AS failed,
 count(*) - count(DISTINCT track_id) AS repeats, least(100, round(100.0 * count(DISTINCT track_id) / nullif((SELECT count(*) FROM customer), 0))) AS percent FROM v_manifest"""))
def ingest_progress(spark: SparkSession, sf: str) -> DataFrame:
    log, total = read(spark, sf, M), read(spark, sf, "customer").agg(F.count("*").alias("total"))
    n = lambda s: F.count_if(F.col("status") == s)
    counts = log.agg(F.count("*").alias("processed"), n("ok").alias("matched"), n("no_preview").alias("no_preview"), n("download_failed").alias("failed"), F.count_distinct("track_id").alias("ids"))
    both = counts.crossJoin(F.broadcast(total))
    percent = F.when(F.col("total") == 0, 0.0).otherwise(F.least(F.lit(100.0), F.round(100.0 * F.col("ids") / F.col("total"))))
    return both.select("processed", "matched", "no_preview", "failed", (F.col("processed") - F.col("ids")).alias("repeats"), percent.alias("percent"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


_TIER = "CASE WHEN lower(c.title) = lower(w.title) AND lower(c.artist) = lower(w.artist) THEN 1 WHEN contains(lower(c.title), lower(w.title)) AND contains(lower(c.artist), lower(w.artist)) THEN 2 WHEN c.preview_url <> '' THEN 3 END"
_CAND = "SELECT p_partkey AS pos, p_partkey % 97 AS wanted, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' live' ELSE '' END AS title, p_brand AS artist, CASE WHEN p_partkey % 4 > 0 THEN 'u' || cast(p_partkey AS VARCHAR) ELSE '' END AS preview_url FROM part"


@query(f"""WITH w AS (SELECT p_partkey AS wanted, p_name AS title, p_brand AS artist FROM part WHERE p_partkey < 97), c AS ({_CAND}), m AS (SELECT w.wanted, pos, {_TIER} AS tier FROM w JOIN c ON c.wanted = w.wanted)
SELECT wanted, pos, tier FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY tier, pos) = 1""")
def match_tiers_best(spark: SparkSession, sf: str) -> DataFrame:
    """The best of each of the first tracks' own candidates: exact, then containing, then any with a preview."""
    p, key = read(spark, sf, "part"), F.col("p_partkey")
    w = p.where("p_partkey < 97").select(key.alias("wanted"), F.lower("p_name").alias("w_title"), F.lower("p_brand").alias("w_artist"))
    return _best(w, _candidates(p).withColumn("wanted", F.col("pos") % 97), "wanted")


@query(f"""WITH w AS (SELECT p_partkey AS wanted, p_partkey // 20 AS list, p_name AS title, p_brand AS artist FROM part), c AS (SELECT *, pos // 20 AS list FROM ({_CAND})), m AS (SELECT w.wanted, pos, {_TIER} AS tier FROM w JOIN c ON c.list = w.list)
SELECT wanted, pos, tier FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY tier, pos) = 1""")
def match_tiers_best_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate of every track, from lists of twenty."""
    p, key = read(spark, sf, "part"), F.col("p_partkey")
    w = p.select(key.alias("wanted"), F.expr("p_partkey div 20").alias("list"), F.lower("p_name").alias("w_title"), F.lower("p_brand").alias("w_artist"))
    return _best(w, _candidates(p).withColumn("list", F.expr("pos div 20")), "list")


def _candidates(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(key.alias("pos"), F.lower(F.concat("p_name", F.when(key % 3 == 0, " live").otherwise(""))).alias("title"), F.lower("p_brand").alias("artist"), F.when(key % 4 > 0, F.concat(F.lit("u"), key.cast("string"))).otherwise("").alias("preview_url"))


def _best(wanted: DataFrame, candidates: DataFrame, on: str) -> DataFrame:
    exact = (F.col("title") == F.col("w_title")) & (F.col("artist") == F.col("w_artist"))
    tier = F.when(exact, 1).when(F.contains("title", "w_title") & F.contains("artist", "w_artist"), 2).when(F.col("preview_url") != "", 3)
    # lists meet by a shuffle and a track's pairs are folded as they come, under the join's own key: no task sorts or sends pairs
    rows = wanted.join(candidates.hint("merge"), on).withColumn("tier", tier).where("tier IS NOT NULL")
    firsts = rows.groupBy(*dict.fromkeys([on, "wanted"])).agg(*[F.min(F.when(F.col("tier") == t, F.col("pos"))).alias(f"_{t}") for t in (1, 2, 3)])
    best = F.when(F.col("_1").isNotNull(), 1).when(F.col("_2").isNotNull(), 2).otherwise(3)
    return firsts.select("wanted", F.coalesce("_1", "_2", "_3").alias("pos"), best.alias("tier"))


_HELD = """w AS (SELECT p_partkey AS wanted, lower(split_part(p_name, ' ', 2)) AS title, lower(p_brand) AS artist FROM part),
c AS (SELECT p_partkey AS pos, lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' live' ELSE '' END) AS title, lower(p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' & friends' ELSE '' END) AS artist FROM part WHERE p_partkey % 4 > 0)"""


@query(f"""WITH {_HELD}, m AS (SELECT wanted, pos, CASE WHEN c.title = w.title AND c.artist = w.artist THEN 1 ELSE 2 END AS tier FROM w JOIN c ON contains(c.title, w.title) AND contains(c.artist, w.artist) WHERE w.title <> '' AND w.artist <> '')
SELECT wanted, count(*) AS n_holding, min(tier) AS tier, arg_min(pos, tier * 1000000000000 + pos) AS pos FROM m GROUP BY wanted""")
def containment_matches(spark: SparkSession, sf: str) -> DataFrame:
    """For every track, how many candidates with a preview hold its title and artist, and the best of them: exact, then first."""
    p, key = read(spark, sf, "part"), F.col("p_partkey")
    w = p.select(key.alias("wanted"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("title"), F.lower("p_brand").alias("artist"))
    c = p.where(key % 4 > 0).select(
        key.alias("pos"), F.lower(F.concat("p_name", F.when(key % 3 == 0, " live").otherwise(""))).alias("title"), F.lower(F.concat("p_brand", F.when(key % 2 == 0, " & friends").otherwise(""))).alias("artist")
    )
    texts = c.groupBy(F.col("title").alias("t_title"), F.col("artist").alias("t_artist")).agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    tier = F.when((F.col("t_title") == F.col("w_title")) & (F.col("t_artist") == F.col("w_artist")), 1).otherwise(2)
    met = containment.containing(w, c, ["title", "artist"]).join(texts, ["t_title", "t_artist"]).withColumn("tier", tier)
    best = met.groupBy("w_title", "w_artist").agg(F.sum("n").alias("n_holding"), F.min("tier").alias("tier"), F.min_by("pos", F.struct("tier", "pos")).alias("pos"))
    return w.join(best, (F.col("title") == F.col("w_title")) & (F.col("artist") == F.col("w_artist"))).select("wanted", "n_holding", "tier", "pos")


@query(duck(T, """WITH w AS (SELECT id, isrc, title, artist FROM v_tracks WHERE id % 5 = 1), i AS (SELECT isrc, min(id) AS hit FROM v_tracks WHERE isrc IS NOT NULL AND id % 5 <> 1 GROUP BY isrc),
s AS (SELECT lower(title) AS lt, lower(artist) AS la, min(id) AS hit FROM v_tracks WHERE id % 5 <> 1 GROUP BY 1, 2)
SELECT w.id, coalesce(i.hit, s.hit) AS hit, CASE WHEN i.hit IS NOT NULL THEN 'itunes_isrc' WHEN s.hit IS NOT NULL THEN 'itunes_term_search' ELSE 'none' END AS source FROM w LEFT JOIN i ON i.isrc = w.isrc LEFT JOIN s ON lt = lower(title) AND la = lower(artist)"""))
def match_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """By recording code, else by title and artist, with the step that found it."""
    t = read(spark, sf, T).select("id", "isrc", F.lower("title").alias("lt"), F.lower("artist").alias("la"))
    wanted, known = t.where("id % 5 = 1"), t.where("id % 5 <> 1")
    by_code = known.where("isrc IS NOT NULL").groupBy("isrc").agg(F.min("id").alias("code_hit"))
    by_name = known.groupBy("lt", "la").agg(F.min("id").alias("name_hit"))
    source = F.when(F.col("code_hit").isNotNull(), "itunes_isrc").when(F.col("name_hit").isNotNull(), "itunes_term_search").otherwise("none")
    return wanted.join(by_code, "isrc", "left").join(by_name, ["lt", "la"], "left").select("id", F.coalesce("code_hit", "name_hit").alias("hit"), source.alias("source"))


@query("""SELECT user_id, event_id AS candidate, step FROM (SELECT *, event_id % 6 AS step FROM events WHERE event_type <> 'error' AND coalesce(nullif(event_id % 5, 0) <> 1, true))
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY step, event_id) = 1""")
def eligible_first_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """The first eligible candidate along a ladder of searches; unknown flags don't rule one out."""
    flag = F.nullif(F.col("event_id") % 5, F.lit(0))
    rows = read(spark, sf, "events").where((F.col("event_type") != "error") & F.coalesce(flag != 1, F.lit(True))).withColumn("step", F.col("event_id") % 6)
    return library.first_of(rows, "user_id", F.col("step"), F.col("event_id")).select("user_id", F.col("event_id").alias("candidate"), "step")


_CATALOGUE = "SELECT p_partkey AS cat, 'IS' || cast(p_partkey * 2 % 3800 AS VARCHAR) AS isrc, lower(p_name) AS title, lower(p_brand) AS artist FROM part WHERE p_partkey % 9 = 0"


@query(duck(T, f"""WITH c AS ({_CATALOGUE}), i AS (SELECT isrc, min(cat) AS hit FROM c GROUP BY 1), s AS (SELECT title, artist, min(cat) AS hit FROM c GROUP BY 1, 2)
SELECT id, CASE WHEN spotify_id <> '' THEN spotify_id ELSE coalesce(i.hit, s.hit)::VARCHAR END AS hit,
 CASE WHEN spotify_id <> '' THEN 'already' WHEN i.hit IS NOT NULL THEN 'isrc' WHEN s.hit IS NOT NULL THEN 'title_artist' ELSE 'missed' END AS outcome
FROM v_tracks t LEFT JOIN i ON i.isrc = t.isrc LEFT JOIN s ON s.title = lower(t.title) AND s.artist = lower(t.artist)"""))
def match_external_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Outer ids for the tracks that lack one: by recording code, and what that leaves by title and artist."""
    p = read(spark, sf, "part").where("p_partkey % 9 = 0")
    code = F.concat(F.lit("IS"), (F.col("p_partkey") * 2 % 3800).cast("string"))
    catalogue = p.select(F.col("p_partkey").alias("cat"), code.alias("c_isrc"), F.lower("p_name").alias("c_title"), F.lower("p_brand").alias("c_artist"))
    by_code = catalogue.groupBy("c_isrc").agg(F.min("cat").alias("hit"))
    by_name = catalogue.groupBy("c_title", "c_artist").agg(F.min("cat").alias("hit"))
    steps = [
        ("isrc", lambda left: left.join(by_code, F.col("isrc") == F.col("c_isrc")).select("id", "hit")),
        ("title_artist", lambda left: left.join(by_name, (F.lower("title") == F.col("c_title")) & (F.lower("artist") == F.col("c_artist"))).select("id", "hit")),
    ]
    tracks = read(spark, sf, T).select("id", "spotify_id", "isrc", "title", "artist")
    return ladder.climb(tracks, steps, already=text.filled(F.col("spotify_id"))).rows


@query(duck(M, f"""SELECT coalesce(l.track_id, f.track_id) AS track_id, CASE WHEN f.track_id IS NOT NULL THEN 'ok' ELSE status END AS status, f.track_id IS NOT NULL AND coalesce(status <> 'ok', true) AS from_file
FROM {_LATEST} l FULL JOIN (SELECT c_custkey AS track_id FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1) f ON f.track_id = l.track_id"""))
def manifest_reconciled_files(spark: SparkSession, sf: str) -> DataFrame:
    """The log against files that are really there: tasks write them, of 10,000 and 10,001 bytes in folders by key, and list them."""
    ship(spark)
    root = f"{shared_dir(spark)}/tunelode/{uuid.uuid4().hex}/previews"

    def write(pdfs):  # noqa: ANN001, ANN202 - batches of keys
        for pdf in pdfs:
            for key in pdf.c_custkey:
                listing.write_bytes(f"{root}/{key % 7}/{key}.mp3", bytes(10_000 + key % 2))
            yield pdf

    made = read(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_custkey")
    made.mapInPandas(write, "c_custkey long").write.format("noop").mode("overwrite").save()
    there = files.downloaded(files.list_tree(spark, root)).select(F.col("track_id").cast("long").alias("track_id"))
    return manifest.reconciled(read(spark, sf, M), there)
