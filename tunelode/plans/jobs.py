"""Queries on client values, headers and stamps, nested documents, candidate ladders and the jobs that write back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import client, scoring, text
from ..operators import changes, identity, library
from ..sources.views import duck, read
from . import library as lib
from .entities import _recursive
from .registry import query

T, M = "v_tracks", "v_manifest"


def _part(spark: SparkSession, sf: str, **columns: str) -> DataFrame:
    """part's key as id, and columns by SQL that both engines read alike."""
    rows = read(spark, sf, "part")
    return rows.select(F.col("p_partkey").alias("id"), *[F.expr(x.replace("VARCHAR", "STRING")).alias(c) for c, x in columns.items()])


def _from_part(body: str, **columns: str) -> str:
    cols = ", ".join(f"{x} AS {c}" for c, x in columns.items())
    return f"WITH x AS (SELECT p_partkey AS id, {cols} FROM part) {body}"


# Lookups and scans

_KEYS = {
    "k": """CASE p_partkey % 4 WHEN 0 THEN cast(p_partkey % 1700 AS VARCHAR) WHEN 1 THEN 'sp' || cast(p_partkey % 1500 AS VARCHAR)
 WHEN 2 THEN '99999999' ELSE 'none' || cast(p_partkey AS VARCHAR) END"""
}


@query(duck(T, _from_part("""
SELECT x.id, coalesce((SELECT min(t.id) FROM v_tracks t WHERE t.apple_id = try_cast(k AS BIGINT)),
                      (SELECT min(t.id) FROM v_tracks t WHERE t.spotify_id = k)) AS track_id FROM x""", **_KEYS)))
def dual_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A track by a key: a number finds an apple_id; what isn't one, or finds none, a spotify_id."""
    tracks, keys = read(spark, sf, T), _part(spark, sf, **_KEYS)
    by = lambda c: tracks.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("id").alias(f"by_{c}"))
    found = keys.withColumn("apple_id", F.col("k").try_cast("long")).join(by("apple_id"), "apple_id", "left")
    found = found.withColumnRenamed("k", "spotify_id").join(by("spotify_id"), "spotify_id", "left")
    return found.select("id", F.coalesce("by_apple_id", "by_spotify_id").alias("track_id"))


@query(duck(T, "SELECT id, title, artist, audio_path FROM v_tracks WHERE id = 42"))
def track_by_id(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, T).where("id = 42").select("id", "title", "artist", "audio_path")


@query(duck(T, "SELECT id, title, artist, album, isrc, tempo, energy, vibe_score, NULL::VARCHAR AS genre, NULL::BIGINT AS duration_ms FROM v_tracks"))
def legacy_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The old table's columns; what a table lacks is NULL."""
    cols = ["id", "title", "artist", "album", "isrc", "tempo", "energy", "vibe_score", "genre", "duration_ms"]
    return changes.with_columns(read(spark, sf, T), {"genre": "string", "duration_ms": "long"}).select(*cols)


@query("""SELECT c_custkey AS user_id, coalesce(n, 0) AS liked, least(coalesce(n, 0), 50) AS top
FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = c_custkey""")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many items a user's sources hold; the top list never shows more than 50."""
    n = read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(n, "user_id", "left")
    total = F.coalesce("n", F.lit(0))
    return users.select("user_id", total.alias("liked"), F.least(total, F.lit(50)).alias("top"))


@query("""SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2""")
def paged_items_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The first items of each paged listing, in page order, up to a cap."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return read(spark, sf, "conversations").withColumn("n", place).where("n <= 2").select("conv_id", "turn", "role")


# Flags

@query(duck(T, """SELECT id, coalesce(length(preview_url), 0) > 0 AS has_preview, coalesce(length(audio_path), 0) > 0 AS has_file,
 coalesce(classification_source, '') <> 'none' AND coalesce(preview_url, '') <> '' AS verifiable,
 CASE WHEN coalesce(classification_source, '') = '' THEN 'Unknown' WHEN classification_source = 'spotify_preview' THEN 'Spotify preview'
  WHEN classification_source = 'itunes_isrc' THEN 'iTunes ISRC lookup' WHEN classification_source = 'itunes_term_search' THEN 'iTunes term search'
  WHEN classification_source = 'none' THEN 'No classification audio' ELSE classification_source END AS label FROM v_tracks"""))
def client_flags(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    source = F.col("classification_source")
    return read(spark, sf, T).select(
        "id", some("preview_url").alias("has_preview"), some("audio_path").alias("has_file"),
        client.verifiable(source, F.col("preview_url")).alias("verifiable"), client.source_label(source).alias("label"),
    )


@query(duck("v_links", "SELECT coalesce(user_id, 1) AS user_id, track_id, coalesce(user_id = 7, false) AS mine FROM v_links"))
def default_user_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Links without a user go to the first one; a link of an unknown user is nobody's own."""
    links = read(spark, sf, "v_links")
    return links.select(F.coalesce("user_id", F.lit(1)).alias("user_id"), "track_id", F.coalesce(F.col("user_id") == 7, F.lit(False)).alias("mine"))


@query(duck(T, f"SELECT id, {' AND '.join(f'{c} IS NOT NULL' for c in scoring.FEATURES)} AS complete FROM v_tracks"))
def features_complete(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, T).select("id", _complete().alias("complete"))


def _complete() -> Column:
    full = F.lit(True)
    for c in scoring.FEATURES:
        full &= F.col(c).isNotNull()
    return full


# Values that a client shows

_NUMBERS = {"v": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE (p_partkey % 400 - 100) / 64.0 END", "most": "p_partkey % 3 * 2.0"}
_CLAMP = lambda x: f"greatest(0.0, least(100.0, {x}))"


@query(_from_part(f"""
SELECT id, round(CASE WHEN v > 1.5 THEN {_CLAMP('v')} ELSE {_CLAMP('v * 100.0')} END, 6) AS percent,
 round(CASE WHEN most > 0 AND v IS NOT NULL THEN {_CLAMP('v / most * 100.0')} END, 6) AS of_most,
 round(CASE WHEN most > 0 AND v IS NOT NULL THEN {_CLAMP('abs(v) / most * 100.0')} END, 6) AS of_most_signed,
 CASE WHEN v IS NULL THEN '' WHEN v > 0 THEN 'major-leaning' WHEN v < 0 THEN 'minor-leaning' ELSE 'neutral' END AS lean,
 round(pow(10.0, v / 20.0), 6) AS gain
FROM (SELECT id, v::DOUBLE AS v, most::DOUBLE AS most FROM x)""", **_NUMBERS).replace(_CLAMP("v"), f"CASE WHEN v IS NOT NULL THEN {_CLAMP('v')} END")
 .replace(_CLAMP("v * 100.0"), f"CASE WHEN v IS NOT NULL THEN {_CLAMP('v * 100.0')} END"))
def bar_percents(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of shares, percents and values with a ceiling, the mode's label and a gain's factor."""
    rows = _part(spark, sf, **_NUMBERS).select("id", F.col("v").cast("double").alias("v"), F.col("most").cast("double").alias("most"))
    v, most = F.col("v"), F.col("most")
    return rows.select(
        "id", F.round(client.percent(v), 6).alias("percent"), F.round(client.percent_of(v, most), 6).alias("of_most"),
        F.round(client.percent_of(v, most, signed=True), 6).alias("of_most_signed"), client.lean(v).alias("lean"), F.round(client.gain(v), 6).alias("gain"),
    )


@query(_from_part("""
SELECT id, 'rgb(' || floor(40 + (220 - 40) * t + 0.5)::BIGINT || ', ' || floor(80 + (60 - 80) * t + 0.5)::BIGINT || ', ' || floor(200 + (30 - 200) * t + 0.5)::BIGINT || ')' AS accent
FROM (SELECT id, least(1.0, greatest(0.0, (s - 10) / 32.0)) AS t FROM x)""", s="p_size"))
def accent_colours(spark: SparkSession, sf: str) -> DataFrame:
    """A colour between two, by where a value lies in a span."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s") - 10) / 32.0))
    mix = client.rgb(*[client.between(a, b, t) for a, b in ((40.0, 220.0), (80.0, 60.0), (200.0, 30.0))])
    return _part(spark, sf, s="p_size").select("id", mix.alias("accent"))


_SHOWN = {
    "name": "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_brand ELSE ' ' || p_name || '  x' END",
    "sec": "CASE p_partkey % 7 WHEN 0 THEN -5 ELSE p_partkey % 4000 END",
    "ms": "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN -1 WHEN 2 THEN p_partkey * 100 ELSE p_partkey * 4321 END",
}


@query(_from_part(r"""
SELECT id, CASE WHEN trim(name) = '' THEN '?' WHEN len(w) = 1 THEN upper(substr(w[1], 1, 1)) ELSE upper(substr(w[1], 1, 1) || substr(w[-1], 1, 1)) END AS initials,
 (greatest(sec, 0) // 60) || ':' || lpad((greatest(sec, 0) % 60)::VARCHAR, 2, '0') AS clock,
 CASE WHEN ms IS NULL THEN '—' WHEN ms <= 0 THEN 'expired' WHEN s >= 3600 THEN 'in ' || (s // 3600) || 'h ' || (s % 3600 // 60) || 'm'
  WHEN s >= 60 THEN 'in ' || (s // 60) || 'm ' || (s % 60) || 's' ELSE 'in ' || s || 's' END AS expiry
FROM (SELECT *, regexp_split_to_array(trim(name), '\s+') AS w, ms // 1000 AS s FROM x)""", **_SHOWN))
def shown_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Initials, running times and times left."""
    rows = _part(spark, sf, **_SHOWN)
    return rows.select("id", client.initials(F.col("name")).alias("initials"), text.clock(F.col("sec").cast("double")).alias("clock"), client.expiry(F.col("ms")).alias("expiry"))


# Headers, numbers in text, stamps

_HEADERS = {
    "size": "p_size * 100",
    "range": """CASE p_partkey % 6 WHEN 0 THEN 'bytes=-' || cast(p_partkey AS VARCHAR) WHEN 1 THEN 'bytes=' || cast(p_partkey AS VARCHAR) || '-'
 WHEN 2 THEN 'bytes=10-' || cast(p_partkey AS VARCHAR) WHEN 3 THEN 'bytes=-' WHEN 4 THEN 'bytes=-0' ELSE 'items=1-2' END""",
    "auth": "CASE p_partkey % 5 WHEN 0 THEN 'Bearer  t' || cast(p_partkey AS VARCHAR) || ' ' WHEN 1 THEN 'bearer' WHEN 2 THEN 'Basic abc' WHEN 3 THEN 'BEARER x y' END",
    "tok": "CASE p_partkey % 4 WHEN 0 THEN ' \"Bearer t' || cast(p_partkey AS VARCHAR) || '\" ' WHEN 1 THEN 'plain' WHEN 2 THEN '''q'' ' END",
    "q": "CASE p_partkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN p_name ELSE repeat(p_name, 12) END",
}


@query(_from_part(r"""
, y AS (SELECT *, try_cast(nullif(regexp_extract(range, '^bytes=([0-9]*)-([0-9]*)$', 1), '') AS BIGINT) AS a, try_cast(nullif(regexp_extract(range, '^bytes=([0-9]*)-([0-9]*)$', 2), '') AS BIGINT) AS b FROM x),
z AS (SELECT *, CASE WHEN a IS NOT NULL THEN a WHEN b > 0 THEN greatest(0, size - b) END AS s, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE size - 1 END AS e FROM y)
SELECT id, CASE WHEN s < size AND e < size AND s <= e THEN s END AS start, CASE WHEN s < size AND e < size AND s <= e THEN e - s + 1 END AS length,
 CASE id % 5 WHEN 0 THEN 't' || id WHEN 3 THEN 'x y' END AS bearer, CASE id % 4 WHEN 0 THEN 't' || id WHEN 1 THEN 'plain' WHEN 2 THEN 'q' ELSE '' END AS token,
 length(trim(q)) BETWEEN 1 AND 300 AS good_query, greatest(1, least(size, 10)) AS n FROM z""", **_HEADERS).replace(") \n, y AS", "), y AS"))
def header_values(spark: SparkSession, sf: str) -> DataFrame:
    """Byte ranges, tokens of headers, and the bounds of a search."""
    rows = _part(spark, sf, **_HEADERS).withColumn("r", client.byte_range(F.col("range"), F.col("size")))
    return rows.select(
        "id", F.col("r.start").alias("start"), F.col("r.length").alias("length"), client.bearer(F.col("auth")).alias("bearer"), client.token(F.col("tok")).alias("token"),
        F.length(F.trim("q")).between(1, 300).alias("good_query"), F.greatest(F.lit(1), F.least(F.col("size"), F.lit(10))).alias("n"),
    )


_TEXTS = {
    "l": "'-' || cast(p_partkey AS VARCHAR) || ', +5,, 1.5, ' || cast(p_size AS VARCHAR) || ' ,x'",
    "n": "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'x' WHEN 2 THEN '12.7' WHEN 3 THEN ' 7 ' WHEN 4 THEN NULL WHEN 5 THEN '-3' ELSE cast(p_partkey AS VARCHAR) END",
    "st": "CASE p_partkey % 5 WHEN 0 THEN '2024-03-01T10:00:05Z' WHEN 1 THEN '2024-03-01 10:00:05.25' WHEN 2 THEN 'soon' WHEN 3 THEN NULL ELSE '2023-12-31 23:59:59' END",
    "u": """CASE p_partkey % 4 WHEN 0 THEN 'listen on Spotify: ' || substr(md5(cast(p_partkey AS VARCHAR)), 1, 22) || '!' WHEN 1 THEN 'elsewhere ' || substr(md5(cast(p_partkey AS VARCHAR)), 1, 22)
 WHEN 2 THEN 'https://open.example.com/embed/playlist/' || substr(md5(cast(p_partkey AS VARCHAR)), 1, 22) ELSE 'short' END""",
}


@query(_from_part("""
SELECT id, (-id) || ',5,' || replace(split_part(l, ',', 5), ' ', '') AS ids,
 CASE id % 7 WHEN 3 THEN 7 WHEN 5 THEN -3 WHEN 6 THEN id ELSE 0 END AS number,
 CASE id % 5 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN 1704067199 ELSE 1709287205 END AS seconds,
 CASE WHEN id % 4 IN (0, 2) THEN substr(md5(id::VARCHAR), 1, 22) END AS playlist FROM x""", **_TEXTS))
def texts_to_values(spark: SparkSession, sf: str) -> DataFrame:
    """Signed lists, numbers, stamps of three forms and ids in loose text."""
    rows = _part(spark, sf, **_TEXTS)
    ids = F.array_join(F.transform(text.int_list(F.col("l")), lambda v: v.cast("string")), ",")
    return rows.select(
        "id", ids.alias("ids"), client.whole_number(F.col("n")).alias("number"), text.epoch(F.col("st")).alias("seconds"), text.playlist_id(F.col("u")).alias("playlist"),
    )


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS compact, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def stamp_forms(spark: SparkSession, sf: str) -> DataFrame:
    stamp = lambda f: F.date_format("ts", f)
    return read(spark, sf, "events").select("event_id", stamp("yyyyMMdd_HHmmss").alias("compact"), stamp("yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


_FALSY = {
    "a": "CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0' END", "b": "CASE WHEN p_partkey % 2 = 0 THEN p_brand END",
    "n": "cast(p_partkey % 3 AS BIGINT)", "d": "cast(p_partkey % 2 AS DOUBLE)",
}


@query(_from_part("SELECT id, coalesce(nullif(a, ''), b) AS word, coalesce(nullif(n, 0), 99) AS number, coalesce(nullif(d, 0), -1.0::DOUBLE) AS real FROM x", **_FALSY))
def first_filled_values(spark: SparkSession, sf: str) -> DataFrame:
    """The first value there is: '' and 0 are none, the text '0' is one."""
    rows = _part(spark, sf, **_FALSY)
    c = F.col
    return rows.select("id", text.first_filled(c("a"), c("b")).alias("word"), text.first_filled(c("n"), F.lit(99)).alias("number"), text.first_filled(c("d"), F.lit(-1.0)).alias("real"))


# Nested documents

_DOC = "struct<id:string,name:string,artists:array<struct<name:string>>,images:array<struct<url:string,width:int,height:int>>,is_local:boolean>"
_NESTED = {
    "j": """CASE p_partkey % 6 WHEN 0 THEN '{"track":null}' WHEN 1 THEN 'not json' ELSE '{"' || CASE WHEN p_partkey % 2 = 0 THEN 'track' ELSE 'item' END || '":{"id":"s' || cast(p_partkey AS VARCHAR)
 || '","name":"' || p_brand || '","artists":[' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '{"name":"' || p_type || '"},{"name":"b"}' END
 || '],"images":[{"url":"small","width":2,"height":2},' || CASE WHEN p_partkey % 5 = 0 THEN '{"url":null,"width":9,"height":9}' ELSE '{"url":"big","width":4,"height":4},{"url":"same","width":8,"height":2}' END
 || '],"is_local":' || CASE WHEN p_partkey % 7 = 0 THEN 'true' ELSE 'false' END || '}}' END""",
    "m": "p_type", "b": "p_brand",
}


@query(_from_part("""
SELECT id, 's' || id AS spotify_id, b AS title, CASE WHEN id % 4 > 0 THEN m END AS artist, CASE WHEN id % 5 = 0 THEN 'small' ELSE 'big' END AS image
FROM x WHERE id % 6 > 1 AND id % 7 > 0""", **_NESTED))
def nested_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Track documents in either of two shapes, flattened; local ones, ones without an id and bad text go."""
    doc = F.from_json("j", f"track {_DOC}, item {_DOC}")
    rows = _part(spark, sf, **_NESTED).select("id", F.coalesce(doc["track"], doc["item"]).alias("t")).where("t.id IS NOT NULL AND NOT coalesce(t.is_local, false)")
    artist = F.try_element_at("t.artists", F.lit(1))["name"]
    return rows.select("id", F.col("t.id").alias("spotify_id"), F.col("t.name").alias("title"), artist.alias("artist"), client.best_image(F.col("t.images"), F.lit("none")).alias("image"))


_LISTS = {"j": "CASE p_partkey % 4 WHEN 0 THEN '[1,2' WHEN 1 THEN NULL ELSE '[' || cast(p_partkey AS VARCHAR) || ',' || cast(p_size AS VARCHAR) || '.5]' END", "s": "p_size"}


@query(_from_part("SELECT id, CASE WHEN id % 4 > 1 THEN id + s + 0.5 ELSE 0 END::DOUBLE AS total, CASE WHEN id % 4 > 1 THEN 2 ELSE 0 END AS n FROM x", **_LISTS))
def json_list_values(spark: SparkSession, sf: str) -> DataFrame:
    """Lists from JSON text; bad text and none are empty lists."""
    values = F.coalesce(F.from_json("j", "array<double>"), F.array().cast("array<double>"))
    return _part(spark, sf, **_LISTS).select("id", F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(values).alias("n"))


# Candidates

@query(duck(T, """SELECT id, unnest(range(0, 6)) AS step, unnest(['"' || title || ' - ' || artist || ' official music video"', '"' || title || ' - ' || artist || '"',
 title || ' ' || artist || ' official music video', title || ' ' || artist, title, artist]) AS search FROM v_tracks"""))
def search_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, T).select("id", F.posexplode(client.search_forms(F.col("title"), F.col("artist"))).alias("step", "search"))


_VIDEOS = """SELECT p_partkey // 12 AS wanted, p_partkey % 6 AS step, p_partkey AS pos, 'v' || cast(p_partkey % 5 AS VARCHAR) AS video,
 CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS embeddable, CASE p_partkey % 5 WHEN 2 THEN 18 WHEN 3 THEN NULL ELSE 0 END AS age_limit,
 CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'private' WHEN 2 THEN 'unlisted' ELSE 'public' END AS availability,
 CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'is_upcoming' ELSE 'was_live' END AS live_status FROM part"""


@query(f"""WITH v AS ({_VIDEOS}), f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY wanted, video ORDER BY step, pos) = 1)
SELECT wanted, video, step, pos FROM f WHERE coalesce(embeddable, true) AND coalesce(age_limit, 0) = 0 AND coalesce(availability IN ('public', 'unlisted'), true)
 AND coalesce(live_status NOT IN ('is_upcoming', 'post_live'), true) QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY step, pos) = 1""")
def first_eligible_video(spark: SparkSession, sf: str) -> DataFrame:
    """For each wanted item the first video of its searches that may be shown; a video counts where it is met first."""
    part = read(spark, sf, "part")
    videos = spark.sql(_VIDEOS.replace("VARCHAR", "STRING").replace("//", "div").replace("FROM part", "FROM {part}"), part=part)
    order = (F.col("step"), F.col("pos"))
    met = library.first_of(videos, ["wanted", "video"], *order)
    ok = client.eligible(*[F.col(c) for c in ("embeddable", "age_limit", "availability", "live_status")])
    return library.first_of(met.where(ok), "wanted", *order).select("wanted", "video", "step", "pos")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events),
r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM l WHERE n = 1)
SELECT user_id, event_type, event_id, place - 1 AS place FROM r WHERE place BETWEEN 2 AND 5""")
def recent_without_current(spark: SparkSession, sf: str) -> DataFrame:
    """Of each user's five latest items those before the current one."""
    rows = library.recent(read(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"], 5)
    return rows.where("place > 1").select("user_id", "event_type", "event_id", (F.col("place") - 1).alias("place"))


# Training frame from the log

@query(duck(f"{T} {M}", """SELECT t.id, m.line_no, t.tempo FROM v_tracks t JOIN (SELECT track_id, line_no FROM v_manifest WHERE status = 'ok') m ON m.track_id = t.id
WHERE t.audio_path <> '' AND tempo IS NOT NULL AND energy IS NOT NULL"""))
def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with all targets and a file, once for every ok line of the log: repeated lines multiply."""
    tracks = read(spark, sf, T).dropna(subset=["tempo", "energy"])
    files = read(spark, sf, T).where("audio_path <> ''").select("id")
    done = read(spark, sf, M).where("status = 'ok'").select(F.col("track_id").alias("id"), "line_no")
    return tracks.join(done, "id").join(files, "id", "left_semi").select("id", "line_no", "tempo")


# Counts of jobs

_OUTCOME = "CASE WHEN audio_path <> '' THEN 'already' WHEN coalesce(preview_url, '') = '' THEN 'no_url' WHEN contains(preview_url, 'example.org') THEN 'failed' ELSE 'ok' END"


@query(duck(T, f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM v_tracks GROUP BY 1"))
def backfill_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What a backfill of files did, by class."""
    url = F.coalesce("preview_url", F.lit(""))
    outcome = F.when(F.col("audio_path") != "", "already").when(url == "", "no_url").when(url.contains("example.org"), "failed").otherwise("ok")
    return read(spark, sf, T).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS matched, count(*) FILTER (event_type = 'view') AS preview_only, count(*) FILTER (event_type = 'error') AS no_preview,
 count(*) FILTER (event_type NOT IN ('purchase', 'signup', 'view', 'error')) AS skipped, count(*) AS processed FROM events GROUP BY user_id""")
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind.isin("purchase", "signup"), "matched").when(kind == "view", "preview_only").when(kind == "error", "no_preview").otherwise("skipped")
    classes = ("matched", "preview_only", "no_preview", "skipped")
    rows = read(spark, sf, "events").select("user_id", outcome.alias("outcome"))
    return rows.groupBy("user_id").agg(*[F.count_if(F.col("outcome") == c).alias(c) for c in classes], F.count("*").alias("processed"))


@query("""WITH c AS (SELECT user_id, count(*) AS done, count(*) FILTER (event_type <> 'error') AS hits, epoch(max(ts)) - epoch(min(ts)) AS s FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN s > 0 THEN done / s ELSE 0 END, 9) AS rate, round(CASE WHEN s > 0 THEN greatest(1000 - done, 0) / (done / s) / 60 ELSE 0 END, 4) AS eta_min,
 round(hits / done * 100, 6) AS hit_percent FROM c""")
def progress_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Items a second, minutes left of a thousand, and the share of hits."""
    at = lambda f: F.unix_micros(f("ts").cast("timestamp")) / 1e6
    c = read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("done"), F.count_if(F.col("event_type") != "error").alias("hits"), (at(F.max) - at(F.min)).alias("s"))
    rate = F.when(F.col("s") > 0, F.col("done") / F.col("s"))
    left = F.greatest(1000 - F.col("done"), F.lit(0)) / rate / 60
    return c.select("user_id", F.round(F.coalesce(rate, F.lit(0.0)), 9).alias("rate"), F.round(F.coalesce(left, F.lit(0.0)), 4).alias("eta_min"), F.round(F.col("hits") / F.col("done") * 100, 6).alias("hit_percent"))


@query("""SELECT user_id, sum(CASE WHEN event_id % 2 = 0 OR event_type = 'purchase' THEN event_id % 10 ELSE 0 END)::BIGINT AS total, count(*) FILTER (event_id % 2 = 0 OR event_type = 'purchase') AS selected FROM events GROUP BY user_id""")
def selected_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The sum over what is selected."""
    on = (F.col("event_id") % 2 == 0) | (F.col("event_type") == "purchase")
    return read(spark, sf, "events").groupBy("user_id").agg(F.sum(F.when(on, F.col("event_id") % 10).otherwise(0)).cast("long").alias("total"), F.count_if(on).alias("selected"))


# Jobs that write back

@query(duck(T, """SELECT id, CASE WHEN youtube_id IS NULL AND youtube_queried_at IS NULL AND id % 3 <> 1 THEN 'new' || id ELSE youtube_id END AS youtube_id,
 CASE WHEN youtube_id IS NULL AND youtube_queried_at IS NULL THEN '2024-06-01 00:00:00' ELSE youtube_queried_at END AS youtube_queried_at FROM v_tracks"""))
def cached_field_update(spark: SparkSession, sf: str) -> DataFrame:
    """Pending rows get a result, a miss too, and the time of asking."""
    tracks = read(spark, sf, T).select("id", "youtube_id", "youtube_queried_at")
    pending = tracks.where("youtube_id IS NULL AND youtube_queried_at IS NULL")
    results = pending.select("id", F.when(F.col("id") % 3 != 1, F.concat(F.lit("new"), F.col("id").cast("string"))).alias("youtube_id"))
    return changes.update(tracks, results, "id", F.lit("2024-06-01 00:00:00"), "youtube_queried_at")


@query(duck(T, """SELECT id, CASE WHEN energy_pred IS NULL OR model_version IS NULL OR model_version <> 'v1' THEN round(coalesce(energy, 0.0) / 2, 6) ELSE round(vibe_score_ml, 6) END AS vibe_score_ml,
 CASE WHEN energy_pred IS NULL OR model_version IS NULL OR model_version <> 'v1' THEN 'v1' ELSE model_version END AS model_version FROM v_tracks"""))
def predict_pending_job(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without the current model's result are predicted and updated; the others stay."""
    tracks = read(spark, sf, T)
    pending = tracks.where(F.col("energy_pred").isNull() | ~F.col("model_version").eqNullSafe(F.lit("v1")))
    results = pending.select("id", (F.coalesce("energy", F.lit(0.0)) / 2).alias("vibe_score_ml"), F.lit("v1").alias("model_version"))
    out = changes.update(tracks.select("id", "vibe_score_ml", "model_version"), results, "id")
    return out.select("id", F.round("vibe_score_ml", 6).alias("vibe_score_ml"), "model_version")


@query("""SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey) AS id, s_name AS name, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END, 0) AS country, 'free' AS plan FROM supplier""")
def insert_with_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """New users after the largest id; missing and NULL columns take their defaults."""
    from ..operators.evaluation import numbered

    top = read(spark, sf, "customer").agg(F.max("c_custkey").alias("top"))
    new = numbered(read(spark, sf, "supplier"), "s_suppkey").crossJoin(F.broadcast(top))
    new = new.select((F.col("top") + F.col("place")).alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey")).alias("country"))
    return changes.with_defaults(new, {"country": F.lit(0), "plan": F.lit("free")})


_FULL = " AND ".join(f"{c} IS NOT NULL" for c in scoring.FEATURES)
#: Tracks with a file.  A track whose features are complete keeps its stored scores, for which the views' vibe_score stands.
RECOMPUTED = duck(T, f"""WITH {lib._AXES}, e AS (SELECT id, CASE WHEN {_FULL} THEN 'kept' ELSE 'recomputed' END AS outcome, CASE WHEN {_FULL} THEN vibe_score ELSE a END AS x,
 CASE WHEN {_FULL} THEN vibe_score / 2 ELSE v END AS y, CASE WHEN {_FULL} THEN 'stored' ELSE {lib._MOOD} END AS mood FROM axes WHERE audio_path <> ''),
s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM e)
SELECT id, outcome, round(x, 6) AS activation, round(y, 6) AS valence, mood,
 round(CASE WHEN x IS NULL THEN NULL WHEN sd <= 1e-9 THEN 50.0 ELSE least(greatest(50.0 + (x - m) / sd * 15.0, 0.0), 100.0) END, 6) AS activation_relative FROM e, s""")


def stored_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with a file, their features and the scores that they have."""
    half = F.col("vibe_score") / 2
    rows = read(spark, sf, T).where("audio_path <> ''")
    return rows.select("id", *scoring.FEATURES, F.col("vibe_score").alias("activation"), half.alias("valence"), F.lit("stored").alias("mood"))


def rescored(rows: DataFrame) -> DataFrame:
    """rows with scores and label from their features."""
    a, v = scoring.activation(), scoring.valence()
    return rows.withColumns({"activation": a, "valence": v}).withColumn("mood", scoring.mood(F.col("activation"), F.col("valence")))


@query(RECOMPUTED)
def recompute_job(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with a file: what is incomplete is scored and labelled again, then all are set against the library."""
    rows = stored_scores(spark, sf).withColumn("outcome", F.when(_complete(), "kept").otherwise("recomputed"))
    out = rows.where("outcome = 'kept'").unionByName(rescored(rows.where("outcome = 'recomputed'")))
    out = scoring.standardised(out, "activation", "activation_relative", 1)
    return out.select("id", "outcome", *[F.round(c, 6).alias(c) for c in ("activation", "valence", "activation_relative")], "mood")


@query(_recursive("""SELECT group_id, n_records, coalesce(users, 0) AS users FROM (SELECT group_id, count(*) AS n_records FROM t GROUP BY 1) LEFT JOIN
 (SELECT group_id, count(DISTINCT o_custkey) AS users FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN t ON t.id = l_partkey GROUP BY 1) USING (group_id)"""))
def split_migration_job(spark: SparkSession, sf: str) -> DataFrame:
    """The merged tracks of a migration, with how many records became one and how many users have it."""
    grouped = identity.groups(read(spark, sf, T))
    users = identity.remapped(read(spark, sf, "v_user_tracks"), grouped).groupBy(F.col("track_id").alias("group_id")).agg(F.count("*").alias("users"))
    merged = grouped.groupBy("group_id").agg(F.count("*").alias("n_records"))
    return merged.join(users, "group_id", "left").select("group_id", "n_records", F.coalesce("users", F.lit(0)).alias("users"))


@query("""WITH new AS (SELECT user_id, event_type, event_id FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1),
old AS (SELECT user_id, event_type, event_id FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM old)""")
def insert_or_ignore_first(spark: SparkSession, sf: str) -> DataFrame:
    """What exists stays; of new rows with one key the first by their order is added, with all its columns."""
    e = read(spark, sf, "events").select("user_id", "event_type", "event_id")
    old = library.first_of(e.where("event_type = 'view'"), "user_id", F.col("event_id"))
    return changes.insert_or_ignore(old, e.where("event_type <> 'view'"), ["user_id"], order="event_id")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS track_id FROM lineitem)
SELECT track_id FROM l m WHERE user_id = 3 AND NOT EXISTS (SELECT 1 FROM l o WHERE o.track_id = m.track_id AND o.user_id <> 3)""")
def orphan_orders_anti(spark: SparkSession, sf: str) -> DataFrame:
    """What only one user has, over links that leave some: suppliers as users, orders as tracks."""
    links = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("track_id")).distinct()
    return library.orphans(links, 3)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, len(embedding) AS n, round(embedding[3]::DOUBLE, 5) AS third FROM embeddings")
def vector_json_values(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to JSON text and back, by their values."""
    back = F.from_json(F.to_json(F.col("embedding").cast("array<double>")), "array<double>")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return read(spark, sf, "embeddings").select("vec_id", back.alias("v")).select("vec_id", F.round(total, 4).alias("total"), F.size("v").alias("n"), F.round(F.col("v")[2], 5).alias("third"))


#: The columns of the table before users and tracks were told apart, in their order, with the types of those that the views lack.
LEGACY = {
    "id": "", "user_id": "long", "spotify_id": "", "apple_id": "", "isrc": "", "title": "", "artist": "", "album": "", "genre": "string", "artwork_url": "string", "preview_url": "",
    "track_view_url": "string", "duration_ms": "long", "tempo": "", "energy": "", "brightness": "", "zcr": "double", "mfcc_json": "string", "tempo_stability": "", "onset_rate": "",
    "energy_mean": "", "energy_std": "", "bandwidth": "double", "rolloff": "double", "spectral_contrast": "", "flatness": "", "timbre_variability": "double", "valence_mode": "",
    "tonnetz_std": "double", "acousticness": "", "chroma_mean_json": "string", "activation": "double", "valence": "double", "activation_relative": "double", "vibe_score": "",
    "mood": "string", "audio_path": "", "classification_source": "", "created_at": "",
}
_DUCK = {"string": "VARCHAR", "long": "BIGINT", "double": "DOUBLE"}


@query(duck(T, "SELECT " + ", ".join(f"NULL::{_DUCK[t]} AS {c}" if t else c for c, t in LEGACY.items()) + " FROM v_tracks"))
def legacy_scan_full(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the old table; what a table lacks is NULL."""
    return changes.with_columns(read(spark, sf, T), {c: t for c, t in LEGACY.items() if t}).select(*LEGACY)


@query(duck(T, "SELECT " + ", ".join(c for c, t in LEGACY.items() if not t) + " FROM v_tracks"))
def legacy_common_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A rebuilt table takes over only the columns that the old one has."""
    return changes.common_columns(read(spark, sf, T), list(LEGACY))


@query(duck(T, """SELECT id, regexp_extract(audio_path, '([^/]*)$', 1) AS name, regexp_extract(audio_path, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, lower(regexp_extract(audio_path, '[^/.](\\.[^./]+)$', 1)) AS suffix,
 'audio/' || id || coalesce(nullif(lower(regexp_extract(audio_path, '[^/.](\\.[^./]+)$', 1)), ''), '.mp3') AS target FROM v_tracks"""))
def audio_names(spark: SparkSession, sf: str) -> DataFrame:
    """Name, stem and suffix of each track's file, and the path that a new one gets."""
    path = F.col("audio_path")
    return read(spark, sf, T).select(
        "id", text.file_name(path).alias("name"), text.file_stem(path).alias("stem"), text.file_suffix(path).alias("suffix"), text.audio_target(F.col("id"), path).alias("target")
    )


@query(duck(T, "SELECT id, audio_path FROM v_tracks WHERE audio_path IS NOT NULL AND (energy_pred IS NULL OR model_version IS NULL OR model_version <> 'v1') ORDER BY id LIMIT 100"))
def pending_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 tracks that wait for a prediction: a cap on a job's work."""
    due = F.col("energy_pred").isNull() | ~F.col("model_version").eqNullSafe(F.lit("v1"))
    return read(spark, sf, T).where(F.col("audio_path").isNotNull() & due).select("id", "audio_path").orderBy("id").limit(100)


@query(duck(M, "SELECT track_id, arg_max(status, line_no) AS status, row_number() OVER (ORDER BY track_id) AS place FROM v_manifest GROUP BY track_id"))
def manifest_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """The compacted log with its keys in order and each one's place there."""
    from ..operators import evaluation, manifest

    return evaluation.numbered(manifest.latest(read(spark, sf, M)), "track_id").select("track_id", "status", F.col("place").cast("long").alias("place"))
