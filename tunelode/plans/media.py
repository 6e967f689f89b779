"""Queries on addresses, JSON and vectors, training frames, and the events as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..sources.views import read
from ..streaming import events as stream
from .registry import query


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^[A-Za-z0-9_-]{11}$') THEN true ELSE false END AS is_video, nullif(regexp_extract(html, '<a href="([^"]+)"', 1), '') AS link,
 nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host FROM pages""")
def scrape_url(spark: SparkSession, sf: str) -> DataFrame:
    """The first linked address of a page and the page's host."""
    one = lambda c, p: text.filled(F.regexp_extract(c, p, 1))
    return read(spark, sf, "pages").select("page_id", text.is_video_id(F.col("url")).alias("is_video"), one("html", '<a href="([^"]+)"').alias("link"), one("url", "^https?://([^/?#]+)").alias("host"))


_ID = "substr(md5(cast(p_partkey AS VARCHAR)), 1, 22)"
_FORM = f"CASE p_partkey % 5 WHEN 0 THEN 'https://open.example.com/playlist/' || {_ID} || '?si=x' WHEN 1 THEN 'app:playlist:' || {_ID} WHEN 2 THEN ' ' || {_ID} || ' ' WHEN 3 THEN 'https://open.example.com/intl-de/playlist/' || {_ID} ELSE 'junk' END"


@query(f"""WITH u AS (SELECT p_partkey AS id, {_FORM} AS u FROM part)
SELECT id, coalesce(nullif(regexp_extract(trim(u), 'playlist/([A-Za-z0-9]{{22}})', 1), ''), nullif(regexp_extract(trim(u), 'playlist:([A-Za-z0-9]{{22}})', 1), ''), nullif(regexp_extract(trim(u), '^([A-Za-z0-9]{{22}})$', 1), '')) AS playlist FROM u""")
def playlist_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_FORM.replace("VARCHAR", "STRING")).alias("u"))
    return rows.select("id", text.playlist_id(F.col("u")).alias("playlist"))


_LIST = "cast(p_partkey AS VARCHAR) || ', ' || p_name || ',,' || cast(p_size AS VARCHAR) || ' ,4x'"


@query(f"""SELECT p_partkey AS id, array_to_string(list_filter(list_transform(string_split({_LIST}, ','), lambda x: try_cast(nullif(regexp_extract(trim(x), '^[0-9]{{1,18}}$', 0), '') AS BIGINT)), lambda x: x IS NOT NULL), ',') AS ids FROM part""")
def int_list_parse(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_LIST.replace("VARCHAR", "STRING")).alias("x"))
    return rows.select("id", F.array_join(F.transform(text.int_list(F.col("x")), lambda v: v.cast("string")), ",").alias("ids"))


_COOKIE = "'a=' || cast(p_partkey AS VARCHAR) || '; b=x=y ;; bare; a=' || p_brand"


@query(f"""SELECT p_partkey AS id, array_to_string(list_transform(list_filter(list_transform(string_split({_COOKIE}, ';'), lambda x: trim(x)), lambda x: strpos(x, '=') > 1),
 lambda x: trim(split_part(x, '=', 1)) || '>' || trim(substr(x, strpos(x, '=') + 1))), '|') AS pairs FROM part""")
def cookie_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_COOKIE.replace("VARCHAR", "STRING")).alias("x"))
    return rows.select("id", F.array_join(F.transform(text.pairs(F.col("x")), lambda p: F.concat(p["name"], F.lit(">"), p["value"])), "|").alias("pairs"))


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, CASE WHEN event_id % 2 = 0 THEN event_type ELSE props END AS item FROM events")
def track_or_item(spark: SparkSession, sf: str) -> DataFrame:
    """A nested number with a default, and the one of two fields that is filled."""
    one, two = F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.when(F.col("event_id") % 2 == 1, F.col("props"))
    return read(spark, sf, "events").select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(0)).alias("k"), F.coalesce(one, two).alias("item"))


_V, _W = "list_transform(embedding[1:12], lambda x: x::DOUBLE)", "list_transform(embedding, lambda x: x::DOUBLE)"
_TEMPLATE = ", ".join(f"('{kind}', {k}, [{', '.join(repr(p[(i - k) % 12]) for i in range(12))}]::DOUBLE[])" for kind, p in (("M", arrays.MAJOR), ("m", arrays.MINOR)) for k in range(12))


def _chroma(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 12).alias("chroma"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("chroma"))


@query(f"""WITH t(kind, k, p) AS (VALUES {_TEMPLATE}), v AS (SELECT vec_id, {_V} AS c FROM embeddings), u AS (SELECT vec_id, kind, k, unnest(c) AS x, unnest(p) AS y FROM v, t),
r AS (SELECT vec_id, kind, k, corr(x, y) AS r FROM u GROUP BY ALL) SELECT vec_id, round(least(greatest(max(r) FILTER (kind = 'M') - max(r) FILTER (kind = 'm'), -1.0), 1.0), 5) AS mode FROM r GROUP BY vec_id""")
def key_mode_valence(spark: SparkSession, sf: str) -> DataFrame:
    """How much more major than minor a 12-tone profile is."""
    return _chroma(spark, sf).select("vec_id", F.round(arrays.key_mode(F.col("chroma")), 5).alias("mode"))


@query(f"SELECT vec_id, round(list_avg({_V}), 6) AS mean, round(list_stddev_pop({_V}), 6) AS std, round(list_max(list_transform({_V}, lambda x: abs(x))), 6) AS peak FROM embeddings")
def vector_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    return _moments(_chroma(spark, sf))


@query(f"SELECT vec_id, round(list_avg({_W}), 6) AS mean, round(list_stddev_pop({_W}), 6) AS std, round(list_max(list_transform({_W}, lambda x: abs(x))), 6) AS peak FROM embeddings")
def vector_mean_std_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _moments(_vectors(spark, sf))


def _moments(vectors: DataFrame) -> DataFrame:
    c = F.col("chroma")
    return vectors.select("vec_id", F.round(arrays.mean(c), 6).alias("mean"), F.round(arrays.std(c), 6).alias("std"), F.round(arrays.max_abs(c), 6).alias("peak"))


@query(f"""SELECT vec_id, round(list_sum(({_V})[5:8]), 6) AS middle, 16 AS padded, round(list_sum(list_transform({_V}, lambda x: x / list_max(list_transform({_V}, lambda y: abs(y))))), 5) AS normalised FROM embeddings""")
def crop_pad_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return _cropped(_chroma(spark, sf), 16)


@query(f"""SELECT vec_id, round(list_sum(({_W})[31:34]), 6) AS middle, 80 AS padded, round(list_sum(list_transform({_W}, lambda x: x / list_max(list_transform({_W}, lambda y: abs(y))))), 5) AS normalised FROM embeddings""")
def crop_pad_normalise_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _cropped(_vectors(spark, sf), 80)


def _cropped(vectors: DataFrame, padded: int) -> DataFrame:
    c = F.col("chroma")
    return vectors.select("vec_id", F.round(arrays.total(arrays.crop_or_pad(c, 4)), 6).alias("middle"), F.size(arrays.crop_or_pad(c, padded)).alias("padded"), F.round(arrays.total(arrays.peak_normalised(c)), 5).alias("normalised"))


_ITEM = """WITH x AS (SELECT vec_id, list_transform(embedding[1:20 + vec_id % 45], lambda v: v::DOUBLE * 5) AS x,
 pow(10.0, (('0x' || substr(md5(vec_id || 'g'), 1, 8))::UBIGINT::DOUBLE / 4294967295.0 * 2 - 1) * 6 / 20.0) AS gain FROM embeddings),
c AS (SELECT vec_id, list_transform(CASE WHEN n >= 32 THEN y[(n - 32) // 2 + 1:(n - 32) // 2 + 32] ELSE y || list_transform(range(32 - n), lambda i: 0.0::DOUBLE) END, lambda v: v * gain) AS y
 FROM (SELECT *, x[1:48] AS y, least(len(x), 48) AS n FROM x WHERE len(x) >= 25))
SELECT vec_id, len(y) AS n, round(list_sum(list_transform(y, lambda v: v / greatest(list_max(list_transform(y, lambda w: abs(w))), 1.0))), 5) AS total,
 round(y[1] / greatest(list_max(list_transform(y, lambda w: abs(w))), 1.0), 5) AS first FROM c"""


@query(_ITEM)
def dataset_items(spark: SparkSession, sf: str) -> DataFrame:
    """Training items of signals of 20 to 64 numbers: short ones skipped, capped, cropped or padded, with gain, within -1 to 1."""
    rows = read(spark, sf, "embeddings").withColumn("x", F.transform(F.expr("slice(embedding, 1, cast(20 + vec_id % 45 AS int))"), lambda v: v.cast("double") * 5))
    item = arrays.dataset_item(F.col("x"), 25, 48, 32, arrays.seeded_gain(F.col("vec_id"), "g", 6.0))
    got = rows.select("vec_id", item.alias("y")).where("y IS NOT NULL")
    return got.select("vec_id", F.size("y").alias("n"), F.round(arrays.total(F.col("y")), 5).alias("total"), F.round(F.col("y")[0], 5).alias("first"))


@query(f"SELECT vec_id, len({_V}) AS n, label > 4 AS high FROM embeddings")
def vector_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to JSON text and back; bad text is an empty vector."""
    return _through_json(read(spark, sf, "embeddings"), F.slice(F.col("embedding").cast("array<double>"), 1, 12))


@query(f"SELECT vec_id, len({_W}) AS n, label > 4 AS high FROM embeddings")
def vector_json_roundtrip_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _through_json(read(spark, sf, "embeddings"), F.col("embedding").cast("array<double>"))


def _through_json(rows: DataFrame, vector: Column) -> DataFrame:
    rows = rows.select("vec_id", "label", F.to_json(vector).alias("j"))
    back = F.coalesce(F.from_json("j", "array<double>"), F.array().cast("array<double>"))
    return rows.select("vec_id", F.size(back).cast("long").alias("n"), (F.col("label") > 4).alias("high"))


@query("""SELECT page_id, CASE WHEN b >= a AND b >= c AND NOT a = b THEN 'b' WHEN a >= c THEN 'a' ELSE 'c' END AS best FROM (SELECT page_id, page_id % 7 * 10 AS a, page_id % 5 * 12 AS b, page_id % 3 * 20 AS c FROM pages)""")
def best_thumbnail(spark: SparkSession, sf: str) -> DataFrame:
    """The largest of an array of structs, the first of equal ones."""
    p = F.col("page_id")
    items = F.array(*[F.struct(area.alias("area"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, (n, area) in enumerate((("a", p % 7 * 10), ("b", p % 5 * 12), ("c", p % 3 * 20)))])
    return read(spark, sf, "pages").select("page_id", F.array_max(items)["name"].alias("best"))


@query("""SELECT vec_id, '{"label":' || label || ',"dims":' || len(embedding) || '}' AS body FROM embeddings""")
def features_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.to_json(F.struct("label", F.size("embedding").alias("dims"))).alias("body"))


@query("SELECT d.doc_id, source, quality FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND n_chars > 200 AND doc_id % 3 > 0")
def training_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with all targets whose file is large enough."""
    files = read(spark, sf, "documents").where("n_chars > 200").select("doc_id")
    rows = read(spark, sf, "documents").where("doc_id % 3 > 0").select("doc_id", "source").join(read(spark, sf, "labels").dropna(subset=["quality", "toxic"]), "doc_id")
    return rows.join(files, "doc_id", "left_semi").select("doc_id", "source", "quality")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streaming_daily_totals(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: daily totals over the events read as a stream."""
    return stream.daily_totals(spark, sf)


@query("SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def streaming_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    """An extension: the resumable log as a stream, the latest status of each key."""
    return stream.latest_status(spark, sf)
