"""The media library as views over the driver's tables: the only place that knows the mapping.

Each view is one SQL text that Spark and DuckDB read alike, so queries and their oracles start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_tracks": """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '' ELSE 'sp' || cast(p_partkey % 1500 AS string) END AS spotify_id,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 1700 END AS apple_id,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'IS' || cast(p_partkey % 1900 AS string) END AS isrc,
  p_name AS title, p_brand AS artist, p_type AS album,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 60.0D + p_partkey % 130 END AS tempo,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size / 300.0D END AS energy,
  CASE WHEN p_partkey % 2 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE p_size / 250.0D END AS energy_mean,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size % 10 / 100.0D END AS energy_std,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE 500.0D + p_partkey % 4000 END AS brightness,
  CASE WHEN p_partkey % 6 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 40 / 10.0D END AS onset_rate,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 9 / 2.0D END AS tempo_stability,
  CASE WHEN p_partkey % 9 = 0 OR p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 21 / 10.0D - 1.0D END AS valence_mode,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 13 / 100.0D END AS flatness,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 35 / 1.0D END AS spectral_contrast,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey % 11 / 10.0D END AS acousticness,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey * 37 % 1000 / 10.0D END AS vibe_score,
  CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 53 % 1000 / 1000.0D END AS vibe_score_ml,
  CASE WHEN p_partkey % 4 = 0 THEN p_size / 50.0D END AS energy_pred,
  CASE WHEN p_partkey % 8 = 0 THEN p_retailprice / 3000.0D END AS danceability_pred,
  CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE 'v' || cast(p_partkey % 3 AS string) END AS model_version,
  CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN '' ELSE 'audio/' || cast(p_partkey AS string) || '.mp3' END AS audio_path,
  CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 8 = 1 THEN '' WHEN p_partkey % 8 < 4 THEN 'https://p.scdn.co/mp3/' || cast(p_partkey AS string)
       WHEN p_partkey % 8 < 6 THEN 'https://audio.itunes.apple.com/' || cast(p_partkey AS string) ELSE 'https://files.example.org/' || cast(p_partkey AS string) END AS preview_url,
  CASE p_partkey % 6 WHEN 0 THEN 'spotify_preview' WHEN 1 THEN 'itunes_isrc' WHEN 2 THEN 'itunes_term_search' WHEN 3 THEN 'unknown' WHEN 4 THEN '' END AS classification_source,
  CASE WHEN p_partkey % 3 = 0 THEN 'yt' || cast(p_partkey AS string) END AS youtube_id,
  CASE WHEN p_partkey % 6 < 4 THEN '2024-01-01 00:00:00' END AS youtube_queried_at,
  CASE WHEN p_partkey % 19 = 0 THEN 'not a date' WHEN p_partkey % 23 = 0 THEN NULL
       ELSE '2024-0' || cast(1 + p_partkey % 9 AS string) || '-1' || cast(p_partkey % 9 AS string) || ' 10:00:00' END AS created_at
FROM part""",
    "v_user_tracks": "SELECT DISTINCT o_custkey AS user_id, l_partkey AS track_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "v_manifest": """
SELECT user_id AS track_id, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'ok' WHEN 'error' THEN 'download_failed' ELSE 'no_preview' END AS status,
  event_id AS line_no, cast(rint(value * 1000) AS bigint) AS bytes FROM events""",
    "v_links": "SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, track_id FROM v_user_tracks",
}
NEEDS = {"v_links": ("v_user_tracks",)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table, or a view over driver tables."""
    if table in TABLES:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")
    text = sql(table, f"SELECT * FROM {table}")
    import re

    used = {t: read(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    for t, df in used.items():
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **used)


def sql(views: str, body: str) -> str:
    """DuckDB SQL (and Spark's, for its own views): body with the named views, space-separated, before it."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in (*NEEDS.get(v, ()), v) if n not in names]
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {heads} {body}" if not body.lstrip().upper().startswith("WITH") else f"WITH {heads}, {body.lstrip()[4:].lstrip()}"


def duck(views: str, body: str) -> str:
    """The DuckDB form of sql(): its numbers have no D suffix, and its casts round halves to even, for which Spark needs rint."""
    import re

    text = re.sub(r"\b(\d+\.\d+)D\b", r"\1::DOUBLE", sql(views, body) if views else body)
    return re.sub(r"\brint\((.*?)\)", r"\1", text)
