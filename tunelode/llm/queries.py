"""The corpus queries over the driver tables and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import infill, ivfpq, jaccard, langid, licenses, mixing, packing, pieces, pii, quality, runs, sharding, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op10_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements, base verdict and the standard policy's verdict."""
    led = quality.ledger(_documents(spark, sf_dir).select("doc_id", "text"))
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return led.select(
        "doc_id",
        *[F.col(f"ledger.{c}").alias(c) for c in cols],
        (~quality.kept(quality.BASE)).alias("base_failed"),
        quality.kept(quality.STANDARD).alias("kept"),
        F.col("ledger.failed").alias("failed_bits"),
    )


_QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM d
), tri AS (
  SELECT doc_id, i, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), rep AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS c FROM tri WHERE w3 IS NOT NULL
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS caps
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * caps > 70 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits FROM b
"""


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and near-duplicate component."""
    return jaccard.near_components(_documents(spark, sf_dir))


def op8_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40 by bytes and its slot there."""
    return sharding.shard(_documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op1_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def _held_out() -> Column:
    """Rows whose labels and languages are never learned from; a null id isn't one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence sentences and licences."""
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three quarters of the documents."""
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.where(~_held_out()))
    return langid.predict(docs, model, also=(_held_out().alias("held_out"),))


def op5_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from three quarters of the labelled documents."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs.where(~_held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, also=(_held_out().alias("held_out"),))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op6_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every 50th id."""
    return ivfpq.search(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


def op7_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts of the fixed patterns, their digest, and all spans."""
    found = pii.find(_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op11_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids, of the text that they decode to, and of the pieces' spans of source bytes."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = pieces.encode(_documents(spark, sf_dir), model)
    text = F.sha2(pieces.decoded(F.col("ids"), model).cast("binary"), 256)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), text.alias("decoded_sha256"), F.sha2("spans", 256).alias("spans_sha256"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs where, in one document of ten by id, the words from a place on repeat a period; null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    cut = docs.withColumns({"h": h, "words": F.when(h % 10 == 0, words)}).withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("words")})
    cut = cut.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), repeated), " ")
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of at least 12 words: their number, the longest, and digests of all and of the collapsed text."""
    found = runs.periodic_runs(_with_planted_runs(_documents(spark, sf_dir).select("doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))
    rows = found.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts, and digests of what it becomes and of the text rebuilt from that."""
    made = infill.fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"),
    )


_INFILL_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, list_transform(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS sizes,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::UBIGINT::BIGINT) AS k FROM d
), f AS (
  SELECT *, len(sizes)::BIGINT AS n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 50 THEN 'plain'
              WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), c AS (
  SELECT *, coalesce(list_sum(sizes[1:least(k[1] % (n + 1), k[2] % (n + 1))]), 0)::BIGINT AS a,
         coalesce(list_sum(sizes[1:greatest(k[1] % (n + 1), k[2] % (n + 1))]), 0)::BIGINT AS b FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || text[1:a] || '<S>' || text[b + 1:] || '<M>' || text[a + 1:b]
              ELSE '<S>' || text[b + 1:] || '<P>' || text[1:a] || '<M>' || text[a + 1:b] END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM c
"""


QUERIES = {
    "op1_bin_slack_packing": op1_bin_slack_packing,
    "op2_minimax_shards": op2_minimax_shards,
    "op3_license_sentences": op3_license_sentences,
    "op4_compression_language": op4_compression_language,
    "op5_boosted_toxicity": op5_boosted_toxicity,
    "op6_ivfpq_search": op6_ivfpq_search,
    "op7_bilstm_crf_pii": op7_bilstm_crf_pii,
    "op8_sainte_lague_mix": op8_sainte_lague_mix,
    "op9_parity_join": op9_parity_join,
    "op10_quality_ledger": op10_quality_ledger,
    "op11_offset_pieces": op11_offset_pieces,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLES = {"op3_license_sentences": licenses.oracle(), "op10_quality_ledger": _QUALITY_SQL, "op13_fill_in_middle": _INFILL_SQL}
