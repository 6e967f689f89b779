"""From raw documents to packed training sequences, in stages that are written out and read again between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelode.llm import jaccard, mixing, packing, pii, quality
from tunelode.session import keep, ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the standard policy rejects go."""
    ship(spark)
    return quality.passing(docs, quality.STANDARD)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the document with the smallest id stays.

    Rows that share an id are one document and leave one row; rows without an id leave one row a text, unless a row
    with an id has that text.
    """
    ship(spark)
    return jaccard.drop_near(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: spans in the text become their kind in brackets, and n_chars follows."""
    ship(spark)
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: the words that the mix takes, as whole documents and cut ones, and n_chars follows."""
    ship(spark)
    return mixing.apply_mix(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: every piece's place in a sequence of at most 2048 tokens.

    Words' ids are kept in less memory than by itself and not between tasks, since the stages before leave less of it.
    """
    import public_tokenizers

    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_bytes=16 << 20, keep_words=False)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_near),
    ("PII", redact),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else keep(docs, f"stage{i}"), sf_dir)
    return docs
