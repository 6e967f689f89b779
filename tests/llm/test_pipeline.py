"""The pipeline's stages on small data."""

import corpus_pipeline
from tunelode.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen.append((name, docs, out))
        docs = out
    assert [x[0] for x in seen] == ["quality rules", "n-gram Jaccard join", "PII", "mixing sources", "best-fit packing"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(x[2].columns == columns for x in seen[:-1])
    good = {r.doc_id for r in quality.ledger(seen[0][1]).where(quality.kept(quality.STANDARD)).collect()}
    assert {r.doc_id for r in seen[0][2].collect()} == good
    assert seen[1][2].count() == seen[2][2].count() <= seen[0][2].count()
    assert seen[4][2].selectExpr("max(offset + length) AS m").first().m <= 2048
    assert {r.doc_id for r in seen[4][2].collect()} == {r.doc_id for r in seen[3][2].collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
