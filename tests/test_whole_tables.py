"""Queries over whole tables, against their SQL twins and against the users and vectors that filters left out."""

import pytest
from pyspark.sql import functions as F

from tunelode.plans import registry
from tunelode.sources.views import read

SF = "/root/testdata/sf0.01"
NAMES = ("remapped_links_whole", "match_tiers_best_whole", "already_linked_whole", "vector_mean_std_whole", "crop_pad_normalise_whole", "vector_json_roundtrip_whole")


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_the_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "embeddings", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_no_user_track_or_component_is_left_out(spark):
    q = {n: registry.queries()[n](spark, SF) for n in NAMES}
    links, tracks = read(spark, SF, "v_user_tracks"), read(spark, SF, "v_tracks").select(F.col("id").alias("track_id"))
    users = links.join(tracks, "track_id").select("user_id").distinct().count()
    assert users > 900 and q["remapped_links_whole"].select("user_id").distinct().count() == users
    assert q["already_linked_whole"].count() == tracks.join(links, "track_id", "left_semi").count()
    assert q["match_tiers_best_whole"].count() > 1900
    assert q["vector_json_roundtrip_whole"].agg(F.min("n")).first()[0] == 64
