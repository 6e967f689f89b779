"""What the layout saves: exchanges, buckets and row groups."""

import pytest

from tunelode.sources import layout

N = 60_000


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('layout')}"
    # ids that are spread over all values, so that only a Bloom filter can rule a row group out
    tracks = spark.range(N).selectExpr("id", "concat('sp', id * 7919 % 100003) AS spotify_id", "id * 104729 % 1000003 AS apple_id", "repeat(md5(cast(id AS string)), 4) AS title")
    links = spark.range(4 * N).selectExpr("id % 500 AS user_id", f"id * 31 % {N} AS track_id")
    layout.write_library(tracks, links, root, "laid", buckets=4)
    layout.write_bucketed(tracks, "laid_small", f"{root}/small", "id", 2, bloom=("spotify_id",), row_group=1 << 20)
    layout.write_bucketed(tracks, "laid_bare", f"{root}/bare", "id", 2, row_group=1 << 20)
    yield root
    for t in ("tracks", "links", "listeners", "small", "bare"):
        spark.sql(f"DROP TABLE IF EXISTS laid_{t}")


@pytest.fixture
def no_broadcast(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan()


def scanned(df):
    """Rows that the scans of an executed plan gave."""
    df.collect()
    todo, total = [plan_of(df)], 0
    while todo:
        node = todo.pop()
        if "Scan" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_tracks_and_links_join_without_an_exchange(spark, laid, no_broadcast):
    df = layout.with_listeners(spark, "laid")
    assert "Exchange" not in plan_of(df).toString() and "SortMergeJoin" in plan_of(df).toString()
    assert df.count() == 4 * N


def test_a_users_links_are_one_bucket(spark, laid, no_broadcast):
    assert scanned(spark.table("laid_links").where("user_id = 7")) < 4 * N // 2  # of four buckets
    df = layout.library_of(spark, "laid", 7)
    assert df.count() == 4 * N // 500 and {r.user_id for r in df.select("user_id").distinct().collect()} == {7}


def test_row_groups_are_skipped_in_a_lookup(spark, laid, no_broadcast):
    one = lambda t, k: spark.table(t).where(f"spotify_id = '{k}'").select("id", "title")
    wanted = spark.table("laid_small").where("id = 4242").first().spotify_id
    assert [r.id for r in one("laid_small", wanted).collect()] == [4242]
    with_bloom, without = scanned(one("laid_small", wanted)), scanned(one("laid_bare", wanted))
    assert without > N // 2 and with_bloom < without / 3
    assert scanned(one("laid_small", "sp50000x")) < N / 10  # within the least and greatest, and nowhere


def test_lookups_by_either_key(spark, laid):
    t = {r.id: r for r in spark.table("laid_tracks").where("id IN (10, 11)").collect()}
    assert layout.lookup(spark, "laid", str(t[10].apple_id)).first().id == 10
    assert layout.lookup(spark, "laid", t[11].spotify_id).first().id == 11
    assert layout.lookup(spark, "laid", "-77").isEmpty() and layout.lookup(spark, "laid", "it's none").isEmpty()
