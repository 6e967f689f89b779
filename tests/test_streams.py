"""Streams: what a restart gives, and the windowed totals."""

import pytest

from tunelode.plans import registry
from tunelode.sources.store import Store
from tunelode.streaming import compaction

SCHEMA = "track_id string, status string, line_no long"


def file_of(spark, root, k, lines):
    spark.createDataFrame(lines, SCHEMA).coalesce(1).write.parquet(f"{root}/log/day={k}")


def start(spark, root, store, after=lambda n: None):
    rows = spark.readStream.schema(SCHEMA + ", day int").option("maxFilesPerTrigger", 1).parquet(f"{root}/log").drop("day")
    return compaction.compact(rows, store, "manifest", f"{root}/checkpoint", after=after)


def latest(spark, root):
    best = {}
    for r in spark.read.schema(SCHEMA).parquet(f"{root}/log").collect():
        if r.track_id is not None and r.line_no > best.get(r.track_id, (None, -1))[1]:
            best[r.track_id] = r.status, r.line_no
    return best


def kept(store):
    return {r.track_id: (r.status, r.line_no) for r in store.read("manifest").collect()}


def test_a_stream_goes_on_after_a_crash_and_applies_no_batch_twice(spark, tmp_path):
    root = f"file://{tmp_path}"
    store = Store(spark, f"{root}/store")
    store.apply(lambda c: c.create("manifest", spark.createDataFrame([], SCHEMA), ["track_id"], buckets=8))
    for k in range(4):
        file_of(spark, root, k, [(f"t{i % 9}", f"s{k}-{i}", 100 * ((k * 3) % 4) + i) for i in range(12)] + [(None, "x", 1)])

    with pytest.raises(ValueError):
        start(spark, root, Store(spark, f"{root}/other"))

    def crash(number):
        if number == 1:
            raise RuntimeError("lost")

    query = start(spark, root, store, crash)
    with pytest.raises(Exception, match="lost"):  # after batch 1 is published, before the stream's checkpoint knows
        query.awaitTermination()
    assert store.version == 3
    start(spark, root, store).awaitTermination()
    assert kept(store) == latest(spark, root) and len(kept(store)) == 9
    assert store.version == 5  # batch 1 was delivered twice and published once
    # what comes later touches only its buckets
    before = store.entry()["tables"]["manifest"]["parts"]
    file_of(spark, root, 4, [("t3", "new", 10_000), ("t4", "old", -5)])
    start(spark, root, store).awaitTermination()
    assert kept(store) == latest(spark, root) and kept(store)["t3"] == ("new", 10_000)
    after = store.entry()["tables"]["manifest"]["parts"]
    assert sum(before.get(b) != after[b] for b in after) <= 2
    start(spark, root, store).awaitTermination()  # nothing new
    assert kept(store) == latest(spark, root)


@pytest.mark.parametrize("name", ["streaming_daily_totals", "streaming_latest_status"])
def test_streams_equal_their_batch_form(spark, name):
    duckdb = pytest.importorskip("duckdb")
    found = registry.queries().get(name)
    if found is None:
        pytest.skip(name)
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    got = found(spark, sf).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(str).values.tolist()))
    assert len(got) and key(got) == key(want)
