"""The log's bytes against the SQL twins, where a value times 1000 falls just under or halfway between whole numbers."""

import datetime

import pytest

from tunelode.plans import registry

VALUES = [32.01, 129.17, 64.07, 0.0005, 0.0015, 0.0025, 12.0005, -32.01, -0.0015, 7.0, 122.79, 0.0]


@pytest.mark.parametrize("name", ["manifest_latest", "manifest_compacted_stream"])
def test_bytes_are_rounded_as_the_twin_rounds_them(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, i % 12, ("purchase", "view", "error")[i % 3], VALUES[(i + i // 12) % 12], "{}") for i in range(36)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = registry.queries()[name](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
