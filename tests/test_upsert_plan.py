"""The batch of upsert_tracks is numbered without passing all of its rows through one task."""

import pytest

from tunelode.plans import registry

SF = "/root/testdata/sf0.01"


def test_batch_is_not_numbered_in_one_task(spark, monkeypatch):
    from tunelode.operators import changes

    seen = []
    upsert = changes.upsert
    monkeypatch.setattr(changes, "upsert", lambda old, new: seen.append(new) or upsert(old, new))
    got = registry.queries()["upsert_tracks"](spark, SF)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Window" in x and "p_partkey" in x and "[_p#" not in x]
    duckdb = pytest.importorskip("duckdb")
    part = duckdb.read_parquet(f"{SF}/part.parquet")  # noqa: F841 - read by DuckDB
    want = duckdb.sql(registry.oracle_sql()["upsert_tracks"])
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
