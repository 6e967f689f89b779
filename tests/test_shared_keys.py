"""Keys that many records share: the graph has links between keys, not between records, and the items are those of union-find."""

import random

import pytest

from tunelode.operators import identity, migration
from tunelode.sources.store import Store

SCHEMA = "id long, spotify_id string, apple_id long, isrc string, title string, artist string, album string, user_id long, genre string, audio_path string, classification_source string, created_at string"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.fixture
def links(monkeypatch):
    """How many links each search for components was given."""
    counts = []
    for module in (identity, migration):
        search = module.connected_components
        monkeypatch.setattr(module, "connected_components", lambda edges, search=search: (counts.append(edges.count()), search(edges))[1])
    return counts


def row(i, spotify, apple, isrc, title):
    return (i, spotify, apple, isrc, title, "b", None, 1, "pop", None, "unknown", None)


def records(n):
    """n records on 8, 6 and 4 keys and 3 titles, with keys in common by chains only, and some without any."""
    rng = random.Random(7)
    pick = lambda *xs: rng.choice(xs)
    return [row(i, pick(None, "", f"s{i % 8}"), pick(None, 0, i % 6 + 1), pick(None, f"i{i % 4}"), f"t{i % 3}" if i % 5 else f"own {i}") for i in rng.sample(range(10 * n), n)]


def items(rows):
    """id -> least id of its item, by union-find over ids and keys."""
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, spotify, apple, isrc, title, *_ in rows:
        keys = [("s", spotify), ("a", apple), ("i", isrc)]
        for key in [k for k in keys if k[1]] or [("t", title)]:
            if i is not None:
                a, b = root((0, i)), root((1, key))
                parent[max(a, b)] = min(a, b)
    return {r[0]: root((0, r[0]))[1] for r in rows if r[0] is not None}


def test_groups_of_shared_keys(spark, links):
    rows = records(400)
    # an id that comes with three other keys joins them; rows without an id join nothing and get none
    rows += [row(3, f"only {i}", None, f"i3 {i}", "t") for i in range(3)] + [row(9_000 + i, f"only {i}", None, None, "u") for i in range(3)]
    rows += [row(None, "only 1", 77, None, "v"), row(9_990, None, 77, None, "v")]
    got = identity.groups(spark.createDataFrame(rows, SCHEMA)).select("id", "group_id").collect()
    assert len(got) == len(rows) and {r.id: r.group_id for r in got if r.id is not None} == items(rows)
    assert [r.group_id for r in got if r.id is None] == [None] and {r.group_id for r in got if r.id in (9_000, 9_001, 9_002)} == {3}
    assert links[0] < 60


def test_batches_of_shared_keys(spark, tmp_path, links):
    rows = records(400)
    store = Store(spark, f"file://{tmp_path}")
    frame = spark.createDataFrame(rows, SCHEMA)
    columns = ["spotify_id", "apple_id", "genre"]
    migration.create(store, columns, dict(frame.dtypes), buckets=2)
    # old components are met by keys that one record alone had, beside one that others share or none, and has, beside a shared one
    late = [row(20_000, "new", None, "alone", "x"), row(20_001, "new", None, None, "x"), row(20_003, None, None, "beside", "x"), row(20_002, None, None, "alone", "x"), row(20_004, "s1", None, "beside", "x")]
    migration.add(store, spark.createDataFrame([r for r in rows if r[0] % 2] + late[3:], SCHEMA), columns)
    migration.add(store, spark.createDataFrame([r for r in rows if not r[0] % 2] + late[:3], SCHEMA), columns)
    assert {r.id: r.component for r in migration.members(store).collect()} == items(rows + late)
    assert {r.id: r.n_records for r in migration.tracks(store, columns).collect()} == {c: list(items(rows + late).values()).count(c) for c in items(rows + late).values()}
    assert max(links) < 60
