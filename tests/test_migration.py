"""Merging by batches against union-find over all records at once."""

import random

import pytest

from tunelode.operators import migration
from tunelode.sources.store import Store

SCHEMA = "id long, user_id long, spotify_id string, apple_id long, isrc string, title string, artist string, album string, audio_path string, genre string, classification_source string, created_at string"
RANK = {"spotify_preview": 4, "itunes_isrc": 3, "itunes_term_search": 2, "unknown": 1, None: -1, "": -1}
COLUMNS = ["spotify_id", "apple_id", "genre"]


@pytest.fixture(autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def records(n=60, seed=5):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    return [
        (
            i, pick(None, 1, 2, 3), pick(None, "", f"s{rng.randrange(40)}"), pick(None, 0, rng.randrange(40)), pick(None, "", f"i{rng.randrange(40)}"), pick("A", " a ", f"t{rng.randrange(30)}"), f"b{rng.randrange(9)}", None,
            pick(None, "", "x.mp3", "y.mp3", f"{i}.mp3"), pick(None, "", "pop", "rock"), rng.choice(list(RANK)), pick(None, "bad", f"2024-01-0{rng.randrange(1, 9)} 00:00:00"),
        )
        for i in rng.sample(range(1000), n)
    ]


def brute(rows):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for r in rows:
        sp, ap, isrc = r[2] or None, r[3] or None, r[4] or None
        low = "|".join((x or "").strip().lower() for x in r[5:8])
        for key in ("a", ap), ("s", sp), ("i", isrc), ("d", ("s", sp) if sp else ("a", ap) if ap else ("i", isrc) if isrc else ("t", low)):
            if key[1] is not None:
                a, b = root(first.setdefault(key, r[0])), root(r[0])
                parent[max(a, b)] = min(a, b)
    groups = {}
    for r in rows:
        groups.setdefault(root(r[0]), []).append(r)
    merged, links = {}, {}
    for g, rs in groups.items():
        stamp = lambda r: 0 if r[11] in (None, "bad") else int(r[11][8:10])
        rs.sort(key=lambda r: (-RANK[r[10]], -stamp(r), r[0]))
        value = lambda k: next((r[k] for r in rs if r[k] not in (None, "")), None)
        own = rs[0][8]
        merged[g] = (rs[0][0], len(rs), value(2), value(3), value(9), sum(bool(own and r[8] and r[8] != own) for r in rs[1:]))
        for r in sorted(rs):
            if r[1] is not None:
                links.setdefault((g, r[1]), [r[0], r[11], 0])[2] += 1
    return merged, {k: tuple(v) for k, v in links.items()}, {r[0]: root(r[0]) for r in rows}


def run(spark, path, batches):
    store = Store(spark, f"file://{path}")
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    migration.create(store, COLUMNS, dict(frames[0].dtypes), buckets=2)
    for f in frames:
        migration.add(store, f, COLUMNS)
    return store


def same(store, rows):
    merged, links, of = brute(rows)
    assert {r.id: (r.canonical_id, r.n_records, *[r[c] for c in COLUMNS], r.conflicts) for r in migration.tracks(store, COLUMNS).collect()} == merged
    assert {(r.component, r.user_id): (r.first_id, r.added_at, r.attempted) for r in store.read("links").collect()} == links
    assert {r.id: r.component for r in migration.members(store).collect()} == of
    s = migration.summary(store).first()
    assert (s.old_rows, s.new_tracks, s.saved) == (len(rows), len(merged), len(rows) - len(merged))
    assert (s.links_attempted, s.links_inserted, s.conflicts) == (sum(r[1] is not None for r in rows), len(links), sum(m[-1] for m in merged.values()))


def test_batches_in_any_order_equal_one_run(spark, tmp_path):
    late = lambda i, sp, ap, t: (i, 1, sp, ap, None, t, "b", None, f"{i}.mp3", None, "unknown", None)
    apart = [late(1005, "q1", None, "x"), late(1007, None, 970, "y"), late(1009, "q9", None, "w")]
    joins = [late(1006, "q1", 970, "z"), late(1002, "q9", 970, "v")]  # which bring the three components together
    some = records()
    rows = [*some, *apart, *joins]
    assert 3 < len(brute(rows)[0]) < 55 and sum(m[-1] for m in brute(rows)[0].values()) > 2
    # rows that come again, twice in a batch or without an id change nothing
    again = [*some[:10], some[31], some[31], (None, *some[0][1:])]
    store = run(spark, tmp_path, [some[40:] + some[:10] + apart, some[10:40] + joins + again])
    same(store, rows)
    assert {r.component: r.label for r in store.read("labels").collect() if r.component > 1000} == {1005: 1002, 1007: 1002, 1009: 1002}
