"""Merging of a library's records batch by batch: a batch costs what it touches, and any order gives what one run gives.

A store holds, with the buckets that a batch doesn't touch left as they are:

    members   record -> component at the time it came, for records that come again
    keys      shared key -> component at the time it came first
    labels    component -> component that it has become part of; only merged ones are here
    merged    component -> values, each with the place of the record that it is from
    links     component, user -> the first record's stamp, and how many records asked for the link
    paths     component, audio path -> records that have it

A batch's records are joined to the components that share a key with them.  In that graph a key is its least record in the
batch, an old component is one node, and records only link the nodes of their keys, so its size is that of the keys which are
shared, however many records share them.  All states combine by minima and sums, so no old record is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import epoch, item_keys, source_rank
from ..session import discard, keep
from ..sources.store import Change, Store
from .components import connected_components, firsts, links, near

PLACE = "struct<rank:int,age:bigint,id:bigint>"


def create(store: Store, columns: list[str], types: dict[str, str], buckets: int = 16) -> int:
    """An empty library whose merged rows carry `columns`."""
    values = ", ".join(f"{c} {types[c]}, {c}_place {PLACE}" for c in columns)
    tables = {
        "members": ("id long, component long", ["id"]),
        "keys": ("k string, component long", ["k"]),
        "labels": ("component long, label long", ["component"]),
        "merged": (f"component long, best {PLACE}, n_records long, audio_path string, {values}", ["component"]),
        "links": ("component long, user_id long, first_id long, added_at string, attempted long", ["component"]),
        "paths": ("component long, path string, n long", ["component"]),
    }

    def make(change: Change) -> None:
        for name, (schema, key) in tables.items():
            change.create(name, schema, key, buckets)

    return store.apply(make)


def _current(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found with its column `component` as it is labelled now."""
    now = labels.select(F.col("component").alias("_c"), "label")
    return found.join(now, F.col("component") == F.col("_c"), "left").withColumn("component", F.coalesce("label", "component")).drop("_c", "label")


def add(store: Store, records: DataFrame, columns: list[str]) -> int:
    """Merge a batch of records (id, user_id, keys, columns, audio_path, classification_source, created_at); the version.

    Records whose id has come before, or is NULL, change nothing; of rows with one id one counts.
    """
    return store.apply(lambda change: _add(change, records, columns))


def _add(change: Change, records: DataFrame, columns: list[str]) -> None:
    spark = change.spark
    ks = {f"_key{i}": k for i, k in enumerate(item_keys())}
    needed = dict.fromkeys(["id", "user_id", *columns, "audio_path", "classification_source", "created_at"])
    rows = keep(records.where("id IS NOT NULL").select(*needed, *[k.alias(c) for c, k in ks.items()]), "records")
    # ids that come again, from before or in this batch, are told by ids alone
    come = change.read("members", change.touched("members", rows)).select("id", F.lit(True).alias("come"))
    ids = rows.select("id", F.lit(False).alias("come")).unionByName(come)
    again = keep(ids.groupBy("id").agg(F.count_if(~F.col("come")).alias("n"), F.bool_or("come").alias("come")).where("n > 1 OR n = 1 AND come"), "again")
    twice = keep(rows.join(again.where("NOT come"), "id", "left_semi").dropDuplicates(["id"]), "twice")
    batch = rows.join(again, "id", "left_anti").unionByName(twice)
    held = keep(firsts(batch, list(ks)), "firsts")
    labels = change.read("labels")
    known = change.read("keys", change.touched("keys", held))
    met = keep(_current(held.join(known, "k", "left"), labels), "met")
    # least records of keys, and the old components that they meet, as one graph
    linking = near(batch, list(ks), met.where("n > 1 OR component IS NOT NULL"))
    old = met.where("component IS NOT NULL").select("component", "a").distinct()
    found = connected_components(old.select(F.col("component").alias("a"), F.col("a").alias("b")).union(links(linking)))

    labelled = lambda nodes, c: nodes.join(found, F.col(c) == F.col("node"), "left")
    of_record = keep(labelled(linking, "_first").select(*needed, F.coalesce("component", "_first").alias("label")), "labelled")
    of_old = labelled(old.select(F.col("component").alias("was")).distinct(), "was").select("was", F.coalesce("component", "was").alias("label"))
    _put(change, "members", of_record.select("id", F.col("label").alias("component")), lambda have, new: have.unionByName(new))
    # a record's own keys are no nodes, so a key is labelled by its record
    new_keys = met.where("component IS NULL").select("k", "a").join(of_record.select("id", "label"), F.col("a") == F.col("id")).select("k", F.col("label").alias("component"))
    change.merge("keys", new_keys, lambda have, new: have.unionByName(new))

    moved = keep(of_old.where("was <> label").select(F.col("was").alias("component"), "label"), "moved")
    further = labels.join(moved.select(F.col("component").alias("_c"), F.col("label").alias("_l")), F.col("label") == F.col("_c")).select("component", F.col("_l").alias("label"))
    change.upsert("labels", moved.union(further))

    # only components are stored, so of the batch its labels matter, not its records
    into = of_record.select(F.col("label").alias("component"), "label").union(of_old.select("label", "label")).union(of_old.select("was", "label"))
    touched = keep(into.distinct(), "touched")
    for table, fresh, by, sums in _states(of_record, columns):
        _put(change, table, touched, _combined(fresh, by, sums))
    discard(spark, rows, again, twice, held, met, of_record, moved, touched)


def _put(change: Change, table: str, batch: DataFrame, into: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """As Change.merge, for a batch that is read from a written table."""
    buckets = change.touched(table, batch)
    if buckets:
        change.rewrite(table, buckets, into(change.read(table, buckets), batch))


def _states(of_record: DataFrame, columns: list[str]) -> list[tuple[str, DataFrame, list[str], list[Column]]]:
    """Each table's rows of single records, its grouping besides the component, and how its columns combine."""
    place = F.struct((-source_rank(F.col("classification_source"))).cast("int").alias("rank"), (-epoch(F.col("created_at"))).cast("long").alias("age"), F.col("id").cast("long").alias("id"))
    there = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    rows = of_record.withColumn("place", place).withColumn("component", F.col("label"))
    values = [x for c in columns for x in (F.when(there(c), F.col(c)).alias(c), F.when(there(c), F.col("place")).alias(f"{c}_place"))]
    merged = rows.select("component", F.col("place").alias("best"), F.lit(1).cast("long").alias("n_records"), F.col("audio_path").alias("audio_path"), *values)
    links = rows.where("user_id IS NOT NULL").select("component", F.col("user_id").cast("long").alias("user_id"), F.col("id").cast("long").alias("first_id"), F.col("created_at").cast("string").alias("added_at"), F.lit(1).cast("long").alias("attempted"))
    paths = rows.where(there("audio_path")).select("component", F.col("audio_path").alias("path"), F.lit(1).cast("long").alias("n"))
    firsts = [x for c in columns for x in (F.min_by(c, f"{c}_place").alias(c), F.min(f"{c}_place").alias(f"{c}_place"))]
    return [
        ("merged", merged, [], [F.min("best").alias("best"), F.sum("n_records").alias("n_records"), F.min_by("audio_path", "best").alias("audio_path"), *firsts]),
        ("links", links, ["user_id"], [F.min("first_id").alias("first_id"), F.min_by("added_at", "first_id").alias("added_at"), F.sum("attempted").alias("attempted")]),
        ("paths", paths, ["path"], [F.sum("n").alias("n")]),
    ]


def _combined(fresh: DataFrame, by: list[str], sums: list[Column]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """What of touched components is stored and what is new, under their labels; other components stay."""

    def change(have: DataFrame, touched: DataFrame) -> DataFrame:
        names = touched.select(F.col("component").alias("_c"), F.col("label").alias("_label"))
        met = have.join(names, F.col("component") == F.col("_c"), "left")
        stay = met.where("_c IS NULL").select(*have.columns)
        mine = met.where("_c IS NOT NULL").withColumn("component", F.col("_label")).select(*have.columns)
        return stay.unionByName(mine.unionByName(fresh).groupBy("component", *by).agg(*sums))

    return change


def members(store: Store) -> DataFrame:
    """(id, component) of every record that has come."""
    return _current(store.read("members"), store.read("labels"))


def tracks(store: Store, columns: list[str]) -> DataFrame:
    """(id, canonical_id, n_records, columns, conflicts) of every merged track; conflicts are records with another audio path
    than the canonical record's, where both have one."""
    total = store.read("paths").groupBy(F.col("component").alias("_c")).agg(F.sum("n").alias("_n"))
    same = store.read("paths").select(F.col("component").alias("_d"), F.col("path").alias("_path"), F.col("n").alias("_same"))
    rows = store.read("merged").join(total, F.col("component") == F.col("_c"), "left").join(same, (F.col("component") == F.col("_d")) & (F.col("audio_path") == F.col("_path")), "left")
    conflicts = F.when(F.col("_same").isNotNull(), F.col("_n") - F.col("_same")).otherwise(F.lit(0)).alias("conflicts")
    return rows.select(F.col("component").alias("id"), F.col("best.id").alias("canonical_id"), "n_records", *columns, conflicts)


def summary(store: Store) -> DataFrame:
    """One row: records, merged tracks, what merging saves, links asked for and made, and conflicts."""
    links = store.read("links").agg(F.coalesce(F.sum("attempted"), F.lit(0)).alias("links_attempted"), F.count("*").alias("links_inserted"))
    merged = tracks(store, []).agg(
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("old_rows"), F.count("*").alias("new_tracks"), F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts")
    )
    return merged.crossJoin(F.broadcast(links)).select("old_rows", "new_tracks", (F.col("old_rows") - F.col("new_tracks")).alias("saved"), "links_attempted", "links_inserted", "conflicts")
