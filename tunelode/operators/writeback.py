"""Jobs that change a store: upserts by several keys, clearing a library, and batch work that goes on where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from ..functions.text import filled
from ..sources.store import Change, StaleParent, Store


def resolved(tracks: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("spotify_id", "apple_id"), order: str = "new_id") -> DataFrame:
    """new with the id of the track that the first of the keys finds, else one after the largest id.

    Only the keys of the tracks are read.  Of rows that find the same track the last by `order` stays; empty keys find nothing.
    """
    hit = new
    for k in keys:
        by = tracks.where(filled(F.col(k)).isNotNull()).groupBy(F.col(k).alias(f"_{k}")).agg(F.min("id").alias(f"_by_{k}"))
        hit = hit.join(by, F.col(k) == F.col(f"_{k}"), "left")
    top = tracks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    found = F.coalesce(*[f"_by_{k}" for k in keys])
    rows = hit.crossJoin(F.broadcast(top)).select(F.coalesce(found, F.col("_top") + F.col(order)).alias("id"), *new.columns)
    cols = [c for c in new.columns if c != order]
    return rows.groupBy("id").agg(F.max_by(F.struct(*cols), order).alias("_r")).select("id", "_r.*")


def upsert_tracks(store: Store, new: DataFrame, keys: tuple[str, ...] = ("spotify_id", "apple_id")) -> int:
    """Incoming tracks put into `tracks`, all of their columns, NULLs too; the version.  Buckets without any of them stay."""
    return store.apply(lambda c: c.upsert("tracks", resolved(c.read("tracks"), new, keys)))


def clear_library(store: Store, user: int, stop: Callable[[str], None] = lambda step: None) -> dict[str, int]:
    """A user's links and the tracks that nobody else has, gone in one version; what went, and how many of them had a file.

    `stop` is called after each step, for tests of what a crash leaves.
    """
    done: dict[str, int] = {}

    def clear(change: Change) -> None:
        links = change.read("user_tracks")
        mine = links.where(F.col("user_id") == user)
        others = links.where(~F.col("user_id").eqNullSafe(F.lit(user))).select("track_id")
        gone = mine.select("track_id").distinct().join(others, "track_id", "left_anti").select(F.col("track_id").alias("id"))
        lost = change.read("tracks").join(gone, "id", "left_semi")
        counts = lost.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("audio_path") != "", F.lit(False))).alias("files")).first()
        done.update(cleared=mine.count(), tracks_pruned=counts["n"], audio_files_removed=counts["files"])
        change.delete("tracks", gone)  # before the links go, which say what is gone
        stop("tracks")
        change.delete("user_tracks", mine)
        stop("user_tracks")

    store.apply(clear)
    return done


def run_job(
    store: Store, table: str, job: str, pending: Column, compute: Callable[[DataFrame], DataFrame], step: int = 4, stop_after: int | None = None,
    outcomes: dict[str, Column] | None = None,
) -> dict[str, int]:
    """compute(rows) in place of the pending rows of a table, `step` buckets a version; the counts of all steps so far.

    A step's rows and its place in the job's progress are published together, so a job that was killed goes on with the
    first unfinished step, redoes none and loses none.  Other rows keep what they have.  compute returns each row once, with
    the table's columns; it is not asked for a step without pending rows.  stop_after ends the job after so many steps.
    outcomes: conditions on the computed rows as they were written, by the name under which they are counted.
    """
    due = F.coalesce(pending, F.lit(False))
    spec = store.entry()["tables"][table]
    taken = 0
    for first in range(0, spec["buckets"], step):
        chunk = list(range(first, min(first + step, spec["buckets"])))
        while first not in done_buckets(store, job):
            if taken == stop_after:
                return progress(store, job)
            change = store.begin()
            old = change.read(table, chunk)
            n, n_due = old.agg(F.count("*"), F.count_if(due)).first()
            counts = {"rows": n, "kept": n - n_due, "computed": n_due}
            if n_due:
                change.rewrite(table, chunk, old.where(~due).unionByName(compute(old.where(due)).select(*old.columns)))
                if outcomes:
                    written = change.read(table, chunk).join(old.where(due).select(*spec["key"]), spec["key"], "left_semi")
                    counts |= written.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in outcomes.items()]).first().asDict()
            change.entry["jobs"].setdefault(job, []).append({"buckets": chunk, "counts": counts})
            try:
                change.commit(job=job)
                taken += 1
            except StaleParent:  # another writer's rows may be among those of this step
                continue
    return progress(store, job)


def done_buckets(store: Store, job: str) -> set[int]:
    return {b for s in store.entry()["jobs"].get(job, []) for b in s["buckets"]}


def progress(store: Store, job: str) -> dict[str, int]:
    """The sums of a job's counts, and how many steps it has behind it."""
    steps = store.entry()["jobs"].get(job, [])
    total: dict[str, int] = {"steps": len(steps)}
    for s in steps:
        for k, n in s["counts"].items():
            total[k] = total.get(k, 0) + n
    return total


def relative(store: Store, table: str, by: str, few: int = 1, version: int | None = None) -> Column:
    """50 + 15 z of a tracked column, within 0 to 100, by the moments that the store keeps: no row is read for them.

    Fewer than `few` values or no spread give 50; NULL stays NULL.
    """
    m = store.moments(table, by, version)
    flat = m.n < few or m.std <= 1e-9
    value = F.lit(50.0) if flat else clamp(50.0 + (F.col(by) - m.mean) / m.std * 15.0, 0.0, 100.0)
    return F.when(F.col(by).isNotNull(), value)
