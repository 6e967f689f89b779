"""Tables with versions: a change is written beside what is there and published by one atomic rename.

A store is a folder with `data`, which holds immutable Parquet folders, and `log`, which holds one small JSON entry a
version.  An entry names, for each table, the folder of every bucket of its key, so a change rewrites only the buckets
that its keys fall into, and one entry publishes changes of several tables together.  The entry of version n + 1 is
renamed into place without replacing, so of two writers with the same parent one gets StaleParent; a writer that dies
before the rename leaves nothing but unnamed folders, which `vacuum` removes.  The file system must rename atomically.

With each bucket go its row count and the moments of tracked columns (count, mean, squared deviations, least, greatest),
which merge without a look at the rows, and jobs leave their progress in the entry that holds their results.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..session import discard, keep

BUCKET = "_bucket"


class StaleParent(RuntimeError):
    """Another writer has published a version since this change began."""


@dataclass(frozen=True)
class Moments:
    """Count, mean, sum of squared deviations, least and greatest of a column's values that are not NULL."""

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    least: float | None = None
    greatest: float | None = None

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if other.n else self
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(
            n, self.mean + gap * other.n / n, self.m2 + other.m2 + gap * gap * self.n * other.n / n,
            min(self.least, other.least), max(self.greatest, other.greatest),
        )

    @property
    def std(self) -> float:
        """The population's standard deviation; 0 of no values."""
        return math.sqrt(max(self.m2, 0.0) / self.n) if self.n else 0.0


class _Files:
    """The few file system calls that a store needs, by Hadoop's client, so any of its file systems will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(root).toUri(), self.conf)

    def path(self, name: str):  # noqa: ANN201 - a Java object
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def age(self, name: str) -> float:
        """Seconds since the last change."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def publish(self, source: str, name: str) -> bool:
        """Rename without replacing; False if the name is taken."""
        option = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(option.NONE.getClass(), 1)
        options[0] = option.NONE
        try:
            self.context.rename(self.path(source), self.path(name), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """A folder of versioned tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = _Files(spark, self.root)
        self._entries: dict[int, dict] = {}

    def _name(self, version: int) -> str:
        return f"{self.root}/log/{version:020d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/log") if n[:-5].isdigit() and n.endswith(".json"))

    @property
    def version(self) -> int:
        """The latest version; 0 before the first change."""
        return max(self.versions(), default=0)

    def entry(self, version: int | None = None) -> dict:
        """What a version holds: tables with their buckets, and jobs with their progress."""
        version = self.version if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "jobs": {}, "note": {}}
        if version not in self._entries:
            self._entries[version] = json.loads(self.files.read(self._name(version)))
        return self._entries[version]

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version, or some of its buckets; columns that were added after a bucket was written are NULL there."""
        return self._rows(self.entry(version)["tables"][table], buckets)

    def _rows(self, spec: dict, buckets: list[int] | None) -> DataFrame:
        schema = StructType.fromJson(spec["schema"])
        parts = [p["path"] for b, p in spec["parts"].items() if buckets is None or int(b) in set(buckets)]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts])

    def rows(self, table: str, version: int | None = None) -> int:
        """How many rows a table has, by its entry."""
        return sum(p["rows"] for p in self.entry(version)["tables"][table]["parts"].values())

    def moments(self, table: str, column: str, version: int | None = None) -> Moments:
        """Moments of a tracked column, merged from its buckets' in their order."""
        parts = self.entry(version)["tables"][table]["parts"]
        return sum((Moments(*parts[b]["moments"][column]) for b in sorted(parts, key=int)), Moments())

    def begin(self) -> Change:
        return Change(self)

    def apply(self, change: Callable[[Change], object], attempts: int = 5) -> int:
        """Make a change and publish it, anew on the latest version where another writer came first; the version.

        A change that returns False has nothing to publish.
        """
        for left in range(attempts, 0, -1):
            new = self.begin()
            if change(new) is False:
                return new.parent
            try:
                return new.commit()
            except StaleParent:
                if left == 1:
                    raise
        raise AssertionError

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> int:
        """Forget all but the last `keep` versions and remove folders that none of them names; how many folders went.

        Folders younger than older_than seconds stay: a change that is not published yet may be writing them.
        """
        kept = self.versions()[-keep:]
        named = {p["path"].split("/")[1] for v in kept for t in self.entry(v)["tables"].values() for p in t["parts"].values()}
        for v in set(self.versions()) - set(kept):
            self.files.remove(self._name(v))
            self._entries.pop(v, None)
        gone = [n for n in self.files.names(f"{self.root}/data") if n not in named and self.files.age(f"{self.root}/data/{n}") >= older_than]
        for n in gone:
            self.files.remove(f"{self.root}/data/{n}")
        return len(gone)


class Change:
    """Changes of one or more tables that become the next version together, or not at all."""

    def __init__(self, store: Store) -> None:
        self.store, self.spark = store, store.spark
        self.parent = store.version
        self.entry = json.loads(json.dumps(store.entry(self.parent)))

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table as this change leaves it so far."""
        return self.store._rows(self.entry["tables"][table], buckets)

    def create(self, table: str, rows: DataFrame | str, key: list[str], buckets: int = 16, track: tuple[str, ...] = ()) -> None:
        """A table, new or whole anew, dealt into buckets by its key; `track` names the columns whose moments are kept.

        Columns (DDL) in place of rows make it empty.
        """
        schema = StructType.fromDDL(rows) if isinstance(rows, str) else rows.schema
        spec = {"key": key, "buckets": buckets, "track": list(track), "schema": json.loads(schema.json()), "parts": {}}
        self.entry["tables"][table] = spec
        if not isinstance(rows, str):
            self._write(spec, rows, None)

    def add_columns(self, table: str, columns: str) -> None:
        """Columns (DDL) that the table lacks, NULL in what is there; no row is written."""
        spec = self.entry["tables"][table]
        has = {f["name"].lower() for f in spec["schema"]["fields"]}
        spec["schema"]["fields"] += [f.jsonValue() for f in StructType.fromDDL(columns).fields if f.name.lower() not in has]

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The buckets that rows with the table's key fall into: at most as many as it has."""
        spec = self.entry["tables"][table]
        return sorted(r[0] for r in keys.select(self._bucket(spec)).distinct().collect())

    def merge(self, table: str, batch: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """change(rows, batch) in place of the rows of every bucket that the batch's keys fall into; those buckets.

        The batch is written first, so that it is worked out once and its keys and its rows are the same.
        """
        batch = keep(batch, "batch")
        buckets = self.touched(table, batch)
        if buckets:
            self.rewrite(table, buckets, change(self.read(table, buckets), batch))
        discard(self.spark, batch)
        return buckets

    def rewrite(self, table: str, buckets: list[int], rows: DataFrame) -> None:
        """rows in place of those of some buckets."""
        spec = self.entry["tables"][table]
        names = [f["name"] for f in spec["schema"]["fields"]]
        self._write(spec, rows.select(*names), buckets)

    def upsert(self, table: str, batch: DataFrame) -> list[int]:
        """Rows of the batch in place of those with their key, and as new rows; columns that it lacks stay or are NULL.

        The batch has each key at most once.
        """
        key = self.entry["tables"][table]["key"]
        cols = [c for c in batch.columns if c not in key]

        def put(old: DataFrame, new: DataFrame) -> DataFrame:
            mine = new.select(*[F.col(c).alias(f"_{c}") for c in key], F.struct(F.lit(1).alias("_hit"), *cols).alias("_new"))
            met = old.join(mine, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "full_outer")
            hit = F.col("_new").isNotNull()
            return met.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in key else F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in old.columns])

        return self.merge(table, batch, put)

    def delete(self, table: str, keys: DataFrame) -> list[int]:
        """Without the rows whose key is among `keys`."""
        key = self.entry["tables"][table]["key"]
        return self.merge(table, keys.select(*key), lambda old, gone: old.join(gone, key, "left_anti"))

    def _bucket(self, spec: dict):  # noqa: ANN202 - a column
        return F.pmod(F.xxhash64(*spec["key"]), F.lit(spec["buckets"])).cast("int").alias(BUCKET)

    def _write(self, spec: dict, rows: DataFrame, buckets: list[int] | None) -> None:
        folder = f"data/{uuid.uuid4().hex}"
        at = f"{self.store.root}/{folder}"
        # rebalanced, not repartitioned: a bucket with a hot key is split over tasks
        rows.withColumn(BUCKET, self._bucket(spec)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(at)
        for b in list(spec["parts"]) if buckets is None else map(str, buckets):
            spec["parts"].pop(b, None)
        schema = StructType.fromJson(spec["schema"]).add(BUCKET, IntegerType())
        sums = [F.count("*").alias("rows")]
        for c in spec["track"]:
            sums += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.var_pop(c).alias(f"var_{c}"), F.min(c).cast("double").alias(f"least_{c}"), F.max(c).cast("double").alias(f"greatest_{c}")]
        for r in self.spark.read.schema(schema).parquet(at).groupBy(BUCKET).agg(*sums).collect():  # a row a bucket
            tracked = {c: [r[f"n_{c}"], r[f"mean_{c}"], r[f"var_{c}"] * r[f"n_{c}"], r[f"least_{c}"], r[f"greatest_{c}"]] if r[f"n_{c}"] else list(_NONE) for c in spec["track"]}
            spec["parts"][str(r[BUCKET])] = {"path": f"{folder}/{BUCKET}={r[BUCKET]}", "rows": r["rows"], "moments": tracked}

    def commit(self, **note: object) -> int:
        """Publish as the version after the parent; StaleParent if another writer has."""
        version = self.parent + 1
        files, log = self.store.files, f"{self.store.root}/log"
        waiting = f"{log}/_{uuid.uuid4().hex}"
        files.write(waiting, json.dumps(self.entry | {"version": version, "parent": self.parent, "note": note}))
        if not files.publish(waiting, self.store._name(version)):
            files.remove(waiting)
            raise StaleParent(f"version {version} exists")
        return version


_NONE = (0, 0.0, 0.0, None, None)
