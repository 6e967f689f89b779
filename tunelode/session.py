"""Session helpers: a local test session and tables kept in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch between Spark and its Python workers, where the session has Spark's default.
BATCH_ROWS = 512

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local[cpus] session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tunelode")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TUNELODE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset in local mode, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tunelode-shared-")
    return _own_dirs[app]


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and return it as read from there.

    The written table cuts the lineage: a lost executor costs a task's rerun, never the steps before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tunelode/{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *kept: DataFrame) -> None:
    """Remove tables that keep() wrote, once nothing reads them any more."""
    for df in kept:
        for f in df.inputFiles()[:1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once an application, so that their Python finds it wherever it lies.

    Texts may be long, so Arrow batches get BATCH_ROWS rows unless the session says otherwise.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        path = f"{tempfile.mkdtemp(prefix='tunelode-')}/tunelode_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
