"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every plan in this library counts on.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs the next operator a shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Cut ranked groups before their shuffle also when many rows per group are asked for.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.sql.session.timeZone": "UTC",
    # State of streams on the executors' disks instead of their heaps.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts and vectors go to the Python workers in batches of a bounded size.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}

_own_scratch: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}
_shipped: set[str] = set()
_kept: dict[tuple, DataFrame] = {}


def _ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="songloom-package-"), "songloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else built, and ship the package."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    _ship(spark)
    return spark


def build_session(app: str = "songloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _own_scratch:
        folder = tempfile.mkdtemp(prefix="songloom-")
        context.setCheckpointDir(folder)
        _own_scratch[context.applicationId] = folder
    return _own_scratch[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/songloom/{label}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The URI that Spark means by a path: one without a scheme is on its default file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.makeQualified(hadoop).toString()
    return "file://" + found.removeprefix("file:") if re.match(r"file:/[^/]", found) else found


def remove_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders this application has made; how many there were.

    For the end of a run: results that still read them can no longer be computed.
    """
    jvm, removed = spark.sparkContext._jvm, 0
    for key in [k for k in _kept if k[0] == spark.sparkContext.applicationId]:
        del _kept[key]
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True))
    return removed


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from the stored table.

    Later steps do not compute it again, a lost executor costs no more than re-reading it,
    and its size is known: joins with it are broadcast below Spark's threshold and
    shuffled above it, with no guess in the plan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """A stored table that ``make`` gives, made once for each key and application."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give heavy work a task per core when a table is too small to have that many splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
