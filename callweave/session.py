"""Session construction and lineage cutting.

Iterative graph jobs cut lineage with ``DataFrame.checkpoint()`` into the shared
folder named by ``spark.checkpoint.dir``. The setting is read from the session;
only a local-mode session without it (tests, the bench) gets a scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "callweave") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # keep CPU-heavy text stages parallel after small shuffles
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint root, setting it from ``spark.checkpoint.dir``.

    On a cluster the folder must be shared storage named by the session; a
    machine-local folder is only chosen for a local-mode session without one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif _is_local(spark):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="callweave-ckpt-", dir="/tmp"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint root for written tables and stream state."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/callweave-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` to reliable storage and drop its lineage (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as columns under the checkpoint root and read back: unlike the rows of a checkpoint,
    numbers and names that come often take little room there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MATERIALIZED: dict[tuple, str] = {}


def materialized(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Build a derived table once per session, write it as parquet under the
    checkpoint root (shared storage) and read it back on every later use."""
    full = (spark.sparkContext.applicationId,) + tuple(key)
    path = _MATERIALIZED.get(full)
    if path is None:
        path = scratch_path(spark, "table-" + "-".join(str(k).strip("/").replace("/", "_") for k in key))
        build().write.mode("overwrite").parquet(path)
        _MATERIALIZED[full] = path
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Widen an input read as fewer partitions than the cluster has task slots
    (a small file on a wide cluster) before CPU-heavy per-row work. An input with
    enough partitions, as any large one has, is returned unchanged (no shuffle)."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def cut_and_count(df: DataFrame, name: str = "round") -> tuple[DataFrame, int]:
    """Checkpoint ``df`` to reliable storage and count it in one action.

    ``df`` is cached for the duration of the action so the checkpoint writer
    reads the cached rows instead of recomputing them; the cache is released
    once the checkpoint files exist, and the returned frame reads only them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = cached.checkpoint(eager=False)
        n = out.count()
    finally:
        cached.unpersist()
    return out, n


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``callweave`` importable in executor Python workers (once per application):
    the package is zipped on the driver and added with ``SparkContext.addPyFile``,
    which distributes it to every executor."""
    import zipfile

    import callweave
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(callweave.__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="callweave-py-"), "callweave.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
