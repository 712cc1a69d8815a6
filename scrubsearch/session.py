"""Session construction and the shared scratch folder.

Tables written to cut lineage (index builds, streaming checkpoints, derived
files) go under ``spark.checkpoint.dir``: on a cluster that setting names a
shared folder (HDFS / object store) that survives the loss of an executor.
We only choose our own folder when the session leaves it unset (local runs,
tests); then it lives below the warehouse dir, never in a machine-local tmp.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "scrubsearch",
              extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts; set only where the session has none."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        root = warehouse.rstrip("/") + "/_scrubsearch_checkpoints"
        if root.startswith("file:"):
            os.makedirs(root[len("file:"):], exist_ok=True)
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint root for one job's written table."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Long texts and files reach Python in Arrow batches of at most ``rows``: lower the session's size, never raise it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Their Python workers import it by name, whatever folder the driver was
    started in. Spark's file server hands out the archive.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="scrubsearch-"), "scrubsearch.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
