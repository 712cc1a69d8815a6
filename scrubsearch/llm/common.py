"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from scrubsearch.session import checkpoint_root, scratch_dir

# Fixed: a word is a maximal run of anything but ASCII white space.
WORD_CLASS = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD_CLASS)

# Texts reach Python in Arrow batches of at most this many rows, so that a
# batch of long documents stays small next to a task's memory.
ARROW_ROWS = 256


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` (never raise it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has, derived from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager)


def store(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder; the table and its path.

    For loops: a checkpoint keeps the size that the optimizer has estimated,
    which multiplies with every join of every round; a table has a size.
    """
    path = scratch_dir(df.sparkSession, "round")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``store`` that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


PIECES = 4


def drawn_part(text: Column, chars: int) -> Column:
    """At most about ``chars`` characters of a text for a training sample, from all over it.

    A longer text gives PIECES runs of equal length, one from each of its
    PIECES equal stretches, at a place that a hash of the text chooses."""
    size = chars // PIECES
    room = F.floor(F.length(text) / F.lit(PIECES)).cast("int")
    runs = [text.substr(room * i + F.pmod(F.xxhash64(text, F.lit(i)), F.greatest(room - size, F.lit(0)) + 1).cast("int") + 1,
                        F.lit(size)) for i in range(PIECES)]
    return F.when(text.isNull() | (F.length(text) <= chars), text).otherwise(F.concat_ws("\n", *runs))


def lookup(df: DataFrame, table: DataFrame, on: str, max_broadcast_rows: int = 100_000) -> DataFrame:
    """Left-join a one-row-per-key table, broadcasting it only while it is small.

    ``table`` must be cheap to count (a checkpointed or written table). Past the
    bound the join shuffles, and adaptive execution splits its hot keys.
    """
    n = table.limit(max_broadcast_rows + 1).count()
    return df.join(F.broadcast(table) if n <= max_broadcast_rows else table, on, "left")


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Number the rows 0, 1, ... in the given order without one task seeing them all.

    The rows are range-partitioned and written, each partition numbers its own,
    and the partitions' counts (one row per partition) give the offsets.
    """
    part, pos, off = fresh(df, "_gr_part", "_gr_pos", "_gr_off")
    cuts = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    counts = cuts.groupBy(part).count().orderBy(part).collect()  # one row per partition
    offsets, total = [], 0
    for r in counts:
        offsets.append((r[0], total))
        total += r["count"]
    if not offsets:
        return cuts.drop(part).withColumn(name, F.lit(0).cast("long"))
    table = df.sparkSession.createDataFrame(offsets, f"{part} int, {off} long")
    return (
        cuts.withColumn(pos, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
        .join(F.broadcast(table), part)
        .withColumn(name, (F.col(pos) - 1 + F.col(off)).cast("long"))
        .drop(part, pos, off)
    )


_MODEL: dict = {}


def worker_model(owner: str, key=None, build=lambda: None):
    """What ``build`` makes, kept by this Python worker until another owner or key asks.

    Spark reuses its Python workers for the stages of a job; a worker holds the
    parsed model and the remembered results of one operator at a time."""
    if _MODEL.get("of") != (owner, key):
        _MODEL.clear()
        _MODEL["model"] = build()
        _MODEL["of"] = (owner, key)
    return _MODEL["model"]


def release_models(owner: str) -> None:
    """Let go of another operator's model."""
    if _MODEL and _MODEL["of"][0] != owner:
        _MODEL.clear()


def map_rows(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """``fn(pandas frame) -> pandas frame`` over the Arrow batches of each task."""

    def run(frames):
        release_models(fn.__module__)
        for frame in frames:
            if len(frame):
                yield fn(frame)

    return df.mapInPandas(run, schema)


def as_text(value) -> str:
    """A text cell as ``str``; null is the empty text."""
    return value if isinstance(value, str) else ""


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
