"""K1-K3 and the chunk builders of E3/E4: the index is one Parquet table.

``chunks`` (store, source, doc_id, chunk_no, chunk_key, text, buckets, tfs,
norm2), partitioned by store: a chunk and its vector are written together, so
they cannot differ, and a search reads the columns it needs.

The chunk key is a sha256 of the chunk's lineage, so rebuilding gives the
same keys, and appending chunks that are there already adds nothing
(deviation V6).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubsearch.functions import fixed
from scrubsearch.operators import chunk as CH
from scrubsearch.operators.embed import DEFAULT_EMBEDDER, Embedder, explode_vectors
from scrubsearch.operators.flatten import flatten_rows, pack_rows
from scrubsearch.sources.tables import TICKET_COLUMNS


def chunk_key(store, source, doc_id, chunk_no):
    return F.sha2(F.concat_ws("|", store, source, doc_id.cast("string"), chunk_no.cast("string")), 256)


def _keyed(chunks: DataFrame, store: str) -> DataFrame:
    return chunks.select(
        F.lit(store).alias("store"), "source", F.col("doc_id").cast("long").alias("doc_id"), "chunk_no",
        chunk_key(F.lit(store), F.col("source"), F.col("doc_id"), F.col("chunk_no")).alias("chunk_key"),
        F.col("chunk").alias("text"))


def kb_chunks(docs: DataFrame, size: int = fixed.KB_CHUNK_SIZE, overlap: int = fixed.KB_CHUNK_OVERLAP,
              recursive: bool = False) -> DataFrame:
    """KB store: each document chunked on its own (P5, or P3 when recursive)."""
    fn = CH.chunk_recursive if recursive else CH.chunk_fixed
    return _keyed(fn(docs, size, overlap, keep=["source", "doc_id"]), "kb")


def sla_chunks(tickets: DataFrame, size: int = fixed.SLA_CHUNK_SIZE, overlap: int = fixed.SLA_CHUNK_OVERLAP,
               rows_per_bucket: int = 256, recursive: bool = False) -> DataFrame:
    """SLA store: tickets flattened (P1), packed per source and bucket (P2),
    then chunked (P5, or P4 when recursive). ``doc_id`` is the bucket."""
    flat = flatten_rows(tickets, TICKET_COLUMNS, keep=["source", "row_no"])
    packed = pack_rows(flat, rows_per_bucket).withColumnRenamed("bucket", "doc_id")
    fn = CH.chunk_recursive if recursive else CH.chunk_fixed
    return _keyed(fn(packed, size, overlap, keep=["source", "doc_id"]), "sla")


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# A store without chunks (S5) writes no Parquet file and must still read back
# as an empty table, hence a declared schema.
CHUNKS_SCHEMA = ("source string, doc_id long, chunk_no int, chunk_key string, text string, "
                 "buckets array<long>, tfs array<long>, norm2 long, store string")


@dataclass
class Index:
    """A persisted index: chunk texts with their vectors."""
    table: DataFrame

    @property
    def chunks(self) -> DataFrame:
        return self.table.drop("buckets", "tfs", "norm2")

    @property
    def vectors(self) -> DataFrame:
        return self.table.select("store", "chunk_key", "buckets", "tfs", "norm2")

    @property
    def postings(self) -> DataFrame:
        return explode_vectors(self.vectors, ["store", "chunk_key"])

    def store(self, name: str) -> "Index":
        """Partition pruning: only the store's directories are read."""
        return Index(self.table.where(F.col("store") == name))


def write_index(chunks: DataFrame, path: str, mode: str = "errorifexists",
                embed: Embedder = DEFAULT_EMBEDDER) -> Index:
    """K1 (+K3): chunks with their vectors as one store-partitioned table.

    ``mode='append'`` embeds and adds only chunks whose key is not there yet,
    each once. ``'overwrite'`` replaces the stores present in ``chunks`` and
    leaves the others; see ``drop_store`` for a store that lost all chunks."""
    spark = chunks.sparkSession
    if mode == "append" and index_complete(spark, path):
        there = read_index(spark, path).chunks.select("store", "chunk_key")
        chunks = chunks.join(there, ["store", "chunk_key"], "left_anti")
    if mode == "append":
        chunks = chunks.dropDuplicates(["store", "chunk_key"])
    columns = [c.split()[0] for c in CHUNKS_SCHEMA.split(", ")]
    # a dynamic overwrite leaves no marker: used only where there is one, else
    # what a build that was cut off left behind goes
    keep = "dynamic" if mode == "overwrite" and index_complete(spark, path) else "static"
    (embed(chunks, "text").select(*columns).write.mode(mode).option("partitionOverwriteMode", keep)
     .partitionBy("store").parquet(f"{path}/chunks"))
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str, store: str | None = None) -> Index:
    idx = Index(spark.read.schema(CHUNKS_SCHEMA).parquet(f"{path}/chunks"))
    return idx.store(store) if store is not None else idx


def index_complete(spark: SparkSession, path: str) -> bool:
    """The committer writes its marker last: without it the build was cut off."""
    return path_exists(spark, f"{path}/chunks/_SUCCESS")


def drop_store(spark: SparkSession, path: str, store: str) -> None:
    """Remove one store's chunks."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/chunks/store={store}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def open_or_build(spark: SparkSession, path: str, build, embed: Embedder = DEFAULT_EMBEDDER) -> Index:
    """K2: load the index if it is complete and never look at the sources
    again; otherwise build it from ``build()`` (a chunks DataFrame), also in
    place of what a build that was cut off left behind."""
    if not index_complete(spark, path):
        return write_index(build(), path, "overwrite", embed)
    return read_index(spark, path)
