"""Exactly-once ingestion of a folder of workbooks, with a ledger.

A run lists the folder, leaves out the files whose path, length and content
digest the ledger has, decodes the others and writes, in this order, their rows
and their ledger entries (path, length, digest, n_rows, error). The entries
commit the run: rows of a run that was cut off belong to no committed run and
are never read. A file that cannot be decoded is quarantined: its entry holds
the error, it has no rows, and it is tried again only when its content changes.
A file that changes replaces its earlier rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubsearch.operators.index import path_exists
from scrubsearch.session import ship_package, small_batches
from scrubsearch.sources.xlsx import ROWS, _decode

LEDGER = "path string, length long, digest string, n_rows long, error string, at timestamp, run string"
TABLE_ROWS = "path string, row_no long, header array<string>, cells array<string>, run string"


def ledger(spark: SparkSession, table: str) -> DataFrame:
    """All committed entries of the table at ``table``, and whether each is the newest of its path."""
    if not path_exists(spark, f"{table}/ledger"):
        return spark.createDataFrame([], LEDGER).withColumn("current", F.lit(True))
    w = Window.partitionBy("path").orderBy(F.desc("at"), F.desc("run"))
    return (spark.read.schema(LEDGER).parquet(f"{table}/ledger")
            .withColumn("current", F.row_number().over(w) == 1))


def rows(spark: SparkSession, table: str) -> DataFrame:
    """(source, row_no, text) of the current files' rows (see xlsx.read_workbooks)."""
    if not path_exists(spark, f"{table}/rows"):
        return spark.createDataFrame([], "source string, row_no long, text string")
    now = ledger(spark, table).where("current AND error IS NULL").select("path", "run")
    return (spark.read.schema(TABLE_ROWS).parquet(f"{table}/rows").join(now, ["path", "run"], "left_semi")
            .select(F.element_at(F.split("path", "/"), -1).alias("source"), "row_no",
                    F.array_join(F.transform("cells", lambda c: F.coalesce(c, F.lit("nan"))), " ").alias("text")))


def ingest(spark: SparkSession, folder: str, table: str, glob: str = "*.xlsx") -> DataFrame:
    """Take in what is new in ``folder``; returns the ledger entries of this run.

    Lock files (``~$*``) are left out. An empty folder is no error."""
    ship_package(spark)
    small_batches(spark)
    run = uuid.uuid4().hex
    known = ledger(spark, table).where("current").select("path", "length", "digest")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
             .where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))
             .select("path", "length", F.sha2("content", 256).alias("digest"), "content"))
    new = files.join(known, ["path", "length", "digest"], "left_anti")
    listed = f"{table}/listed/run={run}"
    new.drop("content").write.parquet(listed)  # what this run works on, whatever the folder does meanwhile
    listed = spark.read.parquet(listed)
    work = files.join(listed.select("path", "digest"), ["path", "digest"], "left_semi")
    (work.select("path", "content").repartition("path").mapInPandas(_decode, ROWS)
     .write.parquet(f"{table}/decoded/run={run}"))
    decoded = spark.read.schema(ROWS).parquet(f"{table}/decoded/run={run}")
    broken = decoded.where("error IS NOT NULL").groupBy("path").agg(F.first("error").alias("error"))
    (decoded.where("error IS NULL").join(broken.select("path"), "path", "left_anti")
     .select("path", "row_no", "header", "cells").write.parquet(f"{table}/rows/run={run}"))
    counts = (spark.read.schema(TABLE_ROWS).parquet(f"{table}/rows/run={run}").groupBy("path")
              .agg(F.count(F.lit(1)).alias("n_rows")))
    (listed.select("path", "length", "digest").join(counts, "path", "left").join(broken, "path", "left")
     .select("path", "length", "digest", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "error",
             F.current_timestamp().alias("at")).write.parquet(f"{table}/ledger/run={run}"))
    for part in ("listed", "decoded"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{part}/run={run}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return ledger(spark, table).where(F.col("run") == run)
