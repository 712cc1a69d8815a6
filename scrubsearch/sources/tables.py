"""Table sources and the derived views every query builds on.

Only columns a query uses are selected, so the Parquet scan reads just those
(``ReadSchema`` in the plan) and filters reach it as ``PushedFilters``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# A bot activity. Three nested id structs, as the message JSON carries them.
ACTIVITY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("from", T.StructType([T.StructField("id", T.StringType())])),
    T.StructField("recipient", T.StructType([T.StructField("id", T.StringType())])),
    T.StructField("conversation", T.StructType([T.StructField("id", T.StringType())])),
    T.StructField("id", T.StringType()),
    T.StructField("serviceUrl", T.StringType()),
])

# Python's str.strip() whitespace set, restricted to the ASCII controls a
# message can carry; plain trim() would only remove spaces.
STRIP_CHARS = " \t\n\r\x0b\x0c"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows when the scan yields fewer partitions than the
    cluster has task slots (a small table in one file with one row group is
    read by a single task, and the per-row text work downstream would run on
    one core). Large inputs already split into many partitions and pass
    through untouched; filters and column pruning still reach the scan."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 on the driver tables: one ticket per order, PII from its customer.

    ``source`` stands in for the workbook file a ticket came from. The join is
    an ordinary equi-join: Catalyst/AQE pick broadcast or sort-merge from the
    runtime size of ``customer``, which grows with the data.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    key = F.col("o_orderkey").cast("string")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(
                F.concat(F.lit("IN"), F.lpad(key, 7, "0")).alias("ticket_id"),
                F.col("o_orderstatus").alias("status"),
                F.col("o_orderpriority").alias("priority"),
                F.col("o_orderdate").cast("string").alias("last_update"),
                F.col("c_name").alias("engineer"),
                F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
                F.concat(F.lit("+1 (555) 555-"),
                         F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias("phone"),
                F.concat(F.lit("shard"), (F.col("o_orderkey") % 8).cast("string")).alias("source"),
                F.col("o_orderkey").alias("row_no"),
            ))


TICKET_COLUMNS = ["ticket_id", "status", "priority", "last_update", "engineer", "email", "phone"]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per ticket, each naming its ticket id and an e-mail."""
    t = tickets(spark, sf_dir)
    return t.select(
        F.col("row_no").alias("query_id"),
        F.concat(F.lit("What's the status of ticket "), F.col("ticket_id"),
                 F.lit("? Reply to "), F.col("email")).alias("text"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with null text read as empty (``doc.text or ""``)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def conversation_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bot activities derived from ``conversations``: user turns are messages."""
    c = table(spark, sf_dir, "conversations")
    cid = F.col("conv_id").cast("string")
    return c.select(
        F.when(F.col("role") == "user", F.lit("message")).otherwise(F.lit("typing")).alias("type"),
        F.col("text"),
        F.struct(F.col("role").alias("id")).alias("from"),
        F.struct(F.lit("bot").alias("id")).alias("recipient"),
        F.struct(cid.alias("id")).alias("conversation"),
        F.concat(F.lit("C"), cid, F.lit("-"), F.col("turn").cast("string")).alias("id"),
        F.lit("http://localhost").alias("serviceUrl"),
    )


def read_activities(spark: SparkSession, path: str, streaming: bool = False,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """S6 source: message JSON with a declared schema (batch or stream)."""
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.schema(ACTIVITY).json(path)


def normalize_messages(activities: DataFrame) -> DataFrame:
    """Keep message activities; text stripped, null -> ''."""
    return (activities.where(F.col("type") == "message")
            .select(F.col("id"), F.col("conversation.id").alias("conversation_id"),
                    F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(STRIP_CHARS)).alias("text")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KB questions: the normalized user messages, keyed like queries."""
    return normalize_messages(conversation_activities(spark, sf_dir)).select(
        F.col("id").alias("query_id"), "text")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2b dictionary: person names are input data (customer names)."""
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty input is a valid, empty corpus."""
    return spark.createDataFrame([], schema)
