"""P1 row flatten and P2 corpus packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_expr(columns: list[str]):
    """Every column cast to text, null as 'nan', joined with one space.

    ``concat_ws`` would silently drop nulls, so each value is coalesced first.
    """
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def flatten_rows(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, flatten_expr(columns).alias("text"))


def pack_rows(flat: DataFrame, rows_per_bucket: int = 256, source: str = "source",
              row_no: str = "row_no") -> DataFrame:
    """Rows of one source joined by newlines, in row order.

    Deviation V3: the text never crosses a source and holds at most
    ``rows_per_bucket`` rows, so a source with a third of all rows still
    splits into many bounded groups. The partial aggregate runs map-side;
    only (source, bucket) groups shuffle.
    """
    bucket = F.floor(F.col(row_no) / F.lit(rows_per_bucket)).cast("long")
    return (flat.withColumn("bucket", bucket)
            .groupBy(source, "bucket")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row_no, "text"))),
                                          lambda x: x["text"]), "\n").alias("text")))
