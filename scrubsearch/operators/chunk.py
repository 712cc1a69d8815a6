"""P3/P4 recursive chunking and P5 fixed-window chunking.

Chunking is per row (document or packed bucket): no shuffle, the work
spreads over every input split. Chunks keep their lineage (deviation V6).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from scrubsearch.functions import fixed
from scrubsearch.session import small_batches


def fixed_windows(text, size: int, overlap: int):
    """P5 as a column: windows of ``size`` characters every ``size-overlap``.

    One pass cuts the text into blocks of a step; a window is a block and the
    start of those after it, so the cost is linear in the text's length."""
    step = size - overlap
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    follow = -(-overlap // step)
    z = F.arrays_zip(*[F.slice(blocks, i + 1, F.greatest(F.size(blocks), F.lit(1))).alias(f"b{i}")
                       for i in range(follow + 1)])
    # the last block starts no window of its own if the one before covers it
    n = F.greatest(F.ceil((F.length(text) - F.lit(overlap)) / F.lit(float(step))), F.lit(1)).cast("int")
    return F.transform(F.slice(z, 1, n), lambda x: F.substring(
        F.concat(*[F.coalesce(x[f"b{i}"], F.lit("")) for i in range(follow + 1)]), 1, size))


def chunk_fixed(df: DataFrame, size: int, overlap: int, keep: list[str], text: str = "text") -> DataFrame:
    """P5: one row per non-empty window, ``chunk_no`` dense from 0."""
    return (df.select(*keep, F.posexplode_outer(fixed_windows(F.col(text), size, overlap)).alias("chunk_no", "chunk"))
            .where(F.length("chunk") > 0)
            .withColumn("chunk_no", F.col("chunk_no").cast("int")))


# ---------------------------------------------------------------------------
# Recursive splitter: the published behaviour of the recursive character
# splitter (separators coarsest first, separator kept at the start of the
# following piece, greedy merge up to ``size``, carry back up to ``overlap``
# characters, chunks stripped, empty chunks dropped).
# ---------------------------------------------------------------------------

def _split_keep_start(text: str, sep: str) -> list[str]:
    if sep == "":
        return [c for c in text]
    parts = re.split("(" + re.escape(sep) + ")", text)
    out = [parts[0]] + [parts[i] + parts[i + 1] for i in range(1, len(parts) - 1, 2)]
    return [p for p in out if p != ""]


def _merge(splits: list[str], size: int, overlap: int) -> list[str]:
    chunks: list[str] = []
    window: list[str] = []
    total = 0
    for piece in splits:
        n = len(piece)
        if window and total + n > size:
            joined = "".join(window).strip()
            if joined:
                chunks.append(joined)
            while window and (total > overlap or total + n > size):
                total -= len(window[0])
                window.pop(0)
        window.append(piece)
        total += n
    joined = "".join(window).strip()
    if joined:
        chunks.append(joined)
    return chunks


def split_recursive(text: str, size: int, overlap: int,
                    separators: list[str] = fixed.RECURSIVE_SEPARATORS) -> list[str]:
    if not text:
        return []
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1:]
            break
    out: list[str] = []
    pending: list[str] = []
    for piece in _split_keep_start(text, sep):
        if len(piece) < size:
            pending.append(piece)
            continue
        if pending:
            out.extend(_merge(pending, size, overlap))
            pending = []
        if rest:
            out.extend(split_recursive(piece, size, overlap, rest))
        else:
            out.append(piece)
    if pending:
        out.extend(_merge(pending, size, overlap))
    return out


def _recursive_udf(size: int, overlap: int):
    @pandas_udf(T.ArrayType(T.StringType()))
    def split_batch(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t or "", size, overlap))
    return split_batch


def chunk_recursive(df: DataFrame, size: int, overlap: int, keep: list[str], text: str = "text") -> DataFrame:
    """Arrow-batched splitter, then ``posexplode`` (chunk_no from 0)."""
    small_batches(df.sparkSession)
    fn = _recursive_udf(size, overlap)
    return (df.select(*keep, F.posexplode_outer(fn(F.col(text))).alias("chunk_no", "chunk"))
            .where(F.col("chunk").isNotNull())
            .withColumn("chunk_no", F.col("chunk_no").cast("int")))
