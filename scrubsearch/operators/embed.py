"""The embed plug point and its default, a hashed bag of tokens.

Tokens are runs of letters, marks and digits of any script in the lower-cased
text (one ideograph or kana each); none is left out. A token's bucket is the
first 32 bits of its md5, ``tf`` its count in the text and ``norm2`` the
text's sum of squared counts. The weight is ``tf / sqrt(norm2)``. Counts stay
integers so a dot product ``sum(tf_q * tf_c) / sqrt(norm2_q * norm2_c)`` is
computed by the same IEEE operations in every engine (exact oracle, stable
ranking).

A text's vector is computed where its row is: no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubsearch.functions import fixed
from scrubsearch.session import ship_package, small_batches


def tokens(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), fixed.SPACELESS, " $1 ")
    return F.filter(F.split(spaced, fixed.TOKEN_SPLIT, -1), lambda t: t != "")


def _vectors(tokens: pa.Array) -> pa.Array:
    """The vectors of a batch of token lists. Each distinct token of the batch is hashed once."""
    coded = tokens.flatten().cast(pa.binary()).dictionary_encode()
    hashed = np.array([int.from_bytes(hashlib.md5(t).digest()[:4]) for t in coded.dictionary.to_pylist()], np.int64)
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().to_numpy(zero_copy_only=False))
    key, tf = np.unique(row << 32 | hashed[coded.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    ends = np.searchsorted(key >> 32, np.arange(len(tokens) + 1))
    squares = np.concatenate([[0], np.cumsum(tf * tf)])
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (key & 0xFFFFFFFF, tf)]
    return pa.StructArray.from_arrays([*lists, pa.array(squares[ends[1:]] - squares[ends[:-1]], pa.int64())],
                                      ["buckets", "tfs", "norm2"])


def embed_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``buckets`` and ``tfs`` (parallel arrays, buckets ascending) and ``norm2``.

    Spark cuts the tokens; a batch of them is hashed and counted together."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)

    @F.arrow_udf("struct<buckets: array<bigint>, tfs: array<bigint>, norm2: bigint>")
    def vectors(batch: pa.Array) -> pa.Array:
        return _vectors(batch)

    return (df.withColumn("_v", vectors(tokens(F.col(text))))
            .withColumns({c: F.col(f"_v.{c}") for c in ("buckets", "tfs", "norm2")}).drop("_v"))


def explode_vectors(vec: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, bucket) with ``tf`` and ``norm2``."""
    return (vec.select(*keys, "norm2", F.explode_outer(F.arrays_zip("buckets", "tfs")).alias("x"))
            .where(F.col("x").isNotNull())
            .select(*keys, F.col("x.buckets").alias("bucket"), F.col("x.tfs").alias("tf"), "norm2"))


def embed_sparse(df: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """(key, bucket, tf, norm2): the vectors of ``embed_rows``, exploded."""
    keys = [key] if isinstance(key, str) else list(key)
    return explode_vectors(embed_rows(df.select(*keys, text), text), keys)


# Plug point: any function (DataFrame, text column name) -> DataFrame with
# buckets, tfs and norm2 added can replace the default, for chunks
# (write_index) and questions (search_sparse) alike.
Embedder = Callable[[DataFrame, str], DataFrame]
DEFAULT_EMBEDDER: Embedder = embed_rows
