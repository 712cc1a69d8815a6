"""Operator 5: shard placement by a permutation-filled lookup table.

Each shard owns a permutation of the slots of a prime-sized table, given by an
offset and a skip that are hashed from the shard's name. The shards take turns,
each claiming its next unclaimed slot, until the table is full. A row's key is
hashed to a slot and the table, a broadcast array of fixed size, names the
shard: constant time, no shuffle, nearly equal shares, and few keys move when a
shard joins or leaves.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65537  # prime; at least a hundred times the number of shards


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _name_hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def build_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of its shard. ``shards`` are distinct names in any order.

    The turns go in name order, so the placement does not depend on the order
    in which the shards are listed. The indices do follow the listing.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a non-empty list of distinct names")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime, at least the number of shards")
    table = np.full(size, -1, np.int32)
    slots = np.arange(size, dtype=np.int64)
    turns = []
    for k in sorted(range(len(shards)), key=lambda k: shards[k]):
        offset = _name_hash(shards[k], "offset") % size
        skip = _name_hash(shards[k], "skip") % (size - 1) + 1 if size > 1 else 0
        turns.append((k, iter(((offset + slots * skip) % size).tolist())))
    free = size
    while free:
        for k, wanted in turns:
            if not free:
                break
            table[next(s for s in wanted if table[s] < 0)] = k
            free -= 1
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: its md5 as text, the first 15 hex digits modulo ``size``.

    A null key is the empty text, so it has a slot as well.
    """
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE,
                  slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` plus the slot and the shard name of every row.

    Columns of ``df`` that have these names are replaced. Null keys count as
    the empty text; equal keys share a shard; an empty table stays empty.
    """
    spark = df.sparkSession
    names = [shards[k] for k in build_table(shards, size)]
    table = spark.createDataFrame(list(enumerate(names)), "__slot int, __shard string")
    plain = df.drop(slot_col, shard_col)
    return (
        plain.withColumn("__slot", slot_of(plain[key], size))
        .join(F.broadcast(table), "__slot")  # ``size`` rows, whatever the data
        .withColumnsRenamed({"__slot": slot_col, "__shard": shard_col})
    )


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, size: int = TABLE_SIZE,
                 max_records_per_file: int = 1_000_000) -> None:
    """Write ``df`` as one Parquet folder per shard, in files of a bounded length."""
    (assign_shards(df, key, shards, size).drop("slot").write.partitionBy("shard")
     .option("maxRecordsPerFile", max_records_per_file).parquet(path))
