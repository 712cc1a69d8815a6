"""Operator 6: exact top-k by inner product over norm-sorted vectors.

Components x become floor(SCALE * x). All vectors are rotated by the right
singular vectors of the table (eigenvectors of its Gram matrix, a d x d sum),
so that most of an inner product lies in the leading coordinates, and dealt by
descending length into blocks.

First each query meets the block of the longest vectors, which gives it a first
k-th best score. By Cauchy-Schwarz no vector of a block can score more than the
query's length times the block's largest length, so a query goes only to blocks
whose bound reaches its score. There the partial products over the leading
rotated coordinates, plus the product of the residual lengths, bound each
vector; only what can still reach the k-th best is multiplied out, in whole
numbers. A cell holds a bounded block of queries and one of vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubsearch.llm.common import cut, global_rank

SCALE = 256
K = 5
BLOCK = 4096            # vectors of a block
QUERY_BLOCK = 1024      # queries of a cell, about
MAX_HEADS = 100_000     # blocks whose largest lengths are kept on the driver
LEADING = (8, 24)       # leading coordinates after which bounds are taken


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v (whole numbers as longs): rows with an id and only finite components."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long"))
    bad = F.exists(F.col(vector).cast("array<double>"),
                   lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(vec_id).cast("long").alias("id"), v.alias("v")))


def gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of the outer products of all vectors; d x d, summed per task first."""
    def run(frames):
        total = np.zeros((dim, dim))
        for frame in frames:
            m = matrix(frame["v"], dim).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"at": np.arange(dim), "row": list(total)})

    rows = vectors.select("v").mapInPandas(run, "at int, row array<double>")
    sums = rows.select("at", F.posexplode("row").alias("col", "x")).groupBy("at", "col").agg(F.sum("x").alias("x"))
    out = np.zeros((dim, dim))
    for r in sums.collect():  # d x d numbers
        out[r["at"], r["col"]] = r["x"]
    return out


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    """Rows of whole numbers, short ones padded with 0."""
    out = np.zeros((len(column), dim), np.int64)
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))


def block_topk(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray,
               vectors: np.ndarray, rotation: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's k best of the block that reach its floor.

    floors: the scores that are beaten or met already; ties are all that a
    smaller id can win, so an equal bound stays in.
    """
    q, v = queries.astype(np.float64) @ rotation, vectors.astype(np.float64) @ rotation
    slack = 1e-9 * (1.0 + _norms(queries)[:, None] * _norms(vectors)[None, :].max(initial=0.0))
    order = np.lexsort((ids, -_norms(vectors)))  # longest first
    v, ids, vectors = v[order], ids[order], vectors[order]
    out: list[tuple[int, int, int]] = []
    steps = [0, *[s for s in LEADING if s < v.shape[1]], v.shape[1]]
    # Squared lengths of what follows each step.
    rest_q = [np.sqrt((q[:, s:] ** 2).sum(axis=1)) for s in steps]
    rest_v = [np.sqrt((v[:, s:] ** 2).sum(axis=1)) for s in steps]
    alive = rest_q[0][:, None] * rest_v[0][None, :] + slack >= floors[:, None]
    alive &= query_ids[:, None] != ids[None, :]
    partial = np.zeros(alive.shape)
    for a, b, rq, rv in zip(steps, steps[1:], rest_q[1:], rest_v[1:], strict=False):
        rows, cols = alive.any(axis=1), alive.any(axis=0)
        if not rows.any():
            return out
        partial[np.ix_(rows, cols)] += q[rows, a:b] @ v[cols, a:b].T
        bound = partial + rq[:, None] * rv[None, :] + slack
        low = partial - rq[:, None] * rv[None, :] - slack
        # The k-th largest lower bound among what is alive is a floor as well.
        if alive.shape[1] >= k:
            kth = np.partition(np.where(alive, low, -np.inf), -k, axis=1)[:, -k]
            floors = np.maximum(floors, kth)
        alive &= bound >= floors[:, None]
    for row in np.flatnonzero(alive.any(axis=1)):
        cols = np.flatnonzero(alive[row])
        scores = vectors[cols] @ queries[row]
        best = np.lexsort((ids[cols], -scores))[:k]
        out += [(int(query_ids[row]), int(ids[cols[c]]), int(scores[c])) for c in best]
    return out


def _search(queries: DataFrame, blocks: DataFrame, rotation: np.ndarray, dim: int, k: int) -> DataFrame:
    """queries: block, part, id, v, floor. blocks: block, part, id, v. Cell by cell."""
    left = queries.select("block", "part", "id", "v", F.col("floor").cast("double").alias("floor"), F.lit(True).alias("q"))
    right = blocks.select("block", "part", "id", "v", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("q"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        is_q = frame["q"].to_numpy(bool)
        x, y = frame[is_q], frame[~is_q]
        got = []
        if len(x) and len(y):
            got = block_topk(x["id"].to_numpy(), matrix(x["v"], dim), x["floor"].fillna(-np.inf).to_numpy(),
                             y["id"].to_numpy(), matrix(y["v"], dim), rotation, k)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype("int64")

    return left.unionByName(right).groupBy("block", "part").applyInPandas(
        run, "query_id long, vec_id long, score long")


def _with_blocks(queries: DataFrame, heads: DataFrame) -> DataFrame:
    """A row for each query and block that can still hold one of its k best.

    heads: block, longest; one row per BLOCK vectors, the longest falling with
    the block. It is sent to the tasks while it is under MAX_HEADS rows (400
    million vectors); past that, each query goes to all blocks and the cells
    prune alone.
    """
    table = heads.orderBy("block").limit(MAX_HEADS + 1).collect()
    if not table:
        return queries.withColumn("block", F.lit(0)).where(F.lit(False))
    first, last = table[0]["block"], heads.agg(F.max("block")).first()[0]
    if len(table) <= MAX_HEADS:
        longest = queries.sparkSession.sparkContext.broadcast(np.array([-h["longest"] for h in table]))

        @F.pandas_udf("int")
        def useful(length: pd.Series, floor: pd.Series) -> pd.Series:
            need = np.where(length > 0, (floor.fillna(-np.inf) - 1e-6) / np.maximum(length, 1e-300) / (1 + 1e-9),
                            np.where(floor.fillna(-np.inf) > 0, np.inf, -np.inf))
            return pd.Series(np.searchsorted(longest.value, -need, side="right"))

        n = useful(F.col("length"), F.col("floor").cast("double"))
    else:
        n = F.lit(last - first + 1)
    return queries.withColumn("n_blocks", n).where("n_blocks > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(first), F.lit(first) + F.col("n_blocks") - 1)))


def top_k(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
          is_query=lambda c: c % 50 == 0, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of each query.

    Queries are the usable rows whose id satisfies ``is_query``, candidates all
    usable rows with another id. Ties go to the smaller id. Rows without id, or
    whose vector is null or holds a null or non-finite component, take no part;
    short vectors count as padded with zeros. A repeated row is one candidate
    and one query. Other columns are ignored.
    """
    all_rows = usable(vectors, vec_id, vector)
    shape = all_rows.agg(F.max(F.size("v")).alias("dim"), F.count("*").alias("n")).first()
    dim = shape["dim"] or 1
    rotation = np.linalg.eigh(gram(all_rows, dim))[1][:, ::-1].copy()  # largest first

    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = all_rows.dropDuplicates(["id", "v"]).withColumn("length", F.sqrt(length))
    ranked = cut(global_rank(rows, [F.col("length").desc(), F.col("id"), F.col("v")], "pos")
                 .withColumn("block", F.floor(F.col("pos") / BLOCK).cast("int")))
    heads = ranked.groupBy("block").agg(F.max("length").alias("longest"))
    queries = ranked.where(is_query(F.col("id"))).select("id", "v", "length")
    n_queries = queries.count()
    parts = max(1, -(-n_queries // QUERY_BLOCK))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def spread(some: DataFrame) -> DataFrame:
        """Each block of vectors, once for every part of the queries."""
        return some.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    first = cut(_search(queries.withColumns({"block": F.lit(0), "floor": F.lit(None).cast("double")}),
                        spread(ranked.where("block = 0")), rotation, dim, k))
    floors = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).select(
        F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("s")).alias("floor"))
    # Blocks are numbered by descending length, so the useful ones of a query
    # are those up to the last whose bound reaches its floor. A query finds it
    # in the table of the blocks' longest vectors, sorted by length.
    wanted = _with_blocks(queries.join(floors, "id", "left"), heads.where("block > 0"))
    later = _search(wanted, spread(ranked.where("block > 0")), rotation, dim, k)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (first.unionByName(later).distinct().withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
