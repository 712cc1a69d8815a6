"""Operator 2: quality classifier, a byte-level convolutional network in numpy.

The bytes of a text are cut into overlapping chunks that cover all of it. Each
byte has a learned vector; learned filters slide over the chunk and are
max-pooled. The largest and the mean pooled value over all chunks go through a
hidden layer to one probability. Trained on the driver on a bounded sample of
labelled rows, by Adam; applied to all rows without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubsearch.llm.common import as_text, cut, drawn_part, map_rows

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 24, 16
CHUNK, OVERLAP = 512, 64
SAMPLE_ROWS = 4_000        # labelled rows to learn from, about
SAMPLE_CHARS = 6_000       # of the text of each of them
TRAIN_CHUNKS = 8           # chunks of a text in one training step
EPOCHS, BATCH, RATE = 14, 64, 4e-3
PREDICT_AT = 0.3
CHUNKS_AT_ONCE = 128


def chunks(text: str) -> np.ndarray:
    """All chunks of a text as rows of bytes, the last one padded with 0."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class Network:
    embed: np.ndarray      # 256 x EMBED
    filters: np.ndarray    # WIDTH * EMBED x FILTERS
    bias: np.ndarray       # FILTERS
    hidden: np.ndarray     # 2 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray        # HIDDEN
    out_bias: np.ndarray   # 1

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max-pooled filter values of chunks and the positions of the maxima."""
        x = self.embed[rows].reshape(len(rows), -1)
        windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]
        values = windows.reshape(-1, WIDTH * EMBED) @ self.filters + self.bias
        values = values.reshape(len(rows), -1, FILTERS)
        at = values.argmax(axis=1)
        best = np.take_along_axis(values, at[:, None, :], axis=1)[:, 0]
        return np.maximum(best, 0), at

    def score(self, text: str) -> float:
        rows = chunks(text)
        top, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS)
        for k in range(0, len(rows), CHUNKS_AT_ONCE):
            p, _ = self.pooled(rows[k: k + CHUNKS_AT_ONCE])
            top = np.maximum(top, p.max(axis=0))
            total += p.sum(axis=0)
        f = np.concatenate([top, total / len(rows)])
        z = float(np.tanh(f @ self.hidden + self.hidden_bias) @ self.out + self.out_bias[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _new(rng: np.random.Generator) -> Network:
    def normal(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return Network(normal(256, EMBED, scale=0.5), normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
                   np.zeros(FILTERS, np.float32), normal(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5),
                   np.zeros(HIDDEN, np.float32), normal(HIDDEN, scale=HIDDEN ** -0.5), np.zeros(1, np.float32))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """Fit a network. Without texts, or with one class, it says that class's share."""
    rng = np.random.default_rng(seed)
    net = _new(rng)
    y = np.array(labels, np.float32)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    net.out_bias[:] = np.log(share / (1 - share))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    rows = [chunks(t) for t in texts]
    names = list(net.__dataclass_fields__)
    m1 = {n: np.zeros_like(getattr(net, n)) for n in names}
    m2 = {n: np.zeros_like(getattr(net, n)) for n in names}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        rate = RATE * (1 - epoch / EPOCHS)
        for start in range(0, len(order), BATCH):
            batch = order[start: start + BATCH]
            picked = [rows[i] if len(rows[i]) <= TRAIN_CHUNKS else
                      rows[i][np.sort(rng.choice(len(rows[i]), TRAIN_CHUNKS, replace=False))] for i in batch]
            grads = _gradients(net, picked, y[batch])
            step += 1
            for n, g in grads.items():
                m1[n] += 0.1 * (g - m1[n])
                m2[n] += 0.001 * (g * g - m2[n])
                getattr(net, n)[...] -= rate * (m1[n] / (1 - 0.9**step)) / (
                    np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Network, picked: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross entropy over a batch of texts."""
    sizes = np.array([len(r) for r in picked])
    owner = np.repeat(np.arange(len(picked)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    rows = np.concatenate(picked)
    p, at = net.pooled(rows)
    top = np.maximum.reduceat(p, first)
    mean = np.add.reduceat(p, first) / sizes[:, None]
    f = np.concatenate([top, mean], axis=1)
    h = np.tanh(f @ net.hidden + net.hidden_bias)
    z = h @ net.out + net.out_bias[0]
    dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
    dh = dz[:, None] * net.out * (1 - h * h)
    df = dh @ net.hidden.T
    # A maximum over chunks passes its gradient to the chunks that have it.
    is_top = p == top[owner]
    dp = np.where(is_top, df[owner, :FILTERS] / np.add.reduceat(is_top, first).clip(1)[owner], 0)
    dp = (dp + df[owner, FILTERS:] / sizes[owner][:, None]) * (p > 0)
    window = at[:, :, None] * STRIDE + np.arange(WIDTH)          # chunk x filter x width
    byte = rows[np.arange(len(rows))[:, None, None], window]
    x = net.embed[byte].reshape(len(rows), FILTERS, -1)
    d_filters = np.einsum("nf,nfk->kf", dp, x, optimize=True)
    d_x = (dp[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    flat = byte.reshape(-1)
    d_embed = np.stack([np.bincount(flat, weights=d_x[:, k], minlength=256) for k in range(EMBED)], axis=1)
    return {"embed": d_embed.astype(np.float32), "filters": d_filters.astype(np.float32),
            "bias": dp.sum(axis=0).astype(np.float32), "hidden": f.T @ dh, "hidden_bias": dh.sum(axis=0),
            "out": h.T @ dz, "out_bias": np.array([dz.sum()], np.float32)}


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
           label: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of about ``rows`` labelled documents outside the held-out fold.

    Chosen by a hash of the id, so reruns agree. Null ids, texts and labels are
    left out; of several labels of an id the smallest holds, of several texts
    the one with the smallest digest. Of a long text the sample has runs from
    all over it (``drawn_part``). ``rows`` and ``chars`` bound the sample.
    """
    known = cut(labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
                .where(F.col("id").isNotNull() & F.col("y").isin(0, 1)).where(~held_out(F.col("id")))
                .groupBy("id").agg(F.min("y").alias("y")))
    cells, n = 1 << 30, max(1, known.count())
    share = int(min(1.0, rows / n) * cells)
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(cells)) < share)  # rows of them, give or take a root
    got = (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t"))
           .where("t IS NOT NULL").join(F.broadcast(picked), "id")
           .groupBy("id", "y").agg(F.min(F.struct(F.md5("t").alias("d"), drawn_part(F.col("t"), chars).alias("t"))).alias("x"))
           .select("id", "y", "x.t").collect())
    got.sort(key=lambda r: r["id"])
    return [r["t"] for r in got], [r["y"] for r in got]


def score_quality(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Only the text is scored, all of it. Null and empty texts get the score of
    the empty text; a null id counts as held out. One row per input row; other
    columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand numbers

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        net = shared.value
        return pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"),
                             "score": [net.score(as_text(t)) for t in frame["text"]]})

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = map_rows(cols, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
