"""Operator 13: cross-tokenizer alignment by products of sparse incidence matrices.

Two tokenizers cut the same bytes: A a byte-level BPE (``bytebpe``), B a
SentencePiece model, whose space mark stands for a space. For a run of texts,
A and B are incidence matrices with a row for each token and a column for each
byte, in CSR form built by hand (row pointers and column numbers; the entries
are all one). Bytes where a token of A and one of B both end cut the tokens
into groups, which gives two more matrices, tokens by groups.

* A . B' by Gustavson's row products: for each entry of a row of A the row of
  B' in that column is added; equal neighbours are summed. The entries are the
  pairs of tokens that overlap, with the number of bytes they share.
* GA . GB', the same product over groups: the pairs of tokens that share a group.

Neither tokenizer has a token that holds a space after a character that is no
white space, so a space there ends a token of both and no group crosses it.
Texts are cut at such spaces into units, the matrices of the units that a batch
meets for the first time are multiplied together, and a unit's result (ids,
groups, links) is remembered in a table of bounded size.

Corpus counts: the number of documents that hold an id pair linked. A document
gives each of its pairs once; the pairs are counted with partial aggregation
and joined back to the documents' pairs (broadcast up to MAX_BROADCAST_PAIRS,
else shuffled by pair, where adaptive execution splits hot ones).
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubsearch.llm import bytebpe
from scrubsearch.llm.common import store, worker_model
from scrubsearch.llm.spiece import MODEL_FILE, SPACE, Remembered, read_model

BYTE_BPE_FILE = "/opt/tokenizers/byte_bpe_50k.json"
CACHE_UNITS = 150_000          # of a generation; two are kept
CACHE_UNIT_CHARS = 64
MAX_BROADCAST_PAIRS = 1_000_000
_CUT = re.compile(r"(?<=\S) ")
_CROWDED = re.compile(r"\s ")


# --- incidence matrices -----------------------------------------------------

def rows_csr(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by bytes: the row of a token holds the ``lengths`` bytes after those of the token before."""
    ptr = np.concatenate([[0], np.cumsum(lengths)])
    return ptr, np.arange(ptr[-1])


def transpose_csr(ptr: np.ndarray, cols: np.ndarray, n_cols: int) -> tuple[np.ndarray, np.ndarray]:
    """The transposed matrix: entries dealt to their columns, rows ascending."""
    rows = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    return np.concatenate([[0], np.cumsum(np.bincount(cols, minlength=n_cols))]), rows[np.argsort(cols, kind="stable")]


def row_products(a_ptr: np.ndarray, a_cols: np.ndarray, b_ptr: np.ndarray, b_cols: np.ndarray, width: int):
    """Gustavson: row i of the product is the sum of the rows of the right matrix that row i names.

    Returns (row, column, sum) of the entries, by row and column. ``width`` is
    the number of columns of the right matrix."""
    counts = np.diff(b_ptr)[a_cols]                      # entries that each named row adds
    rows = np.repeat(np.repeat(np.arange(len(a_ptr) - 1), np.diff(a_ptr)), counts)
    first = np.cumsum(counts) - counts
    cols = b_cols[np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(b_ptr[a_cols], counts)]
    key = rows * max(width, 1) + cols
    if len(key) and not (key[1:] >= key[:-1]).all():
        key = np.sort(key)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    sums = np.diff(np.concatenate([starts, [len(key)]]))
    return key[starts] // max(width, 1), key[starts] % max(width, 1), sums


def group_numbers(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of every token of A and of B, and the number of groups."""
    a_end, b_end = np.cumsum(a_lengths), np.cumsum(b_lengths)
    both = a_end[np.isin(a_end, b_end, assume_unique=True)]
    return np.searchsorted(both, a_end), np.searchsorted(both, b_end), len(both)


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray):
    """(token of A, token of B, shared bytes) of all tokens that overlap: A . B'."""
    a_ptr, a_cols = rows_csr(a_lengths)
    b_ptr, b_cols = rows_csr(b_lengths)
    return row_products(a_ptr, a_cols, *transpose_csr(b_ptr, b_cols, int(b_ptr[-1])), len(b_lengths))


def group_links(a_group: np.ndarray, b_group: np.ndarray, n_groups: int):
    """(token of A, token of B) of all tokens that share a group: GA . GB'."""
    right = transpose_csr(np.arange(len(b_group) + 1), b_group, n_groups)
    a, b, _ = row_products(np.arange(len(a_group) + 1), a_group, *right, len(b_group))
    return a, b


# --- tokenizers -------------------------------------------------------------

def byte_of_letter() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_byte_bpe(content: bytes) -> list[bytes]:
    """The bytes of each id of a byte-level BPE in JSON.

    The ids must be in the order of the merges, so that an id is a rank; special
    tokens are left out."""
    import json

    spec = json.loads(content)
    letters = byte_of_letter()
    special = {t["id"] for t in spec["added_tokens"]}
    vocab = {k: bytes(letters[c] for c in t) for t, k in spec["model"]["vocab"].items() if k not in special}
    tokens = [vocab[k] for k in range(len(vocab))]
    made = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [bytes(letters[c] for c in a + b) for a, b in made]
    if made != tokens[len(tokens) - len(made):]:
        raise ValueError("ids must follow the order of the merges")
    return tokens


class Aligner:
    """Two tokenizers, and the units whose alignment is known."""

    def __init__(self, a_content: bytes, b_model: bytes):
        import sentencepiece

        self.a = bytebpe.Ranks(read_byte_bpe(a_content))
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
        self.b_raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(k) else p.replace(SPACE, " ").encode()
                      for k, p in enumerate(pieces)]
        self.mark = sp.piece_to_id(SPACE)
        if any(SPACE in p.lstrip(SPACE) for k, p in enumerate(pieces) if not (sp.is_control(k) or sp.is_unknown(k))):
            raise ValueError("a piece has the space mark inside; texts can't be cut into units")
        self.a_size = np.array(self.a.size)
        self.b_size = np.array([len(r) for r in self.b_raw])
        # an id and the sign after it: A before one of its side, A before B, B before its side, B at a group's end
        self.spell = [f"{k}{sign}" for n, signs in ((len(self.a.raw), ",|"), (len(pieces), ",;")) for sign in signs for k in range(n)]
        self.units = Remembered(CACHE_UNITS)

    def pack(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for an id of A and one of B."""
        return a * np.int64(len(self.b_raw)) + b

    def learn(self, units: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, groups, links) of each unit after a space; None where the bytes differ."""
        spelled = [(" " + u).encode() for u in units]
        a, a_count = self.a.encode_all([" " + u for u in units])
        b_ids = [ids if u else [self.mark] for u, ids in zip(units, self.sp.encode(units, num_threads=1))]
        b_count = np.array([len(ids) for ids in b_ids], np.int64)
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(b_count.sum()))
        whole = b"".join(spelled)
        if self.a.decode(a.tolist()) == whole == b"".join(map(self.b_raw.__getitem__, b.tolist())):
            kept = list(range(len(units)))
        else:
            a_ids = np.split(a, np.cumsum(a_count)[:-1])
            kept = [k for k, want in enumerate(spelled) if self.a.decode(a_ids[k].tolist()) == want
                    and b"".join([self.b_raw[i] for i in b_ids[k]]) == want]
            a = np.concatenate([np.empty(0, np.int64), *[a_ids[k] for k in kept]])
            b = np.array([i for k in kept for i in b_ids[k]], np.int64)
            a_count, b_count = a_count[kept], b_count[kept]
        out: list[tuple | None] = [None] * len(units)
        if not kept:
            return out
        # one pair of matrices for all of them; every unit ends a group
        a_group, b_group, n = group_numbers(self.a_size[a], self.b_size[b])
        row, col = group_links(a_group, b_group, n)
        links = self.pack(a[row], b[col])
        a_cut, b_cut = (np.searchsorted(g, np.arange(n + 1)) for g in (a_group, b_group))
        # in the order of the groups text each token stands with the sign that follows it
        order = np.empty(len(a) + len(b), np.int64)
        n_a, n_b = len(self.a.raw), len(self.b_raw)
        order[np.arange(len(a)) + b_cut[a_group]] = a + n_a * (np.arange(1, len(a) + 1) == a_cut[a_group + 1])
        order[np.arange(len(b)) + a_cut[b_group + 1]] = 2 * n_a + b + n_b * (np.arange(1, len(b) + 1) == b_cut[b_group + 1])
        parts = list(map(self.spell.__getitem__, order.tolist()))
        a_ends, b_ends = np.cumsum(a_count), np.cumsum(b_count)
        group_ends = a_group[a_ends - 1] + 1
        link_ends = np.searchsorted(row, a_ends).tolist()
        p0 = l0 = 0
        for k, i, j, g, p1, l1 in zip(kept, a_count.tolist(), b_count.tolist(), np.diff(group_ends, prepend=0).tolist(),
                                      (a_ends + b_ends).tolist(), link_ends):
            out[k] = (i, j, g, "".join(parts[p0:p1])[:-1], links[l0:l1].tobytes())
            p0, l0 = p1, l1
        return out

    def align(self, texts: list[str]) -> list[list[tuple] | None]:
        """The units' results of each text; None for an empty text or one whose bytes differ."""
        cache = self.units
        cuts = [units_of(t) if t else [] for t in texts]
        known: dict[str, tuple | bool] = {}
        for units in cuts:
            for u in units:
                if u not in known:
                    known[u] = cache.get(u)
        new = [u for u, v in known.items() if v is None]
        for lo in range(0, len(new), 4096):
            part = new[lo:lo + 4096]
            for u, v in zip(part, self.learn(part)):
                known[u] = v = v or False
                if len(u) <= CACHE_UNIT_CHARS:
                    cache.put(u, v)
        out: list[list[tuple] | None] = []
        for units in cuts:
            found = list(map(known.__getitem__, units))
            out.append(found if found and all(found) else None)
        return out


def units_of(text: str) -> list[str]:
    """A text cut at each space after a character that is no white space."""
    if "  " not in text and not _CROWDED.search(text) and not text.startswith(" "):
        return text.split(" ")
    return _CUT.split(text)


def loaded(a_content: bytes, b_model: bytes) -> Aligner:
    """The aligner of this worker process, built once."""
    return worker_model(__name__, hash((a_content, b_model)), lambda: Aligner(a_content, b_model))


# --- documents --------------------------------------------------------------

def align_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str = BYTE_BPE_FILE,
                    b_path: str = MODEL_FILE, groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs and times of every row.

    ``groups``: ``a1,a2|b1;a3|b2,b3``, the ids in order. ``pairs``: its distinct
    linked id pairs, packed as a * (number of B ids) + b, ascending; ``times``
    how often each is linked. One row per input row, repeated rows and null ids
    included. A null or empty text, and one whose tokens don't spell its bytes,
    has no tokens: zeros, an empty text and empty arrays. With groups=False the
    column holds sha256 of the groups instead (still '' without tokens).

    A batch of texts is read whole; memory is some tens of bytes per character.
    """
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast((read_model(spark, a_path), read_model(spark, b_path)))

    def run(batches):
        import hashlib

        aligner = loaded(*models.value)
        for batch in batches:
            figures, spelled, pairs, times = [], [], [], []
            for units in aligner.align(bytebpe.texts_of(batch["text"])):
                if units is None:
                    figures.append((0, 0, 0, 0))
                    spelled.append("")
                    pairs.append(np.empty(0, np.int64))
                    times.append(np.empty(0, np.int64))
                    continue
                n_a, n_b, n_groups, words, links = zip(*units)
                links = np.frombuffer(b"".join(links), np.int64)
                pair, count = np.unique(links, return_counts=True)
                figures.append((sum(n_a), sum(n_b), sum(n_groups), len(links)))
                whole = ";".join(words)
                spelled.append(whole if groups else hashlib.sha256(whole.encode()).hexdigest())
                pairs.append(pair)
                times.append(count)
            ends = np.cumsum([0, *map(len, pairs)], dtype=np.int32)
            cols = [batch["doc_id"], *(pa.array(c, pa.int64()) for c in zip(*figures)), pa.array(spelled, pa.string()),
                    pa.ListArray.from_arrays(ends, np.concatenate(pairs)),
                    pa.ListArray.from_arrays(ends, np.concatenate(times).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups",
                                                          "pairs", "times"])

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
                                "pairs array<long>, times array<int>")


def count_links(aligned: DataFrame, n_b_ids: int) -> DataFrame:
    """(pair, documents, best) of every linked id pair of the table.

    documents: how many rows hold the pair linked; best: whether no other pair of
    the same A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    counts, _ = store(counts)
    a_id = F.expr(f"pair div {n_b_ids}")
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("documents").alias("most"))
    return (counts.withColumn("a_id", a_id).join(most, "a_id")
            .select("pair", "documents", (F.col("documents") == F.col("most")).alias("best")))


def alignment_report(docs: DataFrame, a_path: str = BYTE_BPE_FILE, b_path: str = MODEL_FILE) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The rows' links are written once, compressed, and read twice: for the corpus
    counts and to look them up. A row's pairs are summed by its position in the
    written table, so repeated ids stay apart."""
    import sentencepiece

    spark = docs.sparkSession
    n_b_ids = sentencepiece.SentencePieceProcessor(model_proto=read_model(spark, b_path)).get_piece_size()
    aligned, _ = store(align_documents(docs, a_path=a_path, b_path=b_path, groups=False)
                       .withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    counts, _ = store(count_links(aligned, n_b_ids))
    if counts.count() <= MAX_BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    sums = (links.join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("documents")).alias("count_sum")))
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), F.col("groups").alias("groups_sha256"))
