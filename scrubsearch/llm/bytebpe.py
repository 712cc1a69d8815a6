"""Operator 11: byte-level BPE encoding and decoding by backtracking.

A text is split by the tokenizer's pattern and each match is encoded alone. Its
UTF-8 bytes are written as Latin-1 characters, so that one character is one
byte, and the vocabulary's trie (pyahocorasick) tells how far the bytes from a
position follow a token; the longest token among them is the first choice.

A sequence of tokens is what merging by rank gives if and only if each token
alone merges to itself and each two neighbours, merged together, stay these
two. The encoder walks left to right with the longest token that starts here;
if it may not follow the last one, the next shorter token is tried, and if none
is left the last token is taken back and the position is closed. Merging has
one result for each prefix, so a closed position need never be entered again:
every position closes at most once and the walk is linear.

Whether two tokens may be neighbours is found without merging their bytes: only
the right edge of the left token and the left edge of the right one can meet,
and their parts are built in order of rank. The answers are remembered, and so
are the ids of matches seen before, both in tables of bounded size. A text is
worked through in runs of matches; memory is a few bytes per character of it.
"""

from __future__ import annotations

import base64
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubsearch.llm.common import worker_model
from scrubsearch.llm.spiece import Remembered, read_model

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 100_000      # of a generation; two are kept
CACHE_PAIRS = 150_000
CACHE_WORD_CHARS = 64
RUN_MATCHES = 65_536       # matches of a text that are worked on together
NEVER = 1 << 62


def read_ranks(content: bytes) -> list[bytes]:
    """The bytes of each id of a rank file (a base64 token and its rank on each line)."""
    ranks = {int(n): base64.b64decode(t) for t, n in (line.split() for line in content.splitlines() if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[k] for k in range(len(ranks))]


class Ranks:
    """A byte-level vocabulary: an id is also the rank of the merge that makes it."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.raw = tokens
        self.split = regex.compile(pattern)
        self.rank = {t: k for k, t in enumerate(tokens)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary needs every single byte")
        self.size = [len(t) for t in tokens]
        self.whole = {t.decode("latin-1"): k for k, t in enumerate(tokens)}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, bool], list[int]] = {}
        self.pairs = Remembered(CACHE_PAIRS)   # left * vocabulary + right -> whether they may be neighbours
        self.words = Remembered(CACHE_WORDS)   # match of the pattern -> its ids as int32 bytes
        self.shorter = [self._prefix(t) for t in tokens]
        self.reach = max(self.size)
        self.trie = ahocorasick.Automaton()
        self.longest = dict(self.whole)  # each beginning of a token -> the longest token that it begins with
        for t, k in self.whole.items():
            self.trie.add_word(t, k)
            for n in range(self.size[self.shorter[k]] + 1, len(t)):
                self.longest[t[:n]] = self.shorter[k]

    def _prefix(self, token: bytes) -> int:
        """The longest other token that ``token`` begins with; -1 for a single byte."""
        for n in range(len(token) - 1, 0, -1):
            k = self.rank.get(token[:n])
            if k is not None:
                return k
        return -1

    def merge(self, data: bytes, below: int = NEVER) -> list[bytes]:
        """Plain merging of a short string by ranks under ``below``: lowest first, then leftmost."""
        parts = [data[k:k + 1] for k in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low >= below or low == NEVER:
                break
            at = ranks.index(low)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte or a token no merge makes."""
        if token not in self.halves:
            parts = self.merge(self.raw[token], token) if self.size[token] > 1 else []
            self.halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def edge(self, token: int, right: bool) -> list[int]:
        """The tokens along the right or left edge of ``token``, from its byte up; [] if no merge makes it."""
        key = (token, right)
        if key not in self.edges:
            at, chain = token, [token]
            while self.size[at] > 1:
                halves = self.parts(at)
                if halves is None:
                    chain = []
                    break
                at = halves[1 if right else 0]
                chain.append(at)
            self.edges[key] = chain[::-1]
        return self.edges[key]

    def allowed(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: the start), remembered."""
        key = left * len(self.raw) + right
        known = self.pairs.get(key)
        if known is None:
            known = self._meet(left, right)
            self.pairs.put(key, known)
        return known

    def _meet(self, left: int, right: int) -> bool:
        near = self.edge(right, False)
        if left < 0:
            return bool(near)
        far = self.edge(left, True)
        if not far or not near:
            return False
        i = j = 0
        while True:
            grown_left = far[i + 1] if i + 1 < len(far) else NEVER
            grown_right = near[j + 1] if j + 1 < len(near) else NEVER
            across = self.rank.get(self.raw[far[i]] + self.raw[near[j]], NEVER)
            # equal ranks: the leftmost merge goes first
            if across < grown_left and across <= grown_right and across < NEVER:
                return False
            if grown_left == grown_right == NEVER:
                return True
            if grown_left <= grown_right:
                i += 1
            else:
                j += 1

    def walk(self, word: str) -> list[int]:
        """Ids of one match, given as Latin-1 characters."""
        known = self.whole.get(word)
        if known is not None:
            return [known]
        n, size, shorter, pairs, total = len(word), self.size, self.shorter, self.pairs, len(self.raw)
        longest, follows, reach = self.longest, self.trie.longest_prefix, self.reach
        token = longest[word[:follows(word)]]  # the longest one that starts here
        closed, out, at, last = bytearray(n + 1), [], 0, -1
        while True:
            end = at + size[token]
            if not closed[end]:
                known = pairs.young.get(last * total + token)
                if known or (known is None and self.allowed(last, token)):
                    out.append(token)
                    if end == n:
                        return out
                    ahead = word[end:end + reach]
                    at, last, token = end, token, longest[ahead[:follows(ahead)]]
                    continue
            token = shorter[token]
            if token < 0:  # nothing may start here: take the last token back
                closed[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                # its own end is closed now, so the next shorter one is tried

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, in runs of RUN_MATCHES matches."""
        if len(text) < RUN_MATCHES:
            return np.frombuffer(self._run(self.split.findall(text)), np.int32)
        matches, out = (m.group() for m in self.split.finditer(text)), []
        while run := list(islice(matches, RUN_MATCHES)):
            out.append(self._run(run))
        return np.frombuffer(b"".join(out), np.int32)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many short texts, one after another, and how many each has."""
        words = list(map(self.split.findall, texts))
        parts = self._parts([w for x in words for w in x])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        ends = np.cumsum([0, *map(len, words)])
        counts = np.concatenate([[0], np.cumsum(sizes)])[ends]
        return np.frombuffer(b"".join(parts), np.int32).astype(np.int64), np.diff(counts)

    def _run(self, words: list[str]) -> bytes:
        return b"".join(self._parts(words))

    def _parts(self, words: list[str]) -> list[bytes]:
        cache = self.words
        out = list(map(cache.young.get, words))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            word = words[k]
            ids = cache.get(word)
            if ids is None:
                spelled = word if word.isascii() else word.encode().decode("latin-1")
                ids = array("i", self.walk(spelled)).tobytes()
                if len(word) <= CACHE_WORD_CHARS:
                    cache.put(word, ids)
            out[k] = ids
        return out

    def decode(self, ids) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.raw.__getitem__, ids))


def loaded(content: bytes) -> Ranks:
    """The vocabulary of this worker process, built once."""
    return worker_model(__name__, hash(content), lambda: Ranks(read_ranks(content)))


def texts_of(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     rank_path: str = RANK_FILE, decoded: bool = False) -> DataFrame:
    """doc_id and ids of every row; with ``decoded`` also the bytes the ids decode to.

    One row per input row, repeated rows and null ids included. A null or empty
    text has no ids. No special tokens: their strings in a text are plain text.
    Other columns of ``docs`` are ignored. The rank file (under 1 MB here) is
    broadcast; there is no shuffle.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, rank_path))

    def run(batches):
        ranks = loaded(model.value)
        for batch in batches:
            ids = [ranks.encode(t) for t in texts_of(batch["text"])]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            cols = [batch["doc_id"], pa.LargeListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *ids]))
                    .cast(pa.list_(pa.int32()))]
            if decoded:
                cols.append(pa.array([ranks.decode(i.tolist()) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "decoded"][:len(cols)])

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return cols.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode_documents(encoded: DataFrame, ids: str = "ids", to: str = "decoded",
                     rank_path: str = RANK_FILE) -> DataFrame:
    """``encoded`` with the bytes of each row's ids as column ``to`` (null ids: no bytes).

    An id outside the vocabulary is an error.
    """
    spark = encoded.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, rank_path))

    @F.pandas_udf("binary")
    def back(col):
        ranks = loaded(model.value)
        return col.map(lambda i: ranks.decode([] if i is None else i.tolist()))

    return encoded.withColumn(to, back(F.col(ids)))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded and decoded rows."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
