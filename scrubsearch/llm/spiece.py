"""Operator 9: SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is a BPE one. Its merges give every prefix of a text exactly one
segmentation, and a segmentation is the right one if and only if each pair of
neighbours is: merging the two alone must give the same two pieces. So the best
path is found left to right: the last piece of the prefix that ends at position
i is the one vocabulary piece ending there whose predecessor is the last piece
of the shorter prefix and pairs with it. Scores are thus 0 for allowed steps
and minus infinity for others; one path survives at each position.

Only the last ``longest piece`` positions can be a predecessor. Each position
in that window keeps its back pointer; when the paths from all of them pass
through one boundary, the pieces up to it are final: their ids are committed
and the boundary becomes the window's start. Memory is bounded by the window,
whatever the length of the text.

A character outside the vocabulary is a piece of its own, written as its UTF-8
bytes. No piece has the space mark after another character, so paths always
meet at the start of a word. They also meet between two characters that stand
side by side in no piece, as most letters and full stops do. A text is cut at
such places; what lies between is encoded once and its ids are remembered in a
table of bounded size.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubsearch.llm.common import as_text, map_rows, worker_model

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE_WORDS = 120_000      # of a generation; two are kept
PAIR_SLOTS = 786_433       # a prime; 8 bytes each
CACHE_STEPS = 50_000
CACHE_WORD_CHARS = 64
OTHER = -1
NEVER = float("-inf")


class Remembered:
    """A table of bounded size that keeps what is used: two generations of ``limit``."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Pieces:
    """Pieces, scores and byte ids of a SentencePiece BPE model."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)
                                              or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [p.encode() for p in self.text]  # what a piece decodes to
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.longest = max(map(len, self.id))
        self.length = [len(p) for p in self.text]
        self.prefixes = {p[:k] for p in self.id for k in range(len(p) + 1)}
        self.part = self._parts()
        self.forget()
        if any(c not in self.id for p in self.id for c in p):
            raise ValueError("a piece has a character that is no piece")
        if len(self.byte) != 256:
            raise ValueError("the model needs a piece for each byte")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has the space mark inside; words can't be encoded alone")
        self.edges: dict[int, tuple | None] = {}
        self.pairs = array("q", bytes(8 * PAIR_SLOTS))  # a pair's number where the two may be neighbours, else less than 0
        self.words = Remembered(CACHE_WORDS)   # part of a text, marks as spaces -> its ids as int32 bytes

    def _parts(self) -> re.Pattern:
        """What cuts a text, marks as spaces, into parts that no piece reaches out of.

        Characters that stand side by side in a piece are in one class; a part
        is a run of one class with the marks before it."""
        of: dict[str, set[str]] = {}
        for a, b in {(a, b) for p in self.id for a, b in zip(p.lstrip(SPACE), p.lstrip(SPACE)[1:])}:
            one = of.setdefault(a, {a})
            if one is not (other := of.setdefault(b, {b})):
                one |= other
                of.update(dict.fromkeys(other, one))
        classes = {id(c): c for c in of.values()}.values()
        runs = ["[" + "".join(map(re.escape, sorted(c))) + "]++" for c in sorted(classes, key=lambda c: (-len(c), min(c)))]
        return re.compile(" *+(?:" + "|".join([*runs, "[^ ]"]) + ")| ++")

    def forget(self) -> None:
        """Start the states anew; those still in use go on working."""
        self.states: dict[str, list] = {}
        self.steps = 0
        self.begin = self.state("")

    def state(self, tail: str) -> list:
        """The state after ``tail``: where each character leads, and the pieces that end here.

        ``tail`` is the longest end of the text that begins a piece. The pieces
        are (length, id), the longest first. States are made when they are met;
        there are no more than beginnings of pieces.
        """
        if tail not in self.states:
            ends = [(len(tail) - k, self.id[tail[k:]]) for k in range(len(tail)) if tail[k:] in self.id]
            self.states[tail] = [{}, ends, tail]
        return self.states[tail]

    def step(self, state: list, char: str) -> list:
        """The state that ``char`` leads to; up to CACHE_STEPS of them are remembered."""
        tail = state[2] + char
        while tail not in self.prefixes:
            tail = tail[1:]
        if self.steps >= CACHE_STEPS:
            self.forget()
        state[0][char] = after = self.state(tail)
        self.steps += 1
        return after

    def merge(self, text: str, above: float = NEVER) -> list[str]:
        """Greedy merging of a short string by scores over ``above``: the best first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and s > above and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, text: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one, if all merges before it have better scores."""
        parts = self.merge(text, self.score[text])
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def edge(self, piece: int, right: bool) -> tuple | None:
        """The pieces along the right or left edge of ``piece``, from its character up, as (text, score).

        () if merging its characters does not give the piece; None if it does,
        but the scores along the way do not fall."""
        key = 2 * piece + right
        if key not in self.edges:
            at = self.text[piece]
            chain: list | None = [(at, self.score[at])]
            while len(at) > 1:
                half = self.halves(at)
                if half is None:
                    chain = None if self.merge(self.text[piece]) == [self.text[piece]] else []
                    break
                at = half[right]
                chain.append((at, self.score[at]))
            self.edges[key] = None if chain is None else tuple(chain[::-1])
        return self.edges[key]

    def allowed(self, left: int, right: int) -> bool:
        """Whether piece ``right`` may follow piece ``left``, remembered.

        OTHER stands for the start and for a character outside the vocabulary;
        no merge crosses it.
        """
        pair = (left + 2) * len(self.text) + right
        known = self.pairs[pair % PAIR_SLOTS]
        if known != pair and known != -pair:
            known = self.pairs[pair % PAIR_SLOTS] = pair if self._meet(left, right) else -pair
        return known > 0

    def _meet(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters together gives the two pieces.

        Only the right edge of the left one and the left edge of the right one
        can meet; their pieces are made in the order of their scores."""
        near = self.edge(right, False)
        if left == OTHER:
            return near != ()
        far = self.edge(left, True)
        if near is None or far is None:
            pair = [self.text[left], self.text[right]]
            return self.merge(pair[1]) == [pair[1]] and self.merge(pair[0] + pair[1]) == pair
        if not far or not near:
            return False
        i, j, score = 0, 0, self.score
        while True:
            grown_left = far[i + 1][1] if i + 1 < len(far) else NEVER
            grown_right = near[j + 1][1] if j + 1 < len(near) else NEVER
            across = score.get(far[i][0] + near[j][0], NEVER)
            # equal scores: the leftmost merge goes first
            if across > grown_left and across >= grown_right and across > NEVER:
                return False
            if grown_left == grown_right == NEVER:
                return True
            if grown_left >= grown_right:
                i += 1
            else:
                j += 1


def viterbi(text: str, pieces: Pieces, on_commit=None) -> list[int]:
    """Ids of a string, in one left-to-right pass over a bounded window.

    ``on_commit(position, window)`` is called whenever ids become final.
    """
    ids: list[int] = []
    longest, length = pieces.longest, pieces.length
    start, last = 0, [OTHER]  # last[k]: last piece of the prefix that ends at start + k
    state, pairs, n_pieces, size = pieces.begin, pieces.pairs, len(pieces.text), len(text)
    full = 2 * longest  # the end of the window at which paths are followed
    for end, char in enumerate(text, 1):
        state, found = state[0].get(char) or pieces.step(state, char), OTHER
        for n, piece in state[1]:
            at = end - n - start
            if at >= 0:
                left = last[at]
                pair = (left + 2) * n_pieces + piece
                known = pairs[pair % PAIR_SLOTS]
                if known == pair or (known != -pair and pieces.allowed(left, piece)):
                    found = piece
                    break
        last.append(found)
        if end == size or end >= full:
            boundary = end
            if end < size:
                # Follow the paths of all positions that a later piece can start
                # from, until they share one boundary.
                live = set(range(end - longest + 1, end + 1))
                while len(live) > 1:
                    far = max(live)
                    live.remove(far)
                    piece = last[far - start]
                    live.add(far - (1 if piece == OTHER else length[piece]))
                    if min(live) <= start:
                        live = {start}
                boundary = live.pop()
            if boundary > start:
                path, at = [], boundary
                while at > start:
                    piece = last[at - start]
                    if piece == OTHER:
                        at -= 1
                        path += [pieces.byte[b] for b in reversed(text[at].encode())]
                    else:
                        at -= length[piece]
                        path.append(piece)
                ids += path[::-1]
                if on_commit:
                    on_commit(boundary, end - boundary + 1)
                if end == size:
                    break
                last = last[boundary - start:]
                start = boundary
                full = start + 2 * longest
    return ids


def encode(text: str, pieces: Pieces) -> np.ndarray:
    """Ids of a text: a space mark in front, spaces as marks, then ``viterbi`` part by part."""
    if not text:
        return np.empty(0, np.int32)
    cache = pieces.words
    parts = pieces.part.findall(" " + text.replace(SPACE, " "))
    out = list(map(cache.young.get, parts))
    for k in [k for k, ids in enumerate(out) if ids is None]:
        part = parts[k]
        ids = cache.get(part)
        if ids is None:
            ids = array("i", viterbi(part.replace(" ", SPACE), pieces)).tobytes()
            if len(part) <= CACHE_WORD_CHARS:
                cache.put(part, ids)
        out[k] = ids
    return np.frombuffer(b"".join(out), np.int32)


def decode(ids, pieces: Pieces) -> str:
    """The text of ids: pieces joined, bytes as UTF-8, the first space mark off."""
    text = b"".join([pieces.raw[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def read_model(spark, path: str) -> bytes:
    """The model's bytes, from a path of the driver or of any Spark file system."""
    import os

    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def loaded(model: bytes) -> Pieces:
    """The parsed model of this worker process."""
    return worker_model(__name__, hash(model), lambda: Pieces(model))


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     model_path: str = MODEL_FILE, check: bool = False) -> DataFrame:
    """doc_id, n_ids and ids of every row; with ``check`` also whether they decode back.

    One row per input row, repeated rows and null ids included. A null or empty
    text has no ids. The space mark itself decodes to a space; any other text
    decodes to itself. Other columns of ``docs`` are ignored. The model (under
    1 MB here) is broadcast; there is no shuffle.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, model_path))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pieces = loaded(model.value)
        texts = [as_text(t) for t in frame["text"]]
        ids = [encode(t, pieces) for t in texts]
        out = {"doc_id": frame["doc_id"].astype("Int64"), "n_ids": [len(i) for i in ids], "ids": ids}
        if check:
            out["round_trip"] = [decode(i.tolist(), pieces) == t.replace(SPACE, " ")
                                 for i, t in zip(ids, texts, strict=True)]
        return pd.DataFrame(out)

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(cols, run, "doc_id long, n_ids long, ids array<int>" + ", round_trip boolean" * check)


def decode_documents(encoded: DataFrame, ids: str = "ids", text: str = "text",
                     model_path: str = MODEL_FILE) -> DataFrame:
    """``encoded`` plus the decoded text of each row (null ids: empty text)."""
    spark = encoded.sparkSession
    model = spark.sparkContext.broadcast(read_model(spark, model_path))

    @F.pandas_udf("string")
    def back(col: pd.Series) -> pd.Series:
        pieces = loaded(model.value)
        return pd.Series([decode(np.asarray(i).tolist() if i is not None else [], pieces) for i in col])

    return encoded.withColumn(text, back(F.col(ids)))
