"""Operator 7: quality rules by repetition coverage.

For several word n-gram lengths a rolling polynomial hash runs over the word
ids of a text in numpy; the share of characters that lie inside n-grams found
more than once is the coverage of that length. The same is measured for lines.
A document fails when the coverage of a length passes its limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubsearch.llm.common import as_text, map_rows, mix64

# n-gram length -> largest share of word characters inside repeated n-grams.
COVERAGE_LIMITS = {2: 0.9, 4: 0.6, 6: 0.5, 10: 0.4}
LINE_LIMIT = 0.5           # share of word characters in lines seen before
SYMBOL_LIMIT = 0.1         # symbols per word
MIN_WORDS = 50
REPEAT_PERCENT = 50        # of words inside repeated 3-word windows
SYMBOLS = "#*$%&|<>"       # fixed
CHARS_TOGETHER = 1 << 20   # of short texts that are measured in one go
_BLANKS = " \t\x0b\x0c\r"  # fixed: white space inside a line
_SYMBOL_BYTE = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_BLANK_BYTE = np.isin(np.arange(256), [ord(c) for c in _BLANKS + "\n"])

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, "
    + ", ".join(f"coverage_{n} double" for n in COVERAGE_LIMITS)
)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> list[np.uint64]:
    out, p, mask = [], 1, (1 << 64) - 1
    for _ in range(n):
        out.append(np.uint64(p))
        p = p * int(_BASE) & mask
    return out


_POWERS = _powers(64)


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every window of ``n`` word ids (empty if there is none).

    Ids are mixed to 64 random-looking bits first, so that the polynomial in
    the fixed odd base has no structure left to collide on.
    """
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    values = mix64(ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += values[k: k + m] * _POWERS[n - 1 - k]
    return mix64(out)


def repeated_mask(ids: np.ndarray, n: int, text: np.ndarray | None = None) -> np.ndarray:
    """Which words lie in an n-word window that occurs twice or more in the text.

    ``text`` numbers the text of each word where ``ids`` holds several texts, one
    after the other; a window lies in one text, and counts within it.
    """
    text = np.zeros(len(ids), np.int64) if text is None else text
    hashes = window_hashes(ids, n)
    starts = np.flatnonzero(text[: len(hashes)] == text[n - 1:]) if len(hashes) else np.empty(0, np.int64)
    covered = np.zeros(len(ids) + 1, np.int32)
    if len(starts) > 1:
        hashes, of = hashes[starts] ^ mix64(text[starts].astype(np.uint64) + np.uint64(1)), text[starts]
        order = np.argsort(hashes, kind="stable")
        same = (hashes[order[1:]] == hashes[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
        twice = np.zeros(len(starts), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        # starts are distinct, and so are their ends
        covered[starts[twice]] += 1
        covered[starts[twice] + n] -= 1
    return np.cumsum(covered[:-1]) > 0


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word that are equal to an earlier one, and their word characters."""
    seen: set[str] = set()
    lines = chars = 0
    for line in text.split("\n"):
        if line in seen:
            lines += 1
            chars += len(line) - sum(map(line.count, _BLANKS))
        elif line.strip(_BLANKS):
            seen.add(line)
    return lines, chars


def measure(text: str) -> dict:
    """All figures of one text."""
    return measure_all([text]).iloc[0].to_dict()


def measure_all(texts: list[str]) -> pd.DataFrame:
    """All figures of some texts. The empty text has zero words and fails."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join([*parts, b""])
    raw = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])           # of the texts, in bytes
    blank = _BLANK_BYTE[raw]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    after = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1     # joined ends in a blank
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before a byte
    lengths = before[after] - before[first]
    words = joined.split()  # bytes split at just the ASCII white space
    ids = pd.factorize(np.array(words, dtype=object))[0] if words else np.empty(0, np.int64)
    text = np.searchsorted(ends, first, side="right")
    k = len(texts)

    def per_text(weights: np.ndarray) -> np.ndarray:
        return np.bincount(text, weights, k).astype(np.int64)

    n_words, chars, repeat = np.bincount(text, minlength=k), per_text(lengths), per_text(repeated_mask(ids, 3, text))
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL_BYTE[raw])])[ends]
    n_symbols = np.diff(symbols, prepend=0)
    dup_lines, dup_chars = np.array([duplicate_lines(t) for t in texts], np.int64).T
    some = np.maximum(chars, 1)  # without characters every share is 0
    share = {n: per_text(lengths * repeated_mask(ids, n, text)) / some for n in COVERAGE_LIMITS}
    line_share = dup_chars / some
    failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
    good = (line_share <= LINE_LIMIT) & (n_symbols <= SYMBOL_LIMIT * n_words)
    for n, most in COVERAGE_LIMITS.items():
        good &= share[n] <= most
    return pd.DataFrame({
        "n_words": n_words, "word_chars": chars, "n_symbols": n_symbols,
        "n_dup_lines": dup_lines, "n_repeat_words": repeat, "base_failed": failed,
        "kept": ~failed & good, "line_coverage": line_share,
        **{f"coverage_{n}": share[n] for n in COVERAGE_LIMITS},
    })


def together(texts: list[str], chars: int = CHARS_TOGETHER):
    """Runs of neighbouring texts of about ``chars`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def repetition_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Figures and verdict of every row; no shuffle.

    One output row per input row, repeated rows and null ids included. A null
    text counts as empty; texts of under ``MIN_WORDS`` words fail. Other columns
    of ``docs`` are ignored; an empty table gives an empty one.
    """

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        runs = together([as_text(t) for t in frame["text"]])
        out = pd.concat([measure_all(run) for run in runs], ignore_index=True)
        out.insert(0, "doc_id", frame["doc_id"].astype("Int64"))
        return out

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(cols, score, SCHEMA)
