"""Operator 3: personal data by candidate gradient boosting.

Exact patterns give the base spans, which always stay. Loose generators propose
more, overlapping spans: numbers and addresses written with other separators or
spelled-out signs. Boosted trees score each candidate by its format and its
context; a threshold per kind, calibrated on held-out candidates, selects what
is redacted besides the base.

Nothing is labelled by hand. Trees learn on the whole texts of all rows: base
spans, and base spans rewritten into the loose forms, are positive; matches that
a check has turned down, base spans with a broken check, and loose candidates
beside no base form are negative. A kind that the table holds too seldom is
filled up with generated values, so every kind is learned and calibrated on a
table of any size.

The examples stay where Spark has them. Cuts are quantiles of the counted values;
examples that fall into the same bins are one row with a number. For a level of
a tree each task adds up its rows' gradients by node, feature and bin; only
these sums, of a fixed size, and the counts by score go to the driver. Up to
BLOCK such rows the driver adds up itself, with the same result.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubsearch.llm.common import as_text, discard, drawn_part, fresh, map_rows, store

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 3_000         # texts around generated values
SAMPLE_CHARS = 4_000        # of each of them
PRECISION = 0.995           # wanted of the added spans, on held-out candidates
KIND_POSITIVES = 400        # of a kind; generated ones fill up to it
HELD_OUT = 0.3              # of the examples calibrate the thresholds
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
UNIT = float(1 << 24)       # gradients are added up as whole numbers of such parts, so their order does not matter
STEPS = 1 << 16             # scores that calibration tells apart
BLOCK = 1 << 16             # examples that are added up at once
CONTEXT = 32

# Fixed patterns. Each begins where the plain pattern's leftmost match does and
# never gives back what it has taken, so the time is linear in the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Java pattern: what a text with any candidate holds at least.
_SIGNS = r"(?i)[0-9@]|[(\[{]at[)\]}]| at "

# Loose generators.
_LOOSE_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(at\)|\[at\]|\{at\}|@) ?| at )[A-Za-z0-9-]{1,63}"
    r"(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?| dot )[A-Za-z0-9-]{1,63}){1,5}", re.I)
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.| ?\[\.\] ?| ?\(\.\) ?| dot )[0-9]{1,3}){3}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z.+])(?:00|\(0?|0)?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){2,5}(?![0-9A-Za-z])")
# What stands between the two sides of a loose address, but for a space around it.
_SPELLED = ("(at)", "[at]", "{at}", "@", " at ")
_AT = re.compile(r"\(at\)|\[at\]|\{at\}|@|(?<= )at(?= )", re.I)
_LOOSE_LOCAL = _LOCAL_CHARS | frozenset("\u0130\u0131\u017f\u212a")  # letters too where case is ignored
# The positive forms of ``_rewritten``.
_FORMS = {
    "email": re.compile(r"[^ @]+(?:(?: at | ?\[at\] ?| ?\(at\) ?| ?\{at\} ?)[a-z0-9-]+"
                        r"(?:(?: dot | ?\[dot\] ?| ?\(dot\) ?| ?\{dot\} ?)[a-z0-9-]+)+|\(at\)[a-z0-9-]+(?:\.[a-z0-9-]+)+"
                        r"| @ [a-z0-9-]+(?:\.[a-z0-9-]+)+)", re.I),
    "ip": re.compile(r"[0-9]+(?:\[\.\][0-9]+){3}"),
    "card": re.compile(r"[0-9]{4}([./_]|  )[0-9]{4}(?:\1[0-9]{4})*(?:\1[0-9]{1,4})?"),
    "phone": re.compile(r"0[0-9].*", re.DOTALL),
}
HINTS = (("mail", "contact", "write"), ("ip", "host", "server", "addr"), ("card", "visa", "pay", "iban"),
         ("phone", "tel", "call", "fax", "mobil"), ("id", "no", "nr", "version", "isbn", "order", "date", "="))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if m and start < at:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def _checked(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in found.split("."))
    digits = "".join(_DIGIT.findall(found))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The base spans of each kind, and the matches that failed their check."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    failed: list[tuple[str, int, int]] = []
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            for m in pattern.finditer(text):
                if _checked(kind, m[0]):
                    found[kind].append(m.span())
                else:
                    failed.append((kind, *m.span()))
    return found, failed


def _loose_emails(text: str) -> list[tuple[int, int]]:
    """What ``_LOOSE_EMAIL`` finds, looked for only at its signs."""
    out: list[tuple[int, int]] = []
    low = text.lower()
    if not any(s in low for s in _SPELLED):
        return out
    done = 0
    for sign in _AT.finditer(text):
        spaced = sign.start() - (text[sign.start() - 1: sign.start()] == " ")
        start = spaced
        while start > max(done, spaced - 64) and text[start - 1] in _LOOSE_LOCAL:
            start -= 1
        m = _LOOSE_EMAIL.match(text, start) if start < spaced else None
        if m:
            out.append(m.span())
            done = m.end()
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the loose generators; they may overlap each other and the base."""
    out = []
    out += [("email", *span) for span in _loose_emails(text)]
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _LOOSE_IP), ("card", _LOOSE_CARD), ("phone", _LOOSE_PHONE)):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


N_FEATURES = 23 + len(HINTS)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    digits = "".join(_DIGIT.findall(s))
    groups = re.findall(r"[0-9]+", s)
    parts = [len(g) for g in groups] or [0]
    before, after = text[max(0, start - CONTEXT): start].lower(), text[end: end + 1]
    near = f" {before[-16:]}"
    ip_like = len(groups) == 4 and all(len(g) < 4 and int(g) <= 255 for g in groups)
    return [
        KINDS.index(kind), len(s), len(digits), sum(c.isalpha() for c in s), len(groups), max(parts), min(parts),
        len(set(parts)), sum(c == " " for c in s), sum(c == "." for c in s), sum(c == "-" for c in s),
        sum(c in "()[]{}" for c in s), float(s[:1] == "+" or s[:2] == "00"), float("@" in s),
        float(luhn(digits)) if digits else 0.0, float(13 <= len(digits) <= 19), float(9 <= len(digits) <= 15),
        float(ip_like), float(digits[:1] or -1), len(set(digits)),
        float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in "\"'=#$/"),
        *[float(any(w in near for w in words)) for words in HINTS],
    ]


# --- boosted trees -----------------------------------------------------------

@dataclass
class Boosted:
    """Depth-DEPTH trees on features cut at quantiles, for logistic loss."""
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]   # feature, cut, leaf value
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


# Examples in bins (rows x features), their labels, kinds and how often each comes.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The node, ``depth`` steps down, that each row comes to; ``cut`` are bins."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
    return node - (2**depth - 1)


def _margins(bins: np.ndarray, trees: list, prior: float) -> np.ndarray:
    z = np.full(len(bins), prior)
    for feature, cut, leaf in trees:
        z += leaf[_leaves(bins, feature, cut)]
    return z


def _gradients(block: Block, trees: list, prior: float, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """(2, nodes of the depth, features, BINS): first and second derivatives, in UNITs."""
    bins, y, _, n = block
    p = 1 / (1 + np.exp(-_margins(bins, trees, prior)))
    sides = [np.rint((y - p) * UNIT) * n, np.rint((p * (1 - p) + 1e-6) * UNIT) * n]
    width = bins.shape[1] * BINS
    cell = (_leaves(bins, feature, cut, depth) * width)[:, None] + np.arange(bins.shape[1]) * BINS + bins
    out = [np.bincount(cell.ravel(), np.repeat(side, bins.shape[1]), 2**depth * width) for side in sides]
    return np.stack(out).reshape(2, 2**depth, -1, BINS).astype(np.int64)


def boost(cuts: list[np.ndarray], share: float, sums: Callable[..., np.ndarray]) -> tuple[Boosted, list]:
    """Trees, on values and on bins. ``share``: of positive examples; ``sums``: ``_gradients`` of all examples."""
    both = 0 < share < 1
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    model, binned = Boosted([], prior), []
    inner = 2**DEPTH - 1
    for _ in range(TREES if both else 0):
        # without a better cut all rows go left
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(inner + 1)
        for depth in range(DEPTH):
            found = sums(binned, prior, feature, cut, depth) / UNIT
            for at in range(2**depth):
                g, h = found[:, at]
                gs, hs = g.cumsum(axis=1), h.cumsum(axis=1)
                best, all_g, all_h = 1e-9, gs[0, -1], hs[0, -1]
                k = 2**depth - 1 + at
                sides = [(all_g, all_h), (0.0, 0.0)]
                for f, c in enumerate(cuts):
                    left_g, left_h = gs[f, :len(c)], hs[f, :len(c)]
                    gain = (left_g**2 / (left_h + 1) + (all_g - left_g)**2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1))
                    if len(gain) and gain.max() > best + 1e-9:
                        best, feature[k], cut[k] = gain.max(), f, gain.argmax()
                        sides = [(left_g[cut[k]], left_h[cut[k]]), (all_g - left_g[cut[k]], all_h - left_h[cut[k]])]
                if depth == DEPTH - 1:
                    leaf[2 * at: 2 * at + 2] = [RATE * a / (b + 1) for a, b in sides]
        binned.append((feature, cut, leaf))
        model.trees.append((feature, np.array([cuts[f][c] if c < BINS else np.inf for f, c in zip(feature, cut)]), leaf))
    return model, binned


def _scores(block: Block, trees: list, prior: float) -> np.ndarray:
    """(kinds, STEPS, 2): negative and positive examples of each kind at each step of the score."""
    bins, y, kind, n = block
    step = np.minimum(STEPS / (1 + np.exp(-_margins(bins, trees, prior))), STEPS - 1).astype(np.int64)
    cell = (kind.astype(np.int64) * STEPS + step) * 2 + y
    return np.bincount(cell, n, len(KINDS) * STEPS * 2).astype(np.int64).reshape(len(KINDS), STEPS, 2)


def _threshold(counts: np.ndarray) -> float:
    """The least score from which on PRECISION of a kind's held-out examples are positive.

    Where there is none, only what scores above every held-out example."""
    at = np.flatnonzero(counts.sum(axis=1))[::-1]
    good, all_of = counts[at, 1].cumsum(), counts[at].sum(axis=1).cumsum()
    fine = at[good >= PRECISION * all_of]
    return max(0.5, float(fine[-1] if len(fine) else at[0] + 1 if len(at) else 2 * STEPS) / STEPS)


# --- training ----------------------------------------------------------------

def _rewritten(kind: str, s: str, rng: random.Random) -> list[tuple[str, float]]:
    """Loose forms of a base span with label 1, and broken ones with label 0."""
    digits = "".join(_DIGIT.findall(s))
    if kind == "email":
        user, _, domain = s.partition("@")
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", ".")])
        words = rng.choice([" at the ", " at "])
        return [(user + at + domain.replace(".", dot), 1.0), (user + words.replace("the ", "") + domain.replace(".", ". "), 0.0)]
    if kind == "ip":
        a, b, c, d = s.split(".")
        return [(f"{a}[.]{b}[.]{c}[.]{d}", 1.0), (f"{a}.{b}.{300 + int(c)}.{d}", 0.0)]
    if kind == "card":
        sep = rng.choice([".", "/", "_", "  "])
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        cut = lambda d: sep.join(d[k: k + 4] for k in range(0, len(d), 4))
        return [(cut(digits), 1.0), (cut(wrong), 0.0), (wrong, 0.0)]
    body = s.lstrip("+")
    day = f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1950, 2030)}"
    return [("00" + body, 1.0), ("0" + body.split(" ", 1)[-1], 1.0), (day, 0.0),
            (day.replace(".", "-") + " " + digits[-4:], 0.0)]


def _made(kind: str, rng: random.Random) -> str:
    """A generated base value of a kind."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        user = word() + rng.choice(["", "." + word(), "_" + word(), number(2)])
        return f"{user}@{word()}{rng.choice(['', '-' + word(), '.' + word()])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'io'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = rng.choice(["4", "51", "55", "34", "37", "6011"])
        body += number((14 if body[0] == "3" else 15) - len(body))
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice(["", " ", "-"]).join(digits[k: k + 4] for k in range(0, len(digits), 4))
    sep = rng.choice([" ", "-", ""])
    return f"+{rng.randint(1, 99)} {rng.randint(10, 999)}{sep}{sep.join(number(rng.randint(3, 4)) for _ in range(2))}"


def _is_form(kind: str, s: str) -> bool:
    """Whether a loose candidate looks like a positive form of ``_rewritten``; such ones get no label."""
    if not _FORMS[kind].fullmatch(s):
        return False
    digits = "".join(_DIGIT.findall(s))
    if kind == "ip":
        return _checked("ip", s.replace("[.]", "."))
    return kind == "email" or _checked(kind, digits)


@dataclass
class Detector:
    model: Boosted
    thresholds: dict[str, float]   # over 1: nothing is added for the kind

    def extra(self, text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
        """Spans to add: the best first, none that touches another or a base span."""
        candidates = loose_spans(text)
        if not candidates:
            return []
        taken = sorted(s for spans in base.values() for s in spans)
        wanted = [c for c in candidates if not _touches(taken, c[1], c[2])]
        if not wanted:
            return []
        scores = self.model.score(np.array([features(text, *c) for c in wanted]))
        order = sorted(range(len(wanted)), key=lambda k: (-scores[k], wanted[k][1], -wanted[k][2], wanted[k][0]))
        out: list[tuple[str, int, int]] = []
        for k in order:
            kind, start, end = wanted[k]
            if scores[k] >= self.thresholds.get(kind, 2.0) and not _touches(sorted((a, b) for _, a, b in out), start, end):
                out.append(wanted[k])
        return out


def _touches(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    import bisect

    # Base spans of different kinds may overlap; a few neighbours tell.
    k = bisect.bisect_left(spans, (end, 0))
    return any(a < end and start < b for a, b in spans[max(0, k - 8): k])


def _examples(text: str, seed: int = 0) -> Iterator[tuple[int, int, bool, list[float]]]:
    """(kind, label, held out, features) of what a text teaches; its copies teach the same."""
    base, failed = base_spans(text)
    turned = [*failed, *(c for c in loose_spans(text) if not _is_form(c[0], text[c[1]: c[2]]))]
    if not turned and not any(base.values()):
        return
    rng = random.Random(seed ^ int.from_bytes(_digest(text)))
    taken = sorted(s for spans in base.values() for s in spans)
    for kind, start, end in turned:
        if not _touches(taken, start, end):
            yield KINDS.index(kind), 0, rng.random() < HELD_OUT, features(text, kind, start, end)
    for kind, spans in base.items():
        for start, end in spans:
            yield from _positive(kind, text[max(0, start - CONTEXT): start], text[start:end], text[end: end + 1], rng)


def _positive(kind: str, before: str, value: str, after: str, rng: random.Random) -> Iterator[tuple[int, int, bool, list[float]]]:
    """A base value between its neighbours, and its rewritten forms."""
    for form, label in [(value, 1.0), *_rewritten(kind, value, rng)]:
        x = features(before + form + after, kind, len(before), len(before) + len(form))
        yield KINDS.index(kind), int(label), rng.random() < HELD_OUT, x


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "replace")).digest()


def _generated(positives: list[int], texts: list[str], seed: int = 0) -> list[tuple[int, int, bool, list[float]]]:
    """Examples of generated values for the kinds with fewer than KIND_POSITIVES ``positives``."""
    out, rng = [], random.Random(seed)
    for n, kind in enumerate(KINDS):
        have = positives[n]
        while have < KIND_POSITIVES:
            # Between two words of a text, half the time after a word that names it.
            text, value = rng.choice(texts), _made(kind, rng)
            at = text.find(" ", rng.randrange(len(text) + 1))
            before, after = (text, "") if at < 0 else (text[:at], text[at:])
            before = before[-CONTEXT:] + " " + rng.choice(["", f"{rng.choice(HINTS[n])} "])
            made = list(_positive(kind, before, value, after[:1], rng))
            out += made
            have += sum(label for _, label, _, _ in made)
    return out


def _nothing() -> Detector:
    return Detector(Boosted([], -10.0), {k: 2.0 for k in KINDS})


def _learned(cuts: list[np.ndarray], share: float, sums: Callable[..., np.ndarray], scores: Callable[..., np.ndarray]) -> Detector:
    """Trees by the sums over the learned examples, thresholds by the scores of the held-out ones."""
    model, trees = boost(cuts, share, sums)
    counts = scores(trees, model.prior)
    return Detector(model, {kind: _threshold(counts[k]) for k, kind in enumerate(KINDS)})


def _quantiles(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values at which a further BINS-th part of all is reached, but for the last."""
    ends = counts.cumsum()
    parts = BINS * ends // ends[-1]
    return values[np.minimum(parts, BINS - 1) > np.append(0, parts[:-1])]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def train(texts: list[str]) -> Detector:
    """A detector learned on the given texts; ``train_on`` learns the same from a table of them."""
    if not texts:
        return _nothing()
    rows = [r for t in texts for r in _examples(t)]
    rows += _generated([sum(y for k, y, *_ in rows if k == n) for n in range(len(KINDS))], texts)
    kind, y, held, x = (np.array(c) for c in zip(*rows))
    cuts = [_quantiles(*np.unique(column, return_counts=True)) for column in x[~held].T]
    learn, test = ((_binned(x[m], cuts), y[m], kind[m], np.ones(m.sum(), np.int64)) for m in (~held, held))
    return _learned(cuts, y[~held].mean(), lambda *at: _gradients(learn, *at), lambda *at: _scores(test, *at))


def _held(text: str, chars: int) -> list[tuple[str, str]]:
    """The kinds whose base spans a text holds, each with ``chars`` of it around the first."""
    out = []
    for kind, spans in base_spans(text)[0].items():
        if spans:
            start, end = spans[0]
            at = 0 if end <= chars else max(0, start - chars // 2)
            at = max(at, text.find(" ", at, start)) if at else 0
            out.append((kind, text[at: at + chars]))
    return out


_NO_SCORES = np.zeros((len(KINDS), STEPS, 2), np.int64)
EXAMPLE = "kind int, label int, held boolean, x array<double>"


def train_on(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Detector:
    """A detector learned on the whole texts of all rows; copies of a text are learned once.

    ``rows`` and ``chars`` bound what stands around generated values only: parts
    of texts with a digit or sign, chosen by hash, around a real value if they
    hold one. Nothing is generated for a kind with KIND_POSITIVES positive examples."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("t")).where("t IS NOT NULL")

    def examples(frame: pd.DataFrame) -> pd.DataFrame:
        found = [(_digest(t), n, *e) for t in frame["t"] for n, e in enumerate(_examples(t))]
        return pd.DataFrame(found, columns=["text", "no", "kind", "label", "held", "x"])

    names = ["kind", "label", "held", "x"]
    every, path = store(map_rows(texts, examples, f"text binary, no int, {EXAMPLE}").groupBy("text", "no").agg(
        F.min(F.struct(*names)).alias("e")).select(*[f"e.{c}" for c in names]))
    paths = [path]
    try:
        known = {r["kind"]: r["n"] for r in every.groupBy("kind").agg(F.sum("label").alias("n")).collect()}  # one row per kind
        positives = [known.get(n, 0) for n in range(len(KINDS))]
        if min(positives) < KIND_POSITIVES:
            around = _surroundings(texts, rows, chars)
            if not around:
                return _nothing()
            made = [(kind, y, held, list(map(float, x))) for kind, y, held, x in _generated(positives, around)]
            every = every.unionByName(spark.createDataFrame(made, EXAMPLE))
        cuts = _cuts(every.where("NOT held"))

        def bins(frame: pd.DataFrame) -> pd.DataFrame:
            return frame[["kind", "label", "held"]].assign(bins=[b.tobytes() for b in _binned(np.stack(frame["x"]), cuts)])

        keys = ["held", "kind", "label", "bins"]
        binned, path = store(map_rows(every, bins, "kind int, label int, held boolean, bins binary").groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n")))
        paths.append(path)
        sizes = {(r[0], r[1]): r[2] for r in binned.groupBy("held", "label").agg(F.sum("n")).collect()}
        positive, negative = (sizes.get((False, y), 0) for y in (1, 0))
        share = positive / max(1, positive + negative)
        n = binned.count()
        learn, test = (binned.where(F.col("held") == held).select("bins", "label", "kind", "n") for held in (False, True))
        if n <= BLOCK:  # a few MB, whatever number of rows they stand for
            some, others = ([*_blocks(df.collect())] for df in (learn, test))
            return _learned(cuts, share, lambda *at: sum(_gradients(b, *at) for b in some),
                            lambda *at: sum((_scores(b, *at) for b in others), _NO_SCORES))
        # read once for all levels, in as many partitions as there is work for
        slots = max(1, min(spark.sparkContext.defaultParallelism, n // BLOCK + 1))
        kept = [df.rdd.coalesce(slots).mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK) for df in (learn, test)]
        try:
            return _learned(cuts, share, lambda *at: kept[0].map(lambda b: _gradients(b, *at)).reduce(add),
                            lambda *at: kept[1].map(lambda b: _scores(b, *at)).fold(_NO_SCORES, add))
        finally:
            for blocks in kept:
                blocks.unpersist()
    finally:
        for p in paths:
            discard(spark, p)


def _surroundings(texts: DataFrame, rows: int, chars: int) -> list[str]:
    def parts(frame: pd.DataFrame) -> pd.DataFrame:
        found = [(cell, part) for t, drawn, cell in zip(frame["t"], frame["drawn"], frame["cell"], strict=True)
                 for part in [p for _, p in _held(t, chars)] or [drawn]]
        return pd.DataFrame(found, columns=["cell", "part"])

    some = texts.where(F.col("t").rlike(_SIGNS)).select(
        "t", drawn_part(F.col("t"), chars).alias("drawn"), F.xxhash64("t").alias("cell"))
    drawn = map_rows(some, parts, "cell long, part string").groupBy("cell").agg(F.min("part").alias("part"))
    return [r["part"] for r in drawn.orderBy("cell").limit(rows).collect()]


def _cuts(examples: DataFrame) -> list[np.ndarray]:
    """``_quantiles`` of each feature over all examples."""
    def values(frame: pd.DataFrame) -> pd.DataFrame:
        counted = [np.unique(column, return_counts=True) for column in np.stack(frame["x"]).T]
        return pd.DataFrame({"f": np.repeat(np.arange(len(counted)), [len(v) for v, _ in counted]),
                             "value": np.concatenate([v for v, _ in counted]), "n": np.concatenate([n for _, n in counted])})

    counts = map_rows(examples, values, "f int, value double, n long").groupBy("f", "value").agg(F.sum("n").alias("n"))
    one = Window.partitionBy("f")
    ends = counts.select("f", "value", F.sum("n").over(one.orderBy("value")).alias("end"), "n", F.sum("n").over(one).alias("all"))
    found = ends.where(F.expr(f"least({BINS} * end div all, {BINS - 1}) > {BINS} * (end - n) div all")).collect()  # BINS a feature at most
    cuts: dict[int, list[float]] = {}
    for r in found:
        cuts.setdefault(r["f"], []).append(r["value"])
    return [np.array(sorted(cuts.get(f, []))) for f in range(N_FEATURES)]


def _blocks(rows: Iterable) -> Iterator[Block]:
    """The rows of a partition as arrays, BLOCK rows at a time."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, BLOCK)):
        bins, label, kind, n = zip(*some)
        yield (np.frombuffer(b"".join(map(bytes, bins)), np.uint8).reshape(len(some), -1), np.array(label), np.array(kind), np.array(n))


# --- application ---------------------------------------------------------------

def all_spans(text: str, detector: Detector) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The base spans by kind, and all spans by kind as listed, then start."""
    base, _ = base_spans(text)
    every = [(k, a, b) for k in KINDS for a, b in base[k]] + detector.extra(text, base)
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Overlapping spans become one placeholder, named by the longest of them."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and start < merged[-1][1]:
            last = merged[-1]
            if end - start > last[3]:
                last[2], last[3] = kind, end - start
            last[1] = max(last[1], end)
        else:
            merged.append([start, end, kind, end - start])
    for start, end, kind, _ in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, detector: Detector, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (array of kind, start, end, base) and redacted text of every row.

    Positions are code points, the end exclusive. A null text counts as empty
    and has no spans. One row per input row, repeated ones and null ids
    included; other columns are ignored; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)  # TREES small trees

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in map(as_text, frame["text"]):
            base, spans = all_spans(t, shared.value)
            listed = {(k, a, b) for k in KINDS for a, b in base[k]}
            out.append(([{"kind": k, "start": a, "end": b, "base": (k, a, b) in listed} for k, a, b in spans],
                        redact(t, spans)))
        got = pd.DataFrame(out, columns=["spans", "redacted"])
        got.insert(0, "doc_id", frame["doc_id"].astype("Int64"))
        return got

    cols = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_rows(cols, run, "doc_id long, spans array<struct<kind string, start long, end long, base boolean>>, "
                               "redacted string")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_pii``: base counts, sha256 of the base list, all spans."""
    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact_column(docs: DataFrame, detector: Detector, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the same columns, its text redacted and ``n_chars`` set anew.

    A null text stays null. All rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("string")
    def clean(col: pd.Series) -> pd.Series:
        return pd.Series([None if not isinstance(t, str) else redact(t, all_spans(t, shared.value)[1]) for t in col],
                         dtype=object)

    new, = fresh(docs, "_pii_text")
    out = docs.withColumn(new, clean(F.col(text)))
    cols = [F.col(new).alias(c) if c == text else
            F.length(new).cast(docs.schema[c].dataType).alias(c) if c == n_chars else out[c] for c in docs.columns]
    return out.select(cols)
