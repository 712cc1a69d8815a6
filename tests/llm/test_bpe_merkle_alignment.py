"""Byte-level BPE, Merkle manifest and token alignment against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as tokenizer_files
import pytest
from pyspark.sql import functions as F

from scrubsearch.llm import alignment, bytebpe, merkle, queries
from scrubsearch.llm.spiece import SPACE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, leaf string, row string"
ALPHABET = ["a", "b", "the", "ing", " ", "  ", "\n", "\t ", "é", "漢", "𝄞", "0", "12", "'s", "'S", "!!", "aaaa", "----",
            "\x1c", "\x00", "\x85", "<|endoftext|>", "Ġ"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", "y", "z") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, one id with two texts, clashing columns."""
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta", "ing", "x1", "één", "sthe"]) for _ in range(rng.randint(1, 30))), "en", "hot")
            for i in range(300)]
    rows += [(300 + i, "Word " * i, "de", f"s{i % 4}") for i in range(40)]
    rows += [(1, "Other text", "en", "hot"), (2, rows[2][1], "en", "hot"), (None, "No Id", "en", "hot"), (None, None, None, None),
             (900, "", None, None), (901, None, "en", "lone"), (902, "Zed " * 30_000, "en", "s1"), (903, "x" * 50_000, "en", "s2"),
             (904, f"with{SPACE}mark", "en", ""), (905, " lead  and \n trail ", "fr", "Ünï")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def ranks():
    with open(bytebpe.RANK_FILE, "rb") as f:
        return bytebpe.Ranks(bytebpe.read_ranks(f.read()))


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizer_files.PATTERN, special_tokens={},
                             mergeable_ranks={t: k for k, t in enumerate(ranks.raw)})


def texts(seed, n, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_bpe_equals_the_library(ranks, library):
    assert bytebpe.PATTERN == tokenizer_files.PATTERN
    rng = random.Random(5)
    long = ["a" * 30_000, "ab" * 9_000, " " * 9_000, "".join(rng.choice("abcde") for _ in range(30_000)), "=" * 777 + "-" * 501]
    for t in texts(5, 1500) + long:
        ids = ranks.encode(t).tolist()
        assert ids == library.encode_ordinary(t)
        assert ranks.decode(ids).decode() == t


def test_neighbours_by_edges_equal_plain_merging(ranks):
    rng = random.Random(6)
    some = [rng.randrange(len(ranks.raw)) for _ in range(200)] + [ranks.rank[x] for x in (b"a", b"aa", b"aaaa", b" ", b"--", b"----")]
    for _ in range(4000):
        a, b = rng.choice(some), rng.choice(some)
        assert ranks._meet(a, b) == (ranks.merge(ranks.raw[a] + ranks.raw[b]) == [ranks.raw[a], ranks.raw[b]])


def test_bpe_with_a_token_that_no_merge_makes():
    """An unmergeable token is an id only as a whole match."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"xyz"]
    own = bytebpe.Ranks(tokens)
    assert own.encode("xyz").tolist() == [257]
    assert own.encode("xyzab").tolist() == [*b"xyz", 256]


def test_bpe_runs_of_a_long_text(ranks, library, monkeypatch):
    monkeypatch.setattr(bytebpe, "RUN_MATCHES", 7)
    for t in texts(8, 50, 200):
        assert ranks.encode(t).tolist() == library.encode_ordinary(t)


def test_bpe_documents(docs, empty, library):
    out = bytebpe.encode_documents(docs, decoded=True)
    got = sorted((r["doc_id"] or -1, r["ids"], bytes(r["decoded"])) for r in out.collect())
    want = sorted((r["doc_id"] or -1, library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in docs.collect())
    assert got == want
    row = bytebpe.digests(out).where("doc_id = 300").first()  # an empty text
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(row) == (300, 0, nothing, nothing)
    row, ids = bytebpe.digests(out).where("doc_id = 301").first(), library.encode_ordinary("Word ")
    assert tuple(row) == (301, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(b"Word ").hexdigest())
    again = bytebpe.decode_documents(bytebpe.encode_documents(docs).withColumn("ids", F.when(F.size("ids") > 0, F.col("ids"))))
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted((r["text"] or "").encode() for r in docs.collect())
    assert bytebpe.encode_documents(empty).count() == 0


# --- Merkle manifest ----------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """The tree built level by level in lists, with every leaf's path."""
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def climb(digests):
        paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
        while len(level) > 1:
            for k, p in enumerate(paths):
                lo = at[k] // 16 * 16
                p.append(("".join(level[lo:at[k]]), "".join(level[at[k] + 1:lo + 16])))
                at[k] //= 16
            level = [sha("".join(level[lo:lo + 16])) for lo in range(0, len(level), 16)]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in order:
        ranked = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        subs.append((ranked, *climb([leaf(r, r["text"]) for r in ranked])))
    root, crowns = climb([sub for _, sub, _ in subs])
    out = []
    for (ranked, sub, paths), crown in zip(subs, crowns):
        for r, path in zip(ranked, paths):
            seen = r["text"]
            if r["doc_id"] is not None and seen is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                seen = "".join(c.lower() if "A" <= c <= "Z" else c for c in seen)
            at = leaf(r, seen)
            for before, after in path + crown:
                at = sha(before + at + after)
            proof = sha("".join(b + a for b, a in path + crown))
            out.append((r["doc_id"], leaf(r, r["text"]), sub, root, proof, at, at == root))
    return sorted(out, key=repr)


def test_merkle_equals_plain_tree(docs, empty, spark):
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(docs.collect())
    assert merkle.manifest(empty).count() == 0 and merkle.manifest(empty).columns == got.columns
    one = docs.where("doc_id = 901")  # a lone leaf is the root; it has no siblings
    row = merkle.manifest(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")


def test_merkle_many_groups_and_shuffled_lookups(docs, spark, monkeypatch):
    """More groups than one run of 16, roots joined without a broadcast, rows dealt anew."""
    rows = [(i, f"T{i}", None, f"g{i % 40:02d}") for i in range(200)] + [(i, "Hot row", None, "z") for i in range(300, 600)]
    many = frame(spark, rows).repartition(7)
    monkeypatch.setattr(merkle, "MAX_BROADCAST_GROUPS", 3)
    assert sorted(map(tuple, merkle.manifest(many).collect()), key=repr) == plain_manifest(many.collect())


# --- alignment ------------------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    with open(alignment.BYTE_BPE_FILE, "rb") as a, open(alignment.MODEL_FILE, "rb") as b:
        return alignment.Aligner(a.read(), b.read())


@pytest.fixture(scope="module")
def tokenizers_of_files():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_FILE)


def plain_alignment(text, tokenizers_of_files, aligner):
    """(A ids, B ids, [(ids of A, ids of B) of each group]) by walking both token lists."""
    a_lib, sp = tokenizers_of_files
    a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
    b = sp.encode(text) if text else []
    want = (" " + (text or "")).encode()
    if not text or b"".join(aligner.a.raw[k] for k in a) != want or b"".join(aligner.b_raw[k] for k in b) != want:
        return [], [], []
    groups, i, j = [], 0, 0
    while i < len(a):
        left, right = [a[i]], [b[j]]
        n, m = len(aligner.a.raw[a[i]]), len(aligner.b_raw[b[j]])
        i, j = i + 1, j + 1
        while n != m:
            if n < m:
                left.append(a[i])
                n, i = n + len(aligner.a.raw[a[i]]), i + 1
            else:
                right.append(b[j])
                m, j = m + len(aligner.b_raw[b[j]]), j + 1
        groups.append((left, right))
    return a, b, groups


def test_products_equal_dense_matrices():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = rng.integers(1, 6, rng.integers(1, 12))
        total = int(a.sum())
        cuts = np.sort(rng.choice(np.arange(1, total), min(total - 1, int(rng.integers(0, 9))), replace=False)) if total > 1 else np.array([], int)
        b = np.diff(np.concatenate([[0], cuts, [total]]))
        dense_a, dense_b = (np.repeat(np.eye(len(x), dtype=int), x, axis=1) for x in (a, b))
        row, col, n = alignment.overlap_links(a, b)
        got = np.zeros((len(a), len(b)), int)
        got[row, col] = n
        assert (got == dense_a @ dense_b.T).all()
        ga, gb, n_groups = alignment.group_numbers(a, b)
        row, col = alignment.group_links(ga, gb, n_groups)
        got[:] = 0
        got[row, col] = 1
        assert (got == (ga[:, None] == gb[None, :])).all()
        # groups are the parts of the overlaps that hang together
        assert all(ga[i] == gb[j] for i, j in zip(*np.nonzero(dense_a @ dense_b.T)))


def test_alignment_equals_walk(aligner, tokenizers_of_files):
    for t in texts(9, 400) + [SPACE, f"a{SPACE} b", " ", "  x", "x ", "x  y z", "x" * 9_000]:
        a, b, groups = plain_alignment(t, tokenizers_of_files, aligner)
        units = aligner.align([t])[0]
        if not a:
            assert units is None
            continue
        assert [sum(u[k] for u in units) for k in range(3)] == [len(a), len(b), len(groups)]
        assert ";".join(u[3] for u in units) == ";".join(
            ",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links = sorted(i * len(aligner.b_raw) + j for x, y in groups for i in x for j in y)
        assert sorted(np.frombuffer(b"".join(u[4] for u in units), np.int64).tolist()) == links


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_alignment_report(docs, empty, aligner, tokenizers_of_files, monkeypatch, most):
    monkeypatch.setattr(alignment, "MAX_BROADCAST_PAIRS", most)
    rows = [(r["doc_id"], *plain_alignment(r["text"], tokenizers_of_files, aligner)) for r in docs.collect()]
    held, best = {}, {}
    for _, _, _, groups in rows:
        for pair in {(i, j) for x, y in groups for i in x for j in y}:
            held[pair] = held.get(pair, 0) + 1
    for (i, _), n in held.items():
        best[i] = max(n, best.get(i, 0))
    want = []
    for doc_id, a, b, groups in rows:
        links = [(i, j) for x, y in groups for i in x for j in y]
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((doc_id, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links),
                     sum(held[p] for p in links), sha(spelled) if groups else ""))
    got = [tuple(r) for r in alignment.alignment_report(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert alignment.alignment_report(empty).count() == 0


def test_queries_are_registered():
    assert {"op11_byte_bpe", "op12_merkle_manifest", "op13_token_alignment"} <= set(queries.QUERIES)
    assert "op12_merkle_manifest" in queries.ORACLES
