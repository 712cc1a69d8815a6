"""P1-P5 invariants and R2/R2b against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scrubsearch.operators import chunk as CH
from scrubsearch.operators import index as IX
from scrubsearch.operators import search as S
from scrubsearch.operators import sparse
from scrubsearch.operators.embed import embed_sparse
from scrubsearch.operators.flatten import flatten_rows, pack_rows
from scrubsearch.session import scratch_dir
from scrubsearch.sources import tables as TB

TEXTS = ["x" * 2500, "para one\n\npara two is longer\n\n" * 40, "", None, "short", "a b\nc d " * 300]


def test_recursive_invariants():
    for t in TEXTS:
        chunks = CH.split_recursive(t or "", 100, 20)
        assert all(len(c) <= 100 for c in chunks)
        assert all(c == c.strip() and c for c in chunks)
        src = "".join((t or "").split())
        assert all("".join(c.split()) in src for c in chunks)
        covered = "".join("".join(c.split()) for c in chunks)
        assert set(src) <= set(covered)


def test_recursive_and_fixed_udf(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    rec = CH.chunk_recursive(df, 100, 20, keep=["doc_id"]).collect()
    by_doc = {}
    for r in rec:
        by_doc.setdefault(r.doc_id, []).append(r.chunk_no)
    assert all(sorted(v) == list(range(len(v))) for v in by_doc.values())
    assert 2 not in by_doc and 3 not in by_doc  # empty and null texts give no chunk
    fx = CH.chunk_fixed(df, 100, 20, keep=["doc_id"]).where(F.col("doc_id") == 0).orderBy("chunk_no").collect()
    assert [len(r.chunk) for r in fx][:2] == [100, 100] and fx[1].chunk == ("x" * 2500)[80:180]


def test_flatten_nulls_and_pack(spark):
    df = spark.createDataFrame([(None, "b", 1), ("a", None, 2), ("a", "b", None)], "x string, y string, z int")
    got = [r.text for r in flatten_rows(df, ["x", "y", "z"], keep=[]).collect()]
    assert got == ["nan b 1", "a nan 2", "a b nan"]
    rows = spark.createDataFrame([("s1", i, f"r{i}") for i in range(10)], "source string, row_no long, text string")
    packed = {r.bucket: r.text for r in pack_rows(rows, rows_per_bucket=4).collect()}
    assert packed == {0: "r0\nr1\nr2\nr3", 1: "r4\nr5\nr6\nr7", 2: "r8\nr9"}


def test_dense_topk_equals_numpy(spark, sf_small):
    e = TB.table(spark, sf_small, "embeddings").select("vec_id", "embedding")
    mat = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in e.collect()}
    ids = np.array(sorted(mat))
    m = np.stack([mat[i] for i in ids])
    queries = e.where(F.col("vec_id") < 25).withColumnRenamed("vec_id", "query_id")
    got = S.topk_dense(spark, queries, e, k=5, metric="l2", block_rows=10, part_rows=30).collect()
    res = {}
    for r in got:
        res.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q, lst in res.items():
        d = ((m - mat[q]) ** 2).sum(axis=1)
        want = list(ids[np.lexsort((ids, d))[:5]])
        assert [v for _, v in sorted(lst)] == want


CHUNKS = "store string, source string, doc_id long, chunk_no int, chunk_key string, text string"


def _index(spark, texts, name="test-index"):
    rows = [("kb", "s", i, 0, f"k{i:03d}", t) for i, t in enumerate(texts)]
    path = scratch_dir(spark, name)
    return IX.write_index(spark.createDataFrame(rows, CHUNKS), path), path


def _brute(texts, query, k):
    def vec(t):
        return Counter(re.findall(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W_\u3040-\u30ff\u3400-\u9fff]+", (t or "").lower()))

    qv, scored = vec(query), []
    for i, t in enumerate(texts):
        cv = vec(t)
        norms = sum(v * v for v in qv.values()) * sum(v * v for v in cv.values())
        scored.append((-sum(n * cv[w] for w, n in qv.items()) / math.sqrt(max(norms, 1)), f"k{i:03d}"))
    return [key for _, key in sorted(scored)[:k]]


SEARCH_TEXTS = ["apple pie recipe", "apple tart", "banana bread", "pie crust apple apple", "cherry pie", "the the the",
                "", None, "\u043f\u0440\u0438\u0432\u0435\u0442 \u041c\u0418\u0420", "\u6771\u4eac\u306e\u5929\u6c17", "gr\u00fc\u00dfe aus k\u00f6ln", "x 7"]


def test_sparse_topk_equals_brute_force(spark):
    """Small stores fill k; any script, single characters and words of every chunk count."""
    asked = ["apple pie", "bread", "zzz", "", "\u043c\u0438\u0440", "\u5929\u6c17", "K\u00d6LN", "7", "the"]
    for n in (1, 10, 49):
        texts = [SEARCH_TEXTS[-1 - i % len(SEARCH_TEXTS)] for i in range(n)]
        index, _ = _index(spark, texts)
        queries = spark.createDataFrame([("kb", i, t) for i, t in enumerate(asked)], "store string, query_id int, key string")
        got = {}
        for r in S.search_sparse(queries, index, k=10).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.chunk_key))
        for i, t in enumerate(asked):
            assert [key for _, key in sorted(got[i])] == _brute(texts, t, 10), (n, t)


def test_sparse_blocks_do_not_change_results(spark):
    index, _ = _index(spark, SEARCH_TEXTS * 9)
    q = IX.DEFAULT_EMBEDDER(spark.createDataFrame([("kb", i, t) for i, t in enumerate(SEARCH_TEXTS)],
                                                  "store string, query_id int, text string"), "text")
    whole = S.topk_sparse(q, index.vectors).collect()
    cut = S.topk_sparse(q, index.vectors, query_rows=3, chunk_rows=7).collect()
    assert sorted(whole) == sorted(cut) and len(whole) == 10 * len(SEARCH_TEXTS)


def test_search_of_empty_sides(spark):
    index, _ = _index(spark, ["a b"])
    none = spark.createDataFrame([], "store string, query_id int, key string")
    assert S.search_sparse(none, index).count() == 0
    empty, _ = _index(spark, [])
    one = spark.createDataFrame([("kb", 1, "a")], "store string, query_id int, key string")
    assert S.search_sparse(one, empty).count() == 0
    vecs = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    no_q = vecs.limit(0).withColumnRenamed("vec_id", "query_id")
    for metric in ("l2", "cosine"):
        assert S.topk_dense(spark, no_q, vecs, metric=metric).count() == 0
        assert S.topk_dense(spark, vecs.withColumnRenamed("vec_id", "query_id"), vecs.limit(0), metric=metric).count() == 0
    assert S.topk_lsh(no_q, vecs).count() == 0


def test_dense_ties_take_the_smaller_ids(spark):
    vecs = spark.range(3000).selectExpr("id as vec_id", "array(0.1D, 0.7D, 0.3D) as embedding")
    q = vecs.where("vec_id < 2").withColumnRenamed("vec_id", "query_id")
    for metric in ("l2", "cosine"):
        got = S.topk_dense(spark, q, vecs, metric=metric, part_rows=500).collect()
        assert sorted(r.vec_id for r in got if r.query_id == 0) == list(range(10))


def test_append_adds_only_new_keys(spark):
    index, path = _index(spark, ["a b", "c"])
    more = spark.createDataFrame([("kb", "s", i, 0, f"k{i:03d}", t) for i, t in enumerate(["a b", "c", "d e f"])], CHUNKS)
    again = IX.write_index(more.unionByName(more), path, "append")
    assert sorted(r.chunk_key for r in again.chunks.collect()) == ["k000", "k001", "k002"]
    assert again.postings.count() == 6


def test_overwrite_leaves_other_stores(spark):
    rows = [("kb", "s", 0, 0, "a", "x"), ("sla", "s", 0, 0, "b", "y")]
    path = scratch_dir(spark, "ow")
    IX.write_index(spark.createDataFrame(rows, CHUNKS), path)
    IX.write_index(spark.createDataFrame([("kb", "s", 1, 0, "c", "z")], CHUNKS), path, "overwrite")
    assert sorted(r.chunk_key for r in IX.read_index(spark, path).chunks.collect()) == ["b", "c"]
    IX.drop_store(spark, path, "sla")
    assert [r.chunk_key for r in IX.read_index(spark, path).chunks.collect()] == ["c"]


def test_build_that_was_cut_off_is_built_anew(spark):
    rows = spark.createDataFrame([("kb", "s", 0, 0, "a", "x")], CHUNKS)
    path = scratch_dir(spark, "cut")
    rows.drop("text").write.partitionBy("store").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/chunks")
    assert IX.open_or_build(spark, path, lambda: rows).chunks.collect()[0].text == "x"
    assert IX.open_or_build(spark, path, lambda: rows.limit(0)).chunks.count() == 1


def test_windows_equal_slices(spark):
    text = "".join(chr(97 + i % 26) if i % 7 else "\U0001f600\n"[i % 2] for i in range(2311))
    for size, overlap in ((100, 20), (100, 60), (100, 90), (50, 0), (4000, 100)):
        for t in (text, text[:overlap], text[:overlap + 1], text[:size], text[:size + 1], "a"):
            df = spark.createDataFrame([(0, t)], "doc_id int, text string")
            got = [r.chunk for r in CH.chunk_fixed(df, size, overlap, keep=["doc_id"]).orderBy("chunk_no").collect()]
            starts = range(0, max(len(t) - overlap - 1, 0) + 1, size - overlap)
            assert got == [t[i:i + size] for i in starts if t], (size, overlap, len(t))


def test_open_or_build_loads_existing(spark):
    chunks = spark.createDataFrame([("kb", "s", 0, 0, "c0", "alpha beta")],
                                   "store string, source string, doc_id long, chunk_no int, chunk_key string, text string")
    path = scratch_dir(spark, "k2")
    calls = []

    def build():
        calls.append(1)
        return chunks

    IX.open_or_build(spark, path, build)
    idx = IX.open_or_build(spark, path, build)
    assert calls == [1] and idx.chunks.count() == 1


def test_embed_counts(spark):
    df = spark.createDataFrame([(1, "Ab ab bc! BC-bc x")], "id int, text string")
    rows = sorted((r.tf, r.norm2) for r in embed_sparse(df, "id").collect())
    assert rows == [(1, 14), (2, 14), (3, 14)]


def test_lsh_recall(spark, sf_small):
    e = TB.table(spark, sf_small, "embeddings").select("vec_id", "embedding")
    q = e.withColumnRenamed("vec_id", "query_id")
    exact = set(map(tuple, S.topk_dense(spark, q, e, k=10).select("query_id", "vec_id").collect()))
    approx = set(map(tuple, S.topk_lsh(q, e, k=10).select("query_id", "vec_id").collect()))
    assert len(approx & exact) / len(exact) >= 0.9


def _vectors(spark, texts, key, store="kb"):
    rows = [(store, k, t) for k, t in texts]
    kind = "long" if key == "query_id" else "string"
    return IX.DEFAULT_EMBEDDER(spark.createDataFrame(rows, f"store string, {key} {kind}, text string"), "text")


def test_sparse_heavy_and_light_tokens(spark):
    """Any share of heavy tokens, blocks and parts of any size give the brute-force rows."""
    rng = random.Random(3)
    common, rare = ["the", "of", "and", "a"], [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(common) for _ in range(rng.randint(0, 8))) + " " + " ".join(rng.sample(rare, rng.randint(0, 4)))
             for _ in range(180)] + ["the of"] * 12  # ties at the edge of the k best
    asked = ["the", "the of and", "w1 w2", "the w3 w3 of", "", "zzz", "a a a w7", "of w59 zzz", "the of"]
    chunks = _vectors(spark, [(f"k{i:03d}", t) for i, t in enumerate(texts)], "chunk_key")
    queries = _vectors(spark, list(enumerate(asked)), "query_id")
    want = {i: _brute(texts, t, 10) for i, t in enumerate(asked)}
    for share, least, part, block in ((0.0, 0, 50, 4), (0.1, 1, 4096, 64), (2.0, 0, 64, 3)):
        rows = S.topk_sparse(queries, chunks, heavy_share=share, heavy_min=least, chunk_rows=part, query_rows=block).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["chunk_key"])
        assert got == want, (share, part)


def test_heavy_blocks_are_skipped_but_nothing_is_lost():
    """Block bounds: chunks of four vocabularies; most blocks of the other three are never scored."""
    rng = np.random.default_rng(1)
    n, tokens, k = 4000, 40, 10
    rows = np.zeros((n, tokens))
    for i in range(n):
        rows[i, i % 4 * 10:i % 4 * 10 + 10] = rng.integers(0, 9, 10)
    asked = np.zeros((30, tokens))
    for i in range(30):
        asked[i, i % 4 * 10:i % 4 * 10 + 10] = rng.integers(0, 4, 10)

    def csr(m):
        row, col = np.nonzero(m)
        return col.astype(np.int64), m[row, col].astype(np.int64), row, (m * m).sum(axis=1)

    q, c, s, scored = sparse.heavy_best(csr(asked), csr(rows), k)
    exact = asked @ rows.T / np.sqrt(np.maximum((asked ** 2).sum(1)[:, None] * (rows ** 2).sum(1)[None], 1.0))
    for i in range(30):
        best = np.lexsort((np.arange(n), -exact[i]))[:k]
        assert sorted(c[q == i].tolist()) == sorted(best.tolist())
        assert np.allclose(np.sort(s[q == i]), np.sort(exact[i][best]), rtol=0, atol=0)
    assert scored <= 0.5 * 30 * n


def test_ticket_search_scores_few_pairs(spark, sf_small):
    """At most a tenth of the pairs of questions and chunks get a score."""
    chunks = IX.DEFAULT_EMBEDDER(IX.sla_chunks(TB.tickets(spark, sf_small)), "text")
    asked = IX.DEFAULT_EMBEDDER(TB.questions(spark, sf_small).withColumn("store", F.lit("sla")), "text")
    pairs = spark.sparkContext.accumulator(0)
    n = S.topk_sparse(asked, chunks, scored=pairs).count()
    total = asked.count() * chunks.count()
    print(f"scored {pairs.value} of {total} pairs")
    assert n == 10 * asked.count() and 0 < pairs.value <= 0.1 * total


def test_lsh_pairs_are_not_joined(spark):
    """Pairs are made inside a task, not joined with their vectors; repeated ids, nulls and parts of any size keep their rows."""
    rng = np.random.default_rng(3)
    vectors = {i: [float(x) for x in rng.normal(size=4)] for i in range(60)}
    rows = [*vectors.items(), (5, vectors[5]), (60, None), (61, [0.1, None, 0.0, 0.0]), (None, [9.0] * 4)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = e.withColumnRenamed("vec_id", "query_id")
    whole, cut = (S.topk_lsh(q, e, k=5, width=1e6, block_rows=b, part_rows=p) for b, p in ((8192, 4096), (9, 7)))
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(str, whole.collect()))
    assert rows == sorted(map(str, cut.collect()))
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in whole.where("score IS NOT NULL").collect()}
    everyone = {**vectors, None: [9.0] * 4}
    for i, v in vectors.items():
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), -1 if j is None else j) for j, w in everyone.items())
        mine = [j for (at, _), j in sorted(((k, j) for k, j in found.items() if k[0] == i), key=lambda x: x[0][1])]
        assert mine == [j for _, j in near[:len(mine)]] and len(mine) >= 3


def test_sparse_parts_go_only_to_blocks_that_visit_them(spark):
    """A chunk is sent once for each block of queries that visit its part, not for each block there is."""
    n = 256
    queries = _vectors(spark, [(i, f"own{i} w{i % 7}") for i in range(n)], "query_id")
    chunks = _vectors(spark, [(f"k{i:03d}", f"own{i} w{i % 7} filler{i}") for i in range(n)], "chunk_key")
    sent = spark.sparkContext.accumulator(0)
    real = sparse.light_best

    def counted(light, dense, parts, heavy, floor, k):
        sent.add(len(parts[3]))
        return real(light, dense, parts, heavy, floor, k)

    sparse.light_best = counted
    try:
        # own tokens are light (one chunk), w tokens heavy: a query visits one part
        got = sparse.topk_sparse(queries, chunks, 2, query_rows=8, chunk_rows=8, heavy_share=0.0, heavy_min=8)
        first = {r["query_id"]: r["chunk_key"] for r in got.where("rank = 1").collect()}
    finally:
        sparse.light_best = real
    assert first == {i: f"k{i:03d}" for i in range(n)}
    assert 0 < sent.value <= 4 * n  # 32 blocks: 32 * n before


def test_sparse_dense_rows_equal_pairs():
    """Light pairs added up in whole rows or one by one: the same pairs and scores."""
    rng = np.random.default_rng(5)

    def vectors(n):
        rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(n)]
        counts = rng.integers(1, 4, 8 * n)
        norm = (counts.reshape(n, 8) ** 2).sum(axis=1).astype(float)
        return np.concatenate(rows), counts, np.repeat(np.arange(n), 8), norm

    heavy = np.arange(10)
    (qb, qt, q_row, qn), chunks = vectors(300), vectors(90)
    h = np.isin(qb, heavy)
    args = ((qb[~h], qt[~h], q_row[~h], qn), (qb[h], qt[h], q_row[h], qn), chunks, heavy, np.full(300, 0.2), 5)
    found = []
    for share in (0, 32):
        sparse.DENSE_FROM = share
        try:
            found.append(sparse.light_best(*args))
        finally:
            sparse.DENSE_FROM = 32
    for one, other in zip(*found):
        assert np.array_equal(one, other)


def test_long_texts_come_in_small_batches(spark):
    """The splitter's Arrow batches hold few rows, whatever the session says."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    CH.chunk_recursive(spark.range(3).selectExpr("id", "repeat('a b ', 500) AS text"), 512, 200, ["id"]).count()
    assert int(spark.conf.get(key)) <= 256


def test_queries_that_differ_in_unknown_tokens_are_searched_once(spark):
    """Tokens that no chunk holds add nothing; an id that repeats has the best of its rows."""
    schema = "store string, {} string, buckets array<long>, tfs array<long>, norm2 long"
    chunks = spark.createDataFrame([("s", f"c{i:02}", [1, 100 + i], [1, 1 + i % 3], 2) for i in range(40)],
                                   schema.format("chunk_key"))
    asked = [("s", f"q{i}", [1, 1000 + i], [1, 1], 2) for i in range(300)]
    asked += [("s", "twice", [1, 105], [1, 2], 5), ("s", "twice", [1, 107], [1, 2], 5), ("s", "none", [7], [1], 1)]
    queries = spark.createDataFrame(asked, schema.format("query_id"))
    scored = spark.sparkContext.accumulator(0)
    often, sparse.OFTEN = sparse.OFTEN, 200
    try:
        got = S.topk_sparse(queries, chunks, 3, scored=scored).collect()
    finally:
        sparse.OFTEN = often
    assert scored.value <= 40 * 10  # 300 x 40 pairs if every query is searched
    found = {}
    for r in sorted(got, key=lambda r: r.rank):
        found.setdefault(r.query_id, []).append((r.rank, r.chunk_key, round(r.score, 6)))
    assert len(found) == 302
    assert all(found[f"q{i}"] == [(1, "c00", 0.5), (2, "c01", 0.5), (3, "c02", 0.5)] for i in range(300))
    assert [x[1] for x in found["none"]] == ["c00", "c01", "c02"] and found["none"][0][2] == 0
    assert found["twice"] == [(1, "c05", round(7 / 10 ** 0.5, 6)), (2, "c07", round(5 / 10 ** 0.5, 6)),
                              (3, "c00", round(1 / 10 ** 0.5, 6))]


def test_embed_rows_hashes_a_token_once_a_batch(spark, monkeypatch):
    import hashlib
    from types import SimpleNamespace

    import pyarrow as pa

    from scrubsearch.operators import embed

    hashed = []
    monkeypatch.setattr(embed, "hashlib", SimpleNamespace(md5=lambda t: hashed.append(t) or hashlib.md5(t)))
    got = embed._vectors(pa.array([["a", "b", "a"], [], ["b"] * 3 + ["é"]])).to_pylist()
    assert sorted(hashed) == [b"a", b"b", "é".encode()]
    monkeypatch.undo()
    bucket = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    want = [{"a": 2, "b": 1}, {}, {"b": 3, "é": 1}]
    for row, counts in zip(got, want, strict=True):
        assert list(zip(row["buckets"], row["tfs"])) == sorted((bucket(t), n) for t, n in counts.items())
        assert row["norm2"] == sum(n * n for n in counts.values())
    texts = ["A b a", None, "B,b b É", "", "\u6f22\u5b57a \u30fb"]
    rows = embed.embed_rows(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).orderBy("id").collect()
    for row, counts in zip(rows, [want[0], {}, want[2], {}, {"\u6f22": 1, "\u5b57": 1, "a": 1}], strict=True):
        assert list(zip(row["buckets"], row["tfs"])) == sorted((bucket(t), n) for t, n in counts.items())
