"""Corpus operators against brute force, and their edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrubsearch.llm import (bytecnn, langid, linecut, mixing, neardup, pii, repetition, shard,
                             spiece, topk)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, bucket string"


def frame(spark, rows):
    full = [(i, t, g, s, len(t or ""), "x", "y", "z") for i, t, g, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    prose = [" ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n)) for n in (80, 60, 120, 3, 1)]
    near = prose[0].replace(prose[0].split()[40], "changed", 1)
    rows = [(1, prose[0], "en", "a"), (2, near, "en", "b"), (3, prose[1], "de", None), (3, prose[1], "de", None),
            (4, None, "en", "a"), (5, "", None, "b"), (6, " \n\t ", "fr", "c"), (7, prose[3], "en", "a"),
            (8, prose[3].upper(), "en", "a"), (None, prose[2], "de", "b"), (9, prose[0] + " ", "en", "b"),
            (10, prose[2] * 300, "en", "a"), (11, None, None, None), (12, "no mail a.b@c.de +49 30 1234567", "en", "b")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_sharding(docs, empty):
    names = [f"s{k}" for k in range(7)]
    table = shard.build_table(names, 1009)
    taken = Counter(table.tolist())
    assert max(taken.values()) - min(taken.values()) <= 1
    # brute force: the shards take turns on their own preference lists
    prefs = []
    for n in sorted(names):
        off, skip = shard._name_hash(n, "offset") % 1009, shard._name_hash(n, "skip") % 1008 + 1
        prefs.append((names.index(n), [(off + j * skip) % 1009 for j in range(1009)]))
    want, at = {}, [0] * 7
    while len(want) < 1009:
        for t, (k, pref) in enumerate(prefs):
            while at[t] < 1009 and pref[at[t]] in want:
                at[t] += 1
            if len(want) < 1009:
                want[pref[at[t]]] = k
    assert [want[k] for k in range(1009)] == table.tolist()
    fewer = shard.build_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.35 * 1009
    out = shard.assign_shards(docs, "doc_id", names, 1009)
    assert out.count() == docs.count() and out.where("shard IS NULL").count() == 0
    assert out.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert shard.assign_shards(empty, "doc_id", names).count() == 0
    with pytest.raises(ValueError):
        shard.build_table(names, 1000)


def test_mixing(docs, empty):
    plan = mixing.plan_mix(docs)
    got = plan.collect()
    assert len(got) == docs.count()
    assert [r["size"] for r in got if r["doc_id"] in (4, 5, 6, 11)] == [0] * 4
    per = {r["source"]: (r["source_size"], r["target"]) for r in got}
    total = sum(s for s, _ in per.values())
    assert sum(t for _, t in per.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-9 for s, t in per.values())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert rows_of(plan, "doc_id", "taken") == rows_of(mixing.plan_mix(docs.repartition(5)), "doc_id", "taken")
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert mixing.plan_mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def brute_repeat(words, n):
    grams = Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
    cover = [False] * len(words)
    for k in range(len(words) - n + 1):
        if grams[tuple(words[k:k + n])] > 1:
            cover[k:k + n] = [True] * n
    return cover


def test_repetition(docs, empty):
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["a ", "b ", "c\n", "dd ", "# ", " ", "\n"]) for _ in range(rng.randint(0, 90)))
        m, words = repetition.measure(text), WORD.findall(text)
        assert m["n_words"] == len(words) and m["word_chars"] == sum(map(len, words))
        assert m["n_repeat_words"] == sum(brute_repeat(words, 3))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert m["n_dup_lines"] == len(lines) - len(set(lines))
        for n in repetition.COVERAGE_LIMITS:
            want = sum(len(w) for w, c in zip(words, brute_repeat(words, n), strict=True) if c)
            assert m[f"coverage_{n}"] == pytest.approx(want / max(1, m["word_chars"]))
    out = repetition.repetition_rules(docs).collect()
    assert len(out) == docs.count()
    assert all(r["base_failed"] and not r["kept"] for r in out if r["n_words"] < 50)
    assert repetition.repetition_rules(empty).count() == 0


def test_pieces_match_the_library(docs, empty):
    import sentencepiece

    with open(spiece.MODEL_FILE, "rb") as f:
        model = f.read()
    sp, pieces = sentencepiece.SentencePieceProcessor(model_proto=model), spiece.Pieces(model)
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice("ab the \n é漢字𝄞ñ01 　\x00<s>ingtion") for _ in range(rng.randint(0, 80)))
        ids = spiece.encode(t, pieces).tolist()
        assert ids == sp.encode(t)
        assert spiece.decode(ids, pieces) == t
    window = []
    long_word = "▁" + "".join(rng.choice("abcdefghinost") for _ in range(20_000))
    assert spiece.viterbi(long_word, pieces, lambda at, n: window.append(n)) == sp.encode(long_word[1:])
    assert len(window) > 500 and max(window) <= 2 * pieces.longest  # committed as it goes
    out = spiece.encode_documents(docs, check=True).collect()
    assert len(out) == docs.count() and all(r["round_trip"] for r in out)
    assert spiece.encode_documents(empty).count() == 0
    texts = spiece.decode_documents(spiece.encode_documents(docs).drop("text")).select("text").collect()
    assert sorted(r[0] for r in texts) == sorted((r["text"] or "") for r in docs.collect())


def test_parts_of_words_are_encoded_once(monkeypatch):
    import sentencepiece

    with open(spiece.MODEL_FILE, "rb") as f:
        model = f.read()
    sp, pieces = sentencepiece.SentencePieceProcessor(model_proto=model), spiece.Pieces(model)
    beside = {p[k:k + 2] for p in pieces.id for k in range(len(p) - 1)}
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice("abT  \n\t.,#'’—é漢ж1▁") for _ in range(rng.randint(1, 60)))
        parts = pieces.part.findall(" " + t.replace("▁", " "))
        assert "".join(parts) == " " + t.replace("▁", " ")
        assert not any((a[-1] + b[0]).replace(" ", "▁") in beside for a, b in zip(parts, parts[1:]))
        assert spiece.encode(t, pieces).tolist() == sp.encode(t)
    plain, calls = spiece.viterbi, []
    monkeypatch.setattr(spiece, "viterbi", lambda *a: calls.append(a[0]) or plain(*a))
    words = ["".join(rng.choice("qzkvw") for _ in range(9)) for _ in range(30)]
    t = " ".join(w + "#" * n + ".\n" for w in words for n in range(20))
    assert spiece.encode(t, pieces).tolist() == sp.encode(t)
    assert len(calls) < 100  # not 600: a word and what follows it are known apart


def test_neighbours_by_edges_equal_plain_merging():
    with open(spiece.MODEL_FILE, "rb") as f:
        pieces = spiece.Pieces(f.read())
    rng = random.Random(2)
    short = [i for i in pieces.id.values() if len(pieces.text[i]) < 4]
    marks = [i for p, i in pieces.id.items() if not p.strip(spiece.SPACE)]
    for k in range(6_000):
        left, right = (rng.choice(marks if k % 3 == 0 else short) for _ in range(2))
        a, b = pieces.text[left], pieces.text[right]
        assert pieces.allowed(left, right) == (pieces.merge(b) == [b] and pieces.merge(a + b) == [a, b])
        assert pieces.allowed(left, right) == pieces.allowed(left, right)
        assert pieces.allowed(spiece.OTHER, right) == (pieces.merge(b) == [b])


def brute_groups(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark, docs, empty):
    out = neardup.near_duplicates(docs, shingle_words=4).collect()
    want = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None], 4)
    assert len(out) == docs.count()
    assert all(r["component_id"] == want[r["doc_id"]] for r in out if r["doc_id"] is not None)
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)
    left = neardup.drop_near_duplicates(docs, shingle_words=4)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(
        [i for i, c in want.items() if i == c] + [None])
    assert neardup.near_duplicates(empty).count() == 0 and neardup.drop_near_duplicates(empty).count() == 0


def test_near_duplicates_in_large_buckets(spark):
    """A chain of edits, so that far ends are linked only through others, in full buckets."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(90):
        if i % 9 == 0:
            base = [*base]
            base[rng.randrange(60)] = f"x{i}"
        text = [*base]
        text[rng.randrange(60)] = f"y{i}"
        rows.append((i, " ".join(text), "en", "a"))
    out = neardup.near_duplicates(frame(spark, rows), shingle_words=4).collect()
    want = brute_groups([(r[0], r[1]) for r in rows], 4)
    assert {r["doc_id"]: r["component_id"] for r in out} == want


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vecs = [(i, rng.normal(0, 0.3, 6).tolist()) for i in range(400)]
    vecs += [(500 + i, vecs[3][1]) for i in range(30)] + [(3, vecs[3][1]), (600, [])]
    bad = [(None, [0.1] * 6), (700, None), (701, [float("nan")] * 6), (702, [None] * 6), (650, [float("inf")] * 6)]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in vecs + bad],
                               "vec_id long, embedding array<float>, id string, v int")
    got = rows_of(topk.top_k(df), "query_id", "rank", "vec_id", "score")
    clean = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in vecs}
    clean[600] = np.zeros(6, np.int64)
    want = []
    for q in (i for i in clean if i % 50 == 0):
        best = sorted(((-int(clean[q] @ v), i) for i, v in clean.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr)
    assert topk.top_k(df.where("vec_id < 0")).count() == 0


def test_language_id(spark, sf_small, docs, empty):
    table = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = langid.train_text_model(table, "text", "lang")
    found = langid.identify(table, "text", "lang", "source", model)
    n = found.count()
    assert found.where("lid_lang = lang").count() >= 0.97 * n
    assert found.where("lid_accepted").count() >= 0.99 * n
    # the text alone, against a plain sum over trigrams
    for r in table.limit(20).collect():
        text = " " + "".join(c if c.isalpha() and (c.isascii() or ord(c) > 127) else " " for c in r["text"].lower()) + " "
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
        total = np.zeros(len(model.langs))
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            if b != 32:
                total += model.table[int(np.uint32((int(a) << 16 | int(b) << 8 | int(c)) * 2654435761 & 0xFFFFFFFF) >> 17)]
        assert np.allclose(total, model.score(r["text"])[0], rtol=1e-4)
    odd = langid.identify(docs, "text", "lang", "source", model)
    assert odd.count() == docs.count()
    assert odd.where("trim(coalesce(text, '')) = '' AND lid_accepted").count() == 0
    assert langid.identify(empty, "text", "lang", "source", model).count() == 0
    assert langid.identify(empty).count() == 0
    page = spark.createDataFrame([("https://a@b.example.de:80/x", '<HTML class=a lang="de-AT">')], "url string, html string")
    assert langid.page_evidence(page).select("page_tag", "page_host").first() == ("de-AT", "b.example.de")


def test_language_evidence_decides_short_texts(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/documents.parquet").select("text", "lang", F.lit("h.de").alias("host"))
    model = langid.train_text_model(table, "text", "lang")
    german = [("der und die", "de", "x.example.de")] * 30 + [("a", "de", "x.example.de")]
    rows = spark.createDataFrame(german, "text string, lang string, host string").unionByName(table)
    out = langid.identify(rows, "text", "lang", "host", model).where("text = 'a'").first()
    assert out["lid_lang"] == "de"


def test_language_model_does_not_depend_on_table_size(spark):
    """A rare language, and few tagged rows, among many others."""
    rng = random.Random(6)
    pick = lambda words: " ".join(rng.choice(words) for _ in range(40))
    english, greek = ["the", "and", "water", "house", "with"], ["και", "νερο", "σπιτι", "ειναι"]
    rows = [(i, pick(english), "en", "a") for i in range(3000)] + [(i, pick(greek), "el", "a") for i in range(3000, 3006)]
    rows += [(i, pick(english), None, "a") for i in range(4000, 9000)] + [(9000, pick(greek), "xx", "a")]
    rows += [(9001, "same text", "da", "a")] * 6
    table = frame(spark, rows)
    model = langid.train_text_model(table, "text", "lang", rows=60)
    assert model.langs == ["da", "el", "en", langid.UNKNOWN]
    found = langid.identify(table, "text", "lang", "source", model)
    assert found.where("doc_id BETWEEN 3000 AND 3005 AND lid_lang = 'el' AND lid_accepted").count() == 6
    few = langid.train_text_model(table.where("lang = 'el' OR lang IS NULL"), "text", "lang", rows=60)
    assert few.langs == ["el", langid.UNKNOWN]
    assert langid._quotas({"a": 5, "b": 100, "c": 1000}, 60) == {"a": 5, "b": 27, "c": 28}


def test_quality(spark, sf_small, docs, empty):
    table = spark.read.parquet(f"{sf_small}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_small}/../sf0.01/labels.parquet")
    net = bytecnn.train(*bytecnn.sample(table, labels))
    out = bytecnn.score_quality(table, net).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = out[out.quality == 1].score, out[out.quality == 0].score
    assert np.mean([(g > bad).mean() for g in good]) > 0.9
    odd = bytecnn.score_quality(docs, net).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert bytecnn.score_quality(empty, net).count() == 0
    assert bytecnn.train([], []).score("x") == pytest.approx(0.5)
    long = "abc " * 2000
    rows = bytecnn.chunks(long)
    whole = np.zeros(bytecnn.FILTERS)
    for r in rows:
        whole = np.maximum(whole, net.pooled(r[None])[0][0])
    assert np.allclose(net.pooled(np.array(rows))[0].max(axis=0), whole, atol=1e-4)
    assert rows.shape[0] * (bytecnn.CHUNK - bytecnn.OVERLAP) + bytecnn.OVERLAP >= len(long)


def test_pii(docs, empty):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(8)
    for _ in range(5000):
        t = "".join(rng.choice("a@.1+ -()9%_") for _ in range(rng.randint(0, 45)))
        want = {k: [m.span() for m in re.finditer(p, t) if k == "email" or pii._checked(k, m[0])]
                for k, p in plain.items()}
        assert pii.base_spans(t)[0] == want
    assert pii.base_spans("1." * 200_000 + "1" * 400_000)[0] is not None  # linear
    texts = [f"mail u{k}@x{k}.org or +49 30 {k}2345{k % 7} ip 10.0.{k % 200}.7 end" for k in range(10, 300)]
    detector = pii.train(texts)
    base, spans = pii.all_spans(texts[0], detector)
    assert pii.redact(texts[0], spans) == "mail [EMAIL] or [PHONE] ip [IP] end"
    assert {(k, a, b) for k in pii.KINDS for a, b in base[k]} <= set(spans)
    found = pii.span_digest(pii.find_pii(docs, detector))
    assert found.count() == docs.count()
    assert rows_of(found.where("doc_id = 12"), "n_email", "n_phone", "spans") == [(1, 1, "email:8:16,phone:17:31")]
    out = pii.redact_column(docs, detector)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 4").first()["text"] is None
    assert pii.redact("abcdef", [("ip", 1, 3), ("card", 2, 5)]) == "a[CARD]f"
    assert pii.find_pii(empty, detector).count() == 0
    assert pii.train_on(empty).extra("a 1.2.3.4", pii.base_spans("a")[0]) == []


def test_pii_kinds_do_not_depend_on_table_size(spark):
    """One document of each kind, and a kind that is rare among many numbers."""
    rng = random.Random(11)
    rows = [(i, f"item {rng.randint(1, 999)} of lot {i}", "en", "a") for i in range(300)]
    rows += [(900, "mail ann@example.org now", "en", "a"), (901, "ip 10.1.2.3 is up", "en", "a"),
             (902, "x " * 3000 + "card 4111 1111 1111 1111 ok", "en", "a")]
    detector = pii.train_on(frame(spark, rows), rows=20)
    assert all(detector.thresholds[k] <= 1 for k in pii.KINDS)
    text = "the host 10[.]20[.]30[.]40 and ip 7[.]8[.]9[.]10 too"
    assert pii.redact(text, pii.all_spans(text, detector)[1]) == "the host [IP] and ip [IP] too"
    assert pii._held(rows[-1][1], 4000)[0][0] == "card" and "4111 1111 1111 1111" in pii._held(rows[-1][1], 4000)[0][1]
    for kind in pii.KINDS:
        for _ in range(50):
            value = pii._made(kind, rng)
            assert pii.base_spans(value)[0][kind] == [(0, len(value))]


def test_pii_learns_on_whole_texts_of_all_rows(spark, monkeypatch):
    """Whatever the sizes given, however the rows lie, and copies once; what stands behind 5000 characters counts.

    Added up by tasks or by the driver."""
    rng = random.Random(13)
    texts = [f"{'word ' * rng.choice([0, 1000])}lot {rng.randint(1000, 9999)}-{rng.randint(100, 999)}-{k} mail u{k}@x{k}.org "
             f"call +49 30 {k}2345{k % 7} ip 10.0.{k % 200}.7 card 4111 1111 1111 1111 from 10.0.{k % 256}.{k % 300}" for k in range(400)]
    want = pii.train(texts)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts + texts[:50])] + [(900, None, "en", "a"), (901, "no sign", "en", "a")]
    for df, block in ((frame(spark, rows).repartition(7), pii.BLOCK), (frame(spark, rows[::-1]).coalesce(1), 100)):
        monkeypatch.setattr(pii, "BLOCK", block)
        got = pii.train_on(df, rows=3, chars=40)
        assert got.thresholds == want.thresholds and got.model.prior == want.model.prior
        for a, b in zip(got.model.trees, want.model.trees, strict=True):
            assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
    assert len(want.model.trees) == pii.TREES


def test_pii_spelled_addresses():
    """Every sign of the pattern is proposed, in any case, and real ones are no counter-examples."""
    for s in ("JOHN AT EXAMPLE DOT COM", "john (AT) example.com", "john at example.com", "john{At}example{DOT}com"):
        assert ("email", 6, 6 + len(s)) in pii.loose_spans(f"write {s}, now")
    rng = random.Random(12)
    for _ in range(20000):
        t = "".join(rng.choice(["a", "b1", ".", " ", " at ", "at", "(at)", "[AT]", "@", " dot ", "(dot)", "x" * 40, "\u212a", ","])
                    for _ in range(rng.randint(0, 14)))
        assert pii._loose_emails(t) == [m.span() for m in pii._LOOSE_EMAIL.finditer(t)], t
    for kind in pii.KINDS:
        for _ in range(50):
            for form, label in pii._rewritten(kind, value := pii._made(kind, rng), rng):
                assert not label or kind == "phone" or pii._is_form(kind, form), (value, form)
    for kind, s in (("card", "4111.1111.1111.1112"), ("ip", "1[.]2[.]3[.]999"), ("email", "look at example.com")):
        assert not pii._is_form(kind, s)
    texts = [f"write ann{k} at site{k} dot org or b{k}@x{k}.org" for k in range(300)]
    text = "write JOHN AT EXAMPLE DOT COM"
    assert pii.redact(text, pii.all_spans(text, pii.train(texts))[1]) == "write [EMAIL]"


def test_html(spark, sf_small):
    text = linecut.main_text
    assert text("") == "" and text("<p>") == ""
    assert text('<nav><a href=x>m</a></nav><article><h1>T &amp;amp; U</h1><p>a\n b<br>c<p class="ad">buy'
                '<div id="comments"><p>hey</div><ul><li>one<li class=promo>x<li>two</ul></article><footer>f') == (
        "T &amp; U\na b c\none\ntwo")
    assert text("<main><p>a < b &nbsp; c</p><form>q</form><script>var t='</p>';</script><!-- x --></main>") == "a < b c"
    assert text("<article>cut off <b>here") == "cut off here"
    plain = "<div><a href=1>Home</a></div><div>x</div>" + "<div></div>" * 3 + "<p>" + "long text " * 30 + "</p>"
    assert "long text" in text(plain) and "Home" not in text(plain)
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    for r in linecut.extract_text(pages, keep=["page_id", "html"]).collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        import html

        lines = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", re.sub(r"</?b>", "", inside))]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])
    odd = spark.createDataFrame([(1, None, "t"), (None, "<p>x", "u"), (2, "", None)], "page_id long, html string, text string")
    assert linecut.extract_text(odd, keep=["page_id", "text"]).count() == 3
    assert linecut.extract_text(odd.where("page_id > 9")).count() == 0


def test_html_keeps_every_part():
    text = linecut.main_text
    one, two = "first " * 50, "second " * 50
    p = lambda t: f"<p>{t}</p>"
    both = f"{one.strip()}\n{two.strip()}"
    assert text(f"<article>{p(one)}</article><article>{p(two * 2)}</article>") == f"{one.strip()}\n{(two * 2).strip()}"
    assert text(f"<main>{p(one)}<article>{p(two)}</article></main><footer>f</footer>") == both
    assert text(f"<main>{p(one)}</main><article>{p(two)}</article><div>{p('out ' * 50)}</div>") == both
    assert text(f"<article><a href=1>teaser</a></article><article>{p(one)}</article>") == one.strip()
    for box in ("<ul class=share><li>a<li>b<li>c</ul>", "<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul>",
                "<div class=ad><p>buy<p>more<p>now</div>"):
        assert text(p(one) + box + p(two)).startswith(one.strip()) and text(p(one) + box + p(two)).endswith(two.strip())
    assert text(p("Title") + p("by Ann") + p("short line") + p("x") + p(one * 20)) == (
        "Title\nby Ann\nshort line\nx\n" + (one * 20).strip())
    gap = "<a href=1>a</a><div><a href=1>b</a></div><div><a href=1>c</a></div><div><a href=1>d</a></div>"
    assert text(p(one * 40) + gap + p(two)) == f"{(one * 40).strip()}\n{two.strip()}"
    assert text("<p><a href=1>only a link</a></p>") == ""


def test_html_class_words_never_lose_the_page():
    text = linecut.main_text
    body, note = "some words " * 30, "<p>" + "note words " * 9 + "</p>"
    want = body.strip()
    for page in ('<article class="post has-sidebar">{}</article>', '<main class="with-sidebar">{}</main>',
                 '<div id="page" class="site has-header-image"><article>{}</article></div>',
                 '<article class="post tag-related category-notices">{}</article>', '<article class="promo">{}</article>',
                 '<div class="widget"><main>{}</main></div>', '<div class="menu"><article>{}</article></div>',
                 '<div class="tag-related no-sidebar">{}</div>', '<main class="x comments">{}</main>'):
        assert text(page.format(f"<p>{body}</p>")) == want, page
    for side in ("<div class=post-comments>{}</div>", "<div id=comments><article class=comment>{}</article></div>",
                 "<div class=sidebar><article>{}</article></div>", "<article class='comment depth-1'>{}</article>",
                 "<div class=share-buttons>{}</div>", "<div class='ad'>{}</div>", "<div class='siteFooter'>{}</div>"):
        assert text(f"<article><p>{body}</p></article>" + side.format(note)) == want, side
        assert text(f"<main class=has-sidebar><p>{body}</p>{side.format(note)}</main>") == want, side


def test_pipeline_stages(spark, sf_small, docs, empty):
    kept = spark.read.parquet(f"{sf_small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf_small)
        if name != "sentencepiece":
            assert out.columns == kept.columns
        else:
            assert out.columns == ["doc_id", "n_ids", "ids"]
        out.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        out = spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}")
        if name == "near_dedup":
            want = brute_groups([(r["doc_id"], r["text"]) for r in kept.collect()], 5)
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, c in want.items() if i == c)
        if name == "pii":
            assert out.where(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.")).count() == 0
        if name == "sentencepiece":
            assert out.count() == kept.count()
        kept = out
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_small).count()
        assert stage(spark, empty, sf_small).count() == 0


def test_language_score_lets_go_of_another_operators_model(spark):
    import pandas as pd

    from scrubsearch.llm import common

    common.worker_model("another operator", build=lambda: bytearray(1 << 20))
    model = langid.TextModel(["en", langid.UNKNOWN], np.zeros((langid.BUCKETS, 2), np.float32))
    got = langid._score_udf(spark, model).func(pd.Series(["some text", None]))
    assert got["n"].tolist() == [8, 0] and not common._MODEL
