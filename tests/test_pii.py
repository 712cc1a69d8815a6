"""A1-A14 goldens and properties."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubsearch.functions import columns as C
from scrubsearch.functions import fixed, spans
from scrubsearch.operators import pii

EMAIL, PHONE, IP = (next(d for d in fixed.DETECTORS if d[0] == n) for n in ("EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS"))
DIGITS_13_16 = ("CREDIT_CARD", r"\b[0-9]{13,16}\b", False)  # without the Luhn check


def _rows(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def _merged(spark, listed):
    df = spark.createDataFrame([(listed,)], "spans array<struct<s:int,e:int,entity:string,original:string>>")
    return [(r.s, r.e) for r in df.select(spans.merge_spans(F.col("spans")).alias("m")).first().m]


def test_merge_nested_and_partial_overlaps(spark):
    assert _merged(spark, [(0, 20, "A", "x"), (5, 10, "B", "y")]) == [(0, 20)]
    assert _merged(spark, [(0, 10, "A", "x"), (5, 15, "B", "y")]) == [(0, 15)]
    assert _merged(spark, [(22, 24, "A", "x"), (23, 25, "B", "y")]) == [(22, 25)]
    assert _merged(spark, [(5, 6, "A", "x"), (0, 2, "B", "y"), (2, 4, "C", "z")]) == [(0, 2), (2, 4), (5, 6)]


def test_multi_detector_spans_are_merged(spark):
    text = "x 1.2.3.4@mail.com y +1 (555) 555-1234567890123 z"
    df = _rows(spark, [text])
    found = df.select(spans.resolve_spans(F.col("text"), [EMAIL, IP, PHONE, DIGITS_13_16]).alias("m")).first().m
    assert [(r.s, r.e) for r in found] == [(2, 18), (21, 47)]
    out = pii.anonymize(df, "text", "a", detectors=[EMAIL, IP, PHONE, DIGITS_13_16]).first()
    assert out.a == "x __PII_0__ y __PII_1__ z"
    assert [m.original for m in out.a_mapping] == ["1.2.3.4@mail.com", "+1 (555) 555-1234567890123"]


def test_anonymize_roundtrip_and_no_leak(spark):
    texts = ["call a@b.co or c@d.org re IN0042923 now",
             " ".join(f"u{i}@x.org" for i in range(12)),
             "trailing match a@b.co",
             "already __PII_0__ and __PRESERVED__3__ here, mail z@y.io",
             "", None, "nothing to see"]
    df = pii.anonymize(_rows(spark, texts), "text", "a")
    df = pii.restore_pii(df, "a", ["a_mapping", "a_preserved"], "back")
    for r in df.collect():
        assert r.back == r.text
        for m in r.a_mapping:
            if m.entity != "PLACEHOLDER":
                assert m.original not in (r.a or "")
        if r.text and "IN0042923" in r.text:
            assert "IN0042923" in r.a
    many = df.where(F.col("id") == 1).first()
    assert [m.ph for m in many.a_mapping][-3:] == ["__PII_9__", "__PII_10__", "__PII_11__"]


def test_empty_and_null_short_circuit(spark):
    rows = pii.anonymize(_rows(spark, ["", None]), "text", "a").orderBy("id").collect()
    assert rows[0].a == "" and rows[1].a is None
    assert all(r.a_mapping == [] and r.a_preserved == [] for r in rows)


def test_mask_ids_distinct_tokens_roundtrip(spark):
    df = pii.mask_ids(_rows(spark, ["IN1234 and IN12345 and IN1234", "in0042923", "", None]), "text", "m")
    df = pii.unmask_ids(df, "m", "m_ids", "back")
    rows = df.orderBy("id").collect()
    assert rows[0].m_ids == ["IN1234", "IN12345", "IN1234"]
    assert rows[0].m.count(fixed.MASK_OPEN) == 3 and "IN" not in rows[0].m
    assert rows[1].m_ids == ["in0042923"]  # case-insensitive preservation (V5)
    assert [r.back for r in rows] == ["IN1234 and IN12345 and IN1234", "in0042923", "", ""]


def test_scoped_mappings_keep_both_values(spark):
    df = spark.createDataFrame([(1, "context mail a@b.co", "question from q@r.io")], "id int, ctx string, q string")
    df = pii.anonymize(df, "ctx", "c", scope="C")
    df = pii.anonymize(df, "q", "qq", scope="Q")
    resp = df.withColumn("resp", F.concat_ws(" | ", "c", "qq"))
    out = pii.restore_pii(resp, "resp", ["c_mapping", "qq_mapping"], "back").first()
    assert out.c == "context mail __PII_C0__" and out.qq == "question from __PII_Q0__"
    assert out.back == "context mail a@b.co | question from q@r.io"


def test_friendly_labels(spark):
    tags = ["US_SSN", "IP_ADDRESS", "IBAN_CODE", "IN_PAN", "UK_NHS", "US_BANK_NUMBER", "B"]
    want = ["[REDACTED Ssn]", "[REDACTED Address]", "[REDACTED Iban Code]", "[REDACTED PAN]",
            "[REDACTED Nhs]", "[REDACTED Bank Number]", "[REDACTED B]"]
    df = _rows(spark, [f"<{t}>" for t in tags] + ["<PERSON> <DATE_TIME> <SSN>"])
    got = df.select(pii.friendly_generic(pii.friendly_table(F.col("text"))).alias("f")).orderBy("f").collect()
    got = sorted(r.f for r in got)
    assert got == sorted(want + ["[REDACTED NAME] [REDACTED DATE/TIME] [REDACTED SSN]"])


def test_redact_labels_and_toggle(spark):
    df = _rows(spark, ["mail a@b.co on 2024-01-02 about IN0042923", "plain <PERSON> text"])
    on = pii.redact_labels(df, "text", "r").orderBy("id").collect()
    assert on[0].r == "mail [REDACTED EMAIL] on [REDACTED DATE/TIME] about IN0042923"
    assert on[1].r == "plain <PERSON> text"  # nothing detected: labels untouched
    off = pii.redact_labels(df, "text", "r", friendly=False).orderBy("id").first()
    assert off.r == "mail <EMAIL_ADDRESS> on <DATE_TIME> about IN0042923"


def test_title_case_matches_python(spark):
    words = ["BANK NUMBER", "X1Y", "A_B", "2FA CODE", "x"]
    df = _rows(spark, words)
    got = {r.text: r.t for r in df.select("text", C.title_case(F.col("text")).alias("t")).collect()}
    assert got == {w: w.title() for w in words}


def test_luhn_filter(spark):
    df = _rows(spark, ["card 4111111111111111 and 4111111111111112"])
    got = df.select(spans.resolve_spans(F.col("text"), [("CREDIT_CARD", r"\b[0-9]{13,16}\b", True)]).alias("s")).first().s
    assert [(s.s, s.e, s.entity) for s in got] == [(5, 21, "CREDIT_CARD")]


def test_frequent_words_of_names_are_split(spark):
    from pyspark.sql import functions as F

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(40_000, numPartitions=8).select(
            "id", F.concat(F.lit("the "), F.when(F.col("id") % 1000 == 0, F.lit("Ann Lee")).otherwise(F.lit("the"))).alias("text"))
        names = spark.createDataFrame([("Ann Lee",), ("Bob Ray",)], "name string")
        got = pii.detect_names(df, "id", "text", names)
        assert sorted(tuple(r) for r in got.collect()) == [(i, "Ann Lee", 1) for i in range(0, 40_000, 1000)]
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_names_dictionary(spark):
    df = _rows(spark, ["assigned to Customer#000000001, cc Ada Lovelace.", "nobody"])
    names = spark.createDataFrame([("Customer#000000001",), ("Ada Lovelace",)], "name string")
    got = sorted((r.id, r.name, r.n) for r in pii.detect_names(df, "id", "text", names).collect())
    assert got == [(0, "Ada Lovelace", 1), (0, "Customer#000000001", 1)]


def test_nested_spans_cut_to_one_placeholder(spark):
    text = "0123456789abcdefghij-rest"
    for listed, want in [([(0, 20, "A", "x"), (5, 10, "B", "y")], "__PII_0__-rest"),
                        ([(0, 10, "A", "x"), (5, 15, "B", "y")], "__PII_0__fghij-rest")]:
        df = spark.createDataFrame([(text, listed)], "t string, spans array<struct<s:int,e:int,entity:string,original:string>>")
        merged = spans.merge_spans(F.col("spans"))
        cut, originals = C.cut_spans(F.col("t"), merged, lambda x, i: C.placeholder(fixed.PII_PREFIX, "", i))
        r = df.select(cut.alias("c"), originals.alias("o")).first()
        assert r.c == want and "".join(r.o) + r.c[len("__PII_0__"):] == text


def _fold(listed):
    """Plain union of sorted spans."""
    out = []
    for s, e, kind in sorted(listed):
        if out and s < out[-1][1]:
            last = out[-1]
            if e - s > last[3]:
                last[2], last[3] = kind, e - s
            last[1] = max(last[1], e)
        else:
            out.append([s, e, kind, e - s])
    return [tuple(x) for x in out]


def test_union_equals_a_fold():
    rng = random.Random(2)
    for _ in range(300):
        rows = [[(s, s + rng.randint(1, 9), rng.randint(0, 3)) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 14)))]
                for _ in range(rng.randint(1, 5))]
        flat = np.array([(i, *x) for i, listed in enumerate(rows) for x in listed], np.int64).reshape(-1, 4).T
        got = list(zip(*(c.tolist() for c in spans.union(*flat))))
        assert got == [(i, *g) for i, listed in enumerate(rows) for g in _fold(listed)]


def test_union_of_64000_spans_is_quick():
    """A fold that copies its result would move two billion spans."""
    start = np.arange(64_000) * 20
    t = time.perf_counter()
    row, s, _, _, _ = spans.union(np.zeros(64_000, np.int64), start, start + 9, np.zeros(64_000, np.int64))
    assert len(row) == 64_000 and (s == start).all() and time.perf_counter() - t < 1


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@x.org" for i in range(20_000))
    r = pii.anonymize(_rows(spark, [text]), "text", "a").first()
    assert len(r.a_mapping) == 20_000 and r.a.endswith(" __PII_19999__") and "@" not in r.a


NAMES = ["Customer#000000001", "Ada Lovelace", "Maria de la Cruz", "Maria", "Jos\u00e9 N\u00fa\u00f1ez", "  ", ""]
NAMED = ["assigned to Customer#000000001, cc Ada Lovelace.", "Customer#0000000012 xAda Lovelace", "(Maria de la Cruz)", "Maria de la",
         "\u00bf Jos\u00e9 N\u00fa\u00f1ez?", "", None, "a@b.co Ada Lovelace a@b.co"]
HIDDEN = ["assigned to __PII_0__, cc __PII_1__.", NAMED[1], "(__PII_0__)", "__PII_0__ de la", "\u00bf __PII_0__?", "", None,
          "__PII_0__ __PII_1__ __PII_2__"]


@pytest.mark.parametrize("most", [100, 0])
def test_names_are_hidden(spark, monkeypatch, most):
    """Names of any number of words, delimited; broadcast, and joined by the first word beyond the bound."""
    monkeypatch.setattr(pii, "MAX_NAMES", most)
    names = spark.createDataFrame([(n,) for n in NAMES + NAMES], "name string")
    df = pii.anonymize(_rows(spark, NAMED), "text", "a", names=names, key="id")
    assert "_a_names" not in df.columns
    got = {r.id: r for r in pii.restore_pii(df, "a", ["a_mapping", "a_preserved"], "back").collect()}
    assert [got[i].a for i in range(len(NAMED))] == HIDDEN
    assert [got[i].back for i in range(len(NAMED))] == NAMED
    assert {m.entity for m in got[0].a_mapping} == {"PERSON"}


def test_names_shown_in_long_texts(spark):
    """Each name once a text; 40,000 different words are no pairs to compare."""
    import time

    from scrubsearch.plans.catalog import names_shown

    names = spark.createDataFrame([("Ann",), ("Ann",), ("Bob",), ("Cy",)], "name string")
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, "Ann met Ann\nand Bob", "__PII_C0__ met Cy Cy"), (2, "nobody", "nobody"), (3, None, None), (4, f"{long} Bob", long),
            (5, None, "Ann"), (6, "Ann Bob", None), (1, "Ann Cy", "Ann")]
    prompts = spark.createDataFrame(rows, "query_id long, context string, prompt string")
    began = time.time()
    got = {tuple(r) for r in names_shown(prompts, names).collect()}
    assert got == {(1, 4, 2), (2, 0, 0), (4, 1, 0)}
    assert time.time() - began < 12
