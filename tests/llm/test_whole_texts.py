"""Samples from whole texts, ids with several texts, extraction by windows and in linear time."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubsearch.llm import bytecnn, langid, linecut, neardup
from scrubsearch.llm.common import drawn_part

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


# --- training samples ------------------------------------------------------------

def test_drawn_part_comes_from_all_over(spark):
    text = "".join(chr(0x4E00 + i) for i in range(8_000))  # each character is its own place
    rows = frame(spark, [(1, text), (2, "short"), (3, ""), (4, None), (5, text[:400])])
    got = {r[0]: r[1] for r in rows.select("doc_id", drawn_part(F.col("text"), 400)).collect()}
    assert got[2] == "short" and got[3] == "" and got[4] is None and got[5] == text[:400]
    runs = got[1].split("\n")
    assert [len(r) for r in runs] == [100] * 4
    assert all(r in text and text.index(r) // 2_000 == k for k, r in enumerate(runs))


def _late(label):
    return "neutral words here " * 600 + ("zzqx " if label else "good ") * 2_500


def test_quality_signal_behind_ten_thousand_characters(spark):
    docs = frame(spark, [(i, _late(i % 2) + str(i)) for i in range(160)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    net = bytecnn.train(*bytecnn.sample(docs, labels))
    assert net.score(_late(1)) > 0.7 and net.score(_late(0)) < 0.3


def test_quality_sample_of_repeated_and_conflicting_rows(spark):
    docs = frame(spark, [(i, f"text {i} of many") for i in range(60)] + [(3, "another text of three")] * 40 + [(None, "x"), (8, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 30 + [(5, 0), (None, 1), (6, None), (7, 9)],
                                   "doc_id long, quality int")
    once = bytecnn.sample(docs, labels)
    assert once == bytecnn.sample(docs.repartition(7), labels.repartition(3))
    assert len(once[0]) == len(set(once[0]))  # one text an id, whatever repeats
    few = bytecnn.sample(docs, labels, rows=20)
    assert 5 <= len(few[0]) <= 40
    none = bytecnn.train(*bytecnn.sample(docs, labels.where(F.lit(False))))
    assert bytecnn.score_quality(docs, none).count() == docs.count()


def test_language_signal_behind_ten_thousand_characters(spark):
    late = {"aa": "qoqo wexi ", "bb": "tuma rilu "}
    rows = [(i, "1234 5678 " * 1_200 + late[g] * 1_500, g, "s", 0) for i in range(12) for g in late]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train_text_model(df, "text", "lang")
    for g, t in late.items():
        score, _ = model.score(t * 20)
        assert model.langs[int(np.argmax(score[:2]))] == g


# --- near-duplicates ---------------------------------------------------------------

def test_ids_with_different_texts_keep_all_links(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(rng.choice(words) for _ in range(90))
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (5, b), (5, c), (7, near(a)), (8, near(b)), (9, near(c)), (4, d), (4, a), (6, near(d)), (3, ""), (3, c)]
    want = {1: 1, 7: 1, 4: 1, 6: 1, 5: 3, 8: 3, 9: 3, 3: 3}
    for parts in (1, 6):
        found = neardup.near_duplicates(frame(spark, rows).repartition(parts), shingle_words=4).collect()
        assert {(r.doc_id, r.component_id) for r in found} == set(want.items())
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_the_row_that_stays_of_a_repeated_id_is_fixed(spark):
    rows = [(1, f"text number {k} " + "filler " * 3) for k in range(20)] + [(2, "single")] + [(None, "x"), (None, "x")]
    kept = [sorted(map(str, neardup.drop_near_duplicates(frame(spark, rows).repartition(n)).collect())) for n in (1, 5, 9)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 4


# --- extraction ----------------------------------------------------------------------

BODY = "word " * 180


def plain_stretches(weights):
    """Windows line by line: kept from a surge to the dive, trimmed to lines with weight."""
    n, half, out, k = len(weights), linecut.WINDOW // 2, [], 0
    window = [sum(weights[max(0, i - half): i + half + 1]) for i in range(n)]
    while k < n:
        if window[k]:
            stop = k
            while stop < n and window[stop]:
                stop += 1
            full = [i for i in range(k, stop) if weights[i]]
            out.append((full[0], full[-1] + 1))
            k = stop
        k += 1
    return out


def test_stretches_equal_plain_windows():
    rng = random.Random(4)
    for _ in range(500):
        weights = [rng.choice([0, 0, 0, 3, 50]) for _ in range(rng.randint(0, 25))]
        assert linecut.stretches(np.array(weights, np.int64)) == plain_stretches(weights)


def test_a_marked_card_does_not_hide_the_body():
    page = f'<div><article class="teaser"><p>short short short</p></article></div><div id=content><p>{BODY}</p></div>'
    assert linecut.main_text(page) == "short short short\n" + BODY.strip()


def test_a_short_paragraph_before_a_link_list_stays():
    links = "".join(f"<li><a href=x>link {i}</a></li>" for i in range(5))
    assert linecut.main_text(f"<div><p>{'a' * 31}</p><ul>{links}</ul><p>{BODY}</p></div>") == "a" * 31 + "\n" + BODY.strip()


def test_link_lines_inside_text_stay_and_outside_go():
    inside = f"<p>{BODY}</p><p><a href=x>all link</a></p><p>{BODY}</p>"
    assert linecut.main_text(f"<body>{inside}</body>").count("all link") == 1
    menu = "".join(f"<div><a href=x>item {i}</a></div>" for i in range(6))
    assert "item" not in linecut.main_text(f"<body>{menu}{inside}{menu}</body>")


@pytest.mark.parametrize("page", ["<a" * 200_000, '<a "' * 150_000, "<!" * 300_000, "<div>" * 60_000 + "</span>" * 50_000,
                                  '<div class="nav">' * 40_000, "<li><ul>" + "<div>" * 40_000 + "<li>a</li>" * 40_000,
                                  "<div " + "a" * 400_000 + ">", "<!--" * 150_000, '<div class="nav"><article>' * 20_000])
def test_hostile_markup_takes_linear_time(page):
    start = time.perf_counter()
    linecut.main_text(page)
    assert time.perf_counter() - start < 10  # quadratic scanners need minutes


def test_a_kept_column_may_be_called_like_ours(spark):
    pages = spark.createDataFrame([(1, "mine", "<p>Some text here</p>")], "page_id long, _html string, html string")
    row = linecut.extract_text(pages, keep=["page_id", "_html"]).first()
    assert (row["page_id"], row["_html"], row["text"]) == (1, "mine", "Some text here")
