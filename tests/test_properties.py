"""Properties of the PII chain on generated texts (one Spark job, fixed seed)."""

import random
from collections import Counter

from scrubsearch.functions import fixed
from scrubsearch.operators import pii

FRAGMENTS = ["a@b.co", "x.y@mail.example.org", "IN0042923", "in12345", "IN1234", "+1 (555) 555-1234",
             "4111111111111111", "10.0.0.1", "123-45-6789", "2024-01-02", "ABCDE1234F", "__PII_0__",
             "__PII_C3__", "__PRESERVED__1__", fixed.MASK_OPEN + "0" + fixed.MASK_CLOSE, "<PERSON>",
             "word", "é", " ", "\n", "-", "_", "#", "1", "ticket"]


def test_roundtrip_and_every_detected_span_removed(spark):
    rnd = random.Random(20261202)
    batch = ["".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randint(0, 8))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(batch)), "id int, text string")
    df = pii.anonymize(df, "text", "a", scope="C")
    df = pii.restore_pii(df, "a", ["a_mapping", "a_preserved"], "back")
    for r in df.collect():
        # restore(anonymize(t)) == t
        assert r.back == r.text
        # each detected occurrence is gone (the same string may remain where
        # the pattern does not match, e.g. "10.0.0.1_" has no word boundary)
        per_value = Counter(m.original for m in r.a_mapping if m.entity != "PLACEHOLDER")
        for value, n in per_value.items():
            if fixed.MASK_OPEN not in value:
                assert r.a.count(value) <= r.text.count(value) - n
        # preserved ticket ids stay readable in the anonymized text
        for t in r.a_preserved:
            assert t.original in r.a or fixed.MASK_OPEN in t.original
