"""The classifier's forward pass and the language posterior, written out in plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubsearch.llm import bytecnn, langid

SCHEMA = "doc_id long, text string, lang string, host string"


def plain_score(net, text):
    raw = text.encode()
    step = bytecnn.CHUNK - bytecnn.OVERLAP
    pooled, at = [], 0
    while True:
        chunk = raw[at:at + bytecnn.CHUNK].ljust(bytecnn.CHUNK, b"\0")
        best = []
        for f in range(bytecnn.FILTERS):
            values = [net.bias[f] + sum(float(net.embed[b] @ net.filters[w * bytecnn.EMBED:(w + 1) * bytecnn.EMBED, f])
                                        for w, b in enumerate(chunk[k:k + bytecnn.WIDTH]))
                      for k in range(0, bytecnn.CHUNK - bytecnn.WIDTH + 1, bytecnn.STRIDE)]
            best.append(max(0.0, max(values)))
        pooled.append(best)
        at += step
        if at + bytecnn.OVERLAP >= len(raw):
            break
    features = [max(c) for c in zip(*pooled)] + [sum(c) / len(pooled) for c in zip(*pooled)]
    hidden = [math.tanh(sum(x * float(net.hidden[i, h]) for i, x in enumerate(features)) + float(net.hidden_bias[h]))
              for h in range(bytecnn.HIDDEN)]
    z = sum(x * float(net.out[h]) for h, x in enumerate(hidden)) + float(net.out_bias[0])
    return 1 / (1 + math.exp(-z))


@pytest.mark.parametrize("size", [0, 5, 512, 513, 900, 1100])
def test_forward_pass(size):
    rng = random.Random(size)
    net = bytecnn._new(np.random.default_rng(3))
    text = "".join(rng.choice("abc dé\n#") for _ in range(size))
    assert net.score(text) == pytest.approx(plain_score(net, text), abs=1e-4)


def plain_identify(rows, model):
    langs, votes = model.langs, []
    scored = [model.score(r["text"] or "") for r in rows]

    def keys(r):
        host = (r["host"] or "").lower()
        labels = host.split(".")
        tag = (r["lang"] or "").lower()
        return host, ".".join(labels[-2:]) if len(labels) > 1 else host, labels[-1] if len(labels) > 1 else "", tag

    for r, (ll, n) in zip(rows, scored):
        if n >= langid.MIN_TRIGRAMS:
            votes.append((*keys(r), int(np.argmax(ll))))
    k = range(len(langs))

    def counts(col):
        out = {}
        for v in votes:
            out.setdefault(v[col], [0] * len(langs))[v[4]] += 1
        return out

    total = [sum(v[4] == i for v in votes) for i in k]
    base = [(c + 1) / (len(votes) + len(langs)) for c in total]
    base[-1] = max(base[-1], langid.UNKNOWN_PRIOR)
    base = [b / sum(base) for b in base]

    def share(col):
        table = {v: c for v, c in counts(col).items() if v}
        return {v: [math.log((c[i] + 1) / (total[i] + len(table) + 1)) for i in k] for v, c in table.items()}

    tags, suffixes, domains, hosts = share(3), share(2), counts(1), counts(0)
    flat, out = [0.0] * len(langs), []
    for r, (ll, n) in zip(rows, scored):
        host, domain, suffix, tag = keys(r)
        if host in hosts:
            d = [(domains[domain][i] + langid.KAPPA * base[i]) / (sum(domains[domain]) + langid.KAPPA) for i in k]
            prior = [math.log((hosts[host][i] + langid.KAPPA * d[i]) / (sum(hosts[host]) + langid.KAPPA))
                     + suffixes.get(suffix, flat)[i] for i in k]
        else:
            prior = [math.log(b) for b in base]
        total_ll = [langid.TEMPER * ll[i] + prior[i] + tags.get(tag, flat)[i] for i in k]
        top = max(total_ll)
        best, posterior = langs[total_ll.index(top)], 1 / sum(math.exp(x - top) for x in total_ll)
        out.append((r["doc_id"], *((best, posterior) if n else (langid.UNKNOWN, 1.0))))
    return out


def test_posterior_equals_plain_bayes(spark):
    """Tags that lie, hosts of one domain, suffixes, short texts that only the other evidence decides."""
    rng = random.Random(8)
    words = {"de": "der und nicht straße schön wir haben", "en": "the and not street nice we have", "fr": "les est pas rue belle nous avons"}
    rows = []
    for i in range(240):
        g = rng.choice(list(words))
        n = rng.choice([0, 1, 2, 12, 40])
        text = " ".join(rng.choice(words[g].split()) for _ in range(n)) or rng.choice([None, "", "1234 !!"])
        tag = rng.choice([g, g, rng.choice(list(words)), None, "x"])
        host = rng.choice([f"www.news.{g}", f"blog.news.{g}", "a.example.com", f"host{i}.example.com", "intranet", None])
        rows.append((i, text, tag, host))
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train_text_model(df, "text", "lang")
    got = {r.doc_id: (r.lid_lang, r.lid_posterior) for r in langid.identify(df, "text", "lang", "host", model)
           .select("doc_id", "lid_lang", "lid_posterior").where(F.col("doc_id").isNotNull()).collect()}
    listed = [dict(zip(("doc_id", "text", "lang", "host"), r)) for r in rows]
    for r in listed:  # a tag of the markup has two or three letters
        r["lang"] = r["lang"] if r["lang"] and len(r["lang"]) in (2, 3) else None
    for doc_id, lang, posterior in plain_identify(listed, model):
        assert got[doc_id][0] == lang and got[doc_id][1] == pytest.approx(posterior, rel=1e-6), doc_id
