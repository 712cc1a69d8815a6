"""Operator 1: language identification by Bayesian evidence fusion.

log P(lang | everything) is, up to a constant, the sum of
  - the text's log likelihood: letter trigrams under one smoothed table per
    language, tempered because neighbouring trigrams are not independent;
  - log P(declared tag | lang), for the language tag of the markup;
  - log P(address suffix | lang), for the last label of the host;
  - the log prior of the host, smoothed towards its domain, and that towards
    the whole corpus.
The trigram tables are learned from a bounded sample of tagged rows. The other
three are counts over all rows, by grouped aggregation of the language that the
text alone suggests. One more class, UNKNOWN, stands for text of no language:
all trigrams are equally likely under it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubsearch.llm.common import as_text, cut, drawn_part, fresh, lookup, release_models

UNKNOWN = "und"
SAMPLE_ROWS = 8_000       # tagged rows to learn trigrams from, about, dealt among the tags
SAMPLE_CHARS = 4_000      # of the text of each of them
MIN_LANG_ROWS = 5         # a tag on fewer rows of the whole table is no language of the model
BUCKETS = 1 << 15
ALPHA = 0.05              # pseudo-count of a trigram bucket
TEMPER = 0.3              # weight of a trigram's log likelihood
MIN_TRIGRAMS = 20         # fewer do not vote in the corpus counts
KAPPA = 20.0              # strength of a parent's prior, in documents
UNKNOWN_PRIOR = 0.01
MIN_POSTERIOR = 0.5
BLOCK = 1 << 20           # bytes of a text that are looked at together

# Fixed: bytes that count as letters once a text is in lower case.
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"): ord("z") + 1] = True
_LETTER[0x80:] = True


def trigram_blocks(text: str):
    """Buckets of the letter trigrams of a text, block by block.

    Everything but letters counts as one space; trigrams without a letter in
    the middle are left out.
    """
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(raw), BLOCK):
        b = raw[max(0, at - 2): at + BLOCK]
        letter = _LETTER[b]
        b = np.where(letter, b, 32).astype(np.uint32)
        if at == 0:
            b, letter = np.concatenate([[np.uint32(32)], b]), np.concatenate([[False], letter])
        if at + BLOCK >= len(raw):
            b, letter = np.concatenate([b, [np.uint32(32)]]), np.concatenate([letter, [False]])
        if len(b) < 3:
            continue
        codes = (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[letter[1:-1]]
        yield (codes * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


@dataclass
class TextModel:
    langs: list[str]          # the last one is UNKNOWN
    table: np.ndarray         # bucket x language: log probability, float32

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """Log likelihood of each language, and the number of trigrams."""
        total, n = np.zeros(len(self.langs)), 0
        for codes in trigram_blocks(text):
            total += self.table[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        return total, n


def primary_tag(tag: Column) -> Column:
    """``fr`` of ``FR-ca``; null where there is no such tag."""
    tag = F.regexp_extract(F.lower(F.trim(tag.cast("string"))), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag)


def _quotas(sizes: dict[str, int], rows: int) -> dict[str, int]:
    """About ``rows`` dealt to tags that have ``sizes`` texts; what small tags leave goes to larger ones."""
    out: dict[str, int] = {}
    for k, (tag, n) in enumerate(sorted(sizes.items(), key=lambda s: (s[1], s[0]))):
        out[tag] = min(n, max(MIN_LANG_ROWS, rows // (len(sizes) - k)))
        rows = max(0, rows - out[tag])
    return out


def train_text_model(df: DataFrame, text: str, tag: str, rows: int = SAMPLE_ROWS,
                     chars: int = SAMPLE_CHARS) -> TextModel:
    """Trigram tables of the languages declared on ``MIN_LANG_ROWS`` rows of the whole table.

    Every such tag gets its share of a sample of about ``rows`` texts, or all
    its texts if they are fewer, so which languages exist does not depend on
    the size of the table. Texts are chosen by a hash, so reruns agree; copies
    of a text under one tag are learned once. Without any tagged row only
    UNKNOWN is left.
    """
    cells = 1 << 40
    tagged = df.select(primary_tag(F.col(tag)).alias("tag"), F.col(text).alias("text")).where(
        (F.col("tag") != UNKNOWN) & (F.length("text") > 0)).withColumn("cell", F.pmod(F.xxhash64("text"), F.lit(cells)))
    found = (tagged.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("texts"))
             .where(F.col("n") >= MIN_LANG_ROWS).collect())  # one row per language
    sizes = {r["tag"]: r["texts"] for r in found}
    counts = {t: np.zeros(BUCKETS) for t in sizes}
    if sizes:
        # All texts of a small tag; of others some more than the quota, which is then cut to.
        quotas = _quotas(sizes, rows)
        limits = [(t, cells if q == sizes[t] else int(cells * min(1.0, (q + 4 * math.sqrt(q)) / sizes[t])))
                  for t, q in quotas.items()]
        table = df.sparkSession.createDataFrame(limits, "tag string, below long")
        picked = (tagged.join(F.broadcast(table), "tag").where(F.col("cell") < F.col("below"))
                  .groupBy("tag", "cell").agg(F.min(drawn_part(F.col("text"), chars)).alias("text")).collect())
        for row in sorted(picked, key=lambda r: (r["tag"], r["cell"])):
            if quotas[row["tag"]] > 0:
                quotas[row["tag"]] -= 1
                for codes in trigram_blocks(row["text"]):
                    counts[row["tag"]] += np.bincount(codes, minlength=BUCKETS)
    langs = sorted(counts)
    columns = [np.log((counts[t] + ALPHA) / (counts[t].sum() + ALPHA * BUCKETS)) for t in langs]
    columns.append(np.full(BUCKETS, -math.log(BUCKETS)))
    return TextModel([*langs, UNKNOWN], np.stack(columns, axis=1).astype(np.float32))


def _score_udf(spark, model: TextModel):
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats

    @F.pandas_udf("n long, ll array<double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        release_models(__name__)
        got = [shared.value.score(as_text(t)) for t in texts]
        return pd.DataFrame({"n": [n for _, n in got], "ll": [ll for ll, _ in got]})

    return score


def _best(values: Column, langs: list[str]) -> Column:
    """The language of the largest entry; the first of equal ones."""
    return F.element_at(F.array(*map(F.lit, langs)), F.array_position(values, F.array_max(values)).cast("int"))


def _evidence(df: DataFrame, model: TextModel, text: str, declared: str | None, host: str | None) -> DataFrame:
    name = F.lower(F.coalesce(F.col(host).cast("string"), F.lit(""))) if host else F.lit("")
    labels = F.split(name, r"\.")
    tag = primary_tag(F.col(declared)) if declared else F.lit(None).cast("string")
    return df.select(
        F.col("*"), _score_udf(df.sparkSession, model)(F.col(text)).alias("li_text"),
        F.coalesce(tag, F.lit("")).alias("li_tag"), name.alias("li_host"),
        F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(name).alias("li_domain"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise("").alias("li_suffix"),
    )


@dataclass
class Priors:
    tags: DataFrame     # li_tag -> li_tag_ll
    hosts: DataFrame    # li_host -> li_host_ll, the suffix's evidence included
    base: list[float]   # log prior of each language, for hosts without votes


def learn_priors(evidence: DataFrame, langs: list[str]) -> Priors:
    """Counts over all rows: by tag, suffix, domain and host.

    Every table has one row per distinct value and is checkpointed.
    """
    vote = _best(F.col("li_text.ll"), langs)
    counts = cut(evidence.where(F.col("li_text.n") >= MIN_TRIGRAMS)
                 .groupBy("li_host", "li_domain", "li_suffix", "li_tag", vote.alias("li_lang"))
                 .agg(F.count("*").alias("n")))
    per_lang = [F.coalesce(F.sum(F.when(F.col("li_lang") == g, F.col("n"))), F.lit(0)).cast("double")
                .alias(f"c{k}") for k, g in enumerate(langs)]

    def by(*keys: str) -> DataFrame:
        return counts.groupBy(*keys).agg(*per_lang)

    k = range(len(langs))
    total = counts.agg(*per_lang).first()  # one number per language
    total = [total[i] or 0.0 for i in k]
    # Base rate of a language: its share, with UNKNOWN held at its prior at least.
    base = [(c + 1.0) / (sum(total) + len(langs)) for c in total]
    base[-1] = max(base[-1], UNKNOWN_PRIOR)
    base = [b / sum(base) for b in base]

    def share(table: DataFrame, key: str, out: str) -> DataFrame:
        """log P(value | lang), with one pseudo-count per value and language."""
        n = table.count()
        lls = [F.log((F.col(f"c{i}") + 1.0) / F.lit(total[i] + n + 1.0)) for i in k]
        return table.select(key, F.array(*lls).alias(out))

    tags = cut(share(by("li_tag").where("li_tag <> ''"), "li_tag", "li_tag_ll"))
    suffixes = cut(share(by("li_suffix").where("li_suffix <> ''"), "li_suffix", "li_suffix_ll"))
    size = lambda: sum((F.col(f"c{i}") for i in k), F.lit(0.0))
    domains = cut(by("li_domain").select("li_domain", *[
        ((F.col(f"c{i}") + KAPPA * base[i]) / (size() + KAPPA)).alias(f"d{i}") for i in k]))
    hosts = lookup(lookup(by("li_host", "li_domain", "li_suffix"), domains, "li_domain"), suffixes, "li_suffix")
    flat = F.array(*[F.lit(0.0)] * len(langs))
    prior = F.array(*[F.log((F.col(f"c{i}") + KAPPA * F.col(f"d{i}")) / (size() + KAPPA)) for i in k])
    hosts = cut(hosts.select("li_host", F.zip_with(
        prior, F.coalesce("li_suffix_ll", flat), lambda a, b: a + b).alias("li_host_ll")))
    return Priors(tags, hosts, [math.log(b) for b in base])


def identify(df: DataFrame, text: str = "text", declared: str | None = "lang", host: str | None = None,
             model: TextModel | None = None, prefix: str = "lid_") -> DataFrame:
    """``df`` plus <prefix>lang, <prefix>posterior, <prefix>text_lang, <prefix>trigrams, <prefix>accepted.

    lang is the likeliest language (UNKNOWN for none), posterior its
    probability, text_lang what the text alone says. accepted is false for text
    without letters (null and empty ones too), for UNKNOWN, and below
    ``MIN_POSTERIOR``. A null or odd tag and a null host are no evidence; equal
    scores go to the first language in name order. Repeated rows stay. Columns
    of ``df`` with one of the five result names, or starting with li_, are
    replaced; all others are kept.
    """
    model = model or train_text_model(df, text, declared)
    langs = model.langs
    results = [prefix + c for c in ("lang", "posterior", "text_lang", "trigrams", "accepted")]
    df = df.drop(*[c for c in df.columns if c in results or c.startswith("li_")])
    evidence = _evidence(df, model, text, declared, host)
    # Pass one reads the texts for the counts, pass two to score: no text is shuffled.
    needed = evidence.select("li_text", "li_tag", "li_host", "li_domain", "li_suffix")
    priors = learn_priors(needed, langs)
    rows = lookup(lookup(evidence, priors.hosts, "li_host"), priors.tags, "li_tag")
    flat = F.array(*[F.lit(0.0)] * len(langs))
    add = lambda a, b: a + b
    total = F.transform(F.col("li_text.ll"), lambda x: x * TEMPER)
    total = F.zip_with(total, F.coalesce("li_host_ll", F.array(*map(F.lit, priors.base))), add)
    total = F.zip_with(total, F.coalesce("li_tag_ll", flat), add)
    rows = rows.withColumn("li_total", total).withColumn("li_top", F.array_max("li_total"))
    rows = rows.withColumn("li_sum", F.aggregate(
        F.zip_with("li_total", F.array_repeat("li_top", len(langs)), lambda a, top: F.exp(a - top)),
        F.lit(0.0), add))
    empty = F.col("li_text.n") == 0
    best = F.when(empty, F.lit(UNKNOWN)).otherwise(_best(F.col("li_total"), langs))
    posterior = F.when(empty, F.lit(1.0)).otherwise(1.0 / F.col("li_sum"))
    said = F.when(empty, F.lit(UNKNOWN)).otherwise(_best(F.col("li_text.ll"), langs))
    out = rows.withColumns(dict(zip(results, [
        best, posterior, said, F.col("li_text.n"),
        (best != UNKNOWN) & (posterior >= MIN_POSTERIOR)], strict=True)))
    return out.select(*df.columns, *results)


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` plus page_tag (lang of the html element) and page_host (of the address)."""
    tag, host = fresh(pages, "page_tag", "page_host")
    return pages.withColumns({
        tag: F.regexp_extract(F.col(html), r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3}[A-Za-z0-9_-]*)""", 1),
        host: F.regexp_extract(F.col(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1),
    })


def keep_identified(docs: DataFrame, text: str = "text", declared: str | None = "lang",
                    host: str | None = "source", **options) -> DataFrame:
    """The accepted rows of ``docs``, with its columns."""
    prefix, = fresh(docs, "lid_keep_")
    found = identify(docs, text, declared, host, prefix=prefix, **options)
    return found.where(prefix + "accepted").select(*docs.columns)
