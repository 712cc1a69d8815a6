"""Preserve, detect, resolve, anonymize with a mapping, redact, restore.

The whole chain is per row, with no shuffle (except the join of a name
dictionary too large to broadcast). Spans are found and united by one Arrow
function over a batch of texts (functions.spans); masking, cutting and
restoring are expressions inside the JVM. Intermediate arrays are materialized
as columns step by step so each regex runs once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubsearch.functions import columns as C
from scrubsearch.functions import fixed, spans
from scrubsearch.session import ship_package

MAX_NAMES = 100_000  # names that are broadcast; more are joined to the texts by their first word
_OUTER = r"^[\"'(\[]+|[\"'.,;:!?)\]]+$"


def _blank(text: Column) -> Column:
    return text.isNull() | (text == "")


def mask_ids(df: DataFrame, text: str, out: str) -> DataFrame:
    """A1 (boundary-safe form): every occurrence of a ticket id gets its own
    mask token; ``<out>_ids`` keeps the originals in order."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(f"{out}_ids", C.matches(t, fixed.PRESERVE))
    return df.withColumn(out, C.interleave(
        C.pieces(t, fixed.PRESERVE), F.transform(F.col(f"{out}_ids"), lambda m, i: C.mask_token(i))))


def unmask_ids(df: DataFrame, masked: str, ids: str, out: str) -> DataFrame:
    """Put the preserved ids back."""
    return df.withColumn(out, C.unmask_preserved(F.col(masked), F.col(ids)))


def detectors_for(lang: str | None = None):
    return fixed.LANG_DETECTORS.get(lang, fixed.DETECTORS) if lang else fixed.DETECTORS


def known_names(df: DataFrame, text: str, names: DataFrame, key: str | None, found: str):
    """What ``spans.resolve_spans`` needs to find the names (column ``name``): (df, broadcast list, column of candidates).

    Up to MAX_NAMES names are broadcast. More are joined: a text's distinct
    words meet the first words of the names, and its row gets the names that
    it may hold as column ``found``; ``key`` tells the rows apart."""
    listed = names.select("name").where(F.length(F.trim("name")) > 0).distinct()
    few = [r[0] for r in listed.limit(MAX_NAMES + 1).collect()]
    if len(few) <= MAX_NAMES:
        return df, df.sparkSession.sparkContext.broadcast(sorted(few)), None
    if key is None:
        raise ValueError("a dictionary of this size needs the key of the texts")
    bare = lambda w: F.regexp_replace(w, _OUTER, "")
    words = F.array_distinct(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+", -1), bare))
    first = listed.withColumn("_word", bare(F.split(F.trim("name"), r"\s+", 2)[0]))
    held = (df.select(key, F.explode_outer(words).alias("_word")).join(first, "_word")
            .groupBy(key).agg(F.collect_set("name").alias(found)))
    return df.join(held, key, "left"), None, F.col(found)


def anonymize(df: DataFrame, text: str, out: str, scope: str = "", detectors=None,
              escape: bool = True, labels: bool = False, names: DataFrame | None = None,
              key: str | None = None) -> DataFrame:
    """A1 + A2 + A3 + A4 + A9 (+ A10): reversible anonymization.

    Adds ``<out>`` (anonymized text), ``<out>_mapping``
    ARRAY<STRUCT<ph, original, entity>> in placeholder order and
    ``<out>_preserved`` ARRAY<STRUCT<ph, original>>. Placeholders are
    __PII_<scope><n>__ numbered by position from 0 (scope letter: deviation
    V1). With ``labels=True`` spans become ``<ENTITY>`` instead (A5).
    ``names``: a dictionary (column ``name``) whose entries, of any number of
    words, are hidden too, as PERSON (A2b); see ``known_names`` for ``key``.
    Null or empty text is returned unchanged with empty arrays (A10).
    """
    ship_package(df.sparkSession)
    dets = list(detectors or fixed.DETECTORS)
    if escape and not labels:
        dets.append(fixed.PLACEHOLDER_DETECTOR)
    t = F.coalesce(F.col(text), F.lit(""))
    ids_c, masked_c, merged_c, cut_c, orig_c = (f"_{out}_{x}" for x in ("ids", "masked", "merged", "cut", "orig"))
    df = df.withColumn(ids_c, C.matches(t, fixed.PRESERVE))
    df = df.withColumn(masked_c, C.interleave(
        C.pieces(t, fixed.PRESERVE), F.transform(F.col(ids_c), lambda m, i: C.mask_token(i))))
    shared = candidates = None
    if names is not None:
        df, shared, candidates = known_names(df, masked_c, names, key, f"_{out}_names")
    df = df.withColumn(merged_c, spans.resolve_spans(F.col(masked_c), dets, shared, candidates))
    if labels:
        fill = lambda x, i: F.concat(F.lit("<"), x["entity"], F.lit(">"))
    else:
        fill = lambda x, i: C.placeholder(fixed.PII_PREFIX, scope, i)
    cut, originals = C.cut_spans(F.col(masked_c), F.col(merged_c), fill)
    df = df.withColumn(cut_c, cut).withColumn(orig_c, originals)
    ids = F.col(ids_c)
    z = F.arrays_zip(F.col(merged_c).alias("x"), F.col(orig_c).alias("o"), C._rep(ids, F.col(merged_c)).alias("ids"))
    df = (df.withColumn(out, F.when(_blank(F.col(text)), F.col(text))
                        .otherwise(C.unmask_preserved(F.col(cut_c), ids)))
          .withColumn(f"{out}_mapping", F.transform(z, lambda y, i: F.struct(
              C.placeholder(fixed.PII_PREFIX, scope, i).alias("ph"),
              F.when(F.contains(y["o"], F.lit(fixed.MASK_OPEN)), C.unmask_preserved(y["o"], y["ids"]))
              .otherwise(y["o"]).alias("original"),
              y["x"]["entity"].alias("entity"))))
          .withColumn(f"{out}_preserved", C.preserved_pairs(ids, scope)))
    return df.drop(ids_c, masked_c, merged_c, cut_c, orig_c, f"_{out}_names")


def friendly_table(text: Column) -> Column:
    """Fixed label table, literal replacements in order."""
    out = text
    for tag, label in fixed.FRIENDLY_LABELS:
        out = F.replace(out, F.lit(tag), F.lit(label))
    return out


def friendly_label(tag: Column) -> Column:
    out = C.title_case(F.replace(F.regexp_replace(tag, fixed.GENERIC_TAG_PREFIX, ""), F.lit("_"), F.lit(" ")))
    for name, label in fixed.SPECIAL_LABELS:
        out = F.when(tag == F.lit(name), F.lit(label)).otherwise(out)
    return out


def friendly_generic(text: Column) -> Column:
    """Every remaining <TAG> (also ones already in the source text)."""
    pat = "<[A-Z0-9_]+>"
    return C.replace_matches(text, pat, lambda m, i: F.concat(
        F.lit("[REDACTED "), friendly_label(F.regexp_extract(m, fixed.GENERIC_TAG, 1)), F.lit("]")))


def redact_labels(df: DataFrame, text: str, out: str, friendly: bool = True, detectors=None) -> DataFrame:
    """A5 (+A6, A7, A8): irreversible redaction to <ENTITY>; ids preserved;
    friendly labels only when something was detected."""
    df = anonymize(df, text, f"_{out}_raw", detectors=detectors, escape=False, labels=True)
    raw = F.col(f"_{out}_raw")
    found = F.size(F.col(f"_{out}_raw_mapping")) > 0
    value = F.when(found, friendly_generic(friendly_table(raw))).otherwise(raw) if friendly else raw
    return (df.withColumn(out, value)
            .drop(f"_{out}_raw", f"_{out}_raw_mapping", f"_{out}_raw_preserved"))


def detect_counts(df: DataFrame, key: str, text: str, detectors=None, lang: str | None = None) -> DataFrame:
    """A2 (+A14): (key, entity, n) match counts per detector, n > 0.

    With ``lang`` naming a column, each row uses its language's detectors."""
    t = F.coalesce(F.col(text), F.lit(""))
    cols = []
    for ent, pat, luhn in (detectors or fixed.DETECTORS):
        ms = C.matches(t, pat)
        if luhn:
            ms = F.filter(ms, C.luhn_ok)
        n = F.when(C.may_match(t, ent), F.size(ms)).otherwise(F.lit(0))
        if lang is not None:
            allowed = [lg for lg, dets in fixed.LANG_DETECTORS.items() if any(d[0] == ent for d in dets)]
            n = F.when(F.col(lang).isin(allowed) | ~F.col(lang).isin(list(fixed.LANG_DETECTORS)), n).otherwise(F.lit(0))
        cols.append(F.struct(F.lit(ent).alias("entity"), n.cast("long").alias("n")))
    keep = [key] + ([lang] if lang else [])
    return (df.select(*keep, F.explode_outer(F.array(*cols)).alias("d"))
            .select(*keep, "d.entity", "d.n").where(F.col("n") > 0))


def resolved_spans(df: DataFrame, key: str, text: str, detectors=None) -> DataFrame:
    """A3 as a table: (key, n, s, e, entity) merged spans as character
    offsets of the id-masked text (equal to the original's when it holds no id)."""
    t = F.coalesce(F.col(text), F.lit(""))
    masked, _ = C.mask_preserved(t)
    dets = list(detectors or fixed.DETECTORS) + [fixed.PLACEHOLDER_DETECTOR]
    ship_package(df.sparkSession)
    merged = (df.select(key, masked.alias("_masked"))
              .select(key, "_masked", spans.resolve_spans(F.col("_masked"), dets).alias("m")))
    ex = merged.select(key, "_masked", F.posexplode_outer("m").alias("n", "x")).where(F.col("x").isNotNull())
    s = C.char_offset(F.col("_masked"), F.col("x.s"))
    return ex.select(key, F.col("n").cast("long").alias("n"), s.cast("long").alias("s"),
                     (s + F.col("x.e") - F.col("x.s")).cast("long").alias("e"), F.col("x.entity").alias("entity"))


def restore_pii(df: DataFrame, text: str, pairs: list[str], out: str, enabled: bool = True) -> DataFrame:
    """A12 (+A13): restore placeholders from one or more mapping columns."""
    if not enabled:
        return df.withColumn(out, F.col(text))
    allp = F.concat(*[F.transform(F.col(p), lambda x: F.struct(x["ph"].alias("ph"), x["original"].alias("original")))
                      for p in pairs])
    return df.withColumn(out, F.when(F.col(text).isNull(), F.col(text)).otherwise(C.restore(F.col(text), allp)))


def merge_mappings(*mappings: str) -> Column:
    """Concatenate scoped mappings; scopes keep the keys distinct."""
    return F.concat(*[F.col(m) for m in mappings])


def detect_names(df: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """Dictionary detection of person names.

    Tokens (split on white space, outer punctuation trimmed) and bigrams are
    exploded and equi-joined with the names table. The names table grows with
    the data, so no broadcast is forced; AQE broadcasts it only when its
    runtime size is small. A frequent word that is no name sends all its rows
    to one partition of the join; the few matches are dealt anew afterwards, so
    that the count does not rest on the join's partitioning and AQE may split
    such a partition. Repeated names do not matter to a semi-join.
    """
    toks = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+", -1),
                       lambda w: F.regexp_replace(w, r"^[\"'(\[]+|[\"'.,;:!?)\]]+$", ""))
    nxt = F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0)))
    pairs = F.arrays_zip(toks.alias("a"), nxt.alias("b"))
    grams = F.concat(toks, F.transform(F.filter(pairs, lambda x: x["b"].isNotNull()),
                                       lambda x: F.concat_ws(" ", x["a"], x["b"])))
    cand = df.select(key, F.explode_outer(grams).alias("name")).where(F.length("name") > 0)
    return (cand.join(names.select("name"), "name", "left_semi").repartition(F.col(key), F.col("name"))
            .groupBy(key, "name").agg(F.count(F.lit(1)).alias("n")))
