"""Registered queries of the corpus operators; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from scrubsearch.llm import (alignment, bytebpe, bytecnn, langid, linecut, merkle, mixing, neardup, pii, repetition,
                             shard, spiece, topk)
from scrubsearch.llm.common import bounded_batches

QUERIES: dict = {}
ORACLES: dict = {}

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the lang column is the declared tag, the source is the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return langid.identify(docs, "text", "lang", "source").drop("text", "lang", "source").withColumnRenamed(
        "lid_accepted", "kept")


@register("page_language_id")
def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: tag of the html element, host and suffix of the address, text of the extraction."""
    pages = langid.page_evidence(table(spark, sf_dir, "pages"))
    text = linecut.extract_text(pages, keep=["page_tag", "page_host"])
    return langid.identify(text, "text", "page_tag", "page_host").drop("text", "n_chars", "page_tag")


@register("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = bytecnn.train(*bytecnn.sample(docs, table(spark, sf_dir, "labels")))
    return bytecnn.score_quality(docs, net)


@register("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.span_digest(pii.find_pii(docs, pii.train_on(docs)))


@register("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecut.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


@register("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return shard.assign_shards(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


TOPK_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@register("op6_top_k", TOPK_SQL)
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set is every vec_id divisible by 50, against all rows."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def _repetition_sql() -> str:
    r"""Words by position, the n-grams that start at each, and whether they recur."""
    lengths = sorted({3, *repetition.COVERAGE_LIMITS})
    grams = ",\n         ".join(
        f"CASE WHEN n_words - pos + 1 >= {n} THEN "
        + " || ' ' || ".join(f"lead(word, {k}) OVER p" if k else "word" for k in range(n)) + f" END AS g{n}"
        for n in lengths)
    twice = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1 AS t{n}" for n in lengths)
    cover = ", ".join(
        f"max(t{n}::INT) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}"
        for n in lengths)
    sums = ", ".join(f"sum(CASE WHEN c{n} = 1 THEN length(word) ELSE 0 END) AS s{n}" for n in lengths)
    shares = ", ".join(
        f"CASE WHEN word_chars > 0 THEN coalesce(s{n}, 0)::DOUBLE / word_chars ELSE 0 END AS coverage_{n}"
        for n in repetition.COVERAGE_LIMITS)
    good = " AND ".join(f"coverage_{n} <= {most}" for n, most in repetition.COVERAGE_LIMITS.items())
    words = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), listed AS (
  SELECT *, {words.format('t')} AS ws FROM docs
), words AS (
  SELECT rid, len(ws) AS n_words, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM listed
), grams AS (
  SELECT rid, pos, word, {grams}
  FROM words WINDOW p AS (PARTITION BY rid ORDER BY pos)
), twice AS (SELECT *, {twice} FROM grams),
covered AS (SELECT *, {cover} FROM twice),
per AS (
  SELECT rid, sum(length(word)) AS word_chars, sum(c3) AS n_repeat_words, {sums} FROM covered GROUP BY rid
), split AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k
  FROM docs
), lines AS (
  SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY k) AS nth,
         list_sum(list_transform({words.format('line')}, lambda w: length(w))) AS chars FROM split
), dup AS (
  SELECT rid, count(*) AS n_dup_lines, sum(chars) AS dup_chars FROM lines
  WHERE nth > 1 AND chars > 0 GROUP BY rid
), figures AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         CASE WHEN word_chars > 0 THEN coalesce(dup_chars, 0)::DOUBLE / word_chars ELSE 0 END AS line_coverage,
         {shares}
  FROM listed LEFT JOIN per USING (rid) LEFT JOIN dup USING (rid)
), judged AS (
  SELECT *, n_words < {repetition.MIN_WORDS}
            OR 100 * n_repeat_words > {repetition.REPEAT_PERCENT} * n_words AS base_failed FROM figures
)
SELECT *, NOT base_failed AND line_coverage <= {repetition.LINE_LIMIT}
          AND n_symbols <= {repetition.SYMBOL_LIMIT} * n_words AND {good} AS kept
FROM judged
"""


@register("op7_repetition_rules", _repetition_sql())
def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


@register("op8_near_duplicates")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4)


@register("op9_sentencepiece")
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spiece.encode_documents(table(spark, sf_dir, "documents"), check=True)


# Every key, size and target is computed as in Spark: md5 digits for u, the
# same double operations. The level is the first one at which the next source,
# by cap per weight, is not above its cap.
MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols
  FROM documents
), keyed AS (
  SELECT doc_id, source, md5(t) AS digest, size,
         greatest(1e0 / (1e0 + symbols::DOUBLE / greatest(size, 1)::DOUBLE), 1e-9::DOUBLE) AS quality,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(0)) || chr(31) || md5(t)), 1, 13))::BIGINT::DOUBLE
          + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM base
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight
  FROM keyed GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source IS NULL, source) AS k FROM sources
), levels AS (
  SELECT k, 3 * source_size AS cap, weight,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
            ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked
), level AS (
  SELECT coalesce((SELECT level FROM levels WHERE cap >= weight * level ORDER BY k LIMIT 1), 0) AS level
), targets AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size < weight * level THEN (3 * source_size)::DOUBLE
              ELSE weight::DOUBLE * level END AS target
  FROM sources, level
), rows AS (
  SELECT d.*, s.source_size, s.target,
         CASE WHEN s.source_size > 0 THEN floor(s.target / s.source_size)::BIGINT ELSE 0 END AS epochs,
         -ln(d.u) / d.quality AS es_key
  FROM keyed d JOIN targets s ON d.source IS NOT DISTINCT FROM s.source
), run AS (
  SELECT *, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY source, es_key, doc_id, digest) AS peers,
         sum(size) OVER (PARTITION BY source ORDER BY es_key, doc_id NULLS FIRST, digest
                         RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM rows
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (epochs * size + CASE WHEN size > 0 AND upto - peers + peers / 2 <= rest THEN size ELSE 0 END)::BIGINT
         AS taken
FROM run
"""


@register("op10_mixing", MIX_SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@register("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(bytebpe.encode_documents(table(spark, sf_dir, "documents"), decoded=True))


def _merkle_sql(levels: int = 6) -> str:
    """Up to FANOUT ** levels leaves in a source, and as many sources.

    A level keeps its nodes' siblings left and right (``b``, ``a``); a group
    with one node left stays as it is. crc32 is folded over the id's digits."""
    n = merkle.FANOUT

    def tree(name: str) -> str:
        out = []
        for k in range(levels):
            out.append(f"""{name}{k}s AS (
  SELECT *, CASE WHEN cnt > 1 THEN coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS b,
         CASE WHEN cnt > 1 THEN coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS a
  FROM {name}{k} WINDOW w AS (PARTITION BY g, r // {n} ORDER BY r)
), {name}{k + 1} AS (
  SELECT g, r // {n} AS r, any_value((cnt + {n - 1}) // {n}) AS cnt,
         CASE WHEN any_value(cnt) > 1 THEN sha256(string_agg(d, '' ORDER BY r)) ELSE any_value(d) END AS d
  FROM {name}{k} GROUP BY g, r // {n}
)""")
        return ",\n".join(out)

    def climb(name: str, start: str) -> str:
        out, at = [], start
        for k in range(levels):
            out.append(f"""f{name}{k} AS (
  SELECT f.* EXCLUDE (d, proof), CASE WHEN s.cnt > 1 THEN sha256(s.b || f.d || s.a) ELSE f.d END AS d,
         f.proof || s.b || s.a AS proof
  FROM {at} f JOIN {name}{k}s s ON s.g = f.{'g' if name == 'l' else 'zero'} AND s.r = f.{'r' if name == 'l' else 'g'} // {n ** k}
)""")
            at = f"f{name}{k}"
        return ",\n".join(out)

    def leaf(text: str) -> str:
        put = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
                          for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({put})"

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), rows AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce(xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda v, x: xor(v // 256, t[xor(v, x) % 256 + 1])), 4294967295) % 5 = 0, false) AS bad
  FROM documents, crc
), hashed AS (
  SELECT doc_id, source, {leaf('text')} AS leaf,
         CASE WHEN bad THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} ELSE {leaf('text')} END AS seen
  FROM rows
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, 0 AS zero,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM hashed
), l0 AS (SELECT g, r, count(*) OVER (PARTITION BY g) AS cnt, leaf AS d FROM leaves
), {tree('l')}, t0 AS (SELECT 0 AS g, g AS r, count(*) OVER () AS cnt, d FROM l{levels}
), {tree('t')}, start AS (SELECT *, seen AS d, '' AS proof FROM leaves
), {climb('l', 'start')}, {climb('t', f'fl{levels - 1}')}
SELECT f.doc_id, f.leaf, l.d AS subroot, t.d AS root, sha256(f.proof) AS proof_sha256, f.d AS folded_root,
       f.d = t.d AS verified
FROM ft{levels - 1} f JOIN l{levels} l ON l.g = f.g, t{levels} t
"""


@register("op12_merkle_manifest", _merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


@register("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
