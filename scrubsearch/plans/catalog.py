"""Registered queries: one per operator of the survey's inventory.

Every query reads the driver tables (or what Spark derives from them) in
full. Long texts are reported as md5 + length, ranks and counts as BIGINT,
scores rounded to 6 places, so Spark and the DuckDB oracle compare by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubsearch.checks import oracle as O
from scrubsearch.functions import fixed
from scrubsearch.operators import chunk as CH
from scrubsearch.operators import find, pii
from scrubsearch.operators import index as IX
from scrubsearch.operators import quantize as VQ
from scrubsearch.operators import search as S
from scrubsearch.operators.answer import inject_ticket, prompt_sla, ticket_header
from scrubsearch.operators.embed import embed_sparse
from scrubsearch.operators.flatten import flatten_rows, pack_rows
from scrubsearch.operators.versions import VersionedIndex
from scrubsearch.plans import pipeline as PL
from scrubsearch.session import scratch_dir
from scrubsearch.sources import tables as TB

QUERIES: dict = {}
ORACLES: dict = {}

FIND_TERM = "in000004"      # F3: a literal id prefix, matched ignoring case
HIT_TERM = "@"              # F4-F6 over documents: rows holding an e-mail-like '@'
CHECK_SOURCE = "src3"       # F6


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def md5_len(col: str, prefix: str):
    return [F.md5(F.col(col)).alias(f"{prefix}_md5"), F.length(F.col(col)).cast("long").alias(f"{prefix}_len")]


def sql_md5_len(col: str, prefix: str) -> str:
    return f"md5({col}) AS {prefix}_md5, CAST(length({col}) AS BIGINT) AS {prefix}_len"


# ---------------------------------------------------------------------------
# Sources (S1, S2, S6)
# ---------------------------------------------------------------------------

@register("ticket_scan", O.with_(O.TICKETS) + " SELECT * FROM tickets")
def ticket_scan(spark: SparkSession, d: str) -> DataFrame:
    return TB.tickets(spark, d)


@register("document_scan", O.with_(O.DOCS) + " SELECT doc_id, source, lang, " + sql_md5_len("text", "text") + " FROM docs")
def document_scan(spark: SparkSession, d: str) -> DataFrame:
    return TB.documents(spark, d).select("doc_id", "source", "lang", *md5_len("text", "text"))


@register("normalize_messages", O.with_(O.MESSAGES) + " SELECT query_id AS id, conversation_id, text FROM messages")
def normalize_messages(spark: SparkSession, d: str) -> DataFrame:
    return TB.normalize_messages(TB.conversation_activities(spark, d))


# ---------------------------------------------------------------------------
# Flatten and chunk
# ---------------------------------------------------------------------------

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("flatten_rows", f"SELECT o_orderkey AS row_no, {O.flatten_expr(ORDER_COLS)} AS text FROM orders")
def flatten_rows_q(spark: SparkSession, d: str) -> DataFrame:
    o = TB.table(spark, d, "orders").withColumn("row_no", F.col("o_orderkey"))
    return flatten_rows(o, ORDER_COLS, keep=["row_no"])


@register("pack_rows", O.with_(O.TICKETS, O.FLAT, O.PACKED)
          + " SELECT source, bucket, n_rows, " + sql_md5_len("text", "text") + " FROM packed")
def pack_rows_q(spark: SparkSession, d: str) -> DataFrame:
    flat = flatten_rows(TB.tickets(spark, d), TB.TICKET_COLUMNS, keep=["source", "row_no"])
    return pack_rows(flat).select("source", "bucket", "n_rows", *md5_len("text", "text"))


@register("chunk_fixed", O.with_(*O.KB_BASE)
          + " SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, " + sql_md5_len("text", "chunk") + " FROM kb_chunks")
def chunk_fixed_q(spark: SparkSession, d: str) -> DataFrame:
    ch = CH.chunk_fixed(TB.documents(spark, d), fixed.KB_CHUNK_SIZE, fixed.KB_CHUNK_OVERLAP, keep=["doc_id"])
    return ch.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), *md5_len("chunk", "chunk"))


@register("chunk_keys", O.with_(*O.KB_BASE) + " SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, chunk_key FROM kb_chunks")
def chunk_keys_q(spark: SparkSession, d: str) -> DataFrame:
    return IX.kb_chunks(TB.documents(spark, d)).select(
        "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "chunk_key")


@register("chunk_recursive_kb")
def chunk_recursive_kb_q(spark: SparkSession, d: str) -> DataFrame:
    ch = CH.chunk_recursive(TB.documents(spark, d), fixed.KB_CHUNK_SIZE, fixed.KB_CHUNK_OVERLAP, keep=["doc_id"])
    return ch.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), *md5_len("chunk", "chunk"))


@register("chunk_recursive_sla")
def chunk_recursive_sla_q(spark: SparkSession, d: str) -> DataFrame:
    ch = IX.sla_chunks(TB.tickets(spark, d), recursive=True)
    return ch.select("source", "doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), *md5_len("text", "chunk"))


# ---------------------------------------------------------------------------
# Extraction and raw search
# ---------------------------------------------------------------------------

ALL_QUESTIONS_SQL = [O.TICKETS, O.QUESTIONS, O.MESSAGES, """allq AS (
  SELECT CAST(query_id AS VARCHAR) AS query_id, text FROM questions
  UNION ALL SELECT query_id, text FROM messages)"""]


def all_questions(spark: SparkSession, d: str) -> DataFrame:
    qs = TB.questions(spark, d).select(F.col("query_id").cast("string").alias("query_id"), "text")
    return qs.unionByName(TB.messages(spark, d))


@register("extract_ticket_id", O.with_(*ALL_QUESTIONS_SQL)
          + f" SELECT query_id, {O.ticket_expr('text')} AS ticket_id FROM allq")
def extract_ticket_id_q(spark: SparkSession, d: str) -> DataFrame:
    return all_questions(spark, d).select("query_id", find.ticket_id(F.col("text")).alias("ticket_id"))


@register("retrieval_key", O.with_(*ALL_QUESTIONS_SQL)
          + f" SELECT query_id, coalesce({O.ticket_expr('text')}, text) AS key FROM allq")
def retrieval_key_q(spark: SparkSession, d: str) -> DataFrame:
    qs = all_questions(spark, d)
    return qs.select("query_id", find.retrieval_key(F.col("text"), find.ticket_id(F.col("text"))).alias("key"))


def _any_contains_sql(cols: list[str], term: str) -> str:
    return " OR ".join(f"contains(lower(coalesce(CAST({c} AS VARCHAR), 'nan')), {O.q(term.lower())})" for c in cols)


TICKET_ALL = O.TICKET_COLUMNS + ["source", "row_no"]


@register("find_rows_any_column", O.with_(O.TICKETS)
          + f" SELECT * FROM tickets WHERE {_any_contains_sql(TICKET_ALL, FIND_TERM)}")
def find_rows_q(spark: SparkSession, d: str) -> DataFrame:
    return find.find_rows(TB.tickets(spark, d), FIND_TERM)


DOC_COLS = ["doc_id", "text", "lang", "source"]


@register("hit_report", O.with_(O.DOCS) + f""" SELECT source, count(*) AS n_rows,
  CAST(count_if({_any_contains_sql(DOC_COLS, HIT_TERM)}) AS BIGINT) AS n_hits,
  bool_or({_any_contains_sql(DOC_COLS, HIT_TERM)}) AS found FROM docs GROUP BY source""")
def hit_report_q(spark: SparkSession, d: str) -> DataFrame:
    return find.hit_report(TB.documents(spark, d), HIT_TERM, DOC_COLS)


@register("search_outcome", O.with_(O.DOCS, f"""rep AS (SELECT source, count(*) AS n_rows,
  count_if({_any_contains_sql(DOC_COLS, HIT_TERM)}) AS n_hits,
  bool_or({_any_contains_sql(DOC_COLS, HIT_TERM)}) AS found FROM docs GROUP BY source)""")
          + """ SELECT count(*) AS n_sources, CAST(coalesce(sum(n_rows), 0) AS BIGINT) AS n_rows,
  CAST(coalesce(sum(n_hits), 0) AS BIGINT) AS n_hits,
  CASE WHEN count(*) = 0 THEN 'no sources' WHEN coalesce(sum(CAST(found AS INTEGER)), 0) = 0 THEN 'not found'
       ELSE 'found' END AS outcome FROM rep""")
def search_outcome_q(spark: SparkSession, d: str) -> DataFrame:
    return find.search_outcome(TB.documents(spark, d), HIT_TERM, DOC_COLS)


@register("file_check", O.with_(O.DOCS) + f""" SELECT count(*) AS n_rows,
  CAST(count_if({_any_contains_sql(DOC_COLS, HIT_TERM)}) AS BIGINT) AS n_hits FROM docs WHERE source = '{CHECK_SOURCE}'""")
def file_check_q(spark: SparkSession, d: str) -> DataFrame:
    return find.file_check(TB.documents(spark, d), CHECK_SOURCE, HIT_TERM, DOC_COLS)


# ---------------------------------------------------------------------------
# Embedding and retrieval
# ---------------------------------------------------------------------------

@register("embed_hashed", O.with_(O.DOCS, O.vectors("dv", "docs", ["doc_id"]))
          + " SELECT doc_id, bucket, tf, CAST(norm2 AS BIGINT) AS norm2 FROM dv")
def embed_hashed_q(spark: SparkSession, d: str) -> DataFrame:
    return embed_sparse(TB.documents(spark, d), "doc_id").select("doc_id", "bucket", "tf", "norm2")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return TB.table(spark, d, "embeddings").select("vec_id", "embedding")


@register("topk_l2", O.dense_topk("l2"))
def topk_l2_q(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    r = S.topk_dense(spark, e.withColumnRenamed("vec_id", "query_id"), e, metric="l2", qid="query_id")
    return r.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("topk_cosine", O.dense_topk("cosine"))
def topk_cosine_q(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    r = S.topk_dense(spark, e.withColumnRenamed("vec_id", "query_id"), e, metric="cosine", qid="query_id")
    return r.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("topk_lsh")
def topk_lsh_q(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    r = S.topk_lsh(e.withColumnRenamed("vec_id", "query_id"), e, qid="query_id")
    return r.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _vector_index(spark: SparkSession, d: str) -> VQ.VectorIndex:
    e = _embeddings(spark, d)
    return VQ.encode(e, VQ.fit(e))


@register("topk_balls", O.dense_topk("l2"))
def topk_balls_q(spark: SparkSession, d: str) -> DataFrame:
    """R2, exact: the same rows as topk_l2, found by cells and the triangle inequality."""
    r = VQ.topk_balls(_embeddings(spark, d), _vector_index(spark, d), qid="vec_id")
    return r.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("topk_quantized")
def topk_quantized_q(spark: SparkSession, d: str) -> DataFrame:
    """Product-quantized codes choose the pairs that are measured."""
    r = VQ.topk_quantized(_embeddings(spark, d), _vector_index(spark, d), qid="vec_id")
    return r.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


# the quantizer against exact search, in SQL against what must come out: every
# query has its rows and at least nine tenths of the true neighbours, from at
# most a tenth of the pairs, with exact scores
@register("quantized_quality", f"""SELECT count(*) AS n_queries, CAST({fixed.TOP_K} * count(*) AS BIGINT) AS n_rows,
  true AS recall_ok, true AS share_ok, CAST(0 AS BIGINT) AS n_wrong_scores FROM embeddings""")
def quantized_quality_q(spark: SparkSession, d: str) -> DataFrame:
    e, index = _embeddings(spark, d), _vector_index(spark, d)
    found = VQ.topk_quantized(e, index, qid="vec_id")
    exact = S.topk_dense(spark, e.withColumnRenamed("vec_id", "query_id"), e, metric="l2", qid="query_id")
    both = found.select("query_id", "vec_id", F.round("score", 6).alias("score")).join(
        exact.select("query_id", "vec_id", F.round("score", 6).alias("exact")), ["query_id", "vec_id"], "full")
    pairs, n = VQ.candidates(e, index, qid="vec_id").count(), sum(index.sizes.values())
    return both.agg(
        F.countDistinct("query_id").alias("n_queries"), F.count("score").alias("n_rows"),
        (F.count_if(F.col("score").isNotNull() & F.col("exact").isNotNull()) >= 0.9 * F.count("exact")).alias("recall_ok"),
        F.lit(pairs <= 0.1 * n * n).alias("share_ok"),
        F.count_if(F.abs(F.col("score") - F.col("exact")) > 1e-6).alias("n_wrong_scores"))


def sla_chunks(spark: SparkSession, d: str) -> DataFrame:
    return IX.sla_chunks(TB.tickets(spark, d))


def kb_chunks(spark: SparkSession, d: str) -> DataFrame:
    return IX.kb_chunks(TB.documents(spark, d))


def build(spark: SparkSession, d: str, stores: tuple[str, ...] = ("kb", "sla")) -> IX.Index:
    """Build the requested stores into a fresh folder of the shared
    checkpoint root and return the persisted index."""
    parts = [sla_chunks(spark, d) if s == "sla" else kb_chunks(spark, d) for s in stores]
    chunks = parts[0]
    for p in parts[1:]:
        chunks = chunks.unionByName(p)
    return IX.write_index(chunks, scratch_dir(spark, "index"))


SLA_SEARCH_SQL = O.SLA_BASE + [O.QUESTIONS,
                               "qs AS (SELECT 'sla' AS store, query_id, text FROM questions)",
                               O.vectors("qv", "qs", ["store", "query_id"]),
                               O.vectors("cv", "sla_chunks", ["store", "chunk_key"]),
                               O.sparse_topk("hits", "qv", "cv", "qs", "sla_chunks")]


@register("topk_sparse", O.with_(*SLA_SEARCH_SQL)
          + " SELECT query_id, rank, chunk_key, round(score, 6) AS score FROM hits")
def topk_sparse_q(spark: SparkSession, d: str) -> DataFrame:
    qs = TB.questions(spark, d).select(F.lit("sla").alias("store"), "query_id", F.col("text").alias("key"))
    hits = S.search_sparse(qs, build(spark, d, ("sla",)))
    return hits.select("query_id", "rank", "chunk_key", F.round("score", 6).alias("score"))


KB_SEARCH_SQL = O.KB_BASE + [O.MESSAGES,
                             "ms AS (SELECT 'kb' AS store, query_id, text FROM messages)",
                             O.vectors("qv", "ms", ["store", "query_id"]),
                             O.vectors("cv", "kb_chunks", ["store", "chunk_key"]),
                             O.sparse_topk("hits", "qv", "cv", "ms", "kb_chunks")]


@register("search_snippets", O.with_(*KB_SEARCH_SQL) + """ SELECT h.query_id, h.rank,
  translate(substr(c.text, 1, 400), chr(10), ' ') AS snippet
  FROM hits h JOIN kb_chunks c ON h.chunk_key = c.chunk_key""")
def search_snippets_q(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, d, ("kb",))
    ms = TB.messages(spark, d).select(F.lit("kb").alias("store"), "query_id", F.col("text").alias("key"))
    hits = S.search_sparse(ms, index)
    return S.snippets(hits, index.chunks).select("query_id", "rank", "snippet")


BOTH_SQL = (O.SLA_BASE + O.KB_BASE + ALL_QUESTIONS_SQL[1:] + [
    "chunks AS (SELECT * FROM sla_chunks UNION ALL SELECT * FROM kb_chunks)",
    "bq AS (SELECT s.store, a.query_id, a.text FROM allq a, (VALUES ('kb'), ('sla')) s(store))",
    O.vectors("qv", "bq", ["store", "query_id"]),
    O.vectors("cv", "chunks", ["store", "chunk_key"]),
    O.sparse_topk("hits", "qv", "cv", "bq", "chunks")])


def both_stores_hits(spark: SparkSession, d: str):
    index = build(spark, d)
    qs = all_questions(spark, d)
    bq = qs.select(F.explode(F.array(F.lit("kb"), F.lit("sla"))).alias("store"), "query_id", F.col("text").alias("key"))
    return S.search_sparse(bq, index), qs


@register("search_both_stores", O.with_(*BOTH_SQL)
          + " SELECT store, query_id, rank, chunk_key, round(score, 6) AS score FROM hits")
def search_both_stores_q(spark: SparkSession, d: str) -> DataFrame:
    hits, _ = both_stores_hits(spark, d)
    return hits.select("store", "query_id", "rank", "chunk_key", F.round("score", 6).alias("score"))


@register("hit_counts", O.with_(*BOTH_SQL) + """ SELECT b.store, b.query_id, count(h.chunk_key) AS n_hits
  FROM bq b LEFT JOIN hits h ON b.store = h.store AND b.query_id = h.query_id GROUP BY b.store, b.query_id""")
def hit_counts_q(spark: SparkSession, d: str) -> DataFrame:
    hits, qs = both_stores_hits(spark, d)
    return S.hit_counts(hits, qs, ["kb", "sla"])


@register("build_context", O.with_(*SLA_SEARCH_SQL) + """ SELECT qs.query_id,
  md5(coalesce((SELECT string_agg(c.text, ' ' ORDER BY h.rank) FROM hits h JOIN sla_chunks c
                ON h.chunk_key = c.chunk_key WHERE h.query_id = qs.query_id), '')) AS context_md5
  FROM qs""")
def build_context_q(spark: SparkSession, d: str) -> DataFrame:
    index = build(spark, d, ("sla",))
    qs = TB.questions(spark, d).select(F.lit("sla").alias("store"), "query_id", F.col("text").alias("key"))
    ctx = S.build_context(S.search_sparse(qs, index), index.chunks, qs.select("query_id"))
    return ctx.select("query_id", F.md5("context").alias("context_md5"))


# ---------------------------------------------------------------------------
# PII (A1-A14)
# ---------------------------------------------------------------------------

@register("mask_ticket_ids", O.with_(*ALL_QUESTIONS_SQL, O.anonymize("a", "allq", "query_id", "text"))
          + " SELECT id AS query_id, md5(m) AS masked_md5, CAST(len(ids) AS BIGINT) AS n_preserved FROM a_k")
def mask_ticket_ids_q(spark: SparkSession, d: str) -> DataFrame:
    m = pii.mask_ids(all_questions(spark, d), "text", "masked")
    return m.select("query_id", F.md5("masked").alias("masked_md5"), F.size("masked_ids").cast("long").alias("n_preserved"))


@register("mask_roundtrip", O.with_(*ALL_QUESTIONS_SQL, O.anonymize("a", "allq", "query_id", "text"))
          + f" SELECT k.id AS query_id, {O.unmask('k.m', 'k.ids')} = s.t AS roundtrip_ok,"
            " CAST(len(k.ids) AS BIGINT) AS n_preserved FROM a_k k JOIN a_src s ON k.id = s.id")
def mask_roundtrip_q(spark: SparkSession, d: str) -> DataFrame:
    m = pii.mask_ids(all_questions(spark, d), "text", "masked")
    m = pii.unmask_ids(m, "masked", "masked_ids", "back")
    return m.select("query_id", (F.col("back") == F.coalesce(F.col("text"), F.lit(""))).alias("roundtrip_ok"),
                    F.size("masked_ids").cast("long").alias("n_preserved"))


def _detect_sql(lang: bool) -> str:
    rows = []
    for ent, pat, lk in fixed.DETECTORS:
        ms = f"regexp_extract_all(text, {O.q(pat)})"
        n = f"len(list_filter({ms}, lambda x: {O.luhn('x')}))" if lk else f"len({ms})"
        if lang:
            allowed = [lg for lg, dets in fixed.LANG_DETECTORS.items() if any(dd[0] == ent for dd in dets)]
            known = ", ".join(O.q(x) for x in fixed.LANG_DETECTORS)
            n = (f"CASE WHEN lang IN ({', '.join(O.q(x) for x in allowed)}) OR lang NOT IN ({known}) "
                 f"OR lang IS NULL THEN {n} ELSE 0 END")
        cols = "doc_id, lang" if lang else "doc_id"
        rows.append(f"SELECT {cols}, {O.q(ent)} AS entity, CAST({n} AS BIGINT) AS n FROM docs")
    return O.with_(O.DOCS) + " SELECT * FROM (" + " UNION ALL ".join(rows) + ") WHERE n > 0"


@register("detect_pii", _detect_sql(False))
def detect_pii_q(spark: SparkSession, d: str) -> DataFrame:
    return pii.detect_counts(TB.documents(spark, d), "doc_id", "text")


@register("detect_pii_by_lang", _detect_sql(True))
def detect_pii_by_lang_q(spark: SparkSession, d: str) -> DataFrame:
    return pii.detect_counts(TB.documents(spark, d), "doc_id", "text", lang="lang")


@register("detect_names_dict", O.with_(O.TICKETS, O.FLAT, """toks AS (
  SELECT row_no, list_transform(string_split_regex(text, '\\s+'),
         lambda w: regexp_replace(w, '^["''(\\[]+|["''.,;:!?)\\]]+$', '', 'g')) AS t FROM flat),
grams AS (SELECT row_no, unnest(t || list_transform(t[2:], lambda w, i: t[i] || ' ' || w)) AS name FROM toks)""")
          + """ SELECT g.row_no, g.name, count(*) AS n FROM grams g
  JOIN (SELECT DISTINCT c_name AS name FROM customer) c ON g.name = c.name
  WHERE length(g.name) > 0 GROUP BY g.row_no, g.name""")
def detect_names_q(spark: SparkSession, d: str) -> DataFrame:
    flat = flatten_rows(TB.tickets(spark, d), TB.TICKET_COLUMNS, keep=["row_no"])
    return pii.detect_names(flat, "row_no", "text", TB.names(spark, d))


@register("resolve_spans", O.with_(O.DOCS, O.anonymize("a", "docs", "doc_id", "text"))
          + " SELECT id AS doc_id, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, entity FROM a_c")
def resolve_spans_q(spark: SparkSession, d: str) -> DataFrame:
    return pii.resolved_spans(TB.documents(spark, d), "doc_id", "text")


@register("anonymize_map", O.with_(O.DOCS, O.anonymize("a", "docs", "doc_id", "text"))
          + " SELECT id AS doc_id, md5(anon) AS anon_md5, CAST(n_spans AS BIGINT) AS n_pii FROM a_out")
def anonymize_map_q(spark: SparkSession, d: str) -> DataFrame:
    a = pii.anonymize(TB.documents(spark, d), "text", "anon")
    return a.select("doc_id", F.md5("anon").alias("anon_md5"), F.size("anon_mapping").cast("long").alias("n_pii"))


@register("pii_mapping", O.with_(O.DOCS, O.anonymize("a", "docs", "doc_id", "text"))
          + " SELECT id AS doc_id, ph, original, entity FROM a_map")
def pii_mapping_q(spark: SparkSession, d: str) -> DataFrame:
    a = pii.anonymize(TB.documents(spark, d), "text", "anon")
    return (a.select("doc_id", F.explode_outer("anon_mapping").alias("m")).where(F.col("m").isNotNull())
            .select("doc_id", "m.ph", "m.original", "m.entity"))


def _labels_sql(stage: str) -> str:
    base = O.with_(O.DOCS, O.anonymize("a", "docs", "doc_id", "text", escape=False, labels=True))
    raw = "anon"
    if stage == "raw":
        val = raw
    elif stage == "table":
        val = f"CASE WHEN n_spans > 0 THEN {O.friendly_table(raw)} ELSE {raw} END"
    else:
        val = f"CASE WHEN n_spans > 0 THEN {O.friendly_generic(O.friendly_table(raw))} ELSE {raw} END"
    return base + f" SELECT id AS doc_id, md5({val}) AS redacted_md5 FROM a_out"


@register("redact_labels", _labels_sql("raw"))
def redact_labels_q(spark: SparkSession, d: str) -> DataFrame:
    r = pii.redact_labels(TB.documents(spark, d), "text", "red", friendly=False)
    return r.select("doc_id", F.md5("red").alias("redacted_md5"))


@register("friendly_labels", _labels_sql("table"))
def friendly_labels_q(spark: SparkSession, d: str) -> DataFrame:
    docs = TB.documents(spark, d)
    a = pii.anonymize(docs, "text", "raw", escape=False, labels=True)
    val = F.when(F.size("raw_mapping") > 0, pii.friendly_table(F.col("raw"))).otherwise(F.col("raw"))
    return a.select("doc_id", F.md5(val).alias("redacted_md5"))


@register("friendly_labels_generic", _labels_sql("generic"))
def friendly_labels_generic_q(spark: SparkSession, d: str) -> DataFrame:
    r = pii.redact_labels(TB.documents(spark, d), "text", "red", friendly=True)
    return r.select("doc_id", F.md5("red").alias("redacted_md5"))


# ---------------------------------------------------------------------------
# Answer post-processing (T1-T7) on responses derived from tickets
# ---------------------------------------------------------------------------

RESPONSES_SQL = O.with_(O.TICKETS, """resp AS (
  SELECT row_no AS query_id, ticket_id,
         CASE row_no % 5
           WHEN 0 THEN 'Status of ticket __[REDACTED NAME]__ is ' || status || '.'
           WHEN 1 THEN 'Ticket # _[REDACTED X]_ was updated ' || last_update
           WHEN 2 THEN 'ticket [REDACTED NAME] belongs to ' || engineer
           WHEN 3 THEN 'The request __[REDACTED ID]__ has priority ' || priority
           ELSE 'Both __[REDACTED A]__ and __[REDACTED B]__ are ' || status END AS response
  FROM tickets)""")


def responses(spark: SparkSession, d: str) -> DataFrame:
    t = TB.tickets(spark, d)
    r = (F.when(F.col("row_no") % 5 == 0, F.concat(F.lit("Status of ticket __[REDACTED NAME]__ is "), F.col("status"), F.lit(".")))
         .when(F.col("row_no") % 5 == 1, F.concat(F.lit("Ticket # _[REDACTED X]_ was updated "), F.col("last_update")))
         .when(F.col("row_no") % 5 == 2, F.concat(F.lit("ticket [REDACTED NAME] belongs to "), F.col("engineer")))
         .when(F.col("row_no") % 5 == 3, F.concat(F.lit("The request __[REDACTED ID]__ has priority "), F.col("priority")))
         .otherwise(F.concat(F.lit("Both __[REDACTED A]__ and __[REDACTED B]__ are "), F.col("status"))))
    return t.select(F.col("row_no").alias("query_id"), "ticket_id", r.alias("response"))


@register("inject_ticket", RESPONSES_SQL + f" SELECT query_id, {O.inject_ticket('response', 'ticket_id')} AS injected FROM resp")
def inject_ticket_q(spark: SparkSession, d: str) -> DataFrame:
    r = responses(spark, d)
    return r.select("query_id", inject_ticket(F.col("response"), F.col("ticket_id")).alias("injected"))


@register("ticket_header", RESPONSES_SQL + f""" SELECT query_id, {O.ticket_header(
    f"(CASE WHEN NOT contains(response, ticket_id) THEN {O.inject_ticket('response', 'ticket_id')} ELSE response END)",
    'ticket_id')} AS answer FROM resp""")
def ticket_header_q(spark: SparkSession, d: str) -> DataFrame:
    r = responses(spark, d)
    tid = F.col("ticket_id")
    inj = F.when(~F.contains(F.col("response"), tid), inject_ticket(F.col("response"), tid)).otherwise(F.col("response"))
    return r.select("query_id", ticket_header(inj, tid).alias("answer"))


def _pipeline_sql(profile: str, select: str) -> str:
    return O.with_(*O.pipeline(profile)) + " " + select


def _prompts(spark: SparkSession, d: str, profile: str) -> DataFrame:
    if profile == "sla":
        return PL.anonymized_prompts(TB.questions(spark, d), build(spark, d, ("sla",)), "sla")
    return PL.anonymized_prompts(TB.messages(spark, d), build(spark, d, ("kb",)), "kb")


@register("prompt_kb", _pipeline_sql("kb", "SELECT query_id, " + sql_md5_len("prompt", "prompt") + " FROM prompts"))
def prompt_kb_q(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d, "kb").select("query_id", *md5_len("prompt", "prompt"))


@register("prompt_sla", _pipeline_sql("sla", "SELECT query_id, " + sql_md5_len("prompt", "prompt") + " FROM prompts"))
def prompt_sla_q(spark: SparkSession, d: str) -> DataFrame:
    return _prompts(spark, d, "sla").select("query_id", *md5_len("prompt", "prompt"))


# every name of the dictionary that the question or a retrieved chunk shows, and none of them in the prompt
@register("prompt_names", _pipeline_sql("sla", """SELECT f.query_id, count(DISTINCT c.c_name) AS n_names,
  CAST(0 AS BIGINT) AS n_leaked FROM (SELECT query_id, unnest(string_split_regex(context, '\\s+')) AS w FROM answered) f
  LEFT JOIN customer c ON c.c_name = f.w GROUP BY f.query_id"""))
def prompt_names_q(spark: SparkSession, d: str) -> DataFrame:
    names = TB.names(spark, d)
    p = PL.anonymized_prompts(TB.questions(spark, d), build(spark, d, ("sla",)), "sla", names=names)
    return names_shown(p, names)


def names_shown(prompts: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, n_names, n_leaked): how many known names the context, and the prompt, of a query hold as words.

    Words are told apart as plain strings: array_distinct hashes those, while
    it compares structs pair by pair."""
    def words(column: str, shown: bool):
        distinct = F.array_distinct(F.split(F.col(column), r"\s+", -1))
        return F.transform(distinct, lambda w: F.struct(w.alias("name"), F.lit(shown).alias("shown")))

    seen = prompts.select("query_id", F.explode(F.concat(words("context", False), words("prompt", True))).alias("w"))
    listed = names.select("name").distinct().withColumn("known", F.lit(True))
    return seen.select("query_id", "w.*").join(listed, "name", "left").groupBy("query_id").agg(
        F.count_if(F.col("known") & ~F.col("shown")).alias("n_names"), F.count_if(F.col("known") & F.col("shown")).alias("n_leaked"))


@register("merge_mappings", _pipeline_sql("sla", """SELECT id AS query_id, ph, original FROM (
  SELECT id, ph, original FROM ac_map UNION ALL SELECT id, ph, original FROM aq_map
  UNION ALL SELECT id, ph, original FROM ac_pres UNION ALL SELECT id, ph, original FROM aq_pres)"""))
def merge_mappings_q(spark: SparkSession, d: str) -> DataFrame:
    p = _prompts(spark, d, "sla")
    return (p.select("query_id", F.explode_outer("mapping").alias("m")).where(F.col("m").isNotNull())
            .select("query_id", "m.ph", "m.original"))


@register("restore_pii", _pipeline_sql("sla", "SELECT query_id, md5(restored) AS restored_md5, "
                                       "restored = prompt_raw AS equals_raw FROM (SELECT *, "
                                       + O.prompt("sla", "context", "(SELECT text FROM questions q WHERE q.query_id = answered.query_id)")
                                       + " AS prompt_raw FROM answered)"))
def restore_pii_q(spark: SparkSession, d: str) -> DataFrame:
    p = _prompts(spark, d, "sla")
    r = pii.restore_pii(p.withColumn("response", F.col("prompt")), "response", ["mapping"], "restored")
    raw = prompt_sla(F.col("context"), F.col("text"))
    return r.select("query_id", F.md5("restored").alias("restored_md5"), (F.col("restored") == raw).alias("equals_raw"))


@register("answers_join", _pipeline_sql("sla", "SELECT query_id, md5(response) AS response_md5 FROM answered"))
def answers_join_q(spark: SparkSession, d: str) -> DataFrame:
    from scrubsearch.operators.answer import answers_join, echo_responder
    # written once: the responder and the join both read the prompts
    path = scratch_dir(spark, "prompts")
    _prompts(spark, d, "sla").select("query_id", "prompt").write.parquet(path)
    p = spark.read.parquet(path)
    return answers_join(p, echo_responder(p)).select("query_id", F.md5("response").alias("response_md5"))


@register("pipeline_sla", _pipeline_sql("sla", "SELECT query_id, ticket_id, " + sql_md5_len("final", "final") + " FROM final"))
def pipeline_sla_q(spark: SparkSession, d: str) -> DataFrame:
    out = PL.answer(TB.questions(spark, d), build(spark, d, ("sla",)), "sla")
    return out.select("query_id", "ticket_id", *md5_len("final", "final"))


@register("pipeline_kb", _pipeline_sql("kb", "SELECT query_id, ticket_id, " + sql_md5_len("final", "final") + " FROM final"))
def pipeline_kb_q(spark: SparkSession, d: str) -> DataFrame:
    out = PL.answer(TB.messages(spark, d), build(spark, d, ("kb",)), "kb")
    return out.select("query_id", "ticket_id", *md5_len("final", "final"))


# ---------------------------------------------------------------------------
# Index build and persistence
# ---------------------------------------------------------------------------

INDEX_SQL = O.SLA_BASE + O.KB_BASE + [
    "chunks AS (SELECT * FROM sla_chunks UNION ALL SELECT * FROM kb_chunks)",
    O.vectors("cv", "chunks", ["store", "chunk_key"])]


@register("build_index", O.with_(*INDEX_SQL) + """ SELECT c.store, c.chunk_key, CAST(length(c.text) AS BIGINT) AS chunk_len,
  (SELECT count(*) FROM cv WHERE cv.chunk_key = c.chunk_key AND cv.store = c.store) AS n_postings FROM chunks c""")
def build_index_q(spark: SparkSession, d: str) -> DataFrame:
    return build(spark, d).table.select("store", "chunk_key", F.length("text").cast("long").alias("chunk_len"),
                                        F.size("buckets").cast("long").alias("n_postings"))


INDEX_STATE_SQL = """ SELECT c.store, count(*) AS n_chunks, count(DISTINCT c.chunk_key) AS n_keys,
  CAST(sum((SELECT count(*) FROM cv WHERE cv.chunk_key = c.chunk_key AND cv.store = c.store)) AS BIGINT) AS n_postings
  FROM chunks c GROUP BY c.store"""


def _index_state(index: IX.Index) -> DataFrame:
    return index.table.groupBy("store").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("chunk_key").alias("n_keys"),
        F.sum(F.size("buckets")).cast("long").alias("n_postings"))


@register("index_append", O.with_(*INDEX_SQL) + INDEX_STATE_SQL)
def index_append_q(spark: SparkSession, d: str) -> DataFrame:
    """K3: both stores added to an index that has one of them, then again."""
    path = scratch_dir(spark, "index")
    IX.write_index(kb_chunks(spark, d), path)
    for _ in range(2):
        index = IX.write_index(kb_chunks(spark, d).unionByName(sla_chunks(spark, d)), path, "append")
    return _index_state(index)


CHANGED = "CASE doc_id % 7 WHEN 2 THEN 'changed ' || coalesce(text, '') ELSE coalesce(text, '') END"
VERSION_SQL = """SELECT {v} AS version, store, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars,
  min(md5(text)) AS least, max(md5(text)) AS most FROM {t} GROUP BY store"""


@register("index_upsert", O.with_(
    *O.SLA_BASE, *O.KB_BASE, f"docs2 AS (SELECT doc_id, source, lang, {CHANGED} AS text FROM documents WHERE doc_id % 5 <> 3)",
    O.KB_CHUNKS.replace("kb_chunks", "kb2_chunks").replace("FROM docs", "FROM docs2"),
    "whole AS (SELECT * FROM kb_chunks UNION ALL SELECT * FROM sla_chunks)",
    "second AS (SELECT * FROM kb2_chunks UNION ALL SELECT * FROM sla_chunks)") + " UNION ALL ".join(
        " " + VERSION_SQL.format(v=v, t=t) for v, t in ((1, "kb_chunks"), (2, "second"), (3, "whole"), (4, "whole"))))
def index_upsert_q(spark: SparkSession, d: str) -> DataFrame:
    """K3: documents added, changed, deleted and added again; every version as it was read from the index."""
    index = VersionedIndex(spark, scratch_dir(spark, "versions"))
    docs = TB.documents(spark, d)
    index.sync(kb_chunks(spark, d))
    text = F.coalesce("text", F.lit(""))
    changed = docs.where(F.col("doc_id") % 5 != 3).withColumn(
        "text", F.when(F.col("doc_id") % 7 == 2, F.concat(F.lit("changed "), text)).otherwise(text))
    index.sync(IX.kb_chunks(changed).unionByName(sla_chunks(spark, d)))
    index.sync(kb_chunks(spark, d).unionByName(sla_chunks(spark, d)))
    index.compact()
    out = None
    for v in index.versions():
        one = index.open(v).chunks.groupBy(F.lit(v).alias("version"), "store").agg(
            F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("n_chars"),
            F.min(F.md5("text")).alias("least"), F.max(F.md5("text")).alias("most"))
        out = one if out is None else out.unionByName(one)
    return out


@register("index_reuse", O.with_(*INDEX_SQL[:-2], "chunks AS (SELECT * FROM kb_chunks)", INDEX_SQL[-1]) + INDEX_STATE_SQL)
def index_reuse_q(spark: SparkSession, d: str) -> DataFrame:
    """K2: the second opening finds the index and never asks for the tickets."""
    path = scratch_dir(spark, "index")
    IX.open_or_build(spark, path, lambda: kb_chunks(spark, d))
    return _index_state(IX.open_or_build(spark, path, lambda: sla_chunks(spark, d)))


@register("index_roundtrip", O.with_(*INDEX_SQL) + """ SELECT store, count(*) AS n_chunks,
  CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY store""")
def index_roundtrip_q(spark: SparkSession, d: str) -> DataFrame:
    chunks = build(spark, d).chunks
    return chunks.groupBy("store").agg(F.count(F.lit(1)).alias("n_chunks"),
                                       F.sum(F.length("text")).cast("long").alias("n_chars"))


# ---------------------------------------------------------------------------
# Workbook source (S1, S3, S4) and the streaming message loop (E5)
# ---------------------------------------------------------------------------

def _workbook_rows(spark: SparkSession, d: str):
    from scrubsearch.sources import xlsx

    folder = scratch_dir(spark, "workbooks")
    xlsx.write_workbooks(TB.tickets(spark, d), TB.TICKET_COLUMNS, folder)
    return xlsx.read_workbooks(spark, folder)


@register("xlsx_ticket_scan", O.with_(O.TICKETS) + f" SELECT {O.flatten_expr(O.TICKET_COLUMNS)} AS text FROM tickets")
def xlsx_ticket_scan_q(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _workbook_rows(spark, d)
    return rows.select("text")


# every fifth workbook is cut short, is no workbook, or has a broken sheet
PLANTED_SQL = """files AS (SELECT printf('tickets-%06d.xlsx', row_no // 500) AS file, count(*) AS n, (row_no // 500) % 5 AS kind
  FROM tickets GROUP BY row_no // 500),
entries AS (SELECT file, CASE WHEN kind IN (1, 2, 3) THEN 0 ELSE n END AS n_rows,
  CASE kind WHEN 1 THEN 'BadZipFile' WHEN 2 THEN 'BadZipFile' WHEN 3 THEN 'ParseError' END AS error FROM files)"""


def _planted_folder(spark: SparkSession, d: str) -> str:
    """One workbook for each run of 500 ticket numbers, some of them broken."""
    from scrubsearch.sources import xlsx

    folder = scratch_dir(spark, "planted")
    t = TB.tickets(spark, d).withColumn("file", F.floor(F.col("row_no") / 500).cast("long"))
    xlsx.write_numbered(t, TB.TICKET_COLUMNS, "file", "row_no", folder, {1: "cut", 2: "text", 3: "sheet"})
    return folder


def _ledger_entries(df: DataFrame) -> DataFrame:
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), "n_rows",
                     F.element_at(F.split("error", ":"), 1).alias("error"))


@register("ingest_ledger", O.with_(O.TICKETS, PLANTED_SQL) + " SELECT * FROM entries")
def ingest_ledger_q(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after two runs over one folder; the second finds nothing new."""
    from scrubsearch.sources import ledger

    folder, table = _planted_folder(spark, d), scratch_dir(spark, "ingested")
    for _ in range(2):
        ledger.ingest(spark, folder, table)
    return _ledger_entries(ledger.ledger(spark, table))


@register("ingest_errors", O.with_(O.TICKETS, PLANTED_SQL) + " SELECT file, n_rows, error FROM entries WHERE error IS NOT NULL")
def ingest_errors_q(spark: SparkSession, d: str) -> DataFrame:
    """The quarantined files."""
    from scrubsearch.sources import ledger

    table = scratch_dir(spark, "ingested")
    return _ledger_entries(ledger.ingest(spark, _planted_folder(spark, d), table).where("error IS NOT NULL"))


@register("ingest_rows", O.with_(O.TICKETS, PLANTED_SQL) + f""" SELECT {O.flatten_expr(O.TICKET_COLUMNS)} AS text FROM tickets
  WHERE (row_no // 500) % 5 NOT IN (1, 2, 3)""")
def ingest_rows_q(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all files that could be read, none twice."""
    from scrubsearch.sources import ledger

    table = scratch_dir(spark, "ingested")
    ledger.ingest(spark, _planted_folder(spark, d), table)
    return ledger.rows(spark, table).select("text")


@register("stream_answers", _pipeline_sql("kb", "SELECT query_id, ticket_id, " + sql_md5_len("final", "final") + " FROM final"))
def stream_answers_q(spark: SparkSession, d: str) -> DataFrame:
    """E5: user messages arrive as JSON activity files and are answered
    micro-batch by micro-batch against the persisted KB index; the result
    equals the batch KB pipeline on the same messages."""
    from scrubsearch.operators.index import write_index
    from scrubsearch.streaming import answers

    index_path = scratch_dir(spark, "index")
    write_index(kb_chunks(spark, d), index_path)
    inbox = scratch_dir(spark, "activities")
    TB.conversation_activities(spark, d).repartition(4).write.json(inbox)
    out = scratch_dir(spark, "answers")
    q = answers.start(spark, inbox, index_path, out, scratch_dir(spark, "stream-ckpt"), profile="kb",
                      max_files_per_trigger=2)
    q.awaitTermination()
    res = spark.read.parquet(out)
    return res.select("query_id", "ticket_id", *md5_len("final", "final"))
