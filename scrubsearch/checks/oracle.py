"""DuckDB oracle SQL for the correctness gate.

Each builder returns plain SQL over the driver's pre-registered tables; the
derived views (tickets, questions, messages, chunks, vectors) are inlined as
CTEs. The SQL is written relationally (unnest + window functions +
string_agg) so it checks the Spark operators, which compute the same values
row by row with higher-order functions, by an independent route.
"""

from __future__ import annotations

from scrubsearch.functions import fixed


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c)


# ---------------------------------------------------------------------------
# Derived views
# ---------------------------------------------------------------------------

TICKETS = """tickets AS (
  SELECT 'IN' || lpad(CAST(o.o_orderkey AS VARCHAR), 7, '0') AS ticket_id,
         o.o_orderstatus AS status, o.o_orderpriority AS priority,
         CAST(o.o_orderdate AS VARCHAR) AS last_update, c.c_name AS engineer,
         'user' || CAST(c.c_custkey AS VARCHAR) || '@example.com' AS email,
         '+1 (555) 555-' || lpad(CAST(c.c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
         'shard' || CAST(o.o_orderkey % 8 AS VARCHAR) AS source, o.o_orderkey AS row_no
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

QUESTIONS = """questions AS (
  SELECT row_no AS query_id,
         'What''s the status of ticket ' || ticket_id || '? Reply to ' || email AS text
  FROM tickets)"""

STRIP = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

MESSAGES = f"""messages AS (
  SELECT 'C' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS query_id,
         CAST(conv_id AS VARCHAR) AS conversation_id,
         trim(coalesce(text, ''), {STRIP}) AS text
  FROM conversations WHERE role = 'user')"""

DOCS = "docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)"

TICKET_COLUMNS = ["ticket_id", "status", "priority", "last_update", "engineer", "email", "phone"]


def flatten_expr(cols: list[str]) -> str:
    return "concat_ws(' ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), 'nan')" for c in cols) + ")"


FLAT = f"flat AS (SELECT source, row_no, {flatten_expr(TICKET_COLUMNS)} AS text FROM tickets)"

PACKED = """packed AS (
  SELECT source, CAST(floor(row_no / 256) AS BIGINT) AS bucket, count(*) AS n_rows,
         string_agg(text, chr(10) ORDER BY row_no) AS text
  FROM flat GROUP BY source, CAST(floor(row_no / 256) AS BIGINT))"""


def fixed_chunks(name: str, src: str, store: str, size: int, overlap: int, doc_col: str) -> str:
    step = size - overlap
    return f"""{name}_w AS (
  SELECT source, {doc_col} AS doc_id, text,
         unnest(generate_series(0, greatest(length(text) - {overlap + 1}, 0), {step})) AS off
  FROM {src}),
{name} AS (
  SELECT '{store}' AS store, source, doc_id, CAST(off // {step} AS INTEGER) AS chunk_no,
         sha256('{store}' || '|' || source || '|' || CAST(doc_id AS VARCHAR) || '|'
                || CAST(CAST(off // {step} AS INTEGER) AS VARCHAR)) AS chunk_key,
         substr(text, off + 1, {size}) AS text
  FROM {name}_w WHERE length(substr(text, off + 1, {size})) > 0)"""


KB_CHUNKS = fixed_chunks("kb_chunks", "docs", "kb", fixed.KB_CHUNK_SIZE, fixed.KB_CHUNK_OVERLAP, "doc_id")
SLA_CHUNKS = fixed_chunks("sla_chunks", "packed", "sla", fixed.SLA_CHUNK_SIZE, fixed.SLA_CHUNK_OVERLAP, "bucket")
SLA_BASE = [TICKETS, FLAT, PACKED, SLA_CHUNKS]
KB_BASE = [DOCS, KB_CHUNKS]


def vectors(name: str, src: str, keys: list[str], text: str = "text") -> str:
    """R1 sparse form: (keys, bucket, tf, norm2)."""
    k = ", ".join(keys)
    return f"""{name}_t AS (
  SELECT {k}, unnest(string_split_regex(regexp_replace(lower(coalesce({text}, '')), {q(fixed.SPACELESS)}, ' \\1 ', 'g'),
                                        {q(fixed.TOKEN_SPLIT)})) AS tok FROM {src}),
{name}_c AS (
  SELECT {k}, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) AS bucket, count(*) AS tf
  FROM {name}_t WHERE tok <> '' GROUP BY ALL),
{name} AS (SELECT *, sum(tf * tf) OVER (PARTITION BY {k}) AS norm2 FROM {name}_c)"""


def sparse_topk(name: str, qv: str, cv: str, qsrc: str, csrc: str, k: int = fixed.TOP_K) -> str:
    """R2b over vectors qv (store, query_id, ...) and cv (store, chunk_key, ...)
    of the queries qsrc and the chunks csrc: every pair that shares a token,
    then chunks without one at score 0. A query that shares tokens with fewer
    than k chunks has its k best among those and the first 2k chunks by key."""
    return f"""{name}_c AS (SELECT store, chunk_key, row_number() OVER (PARTITION BY store ORDER BY chunk_key) AS cid FROM {csrc}),
{name}_cv AS (SELECT v.store, c.cid, v.bucket, v.tf FROM {cv} v JOIN {name}_c c ON v.store = c.store AND v.chunk_key = c.chunk_key),
{name}_nq AS (SELECT DISTINCT store, query_id, norm2 AS nq FROM {qv}),
{name}_nc AS (SELECT DISTINCT v.store, c.cid, v.norm2 AS nc FROM {cv} v JOIN {name}_c c ON v.store = c.store AND v.chunk_key = c.chunk_key),
{name}_p AS (
  SELECT qv.store, qv.query_id, cv.cid, sum(qv.tf * cv.tf) AS dot
  FROM {qv} qv JOIN {name}_cv cv ON qv.store = cv.store AND qv.bucket = cv.bucket
  GROUP BY qv.store, qv.query_id, cv.cid),
{name}_s AS (
  SELECT p.store, p.query_id, p.cid, CAST(dot AS DOUBLE) / sqrt(CAST(nq * nc AS DOUBLE)) AS score
  FROM {name}_p p JOIN {name}_nq a ON p.store = a.store AND p.query_id = a.query_id
  JOIN {name}_nc b ON p.store = b.store AND p.cid = b.cid),
{name}_t AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store, query_id ORDER BY score DESC, cid) AS rank
                 FROM {name}_s) WHERE rank <= {k}),
{name}_z AS (
  SELECT store, query_id, cid, score FROM {name}_t UNION ALL
  SELECT s.store, s.query_id, c.cid, 0.0 FROM {qsrc} s JOIN {name}_c c ON s.store = c.store AND c.cid <= {2 * k}
  WHERE NOT EXISTS (SELECT 1 FROM {name}_t t WHERE t.store = s.store AND t.query_id = s.query_id AND t.cid = c.cid)),
{name} AS (
  SELECT r.store, r.query_id, c.chunk_key, r.score, r.rank FROM (
    SELECT *, row_number() OVER (PARTITION BY store, query_id ORDER BY score DESC, cid) AS rank FROM {name}_z) r
  JOIN {name}_c c ON r.store = c.store AND r.cid = c.cid WHERE r.rank <= {k})"""


def ticket_expr(text: str) -> str:
    return f"nullif(regexp_extract({text}, {q(fixed.TICKET_ID_EXTRACT)}, 1), '')"


def interleave(pieces: str, fill_i: str, n: str) -> str:
    """pieces[1] fill(1) pieces[2] ... ; fill_i uses the 1-based index ``i``."""
    return f"array_to_string(list_transform({pieces}, lambda x, i: x || CASE WHEN i <= {n} THEN {fill_i} ELSE '' END), '')"


def replace_matches(text: str, pattern: str, fill_m: str) -> str:
    """One-pass replacement; ``fill_m`` uses ``mm`` (the match list) and ``i``."""
    pat = q(pattern)
    return (f"array_to_string(list_transform(string_split_regex({text}, {pat}), lambda x, i: x || "
            f"CASE WHEN i <= len(regexp_extract_all({text}, {pat})) THEN "
            f"{fill_m.replace('mm[i]', f'regexp_extract_all({text}, {pat})[i]')} ELSE '' END), '')")


def unmask(text: str, ids: str) -> str:
    pat = q(fixed.MASK_NUMBER)
    return (f"array_to_string(list_transform(list_zip(string_split_regex({text}, {pat}), regexp_extract_all({text}, {pat}, 1)), "
            f"lambda x: x[1] || coalesce({ids}[CAST(x[2] AS INTEGER) + 1], '')), '')")


def luhn(col: str) -> str:
    d = f"CAST(substr({col}, length({col}) - j, 1) AS INTEGER)"
    return (f"(list_sum(list_transform(range(length({col})), lambda j: CASE WHEN j % 2 = 1 THEN "
            f"(CASE WHEN 2 * {d} > 9 THEN 2 * {d} - 9 ELSE 2 * {d} END) ELSE {d} END)) % 10 = 0)")


def title(s: str) -> str:
    chars = f"string_split({s}, '')"
    return (f"array_to_string(list_transform({chars}, lambda c, i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches({chars}[i - 1], '[A-Za-z]') THEN upper(c) ELSE lower(c) END), '')")


def friendly_label(tag: str) -> str:
    out = title(f"replace(regexp_replace({tag}, {q(fixed.GENERIC_TAG_PREFIX)}, ''), '_', ' ')")
    for name, label in fixed.SPECIAL_LABELS:
        out = f"CASE WHEN {tag} = {q(name)} THEN {q(label)} ELSE {out} END"
    return out


def friendly_table(t: str) -> str:
    for tag, label in fixed.FRIENDLY_LABELS:
        t = f"replace({t}, {q(tag)}, {q(label)})"
    return t


def friendly_generic(t: str) -> str:
    tags = f"regexp_extract_all({t}, {q(fixed.GENERIC_TAG)}, 1)"
    return interleave(f"string_split_regex({t}, '<[A-Z0-9_]+>')",
                      f"'[REDACTED ' || {friendly_label(tags + '[i]')} || ']'", f"len({tags})")


# ---------------------------------------------------------------------------
# PII chain: mask -> detect -> merge -> cut -> unmask
# ---------------------------------------------------------------------------

def anonymize(p: str, src: str, id_col: str, text_col: str, scope: str = "", detectors=None,
              escape: bool = True, labels: bool = False) -> str:
    """CTEs ``{p}_k`` (id, t0, ids, m), ``{p}_c`` merged spans (id, n, s, e, entity, pe),
    ``{p}_out`` (id, t0, anon, n_spans) and ``{p}_map`` (id, n, ph, original, entity)."""
    dets = list(detectors or fixed.DETECTORS)
    if escape and not labels:
        dets.append(fixed.PLACEHOLDER_DETECTOR)
    pres = q(fixed.PRESERVE)
    mask_fill = "chr(57344) || CAST(i - 1 AS VARCHAR) || chr(57345)"
    det_rows = "\n  UNION ALL ".join(
        f"SELECT id, {q(ent)} AS entity, {str(lk).upper()} AS luhn, regexp_extract_all(m, {q(pat)}) AS ms, "
        f"string_split_regex(m, {q(pat)}) AS ps FROM {p}_k"
        for ent, pat, lk in dets)
    fill = ("'<' || c.entity || '>'" if labels
            else f"'{fixed.PII_PREFIX}{scope}' || CAST(c.n AS VARCHAR) || '__'")
    return f"""{p}_src AS (SELECT {id_col} AS id, {text_col} AS t0, coalesce({text_col}, '') AS t FROM {src}),
{p}_k0 AS (SELECT id, t0, t, regexp_extract_all(t, {pres}) AS ids, string_split_regex(t, {pres}) AS pp FROM {p}_src),
{p}_k AS (SELECT id, t0, ids, {interleave('pp', mask_fill, 'len(ids)')} AS m FROM {p}_k0),
{p}_d AS ({det_rows}),
{p}_u AS (SELECT id, entity, luhn, unnest(ms) AS o, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i
          FROM {p}_d WHERE len(ms) > 0),
{p}_s0 AS (
  SELECT id, entity, luhn, o AS original,
         CAST(sum(length(p) + length(o)) OVER (PARTITION BY id, entity ORDER BY i ROWS UNBOUNDED PRECEDING) - length(o) AS BIGINT) AS s
  FROM {p}_u),
{p}_s AS (SELECT id, entity, original, s, s + length(original) AS e FROM {p}_s0 WHERE NOT luhn OR {luhn('original')}),
{p}_o AS (
  SELECT id, s, e, entity, original, e - s AS len,
         max(e) OVER (PARTITION BY id ORDER BY s, e, entity, original ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pmax,
         row_number() OVER (PARTITION BY id ORDER BY s, e, entity, original) AS rn
  FROM {p}_s),
{p}_g AS (
  SELECT *, sum(CASE WHEN pmax IS NULL OR s >= pmax THEN 1 ELSE 0 END)
              OVER (PARTITION BY id ORDER BY s, e, entity, original ROWS UNBOUNDED PRECEDING) AS g
  FROM {p}_o),
{p}_mg AS (SELECT id, g - 1 AS n, min(s) AS s, max(e) AS e, arg_max(entity, len * 10000000 - rn) AS entity
           FROM {p}_g GROUP BY id, g),
{p}_c AS (SELECT id, n, s, e, entity, coalesce(lag(e) OVER (PARTITION BY id ORDER BY n), 0) AS pe FROM {p}_mg),
{p}_cut AS (
  SELECT k.id, any_value(k.t0) AS t0, any_value(k.ids) AS ids, count(c.n) AS n_spans,
         coalesce(string_agg(substr(k.m, c.pe + 1, c.s - c.pe) || {fill}, '' ORDER BY c.n), '')
           || substr(any_value(k.m), coalesce(max(c.e), 0) + 1) AS cut
  FROM {p}_k k LEFT JOIN {p}_c c ON k.id = c.id GROUP BY k.id),
{p}_out AS (
  SELECT id, t0, ids, n_spans, CASE WHEN t0 IS NULL OR t0 = '' THEN t0 ELSE {unmask('cut', 'ids')} END AS anon
  FROM {p}_cut),
{p}_map AS (
  SELECT c.id, c.n, '{fixed.PII_PREFIX}{scope}' || CAST(c.n AS VARCHAR) || '__' AS ph,
         {unmask('substr(k.m, c.s + 1, c.e - c.s)', 'k.ids')} AS original, c.entity
  FROM {p}_c c JOIN {p}_k k ON c.id = k.id),
{p}_pres AS (
  SELECT id, CAST(i - 1 AS BIGINT) AS n, '{fixed.PRESERVE_PREFIX}{scope}' || CAST(i - 1 AS VARCHAR) || '__' AS ph, x AS original
  FROM (SELECT id, unnest(ids) AS x, generate_subscripts(ids, 1) AS i FROM {p}_k WHERE len(ids) > 0))"""


def restore(text: str, pairs: str) -> str:
    """One-pass restore; ``pairs`` is a LIST of STRUCT(ph, original)."""
    pat = q(fixed.PLACEHOLDER)
    mm = f"regexp_extract_all({text}, {pat})"
    return (f"array_to_string(list_transform(string_split_regex({text}, {pat}), lambda x, i: x || "
            f"CASE WHEN i <= len({mm}) THEN coalesce(list_filter({pairs}, lambda pr: pr.ph = {mm}[i])[1].original, {mm}[i]) "
            f"ELSE '' END), '')")


def inject_ticket(resp: str, tid: str) -> str:
    t1 = f"regexp_replace({resp}, {q(fixed.TICKET_REDACTION)}, '\\1' || {tid}, 'g')"
    toks = f"regexp_extract_all({t1}, {q(fixed.REDACTION_TOKEN)})"
    t2 = f"CASE WHEN NOT contains({t1}, {tid}) AND len({toks}) = 1 THEN replace({t1}, {toks}[1], {tid}) ELSE {t1} END"
    return f"CASE WHEN {resp} IS NULL OR {resp} = '' OR {tid} IS NULL OR {tid} = '' THEN {resp} ELSE {t2} END"


def ticket_header(resp: str, tid: str) -> str:
    return (f"CASE WHEN {tid} IS NOT NULL AND {tid} <> '' AND NOT contains(coalesce({resp}, ''), {tid}) "
            f"THEN 'Ticket: ' || {tid} || chr(10) || chr(10) || coalesce({resp}, '') ELSE {resp} END")


def prompt(profile: str, ctx: str, question: str) -> str:
    if profile == "kb":
        return f"{q(fixed.KB_PROMPT_HEAD)} || {ctx} || {q(fixed.KB_PROMPT_MID)} || {question} || {q(fixed.KB_PROMPT_TAIL)}"
    return f"{ctx} || {q(fixed.SLA_PROMPT_MID)} || {question} || {q(fixed.SLA_PROMPT_TAIL)}"


def pipeline(profile: str, restore_on: bool = True) -> list[str]:
    """CTE list ending in ``final`` (query_id, ticket_id, context, prompt, response, restored, final)."""
    if profile == "sla":
        base = SLA_BASE + [QUESTIONS]
        qsrc, chunks = "questions", "sla_chunks"
    else:
        base = KB_BASE + [MESSAGES]
        qsrc, chunks = "messages", "kb_chunks"
    ctes = list(base) + [
        f"""pq AS (SELECT query_id, text, {ticket_expr('text')} AS ticket_id,
                   coalesce({ticket_expr('text')}, text) AS key FROM {qsrc})""",
        f"pqs AS (SELECT '{profile}' AS store, query_id, key FROM pq)",
        vectors("qv", "pqs", ["store", "query_id"], "key"),
        vectors("cv", chunks, ["store", "chunk_key"]),
        sparse_topk("hits", "qv", "cv", "pqs", chunks),
        f"""ctx AS (
  SELECT pq.query_id, pq.text, pq.ticket_id,
         coalesce((SELECT string_agg(c.text, ' ' ORDER BY h.rank) FROM hits h JOIN {chunks} c ON h.chunk_key = c.chunk_key
                   WHERE h.query_id = pq.query_id), '') AS context
  FROM pq)""",
        anonymize("ac", "ctx", "query_id", "context", scope="C"),
        anonymize("aq", "ctx", "query_id", "text", scope="Q"),
        """maps AS (
  SELECT id, ph, original FROM ac_map UNION ALL SELECT id, ph, original FROM aq_map UNION ALL
  SELECT id, ph, original FROM ac_pres UNION ALL SELECT id, ph, original FROM aq_pres)""",
        f"""prompts AS (
  SELECT ctx.query_id, ctx.ticket_id, ctx.context, {prompt(profile, 'ac.anon', 'aq.anon')} AS prompt
  FROM ctx JOIN ac_out ac ON ctx.query_id = ac.id JOIN aq_out aq ON ctx.query_id = aq.id)""",
        "responses AS (SELECT query_id, prompt AS response FROM prompts)",
    ]
    pat = q(fixed.PLACEHOLDER)
    ctes.append(f"""cut AS (
  SELECT query_id, generate_subscripts(pp, 1) AS i, unnest(pp) AS p, unnest(mm) AS m
  FROM (SELECT query_id, string_split_regex(response, {pat}) AS pp, regexp_extract_all(response, {pat}) AS mm FROM responses)),
joined AS (
  SELECT c.query_id, string_agg(c.p || coalesce(m.original, c.m, ''), '' ORDER BY c.i) AS restored
  FROM cut c LEFT JOIN maps m ON c.query_id = m.id AND c.m = m.ph GROUP BY c.query_id)""")
    restored = "j.restored" if restore_on else "r.response"
    ctes.append(f"""answered AS (
  SELECT p.query_id, p.ticket_id, p.context, p.prompt, r.response, {restored} AS restored
  FROM prompts p LEFT JOIN responses r ON p.query_id = r.query_id LEFT JOIN joined j ON p.query_id = j.query_id)""")
    fin = "restored"
    if profile == "sla":
        fin = (f"CASE WHEN ticket_id IS NOT NULL AND NOT contains(coalesce(restored, ''), ticket_id) "
               f"THEN {inject_ticket('restored', 'ticket_id')} ELSE restored END")
    ctes.append(f"final AS (SELECT *, {ticket_header(f'({fin})', 'ticket_id')} AS final FROM answered)")
    return ctes


# ---------------------------------------------------------------------------
# Dense top-k
# ---------------------------------------------------------------------------

def dense_topk(metric: str, k: int = fixed.TOP_K) -> str:
    if metric == "l2":
        score = ("list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: "
                 "(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2))")
        order = "score ASC, vec_id"
    else:
        dot = ("list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: "
               "CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))")
        na = "list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
        nb = "list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"
        score = f"{dot} / sqrt(greatest({na} * {nb}, 1e-300))"
        order = "score DESC, vec_id"
    return f"""SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {score} AS score
        FROM embeddings a, embeddings b)) WHERE rank <= {k}"""
