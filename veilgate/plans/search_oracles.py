"""SQL equivalents of the search queries: every score and rank over the whole corpus."""

from __future__ import annotations

from veilgate.functions.patterns import NEVER_IN_RESPONSE, QUICK_SCAN, SUSPICIOUS_IN_RESPONSE
from veilgate.functions.rules import RECOMMENDED_RULES
from veilgate.functions.text import STOP_WORDS
from veilgate.plans.tables import AS_OF, DOMAINS
from veilgate.plans.text_oracles import TEXTS, any_match, labels, redact, role, shielded

REGISTRY = f"""
registry AS (
  SELECT doc_id::VARCHAR AS document_id, lang AS domain, source AS source_uri,
    CASE WHEN doc_id % 10 = 0 THEN 'RESTRICTED' WHEN doc_id % 10 < 4 THEN 'INTERNAL'
      ELSE 'STANDARD' END AS data_class,
    doc_id % 17 <> 0 AS is_active,
    TIMESTAMP '{AS_OF}' - to_days((doc_id % 120)::INT) AS updated_at,
    CASE WHEN doc_id % 9 = 0 THEN 'older-model' ELSE 'current-model' END AS embedding_model_id,
    text FROM documents)"""

CHUNKS = f"""{REGISTRY},
worded AS (
  SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM registry),
chunks AS (
  SELECT * EXCLUDE (ws, text, i), i AS chunk_index, document_id || ':' || i AS chunk_id,
    array_to_string(ws[i * 512 + 1 : i * 512 + 512], ' ') AS chunk_text
  FROM (SELECT *, unnest(range(0, ((len(ws) + 511) // 512)::BIGINT)) AS i FROM worded))"""

VISIBLE = "data_class IN ('STANDARD', 'INTERNAL') AND is_active"


def terms(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return (
        f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: w <> '' AND w NOT IN ({stops}))"
    )


def words(text: str) -> str:
    return (
        f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    )


REQUESTS = f"""
requests AS (
  SELECT item_id::VARCHAR AS query_id, text AS query, e.embedding AS query_vector,
    [{', '.join(repr(d) for d in DOMAINS)}][(item_id % {len(DOMAINS)}) + 1] AS domain,
    TIMESTAMP '{AS_OF}' - to_days((30 + (item_id % 4) * 30)::INT) AS cutoff,
    (item_id % 6 + 1)::INT AS top_k, 'agent-' || (item_id % 7) AS agent_id,
    {role('item_id')} AS agent_role, 'session-' || (item_id % 11) AS session_id
  FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id)"""

def cosine(a: str, b: str) -> str:
    def product(x: str, y: str) -> str:
        return f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"

    lengths = f"(sqrt({product(a, a)}) * sqrt({product(b, b)}))"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {lengths} > 0 "
        f"THEN round({product(a, b)} / {lengths}, 6) ELSE 0 END"
    )


ALLOWED = """(r.domain = 'all' OR r.domain = c.domain) AND c.updated_at >= r.cutoff"""

VECTOR_TOP = f"""WITH {REGISTRY}, {REQUESTS},
scored AS (
  SELECT query_id, document_id AS chunk_id, {cosine('e.embedding', 'r.query_vector')} AS dense
  FROM registry c JOIN embeddings e ON e.vec_id::VARCHAR = document_id
    JOIN requests r ON {ALLOWED} AND r.query_vector IS NOT NULL
  WHERE {VISIBLE}),
top AS (
  SELECT *, rank() OVER (PARTITION BY query_id ORDER BY dense DESC) AS dense_rank,
    row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id) AS position
  FROM scored)"""

SCORES = f"""{CHUNKS}, {REQUESTS},
indexed AS (
  SELECT c.*, {terms('chunk_text')} AS terms, e.embedding
  FROM chunks c LEFT JOIN embeddings e ON e.vec_id::VARCHAR = c.document_id WHERE {VISIBLE}),
stats AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS avgdl FROM indexed),
asked AS (SELECT query_id, unnest(list_distinct({terms('query')})) AS term FROM requests),
tf AS (
  SELECT chunk_id, len(terms) AS dl, term, count(*) AS tf
  FROM (SELECT chunk_id, terms, unnest(terms) AS term FROM indexed) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
matched AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
      / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS sparse
  FROM asked JOIN dfs USING (term) JOIN tf USING (term) CROSS JOIN stats
  GROUP BY query_id, chunk_id),
pairs AS (
  SELECT r.query_id, c.chunk_id, coalesce(m.sparse, 0) AS sparse,
    {cosine('c.embedding', 'r.query_vector')} AS dense
  FROM requests r JOIN indexed c ON {ALLOWED}
    LEFT JOIN matched m ON m.query_id = r.query_id AND m.chunk_id = c.chunk_id),
ranked_pairs AS (
  SELECT *, rank() OVER (PARTITION BY query_id ORDER BY dense DESC NULLS LAST) AS dense_rank,
    rank() OVER (PARTITION BY query_id ORDER BY sparse DESC) AS sparse_rank FROM pairs),
fused AS (
  SELECT *, 1.0::DOUBLE / (60 + dense_rank) + 1.0::DOUBLE / (60 + sparse_rank) AS combined
  FROM ranked_pairs),
found AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, chunk_id) AS position
  FROM fused QUALIFY position <= 10)"""


def scores(name: str = "found_chunks") -> str:
    """The hybrid result under another name, since the detection CTEs use ``found``."""
    return SCORES.replace("found AS (", f"{name} AS (")


SINGLE_WORD = REQUESTS.replace("text AS query", "regexp_extract(text, '(\\S+)\\s*$', 1) AS query").replace(
    "e.embedding AS query_vector", "NULL::FLOAT[] AS query_vector"
)
HALF_BLIND = REQUESTS.replace(
    f"TIMESTAMP '{AS_OF}' - to_days((30 + (item_id % 4) * 30)::INT) AS cutoff",
    f"CASE WHEN item_id % 2 = 0 THEN TIMESTAMP '2099-01-01' ELSE "
    f"TIMESTAMP '{AS_OF}' - to_days((30 + (item_id % 4) * 30)::INT) END AS cutoff",
)


def governed(drop: bool) -> str:
    keep = "WHERE status = 'ok'" if drop else ""
    return f"""{TEXTS}, {scores()},
{shielded('requests', 'query_id', 'query', RECOMMENDED_RULES, more='_q')},
hits AS (
  SELECT f.query_id || '|' || f.chunk_id AS hit_id, f.query_id, f.chunk_id, i.document_id,
    i.chunk_text, r.agent_role, combined
  FROM found_chunks f JOIN indexed i USING (chunk_id) JOIN requests r ON r.query_id = f.query_id),
{shielded('hits', 'hit_id', 'chunk_text', RECOMMENDED_RULES)},
calls AS (
  SELECT *, coalesce(safe_text <> chunk_text, FALSE) AS was_modified,
    count(*) OVER (PARTITION BY query_id) AS total_found,
    bool_or(status = 'blocked') OVER (PARTITION BY query_id) AS any_blocked,
    bool_or(coalesce(safe_text <> chunk_text, FALSE)) OVER (PARTITION BY query_id) AS pii_detected
  FROM done),
places AS (
  SELECT c.*, q.agent_id, q.session_id, q.top_k,
    CASE WHEN q.status = 'blocked' THEN q.query ELSE q.safe_text END AS safe_query,
    row_number() OVER (PARTITION BY c.query_id ORDER BY combined DESC, chunk_id) AS position
  FROM calls c JOIN done_q q USING (query_id) {keep.replace('status', 'c.status')}),
returned_rows AS (
  SELECT *, count(*) OVER (PARTITION BY query_id) AS returned FROM places
  WHERE position <= least(top_k, 20, 3))"""


GOVERNED = f"""governed AS (
  SELECT query_id, agent_id, agent_role, session_id, safe_query AS query,
    CASE WHEN any_blocked THEN 'blocked' ELSE 'ok' END AS status,
    CASE WHEN any_blocked THEN 0 ELSE total_found END AS total_found,
    CASE WHEN any_blocked THEN 0 ELSE returned END AS returned,
    CASE WHEN any_blocked THEN 0 ELSE position END::INT AS position,
    CASE WHEN NOT any_blocked THEN chunk_id END AS chunk_id,
    CASE WHEN NOT any_blocked THEN document_id END AS document_id,
    CASE WHEN NOT any_blocked THEN safe_text END AS text,
    CASE WHEN NOT any_blocked THEN round(combined, 4) END AS score,
    was_modified AND NOT any_blocked AS pii_masked,
    pii_detected OR any_blocked AS pii_detected
  FROM returned_rows WHERE NOT any_blocked OR position = 1)"""

ASSEMBLED = """assembled AS (
  SELECT query_id, agent_id, agent_role, session_id, query,
    'Context:' || chr(10) || string_agg('[' || position || '] ' || text, chr(10) ORDER BY position)
    || chr(10) || 'Question: ' || query AS prompt
  FROM {rows} GROUP BY query_id, agent_id, agent_role, session_id, query)"""


def guarded_prompts() -> str:
    return f"""looked AS (
  SELECT *, {any_match('prompt', QUICK_SCAN)} AS suspect,
    CASE WHEN {any_match('prompt', QUICK_SCAN)} THEN prompt END AS inspected FROM assembled),
{shielded('looked', 'query_id', 'inspected', RECOMMENDED_RULES, more='_p')},
prompts_done AS (
  SELECT *, CASE WHEN status = 'blocked' THEN 'blocked'
      WHEN coalesce(safe_text <> inspected, FALSE) THEN 'sanitized' ELSE 'passed' END AS action,
    status = 'blocked' OR coalesce(safe_text <> inspected, FALSE) AS detected,
    CASE WHEN status = 'blocked' THEN NULL WHEN suspect THEN safe_text ELSE prompt END AS safe_prompt
  FROM done_p)"""


QUALITY = f"""WITH asked AS (
  SELECT u.conv_id, u.turn, {words('u.text')} AS q, {words('n.text')} AS a,
    list_filter([b.text, f.text], lambda x: x IS NOT NULL) AS ctx
  FROM conversations u JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 1
    LEFT JOIN conversations b ON b.conv_id = u.conv_id AND b.turn = u.turn - 1
    LEFT JOIN conversations f ON f.conv_id = u.conv_id AND f.turn = u.turn + 2
  WHERE u.role = 'user'),
split AS (
  SELECT conv_id, turn, list_distinct(q) AS q, list_distinct(a) AS a, len(ctx) AS num_chunks,
    list_transform(ctx, lambda c: {words('c')}) AS cs FROM asked),
flags AS (
  SELECT *, list_distinct(flatten(cs)) AS everything,
    list_transform(cs, lambda c: len(list_intersect(c, q)) > 0) AS hits FROM split),
gains AS (
  SELECT *, len(list_filter(hits, lambda h: h)) AS found,
    list_transform(range(1, len(hits) + 1), lambda i: CASE WHEN hits[i]
      THEN len(list_filter(hits[1:i], lambda h: h)) / i ELSE 0.0 END) AS g FROM flags),
scored AS (
  SELECT conv_id, turn, num_chunks::INT AS num_chunks,
    round(CASE WHEN len(a) > 0 THEN len(list_intersect(everything, a)) / len(a) ELSE 0 END, 3)
      AS faithfulness,
    round(CASE WHEN len(q) > 0 THEN len(list_intersect(a, q)) / len(q) ELSE 0 END, 3)
      AS answer_relevancy,
    round(CASE WHEN found > 0 THEN coalesce(list_sum(g), 0) / found ELSE 0 END, 3) AS context_precision,
    round(CASE WHEN len(q) > 0 THEN len(list_intersect(everything, q)) / len(q) ELSE 0 END, 3)
      AS context_recall FROM gains)
SELECT *, CASE WHEN least(faithfulness, answer_relevancy, context_precision, context_recall) >= 0.7
    THEN 'PASS' ELSE 'REVIEW_REQUIRED' END AS quality_gate,
  CASE WHEN least(faithfulness, answer_relevancy, context_precision, context_recall) >= 0.7
    THEN 'Retrieval quality meets threshold for agent use.'
    ELSE 'Review chunking strategy or re-ranking configuration.' END AS recommendation
FROM scored"""


def component(key: str, place: int) -> str:
    """Number ``place`` (1-based, up to 16) of the pseudo vector of a text key."""
    start = (place - 1) * 4 + 1
    return f"(('0x' || substr(sha256({key} || ':0'), {start}, 4))::INT / 32768.0 - 1.0)"


KEY = "md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))"
ALL_COMPONENTS = ", ".join(component("md5(text)", i) for i in range(1, 17))

DOCUMENTS_ASKED = f"""{REGISTRY}, asked AS (
  SELECT c_custkey AS request_id, c_custkey::VARCHAR AS document_id, text, source_uri AS title,
    {role('c_nationkey')} AS agent_role
  FROM customer LEFT JOIN registry ON document_id = c_custkey::VARCHAR AND {VISIBLE})"""

ORACLES = {
    "chunking": f"""WITH {CHUNKS}
SELECT chunk_id, document_id, chunk_index::INT AS chunk_index, chunk_text FROM chunks""",
    "chunk_counts": f"""WITH {CHUNKS}
SELECT document_id, count(*) AS total_chunks FROM chunks GROUP BY document_id""",
    "safe_chunks": f"""WITH {CHUNKS},
{shielded('chunks', 'chunk_id', 'chunk_text', RECOMMENDED_RULES, None)}
SELECT chunk_id, safe_text AS chunk_text_safe,
  array_to_string(list_sort(list_distinct(types)), ',') AS pii_classification FROM done""",
    "prefilter_rls": f"""WITH {REGISTRY}
SELECT document_id, domain, data_class, updated_at FROM registry
WHERE {VISIBLE} AND domain = 'en' AND updated_at >= TIMESTAMP '{AS_OF}' - to_days(90)""",
    "text_terms": f"""WITH exploded AS (
  SELECT doc_id, unnest({terms("coalesce(text, '')")}) AS term FROM documents)
SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM exploded GROUP BY term""",
    "l2_normalize": """WITH unit AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x:
    x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)
SELECT vec_id, round(u[1], 6) AS first, round(list_sum(u), 6) AS total FROM unit""",
    "dim_check": "SELECT vec_id, coalesce(label, -1) <> 3 AND len(embedding) = 64 AS dimension_ok FROM embeddings",
    "reembed_needed": f"""WITH {REGISTRY}
SELECT document_id FROM registry WHERE embedding_model_id IS DISTINCT FROM 'current-model'""",
    "demo_embed": f"""WITH {TEXTS}, raw AS (SELECT text_id, [{ALL_COMPONENTS}]::DOUBLE[] AS v FROM texts)
SELECT text_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first,
  round(v[16] / sqrt(list_dot_product(v, v)), 6) AS last FROM raw""",
    "embed_dedup": f"""WITH {TEXTS},
keyed AS (SELECT text_id, text, {KEY} AS text_key FROM texts)
SELECT text_id, text_key, {component('text_key', 1)}::DOUBLE AS first FROM keyed""",
    "cache_hit_rate": f"""WITH {TEXTS}
SELECT count(*) AS calls, count(DISTINCT {KEY}) AS distinct_texts,
  round(1 - count(DISTINCT {KEY}) / count(*), 6) AS hit_rate FROM texts""",
    "dense_topk": f"{VECTOR_TOP} SELECT * FROM top WHERE position <= 10",
    "ann_topk": f"{VECTOR_TOP} SELECT * FROM top WHERE position <= 10",
    "min_score": f"""{VECTOR_TOP}
SELECT query_id, chunk_id, dense FROM top WHERE position <= 10 AND dense >= 0.4""",
    "bm25_topk": f"""WITH {SCORES},
hits AS (SELECT query_id, chunk_id, sparse FROM pairs WHERE sparse > 0)
SELECT *, rank() OVER (PARTITION BY query_id ORDER BY sparse DESC) AS sparse_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, chunk_id) AS position
FROM hits QUALIFY position <= 10""",
    "rrf_search": f"""WITH {SCORES}
SELECT query_id, chunk_id, coalesce(dense, -9) AS dense, sparse, dense_rank, sparse_rank,
  round(combined, 10) AS combined, position FROM found""",
    "governed_search": f"WITH {governed(False)}, {GOVERNED} SELECT * FROM governed",
    "governed_search_drop": f"""WITH {governed(True)}
SELECT query_id, total_found, returned, position::INT AS position, chunk_id, safe_text AS text,
  was_modified AS pii_masked FROM returned_rows
UNION ALL SELECT query_id, (SELECT count(*) FROM calls c WHERE c.query_id = r.query_id), 0, 0, NULL, NULL, FALSE
FROM requests r WHERE query_id NOT IN (SELECT query_id FROM returned_rows)""",
    "sparse_hits_search": f"""WITH {SCORES.replace(REQUESTS, SINGLE_WORD)}
SELECT query_id, chunk_id, sparse, dense_rank, sparse_rank, position FROM found""",
    "empty_search_calls": f"""WITH {governed(True).replace(REQUESTS, HALF_BLIND)},
answered AS (
  SELECT query_id, total_found, returned, position::INT AS position, chunk_id FROM returned_rows
  UNION ALL SELECT query_id, (SELECT count(*) FROM calls c WHERE c.query_id = r.query_id), 0, 0, NULL
  FROM requests r WHERE query_id NOT IN (SELECT query_id FROM returned_rows))
SELECT *, (count(chunk_id) OVER (PARTITION BY query_id))::INT AS logged_chunks FROM answered""",
    "search_audit": f"""WITH {governed(False)}, {GOVERNED}
SELECT sha256('MCP_TOOL_CALL' || chr(1) || query_id) AS event_id,
  'search_knowledge_base' AS tool_name, agent_id, agent_role, session_id,
  sha256(query) AS query_hash, string_agg(chunk_id, ',' ORDER BY position) AS chunk_ids,
  pii_detected, 'INFO' AS severity
FROM governed WHERE status = 'ok' GROUP BY query_id, agent_id, agent_role, session_id, query, pii_detected""",
    "context_assembly": f"""WITH {governed(False)}, {GOVERNED},
fine AS (SELECT * FROM governed WHERE status = 'ok'),
{ASSEMBLED.format(rows='fine')}, {guarded_prompts()}
SELECT query_id, action, detected AS pii_detected, safe_prompt FROM prompts_done""",
    "answer_flow": f"""WITH {governed(True)},
fine AS (
  SELECT query_id, agent_id, agent_role, session_id, safe_query AS query, position,
    safe_text AS text FROM returned_rows),
{ASSEMBLED.format(rows='fine')}, {guarded_prompts()},
said AS (
  SELECT query_id, safe_prompt AS response, {labels('safe_prompt', NEVER_IN_RESPONSE)} AS never,
    {labels('safe_prompt', SUSPICIOUS_IN_RESPONSE)} AS odd
  FROM prompts_done WHERE action <> 'blocked')
SELECT query_id, len(never) > 0 AS leakage,
  CASE WHEN len(never) > 0 THEN 1.0 WHEN len(odd) > 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS risk,
  CASE WHEN len(never) > 0 THEN 'sanitized' WHEN len(odd) > 0 THEN 'logged' ELSE 'passed' END AS action,
  CASE WHEN len(never) > 0 THEN {redact('response', [p for _, p in NEVER_IN_RESPONSE])}
    ELSE response END AS safe_response FROM said""",
    "document_fetch": f"""WITH {DOCUMENTS_ASKED},
{shielded('asked', 'request_id', 'text', RECOMMENDED_RULES)}
SELECT request_id, document_id,
  CASE WHEN text IS NULL THEN 'Document not found or access denied' END AS error, status,
  safe_text AS content, coalesce(safe_text <> text, FALSE) AS pii_masked, title FROM done""",
    "document_audit": f"""WITH {DOCUMENTS_ASKED},
{shielded('asked', 'request_id', 'text', RECOMMENDED_RULES)}
SELECT sha256('MCP_TOOL_CALL' || chr(1) || 'get_document' || chr(1) || request_id) AS event_id,
  'get_document' AS tool_name, agent_role, CASE WHEN text IS NULL THEN '' ELSE document_id END AS chunk_ids,
  coalesce(safe_text <> text, FALSE) AS pii_detected,
  CASE WHEN text IS NULL OR status = 'blocked' THEN 'WARNING' ELSE 'INFO' END AS severity FROM done""",
    "quality_gate": QUALITY,
}

ORACLES["bm25_scan"] = ORACLES["bm25_topk"]
ORACLES["search_metadata"] = f"""WITH {governed(False)}, {GOVERNED}
SELECT query_id, position, g.chunk_id, i.domain, i.source_uri, i.updated_at
FROM governed g LEFT JOIN indexed i ON i.chunk_id = g.chunk_id"""
ORACLES["search_refusals"] = f"""WITH {governed(False)}, {GOVERNED}
SELECT sha256('PII_BLOCKED' || chr(1) || query_id) AS event_id, 'PII_BLOCKED' AS event_type, agent_id, session_id,
  sha256(query) AS query_hash, 'WARNING' AS severity, TIMESTAMP '{AS_OF}' AS timestamp FROM governed WHERE status = 'blocked'"""
