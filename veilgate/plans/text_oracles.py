"""SQL equivalents of the text queries, written from the rules and patterns alone."""

from __future__ import annotations

from veilgate.functions.patterns import (
    NEVER_IN_RESPONSE,
    QUERY_REDACTION,
    QUICK_SCAN,
    RECOGNISERS,
    SUSPICIOUS_IN_RESPONSE,
)
from veilgate.functions.rules import FALLBACK_RULES, RECOMMENDED_RULES, RuleSet
from veilgate.operators.access import DEFAULT_POLICY
from veilgate.plans.tables import ROLES
from veilgate.plans.text_queries import EVERYTHING_MASKED, EVERYTHING_TOKENS, SWEEP


def role(number: str) -> str:
    return f"[{', '.join(repr(r) for r in ROLES)}][({number} % {len(ROLES)}) + 1]"


def pattern(text: str, ignore_case: bool = False) -> str:
    return "'" + ("(?i)" if ignore_case else "") + text + "'"


NOTES = f"""
notes AS (
  SELECT 'note:' || c_custkey AS text_id,
    'Account ENT-' || lpad((c_custkey % 10000000000)::VARCHAR, 10, '0')
    || ' mail user' || c_custkey || '@example.com'
    || ' call 415-555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
    || CASE c_mktsegment
         WHEN 'BUILDING' THEN ' SSN ' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '-45-'
           || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
         WHEN 'AUTOMOBILE' THEN ' card 4532-0151-1283-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
         WHEN 'MACHINERY' THEN ' acct #' || lpad((c_custkey % 1000000000000)::VARCHAR, 12, '0')
         WHEN 'HOUSEHOLD' THEN ' ref AB-' || lpad((c_custkey % 10000000000)::VARCHAR, 10, '0') || ' ok'
         ELSE '' END AS text,
    {role('c_nationkey')} AS agent_role
  FROM customer)"""

TEXTS = (
    NOTES
    + f""",
texts AS (
  SELECT 'doc:' || doc_id AS text_id, text, {role('doc_id')} AS agent_role FROM documents
  UNION ALL SELECT 'page:' || page_id, html, {role('page_id')} FROM pages
  UNION ALL SELECT 'turn:' || conv_id || ':' || turn, text, {role('conv_id')} FROM conversations
  UNION ALL SELECT text_id, text, agent_role FROM notes)"""
)


def spans(source: str, key: str, text: str, rules: RuleSet | None, more: str = "") -> str:
    """``found`` CTE: every match with its offsets; gated by the thresholds of ``rules``."""
    parts = []
    for i, r in enumerate(RECOGNISERS):
        if rules is not None and r.score < rules.threshold(r.entity_type):
            continue
        p = pattern(r.pattern, r.ignore_case)
        parts.append(
            f"SELECT {key} AS k, {i} AS ord, '{r.entity_type}' AS entity_type, "
            f"{r.score}::DOUBLE AS score, regexp_extract_all({text}, {p}) AS ms, "
            f"string_split_regex({text}, {p}) AS ps FROM {source}"
        )
    return f"""
matches{more} AS ({' UNION ALL '.join(parts)}),
found{more} AS (
  SELECT k, ord, entity_type, score, ms[i] AS original,
    (list_sum(list_transform(ps[1:i], lambda x: length(x)))
     + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::INT AS s,
    length(ms[i])::INT AS w
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM matches{more} WHERE len(ms) > 0))"""


CHOSEN_TYPE = "STRUCT(s INT, e INT, entity_type VARCHAR, original VARCHAR)[]"


def chosen(more: str = "") -> str:
    """``kept`` CTE: greedy choice per text, widest first."""
    return f"""
ranked{more} AS (
  SELECT k, list({{'s': s, 'e': s + w, 'entity_type': entity_type, 'original': original}}
    ORDER BY w DESC, score DESC, ord, s) AS l FROM found{more} GROUP BY k),
kept{more} AS (
  SELECT k, unnest(list_reduce(l, lambda acc, c: CASE
      WHEN len(list_filter(acc, lambda z: z.s < c.e AND z.e > c.s)) > 0 THEN acc
      ELSE list_append(acc, c) END, []::{CHOSEN_TYPE})) AS d FROM ranked{more})"""


def mode_case(rules: RuleSet, entity: str = "d.entity_type") -> str:
    cases = " ".join(f"WHEN '{r.entity_type}' THEN '{r.mode}'" for r in rules.rules)
    return f"CASE {entity} {cases} ELSE '{rules.global_mode}' END"


def exempt_case(rules: RuleSet, who: str = "agent_role", entity: str = "d.entity_type") -> str:
    tests = [
        f"({entity} = '{r.entity_type}' AND {who} IN ({', '.join(repr(x) for x in r.allowed_agent_roles)}))"
        for r in rules.rules
        if r.allowed_agent_roles
    ]
    return f"coalesce({' OR '.join(tests) or 'FALSE'}, FALSE)"


def shielded(
    source: str, key: str, text: str, rules: RuleSet, who: str | None = "agent_role", more: str = ""
) -> str:
    """``done`` CTE: one row per source row with the protected text and the applied detections."""
    exempt = exempt_case(rules, f"t.{who}") if who else "FALSE"
    mode = mode_case(rules)
    return (
        spans(source, key, text, rules, more)
        + ","
        + chosen(more)
        + f""",
applied{more} AS (
  SELECT k, d.s AS s, d.e AS e, d.entity_type AS entity_type, d.original AS original,
    CASE WHEN {exempt} THEN 'mask' ELSE {mode} END AS mode,
    CASE WHEN {exempt} THEN d.original
      WHEN {mode} = 'token' THEN
        '[' || d.entity_type || ':' || upper(substr(sha256(d.original), 1, 8)) || ']'
      ELSE '[' || d.entity_type || ']' END AS repl
  FROM kept{more} JOIN {source} t ON t.{key} = k),
perk{more} AS (
  SELECT k, list({{'s': s, 'e': e, 'repl': repl}} ORDER BY s DESC) AS l,
    list(entity_type ORDER BY s DESC) AS types, list(mode ORDER BY s DESC) AS modes,
    arg_max(entity_type, s) FILTER (mode = 'block') AS blocked_type
  FROM applied{more} GROUP BY k),
done{more} AS (
  SELECT t.*, coalesce(types, []) AS types, coalesce(modes, []) AS modes, blocked_type,
    CASE WHEN blocked_type IS NULL THEN 'ok' ELSE 'blocked' END AS status,
    CASE WHEN blocked_type IS NULL THEN coalesce(list_reduce(l, lambda acc, c:
      substr(acc, 1, c.s) || c.repl || substr(acc, c.e + 1), {text}), {text}) END AS safe_text
  FROM {source} t LEFT JOIN perk{more} ON t.{key} = k)"""
    )


def on_texts(rules: RuleSet, select: str, who: str | None = "agent_role") -> str:
    return f"WITH {TEXTS}, {shielded('texts', 'text_id', 'text', rules, who)} {select}"


def redact(expression: str, patterns) -> str:
    for p in patterns:
        expression = f"regexp_replace({expression}, {pattern(p)}, '[REDACTED]', 'g')"
    return expression


def any_match(expression: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({expression}, {pattern(p)})" for p in patterns) + ")"


def labels(expression: str, labelled) -> str:
    items = ", ".join(
        f"CASE WHEN regexp_matches({expression}, {pattern(p)}) THEN '{name}' END"
        for name, p in labelled
    )
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


SAFE_FLAG = "coalesce(safe_text <> text, FALSE) AS was_modified"
SESSION = "'session-' || substr(md5(text_id), 1, 4)"

PROMPTS = f"""prompts AS (
  SELECT text_id AS prompt_id, text AS prompt, 'agent-' || agent_role AS agent_id, agent_role,
    {SESSION} AS session_id
  FROM texts WHERE text_id LIKE 'turn:%' OR text_id LIKE 'note:%'),
scanned AS (
  SELECT *, {any_match('prompt', QUICK_SCAN)} AS suspect,
    CASE WHEN {any_match('prompt', QUICK_SCAN)} THEN prompt END AS inspected FROM prompts)"""


def guarded_prompts(strict: bool) -> str:
    on_block = "NULL" if strict else redact("prompt", QUICK_SCAN)
    return f"""WITH {TEXTS}, {PROMPTS},
{shielded('scanned', 'prompt_id', 'inspected', RECOMMENDED_RULES)},
guarded AS (
  SELECT *, status = 'blocked' AS blocked,
    coalesce(safe_text <> inspected, FALSE) AS was_modified FROM done),
final AS (
  SELECT *, CASE WHEN blocked THEN '{'blocked' if strict else 'sanitized'}'
      WHEN was_modified THEN 'sanitized' ELSE 'passed' END AS action,
    blocked OR was_modified AS pii_detected,
    CASE WHEN blocked THEN [blocked_type] ELSE types END AS entities,
    CASE WHEN blocked THEN {on_block} WHEN suspect THEN safe_text ELSE prompt END AS safe_prompt
  FROM guarded)"""


PROMPT_COLUMNS = """SELECT prompt_id, action, pii_detected,
  array_to_string(entities, ',') AS entities_found, safe_prompt FROM final"""

RESPONSES = f"""responses AS (
  SELECT text_id AS response_id, text AS response, 'agent-' || agent_role AS agent_id,
    {SESSION} AS session_id,
    {labels('text', NEVER_IN_RESPONSE)} AS never, {labels('text', SUSPICIOUS_IN_RESPONSE)} AS odd
  FROM texts)"""

DOC_FOUND = spans("documents", "doc_id", "text", None)


def _sweep() -> str:
    levels = ", ".join(f"({t}::DOUBLE)" for t in SWEEP)
    return f"""WITH {DOC_FOUND}, levels(threshold) AS (VALUES {levels}),
per AS (SELECT k, entity_type, score, count(*) AS n FROM found GROUP BY ALL)
SELECT entity_type, coalesce(quality, -1) AS quality, threshold, sum(n)::BIGINT AS detections, count(*) AS texts
FROM (SELECT entity_type, quality, threshold, k, score, n
      FROM per LEFT JOIN labels ON labels.doc_id = k JOIN levels ON score >= threshold)
GROUP BY entity_type, quality, threshold"""


def _quality() -> str:
    levels = ", ".join(f"({t}::DOUBLE)" for t in SWEEP)
    return f"""WITH {NOTES}, {spans('notes', 'text_id', 'text', None)},
levels(threshold) AS (VALUES {levels}),
truth AS (
  SELECT 'note:' || c_custkey AS text_id, unnest(list_filter(['ACCOUNT_NUMBER', 'EMAIL_ADDRESS',
    'PHONE_NUMBER', CASE c_mktsegment WHEN 'BUILDING' THEN 'US_SSN'
      WHEN 'AUTOMOBILE' THEN 'CREDIT_CARD' END], lambda x: x IS NOT NULL)) AS entity_type
  FROM customer),
hits AS (SELECT DISTINCT threshold, k, entity_type FROM found JOIN levels ON score >= threshold),
counted AS (
  SELECT threshold,
    (SELECT count(*) FROM hits h JOIN truth t ON t.text_id = h.k AND t.entity_type = h.entity_type
      WHERE h.threshold = l.threshold) AS true_positives,
    (SELECT count(*) FROM hits h WHERE h.threshold = l.threshold) AS reported,
    (SELECT count(*) FROM truth) AS expected
  FROM levels l)
SELECT threshold, true_positives, reported, expected,
  round(CASE WHEN reported > 0 THEN true_positives / reported END, 6) AS precision,
  round(CASE WHEN expected > 0 THEN true_positives / expected END, 6) AS recall FROM counted"""


SPLIT = f"""WITH {TEXTS},
worded AS (
  SELECT text_id, array_to_string(
    list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS line FROM texts),
{spans('worded', 'text_id', 'line', RECOMMENDED_RULES)}, {chosen()},
placed AS (
  SELECT text_id, d.entity_type AS entity_type, length(d.original)::INT AS length,
    ((d.s - length(replace(substr(line, 1, d.s), ' ', ''))) // 3)::INT AS chunk_index,
    ((d.e - 1 - length(replace(substr(line, 1, d.e - 1), ' ', ''))) // 3)::INT AS last_chunk_index
  FROM kept JOIN worded ON text_id = k)
SELECT text_id, chunk_index, last_chunk_index, entity_type, length FROM placed
WHERE chunk_index < last_chunk_index"""

ORACLES = {
    "pii_spans": f"""WITH {TEXTS}, {spans('texts', 'text_id', 'text', None)}
SELECT k AS text_id, entity_type, s AS start, s + w AS "end", score, original FROM found""",
    "pii_overlap": f"""WITH {TEXTS}, {spans('texts', 'text_id', 'text', EVERYTHING_MASKED)}, {chosen()}
SELECT k AS text_id, d.entity_type AS entity_type, d.s AS start, d.e AS "end" FROM kept""",
    "pii_mask": on_texts(
        EVERYTHING_MASKED, f"SELECT text_id, safe_text, {SAFE_FLAG} FROM done", None
    ),
    "pii_token": on_texts(
        EVERYTHING_TOKENS,
        """, tokens AS (SELECT k, count(DISTINCT repl)::INT AS n FROM applied GROUP BY k)
SELECT text_id, safe_text, coalesce(n, 0) AS tokens FROM done LEFT JOIN tokens ON k = text_id""",
        None,
    ),
    "pii_block_status": on_texts(
        RECOMMENDED_RULES, f"SELECT text_id, status, blocked_type, {SAFE_FLAG} FROM done"
    ),
    "pii_role_exempt": on_texts(
        RECOMMENDED_RULES,
        """SELECT text_id, agent_role, array_to_string(types, ',') AS entity_types,
  array_to_string(modes, ',') AS modes, safe_text FROM done""",
    ),
    "pii_policy_grants": on_texts(
        DEFAULT_POLICY.rules_for(FALLBACK_RULES),
        "SELECT text_id, status, blocked_type, safe_text FROM done",
    ),
    "pii_violations": on_texts(
        RECOMMENDED_RULES,
        """SELECT text_id, agent_role AS agent_id, blocked_type AS entity_types,
  sha256(text_id || chr(1) || blocked_type) AS violation_id FROM done WHERE status = 'blocked'""",
    ),
    "pii_vault": on_texts(
        EVERYTHING_TOKENS,
        "SELECT DISTINCT repl AS token, original FROM applied",
        None,
    ),
    "pii_detokenize": f"WITH {TEXTS} SELECT text_id, text AS restored_text FROM texts",
    "pii_audit": on_texts(
        RECOMMENDED_RULES,
        f"""SELECT sha256('PII_PROCESSED' || chr(1) || text_id) AS event_id,
  'PII_PROCESSED' AS event_type, agent_role AS agent_id, 'prompt:' || text_id AS context_id,
  array_to_string(types, ',') AS entity_types, array_to_string(modes, ',') AS modes_applied,
  {SAFE_FLAG} FROM done WHERE len(types) > 0 AND status = 'ok'""",
    ),
    "pii_classify": on_texts(
        EVERYTHING_MASKED,
        "SELECT text_id, array_to_string(list_sort(list_distinct(types)), ',') AS types FROM done",
        None,
    ),
    "token_xref": on_texts(
        EVERYTHING_TOKENS,
        """SELECT repl AS token, count(*) AS occurrences, count(DISTINCT k) AS texts
FROM applied GROUP BY repl""",
        None,
    ),
    "threshold_sweep": _sweep(),
    "threshold_quality": _quality(),
    "split_entities": SPLIT,
    "prompt_guard": f"{guarded_prompts(True)} {PROMPT_COLUMNS}",
    "prompt_redact": f"{guarded_prompts(False)} {PROMPT_COLUMNS}",
    "response_guard": f"""WITH {TEXTS}, {RESPONSES}
SELECT response_id, len(never) > 0 AS leakage,
  array_to_string(CASE WHEN len(never) > 0 THEN never ELSE odd END, ',') AS entities_found,
  CASE WHEN len(never) > 0 THEN 1.0 WHEN len(odd) > 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS risk,
  CASE WHEN len(never) > 0 THEN 'sanitized' WHEN len(odd) > 0 THEN 'logged' ELSE 'passed' END
    AS action,
  CASE WHEN len(never) > 0 THEN {redact('response', [p for _, p in NEVER_IN_RESPONSE])}
    ELSE response END AS safe_response
FROM responses""",
    "response_escalations": f"""WITH {TEXTS}, {RESPONSES}
SELECT sha256('PII_LEAKAGE_DETECTED' || chr(1) || response_id) AS event_id,
  'CRITICAL' AS severity, response_id AS inspection_id, 'prompt:' || response_id AS prompt_inspection_id,
  agent_id, session_id,
  array_to_string(never, ',') AS entities_leaked, 'IMMEDIATE_REVIEW' AS action_required
FROM responses WHERE len(never) > 0""",
    "guard_events": f"""{guarded_prompts(False)}, {RESPONSES},
log AS (
  SELECT 'PROMPT_BLOCKED' AS event_type, 'HIGH' AS severity, NULL AS action, agent_id, entities
  FROM final WHERE blocked
  UNION ALL
  SELECT 'PROMPT_INSPECTED', CASE WHEN len(entities) > 0 THEN 'WARNING' ELSE 'INFO' END, action,
    agent_id, entities FROM final WHERE suspect
  UNION ALL
  SELECT 'RESPONSE_INSPECTED', CASE WHEN len(odd) > 0 THEN 'WARNING' ELSE 'INFO' END,
    CASE WHEN len(odd) > 0 THEN 'logged' ELSE 'passed' END, agent_id, odd
  FROM responses WHERE len(never) = 0)
SELECT event_type, severity, action, agent_id, count(*) AS events,
  sum(len(entities))::BIGINT AS entities FROM log GROUP BY ALL""",
    "query_sanitize": on_texts(
        RECOMMENDED_RULES,
        f"""SELECT text_id, CASE WHEN status = 'blocked' THEN {redact('text', QUERY_REDACTION)}
  ELSE safe_text END AS safe_query, status = 'blocked' AS query_redacted FROM done""",
    ),
}
