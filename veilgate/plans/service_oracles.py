"""SQL equivalents of the access, feature, audit, governance and lineage queries."""

from __future__ import annotations

from veilgate.functions.rules import FALLBACK_RULES, RECOMMENDED_RULES
from veilgate.operators.access import DEFAULT_POLICY, GOVERNANCE_ROLES, TOOL_ROLES
from veilgate.operators.audit import EVENT_TYPES, SEVERITIES
from veilgate.operators.features import FEATURE_SETS, NO_CONTEXT, RAW_ID_ERROR, TOKEN_ERROR
from veilgate.operators.governance import ALERT_LIMITS
from veilgate.plans.search_oracles import CHUNKS, REGISTRY
from veilgate.plans.service_queries import CALLER, CONTRACT, WINDOW
from veilgate.plans.tables import AS_OF, AUDIT_ROLES, AUDIT_TOOLS, FEATURE_SETS_BY_PRIORITY, ROLES
from veilgate.plans.text_oracles import shielded, spans


def one_of(values, number: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({number}) % {len(values)} + 1]"


def listed(values) -> str:
    return ", ".join(repr(v) for v in values)


def cases(mapping: dict, default: str) -> str:
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}'"


AUDIT = f"""
numbered AS (
  SELECT *, json_extract_string(props, '$.k')::INT AS k,
    'agent-' || lpad(user_id::VARCHAR, 6, '0') AS agent_id FROM events),
audit AS (
  SELECT event_id AS n, 'evt-' || event_id AS event_id,
    CASE WHEN k >= 98 THEN 'PII_LEAKAGE' WHEN k >= 95 THEN 'PROMPT_BLOCKED'
      WHEN k >= 90 THEN 'PII_BLOCKED' WHEN k >= 80 THEN 'PII_PROCESSED' ELSE 'MCP_TOOL_CALL' END
      AS event_type,
    CASE event_type {cases(AUDIT_TOOLS, 'evaluate_retrieval_quality')} END AS tool_name, agent_id,
    {one_of(AUDIT_ROLES, 'user_id')} AS agent_role,
    agent_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
    sha256('query ' || event_id) AS query_hash,
    [(event_id // 10) || ':0', (event_id // 20) || ':0'] AS chunk_ids,
    k % 4 = 0 AS pii_detected,
    CASE WHEN k % 4 <> 0 THEN []::VARCHAR[] WHEN k >= 90 THEN ['US_SSN', 'EMAIL_ADDRESS']
      WHEN k % 8 = 0 THEN ['EMAIL_ADDRESS', 'PHONE_NUMBER'] ELSE ['ACCOUNT_NUMBER'] END AS types,
    CASE WHEN k % 4 <> 0 THEN []::VARCHAR[] WHEN k >= 90 THEN ['block', 'mask']
      WHEN k % 8 = 0 THEN ['mask', 'mask'] ELSE ['token'] END AS modes,
    floor(value * 10)::INT AS latency_ms,
    CASE WHEN k >= 98 THEN 'CRITICAL' WHEN k >= 90 THEN 'HIGH' WHEN k >= 80 THEN 'WARNING'
      ELSE 'INFO' END AS severity,
    ts AS timestamp FROM numbered)"""

DOMAINS = ("servicing", "risk", "fraud", "public", "hr")
CALLS = f"""{AUDIT}, calls AS (SELECT *, {one_of(DOMAINS, 'n')} AS domain FROM audit),
known AS (
  SELECT *, CASE WHEN agent_role IN ({listed(DEFAULT_POLICY.names)}) THEN agent_role ELSE 'public'
    END AS effective_role,
    CASE WHEN agent_role IN ({listed(DEFAULT_POLICY.names)}) THEN 'ok' ELSE 'defaulted' END
      AS role_status FROM calls)"""

TOOLS_ALLOWED = "CASE tool_name " + " ".join(
    f"WHEN '{tool}' THEN agent_role IN ({listed(roles)})" for tool, roles in TOOL_ROLES.items()
) + " ELSE TRUE END"
TOOLS_REQUIRED = "CASE tool_name " + " ".join(
    f"WHEN '{tool}' THEN '{','.join(sorted(roles))}'" for tool, roles in TOOL_ROLES.items()
) + " END"
GRANTS = ", ".join(
    f"('{role}', '{tool}')" for role, p in DEFAULT_POLICY.roles.items() for tool in p.tools
)
DOMAIN_GRANTS = ", ".join(
    f"('{role}', '{d}')" for role, p in DEFAULT_POLICY.roles.items() for d in p.domains
)
LIMITS = ", ".join(
    f"('{role}', {p.max_top_k}, {p.rate_limit or 'NULL'})" for role, p in DEFAULT_POLICY.roles.items()
)


def token(key: str) -> str:
    return f"('TOK_' || upper(substr(sha256('sess-001:internal_id:' || {key}), 1, 16)))"


HISTORY = f"""history AS (
  SELECT {token('o_custkey')} AS entity_token,
    CASE o_orderpriority {cases(FEATURE_SETS_BY_PRIORITY, 'cross_sell')} END AS feature_set,
    o_orderdate AS as_of, o_orderkey AS version, o_totalprice / 600000 AS value_1,
    (o_orderkey % 97)::DOUBLE AS value_2, (o_orderkey % 90)::DOUBLE AS value_3,
    (o_orderkey % 5 + 1)::DOUBLE AS value_4 FROM orders)"""

LATEST = f"""{HISTORY}, latest AS (
  SELECT *, row_number() OVER (PARTITION BY entity_token, feature_set
    ORDER BY as_of DESC, version DESC) AS rn FROM history QUALIFY rn = 1)"""

CONTEXT = f"""WITH online AS (
  SELECT {token('c_custkey')} AS entity_token, c_custkey,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN 'CURRENT, contact 415-555-0100'
      WHEN c_acctbal < 0 THEN 'DELINQUENT' ELSE 'CURRENT' END AS st,
    floor(abs(c_acctbal))::BIGINT * 2 AS lim, floor(c_acctbal)::BIGINT AS bal,
    c_custkey % 13 AS good, c_custkey % 3 AS missed, c_custkey % 7 <> 0 AS has_risk,
    CASE WHEN c_acctbal < 1000 THEN 'HIGH' ELSE 'LOW' END AS tier,
    CASE WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' ELSE '680-720' END AS band,
    TIMESTAMP '{AS_OF}' - to_minutes(c_custkey % 90) AS last_updated FROM customer),
asked AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_custkey % 11 = 0 THEN c_custkey::VARCHAR ELSE {token('c_custkey')} END AS entity_token,
    c_custkey % 4 IN (0, 3) AS account, c_custkey % 4 IN (0, 3) AS payment,
    c_custkey % 4 IN (0, 1, 3) AS risk, {one_of(ROLES, 'c_nationkey')} AS agent_role FROM customer),
gated AS (
  SELECT a.*, o.* EXCLUDE (entity_token),
    CASE WHEN agent_role NOT IN ({listed(TOOL_ROLES['get_entity_context'])})
        THEN 'Insufficient permissions'
      WHEN NOT starts_with(a.entity_token, 'TOK_') THEN '{TOKEN_ERROR}' END AS error
  FROM asked a LEFT JOIN online o USING (entity_token)),
told AS (
  SELECT *, CASE WHEN error IS NULL THEN coalesce(nullif(concat_ws(' ',
    CASE WHEN account AND st IS NOT NULL THEN 'Account status is ' || st || '. Credit limit: $'
      || format('{{:,}}', lim) || '. Current balance: $' || format('{{:,}}', bal) || '.' END,
    CASE WHEN payment AND good IS NOT NULL THEN 'Payment history (last 12 months): ' || good
      || ' on-time, ' || missed || ' missed.' END,
    CASE WHEN risk AND has_risk THEN 'Risk tier: ' || tier || '. Score band: ' || band || '.' END),
    ''), '{NO_CONTEXT}') END AS told_text FROM gated),
{shielded('told', 'request_id', 'told_text', RECOMMENDED_RULES)}
SELECT request_id, error,
  CASE WHEN error = 'Insufficient permissions'
    THEN '{','.join(sorted(TOOL_ROLES['get_entity_context']))}' END AS required_roles,
  safe_text AS narrative, CASE WHEN error IS NULL THEN last_updated END AS data_freshness,
  coalesce(safe_text <> told_text, FALSE) AS pii_masked FROM done"""

ENTITY_HISTORY = f"""WITH asked AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_custkey % 13 = 0 THEN lpad(c_custkey::VARCHAR, 11, '9')
      ELSE {token('c_custkey')} END AS entity_token,
    400 + c_custkey % 5 * 400 AS days, c_custkey % 2 = 0 AS some_types,
    {one_of(ROLES, 'c_nationkey')} AS agent_role FROM customer),
gated AS (
  SELECT *, CASE WHEN agent_role NOT IN ({listed(TOOL_ROLES['search_entity_history'])})
      THEN 'Insufficient permissions'
    WHEN regexp_full_match(entity_token, '\\d+') AND length(entity_token) > 8 THEN '{RAW_ID_ERROR}'
    END AS error FROM asked),
hits AS (
  SELECT request_id, agent_role, 'rec_' || o_orderkey AS record_id, o_orderstatus AS record_type,
    'Order ' || o_orderpriority || ' account ENT-' || lpad(o_custkey::VARCHAR, 10, '0')
    || ' call 415-555-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS summary,
    request_id || '|' || o_orderkey AS hit_id
  FROM gated JOIN orders ON {token('o_custkey')} = entity_token
  WHERE error IS NULL AND o_orderdate >= TIMESTAMP '1999-01-01' - to_days(days::INT)
    AND (NOT some_types OR o_orderstatus IN ('O', 'P'))),
{shielded('hits', 'hit_id', 'summary', RECOMMENDED_RULES)}
SELECT request_id, record_id, record_type, safe_text AS summary, NULL AS error,
  NULL AS required_roles FROM done
UNION ALL
SELECT request_id, NULL, NULL, NULL, error, CASE WHEN error = 'Insufficient permissions'
  THEN '{','.join(sorted(TOOL_ROLES['search_entity_history']))}' END FROM gated WHERE error IS NOT NULL"""

FEATURE_ROWS = ", ".join(
    f"('{s}', '{name}', {i + 1})" for s, names in FEATURE_SETS.items() for i, name in enumerate(names)
)
SET_LIST = ", ".join(f"''{s}''" for s in sorted(FEATURE_SETS))

EDGES = """edges AS (
  SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)"""

METRICS = f"""{AUDIT},
metrics AS (
  SELECT date_trunc('day', timestamp) AS period, count(*) AS calls,
    avg((tool_name = 'search_entity_history')::INT) AS error_rate,
    avg(pii_detected::INT) AS pii_rate, avg((event_type = 'PROMPT_BLOCKED')::INT) AS blocked_rate,
    count(*) FILTER (event_type = 'PII_LEAKAGE') AS leaks,
    quantile_disc(latency_ms, 0.5) AS p50_ms, quantile_disc(latency_ms, 0.95) AS p95_ms,
    quantile_disc(latency_ms, 0.99) AS p99_ms
  FROM audit GROUP BY 1)"""

IN_WINDOW = f"timestamp >= TIMESTAMP '{WINDOW['start']}' AND timestamp <= TIMESTAMP '{WINDOW['end']}'"
RULE_ROWS = ", ".join(f"('{r.entity_type}', '{r.mode}')" for r in RECOMMENDED_RULES.rules)

TAGGED = listed(CONTRACT.pii_tags["text"])
CHECKS = f"""{REGISTRY},
{shielded('registry', 'document_id', 'text', RECOMMENDED_RULES, None)},
m AS (
  SELECT count(*) AS n, max(updated_at) AS latest,
    sum((text IS NULL)::INT + (domain IS NULL)::INT + (source_uri IS NULL)::INT) AS nulls,
    count(*) FILTER (len(list_filter(types, lambda t: t NOT IN ({TAGGED}))) > 0) AS open
  FROM done),
silent AS (
  SELECT count(*) AS s FROM (SELECT DISTINCT user_id FROM events)
  WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)),
checks AS (
  SELECT 'schema_consistency' AS check_name, 'PASS' AS status,
    'missing [], extra [], retyped []' AS evidence
  UNION ALL SELECT 'null_rate', CASE WHEN round(nulls / (n * 8), 6) <= 0.005 THEN 'PASS' ELSE 'FAIL'
    END, 'null_rate=' || format('{{:.6f}}', round(nulls / (n * 8), 6)) FROM m
  UNION ALL SELECT 'freshness', CASE WHEN latest >= TIMESTAMP '{AS_OF}' - to_hours(48) THEN 'PASS'
    ELSE 'FAIL' END, 'Last updated: ' || strftime(latest, '%Y-%m-%d %H:%M:%S') FROM m
  UNION ALL SELECT 'volume', CASE WHEN abs(n - 1000) <= 100 THEN 'PASS' ELSE 'FAIL' END,
    'Row count ' || format('{{:,}}', n) FROM m
  UNION ALL SELECT 'pii_classification', CASE WHEN open = 0 THEN 'PASS' ELSE 'FAIL' END,
    '6 text fields, ' || (open > 0)::INT || ' unclassified' FROM m
  UNION ALL SELECT 'consumer_acknowledgement', CASE WHEN s = 0 THEN 'PASS' ELSE 'WARN' END,
    s || ' consumers have not acknowledged' FROM silent)"""


def flat(name: str, per: str) -> str:
    """Sorted distinct values of a list column per session."""
    return (
        f"{name}_flat AS (SELECT session_id, string_agg(DISTINCT v, ',' ORDER BY v) AS {name} "
        f"FROM (SELECT session_id, unnest({per}) AS v FROM audit) GROUP BY session_id)"
    )


ORACLES = {
    "role_access": f"""WITH {CALLS}, gated AS (SELECT *, {TOOLS_ALLOWED} AS allowed FROM calls)
SELECT event_id, tool_name, agent_role, allowed,
  CASE WHEN NOT allowed THEN 'Insufficient permissions' END AS error,
  CASE WHEN NOT allowed THEN {TOOLS_REQUIRED} END AS required_roles FROM gated""",
    "policy_access": f"""WITH {CALLS}, grants(role, tool) AS (VALUES {GRANTS})
SELECT event_id, effective_role, role_status, tool_name,
  EXISTS (SELECT 1 FROM grants WHERE role = effective_role AND tool = tool_name) AS allowed FROM known""",
    "unknown_agents": f"""WITH {CALLS}
SELECT agent_role, CASE role_status WHEN 'defaulted' THEN 'blocked' ELSE 'ok' END AS role_status,
  count(*) AS calls FROM known GROUP BY ALL""",
    "domain_access": f"""WITH {CALLS}, grants(role, d) AS (VALUES {DOMAIN_GRANTS})
SELECT event_id, effective_role, domain, EXISTS (SELECT 1 FROM grants
  WHERE role = effective_role AND d IN ('all', domain)) AS domain_allowed FROM known""",
    "unauthorized_events": f"""WITH {CALLS}
SELECT sha256('UNAUTHORIZED_ACCESS' || chr(1) || event_id) AS event_id,
  'UNAUTHORIZED_ACCESS' AS event_type, agent_id, agent_role, tool_name, 'HIGH' AS severity,
  tool_name AS denied_tool FROM calls WHERE NOT {TOOLS_ALLOWED}""",
    "topk_limits": f"""WITH {CALLS}, limits(role, k, rate) AS (VALUES {LIMITS})
SELECT event_id, (latency_ms % 30 + 1)::INT AS requested,
  least(latency_ms % 30 + 1, 20, k)::INT AS allowed_k,
  least(latency_ms % 30 + 1, 20, 3, k)::INT AS effective_k
FROM known JOIN limits ON role = effective_role""",
    "session_required": f"""WITH {AUDIT}
SELECT event_id, severity <> 'WARNING' AS has_session FROM audit""",
    "entity_token": f"""WITH asked AS (
  SELECT c_custkey AS request_id, {one_of(('internal_id', 'crm_id', 'hashed_email', 'raw_ssn'), 'c_custkey')}
    AS id_type, c_custkey, c_nationkey FROM customer)
SELECT request_id, CASE WHEN id_type <> 'raw_ssn' THEN 'TOK_' || upper(substr(sha256(
    'sess-' || c_nationkey || ':' || id_type || ':' || c_custkey), 1, 16)) END AS entity_token,
  CASE WHEN id_type <> 'raw_ssn' THEN '86400s' END AS expires_in,
  CASE WHEN id_type <> 'raw_ssn' THEN 'agent-' || c_nationkey END AS scoped_to,
  CASE WHEN id_type = 'raw_ssn' THEN
    'Invalid id_type. Must be one of: [''crm_id'', ''hashed_email'', ''internal_id'']' END AS error
FROM asked""",
    "entity_context": CONTEXT,
    "entity_history": ENTITY_HISTORY,
    "latest_features": f"""WITH {LATEST}
SELECT entity_token, feature_set, as_of, version, value_2 FROM latest""",
    "stale_features": f"""WITH {HISTORY}, latest AS (
  SELECT *, row_number() OVER (PARTITION BY entity_token, feature_set
    ORDER BY as_of DESC, version DESC) AS rn FROM history
  WHERE as_of <= TIMESTAMP '1998-12-31 08:00:00' QUALIFY rn = 1)
SELECT entity_token, feature_set, version FROM latest
WHERE as_of + INTERVAL 24 HOUR > TIMESTAMP '1998-12-31 08:00:00'
  AND as_of >= TIMESTAMP '1998-12-31 08:00:00' - INTERVAL 600 MINUTE""",
    "data_freshness": f"""WITH {HISTORY}
SELECT entity_token, max(as_of) AS data_freshness FROM history GROUP BY entity_token""",
    "ml_features": f"""WITH {LATEST}, names(feature_set, feature, i) AS (VALUES {FEATURE_ROWS}),
asked AS (
  SELECT c_custkey AS request_id, {token('c_custkey')} AS entity_token,
    {one_of((*FEATURE_SETS, 'unknown_set'), 'c_custkey')} AS feature_set FROM customer)
SELECT request_id, feature,
  round(coalesce(CASE i WHEN 1 THEN value_1 WHEN 2 THEN value_2 WHEN 3 THEN value_3
    WHEN 4 THEN value_4 END, -1), 6) AS value,
  CASE WHEN feature IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS as_of,
  CASE WHEN feature IS NOT NULL THEN 'v2024_q4' END AS feature_version,
  CASE WHEN feature IS NULL THEN 'Unknown feature set. Available: [{SET_LIST}]' END AS error,
  substr(a.entity_token, 1, 8) || '***' AS log_token
FROM asked a LEFT JOIN names n ON n.feature_set = a.feature_set
  LEFT JOIN latest l ON l.entity_token = a.entity_token AND l.feature_set = a.feature_set""",
    "pit_features": f"""WITH {HISTORY}, asked AS (
  SELECT row_number() OVER () AS rid, {token('o_custkey')} AS entity_token,
    {one_of(tuple(FEATURE_SETS), 'l_linenumber')} AS feature_set, l_shipdate AS event_ts,
    l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
hits AS (
  SELECT a.*, h.as_of, h.version, h.value_2, row_number() OVER (PARTITION BY rid
    ORDER BY h.as_of DESC NULLS LAST, h.version DESC NULLS LAST) AS rn
  FROM asked a LEFT JOIN history h ON h.entity_token = a.entity_token
    AND h.feature_set = a.feature_set AND h.as_of <= a.event_ts)
SELECT l_orderkey, l_linenumber, l_partkey, feature_set, event_ts, as_of,
  coalesce(version, -1) AS version, coalesce(value_2, -1) AS value_2 FROM hits WHERE rn = 1""",
    "audit_query": f"""WITH {AUDIT}
SELECT event_id, event_type, tool_name, agent_id, severity, timestamp, latency_ms FROM audit
WHERE pii_detected AND severity = 'HIGH' AND {IN_WINDOW}
ORDER BY timestamp DESC, event_id LIMIT 1000""",
    "audit_validation": f"""WITH {AUDIT}, changed AS (
  SELECT CASE WHEN latency_ms % 50 = 0 THEN 'MADE_UP' ELSE event_type END AS event_type,
    CASE WHEN latency_ms % 70 = 1 THEN 'LOUD' ELSE severity END AS severity FROM audit)
SELECT CASE WHEN event_type NOT IN ({listed(EVENT_TYPES)}) THEN 'Invalid event_type'
    WHEN severity NOT IN ({listed(SEVERITIES)}) THEN 'Invalid severity' ELSE 'valid' END AS reason,
  event_type, severity, count(*) AS events FROM changed GROUP BY ALL""",
    "audit_log_union": f"""WITH {AUDIT}, log AS (
  SELECT 'MCP_TOOL_CALL' AS event_type, 'INFO' AS severity, session_id,
    sha256('MCP_TOOL_CALL' || chr(1) || event_id) AS id, 1 AS hashed, 0 AS approved, 0 AS denied
  FROM audit
  UNION ALL SELECT 'DATA_POLICY_CHECK', 'INFO', '', sha256('DATA_POLICY_CHECK' || chr(1) || event_id),
    0, (latency_ms < 1000)::INT, 0 FROM audit
  UNION ALL SELECT 'UNAUTHORIZED_ACCESS', 'HIGH', '',
    sha256('UNAUTHORIZED_ACCESS' || chr(1) || event_id), 0, 0, 1 FROM audit WHERE NOT {TOOLS_ALLOWED})
SELECT event_type, severity, session_id, count(*) AS events, sum(hashed)::BIGINT AS hashed,
  sum(approved)::BIGINT AS approved, sum(denied)::BIGINT AS denied, count(DISTINCT id) AS ids
FROM log GROUP BY event_type, severity, session_id""",
    "audit_no_text": f"""WITH {AUDIT}, flat_text AS (
  SELECT event_id, concat_ws(' ', event_type, tool_name, agent_id, agent_role, session_id,
    array_to_string(chunk_ids, ' '), array_to_string(types, ' '), severity) AS t FROM audit),
{spans('flat_text', 'event_id', 't', FALLBACK_RULES)}
SELECT k AS event_id, string_agg(entity_type, ',' ORDER BY s DESC) AS entity_types
FROM found GROUP BY k""",
    "session_reconstruct": f"""WITH {AUDIT}
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, event_id)
  AS call_number, event_id, tool_name, timestamp, latency_ms,
  array_to_string(chunk_ids, ',') AS chunk_ids FROM audit""",
    "session_summary": f"""WITH {AUDIT}, {flat('entity_types_seen', 'types')},
{flat('modes_applied', 'modes')},
totals AS (
  SELECT session_id, count(*) AS calls, count(*) FILTER (pii_detected) AS total_pii_events,
    bool_or(list_contains(modes, 'block')) AS any_blocked,
    bool_or(severity = 'CRITICAL') AS any_critical_escalation,
    sum(latency_ms)::BIGINT AS total_latency_ms FROM audit GROUP BY session_id)
SELECT t.*, coalesce(entity_types_seen, '') AS entity_types_seen,
  coalesce(modes_applied, '') AS modes_applied
FROM totals t LEFT JOIN entity_types_seen_flat USING (session_id)
  LEFT JOIN modes_applied_flat USING (session_id)""",
    "session_chunks": f"""WITH {AUDIT}
SELECT session_id, chunk_id, count(*) AS reads
FROM (SELECT session_id, unnest(chunk_ids) AS chunk_id FROM audit) GROUP BY ALL""",
    "session_provenance": f"""WITH {AUDIT}, {CHUNKS}, reads AS (
  SELECT session_id, chunk_id, count(*) AS reads
  FROM (SELECT session_id, unnest(chunk_ids) AS chunk_id FROM audit) GROUP BY ALL)
SELECT session_id, document_id, count(*) AS chunks, sum(reads)::BIGINT AS reads
FROM reads JOIN chunks USING (chunk_id) GROUP BY session_id, document_id""",
    "session_access": f"""WITH {AUDIT}, asked AS (
  SELECT event_id, session_id, CASE WHEN latency_ms % 3 = 0 THEN agent_id
      WHEN latency_ms % 3 = 1 THEN '' ELSE 'x' || agent_id END AS caller,
    {one_of((CALLER, 'analyst', 'platform-admin', 'public'), 'latency_ms')} AS role FROM audit),
gated AS (
  SELECT *, role IN ({listed(GOVERNANCE_ROLES)})
    OR (caller <> '' AND starts_with(session_id, substr(caller, 1, 8))) AS allowed FROM asked)
SELECT event_id, allowed, CASE WHEN NOT allowed THEN
  'You may only query your own sessions unless you hold a governance role.' END AS error FROM gated""",
    "pii_report": f"""WITH {AUDIT}, t AS (
  SELECT count(*) AS total_tool_calls, count(*) FILTER (pii_detected) AS calls_with_pii_detected,
    count(*) FILTER (severity = 'CRITICAL') AS critical_escalations,
    count(*) FILTER (severity = 'HIGH') AS high_severity_events FROM audit WHERE {IN_WINDOW})
SELECT *, round(calls_with_pii_detected * 100.0 / total_tool_calls, 1)::DOUBLE AS pii_detection_rate,
  CASE WHEN critical_escalations = 0 THEN 'No' ELSE critical_escalations::VARCHAR END
    || ' CRITICAL leakage events in reporting window.' AS compliance_statement FROM t""",
    "pii_by_type": f"""WITH {AUDIT}, rules(entity_type, mode) AS (VALUES {RULE_ROWS}),
pairs AS (
  SELECT severity, types[i] AS entity_type, modes[i] AS mode
  FROM (SELECT *, unnest(range(1, len(types) + 1)) AS i FROM audit WHERE {IN_WINDOW})),
seen AS (
  SELECT entity_type, mode, count(*) AS "count", count(*) FILTER (severity = 'CRITICAL') AS critical
  FROM pairs GROUP BY entity_type, mode)
SELECT * FROM seen
UNION ALL SELECT entity_type, mode, 0, 0 FROM rules
WHERE entity_type NOT IN (SELECT entity_type FROM seen)""",
    "contract_checks": f"WITH {CHECKS} SELECT * FROM checks",
    "contract_gate": f"""WITH {CHECKS}, s AS (
  SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warned,
    count(*) FILTER (status = 'FAIL') AS failed, count(*) AS total FROM checks)
SELECT 'documents' AS dataset_name, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS gate, s.*,
  CASE WHEN failed = 0 THEN '''documents'' meets contract — safe for RAG onboarding.'
    ELSE '''documents'' FAILED contract validation. Resolve failures before onboarding.' END
    AS recommendation FROM s""",
    "rate_limit": f"""WITH {CALLS}, limits(role, k, rate) AS (VALUES {LIMITS}), counted AS (
  SELECT date_trunc('minute', timestamp) AS window_start, agent_id, agent_role, effective_role,
    count(*) AS calls FROM known GROUP BY ALL)
SELECT window_start, agent_id, agent_role, calls, coalesce(rate, -1)::INT AS rate_limit,
  coalesce(calls > rate, FALSE) AS over_limit FROM counted JOIN limits ON role = effective_role""",
    "latency_alerts": f"""WITH {METRICS}
SELECT period, calls, leaks, p50_ms, p95_ms, p99_ms, round(error_rate, 6) AS error_rate,
  round(pii_rate, 6) AS pii_rate, round(blocked_rate, 6) AS blocked_rate FROM metrics""",
    "alert_evaluation": f"""WITH {METRICS}, spaced AS (
  SELECT date_trunc('day', timestamp) AS period, floor((epoch_us(timestamp) - epoch_us(lag(timestamp)
    OVER (PARTITION BY tool_name ORDER BY timestamp, event_id))) / 1000000)::DOUBLE AS g FROM audit),
stacked AS (
  SELECT period, 'lineage_gap_seconds' AS metric, max(g) AS v FROM spaced GROUP BY period UNION ALL
  SELECT period, 'critical_leakage', leaks::DOUBLE FROM metrics
  UNION ALL SELECT period, 'blocked_rate', blocked_rate FROM metrics
  UNION ALL SELECT period, 'p95_latency_ms', p95_ms FROM metrics
  UNION ALL SELECT period, 'error_rate', error_rate FROM metrics),
limits(metric, "limit") AS (VALUES {', '.join(f"('{m}', {v}::DOUBLE)" for m, v in ALERT_LIMITS.items())})
SELECT period, metric, round(v, 6) AS value, "limit", coalesce(v > "limit", FALSE) AS breached
FROM stacked JOIN limits USING (metric)""",
    "lineage_gap": f"""WITH {AUDIT}, gaps AS (
  SELECT event_id, tool_name, floor((epoch_us(timestamp) - epoch_us(lag(timestamp)
    OVER (PARTITION BY tool_name ORDER BY timestamp, event_id))) / 1000000)::BIGINT AS g FROM audit)
SELECT event_id, tool_name, coalesce(g, -1) AS gap_seconds, coalesce(g > 1800, FALSE) AS over_limit
FROM gaps""",
    "erasure": f"""WITH {HISTORY}
SELECT feature_set, count(*) AS records, count(DISTINCT entity_token) AS entities FROM history
WHERE entity_token NOT IN (SELECT {token('c_custkey')} FROM customer WHERE c_acctbal < 0)
GROUP BY feature_set""",
    "retention": f"""WITH {REGISTRY}
SELECT document_id, updated_at FROM registry
WHERE updated_at >= TIMESTAMP '{AS_OF}' - to_days(45)""",
    "insert_if_absent": f"""WITH {REGISTRY}
SELECT document_id, domain FROM registry WHERE data_class <> 'STANDARD'""",
    "lineage_depth": f"""WITH {EDGES}, one AS (
  SELECT 'order:' || o_orderkey AS start, 'order:' || o_orderkey AS node, 0 AS hops FROM orders),
two AS (SELECT start, src AS node, 1 AS hops FROM one JOIN edges ON dst = node),
three AS (SELECT start, src AS node, 2 AS hops FROM two JOIN edges ON dst = node),
four AS (SELECT start, src AS node, 3 AS hops FROM three JOIN edges ON dst = node)
SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM three UNION SELECT * FROM four""",
    "lineage_consumers": f"""WITH {EDGES}, one AS (
  SELECT 'nation:' || n_nationkey AS start, 'nation:' || n_nationkey AS node, 0 AS hops FROM nation),
two AS (SELECT start, dst AS node, 1 AS hops FROM one JOIN edges ON src = node),
three AS (SELECT start, dst AS node, 2 AS hops FROM two JOIN edges ON src = node)
SELECT start, hops, count(*) AS nodes FROM (SELECT * FROM one UNION ALL SELECT * FROM two
  UNION ALL SELECT * FROM three) GROUP BY start, hops""",
    "lineage_sessions": f"""WITH {AUDIT}, reads AS (
  SELECT unnest(list_distinct(chunk_ids)) AS artefact_id, session_id, agent_id, tool_name, timestamp
  FROM audit)
SELECT artefact_id, session_id, agent_id, tool_name, max(timestamp) AS retrieved_at,
  count(*) AS reads FROM reads
WHERE artefact_id IN (SELECT doc_id || ':0' FROM documents)
GROUP BY artefact_id, session_id, agent_id, tool_name""",
    "lineage_events": f"""WITH {AUDIT}
SELECT sha256('retrieval' || chr(1) || event_id) AS run_id, 'veilgate' AS job_namespace,
  'mcp.' || tool_name AS job_name,
  'pgvector|rag.document_chunks:' || chunk_ids[1] || ',pgvector|rag.document_chunks:' || chunk_ids[2]
    AS inputs,
  'mcp|agent_context:' || session_id AS outputs, '2' AS chunk_count, timestamp AS event_time
FROM audit""",
    "lineage_layers": f"""WITH {AUDIT}, all_edges AS (
  SELECT 'raw:' || source AS src, 'job:curate_' || lang AS dst, 'input' AS type FROM documents
  UNION ALL SELECT 'veilgate:registry', 'job:curate_' || lang, 'input' FROM documents
  UNION ALL SELECT 'job:curate_' || lang, 'pgvector:rag.document_chunks:' || doc_id || ':0', 'produces'
    FROM documents
  UNION ALL SELECT 'pgvector:rag.document_chunks:' || unnest(chunk_ids), 'job:mcp.' || tool_name, 'input'
    FROM audit
  UNION ALL SELECT 'job:mcp.' || tool_name, 'mcp:agent_context:' || session_id, 'produces' FROM audit
  UNION ALL SELECT 'pgvector:chunk:' || unnest(chunk_ids), 'job:mcp.prompt_assembly', 'input'
    FROM audit WHERE tool_name = 'search_knowledge_base'
  UNION ALL SELECT 'job:mcp.prompt_assembly', 'bedrock:model-a:prompt:' || session_id, 'produces'
    FROM audit WHERE tool_name = 'search_knowledge_base')
SELECT DISTINCT src, dst, type FROM all_edges""",
}

ORACLES["contract_profiled"] = ORACLES["contract_checks"]
ORACLES["contract_sketches"] = """SELECT count(*) AS n, true AS ids_near, count(DISTINCT lang) AS domains FROM documents"""
ORACLES["lineage_facets"] = f"""WITH {AUDIT}
SELECT sha256('prompt' || chr(1) || event_id) AS run_id, pii_detected, latency_ms::BIGINT AS took, latency_ms / 8.0 AS share,
  session_id, 'BOOLEAN' AS kind FROM audit WHERE tool_name = 'search_knowledge_base'"""
ORACLES["erasure_stored"] = ORACLES["erasure"]
ORACLES["online_lookup"] = f"""WITH {LATEST}, asked AS (SELECT c_custkey AS request_id, {token('c_custkey')} AS entity_token FROM customer)
SELECT request_id, feature_set, version FROM asked LEFT JOIN latest USING (entity_token)"""
