"""SQL equivalents of the streaming queries: the batch answers."""

from __future__ import annotations

from veilgate.functions.patterns import NEVER_IN_RESPONSE, SUSPICIOUS_IN_RESPONSE
from veilgate.functions.rules import RECOMMENDED_RULES
from veilgate.plans.service_oracles import AUDIT, LATEST
from veilgate.plans.text_oracles import SAFE_FLAG, labels, shielded

ORACLES = {
    "stream_mask": f"""WITH {shielded('documents', 'doc_id', 'text', RECOMMENDED_RULES, None)}
SELECT doc_id, status, safe_text, {SAFE_FLAG} FROM done""",
    "stream_guard": f"""WITH r AS (
  SELECT page_id, {labels('html', NEVER_IN_RESPONSE)} AS never,
    {labels('html', SUSPICIOUS_IN_RESPONSE)} AS odd FROM pages)
SELECT page_id, len(never) > 0 AS leakage,
  CASE WHEN len(never) > 0 THEN 1.0 WHEN len(odd) > 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS risk,
  CASE WHEN len(never) > 0 THEN 'sanitized' WHEN len(odd) > 0 THEN 'logged' ELSE 'passed' END
    AS action FROM r""",
    "stream_rate_limit": f"""WITH {AUDIT}
SELECT date_trunc('minute', timestamp) AS window_start, agent_id, count(*) AS calls
FROM audit GROUP BY ALL""",
    "stream_updates": f"""WITH {AUDIT}
SELECT date_trunc('minute', timestamp) AS window_start, agent_id, count(*) AS calls
FROM audit GROUP BY ALL""",
    "stream_late": f"""WITH {AUDIT},
marks AS (
  SELECT max(timestamp) FILTER (n % 10 <> 0) - INTERVAL 12 HOUR AS first_mark,
    max(timestamp) - INTERVAL 12 HOUR AS last_mark FROM audit),
windows AS (
  SELECT date_trunc('day', timestamp) AS window_start, severity, n % 10 = 0 AS late FROM audit)
SELECT window_start, severity, count(*) AS calls FROM windows, marks
WHERE window_start + INTERVAL 1 DAY <= last_mark
  AND NOT (late AND window_start + INTERVAL 1 DAY <= first_mark)
GROUP BY ALL""",
    "stream_metrics": f"""WITH {AUDIT}
SELECT date_trunc('day', timestamp) AS window_start, count(*) AS calls,
  round(avg((tool_name = 'search_entity_history')::INT), 6) AS error_rate,
  round(avg(pii_detected::INT), 6) AS pii_rate,
  round(avg((event_type = 'PROMPT_BLOCKED')::INT), 6) AS blocked_rate FROM audit GROUP BY 1""",
    "stream_sessions": f"""WITH {AUDIT}, flagged AS (
  SELECT *, coalesce(timestamp >= lag(timestamp) OVER w + INTERVAL 6 HOUR, TRUE)::INT AS opens
  FROM audit WINDOW w AS (PARTITION BY agent_id ORDER BY timestamp, event_id)),
numbered_s AS (
  SELECT *, sum(opens) OVER (PARTITION BY agent_id ORDER BY timestamp, event_id) AS g FROM flagged)
SELECT agent_id, min(timestamp) AS started, max(timestamp) + INTERVAL 6 HOUR AS ended,
  count(*) AS calls, count(*) FILTER (pii_detected) AS pii_events
FROM numbered_s GROUP BY agent_id, g""",
    "stream_dedup": f"WITH {AUDIT} SELECT event_id, timestamp FROM audit",
    "stream_latest": f"""WITH {LATEST}
SELECT entity_token, feature_set, as_of, version, as_of + INTERVAL 24 HOUR AS expires_at FROM latest""",
    "stream_audit": f"""WITH {AUDIT}
SELECT timestamp::DATE::VARCHAR AS event_date, severity, count(*) AS events, count(DISTINCT event_id) AS ids
FROM audit WHERE timestamp::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL""",
    "stream_lifetimes": """WITH rows AS (
  SELECT 'TOK_' || user_id AS entity_token, event_type AS feature_set, ts AS as_of, event_id AS version FROM events),
timed AS (
  SELECT *, lag(as_of) OVER w AS before, lead(as_of) OVER w AS after, max(as_of) OVER () - INTERVAL 1 HOUR AS mark
  FROM rows WINDOW w AS (PARTITION BY entity_token, feature_set ORDER BY as_of, version))
SELECT entity_token, feature_set, CASE WHEN before IS NULL OR as_of >= before + INTERVAL 24 HOUR THEN 'inserted' ELSE 'updated' END AS action,
  as_of, version, as_of + INTERVAL 24 HOUR AS expires_at FROM timed
UNION ALL
SELECT entity_token, feature_set, 'expired', as_of, version, as_of + INTERVAL 24 HOUR FROM timed
WHERE coalesce(after, mark) >= as_of + INTERVAL 24 HOUR""",
    "escalation_outbox": f"""WITH {AUDIT}
SELECT event_id, CASE WHEN substr(event_id, 5)::BIGINT % 10 = 7 THEN 'failed' ELSE 'delivered' END AS status, 1::BIGINT AS attempts
FROM audit WHERE severity = 'CRITICAL'""",
}

#: In append mode a window is out once the watermark, an hour behind the latest event, has passed its end.
MARK = "(SELECT max(timestamp) - INTERVAL 1 HOUR AS mark FROM (SELECT ts AS timestamp FROM events))"
ORACLES["stream_metrics_closed"] = f"""SELECT m.* FROM ({ORACLES['stream_metrics']}) m, {MARK}
WHERE window_start + INTERVAL 1 DAY <= mark"""
ORACLES["stream_sessions_closed"] = f"SELECT s.* FROM ({ORACLES['stream_sessions']}) s, {MARK} WHERE ended <= mark"
