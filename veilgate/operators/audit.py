"""Audit events: builders, validation, escalation and the check that no text leaks into them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgate.functions.ids import sha256_hex, stable_id
from veilgate.functions.rules import RuleSet
from veilgate.operators.shield import detect

# --- Fixed values: accepted event types and severities ----------------------------------------

EVENT_TYPES = (
    "MCP_TOOL_CALL",
    "PII_PROCESSED",
    "PII_BLOCKED",
    "PROMPT_INSPECTED",
    "PROMPT_BLOCKED",
    "RESPONSE_INSPECTED",
    "PII_LEAKAGE",
    "DATA_POLICY_CHECK",
    "TOKEN_ISSUED",
    "UNAUTHORIZED_ACCESS",
)
SEVERITIES = ("DEBUG", "INFO", "WARNING", "HIGH", "CRITICAL")

# ----------------------------------------------------------------------------------------------

BASE_FIELDS = (
    ("event_id", "string"),
    ("event_type", "string"),
    ("agent_id", "string"),
    ("agent_role", "string"),
    ("session_id", "string"),
    ("tool_name", "string"),
    ("severity", "string"),
    ("timestamp", "timestamp"),
)


def normalised(events: DataFrame) -> DataFrame:
    """Base fields first, missing ones empty (severity INFO), then the event's own fields."""
    base = []
    for name, kind in BASE_FIELDS:
        fallback = F.lit("INFO" if name == "severity" else "").cast(kind)
        if kind == "timestamp":
            fallback = F.lit(None).cast(kind)
        base.append(
            (F.coalesce(F.col(name), fallback) if name in events.columns else fallback).alias(name)
        )
    own = [c for c in events.columns if c not in dict(BASE_FIELDS)]
    return events.select(*base, *own)


def event_log(*families: DataFrame) -> DataFrame:
    """One log from several event families; fields a family lacks are null."""
    log = normalised(families[0])
    for family in families[1:]:
        log = log.unionByName(normalised(family), allowMissingColumns=True)
    return log


def is_valid(event_type: Column, severity: Column) -> Column:
    return F.coalesce(event_type.isin(*EVENT_TYPES) & severity.isin(*SEVERITIES), F.lit(False))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) events; invalid ones carry a reason and belong in quarantine."""
    ok = is_valid(F.col("event_type"), F.col("severity"))
    reason = F.when(
        F.coalesce(~F.col("event_type").isin(*EVENT_TYPES), F.lit(True)), "Invalid event_type"
    ).otherwise("Invalid severity")
    return events.where(ok), events.where(~ok).withColumn("reason", reason)


def require_valid(events: DataFrame) -> DataFrame:
    """Fail the job on the first invalid event."""
    bad = F.raise_error(F.concat(F.lit("invalid audit event: "), F.col("event_id"))).cast("string")
    return events.withColumn(
        "event_type",
        F.when(is_valid(F.col("event_type"), F.col("severity")), F.col("event_type")).otherwise(bad),
    )


def tool_call_events(calls: DataFrame, key: str, query: str, at: Column) -> DataFrame:
    """Tool invocations; the query is stored as a hash only."""
    return calls.select(
        stable_id(F.lit("MCP_TOOL_CALL"), F.col(key)).alias("event_id"),
        F.lit("MCP_TOOL_CALL").alias("event_type"),
        "tool_name",
        "agent_id",
        "agent_role",
        "session_id",
        F.lit("INFO").alias("severity"),
        sha256_hex(F.col(query)).alias("query_hash"),
        "chunk_ids",
        "pii_detected",
        "latency_ms",
        at.alias("timestamp"),
    )


def pii_events(
    rows: DataFrame, key: str, at: Column, kind: str = "PII_PROCESSED", severity: str = "INFO"
) -> DataFrame:
    if kind not in ("PII_PROCESSED", "PII_BLOCKED", "PII_LEAKAGE"):
        raise ValueError(f"not a PII event type: {kind}")
    return rows.select(
        stable_id(F.lit(kind), F.col(key)).alias("event_id"),
        F.lit(kind).alias("event_type"),
        "agent_id",
        "session_id",
        F.lit(severity).alias("severity"),
        "entity_types",
        "modes_applied",
        "was_modified",
        "context_id",
        at.alias("timestamp"),
    )


def policy_check_events(checks: DataFrame, key: str, at: Column) -> DataFrame:
    return checks.select(
        stable_id(F.lit("DATA_POLICY_CHECK"), F.col(key)).alias("event_id"),
        F.lit("DATA_POLICY_CHECK").alias("event_type"),
        "agent_id",
        "agent_role",
        F.lit("INFO").alias("severity"),
        "dataset_name",
        "use_case",
        "approved",
        at.alias("timestamp"),
    )


def critical(events: DataFrame) -> DataFrame:
    return events.where(F.col("severity") == "CRITICAL")


def escalate(events: DataFrame, callback: Callable[[dict], None]) -> tuple[int, int]:
    """Hand CRITICAL rows to a callback, in the tasks that hold them; its errors are counted, never raised.

    The callback is shipped to the executors, so it has to be picklable and to reach its receiver from
    there; a repeated task hands its rows over again, ``event_id`` tells repeats apart. Returns
    (delivered, failed).
    """
    context = events.sparkSession.sparkContext
    delivered, failed = context.accumulator(0), context.accumulator(0)

    def hand_over(rows) -> None:
        for row in rows:
            try:
                callback(row.asDict(recursive=True))
                delivered.add(1)
            except Exception:  # noqa: BLE001 - a failing receiver must not stop the audit
                failed.add(1)

    critical(events).foreachPartition(hand_over)
    return delivered.value, failed.value


def leaked_entities(events: DataFrame, rules: RuleSet) -> DataFrame:
    """Events whose serialised form holds anything the recognisers find; expected to be empty.

    Identifiers and hashes are hexadecimal or numeric by nature and are left out of the scan.
    """
    skipped = ("event_id", "query_hash", "timestamp", "latency_ms")
    scanned = [c for c in events.columns if c not in skipped]
    text = F.to_json(F.struct(*scanned))
    found = detect(events.withColumn("_json", text), "_json", rules)
    return found.where(F.size("spans") > 0).select(
        "event_id", F.transform("spans", lambda s: s["entity_type"]).alias("entity_types")
    )
