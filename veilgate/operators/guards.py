"""Inspection of prompts before a model call, of responses after it, and of search queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgate.functions import sqltext
from veilgate.functions.ids import stable_id
from veilgate.functions.patterns import (
    NEVER_IN_RESPONSE,
    QUERY_REDACTION,
    QUICK_SCAN,
    REDACTED,
    SUSPICIOUS_IN_RESPONSE,
    java_regex,
)
from veilgate.functions.rules import RuleSet
from veilgate.operators.shield import entity_types, shield


def matches_any(column: str, patterns: Sequence[str]) -> Column:
    tests = [f"{sqltext.name(column)} RLIKE {sqltext.raw(java_regex(p))}" for p in patterns]
    return F.expr(f"coalesce({' OR '.join(tests)}, false)")


def redact(column: str, patterns: Sequence[str]) -> Column:
    """Replace the patterns one after the other."""
    done = sqltext.name(column)
    for pattern in patterns:
        done = f"regexp_replace({done}, {sqltext.raw(java_regex(pattern))}, '{REDACTED}')"
    return F.expr(done)


def labels_found(column: str, labelled: Sequence[tuple[str, str]]) -> Column:
    tests = [
        f"CASE WHEN {sqltext.name(column)} RLIKE {sqltext.raw(java_regex(p))} "
        f"THEN {sqltext.text(label)} END"
        for label, p in labelled
    ]
    return F.expr(f"array_compact(array({', '.join(tests)}))")


def guard_prompts(
    df: DataFrame, prompt: str, rules: RuleSet, role: str | None = None, strict: bool = True
) -> DataFrame:
    """Add ``action``, ``pii_detected``, ``entities_found``, ``safe_prompt``, ``token_map``,
    ``was_inspected`` and ``was_blocked``.

    Only prompts that pass the quick scan reach the shield. A blocked prompt is reported as
    ``blocked`` in strict mode and redacted by the quick-scan patterns otherwise.
    """
    scanned = df.withColumn("_suspect", matches_any(prompt, QUICK_SCAN)).withColumn(
        "_inspected", F.when(F.col("_suspect"), F.col(prompt))
    )
    checked = shield(scanned, "_inspected", rules, role)
    blocked = F.col("status") == "blocked"
    on_block = F.lit(None).cast("string") if strict else redact(prompt, QUICK_SCAN)
    return (
        checked.withColumn(
            "action",
            F.when(blocked, "blocked" if strict else "sanitized")
            .when(F.col("was_modified"), "sanitized")
            .otherwise("passed"),
        )
        .withColumn("pii_detected", blocked | F.col("was_modified"))
        .withColumn(
            "entities_found",
            F.when(blocked, F.array("blocked_type")).otherwise(entity_types(F.col("detections"))),
        )
        .withColumn(
            "safe_prompt",
            F.when(blocked, on_block)
            .when(F.col("_suspect"), F.col("safe_text"))
            .otherwise(F.col(prompt)),
        )
        .withColumn("was_blocked", blocked)
        .withColumnRenamed("_suspect", "was_inspected")
        .drop("_inspected", "detections", "status", "blocked_type", "safe_text", "was_modified")
    )


def guard_responses(df: DataFrame, response: str, blocking: bool = True) -> DataFrame:
    """Add ``leakage``, ``entities_found``, ``risk``, ``action``, ``safe_response``."""
    text = F.col(response)
    scanned = df.withColumn("_never", labels_found(response, NEVER_IN_RESPONSE)).withColumn(
        "_odd",
        F.when(F.size("_never") == 0, labels_found(response, SUSPICIOUS_IN_RESPONSE)).otherwise(
            F.array().cast("array<string>")
        ),
    )
    leak = F.size("_never") > 0
    odd = F.size("_odd") > 0
    cleaned = (
        F.lit(None).cast("string") if blocking else redact(response, [p for _, p in NEVER_IN_RESPONSE])
    )
    return (
        scanned.withColumn("leakage", leak)
        .withColumn("entities_found", F.when(leak, F.col("_never")).otherwise(F.col("_odd")))
        .withColumn("risk", F.when(leak, 1.0).when(odd, 0.6).otherwise(0.0))
        .withColumn(
            "action",
            F.when(leak, "blocked" if blocking else "sanitized")
            .when(odd, "logged")
            .otherwise("passed"),
        )
        .withColumn("safe_response", F.when(leak, cleaned).otherwise(text))
        .drop("_never", "_odd")
    )


def escalations(
    guarded: DataFrame, key: str, agent: str, session: str, at: Column, prompt: str | None = None
) -> DataFrame:
    """One CRITICAL record per leaking response; ``prompt`` names the column of the prompt's inspection id."""
    return guarded.where("leakage").select(
        stable_id(F.lit("PII_LEAKAGE_DETECTED"), F.col(key)).alias("event_id"),
        F.lit("PII_LEAKAGE_DETECTED").alias("event_type"),
        F.lit("CRITICAL").alias("severity"),
        F.col(key).alias("inspection_id"),
        (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("prompt_inspection_id"),
        F.col(agent).alias("agent_id"),
        F.col(session).alias("session_id"),
        F.col("entities_found").alias("entities_leaked"),
        F.lit(1.0).alias("risk_score"),
        at.alias("timestamp"),
        F.lit("IMMEDIATE_REVIEW").alias("action_required"),
    )


def _guard_event(rows: DataFrame, kind: str, key: str, agent: str, session: str, at: Column, **more):
    return rows.select(
        stable_id(F.lit(kind), F.col(key)).alias("event_id"),
        F.lit(kind).alias("event_type"),
        F.col(key).alias("inspection_id"),
        F.col(agent).alias("agent_id"),
        F.col(session).alias("session_id"),
        F.col("entities_found").alias("entities"),
        at.alias("timestamp"),
        *[value.alias(name) for name, value in more.items()],
    )


def prompt_events(guarded: DataFrame, key: str, agent: str, session: str, at: Column) -> DataFrame:
    """Inspection records for prompts that reached the shield, and block records.

    A prompt that fails the quick scan is returned before anything is logged; a strict block is
    logged as a block only, a lenient block as a block and an inspection.
    """
    blocks = _guard_event(
        guarded.where("was_blocked"),
        "PROMPT_BLOCKED",
        key,
        agent,
        session,
        at,
        severity=F.lit("HIGH"),
    )
    seen = guarded.where((F.col("action") != "blocked") & F.col("was_inspected"))
    inspected = _guard_event(
        seen,
        "PROMPT_INSPECTED",
        key,
        agent,
        session,
        at,
        severity=F.when(F.size("entities_found") > 0, "WARNING").otherwise("INFO"),
        action=F.col("action"),
    )
    return blocks.unionByName(inspected, allowMissingColumns=True)


def response_events(guarded: DataFrame, key: str, agent: str, session: str, at: Column) -> DataFrame:
    """Inspection records; a blocked response has only its escalation record."""
    return _guard_event(
        guarded.where(F.col("action") != "blocked"),
        "RESPONSE_INSPECTED",
        key,
        agent,
        session,
        at,
        severity=F.when(F.size("entities_found") > 0, "WARNING").otherwise("INFO"),
        action=F.col("action"),
        risk_score=F.col("risk"),
    )


def sanitise_queries(df: DataFrame, query: str, rules: RuleSet, role: str | None = None) -> DataFrame:
    """Add ``safe_query``: shielded, or redacted by two patterns when the shield would block."""
    checked = shield(df, query, rules, role)
    return checked.withColumn(
        "safe_query",
        F.when(F.col("status") == "blocked", redact(query, QUERY_REDACTION)).otherwise(
            F.col("safe_text")
        ),
    ).select(*df.columns, "safe_query", (F.col("status") == "blocked").alias("query_redacted"))
