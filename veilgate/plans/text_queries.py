"""Queries about detection, protection and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.functions.patterns import ENTITY_TYPES
from veilgate.functions.rules import FALLBACK_RULES, RECOMMENDED_RULES, EntityRule, RuleSet
from veilgate.operators import guards, shield
from veilgate.operators.access import DEFAULT_POLICY
from veilgate.operators.corpus import chunk_documents
from veilgate.plans import tables as T


def at() -> Column:
    return F.lit(T.AS_OF).cast("timestamp")


EVERYTHING_MASKED = RuleSet(tuple(EntityRule(t, "mask", 0.5) for t in ENTITY_TYPES))
EVERYTHING_TOKENS = RuleSet(tuple(EntityRule(t, "token", 0.5) for t in ENTITY_TYPES))
SWEEP = (0.50, 0.60, 0.75, 0.85, 0.90, 0.92, 0.95)


def joined(column: Column | str) -> Column:
    return F.array_join(column, ",")


def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    found = shield.detect(
        T.texts(spark, sf), "text", RECOMMENDED_RULES, gate=False, resolve=False
    )
    return found.select("text_id", F.explode("spans").alias("s")).select(
        "text_id", "s.entity_type", "s.start", "s.end", "s.score", "s.original"
    )


def pii_overlap(spark, sf):
    found = shield.detect(T.texts(spark, sf), "text", EVERYTHING_MASKED)
    return found.select("text_id", F.explode("spans").alias("s")).select(
        "text_id", "s.entity_type", "s.start", "s.end"
    )


def pii_mask(spark, sf):
    return shield.shield(T.texts(spark, sf), "text", EVERYTHING_MASKED).select(
        "text_id", "safe_text", "was_modified"
    )


def pii_token(spark, sf):
    return shield.shield(T.texts(spark, sf), "text", EVERYTHING_TOKENS).select(
        "text_id", "safe_text", F.size("token_map").alias("tokens")
    )


def pii_block_status(spark, sf):
    return shield.shield(T.texts(spark, sf), "text", RECOMMENDED_RULES, "agent_role").select(
        "text_id", "status", "blocked_type", "was_modified"
    )


def pii_role_exempt(spark, sf):
    done = shield.shield(T.texts(spark, sf), "text", RECOMMENDED_RULES, "agent_role")
    return done.select(
        "text_id",
        "agent_role",
        joined(shield.entity_types(F.col("detections"))).alias("entity_types"),
        joined(shield.modes(F.col("detections"))).alias("modes"),
        "safe_text",
    )


def pii_policy_grants(spark, sf):
    rules = DEFAULT_POLICY.rules_for(FALLBACK_RULES)
    return shield.shield(T.texts(spark, sf), "text", rules, "agent_role").select(
        "text_id", "status", "blocked_type", "safe_text"
    )


def pii_violations(spark, sf):
    done = shield.shield(T.texts(spark, sf), "text", RECOMMENDED_RULES, "agent_role")
    return shield.violations(done, "text_id", "agent_role").select(
        "text_id", "agent_id", joined("entity_types").alias("entity_types"), "violation_id"
    )


def pii_vault(spark, sf):
    return shield.vault(shield.shield(T.texts(spark, sf), "text", EVERYTHING_TOKENS))


def pii_detokenize(spark, sf):
    done = shield.shield(T.texts(spark, sf), "text", EVERYTHING_TOKENS)
    restored = shield.detokenize(
        done.select("text_id", "safe_text"), "text_id", "safe_text", shield.vault(done)
    )
    return restored.select("text_id", "restored_text")


def pii_audit(spark, sf):
    done = shield.shield(T.texts(spark, sf), "text", RECOMMENDED_RULES, "agent_role")
    context = F.concat(F.lit("prompt:"), F.col("text_id"))
    events = shield.audit_events(done, "text_id", "agent_role", context, at())
    return events.select(
        "event_id",
        "event_type",
        "agent_id",
        "context_id",
        joined("entity_types").alias("entity_types"),
        joined("modes_applied").alias("modes_applied"),
        "was_modified",
    )


def pii_classify(spark, sf):
    done = shield.shield(T.texts(spark, sf), "text", EVERYTHING_MASKED)
    return done.select("text_id", joined(shield.classify(F.col("detections"))).alias("types"))


def token_xref(spark, sf):
    done = shield.shield(T.texts(spark, sf), "text", EVERYTHING_TOKENS)
    return shield.token_cross_reference(done, "text_id")


def threshold_sweep(spark, sf):
    labelled = T.table(spark, sf, "documents").join(
        T.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left"
    ).withColumn("quality", F.coalesce("quality", F.lit(-1)))
    return shield.threshold_sweep(labelled, "text", "quality", RECOMMENDED_RULES, SWEEP)


def threshold_quality(spark, sf):
    """Notes are built from known parts, so the true entity types of each are known."""
    extra = {
        "BUILDING": "US_SSN",
        "AUTOMOBILE": "CREDIT_CARD",
    }
    segment = F.lit(None).cast("string")
    for name, kind in extra.items():
        segment = F.when(F.col("c_mktsegment") == name, kind).otherwise(segment)
    truth = T.table(spark, sf, "customer").select(
        F.concat(F.lit("note:"), F.col("c_custkey").cast("string")).alias("text_id"),
        F.array_compact(
            F.array(F.lit("ACCOUNT_NUMBER"), F.lit("EMAIL_ADDRESS"), F.lit("PHONE_NUMBER"), segment)
        ).alias("truth"),
    )
    labelled = T.notes(spark, sf).join(truth, "text_id")
    scored = shield.threshold_quality(labelled, "text", "truth", RECOMMENDED_RULES, SWEEP)
    return scored.select(
        "threshold",
        "true_positives",
        "reported",
        "expected",
        F.round("precision", 6).alias("precision"),
        F.round("recall", 6).alias("recall"),
    )


def split_entities(spark, sf):
    pieces = chunk_documents(T.texts(spark, sf).drop("agent_role"), "text_id", "text", 3)
    return shield.split_entities(pieces, "text_id", "chunk_index", "chunk_text", RECOMMENDED_RULES)


def prompt_guard(spark, sf):
    done = guards.guard_prompts(T.prompts(spark, sf), "prompt", RECOMMENDED_RULES, "agent_role")
    return done.select(
        "prompt_id",
        "action",
        "pii_detected",
        joined("entities_found").alias("entities_found"),
        "safe_prompt",
    )


def prompt_redact(spark, sf):
    done = guards.guard_prompts(
        T.prompts(spark, sf), "prompt", RECOMMENDED_RULES, "agent_role", strict=False
    )
    return done.select(
        "prompt_id",
        "action",
        "pii_detected",
        joined("entities_found").alias("entities_found"),
        "safe_prompt",
    )


def response_guard(spark, sf):
    done = guards.guard_responses(T.responses(spark, sf), "response", blocking=False)
    return done.select(
        "response_id",
        "leakage",
        joined("entities_found").alias("entities_found"),
        "risk",
        "action",
        "safe_response",
    )


def response_escalations(spark, sf):
    asked = T.responses(spark, sf).withColumn("prompt_id", F.concat(F.lit("prompt:"), "response_id"))
    done = guards.guard_responses(asked, "response")
    found = guards.escalations(done, "response_id", "agent_id", "session_id", at(), "prompt_id")
    return found.select(
        "event_id",
        "severity",
        "inspection_id",
        "prompt_inspection_id",
        "agent_id",
        "session_id",
        joined("entities_leaked").alias("entities_leaked"),
        "action_required",
    )


def guard_events(spark, sf):
    prompts = guards.guard_prompts(
        T.prompts(spark, sf), "prompt", RECOMMENDED_RULES, "agent_role", strict=False
    )
    responses = guards.guard_responses(T.responses(spark, sf), "response")
    log = guards.prompt_events(prompts, "prompt_id", "agent_id", "session_id", at()).unionByName(
        guards.response_events(responses, "response_id", "agent_id", "session_id", at()),
        allowMissingColumns=True,
    )
    return log.groupBy("event_type", "severity", "action", "agent_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.size("entities")).alias("entities")
    )


def query_sanitize(spark, sf):
    asked = T.texts(spark, sf).withColumnRenamed("text", "query")
    return guards.sanitise_queries(asked, "query", RECOMMENDED_RULES, "agent_role").select(
        "text_id", "safe_query", "query_redacted"
    )


QUERIES = {
    f.__name__: f
    for f in (
        pii_spans,
        pii_overlap,
        pii_mask,
        pii_token,
        pii_block_status,
        pii_role_exempt,
        pii_policy_grants,
        pii_violations,
        pii_vault,
        pii_detokenize,
        pii_audit,
        pii_classify,
        token_xref,
        threshold_sweep,
        threshold_quality,
        split_entities,
        prompt_guard,
        prompt_redact,
        response_guard,
        response_escalations,
        guard_events,
        query_sanitize,
    )
}
