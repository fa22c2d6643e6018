"""Streaming twins: the same answers from streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.functions.rules import RECOMMENDED_RULES
from veilgate.operators import guards
from veilgate.plans import tables as T
from veilgate.session import scratch_path
from veilgate.sources.readers import read_audit, stream_table
from veilgate.sources.schemas import AUDIT
from veilgate.streaming import lifetimes, outbox, streams


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # A pattern, since a stream source takes a plain path for a folder; tables may be single files.
    return stream_table(spark, f"{sf}/{name}.parque[t]", T.table(spark, sf, name).schema)


def audit_stream(spark, sf) -> DataFrame:
    return T.audit_columns(stream_of(spark, sf, "events"))


def stream_mask(spark, sf):
    done = streams.shield_stream(stream_of(spark, sf, "documents"), "text", RECOMMENDED_RULES)
    rows = done.select("doc_id", "status", "safe_text", "was_modified")
    return streams.run_available(rows, scratch_path(spark, "stream-mask"))


def stream_guard(spark, sf):
    done = guards.guard_responses(stream_of(spark, sf, "pages"), "html", blocking=False)
    rows = done.select("page_id", "leakage", "risk", "action")
    return streams.run_available(rows, scratch_path(spark, "stream-guard"))


def stream_rate_limit(spark, sf):
    counted = streams.calls_per_window(audit_stream(spark, sf), "timestamp", ["agent_id"])
    return streams.run_available(counted, scratch_path(spark, "stream-rate"), "complete")


def stream_updates(spark, sf):
    """The same counts from update mode: versions of windows, folded to the last."""
    counted = streams.calls_per_window(audit_stream(spark, sf), "timestamp", ["agent_id"])
    path, keys = scratch_path(spark, "stream-updates"), ["window_start", "agent_id"]
    return streams.run_available(counted, path, "update", keys)


def stream_late(spark, sf):
    """Daily counts in append mode: every tenth event arrives after all others, mostly too late.

    Windows the watermark had closed by then keep their count; windows still open take the late rows; windows
    not closed at the end are not out yet.
    """
    path = scratch_path(spark, "stream-late")
    events = T.audit_columns(T.table(spark, sf, "events"))
    late = F.expr("CAST(substring(event_id, 5) AS BIGINT) % 10 = 0")
    result = None
    for part in (events.where(~late), events.where(late)):
        part.select("timestamp", "severity").write.mode("append").parquet(f"{path}-in")
        arriving = stream_table(spark, f"{path}-in", "timestamp timestamp, severity string")
        counted = streams.calls_per_window(arriving, "timestamp", ["severity"], "1 day", "12 hours")
        result = streams.run_available(counted, path)
    return result


def stream_metrics(spark, sf):
    measured = streams.metrics_per_window(
        audit_stream(spark, sf), "timestamp", F.col("tool_name") == "search_entity_history"
    )
    done = streams.run_available(measured, scratch_path(spark, "stream-metrics"), "complete")
    return done.withColumns(
        {name: F.round(name, 6) for name in ("error_rate", "pii_rate", "blocked_rate")}
    )


def stream_sessions(spark, sf):
    grouped = streams.sessions_by_gap(audit_stream(spark, sf), "timestamp", "agent_id")
    return streams.run_available(grouped, scratch_path(spark, "stream-sessions"), "complete")


def stream_metrics_closed(spark, sf):
    """The metrics of closed days in append mode: the state holds open days only."""
    measured = streams.metrics_per_window(
        audit_stream(spark, sf), "timestamp", F.col("tool_name") == "search_entity_history"
    )
    done = streams.run_available(measured, scratch_path(spark, "stream-metrics-closed"))
    return done.withColumns({name: F.round(name, 6) for name in ("error_rate", "pii_rate", "blocked_rate")})


def stream_sessions_closed(spark, sf):
    """Sessions in append mode: each is out once, when its silence has lasted long enough."""
    grouped = streams.sessions_by_gap(audit_stream(spark, sf), "timestamp", "agent_id")
    return streams.run_available(grouped, scratch_path(spark, "stream-sessions-closed"))


def stream_dedup(spark, sf):
    """Every event arrives twice and is kept once."""
    twice = audit_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = streams.without_duplicates(twice, "timestamp").select("event_id", "timestamp")
    return streams.run_available(kept, scratch_path(spark, "stream-dedup"))


def stream_latest(spark, sf):
    """Feature changes as a stream, folded to the newest value per key."""
    changes = stream_of(spark, sf, "orders")
    sets = " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in T.FEATURE_SETS_BY_PRIORITY.items())
    rows = changes.selectExpr(
        f"{T.token_of('o_custkey')} AS entity_token",
        f"CASE o_orderpriority {sets} ELSE 'cross_sell' END AS feature_set",
        "CAST(o_orderdate AS TIMESTAMP) AS as_of",
        "o_orderkey AS version",
    )
    path = scratch_path(spark, "stream-latest")
    query = streams.upsert_features(rows, path, f"{path}-state", "version")
    streams.finished(query)
    return streams.read_upserted(spark, path, "version").select(
        "entity_token", "feature_set", "as_of", "version", "expires_at"
    )


def stream_audit(spark, sf):
    """Audit events appended by day, then counted from the log."""
    path = scratch_path(spark, "stream-audit")
    columns = [c.strip().split(" ")[0] for c in AUDIT.replace("\n", " ").split(",")]
    rows = audit_stream(spark, sf).select(*[c for c in columns if c != "event_date"])
    query = streams.audit_stream(rows, path, f"{path}-state")
    streams.finished(query)
    return (
        read_audit(spark, path, "2024-01-05", "2024-01-20")
        .groupBy(F.col("event_date").cast("string").alias("event_date"), "severity")
        .agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"))
    )


def stream_lifetimes(spark, sf):
    """Feature changes with a lifetime of 24 hours: values that are not renewed expire by a timer, and may come again.

    The first half of the time arrives before the second; the state goes on between the runs.
    """
    path = scratch_path(spark, "stream-lifetimes")
    rows = T.table(spark, sf, "events").selectExpr(
        "concat('TOK_', user_id) AS entity_token", "event_type AS feature_set", "CAST(ts AS TIMESTAMP) AS as_of", "event_id AS version"
    )
    half = F.lit("2024-01-16").cast("timestamp")
    result = None
    for part in (rows.where(F.col("as_of") < half), rows.where(F.col("as_of") >= half)):
        part.write.mode("append").parquet(f"{path}-in")
        arriving = stream_table(spark, f"{path}-in", "entity_token string, feature_set string, as_of timestamp, version long")
        result = streams.run_available(lifetimes.with_lifetimes(arriving), path)
    return result


def unreliable(event: dict) -> None:
    """A receiver that does not take every tenth event."""
    if int(event["event_id"][4:]) % 10 == 7:
        raise ConnectionError("not taken")


def escalation_outbox(spark, sf):
    """Critical events of the audit stream, handed over once although their batch runs twice."""
    path = scratch_path(spark, "escalation")
    columns = [c.strip().split(" ")[0] for c in AUDIT.replace("\n", " ").split(",")]
    rows = audit_stream(spark, sf).select(*[c for c in columns if c != "event_date"])
    streams.finished(streams.audit_stream(rows, path, f"{path}-state", unreliable, slice_rows=1000))
    outbox.deliver(read_audit(spark, path), f"{path}-outbox", 0, unreliable, slice_rows=1000)
    return outbox.status(spark, f"{path}-outbox").select("event_id", "status", "attempts")


QUERIES = {
    f.__name__: f
    for f in (
        stream_mask,
        stream_guard,
        stream_rate_limit,
        stream_updates,
        stream_late,
        stream_metrics,
        stream_sessions,
        stream_metrics_closed,
        stream_sessions_closed,
        stream_dedup,
        stream_latest,
        stream_audit,
        stream_lifetimes,
        escalation_outbox,
    )
}
