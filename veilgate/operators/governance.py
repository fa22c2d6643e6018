"""Audit queries, session reconstruction, exposure reports, data contracts, alerts, retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgate.functions import sqltext
from veilgate.functions.rules import RuleSet
from veilgate.operators.access import (
    GOVERNANCE_ROLES,
    AccessPolicy,
    may_read_session,
    sorted_roles,
    with_effective_role,
    with_limits,
)
from veilgate.operators.keyed import balanced_join, exact_quantiles, lookup_join, numbered
from veilgate.operators.shield import detect
from veilgate.sources.sinks import exists

MAX_AUDIT_ROWS = 1_000


# -- audit queries -------------------------------------------------------------------------------


def audit_filter(
    events: DataFrame,
    agent_id: str = "",
    tool_name: str = "",
    pii_only: bool = False,
    severity: str = "",
    start: str = "",
    end: str = "",
) -> DataFrame:
    """Every argument left empty adds no condition; what is given reaches the scan."""
    if start:
        events = events.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        events = events.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    if agent_id:
        events = events.where(F.col("agent_id") == agent_id)
    if tool_name:
        events = events.where(F.col("tool_name") == tool_name)
    if severity:
        events = events.where(F.col("severity") == severity)
    if pii_only:
        events = events.where("pii_detected")
    return events


def require_governance(caller_role: str) -> None:
    if caller_role not in GOVERNANCE_ROLES:
        raise PermissionError(
            f"Insufficient permissions; required roles: {sorted(GOVERNANCE_ROLES)}"
        )


def audit_trail(events: DataFrame, caller_role: str, limit: int = 100, **conditions) -> DataFrame:
    """Newest matching events first, at most 1000; governance roles only."""
    require_governance(caller_role)
    return (
        audit_filter(events, **conditions)
        .orderBy(F.desc("timestamp"), "event_id")
        .limit(min(limit, MAX_AUDIT_ROWS))
    )


# -- sessions ------------------------------------------------------------------------------------


def session_calls(events: DataFrame) -> DataFrame:
    """All events of all sessions, numbered oldest first within their session."""
    return numbered(
        events,
        ["session_id"],
        ["timestamp", "event_id"],
        F.date_trunc("hour", F.col("timestamp")),
        "call_number",
    )


def session_summary(events: DataFrame) -> DataFrame:
    """PII totals per session; the type and mode sets are bounded by the vocabulary."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return events.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("pii_detected").alias("total_pii_events"),
        flat("pii_entity_types").alias("entity_types_seen"),
        flat("pii_modes_applied").alias("modes_applied"),
        F.coalesce(F.bool_or(F.array_contains("pii_modes_applied", "block")), F.lit(False)).alias(
            "any_blocked"
        ),
        F.bool_or(F.col("severity") == "CRITICAL").alias("any_critical_escalation"),
        F.sum("latency_ms").alias("total_latency_ms"),
    )


def session_chunks(events: DataFrame) -> DataFrame:
    """(session, chunk) pairs with the number of reads: what data a session has seen."""
    return (
        events.select("session_id", F.explode("chunk_ids").alias("chunk_id"))
        .groupBy("session_id", "chunk_id")
        .agg(F.count(F.lit(1)).alias("reads"))
    )


def session_access(requests: DataFrame) -> DataFrame:
    """Add ``allowed`` and ``error`` to requests for a session's reconstruction."""
    allowed = may_read_session(
        F.col("session_id"), F.col("caller_agent_id"), F.col("caller_agent_role")
    )
    return requests.withColumn("allowed", allowed).withColumn(
        "error",
        F.when(
            ~F.col("allowed"),
            "You may only query your own sessions unless you hold a governance role.",
        ),
    )


def session_provenance(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents behind every session: session, document, distinct chunks, reads."""
    read = session_chunks(events)
    return (
        balanced_join(read, chunks.select("chunk_id", "document_id"), ["chunk_id"])
        .groupBy("session_id", "document_id")
        .agg(F.count(F.lit(1)).alias("chunks"), F.sum("reads").alias("reads"))
    )


# -- exposure report -----------------------------------------------------------------------------


def exposure_totals(events: DataFrame) -> DataFrame:
    totals = events.agg(
        F.count(F.lit(1)).alias("total_tool_calls"),
        F.count_if("pii_detected").alias("calls_with_pii_detected"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_escalations"),
        F.count_if(F.col("severity") == "HIGH").alias("high_severity_events"),
    )
    rate = F.when(
        F.col("total_tool_calls") > 0,
        F.round(F.col("calls_with_pii_detected") * 100.0 / F.col("total_tool_calls"), 1),
    ).otherwise(0.0)
    return totals.withColumn("pii_detection_rate", rate).withColumn(
        "compliance_statement",
        F.when(
            F.col("critical_escalations") == 0, "No CRITICAL leakage events in reporting window."
        ).otherwise(
            F.concat(
                F.col("critical_escalations").cast("string"),
                F.lit(" CRITICAL leakage events in reporting window."),
            )
        ),
    )


def exposure_by_type(events: DataFrame, rules: RuleSet, entity_type: str = "") -> DataFrame:
    """Counts per entity type and applied mode; configured types without an event count zero."""
    pairs = events.select(
        "severity", F.explode(F.arrays_zip("pii_entity_types", "pii_modes_applied")).alias("p")
    )
    seen = pairs.groupBy(
        F.col("p.pii_entity_types").alias("entity_type"),
        F.col("p.pii_modes_applied").alias("mode"),
    ).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
    )
    configured = rules.to_frame(events.sparkSession).select("entity_type", "mode")
    unseen = configured.join(seen.select("entity_type").distinct(), "entity_type", "left_anti")
    report = seen.unionByName(
        unseen.select(
            "entity_type",
            "mode",
            F.lit(0).cast("long").alias("count"),
            F.lit(0).cast("long").alias("critical"),
        )
    )
    return report.where(F.col("entity_type") == entity_type) if entity_type else report


def exposure_report(
    events: DataFrame, rules: RuleSet, caller_role: str, entity_type: str = "", **conditions
) -> tuple[DataFrame, DataFrame]:
    """(totals, by entity type) over a time window and optional agent; governance roles only."""
    require_governance(caller_role)
    window = audit_filter(events, **conditions)
    return exposure_totals(window), exposure_by_type(window, rules, entity_type)


# -- data contracts ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Contract:
    """What a dataset promises. ``pii_tags`` maps a text column to the entity types it may hold."""

    columns: Mapping[str, str]
    updated_column: str
    max_age_hours: int
    baseline_rows: int
    max_null_rate: float = 0.005
    volume_tolerance: float = 0.10
    pii_tags: Mapping[str, Sequence[str]] = field(default_factory=dict)


def schema_difference(df: DataFrame, expected: Mapping[str, str]) -> tuple[list, list, list]:
    """(missing, extra, retyped) columns."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    missing = [c for c in expected if c not in actual]
    extra = [c for c in actual if c not in expected]
    retyped = [c for c in expected if c in actual and actual[c] != expected[c]]
    return missing, extra, retyped


def _profiled(df: DataFrame, contract: Contract) -> tuple[list[str], list[str]]:
    """(promised columns that are there, text columns)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return [c for c in contract.columns if c in df.columns], texts


def profile(df: DataFrame, contract: Contract, rules: RuleSet, by: Sequence[Column | str] | None = None, sketches: bool = False) -> DataFrame:
    """What the checks need to know about a dataset, in one pass: counts, nulls, latest time, unexpected entities.

    With ``by`` one mergeable row per value of those columns. ``sketches`` adds mergeable sketches of every column: of
    its distinct values and, for numbers, of its quantiles.
    """
    required, texts = _profiled(df, contract)
    scanned = df
    for i, name in enumerate(texts):
        scanned = detect(scanned, name, rules, out=f"_pii{i}")
    measures = [F.count(F.lit(1)).alias("n")]
    measures += [F.count_if(F.col(c).isNull()).alias(f"null_{i}") for i, c in enumerate(required)]
    if contract.updated_column in df.columns:
        measures.append(F.max(contract.updated_column).cast("timestamp").alias("latest"))
    else:
        measures.append(F.max(F.lit(None).cast("timestamp")).alias("latest"))
    for i, name in enumerate(texts):
        tags = sqltext.texts(contract.pii_tags.get(name, ()))
        known = f"s.entity_type IN ({tags})" if tags else "false"
        measures.append(F.expr(f"count_if(exists(_pii{i}, s -> NOT {known}))").alias(f"pii_{i}"))
    if sketches:
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.StringType, T.IntegerType, T.LongType)):
                measures.append(F.hll_sketch_agg(f.name).alias(f"distinct_{f.name}"))
            if isinstance(f.dataType, (T.IntegralType, T.FractionalType)) and not isinstance(f.dataType, T.DecimalType):
                measures.append(F.kll_sketch_agg_double(F.col(f.name).cast("double")).alias(f"quantiles_{f.name}"))
    return scanned.groupBy(*by).agg(*measures) if by else scanned.agg(*measures)


def merged(profiles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Profiles added up: of everything, or per value of ``by``."""
    measures = []
    for name in profiles.columns:
        if name == "n" or name.startswith(("null_", "pii_")):
            measures.append(F.coalesce(F.sum(name), F.lit(0)).alias(name))
        elif name == "latest":
            measures.append(F.max(name).alias(name))
        elif name.startswith("distinct_"):
            measures.append(F.hll_union_agg(name).alias(name))
        elif name.startswith("quantiles_"):
            measures.append(F.kll_merge_agg_double(name).alias(name))
    return profiles.groupBy(*by).agg(*measures) if by else profiles.agg(*measures)


def update_profiles(df: DataFrame, contract: Contract, rules: RuleSet, path: str, part: Column, sketches: bool = True) -> int:
    """Profile the parts of a dataset (a day, a file) that ``path`` has no profile of yet; how many there were.

    Parts are looked up before the rows are read, so what is known is not scanned again. A part that changes has
    to be removed from the store first.
    """
    spark = df.sparkSession
    mark = F.coalesce(part.cast("string"), F.lit(""))
    new = df.select(mark.alias("part")).distinct()
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("part"), "part", "left_anti")
    parts = sorted(r.part for r in new.collect())
    if parts:
        profile(df.where(mark.isin(*parts)), contract, rules, [mark.alias("part")], sketches).write.mode("append").parquet(path)
    return len(parts)


def contract_checks(
    df: DataFrame,
    contract: Contract,
    rules: RuleSet,
    as_of: str,
    consumers: DataFrame | None = None,
    acknowledged: DataFrame | None = None,
    profiles: DataFrame | None = None,
) -> DataFrame:
    """Six checks as rows (check_name, status, evidence).

    They come from one pass over the whole dataset or, where ``profiles`` of all its parts are given, from those; then
    only the schema of ``df`` is looked at.
    """
    missing, extra, retyped = schema_difference(df, contract.columns)
    required, texts = _profiled(df, contract)
    measured = profile(df, contract, rules) if profiles is None else merged(profiles)

    cells = F.col("n") * max(len(required), 1)
    nulls = sum((F.col(f"null_{i}") for i in range(len(required))), F.lit(0))
    null_rate = F.when(F.col("n") > 0, F.round(nulls / cells, 6)).otherwise(0.0)
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(contract.max_age_hours))
    spread = contract.baseline_rows * contract.volume_tolerance
    near = F.abs(F.col("n") - contract.baseline_rows) <= spread
    open_fields = sum(
        (F.when(F.col(f"pii_{i}") > 0, 1).otherwise(0) for i in range(len(texts))), F.lit(0)
    )
    schema_ok = not (missing or extra or retyped)

    def check(name: str, passed: Column, evidence: Column, otherwise: str = "FAIL") -> Column:
        return F.struct(
            F.lit(name).alias("check_name"),
            F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise(otherwise).alias("status"),
            evidence.alias("evidence"),
        )

    rows = [
        check(
            "schema_consistency",
            F.lit(schema_ok),
            F.lit(f"missing {missing}, extra {extra}, retyped {retyped}"),
        ),
        check(
            "null_rate",
            null_rate <= contract.max_null_rate,
            F.concat(F.lit("null_rate="), F.format_number(null_rate, 6)),
        ),
        check(
            "freshness",
            F.col("latest") >= limit,
            F.concat(
                F.lit("Last updated: "),
                F.coalesce(F.date_format("latest", "yyyy-MM-dd HH:mm:ss"), F.lit("never")),
            ),
        ),
        check("volume", near, F.concat(F.lit("Row count "), F.format_number("n", 0))),
        check(
            "pii_classification",
            open_fields == 0,
            F.concat(F.lit(f"{len(texts)} text fields, "), open_fields, F.lit(" unclassified")),
        ),
    ]
    report = measured.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
    if consumers is None:
        return report
    silent = (
        consumers
        if acknowledged is None
        else consumers.join(acknowledged, list(acknowledged.columns), "left_anti")
    ).agg(F.count(F.lit(1)).alias("silent"))
    acknowledgement = silent.select(
        check(
            "consumer_acknowledgement",
            F.col("silent") == 0,
            F.concat(F.col("silent").cast("string"), F.lit(" consumers have not acknowledged")),
            "WARN",
        ).alias("c")
    ).select("c.*")
    return report.unionByName(acknowledgement)


def contract_gate(checks: DataFrame, dataset: str) -> DataFrame:
    """Summary of the checks: any FAIL fails the gate, a WARN does not."""
    counted = checks.agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )
    good = f"'{dataset}' meets contract — safe for RAG onboarding."
    bad = f"'{dataset}' FAILED contract validation. Resolve failures before onboarding."
    return counted.select(
        F.lit(dataset).alias("dataset_name"),
        F.when(F.col("failed") == 0, "PASS").otherwise("FAIL").alias("gate"),
        "passed",
        "warned",
        "failed",
        "total",
        F.when(F.col("failed") == 0, good).otherwise(bad).alias("recommendation"),
    )


# -- rates and alerts ----------------------------------------------------------------------------


def rate_limits(calls: DataFrame, policy: AccessPolicy, width: str = "1 minute") -> DataFrame:
    """Calls per agent and window against the limit of the agent's role."""
    counted = calls.groupBy(
        F.window("timestamp", width).alias("w"), "agent_id", "agent_role"
    ).agg(F.count(F.lit(1)).alias("calls"))
    limited = with_limits(with_effective_role(counted, policy), policy)
    return limited.select(
        F.col("w.start").alias("window_start"),
        "agent_id",
        "agent_role",
        "calls",
        "rate_limit",
        F.coalesce(F.col("calls") > F.col("rate_limit"), F.lit(False)).alias("over_limit"),
    )


LATENCY_LEVELS = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}

# --- Fixed values: alert limits ----------------------------------------------------------------

ALERT_LIMITS = {
    "critical_leakage": 0.0,
    "blocked_rate": 0.001,
    "p95_latency_ms": 2000.0,
    "error_rate": 0.01,
    "lineage_gap_seconds": 3600.0,
}
LINEAGE_GAP_SECONDS = 3600
# Events of one job that are sorted together when gaps are looked for.
STRETCH_EVENTS = 200_000

# ----------------------------------------------------------------------------------------------


def period_metrics(events: DataFrame, period: str, is_error: Column) -> DataFrame:
    """Latency quantiles (nearest rank, exact), error, PII and block rates per period."""
    timed = events.withColumn("period", F.date_trunc(period, F.col("timestamp")))
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    rates = timed.groupBy("period").agg(
        F.count(F.lit(1)).alias("calls"),
        share(is_error).alias("error_rate"),
        share(F.col("pii_detected")).alias("pii_rate"),
        share(F.col("event_type") == "PROMPT_BLOCKED").alias("blocked_rate"),
        F.count_if(F.col("event_type").isin("PII_LEAKAGE", "PII_LEAKAGE_DETECTED")).alias("leaks"),
    )
    return rates.join(exact_quantiles(timed, ["period"], "latency_ms", LATENCY_LEVELS), "period", "left")


def alerts(metrics: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """One row per period and metric with its value, limit and whether it is breached.

    ``gaps`` (period, gap_seconds), for instance from ``event_gaps``, adds the longest gap of each period.
    """
    rows = {
        "critical_leakage": F.col("leaks").cast("double"),
        "blocked_rate": F.col("blocked_rate"),
        "p95_latency_ms": F.col("p95_ms").cast("double"),
        "error_rate": F.col("error_rate"),
    }
    stacked = F.array(
        *[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in rows.items()]
    )
    measured = metrics.select("period", F.explode(stacked).alias("a")).select("period", "a.metric", "a.value")
    if gaps is not None:
        longest = gaps.groupBy("period").agg(F.max("gap_seconds").cast("double").alias("value"))
        measured = measured.unionByName(longest.withColumn("metric", F.lit("lineage_gap_seconds")))
    limit = F.expr(sqltext.lookup("metric", ALERT_LIMITS, 0.0))
    return measured.withColumn("limit", limit).withColumn(
        "breached", F.coalesce(F.col("value") > F.col("limit"), F.lit(False))
    )


def event_gaps(
    events: DataFrame, job: str, time: str, order: str, limit_seconds: int = LINEAGE_GAP_SECONDS
) -> DataFrame:
    """Seconds since the previous event of the same job, flagged above the limit.

    Events are compared inside (job, stretch of time); the first of a stretch is compared with the last
    event of the closest earlier one. The stretch is a day, or an hour, minute or second where a day of
    one job holds more events than a task should sort, so a busy job is spread however few jobs there are.
    """
    stretch = "second"
    for wider in ("day", "hour", "minute"):
        peak = events.groupBy(job, F.date_trunc(wider, F.col(time))).count().agg(F.max("count")).first()[0]
        if (peak or 0) <= STRETCH_EVENTS:
            stretch = wider
            break
    daily = events.withColumn("_day", F.date_trunc(stretch, F.col(time)))
    inside = Window.partitionBy(job, "_day").orderBy(time, order)
    earlier = Window.partitionBy(job).orderBy("_day")
    ends = daily.groupBy(job, "_day").agg(F.max(time).alias("_last"))
    carried = ends.select(job, "_day", F.lag("_last").over(earlier).alias("_carried"))
    located = (
        daily.withColumn("_previous", F.lag(time).over(inside))
        .join(carried, [job, "_day"])
        .withColumn("_previous", F.coalesce("_previous", "_carried"))
    )
    seconds = F.unix_micros(F.col(time)) - F.unix_micros(F.col("_previous"))
    return located.withColumn("gap_seconds", F.floor(seconds / 1_000_000)).withColumn(
        "over_limit", F.coalesce(F.col("gap_seconds") > limit_seconds, F.lit(False))
    ).drop("_day", "_previous", "_carried")


# -- erasure and retention -----------------------------------------------------------------------


def erase(rows: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Rows that remain after removing the listed entities (not for the append-only audit log)."""
    return lookup_join(rows, entities.select(key).distinct(), [key], "left_anti")


def retain(rows: DataFrame, time: str, as_of: str, days: int) -> DataFrame:
    """Rows younger than the retention period; on date-partitioned data this prunes partitions."""
    cutoff = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return rows.where(F.col(time) >= cutoff)


def refusal(spark: SparkSession) -> DataFrame:
    """The error row of a governance request from another role."""
    return spark.range(1).select(
        F.lit("Insufficient permissions").alias("error"),
        sorted_roles(GOVERNANCE_ROLES).alias("required_roles"),
    )
