"""Queries about access, features, audit, governance and lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.functions.rules import FALLBACK_RULES, RECOMMENDED_RULES
from veilgate.operators import access, audit, corpus, features, governance, lineage, online, search
from veilgate.operators import erasure as stored
from veilgate.operators.access import DEFAULT_POLICY
from veilgate.plans import tables as T
from veilgate.session import scratch_path, settle
from veilgate.sources import sinks

NOW = f"TIMESTAMP '{T.AS_OF}'"
CALLER = "governance-reviewer"
WINDOW = {"start": "2024-01-05 00:00:00", "end": "2024-01-25 00:00:00"}


def at() -> Column:
    return F.expr(NOW)


def joined(column) -> Column:
    return F.array_join(column, ",")


# -- access --------------------------------------------------------------------------------------


def calls(spark: SparkSession, sf: str) -> DataFrame:
    domains = ("servicing", "risk", "fraud", "public", "hr")
    return T.audit(spark, sf).withColumn(
        "domain", F.expr(T.pick(domains, "CAST(substring(event_id, 5) AS BIGINT)"))
    )


def role_access(spark, sf):
    gated = access.gate_tools(calls(spark, sf))
    return gated.select(
        "event_id", "tool_name", "agent_role", "allowed", "error",
        joined("required_roles").alias("required_roles"),
    )


def policy_access(spark, sf):
    known = access.with_effective_role(calls(spark, sf), DEFAULT_POLICY)
    allowed = access.permitted(known, DEFAULT_POLICY).withColumn("allowed", F.lit(True))
    refused = access.denied(known, DEFAULT_POLICY).withColumn("allowed", F.lit(False))
    return allowed.unionByName(refused).select(
        "event_id", "effective_role", "role_status", "tool_name", "allowed"
    )


def unknown_agents(spark, sf):
    known = access.with_effective_role(calls(spark, sf), DEFAULT_POLICY, block_unknown=True)
    return known.groupBy("agent_role", "role_status").agg(F.count(F.lit(1)).alias("calls"))


def domain_access(spark, sf):
    known = access.with_effective_role(calls(spark, sf), DEFAULT_POLICY)
    return access.with_domain_permission(known, DEFAULT_POLICY).select(
        "event_id", "effective_role", "domain", "domain_allowed"
    )


def unauthorized_events(spark, sf):
    refused = access.gate_tools(calls(spark, sf)).where(~F.col("allowed"))
    return access.unauthorized_events(refused, "event_id", F.col("timestamp")).drop("timestamp")


def topk_limits(spark, sf):
    asked = access.with_effective_role(calls(spark, sf), DEFAULT_POLICY).withColumn(
        "requested", (F.col("latency_ms") % 30 + 1).cast("int")
    )
    limited = access.with_limits(asked, DEFAULT_POLICY)
    return limited.select(
        "event_id",
        "requested",
        F.least("requested", F.lit(search.MAX_TOP_K), "max_top_k").alias("allowed_k"),
        search.effective_k(F.col("requested"), F.col("max_top_k")).alias("effective_k"),
    )


def session_required(spark, sf):
    return calls(spark, sf).select(
        "event_id",
        access.has_session(
            F.when(F.col("severity") != "WARNING", F.col("session_id"))
        ).alias("has_session"),
    )


# -- features --------------------------------------------------------------------------------------


def customers(spark, sf):
    return T.table(spark, sf, "customer")


def entity_token(spark, sf):
    kinds = ("internal_id", "crm_id", "hashed_email", "raw_ssn")
    requests = customers(spark, sf).selectExpr(
        "c_custkey AS request_id",
        "concat('sess-', c_nationkey) AS session_id",
        f"{T.pick(kinds, 'c_custkey')} AS id_type",
        "CAST(c_custkey AS STRING) AS id_value",
        "concat('agent-', c_nationkey) AS agent_id",
    )
    return features.issue_tokens(requests).select(
        "request_id", "entity_token", "expires_in", "scoped_to", "error"
    )


def online_sections(spark, sf) -> DataFrame:
    return customers(spark, sf).selectExpr(
        f"{T.token_of('c_custkey')} AS entity_token",
        """named_struct(
          'status', CASE WHEN c_mktsegment = 'FURNITURE' THEN 'CURRENT, contact 415-555-0100'
            WHEN c_acctbal < 0 THEN 'DELINQUENT' ELSE 'CURRENT' END,
          'credit_limit', CAST(floor(abs(c_acctbal)) AS BIGINT) * 2,
          'balance', CAST(floor(c_acctbal) AS BIGINT)) AS account_status""",
        """named_struct('on_time_12m', CAST(c_custkey % 13 AS INT),
          'missed_12m', CAST(c_custkey % 3 AS INT)) AS payment_history""",
        """CASE WHEN c_custkey % 7 <> 0 THEN named_struct(
          'risk_tier', CASE WHEN c_acctbal < 1000 THEN 'HIGH' ELSE 'LOW' END,
          'score_band', CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '680-720' END)
          END AS risk_profile""",
        "CAST(NULL AS STRUCT<preferred_channel: STRING>) AS contact_preferences",
        f"{NOW} - make_dt_interval(0, 0, CAST(c_custkey % 90 AS INT)) AS last_updated",
    )


def entity_context(spark, sf):
    requests = customers(spark, sf).selectExpr(
        "c_custkey AS request_id",
        f"""CASE WHEN c_custkey % 11 = 0 THEN CAST(c_custkey AS STRING)
              ELSE {T.token_of('c_custkey')} END AS entity_token""",
        """CASE c_custkey % 4 WHEN 0 THEN CAST(NULL AS array<string>)
             WHEN 1 THEN array('risk_profile') WHEN 2 THEN array('contact_preferences')
             ELSE array('risk_profile', 'account_status', 'payment_history') END AS sections""",
        f"{T.pick(T.ROLES, 'c_nationkey')} AS agent_role",
    )
    told = features.entity_context(requests, online_sections(spark, sf), RECOMMENDED_RULES)
    return told.select(
        "request_id",
        "error",
        joined("required_roles").alias("required_roles"),
        "narrative",
        "data_freshness",
        "pii_masked",
    )


def entity_history(spark, sf):
    """Orders as the activity records of customers."""
    requests = customers(spark, sf).selectExpr(
        "c_custkey AS request_id",
        f"""CASE WHEN c_custkey % 13 = 0 THEN lpad(CAST(c_custkey AS STRING), 11, '9')
              ELSE {T.token_of('c_custkey')} END AS entity_token""",
        "CAST(400 + c_custkey % 5 * 400 AS INT) AS date_range_days",
        """CASE WHEN c_custkey % 2 = 0 THEN array('O', 'P')
             ELSE CAST(array() AS array<string>) END AS record_types""",
        f"{T.pick(T.ROLES, 'c_nationkey')} AS agent_role",
    )
    records = T.table(spark, sf, "orders").selectExpr(
        f"{T.token_of('o_custkey')} AS entity_token",
        "concat('rec_', o_orderkey) AS record_id",
        "o_orderstatus AS record_type",
        """concat('Order ', o_orderpriority, ' account ENT-',
             lpad(CAST(o_custkey AS STRING), 10, '0'), ' call 415-555-',
             lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) AS summary""",
        "CAST(o_orderdate AS TIMESTAMP) AS date",
    )
    moment = F.expr("TIMESTAMP '1999-01-01 00:00:00'")
    found = features.entity_history(requests, records, RECOMMENDED_RULES, moment)
    return found.select(
        "request_id", "record_id", "record_type", "summary", "error",
        joined("required_roles").alias("required_roles"),
    )


def latest_features(spark, sf):
    return features.latest_features(T.feature_history(spark, sf)).select(
        "entity_token", "feature_set", "as_of", "version", "value_2"
    )


def online_lookup(spark, sf):
    """Current features of all customers by lookups in the bucketed online table."""
    current = features.latest_features(T.feature_history(spark, sf)).select("entity_token", "feature_set", "as_of", "version")
    name, path = f"online_{uuid.uuid4().hex}", scratch_path(spark, "online")
    online.store(current, name, path, 16)
    asked = customers(spark, sf).selectExpr("c_custkey AS request_id", f"{T.token_of('c_custkey')} AS entity_token")
    return online.lookup(asked, spark.table(name)).select("request_id", "feature_set", "version")


def stale_features(spark, sf):
    """Values that were still served at the end of 1998: 24 hours to live, 600 minutes old at most."""
    now = F.expr("TIMESTAMP '1998-12-31 08:00:00'")
    history = T.feature_history(spark, sf).where(F.col("as_of") <= now)
    current = features.latest_features(features.with_expiry(history))
    return features.fresh_features(current, now, 600).select(
        "entity_token", "feature_set", "version"
    )


def data_freshness(spark, sf):
    return features.data_freshness(T.feature_history(spark, sf))


def ml_features(spark, sf):
    sets = (*features.FEATURE_SETS, "unknown_set")
    requests = customers(spark, sf).selectExpr(
        "c_custkey AS request_id",
        f"{T.token_of('c_custkey')} AS entity_token",
        f"{T.pick(sets, 'c_custkey')} AS feature_set",
        "CAST(NULL AS TIMESTAMP) AS event_ts",
    )
    values = features.with_named_features(
        features.latest_features(T.feature_history(spark, sf)),
        ["value_1", "value_2", "value_3", "value_4"],
    )
    served = features.feature_vectors(requests, values, at())
    return served.select(
        "request_id",
        F.explode_outer("features").alias("feature", "value"),
        "as_of",
        "feature_version",
        "error",
        "log_token",
    ).withColumn("value", F.round(F.coalesce("value", F.lit(-1.0)), 6))


def pit_features(spark, sf):
    """Shipments ask for the feature values their customer had on the shipping day."""
    sets = tuple(features.FEATURE_SETS)
    requests = (
        T.table(spark, sf, "lineitem")
        .join(T.table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
        .selectExpr(
            f"{T.token_of('o_custkey')} AS entity_token",
            f"{T.pick(sets, 'l_linenumber')} AS feature_set",
            "CAST(l_shipdate AS TIMESTAMP) AS event_ts",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
        )
    )
    found = features.point_in_time(settle(requests, "asked"), T.feature_history(spark, sf))
    return found.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "feature_set",
        "event_ts",
        "as_of",
        F.coalesce("version", F.lit(-1)).alias("version"),
        F.coalesce("value_2", F.lit(-1.0)).alias("value_2"),
    )


# -- audit -----------------------------------------------------------------------------------------


def audit_query(spark, sf):
    return governance.audit_trail(
        T.audit(spark, sf), CALLER, 5000, pii_only=True, severity="HIGH", **WINDOW
    ).select("event_id", "event_type", "tool_name", "agent_id", "severity", "timestamp", "latency_ms")


def audit_validation(spark, sf):
    kind = F.expr("CASE WHEN latency_ms % 50 = 0 THEN 'MADE_UP' ELSE event_type END")
    level = F.expr("CASE WHEN latency_ms % 70 = 1 THEN 'LOUD' ELSE severity END")
    valid, invalid = audit.split_valid(
        T.audit(spark, sf).withColumns({"event_type": kind, "severity": level})
    )
    return (
        valid.withColumn("reason", F.lit("valid"))
        .unionByName(invalid)
        .groupBy("reason", "event_type", "severity")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def audit_log_union(spark, sf):
    calls_ = T.audit(spark, sf)
    policy = calls_.select(
        "event_id", "agent_id", "agent_role",
        F.col("tool_name").alias("dataset_name"),
        F.lit("search").alias("use_case"),
        (F.col("latency_ms") < 1000).alias("approved"),
        "timestamp",
    )
    refused = access.gate_tools(calls_).where(~F.col("allowed"))
    log = audit.event_log(
        audit.tool_call_events(calls_, "event_id", "query_hash", F.col("timestamp")),
        audit.policy_check_events(policy, "event_id", F.col("timestamp")),
        access.unauthorized_events(refused, "event_id", F.col("timestamp")),
    )
    return log.groupBy("event_type", "severity", "session_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count("query_hash").alias("hashed"),
        F.count_if("approved").alias("approved"),
        F.count("denied_tool").alias("denied"),
        F.countDistinct("event_id").alias("ids"),
    )


def audit_no_text(spark, sf):
    """Audit records never hold protected data: expected to return no row."""
    return audit.leaked_entities(T.audit(spark, sf), FALLBACK_RULES).select(
        "event_id", joined("entity_types").alias("entity_types")
    )


def session_reconstruct(spark, sf):
    return governance.session_calls(T.audit(spark, sf)).select(
        "session_id", "call_number", "event_id", "tool_name", "timestamp", "latency_ms",
        joined("chunk_ids").alias("chunk_ids"),
    )


def session_summary(spark, sf):
    done = governance.session_summary(T.audit(spark, sf))
    return done.withColumns(
        {
            "entity_types_seen": joined("entity_types_seen"),
            "modes_applied": joined("modes_applied"),
        }
    )


def session_chunks(spark, sf):
    return governance.session_chunks(T.audit(spark, sf))


def session_provenance(spark, sf):
    pieces = corpus.chunk_documents(T.documents(spark, sf), "document_id", "text")
    return governance.session_provenance(T.audit(spark, sf), pieces)


def session_access(spark, sf):
    roles = (CALLER, "analyst", "platform-admin", "public")
    requests = T.audit(spark, sf).selectExpr(
        "event_id",
        "session_id",
        "CASE WHEN latency_ms % 3 = 0 THEN agent_id WHEN latency_ms % 3 = 1 THEN '' "
        "ELSE concat('x', agent_id) END AS caller_agent_id",
        f"{T.pick(roles, 'latency_ms')} AS caller_agent_role",
    )
    return governance.session_access(requests).select("event_id", "allowed", "error")


# -- governance --------------------------------------------------------------------------------------


def pii_report(spark, sf):
    return governance.exposure_report(T.audit(spark, sf), RECOMMENDED_RULES, CALLER, **WINDOW)[0]


def pii_by_type(spark, sf):
    return governance.exposure_report(T.audit(spark, sf), RECOMMENDED_RULES, CALLER, **WINDOW)[1]


CONTRACT = governance.Contract(
    columns={
        "document_id": "string",
        "domain": "string",
        "source_uri": "string",
        "data_class": "string",
        "is_active": "boolean",
        "updated_at": "timestamp",
        "embedding_model_id": "string",
        "text": "string",
    },
    updated_column="updated_at",
    max_age_hours=48,
    baseline_rows=1_000,
    pii_tags={"text": ("CREDIT_CARD", "EMAIL_ADDRESS")},
)


def _consumers(spark, sf):
    events = T.table(spark, sf, "events")
    answered = events.where("event_type = 'signup' AND value > 100").select("user_id").distinct()
    return events.select("user_id").distinct(), answered


def contract_checks(spark, sf):
    return governance.contract_checks(
        T.documents(spark, sf), CONTRACT, RECOMMENDED_RULES, T.AS_OF, *_consumers(spark, sf)
    )


def _profiles(spark, sf):
    """Stored profiles of the documents per day of update: the earlier days first, then what has come since."""
    path = scratch_path(spark, "profiles")
    dated = T.documents(spark, sf).withColumn("day", F.to_date("updated_at"))
    for known in (dated.where("day < DATE '2024-05-01'"), dated):
        governance.update_profiles(known.drop("day"), CONTRACT, RECOMMENDED_RULES, path, F.to_date("updated_at"))
    return spark.read.parquet(path)


def contract_profiled(spark, sf):
    """The same checks from stored profiles, without reading the documents again."""
    return governance.contract_checks(
        T.documents(spark, sf), CONTRACT, RECOMMENDED_RULES, T.AS_OF, *_consumers(spark, sf), profiles=_profiles(spark, sf)
    )


def contract_sketches(spark, sf):
    """Distinct documents and texts by the merged sketches of all days, and whether they are near the exact numbers."""
    whole = governance.merged(_profiles(spark, sf)).select(
        "n", F.hll_sketch_estimate("distinct_document_id").alias("ids"), F.hll_sketch_estimate("distinct_domain").alias("domains")
    )
    return whole.select("n", (F.abs(F.col("ids") - F.col("n")) <= 0.06 * F.col("n")).alias("ids_near"), "domains")


def contract_gate(spark, sf):
    return governance.contract_gate(contract_checks(spark, sf), "documents")


def rate_limit(spark, sf):
    return governance.rate_limits(T.audit(spark, sf), DEFAULT_POLICY).select(
        "window_start", "agent_id", "agent_role", "calls",
        F.coalesce("rate_limit", F.lit(-1)).alias("rate_limit"), "over_limit",
    )


def _metrics(spark, sf):
    return governance.period_metrics(
        T.audit(spark, sf), "day", F.col("tool_name") == "search_entity_history"
    )


def latency_alerts(spark, sf):
    return _metrics(spark, sf).withColumns(
        {name: F.round(name, 6) for name in ("error_rate", "pii_rate", "blocked_rate")}
    )


def alert_evaluation(spark, sf):
    gaps = governance.event_gaps(T.audit(spark, sf), "tool_name", "timestamp", "event_id").select(
        F.date_trunc("day", "timestamp").alias("period"), "gap_seconds"
    )
    return governance.alerts(_metrics(spark, sf), gaps).withColumn("value", F.round("value", 6))


def lineage_gap(spark, sf):
    gaps = governance.event_gaps(T.audit(spark, sf), "tool_name", "timestamp", "event_id", 1800)
    return gaps.select(
        "event_id", "tool_name", F.coalesce("gap_seconds", F.lit(-1)).alias("gap_seconds"),
        "over_limit",
    )


def erasure(spark, sf):
    gone = customers(spark, sf).where("c_acctbal < 0").selectExpr(
        f"{T.token_of('c_custkey')} AS entity_token"
    )
    kept = governance.erase(T.feature_history(spark, sf), gone, "entity_token")
    return kept.groupBy("feature_set").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("entity_token").alias("entities")
    )


def erasure_stored(spark, sf):
    """The same on a stored table: a file per feature set and part of the customers, of which only some hold an entity."""
    gone = customers(spark, sf).where("c_acctbal < 0").selectExpr(f"{T.token_of('c_custkey')} AS entity_token")
    history, path = T.feature_history(spark, sf), scratch_path(spark, "erasable")
    for part in ("cross_sell", "<>"):
        chosen = F.col("feature_set") == part if part != "<>" else F.col("feature_set") != "cross_sell"
        stored.append(history.where(chosen).repartition(16, "entity_token"), path)
    stored.erase_stored(spark, path, history.schema, gone, "entity_token")
    return stored.read(spark, path, history.schema).groupBy("feature_set").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("entity_token").alias("entities")
    )


def retention(spark, sf):
    return governance.retain(T.documents(spark, sf), "updated_at", T.AS_OF, 45).select(
        "document_id", "updated_at"
    )


def insert_if_absent(spark, sf):
    known = T.documents(spark, sf).where("data_class = 'STANDARD'").select("document_id")
    offered = T.documents(spark, sf).select("document_id", "domain")
    twice = offered.unionByName(offered)
    return sinks.absent_rows(twice, known, ["document_id"])


# -- lineage -----------------------------------------------------------------------------------------


def edges(spark, sf) -> DataFrame:
    """Region, nation, customer and order as a chain of producers."""
    parts = (
        ("nation", "concat('region:', n_regionkey)", "concat('nation:', n_nationkey)"),
        ("customer", "concat('nation:', c_nationkey)", "concat('customer:', c_custkey)"),
        ("orders", "concat('customer:', o_custkey)", "concat('order:', o_orderkey)"),
    )
    frames = [
        T.table(spark, sf, name).selectExpr(f"{src} AS src", f"{dst} AS dst", "'produces' AS type")
        for name, src, dst in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def lineage_depth(spark, sf):
    starts = T.table(spark, sf, "orders").selectExpr("concat('order:', o_orderkey) AS start")
    return lineage.reachable(edges(spark, sf), starts, 3, "upstream")


def lineage_consumers(spark, sf):
    starts = T.table(spark, sf, "nation").selectExpr("concat('nation:', n_nationkey) AS start")
    reached = lineage.reachable(edges(spark, sf), starts, 2, "downstream")
    return reached.groupBy("start", "hops").agg(F.count(F.lit(1)).alias("nodes"))


def lineage_sessions(spark, sf):
    artefacts = T.documents(spark, sf).selectExpr("concat(document_id, ':0') AS artefact_id")
    return lineage.sessions_reading(T.audit(spark, sf), artefacts)


def _runs(spark, sf):
    return T.table(spark, sf, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS run",
        "concat('curate_', lang) AS job_name",
        "array(concat('raw:', source), 'registry') AS input_datasets",
        "array(concat('pgvector:rag.document_chunks:', doc_id, ':0')) AS output_datasets",
    )


def lineage_events(spark, sf):
    events = lineage.retrieval_events(T.audit(spark, sf), "event_id", F.col("timestamp"))
    return events.select(
        F.col("run.runId").alias("run_id"),
        F.col("job.namespace").alias("job_namespace"),
        F.col("job.name").alias("job_name"),
        F.expr("array_join(transform(inputs, d -> concat(d.namespace, '|', d.name)), ',')").alias(
            "inputs"
        ),
        F.expr("array_join(transform(outputs, d -> concat(d.namespace, '|', d.name)), ',')").alias(
            "outputs"
        ),
        lineage.facet("chunk_count", "string").alias("chunk_count"),
        F.col("eventTime").alias("event_time"),
    )


def lineage_layers(spark, sf):
    log = T.audit(spark, sf)
    prompts = log.where("tool_name = 'search_knowledge_base'").withColumn(
        "prompt_hash", F.col("query_hash")
    )
    when = F.col("timestamp")
    return lineage.three_layers(
        lineage.dataset_events(_runs(spark, sf), "run", at()),
        lineage.retrieval_events(log, "event_id", when),
        lineage.prompt_events(prompts, "event_id", "model-a", when),
    )


def lineage_facets(spark, sf):
    """Typed metadata of prompt events, with what each run brings of its own, read back from the stored event log."""
    log = T.audit(spark, sf).where("tool_name = 'search_knowledge_base'")
    free = F.to_json(F.struct(F.col("latency_ms").alias("took"), (F.col("latency_ms") / 8).alias("share"), F.array("session_id").alias("of")))
    prompts = log.withColumns({"prompt_hash": F.col("query_hash"), "metadata": free})
    path = scratch_path(spark, "lineage-log")
    sinks.append_lineage(lineage.prompt_events(prompts, "event_id", "model-a", F.col("timestamp")), path)
    log = spark.read.text(path).select(F.parse_json("value").alias("e"))
    events = log.select(F.struct(F.variant_get("e", "$.run.runId", "string").alias("runId"), F.expr("variant_get(e, '$.run.facets')").alias("facets")).alias("run"))
    return events.select(
        F.col("run.runId").alias("run_id"),
        lineage.facet("pii_detected", "boolean").alias("pii_detected"),
        lineage.facet("took", "bigint").alias("took"),
        lineage.facet("share", "double").alias("share"),
        lineage.facet("of[0]", "string").alias("session_id"),
        F.schema_of_variant(F.expr("variant_get(run.facets, '$.mcp_metadata.pii_detected')")).alias("kind"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        role_access,
        policy_access,
        unknown_agents,
        domain_access,
        unauthorized_events,
        topk_limits,
        session_required,
        entity_token,
        entity_context,
        entity_history,
        latest_features,
        stale_features,
        online_lookup,
        data_freshness,
        ml_features,
        pit_features,
        audit_query,
        audit_validation,
        audit_log_union,
        audit_no_text,
        session_reconstruct,
        session_summary,
        session_chunks,
        session_provenance,
        session_access,
        pii_report,
        pii_by_type,
        contract_checks,
        contract_gate,
        contract_profiled,
        contract_sketches,
        rate_limit,
        latency_alerts,
        alert_evaluation,
        lineage_gap,
        erasure,
        erasure_stored,
        retention,
        insert_if_absent,
        lineage_depth,
        lineage_consumers,
        lineage_sessions,
        lineage_events,
        lineage_layers,
        lineage_facets,
    )
}
