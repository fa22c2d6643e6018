import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veilgate.functions.rules import FALLBACK_RULES, RECOMMENDED_RULES
from veilgate.operators import access, audit, features, governance, lineage
from veilgate.operators.access import DEFAULT_POLICY, load_policy
from veilgate.sources import readers, sinks

NOW = datetime(2024, 6, 1)


def test_entity_tokens(spark):
    rows = [
        ("internal_id", "ENT123456", "sess-001"),
        ("internal_id", "ENT123456", "sess-001"),
        ("internal_id", "ENT123456", "sess-002"),
        ("internal_id", "ENT999", "sess-001"),
        ("raw_ssn", "123", "sess-001"),
    ]
    df = spark.createDataFrame(rows, "id_type string, id_value string, session_id string")
    got = features.issue_tokens(df.withColumn("agent_id", F.lit("agent"))).collect()
    assert got[0].entity_token == got[1].entity_token and got[0].entity_token.startswith("TOK_")
    assert len({r.entity_token for r in got[:4]}) == 3
    assert got[4].entity_token is None and "Invalid id_type" in got[4].error


def online(spark):
    return spark.sql(
        """SELECT 'TOK_1' AS entity_token,
          named_struct('status', 'CURRENT', 'credit_limit', 5000L, 'balance', 1200L) AS account_status,
          named_struct('on_time_12m', 11, 'missed_12m', 1) AS payment_history,
          named_struct('risk_tier', 'MEDIUM', 'score_band', '680-720') AS risk_profile,
          named_struct('preferred_channel', 'SMS') AS contact_preferences,
          TIMESTAMP '2024-06-01' AS last_updated"""
    )


def test_entity_context(spark):
    rows = [
        (1, "TOK_1", None, "analyst"),
        (2, "TOK_1", None, "public"),
        (3, "12345678901", None, "analyst"),
        (4, "TOK_1", ["contact_preferences"], "analyst"),
        (5, "TOK_2", None, "analyst"),
    ]
    df = spark.createDataFrame(
        rows, "id int, entity_token string, sections array<string>, agent_role string"
    )
    got = {r.id: r for r in features.entity_context(df, online(spark), FALLBACK_RULES).collect()}
    assert got[1].narrative == (
        "Account status is CURRENT. Credit limit: $5,000. Current balance: $1,200. "
        "Payment history (last 12 months): 11 on-time, 1 missed. "
        "Risk tier: MEDIUM. Score band: 680-720."
    )
    assert got[2].error == features.PERMISSION_ERROR
    assert got[2].required_roles == sorted(access.ENTITY_DATA_ROLES)
    assert got[3].error == features.TOKEN_ERROR
    assert got[4].narrative == got[5].narrative == features.NO_CONTEXT


def test_feature_vectors_are_numeric_and_echo_the_time(spark):
    names = {s: {n: 1.5 for n in fs} | {"extra": 9.0} for s, fs in features.FEATURE_SETS.items()}
    values = spark.createDataFrame(
        [("TOK_1", s, f) for s, f in names.items()],
        "entity_token string, feature_set string, features map<string,double>",
    )
    asked = spark.createDataFrame(
        [("TOK_1", s, NOW) for s in (*features.FEATURE_SETS, "nope")],
        "entity_token string, feature_set string, event_ts timestamp",
    )
    got = {r.feature_set: r for r in features.feature_vectors(asked, values, F.lit(None).cast("timestamp")).collect()}
    for name, wanted in features.FEATURE_SETS.items():
        assert set(got[name].features) == set(wanted) and got[name].as_of == NOW
    assert "Unknown feature set" in got["nope"].error
    with pytest.raises(TypeError):
        features.require_numeric(values.withColumn("features", F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit("b")))))


def test_policy_file(spark, tmp_path):
    path = tmp_path / "policy.yaml"
    path.write_text(
        "roles:\n  public: {allowed_tools: [a], max_top_k: 3, allowed_domains: [public]}\n"
        "  boss: {allowed_tools: [a, b], max_top_k: 9, allowed_domains: all,"
        " pii_overrides: {EMAIL_ADDRESS: plaintext}, rate_limit_per_minute: 5}\n"
        "global: {absolute_block_entities: [US_SSN], min_retrieval_score: 0.5}\n"
    )
    policy = load_policy(str(path))
    assert policy.roles["boss"].plaintext == ("EMAIL_ADDRESS",) and policy.min_score == 0.5
    calls = spark.createDataFrame([("boss", "b"), ("ghost", "b"), ("ghost", "a")], "agent_role string, tool_name string")
    known = access.with_effective_role(calls, policy)
    assert access.permitted(known, policy).count() == 2 and access.denied(known, policy).count() == 1
    path.write_text("roles: {boss: {allowed_tools: [a], max_top_k: 1}}")
    with pytest.raises(ValueError):
        load_policy(str(path))


def test_governance_role_is_required(spark):
    with pytest.raises(PermissionError):
        governance.audit_trail(spark.range(1), "analyst")
    assert governance.refusal(spark).first().required_roles == sorted(access.GOVERNANCE_ROLES)


def audit_rows(spark):
    rows = [
        (f"e{i}", "MCP_TOOL_CALL", "a", "s", "INFO" if i % 3 else "CRITICAL", datetime(2024, 1, 1 + i % 3))
        for i in range(9)
    ]
    return spark.createDataFrame(
        rows,
        "event_id string, event_type string, agent_id string, session_id string, severity string, timestamp timestamp",
    )


def test_escalation_swallows_callback_errors(spark, tmp_path):
    def callback(event):
        if event["event_id"] == "e3":
            raise RuntimeError("receiver is down")
        (tmp_path / event["event_id"]).write_text(event["severity"])

    assert audit.escalate(audit_rows(spark), callback) == (2, 1)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["e0", "e6"]


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "audit")
    sinks.append_audit(audit_rows(spark), path, batch=1)
    sinks.append_audit(audit_rows(spark).limit(4), path, batch=2)
    sinks.append_audit(audit_rows(spark), path, batch=1)
    assert readers.read_audit(spark, path).count() == 13


def test_invalid_events(spark):
    bad = audit_rows(spark).withColumn("event_type", F.lit("NOPE"))
    assert audit.split_valid(bad)[1].count() == 9
    with pytest.raises(Exception, match="invalid audit event"):
        audit.require_valid(bad).collect()


def test_audit_sink_only_grows_and_prunes(spark, tmp_path):
    path = str(tmp_path / "audit")
    sinks.append_audit(audit_rows(spark), path)
    sinks.append_audit(audit_rows(spark), path)
    assert readers.read_audit(spark, path).count() == 18
    some = readers.read_audit(spark, path, "2024-01-02", "2024-01-02")
    assert some.count() == 6 and "PartitionFilters: [isnotnull(event_date" in some._jdf.queryExecution().toString()


def test_insert_if_absent_and_feature_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    sinks.insert_if_absent(df, path, ["id"])
    sinks.insert_if_absent(df.withColumn("v", F.lit("new")).union(spark.createDataFrame([(3, "c")], df.schema)), path, ["id"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    store = str(tmp_path / "features")
    rows = spark.createDataFrame(
        [("T", "s", {"a": 1.0}, datetime(2024, 1, d), "m") for d in (1, 2)],
        "entity_token string, feature_set string, features map<string,double>, as_of timestamp, source string",
    )
    sinks.write_features(rows, store)
    current = readers.read_online_features(spark, store).first()
    assert current.as_of == datetime(2024, 1, 2) and current.expires_at == datetime(2024, 1, 3)
    asked = spark.createDataFrame([("T", "s", datetime(2024, 1, 1, 12))], "entity_token string, feature_set string, event_ts timestamp")
    assert readers.read_features_at(spark, store, asked).first().as_of == datetime(2024, 1, 1)


def test_shielded_rows_are_split_and_hold_no_original(spark, tmp_path):
    from veilgate.operators.shield import shield, vault

    df = spark.createDataFrame([(1, "123-45-6789"), (2, "ENT-1234567890 ok")], "id int, text string")
    done = shield(df, "text", FALLBACK_RULES)
    safe, held, tokens = (str(tmp_path / n) for n in ("safe", "held", "vault"))
    sinks.write_shielded(done, safe, held, "text")
    sinks.write_vault(vault(done), tokens)
    stored = spark.read.parquet(safe)
    assert "text" not in stored.columns and "1234567890" not in json.dumps([r.asDict() for r in stored.collect()])
    assert spark.read.parquet(held).first().blocked_type == "US_SSN"
    assert spark.read.parquet(tokens).count() == 1


def test_lineage_walk_ends_on_cycles(spark):
    edges = spark.createDataFrame(
        [("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("x", "a", "t")], "src string, dst string, type string"
    )
    starts = spark.createDataFrame([("c",)], "start string")
    got = {(r.node, r.hops) for r in lineage.reachable(edges, starts, 10).collect()}
    assert got == {("c", 0), ("b", 1), ("a", 2), ("x", 3)}
    assert lineage.subgraph(edges, lineage.reachable(edges, starts, 1)).count() == 1


def test_dataset_references(spark):
    df = spark.createDataFrame([("pg:a:b",), ("plain",)], "n string")
    got = [tuple(r.r) for r in df.select(lineage.dataset_reference(F.col("n")).alias("r")).collect()]
    assert got == [("pg", "a:b"), ("veilgate", "plain")]


def test_rates_and_gaps_use_the_role_limit(spark):
    rows = [(f"e{i}", "a1", "visitor", datetime(2024, 1, 1, 0, 0, i)) for i in range(12)]
    df = spark.createDataFrame(rows, "event_id string, agent_id string, agent_role string, timestamp timestamp")
    row = governance.rate_limits(df, DEFAULT_POLICY).first()
    assert (row.calls, row.rate_limit, row.over_limit) == (12, 10, True)


def test_gaps_do_not_depend_on_the_stretch(spark, monkeypatch):
    rows = [(f"e{i}", "hot" if i % 10 else "rare", datetime(2024, 1, 1 + i // 40, i % 24, i % 60)) for i in range(120)]
    events = spark.createDataFrame(rows, "event_id string, job string, at timestamp")
    whole = {tuple(r) for r in governance.event_gaps(events, "job", "at", "event_id").collect()}
    for limit in (30, 3, 0):
        monkeypatch.setattr(governance, "STRETCH_EVENTS", limit)
        assert {tuple(r) for r in governance.event_gaps(events, "job", "at", "event_id").collect()} == whole


def test_expired_tokens_are_refused(spark):
    rows = [(1, "TOK_A", datetime(2024, 1, 2, 1)), (2, "TOK_A", datetime(2024, 1, 1)), (3, "TOK_A", None)]
    asked = spark.createDataFrame(rows, "id int, entity_token string, issued_at timestamp").selectExpr(
        "*", "CAST(NULL AS array<string>) AS sections", "'a' AS agent_id", "'fraud-agent' AS agent_role"
    )
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    got = {r.id: r.error for r in features.entity_context(asked, online(spark), FALLBACK_RULES, now).collect()}
    assert got[1] is None and got[2] == got[3] == features.TOKEN_EXPIRED


def test_only_new_parts_are_profiled(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "profiles")
    contract = governance.Contract({"id": "bigint", "note": "string", "day": "string"}, "at", 24, 4)
    rows = [(1, "a", "d1", datetime(2024, 1, 1)), (2, None, "d1", datetime(2024, 1, 3)), (3, "mail a@b.com", "d2", datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "id long, note string, day string, at timestamp")
    assert governance.update_profiles(df.where("day = 'd1'"), contract, RECOMMENDED_RULES, path, F.col("day")) == 1
    assert governance.update_profiles(df, contract, RECOMMENDED_RULES, path, F.col("day")) == 1
    assert governance.update_profiles(df, contract, RECOMMENDED_RULES, path, F.col("day")) == 0
    stored = spark.read.parquet(path)
    assert {r.part: r.n for r in stored.collect()} == {"d1": 2, "d2": 1}
    plain = governance.contract_checks(df, contract, RECOMMENDED_RULES, "2024-01-04 00:00:00").collect()
    assert governance.contract_checks(df, contract, RECOMMENDED_RULES, "2024-01-04 00:00:00", profiles=stored).collect() == plain
    none = df.limit(0)
    assert governance.contract_checks(none, contract, RECOMMENDED_RULES, "2024-01-04 00:00:00", profiles=stored.limit(0)).collect() == (
        governance.contract_checks(none, contract, RECOMMENDED_RULES, "2024-01-04 00:00:00").collect()
    )
    median = governance.merged(stored).select(F.kll_sketch_get_quantile_double("quantiles_id", F.lit(0.5)).alias("m")).first().m
    assert median == 2.0


def test_free_metadata_keeps_its_types_and_wins(spark, tmp_path):
    rows = [
        ("1", "s", "a", "h", ["c"], True, '{"agent_id": "other", "deep": {"n": 3, "l": [1.5, null]}}'),
        ("2", "s", 'quote " \\ \n', None, [], False, "not json"),
        ("3", "s", "a", "h", ["c"], None, None),
        ("4", "s", "a", "h", ["c"], True, " { } "),
    ]
    fields = "id string, session_id string, agent_id string, prompt_hash string, chunk_ids array<string>, pii_detected boolean, metadata string"
    df = spark.createDataFrame(rows, fields)
    events = lineage.prompt_events(df, "id", "m", F.lit(NOW))
    kinds = {"agent_id": "string", "prompt_hash": "string", "pii_detected": "boolean", "deep.n": "int", "deep.l[0]": "double", "llm_model_id": "string"}
    got = events.select(*[lineage.facet(k, v).alias(k) for k, v in kinds.items()]).collect()
    assert [tuple(r) for r in got] == [
        ("other", "h", True, 3, 1.5, "m"), ('quote " \\ \n', None, False, None, None, "m"), ("a", "h", None, None, None, "m"), ("a", "h", True, None, None, "m"),
    ]
    # structs and VARIANTs are taken as they are
    typed = df.withColumn("metadata", F.struct(F.lit(7).alias("n")))
    assert {r[0] for r in lineage.prompt_events(typed, "id", "m", F.lit(NOW)).select(lineage.facet("n", "int")).collect()} == {7}
    variant = df.withColumn("metadata", F.parse_json(F.lit('{"n": 8}')))
    assert {r[0] for r in lineage.prompt_events(variant, "id", "m", F.lit(NOW)).select(lineage.facet("n", "int")).collect()} == {8}
    assert lineage.edges_of(events).count() > 0


def test_a_walk_of_many_starts_repeats_no_rows(spark, monkeypatch):
    """Frontiers above the broadcast limit: many nodes at once, then many starts that stand on few nodes; with a cycle."""
    up = [(f"c{i % 8}", f"o{i}") for i in range(60)] + [(f"n{i % 3}", f"c{i}") for i in range(8)] + [("n1", "n1"), ("o7", "n2")]
    edges = spark.createDataFrame(up + up[:5], "src string, dst string").coalesce(1)
    want = set()
    for start in {dst for _, dst in up}:
        seen, front = {start: 0}, {start}
        for hop in (1, 2, 3):
            front = {src for src, dst in up if dst in front} - set(seen)
            seen |= dict.fromkeys(front, hop)
        want |= {(start, node, hops) for node, hops in seen.items()}
    repeated = []
    monkeypatch.setattr(lineage, "is_small", lambda df: df.count() <= 20)
    monkeypatch.setattr(lineage, "two_sided_join", lambda *a, **b: repeated.append(a))
    got = [tuple(r) for r in lineage.reachable(edges, edges.select(edges.dst.alias("start")), 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want and not repeated
