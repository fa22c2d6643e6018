from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import model
from veilgate.functions.patterns import RECOGNISERS, Recogniser
from veilgate.functions.rules import RECOMMENDED_RULES, EntityRule, RuleSet, load_rules
from veilgate.operators import shield
from veilgate.operators.access import DEFAULT_POLICY

RULES = RuleSet(
    (
        EntityRule("US_SSN", "block", 0.70),
        EntityRule("CREDIT_CARD", "block", 0.75),
        EntityRule("EMAIL_ADDRESS", "mask", 0.90, ("collections-agent", "servicing-agent")),
        EntityRule("PHONE_NUMBER", "mask", 0.75, ("collections-agent",)),
        EntityRule("ACCOUNT_NUMBER", "token", 0.85, ("fraud-agent",)),
        EntityRule("PERSON", "mask", 0.80),
        EntityRule("LOCATION", "mask", 0.75),
    )
)


def run(spark, texts, rules=RULES, role="analyst", **more):
    rows = [(i, t, role) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string, role string")
    return shield.shield(df, "text", rules, "role", **more).orderBy("id").collect()


@pytest.mark.parametrize(
    "text, role, status, safe",
    [
        ("SSN: 123-45-6789", "analyst", "blocked", None),
        ("Card 4532-0151-1283-0366 declined.", "analyst", "blocked", None),
        ("SSN 987-65-4321", "fraud-agent", "blocked", None),
        ("Contact user@example.com.", "analyst", "ok", "Contact [EMAIL_ADDRESS]."),
        ("Contact user@example.com.", "collections-agent", "ok", "Contact user@example.com."),
        ("Call 415-555-1234.", "analyst", "ok", "Call [PHONE_NUMBER]."),
        ("Call 415-555-1234.", "collections-agent", "ok", "Call 415-555-1234."),
        (
            "Email alpha@test.com or beta@test.com.",
            "analyst",
            "ok",
            "Email [EMAIL_ADDRESS] or [EMAIL_ADDRESS].",
        ),
        (
            "Account ENT-1234567890 under review.",
            "analyst",
            "ok",
            "Account [ACCOUNT_NUMBER:0B771836] under review.",
        ),
        (
            "Account ENT-1234567890 under review.",
            "fraud-agent",
            "ok",
            "Account ENT-1234567890 under review.",
        ),
        ("account number: 1234567890", "analyst", "ok", "account number: [PHONE_NUMBER]"),
        ("(838) 555-7235", "analyst", "ok", "([PHONE_NUMBER]"),
        ("Dispute resolution takes 10 business days.", "analyst", "ok", None),
        ("Payment amount was $127.50.", "analyst", "ok", None),
        ("Account opened in Q3 2022.", "analyst", "ok", None),
        ("", "analyst", "ok", None),
        ("   \n\t  ", "analyst", "ok", None),
    ],
)
def test_published_cases(spark, text, role, status, safe):
    row = run(spark, [text], role=role)[0]
    expected = safe if safe is not None or status == "blocked" else text
    assert (row.status, row.safe_text) == (status, expected)
    assert row.was_modified == (expected is not None and expected != text)


def test_exempt_detection_is_recorded_as_mask(spark):
    row = run(spark, ["ENT-1234567890"], role="fraud-agent")[0]
    assert [(d.mode, d.replacement) for d in row.detections] == [("mask", "ENT-1234567890")]
    assert row.token_map == {}


def test_detections_are_listed_right_to_left_and_block_names_the_last(spark):
    row = run(spark, ["a@b.com then 123-45-6789 then 4532-0151-1283-0366 x"])[0]
    starts = [d.start for d in row.detections]
    assert starts == sorted(starts, reverse=True)
    assert row.blocked_type == "CREDIT_CARD"


def test_thresholds_gate_before_overlaps(spark):
    low = RuleSet((EntityRule("EMAIL_ADDRESS", "mask", 0.50),))
    high = RuleSet((EntityRule("EMAIL_ADDRESS", "mask", 0.99),))
    assert run(spark, ["user@example.com"], low)[0].was_modified
    assert not run(spark, ["user@example.com"], high)[0].was_modified
    bank = RuleSet((EntityRule("US_BANK_NUMBER", "mask", 0.60),))
    assert run(spark, ["acct 123456789012345"], bank)[0].safe_text == "[ACCOUNT_NUMBER]"
    assert run(spark, ["no 123456789012345"], bank)[0].safe_text == "no [US_BANK_NUMBER]"
    assert run(spark, ["no 123456789012345"], RuleSet())[0].safe_text == "no 123456789012345"


def test_null_text_and_null_role_fail_closed(spark):
    df = spark.createDataFrame(
        [(1, None, "fraud-agent"), (2, "ENT-1234567890", None)], "id int, text string, role string"
    )
    rows = shield.shield(df, "text", RULES, "role").orderBy("id").collect()
    assert rows[0].safe_text is None and rows[0].detections == []
    assert rows[1].safe_text.startswith("[ACCOUNT_NUMBER:")


HARD = [
    "é123-45-6789",
    "a@b.comé",
    "ü a@b.co",
    "٣٣٣-٤٤-٥٥٥٥ and 123-45-6789",
    "4532 0151 1283 0366",
    "+1 415 555 1234 and +14155551234",
    "ACCT: 1234567890 acct1234567890 Account # 123456789012",
    "ENT-12345678901234 ABCDE-123456789 AB-12345678",
    "1234567890123456 12345678 123456789012345678",
    "😀 415-555-1234 😀 a.b+c@d-e.co.uk",
    "123-45-6789-0000 4111111111111111a",
]


def test_unicode_and_borderline_texts_match_the_model(spark):
    df = spark.createDataFrame(list(enumerate(HARD)), "id int, text string")
    for rules in (RULES, RuleSet(tuple(EntityRule(t, "mask", 0.5) for t in {f[0] for f in model.FINDERS}))):
        rows = shield.detect(df, "text", rules).orderBy("id").collect()
        for row in rows:
            got = [(s.start, s.end, s.entity_type) for s in row.spans]
            assert got == model.spans(row.text, rules.threshold), row.text
            assert all(row.text[s.start : s.end] == s.original for s in row.spans)


pieces = st.sampled_from(
    ["123-45-6789", "4532015112830366", "a@b.com", "415-555-1234", "(415) 555-1234", "AB-12345678"]
    + ["acct", "account #", "1234567890", "99999999", " ", "-", "x", ".", "\n", "é", "12", "+1 "]
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(pieces, max_size=12).map("".join), min_size=40, max_size=60))
def test_random_texts_match_the_model(spark, texts):
    everything = RuleSet(tuple(EntityRule(t, "token", 0.5) for t in {f[0] for f in model.FINDERS}))
    for rules in (RULES, everything):
        for row in run(spark, texts, rules):
            want, kind = model.protect(row.text, rules.threshold, rules.mode)
            assert (row.safe_text, row.blocked_type) == (want, kind)


def test_detokenize_restores_every_token(spark):
    texts = ["ENT-1234567890 and AB-99999999 and ENT-1234567890", "plain", "acct 1234567890"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    done = shield.shield(df, "text", RULES)
    restored = shield.detokenize(done, "id", "safe_text", shield.vault(done)).orderBy("id")
    assert [r.restored_text for r in restored.collect()] == texts


def test_scope_changes_tokens_and_keeps_them_stable(spark):
    df = spark.createDataFrame(
        [(1, "s1", "ENT-1234567890"), (2, "s1", "ENT-1234567890"), (3, "s2", "ENT-1234567890")],
        "id int, session string, text string",
    )
    rows = shield.shield(df, "text", RULES, scope="session").orderBy("id").collect()
    assert rows[0].safe_text == rows[1].safe_text != rows[2].safe_text


def test_on_block_choices(spark):
    df = spark.createDataFrame([(1, "123-45-6789"), (2, "fine")], "id int, text string")
    assert [r.id for r in shield.shield(df, "text", RULES, on_block="drop").collect()] == [2]
    with pytest.raises(Exception, match="blocked entity"):
        shield.shield(df, "text", RULES, on_block="fail").collect()


def test_custom_recogniser_and_detector(spark):
    badge = Recogniser("US_NPI", r"\bBADGE\d+\b", 0.99)
    row = run(spark, ["see BADGE77"], recognisers=(*RECOGNISERS, badge))[0]
    assert row.safe_text == "see [US_NPI]"

    def names(text):
        return F.when(
            text.contains("Ada"),
            F.array(
                F.struct(
                    F.lit("PERSON").alias("entity_type"),
                    (F.instr(text, "Ada") - 1).alias("start"),
                    (F.instr(text, "Ada") + 2).alias("end"),
                    F.lit(0.9).alias("score"),
                    F.lit("Ada").alias("original"),
                )
            ),
        )

    row = run(spark, ["Ada wrote to a@b.com", "nobody"], detectors=(names,))[0]
    assert row.safe_text == "[PERSON] wrote to [EMAIL_ADDRESS]"


def test_absolute_block_beats_grants(spark):
    granted = RuleSet((EntityRule("US_SSN", "mask", 0.9, ("analyst",)),))
    assert run(spark, ["123-45-6789"], granted)[0].safe_text == "123-45-6789"
    assert run(spark, ["123-45-6789"], DEFAULT_POLICY.rules_for(granted))[0].status == "blocked"


def test_long_text_is_processed_whole(spark):
    text = "word " * 60_000 + "call 415-555-1234 " + "word " * 60_000 + "mail a@b.com"
    row = run(spark, [text])[0]
    assert row.safe_text.count("[PHONE_NUMBER]") == 1 and row.safe_text.endswith("[EMAIL_ADDRESS]")


def test_rule_file(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text(
        "global_mode: token\nentities:\n"
        "  - {entity_type: US_SSN, mode: block, score_threshold: 0.7}\n"
        "  - {entity_type: EMAIL_ADDRESS, mode: mask, allowed_agent_roles: [analyst]}\n"
    )
    rules = load_rules(str(path))
    assert (rules.mode("US_SSN"), rules.mode("PHONE_NUMBER")) == ("block", "token")
    assert rules.threshold("EMAIL_ADDRESS") == 0.75
    path.write_text("entities:\n  - {entity_type: NOPE, mode: mask}\n")
    with pytest.raises(ValueError):
        load_rules(str(path))


def test_split_entities_over_many_chunks(spark):
    words = "card 4532 0151 1283 0366 and mail a@b.com then acct # 123456789012 end".split()
    for size in (1, 2, 3, 50):
        pieces = [("d", i // size, " ".join(words[i : i + size])) for i in range(0, len(words), size)]
        chunks = spark.createDataFrame([*pieces, ("e", 0, None)], "doc string, pos int, t string")
        rules = RuleSet(tuple(EntityRule(k, "mask", 0.5) for k in ("CREDIT_CARD", "EMAIL_ADDRESS", "ACCOUNT_NUMBER")))
        got = shield.split_entities(chunks, "doc", "pos", "t", rules).collect()
        found = {r.entity_type: (r.pos, r.last_pos) for r in got}
        assert found.get("CREDIT_CARD") == (None if size == 50 else (1 // size, 4 // size))
        assert "EMAIL_ADDRESS" not in found


def test_colliding_tokens_are_kept_and_reported(spark):
    vault = spark.createDataFrame(
        [("[ACCOUNT_NUMBER:0000000A]", "one"), ("[ACCOUNT_NUMBER:0000000A]", "two"), ("[ACCOUNT_NUMBER:0000000B]", "three")],
        "token string, original string",
    )
    texts = spark.createDataFrame([(1, "x [ACCOUNT_NUMBER:0000000A] y [ACCOUNT_NUMBER:0000000B]"), (2, "none")], "id int, t string")
    rows = shield.detokenize(texts, "id", "t", vault).orderBy("id").collect()
    assert rows[0].restored_text == "x [ACCOUNT_NUMBER:0000000A] y three"
    assert [r.ambiguous_tokens for r in rows] == [["[ACCOUNT_NUMBER:0000000A]"], []]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"user{i}@example.com or call 415-555-{i % 10000:04d}" for i in range(4000))
    row = run(spark, [text])[0]
    assert row.safe_text == " ".join(["[EMAIL_ADDRESS] or call [PHONE_NUMBER]"] * 4000)


def test_rules_may_turn_audit_events_off(spark):
    done = shield.shield(spark.createDataFrame([("t", "Contact user@example.com.", "analyst")], "id string, text string, role string"), "text", RECOMMENDED_RULES)
    arguments = ("id", "role", F.lit("c"), F.lit(None).cast("timestamp"))
    assert shield.audit_events(done, *arguments, RECOMMENDED_RULES).count() == 1
    assert shield.audit_events(done, *arguments, replace(RECOMMENDED_RULES, audit_all_events=False)).count() == 0


def test_notes_are_made_by_all_cores(spark, tmp_path):
    from veilgate.plans import tables

    spark.range(400).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "'BUILDING' AS c_mktsegment").coalesce(1).write.parquet(
        str(tmp_path / "customer.parquet")
    )
    notes = tables.notes(spark, str(tmp_path))
    sizes = [r["count"] for r in notes.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == 400 and max(sizes) < 100


def test_a_single_match_is_placed_without_splitting(spark):
    """Its offset counts characters, and is left to the split where its characters occur elsewhere too."""
    ssn = r"\b\d{3}-\d{2}-\d{4}\b"
    texts = {
        "\U0001f600\U0001f600 é 123-45-6789 end": 5,
        "123-45-6789": 0,
        "x123-45-6789 then 123-45-6789": None,
        "123-45-6789 then 987-65-4321": None,
        "no number": None,
        None: None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", f"regexp_extract_all(text, r'(?U){ssn}', 0) AS m")
    found = rows.select("text", F.expr(shield._start_of_only("text", "m")).alias("at")).collect()
    assert {r["text"]: r["at"] for r in found} == texts
    spans = shield.detect(rows, "text", RULES).collect()
    assert {r["text"]: [(s["start"], s["end"]) for s in r["spans"]] for r in spans} == {
        "\U0001f600\U0001f600 é 123-45-6789 end": [(5, 16)],
        "123-45-6789": [(0, 11)],
        "x123-45-6789 then 123-45-6789": [(18, 29)],
        "123-45-6789 then 987-65-4321": [(17, 28), (0, 11)],
        "no number": [],
        None: [],
    }


def test_few_and_many_spans_are_chosen_alike(spark):
    """Overlapping spans of one text, then the same behind more spans than are compared all with all."""
    mixed = "card 4532 0151 1283 0366 acct #123456789012 ENT-1234567890 415-555-1234 "
    tail = "123-45-6789 " * (shield.FEW + 1)
    all_masked = RuleSet(tuple(EntityRule(r.entity_type, "mask", 0.5) for r in RECOGNISERS))
    few, many = run(spark, [mixed, mixed + tail], all_masked)
    here = lambda row: [(d["entity_type"], d["start"], d["end"]) for d in row["detections"] if d["start"] < len(mixed)]
    assert len(here(few)) == 4 and here(few) == here(many)
    assert len(many["detections"]) == 4 + shield.FEW + 1


def test_what_nobody_reads_is_not_made(spark):
    """Violations need neither the safe text nor the token map; a text without eight digits meets no pattern of numbers."""
    df = spark.createDataFrame([("t", "SSN 123-45-6789", "analyst")], "id string, text string, role string")
    done = shield.shield(df, "text", RECOMMENDED_RULES, "role")
    found = shield.violations(done, "id", "role")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "array_join" not in plan
    assert [r.entity_types for r in found.collect()] == [["US_SSN"]]
    assert "map_from_entries" in done._jdf.queryExecution().optimizedPlan().toString()


def test_no_number_is_missed_by_the_test_before_the_patterns(spark):
    texts = {
        "123-45-6789": "US_SSN",
        "a+1 (415)\u00a0555-1234": "PHONE_NUMBER",
        "1234)-567-8901 or 415)-555-1234": "PHONE_NUMBER",
        "1234\u20035678\u20039012\u20033456": "CREDIT_CARD",
        "\u0661\u0662\u0663-\u0664\u0665-\u0666\u0667\u0668\u0669": "US_SSN",
        "12345678": "US_BANK_NUMBER",
        "AB-12345678": "ACCOUNT_NUMBER",
        "ACCOUNT# :1234567890": "ACCOUNT_NUMBER",
        "123-45-678 in 2024, 1234567": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    ungated = tuple(replace(r, needs=None, begins=None) for r in RECOGNISERS)
    few, every = (
        {r.text: [tuple(s) for s in r.spans] for r in shield.detect(df, "text", RULES, kinds, gate=False, resolve=False).collect()}
        for kinds in (RECOGNISERS, ungated)
    )
    assert few == every
    assert all((kind in [s[2] for s in few[t]]) if kind else few[t] == [] for t, kind in texts.items())


def test_matches_are_placed_alike_whatever_their_number(spark):
    """One to a few are placed by plain expressions, more by a fold."""
    mails = [" \U0001f600 ".join(["x@y.com x@y.com"] + [f"m{i}@y.com" for i in range(n)]) for n in range(9)]
    for row in run(spark, mails):
        assert all(row.text[d.start : d.end] == d.original for d in row.detections)
        assert row.safe_text == " \U0001f600 ".join(
            ["[EMAIL_ADDRESS] [EMAIL_ADDRESS]"] + ["[EMAIL_ADDRESS]"] * (len(row.detections) - 2)
        )
    assert [len(r.detections) for r in run(spark, mails)] == [n + 2 for n in range(9)]
