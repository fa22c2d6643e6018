import pytest
from pyspark.sql import functions as F

from tests.test_shield import RULES
from veilgate.operators import guards, search


def prompts(spark, texts, **more):
    df = spark.createDataFrame(
        [(i, t, "analyst", "s") for i, t in enumerate(texts)],
        "id int, prompt string, role string, session string",
    )
    return guards.guard_prompts(df, "prompt", RULES, "role", **more).orderBy("id")


def test_strict_prompts(spark):
    texts = [
        "Review SSN 123-45-6789 for this account.",
        "Card 4532-0151-1283-0366 was declined.",
        "You are a helpful agent.",
        "Statement of 2024-01-15 attached.",
        "mail a@b.com",
        "digits 4155551234 only",
        "call (415) 555-1234",
        "account 1234567890",
    ]
    rows = prompts(spark, texts).collect()
    assert [r.action for r in rows] == ["blocked"] * 2 + ["passed"] * 2 + ["sanitized"] + ["passed"] * 3
    assert [r.safe_prompt for r in rows[2:4]] == texts[2:4]
    assert rows[0].entities_found == ["US_SSN"] and rows[0].safe_prompt is None


def test_lenient_prompt_is_redacted(spark):
    row = prompts(spark, ["Review SSN 123-45-6789, mail a@b.com."], strict=False).first()
    assert row.action == "sanitized"
    assert row.safe_prompt == "Review SSN [REDACTED], mail [REDACTED]."


def test_exempt_prompt_passes_with_entities(spark):
    df = spark.createDataFrame([("a@b.com", "servicing-agent")], "prompt string, role string")
    row = guards.guard_prompts(df, "prompt", RULES, "role").first()
    assert (row.action, row.pii_detected, row.entities_found) == ("passed", False, ["EMAIL_ADDRESS"])


@pytest.mark.parametrize("blocking", [True, False])
def test_responses(spark, blocking):
    texts = [
        "The SSN on file is 555-66-7777. Account is current.",
        "I found card 4532-0151-1283-0366 on the account.",
        "Call the customer at 415-555-1234 immediately.",
        "The dispute has been logged with reference DISP-2024-00142.",
        "Write to a@b.com on 2024-01-15.",
    ]
    df = spark.createDataFrame(
        [(i, t, "agent", "s") for i, t in enumerate(texts)],
        "id int, response string, agent string, session string",
    )
    done = guards.guard_responses(df, "response", blocking)
    rows = done.orderBy("id").collect()
    assert [r.leakage for r in rows] == [True, True, True, False, False]
    assert [r.risk for r in rows] == [1.0, 1.0, 1.0, 0.0, 0.6]
    first = "blocked" if blocking else "sanitized"
    assert [r.action for r in rows] == [first] * 3 + ["passed", "logged"]
    assert rows[4].entities_found == ["EMAIL", "DATE"]
    if not blocking:
        assert rows[0].safe_response == "The SSN on file is [REDACTED]. Account is current."
    alarms = guards.escalations(done, "id", "agent", "session", F.current_timestamp()).collect()
    assert len(alarms) == 3 and {a.severity for a in alarms} == {"CRITICAL"}


def test_query_is_redacted_not_refused(spark):
    df = spark.createDataFrame([("find 123-45-6789 and a@b.com", "analyst")], "query string, role string")
    row = guards.sanitise_queries(df, "query", RULES, "role").first()
    assert row.safe_query == "find [REDACTED] and a@b.com" and row.query_redacted


def test_quality_scores(spark):
    rows = [
        ("dispute timeline days", ["disputes take days", "nothing here"], "disputes take ten days"),
        ("test", [], "no answer"),
        ("same words", ["same words"], "same words"),
    ]
    df = spark.createDataFrame(rows, "q string, ctx array<string>, a string")
    done = search.retrieval_quality(df, "q", "a", "ctx").collect()
    names = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
    assert all(0.0 <= r[n] <= 1.0 for r in done for n in names)
    assert [r.quality_gate for r in done] == ["REVIEW_REQUIRED", "REVIEW_REQUIRED", "PASS"]
