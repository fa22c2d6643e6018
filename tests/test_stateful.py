"""Lifetimes in the state of a stream, and escalations that are delivered once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilgate.sources.readers import stream_table
from veilgate.streaming import lifetimes, outbox, streams

T0 = datetime(2024, 1, 1)
FIELDS = "entity_token string, feature_set string, as_of timestamp, version long"


def run(spark, path, rows):
    spark.createDataFrame([(k, "s", T0 + timedelta(hours=h), v) for k, h, v in rows], FIELDS).write.mode("append").parquet(f"{path}-in")
    stream = stream_table(spark, f"{path}-in", FIELDS)
    done = streams.run_available(lifetimes.with_lifetimes(stream), path).collect()
    return sorted((r.entity_token, (r.as_of - T0) // timedelta(hours=1), r.action, r.version) for r in done)


def test_seen_expired_seen_again(spark, tmp_path):
    path = str(tmp_path / "x")
    first = run(spark, path, [("a", 0, 1), ("a", 5, 2), ("a", 5, 2), ("a", 4, 9), ("b", 1, 1), ("c", 40, 1)])
    assert first == [
        ("a", 0, "inserted", 1), ("a", 4, "updated", 9), ("a", 5, "expired", 2), ("a", 5, "updated", 2),
        ("b", 1, "expired", 1), ("b", 1, "inserted", 1), ("c", 40, "inserted", 1),
    ]
    again = run(spark, path, [("a", 50, 3), ("c", 63, 2), ("c", 64, 3), ("c", 90, 4)])
    assert again[len(first) :] or len(again) > len(first)
    assert [x for x in again if x not in first] == [
        ("a", 50, "expired", 3), ("a", 50, "inserted", 3), ("c", 63, "updated", 2), ("c", 64, "expired", 3), ("c", 64, "updated", 3), ("c", 90, "inserted", 4),
    ]


def critical_rows(spark, n, first=0):
    rows = [(f"e{i}", "CRITICAL" if i % 2 else "INFO", f"text {i}") for i in range(first, n)]
    return spark.createDataFrame(rows, "event_id string, severity string, note string")


def test_a_killed_and_repeated_batch_delivers_once(spark, tmp_path):
    calls, box = tmp_path / "calls", str(tmp_path / "box")
    calls.mkdir()

    def receiver(event):
        with open(calls / event["event_id"], "a") as file:
            file.write("x")
        if event["event_id"] == "e5":
            raise RuntimeError("receiver is down")
        if event["event_id"] == "e9" and not (tmp_path / "died").exists():
            (tmp_path / "died").touch()
            __import__("os")._exit(1)

    with pytest.raises(Exception):  # noqa: B017 - the worker dies
        outbox.deliver(critical_rows(spark, 20).coalesce(1), box, 0, receiver)
    outbox.deliver(critical_rows(spark, 20), box, 0, receiver)
    outbox.deliver(critical_rows(spark, 20), box, 0, receiver)
    outbox.deliver(critical_rows(spark, 24, 18), box, 1, receiver)
    assert {p.name: p.read_text() for p in calls.iterdir()} == {f"e{i}": "x" for i in range(1, 24, 2)}
    found = {r.event_id: (r.status, r.attempts) for r in outbox.status(spark, box).collect()}
    assert found == {f"e{i}": ({5: "failed", 9: "unsure"}.get(i, "delivered"), 1) for i in range(1, 24, 2)}

    outbox.retry(spark, box, lambda event: None)
    found = {r.event_id: (r.status, r.attempts) for r in outbox.status(spark, box).collect()}
    assert found["e5"] == ("delivered", 2) and found["e9"] == ("unsure", 1)
    outbox.retry(spark, box, lambda event: None, also_unsure=True)
    assert {r.status for r in outbox.status(spark, box).collect()} == {"delivered"}


def test_slices_and_nothing_to_do(spark, tmp_path):
    box = str(tmp_path / "box")
    assert outbox.status(spark, box).count() == 0
    outbox.deliver(critical_rows(spark, 4).where("false"), box, 0, print)
    assert outbox.status(spark, box).count() == 0
    events = critical_rows(spark, 100)
    outbox.deliver(events.union(events), box, 1, lambda event: None, slice_rows=7)
    assert outbox.status(spark, box).where((F.col("status") == "delivered") & (F.col("attempts") == 1)).count() == 50
