"""The stored inverted index against a plain BM25 over all chunks."""

import datetime
import math
import random

import pytest

from veilgate.operators import postings as P
from veilgate.session import scratch_path

CHUNKS = "chunk_id string, domain string, updated_at timestamp, terms array<string>"
ASKED = "query_id string, query string, domain string, cutoff timestamp"
DAY = datetime.datetime(2024, 5, 1)


def make(seed, n, name="c"):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        terms = [rng.choice(words[: rng.choice((6, 60))]) for _ in range(rng.randint(0, 30))]
        day = DAY + datetime.timedelta(days=rng.randint(0, 5), hours=rng.randint(0, 23)) if i % 17 else None
        rows.append((f"{name}{i}", rng.choice(["en", "de", None]), day, terms))
    return rows


def plain(rows, asked, k):
    n, average = len(rows), sum(len(t) for *_, t in rows) / len(rows)
    df = {}
    for *_, terms in rows:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text, domain, cutoff in asked:
        scored = []
        for c, d, at, terms in rows:
            if (domain != "all" and d != domain) or (cutoff is not None and (at is None or at < cutoff)):
                continue
            s = 0.0
            for t in set((text or "").split()):
                tf = terms.count(t)
                if tf:
                    s += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / average))
            if round(s, 6) > 0:
                scored.append((round(s, 6), c))
        scored.sort(key=lambda x: (-x[0], x[1]))
        out += [(q, c, s, p + 1, 1 + sum(x > s for x, _ in scored)) for p, (s, c) in enumerate(scored[:k])]
    return sorted(out)


ASKS = [
    ("q0", "w1 w2 w50", "all", None),
    ("q1", "w3 unknown", "en", DAY + datetime.timedelta(days=2, hours=5)),
    ("q2", "w0 w0", "de", None),
    ("q3", "unknown words", "all", None),
    ("q4", None, "all", None),
    ("q5", "w59", "fr", None),
    ("q6", " ".join(f"w{k}" for k in range(60)), "all", DAY + datetime.timedelta(days=4)),
]


@pytest.mark.parametrize("segment", [1024, 7])
def test_equals_plain_scores(spark, monkeypatch, segment):
    monkeypatch.setattr(P, "SEGMENT", segment)
    rows, more = make(1, 400), make(2, 150, "d")
    folder = scratch_path(spark, "index")
    P.append(spark.createDataFrame(rows, CHUNKS).repartition(3), folder)
    P.append(spark.createDataFrame(more, CHUNKS), folder)
    asked = spark.createDataFrame(ASKS, ASKED)
    for k in (1, 5, 40):
        found = sorted(map(tuple, P.search(spark, folder, asked, "query", k).collect()))
        want = plain(rows + more, ASKS, k)
        assert [(q, c, p, r) for q, c, _, p, r in found] == [(q, c, p, r) for q, c, _, p, r in want]
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(found, want))


def test_ties_go_by_id_over_all_segments(spark):
    rows = [(f"c{i:03}", "en", DAY, ["alike"]) for i in random.Random(3).sample(range(500), 500)]
    folder = scratch_path(spark, "index")
    P.append(spark.createDataFrame(rows, CHUNKS).repartition(8), folder)
    found = P.search(spark, folder, spark.createDataFrame([("q", "alike", "all", None)], ASKED), "query", 4).collect()
    assert [(r.chunk_id, r.position, r.sparse_rank) for r in sorted(found, key=lambda r: r.position)] == [(f"c{i:03}", i + 1, 1) for i in range(4)]


def test_batches_empty_tables_and_plan(spark, monkeypatch):
    rows = make(5, 200)
    folder = scratch_path(spark, "index")
    P.append(spark.createDataFrame(rows, CHUNKS), folder)
    asked = spark.createDataFrame(ASKS, ASKED)
    one = sorted(map(tuple, P.search(spark, folder, asked, "query", 5).collect()))
    monkeypatch.setattr(P, "BATCH_QUERIES", 2)
    assert sorted(map(tuple, P.search(spark, folder, asked, "query", 5).collect())) == one
    assert P.search(spark, folder, asked.limit(0), "query", 5).count() == 0
    blocks = P.reachable(P._table(spark, folder, "postings", "month segment term latest docs n"), ["w1", "w2"], 1_714_521_600_000_000)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [w1,w2])" in plan and "PartitionFilters: [isnotnull(month" in plan
    nothing = scratch_path(spark, "index")
    P.append(spark.createDataFrame([("a", "en", DAY, []), ("b", None, None, None)], CHUNKS), nothing)
    assert P.search(spark, nothing, asked, "query", 5).count() == 0


def test_a_segment_that_cannot_matter_is_skipped():
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    asked = P._Asked(
        pd.DataFrame({"query_id": ["q"], "domain": ["all"], "cutoff": pd.to_datetime([None])}), pd.DataFrame({"query_id": ["q"], "term": ["x"], "idf": [1.0]}), 2.0
    )
    top = P._Top(1, 1)

    def block(tf):
        terms = pa.array([["x"] * tf])
        return pa.Table.from_batches([next(P._segment("2024-05", "en", [f"c{tf}"], np.array([0]), terms))])

    assert P._score_segment(block(9), asked, top) == 1
    top.prune()
    assert P._score_segment(block(1), asked, top) == 0
