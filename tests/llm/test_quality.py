import random
import zlib

import numpy as np
import pytest

from veilgate.llm import quality as Q


def walk(forest, row):
    total = forest.base
    for t in range(len(forest.value)):
        node = 0
        while forest.left[t, node] != node:
            go_left = row[forest.feature[t, node]] <= forest.threshold[t, node]
            node = forest.left[t, node] if go_left else forest.right[t, node]
        total += forest.value[t, node]
    return 1 / (1 + np.exp(-total))


def test_flat_traversal_equals_walking_the_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0.2)).astype(float)
    forest = Q.boost(x, y, trees=40)
    scores = forest.score(x)
    assert np.allclose(scores[:50], [walk(forest, r) for r in x[:50]])
    test = rng.normal(size=(2000, 5))
    truth = (test[:, 0] > 0.3) ^ (test[:, 2] * test[:, 1] > 0.2)
    assert ((forest.score(test) >= 0.5) == truth).mean() > 0.9


def test_degenerate_samples():
    none = Q.boost(np.empty((0, 3)), np.empty(0))
    assert none.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert Q.boost(np.zeros((9, 3)), np.ones(9)).score(np.zeros((1, 3)))[0] == pytest.approx(10 / 11)


def test_statistics_cover_the_whole_text():
    plain = "A fine line of words here.\n" * 3
    assert len(Q.statistics(plain)) == len(Q.FEATURES)
    assert Q.statistics(None) == Q.statistics("") == Q.statistics(" \n") == [0.0] * len(Q.FEATURES)
    assert Q.statistics("x" * 500_000 + " !!!") != Q.statistics("x" * 500_000 + " abc")


def make(rng, good):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))]
    if good:
        return " ".join(words).capitalize() + "."
    return " ".join(w.upper() + "!!" for w in words[:6] * 5)


def test_held_out_rows(spark, docs):
    rng = random.Random(2)
    truth = {i: int(rng.random() < 0.7) for i in range(500)}
    rows = [(i, make(rng, g)) for i, g in truth.items()]
    extra = [(None, "no id at all"), (900, None), (901, ""), (902, " "), (0, rows[0][1])]
    labels = spark.createDataFrame(
        [(i, g, 0) for i, g in truth.items()] + [(3, None, 0), (None, 1, 0), (3, truth[3], 1), (7777, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    frame = docs(rows + extra).withColumnsRenamed({"lang": "score", "source": "quality"})
    forest = Q.fit(frame, labels)
    out = Q.score(frame, forest, keep=["doc_id"]).collect()
    assert len(out) == len(rows) + len(extra)
    scores = {r.doc_id: r.score for r in out}
    assert all(0 <= s <= 1 for s in scores.values())
    assert scores[900] == scores[901] == scores[902]
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.5) == truth[i] for i in held]) > 0.98
    again = Q.fit(frame.repartition(5), labels)
    assert np.array_equal(forest.value, again.value)
    # labels of the held-out fold change nothing
    flipped = labels.selectExpr("doc_id", f"CASE WHEN {Q.HELD_OUT.format(id='doc_id')} THEN 1 - quality ELSE quality END AS quality")
    assert np.array_equal(forest.value, Q.fit(frame, flipped).value)


def test_sample_bound_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    frame = docs([(i, "word " * (i + 1)) for i in range(60)])
    assert 0 < Q.fit(frame, labels, sample_rows=10).base + 10
    empty = Q.fit(docs([]), labels.limit(0))
    assert [r.score for r in Q.score(frame, empty).collect()] == [0.5] * 60
    assert Q.score(docs([]), empty).collect() == []
