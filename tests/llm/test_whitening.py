"""Whitening against double precision eigenvectors, exact integers and constructed clusters."""

import numpy as np
import pytest

from veilgate.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def _collect(frame):
    rows = sorted(frame.collect(), key=lambda r: (r.vec_id, r.component))
    return rows


def _reference(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array([[(n * int(a) - int(b)) / n for a, b in zip(row, s)] for row in x])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, e[::-1], q[:, ::-1]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 40)) @ np.diag(1 / np.arange(1, 41) ** 0.5)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    odd = [(900, None, 0), (901, [None] * 40, 0), (902, [float("nan")] + [0.0] * 39, 0), (903, [float("inf")] * 40, 0), (904, [], 0), (905, [1e30] * 40, 0)]
    found = _collect(W.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(5)))
    deviation, centred, e, q = _reference(base)
    assert len(found) == 300 * 32
    assert {r.n for r in found} == {300} and {r.deviation for r in found if r.vec_id == 7} == {deviation[7]}
    assert [r.deviation for r in found[::32]] == deviation
    ours = np.array([r.whitened for r in found]).reshape(300, 32)
    plain = centred @ q[:, :32] / np.sqrt(e[:32])
    assert np.allclose(ours * np.sign((ours * plain).sum(axis=0)), plain, atol=1e-9)
    assert np.allclose([r.explained for r in found[:32]], e[:32] / e.sum(), rtol=1e-12)
    assert found[0].identity_error < 1e-10


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(200, 8)))]
    one = W.fit(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    many = W.fit(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert one.sums == many.sums and (one.vectors == many.vectors).all() and (one.values == many.values).all()


@pytest.mark.parametrize("gap", [1e-3, 1e-8, 1e-11, 0.0])
def test_clusters_are_told_apart(gap):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(24, 24)))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal in extended precision
        q = q @ (3 * np.eye(24, dtype=np.longdouble) - q.T @ q) / 2
    e = np.concatenate(([9, 7], 5 + gap * np.arange(6), 3 + gap * np.arange(6), np.linspace(2, 1, 10))).astype(np.longdouble)
    values, x = W.eigen(q @ np.diag(e) @ q.T)
    order = np.argsort(-e, kind="stable")
    assert np.abs(values - e[order]).max() < 1e-16
    assert np.abs(x.T @ x - np.eye(24)).max() < 1e-16
    if gap:
        off = 1 - np.abs((x * q[:, order]).sum(axis=0))
        assert off.max() < max(1e-16, (1e-17 / gap) ** 2 * 1e3)
    plain = np.linalg.eigh((q @ np.diag(e) @ q.T).astype(float))[1][:, ::-1]
    if gap == 1e-8:  # better than double precision alone
        assert off.max() < (1 - np.abs((plain * q[:, order].astype(float)).sum(axis=0))).max()


def test_few_or_equal_or_no_vectors(spark):
    empty = W.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert empty.count() == 0
    twice = _collect(W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (None, None, 1)], SCHEMA)))
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in twice] == [(1, 2, 0, 0.0, 0.0, 1.0)] * 2 + [(2, 2, 0, 0.0, 0.0, 1.0)] * 2


def test_wide_entries_stay_exact(spark):
    rows = [(i, [float(v), 1.0], 0) for i, v in enumerate((2.0**20, -(2.0**20), 3.0, 0.5))]
    found = _collect(W.whiten(spark.createDataFrame(rows, SCHEMA)))
    assert [r.deviation for r in found[::2]] == _reference([v for _, v, _ in rows])[0]
    assert found[0].explained == pytest.approx(1.0) and all(r.whitened == 0 for r in found[1::2])
    # beyond a long there is no deviation, the rest stays
    vast = _collect(W.whiten(spark.createDataFrame([(0, [2.0**40], 0), (1, [0.0], 0)], SCHEMA)))
    assert vast[0].deviation is None and abs(vast[0].whitened) == pytest.approx(1.0)


def test_clashing_columns_and_lengths(spark):
    frame = spark.createDataFrame([(0, [1.0], 5), (1, [2.0], 6)], "vec_id long, embedding array<float>, whitened int")
    assert W.whiten(frame.withColumn("__vector", frame.whitened)).count() == 2
    with pytest.raises(Exception, match="several lengths"):
        W.whiten(spark.createDataFrame([(0, [1.0], 0), (1, [2.0, 1.0], 0)], SCHEMA).repartition(2)).count()
