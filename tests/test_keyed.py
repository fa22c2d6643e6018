import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veilgate.operators import keyed
from veilgate.session import settle

START = datetime(2024, 1, 1)


def times(rng, n):
    return [START + timedelta(hours=rng.randint(0, 24 * 200)) for _ in range(n)]


def test_asof_join_equals_brute_force(spark):
    rng = random.Random(1)
    keys = ["hot"] * 60 + ["a", "b", "c"]
    history = [(rng.choice(keys), t, i, float(i)) for i, t in enumerate(times(rng, 300))]
    asked = [(rng.choice([*keys, "none"]), t, i) for i, t in enumerate(times(rng, 200))]
    h = spark.createDataFrame(history, "k string, ht timestamp, v long, x double")
    r = spark.createDataFrame(asked, "k string, rt timestamp, id long")
    for ranges in (None, 1, 40):
        got = keyed.asof_join(r, h, ["k"], "rt", "ht", "v", ranges).collect()
        assert len(got) == len(asked)
        for row in got:
            past = [(t, v) for k, t, v, _ in history if k == row.k and t <= row.rt]
            assert row.v == (max(past)[1] if past else None)


def test_numbering_equals_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), t, i) for i, t in enumerate(times(rng, 300))]
    df = spark.createDataFrame(rows, "k string, t timestamp, id long")
    got = keyed.numbered(df, ["k"], ["t", "id"], F.date_trunc("day", "t")).collect()
    for k in "ab":
        want = sorted((t, i) for key, t, i in rows if key == k)
        assert [(r.t, r.id) for r in sorted(got, key=lambda r: r.position) if r.k == k] == want
        assert sorted(r.position for r in got if r.k == k) == list(range(1, len(want) + 1))


def test_balanced_and_salted_joins_equal_plain_joins(spark, monkeypatch):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(200)]
    large = spark.createDataFrame(rows, "k string, i long")
    small = spark.createDataFrame([("hot", "H"), *[(f"k{i}", f"v{i}") for i in range(30)]], "k string, v string")
    want = {tuple(r) for r in large.join(small, "k", "left").collect()}
    salted = keyed.salted_join(large, small, ["k"], "left", salts=5)
    assert {tuple(r) for r in salted.select("k", "i", "v").collect()} == want
    sizes = iter([False, True, True])
    monkeypatch.setattr(keyed, "is_small", lambda df, rows=0: next(sizes))
    split = keyed.balanced_join(large, small, ["k"], "left", heavy=100)
    assert {tuple(r) for r in split.select("k", "i", "v").collect()} == want
    assert split.count() == len(rows)


def test_quantiles_are_nearest_rank(spark):
    rng = random.Random(3)
    values = [rng.randint(0, 50) for _ in range(500)]
    df = spark.createDataFrame([("p", v) for v in values], "k string, v int")
    row = keyed.exact_quantiles(df, ["k"], "v", {"p50": 0.5, "p99": 0.99}).first()
    ordered = sorted(values)
    assert (row.p50, row.p99) == (ordered[249], ordered[494])


def test_a_dense_hot_key_is_spread_over_ranges(spark, monkeypatch):
    moments = [START + timedelta(milliseconds=i) for i in range(4000)]
    h = spark.createDataFrame([("hot", t, i) for i, t in enumerate(moments)], "k string, ht timestamp, v long")
    r = spark.createDataFrame([("hot", t, i) for i, t in enumerate(moments[::7])], "k string, rt timestamp, id long")
    dealt = []
    monkeypatch.setattr(keyed, "settle", lambda df, name="": dealt.append(settle(df, name)) or dealt[-1])
    found = keyed.asof_join(r, h, ["k"], "rt", "ht", "v", 8).collect()
    assert all(row.v == row.id * 7 for row in found) and len(found) == len(moments[::7])
    sizes = [row["count"] for row in dealt[0].groupBy("_b").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_only_hot_keys_are_dealt_by_ranges(spark, monkeypatch):
    rng = random.Random(4)
    dealt = []
    monkeypatch.setattr(keyed, "settle", lambda df, name="": dealt.append(settle(df, name)) or dealt[-1])
    for hot in (0, 600):
        names = [f"k{i % 90}" for i in range(900)] + ["hot"] * hot
        history = [(k, t, i) for i, (k, t) in enumerate(zip(names, times(rng, len(names)), strict=True))]
        asked = [(k, t, i) for i, (k, t) in enumerate(zip([*names, "none"], times(rng, len(names) + 1), strict=True))]
        h = spark.createDataFrame(history, "k string, ht timestamp, v long")
        r = spark.createDataFrame(asked, "k string, rt timestamp, id long")
        got = keyed.asof_join(r, h, ["k"], "rt", "ht", "v", None, 100).collect()
        assert sorted(row.id for row in got) == list(range(len(asked)))
        for row in got:
            past = [(t, v) for k, t, v in history if k == row.k and t <= row.rt]
            assert row.v == (max(past)[1] if past else None)
        assert {row.k for df in dealt for row in df.select("k").distinct().collect()} == ({"hot"} if hot else set())


def test_quantiles_by_selection_equal_sorting(spark):
    rng = random.Random(8)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 0.5, 1e9])) for _ in range(3000)]
    rows += [(f"k{i % 7}", float(rng.randint(0, 9))) for i in range(60)] + [("one", 4.0), ("none", None), (None, 1.0), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    fractions = {"least": 0.0001, "p50": 0.5, "p95": 0.95, "p99": 0.99, "most": 1.0}
    for accuracy in (keyed.ACCURACY, 20):
        found = {r.k: r for r in keyed.exact_quantiles(df, ["k"], "v", fractions, accuracy).collect()}
        for key in {k for k, _ in rows} - {None}:
            ordered = sorted(v for k, v in rows if k == key and v is not None)
            for name, q in fractions.items():
                want = ordered[math.ceil(len(ordered) * q) - 1] if ordered else None
                assert found[key][name] == want, (key, name)


def test_latest_per_key_breaks_ties(spark):
    rows = [("a", START, 1, "x"), ("a", START, 2, "y"), ("b", START, 1, None)]
    df = spark.createDataFrame(rows, "k string, t timestamp, n int, v string")
    got = {r.k: (r.n, r.v) for r in keyed.latest_per_key(df, ["k"], ["t", "n"]).collect()}
    assert got == {"a": (2, "y"), "b": (1, None)}


def test_size_check_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1.0] * 100)] * 50, "s string, v array<double>")
    assert keyed.is_small(df)
    assert not keyed.is_small(df, rows=49)
    assert not keyed.is_small(df, size=50_000)


def test_salted_join_takes_maps(spark):
    large = spark.createDataFrame([(1, {"a": 1}), (1, {"b": 2}), (2, None)], "k int, m map<string,int>")
    small = spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted(r.v for r in keyed.salted_join(large, small, ["k"]).collect()) == ["x", "x"]


def test_two_sided_join_makes_each_pair_once(spark):
    left = spark.createDataFrame([("hot", i) for i in range(40)] + [("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("hot", i) for i in range(30)] + [("a", 7), ("b", 1), (None, 3)], "k string, y int")
    got = keyed.two_sided_join(left, right, ["k"], ["x"], ["y"]).collect()
    assert len(got) == 40 * 30 + 1 and len(set(got)) == len(got)


def test_only_hot_keys_are_repeated(spark):
    left = spark.createDataFrame([(i % 7 if i > 60 else 0, i) for i in range(100)] + [(None, -1)], "k int, a int")
    right = spark.createDataFrame([(i % 9 if i < 20 else 3, i) for i in range(60)] + [(None, -1)], "k int, b int")
    want = sorted(map(tuple, left.join(right, ["k"]).collect()))
    for heavy, buckets in ((5, 64), (5, 1), (1000, 64), (0, 64)):
        got = keyed.skewed_join(left, right, ["k"], ["a"], ["b"], heavy, buckets)
        assert sorted(map(tuple, got.collect())) == want
    unlike = right.withColumn("k", right.k.cast("long"))
    assert sorted(map(tuple, keyed.skewed_join(left, unlike, ["k"], ["a"], ["b"], 5).collect())) == want
    plan = keyed.skewed_join(left, right, ["k"], ["a"], ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
