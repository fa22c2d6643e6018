"""Embeddings kept between runs and models."""

import pytest
from pyspark.sql import functions as F

from veilgate.functions.text import embedding_key
from veilgate.functions.vectors import pseudo_components
from veilgate.operators import vector_store as V


def embed(shift):
    return lambda t: F.transform(pseudo_components(embedding_key(t), 8), lambda x: x + shift)


def test_second_run_embeds_nothing_and_a_new_model_only_what_it_lacks(spark, tmp_path):
    folder = str(tmp_path / "store")
    one = spark.createDataFrame([(1, "A  text"), (2, "a text"), (3, "other"), (4, None)], "id int, text string")
    two = spark.createDataFrame([(5, "OTHER"), (6, "third")], "id int, text string")
    found, new = V.embed_stored(one, "text", embed(0), folder, "m1", 8)
    rows = {r.id: r.embedding for r in found.collect()}
    assert new == 2 and rows[1] == rows[2] != rows[3] and rows[4] is None
    assert V.embed_stored(one, "text", embed(0), folder, "m1", 8)[1] == 0
    both, new = V.embed_stored(one.union(two), "text", embed(0), folder, "m1", 8)
    assert new == 1 and {r.id: r.embedding for r in both.collect()}[5] == rows[3]
    keys = one.union(two).where("text IS NOT NULL").select(embedding_key(F.col("text")).alias("key")).distinct()
    assert V.outdated(keys, folder, "m2").count() == 3 and V.outdated(keys, folder, "m1").count() == 0
    renewed, new = V.embed_stored(two, "text", embed(1), folder, "m2", 8)
    assert new == 2 and V.outdated(keys, folder, "m2").count() == 1
    assert {r.id: r.embedding[0] for r in renewed.collect()}[5] == pytest.approx(rows[3][0] + 1)
    plan = V.missing(keys, folder, "m1")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "PartitionFilters: [isnotnull(model" in plan


def test_wrong_width_stores_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "x")], "id int, text string")
    with pytest.raises(Exception, match="expected 9, got 8"):
        V.embed_stored(rows, "text", embed(0), folder, "m", 9)
    assert V.stored(spark, folder).count() == 0
    assert V.embed_stored(rows.limit(0), "text", embed(0), folder, "m", 8)[1] == 0


def test_a_key_is_evaluated_once_per_vector(spark):
    known = {tuple(r.v) for r in spark.createDataFrame([("a",), ("b",)], "k string").select(pseudo_components(F.col("k"), 64).alias("v")).collect()}
    either = F.when(F.rand(1) < 0.5, "a").otherwise("b")  # another value each time it is evaluated
    got = {tuple(r.v) for r in spark.range(64).select(pseudo_components(either, 64).alias("v")).collect()}
    assert got == known


def test_components_are_the_digits_of_the_digests(spark):
    import hashlib

    row = spark.createDataFrame([("k", None)], "a string, b string").select(pseudo_components(F.col("a"), 20).alias("a"), pseudo_components(F.col("b"), 20).alias("b")).first()
    digits = "".join(hashlib.sha256(f"k:{i}".encode()).hexdigest() for i in range(2))
    assert row.a == [int(digits[4 * i : 4 * i + 4], 16) / 32768 - 1 for i in range(20)] and row.b == [None] * 20


def test_copies_of_a_heavy_text_are_joined_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "HEAVY", 2)
    rows = spark.createDataFrame([(i, "same" if i < 5 else f"t{i}" if i < 8 else None) for i in range(9)], "id int, text string")
    found, new = V.embed_stored(rows, "text", embed(0), str(tmp_path / "store"), "m", 8)
    got = {r.id: r.embedding for r in found.collect()}
    assert new == 4 and len(got) == 9 and len({tuple(got[i]) for i in range(5)}) == 1 and got[8] is None
    assert len({tuple(got[i]) for i in range(4, 8)}) == 4


def test_a_wrong_width_is_a_value_error_and_commits_no_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id int, text string")
    with pytest.raises(ValueError, match="expected 9, got 8"):
        V.embed_stored(rows, "text", embed(0), str(tmp_path / "store"), "m", 9)
    assert not list(tmp_path.rglob("*.parquet"))


def test_wide_components_are_those_of_the_digests_too(spark):
    import hashlib

    rows = spark.createDataFrame([(i, f"k{i}" if i % 3 else None) for i in range(600)], "id int, k string").repartition(1)
    got = {r.k: r.v for r in rows.select("k", pseudo_components(F.col("k"), 300).alias("v")).collect()}
    digits = "".join(hashlib.sha256(f"k7:{i}".encode()).hexdigest() for i in range(19))
    assert got["k7"] == [int(digits[4 * i : 4 * i + 4], 16) / 32768 - 1 for i in range(300)]
    assert len(got) == 401 and got[None] == [None] * 300


def test_only_what_is_read_of_a_vector_meets_the_texts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, None)], "id int, text string")
    whole, _ = V.embed_stored(rows, "text", embed(0), str(tmp_path / "store"), "m", 8)
    read = {"n": F.size, "last": lambda v: F.element_at(v, -1)}
    found, new = V.embed_stored(rows, "text", embed(0), str(tmp_path / "store"), "m", 8, read=read)
    assert new == 0 and found.columns == ["id", "text", "n", "last"]
    assert {tuple(r) for r in found.select("id", "n", "last").collect()} == {
        (r.id, None, None) if r.embedding is None else (r.id, 8, r.embedding[-1]) for r in whole.collect()
    }
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(embedding" in joined.split("Join LeftOuter")[1] and "embedding" not in joined.split("Join LeftOuter")[0]


def test_texts_of_stored_keys_are_left_out_before_the_shuffle(spark):
    rows = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("key"), F.col("id").cast("string").alias("_text"))
    lacking = rows.where("_text % 20 = 0").select("key")
    kept = V._likely(rows, lacking, 1000)
    assert lacking.join(kept, "key", "left_anti").isEmpty() and 1000 <= kept.count() < 4000
    least = V._least_texts(rows.unionByName(rows.select("key", F.concat(F.lit("x"), "_text").alias("_text"))), lacking, 1000)
    assert {(r.key, r._text) for r in least.collect()} == {(r.key, r._text) for r in rows.where("_text % 20 = 0").collect()}


def test_what_a_run_shuffles_is_gone_when_it_returns_and_the_setting_is_as_before(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    seen, was = [], spark.conf.get(name, "false")

    def watching(t):
        seen.append(spark.conf.get(name))
        return embed(0)(t)

    V.embed_stored(rows, "text", watching, str(tmp_path / "store"), "m", 8)
    assert seen == ["true"] and spark.conf.get(name) == was
    with pytest.raises(ValueError, match="expected 9"):
        V.embed_stored(rows, "text", embed(0), str(tmp_path / "store"), "m9", 9)
    assert spark.conf.get(name) == was


def test_a_run_adds_one_folder_unsorted_and_reads_stores_with_a_folder_per_digit(spark, tmp_path):
    folder = tmp_path / "store"
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id int, text string")
    old = rows.where("id < 20").select(embedding_key(F.col("text")).alias("key"), F.lit(8).alias("dimension"), embed(0)(F.col("text")).cast("array<float>").alias("embedding"))
    old.withColumn("model", F.lit("m:1")).withColumn("part", F.substring("key", 1, 1)).write.partitionBy("model", "part").parquet(str(folder))
    before = {p.name for p in folder.glob("model=m%3A1/part=*")}
    found, new = V.embed_stored(rows, "text", embed(0), str(folder), "m:1", 8)
    assert new == 20 and len({p.name for p in folder.glob("model=m%3A1/part=*")} - before) == 1
    assert V.stored(spark, str(folder), "m:1").select("key").distinct().count() == 40
    assert found.where("size(embedding) = 8").count() == 40


def test_the_key_is_evaluated_once_where_texts_are_read(spark, tmp_path):
    rows = spark.range(9).selectExpr("cast(id as string) AS text")
    keyed = rows.select(embedding_key(F.col("text")).alias("key"), F.col("text").alias("_text")).where("_text IS NOT NULL")
    plan = V._likely(keyed, keyed.select("key"), 9)._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert plan.count("regexp_replace") == 1
