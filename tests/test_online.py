"""Lookups in the bucketed online table exchange the requests alone."""

from veilgate.operators import online


def test_lookup_does_not_shuffle_the_table(spark, tmp_path):
    rows = [(f"t{i}", s, i) for i in range(200) for s in ("a", "b")]
    features = spark.createDataFrame(rows, "entity_token string, feature_set string, version int")
    online.store(features, "online_test", str(tmp_path / "online"), 8)
    asked = spark.createDataFrame([(i, f"t{i * 3}") for i in range(100)] + [(1000, None)], "request_id int, entity_token string")
    found = online.lookup(asked, spark.table("online_test"))
    got = sorted((r.request_id, r.feature_set or "", r.version or 0) for r in found.collect())
    assert got == sorted([(i, s, i * 3) for i in range(67) for s in ("a", "b")] + [(i, "", 0) for i in range(67, 100)] + [(1000, "", 0)])
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    table_side = plan[plan.index("FileScan") - 400 :] if "FileScan" in plan else plan[plan.index("Scan parquet") - 400 :]
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(entity_token") <= 1, table_side
    assert online.attach(spark, "online_again", str(tmp_path / "online"), "entity_token string, feature_set string, version int", 8).count() == 400
    spark.sql("DROP TABLE online_test")
    spark.sql("DROP TABLE online_again")
