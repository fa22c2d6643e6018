"""Erasure on stored tables: rows, files left alone, and files that are gone."""

import os

from veilgate.operators import erasure as E

FIELDS = "who string, n long"


def test_only_files_with_the_entity_are_rewritten(spark, tmp_path):
    table = str(tmp_path / "table")
    assert E.read(spark, table, FIELDS).count() == 0
    for k in range(4):
        rows = [(f"p{k}", i) for i in range(5)] + [(None, k)] + ([("hot", k)] if k % 2 else [])
        E.append(spark.createDataFrame(rows, FIELDS).coalesce(1), table)
    before = {f: os.stat(f.removeprefix("file:")).st_mtime_ns for f in E.files(spark, table)}
    gone = spark.createDataFrame([("hot",), ("p0",), ("nobody",), (None,)], "who string")
    assert E.erase_stored(spark, table, FIELDS, gone, "who") == 3
    after = E.files(spark, table)
    same = [f for f in after if f in before]
    assert len(same) == 1 and os.stat(same[0].removeprefix("file:")).st_mtime_ns == before[same[0]]
    assert not any(os.path.exists(f.removeprefix("file:")) for f in before if f not in same)
    left = sorted(((r.who or "", r.n) for r in E.read(spark, table, FIELDS).collect()))
    assert left == sorted([(f"p{k}", i) for k in (1, 2, 3) for i in range(5)] + [("", k) for k in range(4)])
    assert E.erase_stored(spark, table, FIELDS, gone, "who") == 0 and E.files(spark, table) == after
    everyone = spark.createDataFrame([(f"p{k}",) for k in range(4)], "who string")
    assert E.erase_stored(spark, table, FIELDS, everyone, "who") > 0
    assert {r.who for r in E.read(spark, table, FIELDS).collect()} == {None}
