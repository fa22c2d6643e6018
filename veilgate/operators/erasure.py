"""Erasure on stored tables: only the files that hold an entity are rewritten, and a manifest switches to them.

A table is a folder with data files and manifests; the newest manifest lists the files that are the table. Readers see either
all of an erasure or nothing of it. The files that held the entities are removed once the switch is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgate.operators.keyed import lookup_join
from veilgate.sources.sinks import exists


def _system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def _manifests(spark: SparkSession, table: str) -> list[str]:
    """Paths of the manifests, oldest first."""
    if not exists(spark, f"{table}/manifests"):
        return []
    system, folder = _system(spark, f"{table}/manifests")
    return sorted(s.getPath().toString() for s in system.listStatus(folder) if s.getPath().getName().startswith("v"))


def files(spark: SparkSession, table: str) -> list[str]:
    """The data files of the table."""
    known = _manifests(spark, table)
    return sorted(r.value for r in spark.read.text(known[-1]).collect()) if known else []


def read(spark: SparkSession, table: str, schema: T.StructType | str) -> DataFrame:
    """The rows of the table; its files must have been written with this schema."""
    known = files(spark, table)
    return spark.read.schema(schema).parquet(*known) if known else spark.createDataFrame([], schema)


def _switch(spark: SparkSession, table: str, now: list[str]) -> None:
    """Make ``now`` the files of the table. The manifest is renamed into place when it is whole; a second writer of the
    same version fails."""
    number = len(_manifests(spark, table))
    hidden, place = f"{table}/manifests/.v{number:08d}", f"{table}/manifests/v{number:08d}"
    system, target = _system(spark, place)
    _, source = _system(spark, hidden)
    out = system.create(source, True)
    out.write(bytearray("\n".join(now).encode()))
    out.close()
    if not system.rename(source, target):
        raise RuntimeError(f"another change of {table} came first")


def _write(rows: DataFrame, table: str, number: int) -> list[str]:
    spark = rows.sparkSession
    folder = f"{table}/data/{number:08d}"
    rows.write.mode("overwrite").parquet(folder)  # what an attempt that failed before its switch has left is replaced
    system, location = _system(spark, folder)
    return [s.getPath().toString() for s in system.listStatus(location) if s.getPath().getName().endswith(".parquet")]


def append(rows: DataFrame, table: str) -> None:
    """Add rows to the table, in files of their own."""
    spark = rows.sparkSession
    _switch(spark, table, files(spark, table) + _write(rows, table, len(_manifests(spark, table))))


def erase_stored(spark: SparkSession, table: str, schema: T.StructType | str, entities: DataFrame, key: str) -> int:
    """Remove all rows of the listed entities from the stored table; how many files held any.

    One scan of the key column finds the files; only those are read in full and rewritten, the others keep their names
    and times. Rows without a key stay. The old files are deleted, since they hold what was to be erased.
    """
    gone = entities.select(key).where(F.col(key).isNotNull()).distinct()
    rows = read(spark, table, schema).select(key, F.col("_metadata.file_path").alias("_file")) if files(spark, table) else None
    if rows is None:
        return 0
    held = [r["_file"] for r in lookup_join(rows, gone, [key], "left_semi", spread=["_file"]).select("_file").distinct().collect()]
    if not held:
        return 0
    names = {_plain(spark, f): f for f in files(spark, table)}
    old = [names[_plain(spark, f)] for f in held]
    kept = lookup_join(spark.read.schema(schema).parquet(*old), gone, [key], "left_anti")
    fresh = _write(kept.select(*T.StructType.fromDDL(schema).names) if isinstance(schema, str) else kept.select(*schema.names), table, len(_manifests(spark, table)))
    _switch(spark, table, [f for f in names.values() if f not in set(old)] + fresh)
    for path in old:
        system, location = _system(spark, path)
        system.delete(location, False)
    return len(old)


def _plain(spark: SparkSession, path: str) -> str:
    """A path without its scheme, as it is written in different places."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
