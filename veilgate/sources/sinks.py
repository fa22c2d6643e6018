"""Writers. The audit log and lineage log can only be appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.operators.features import with_expiry
from veilgate.session import settle


def exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def append_audit(events: DataFrame, path: str, fmt: str = "parquet", batch: int | None = None) -> None:
    """Append events, partitioned by day. There is deliberately no way to update or delete.

    A numbered batch (of a stream) has folders of its own below each day; writing it again after a failure
    replaces just those, so its events are never stored twice.
    """
    dated = events.withColumn("event_date", F.to_date("timestamp"))
    if batch is None:
        dated.write.mode("append").partitionBy("event_date").format(fmt).save(path)
        return
    numbered = dated.withColumn("batch", F.lit(batch).cast("long"))
    (
        numbered.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "batch")
        .format(fmt)
        .save(path)
    )


def append_lineage(events: DataFrame, path: str) -> None:
    """Append lineage events as JSON lines."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def absent_rows(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The first row per key among those whose key is not stored yet."""
    others = [c for c in rows.columns if c not in keys]
    if others:
        first = F.min(F.struct(*others)).alias("_row")
        single = rows.groupBy(*keys).agg(first).select(*keys, "_row.*")
    else:
        single = rows.distinct()
    return single.join(stored.select(*keys), keys, "left_anti").select(*rows.columns)


def insert_if_absent(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Append only rows whose key is new; existing rows are left as they are."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = absent_rows(rows, spark.read.schema(rows.schema).parquet(path), keys)
    else:
        rows = absent_rows(rows, rows.limit(0), keys)
    rows.write.mode("append").parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """Append feature values that expire 24 hours after they were computed."""
    with_expiry(features).write.mode("append").parquet(path)


def write_shielded(shielded: DataFrame, safe_path: str, quarantine_path: str, text: str) -> None:
    """Safe rows and blocked rows go to separate tables; the safe table holds no original text.

    The shielded rows are written once below the shared folder, so the shield runs once for both tables.
    """
    shielded = settle(shielded, "shielded")
    private = [c for c in (text, "detections", "token_map") if c in shielded.columns]
    shielded.where(F.col("status") == "ok").drop(*private).write.mode("append").parquet(safe_path)
    (
        shielded.where(F.col("status") == "blocked")
        .drop(*private, "safe_text")
        .write.mode("append")
        .parquet(quarantine_path)
    )


def write_vault(vault: DataFrame, path: str) -> None:
    """Token vault, stored apart from every safe table; a token with two originals has two entries."""
    insert_if_absent(vault, path, ["token", "original"])
