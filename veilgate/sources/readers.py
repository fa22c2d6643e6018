"""Readers of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.operators.corpus import visible
from veilgate.operators.features import latest_features, point_in_time
from veilgate.sources import schemas


def read_chunks(spark: SparkSession, path: str, row_security: bool = True) -> DataFrame:
    """The chunk corpus (partitioned by domain); restricted and inactive rows never leave it."""
    stored = spark.read.schema(schemas.CHUNKS).parquet(path)
    return visible(stored) if row_security else stored


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DOCUMENTS).parquet(path)


def read_online_features(spark: SparkSession, path: str) -> DataFrame:
    """Current feature values: the newest row per (entity token, feature set)."""
    stored = spark.read.schema(schemas.ONLINE_FEATURES).parquet(path)
    return latest_features(stored, tie_break="source")


def read_features_at(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """Feature values as they were known at each request's ``event_ts``."""
    stored = spark.read.schema(schemas.ONLINE_FEATURES).parquet(path)
    return point_in_time(requests, stored, tie_break="source")


def read_audit(spark: SparkSession, path: str, start: str = "", end: str = "") -> DataFrame:
    """The audit log; a time window is turned into partition pruning on ``event_date``."""
    log = spark.read.schema(schemas.AUDIT).parquet(path)
    if start:
        log = log.where(F.col("event_date") >= F.to_date(F.lit(start)))
    if end:
        log = log.where(F.col("event_date") <= F.to_date(F.lit(end)))
    return log


def read_audit_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIT).json(path)


def stream_table(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """A file-backed stream over a table folder."""
    return spark.readStream.schema(schema).format(fmt).load(path)


def stream_feature_changes(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Feature changes from a Kafka topic of JSON records (needs the Kafka connector)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    record = F.from_json(F.col("value").cast("string"), schemas.ONLINE_FEATURES)
    return raw.select(record.alias("r")).select("r.*")
