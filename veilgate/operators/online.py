"""The online feature table: newest values in buckets of their entity, so that lookups shuffle the requests alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Buckets of the table; a bucket should hold some hundred megabytes.
BUCKETS = 64


def store(features: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Write ``features(entity_token, feature_set, ...)`` as the table ``name`` below ``path``, one file per bucket, sorted.

    Rows of one entity lie together; there are as many as feature sets, so no bucket grows with a hot entity.
    """
    dealt = features.repartition(buckets, "entity_token")
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, "entity_token").sortBy("entity_token", "feature_set").saveAsTable(name)


def attach(spark: SparkSession, name: str, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The stored table in a session that does not know it yet."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet "
        f"CLUSTERED BY (entity_token) SORTED BY (entity_token, feature_set) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def lookup(requests: DataFrame, online: DataFrame) -> DataFrame:
    """Every request with the stored values of its ``entity_token``, or with nulls.

    The table is read bucket by bucket in its own partitioning; only the requests are exchanged.
    """
    return requests.join(online.hint("merge"), "entity_token", "left")
