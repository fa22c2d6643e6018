"""Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgate.functions.rules import RuleSet
from veilgate.operators.features import latest_features, with_expiry
from veilgate.operators.keyed import latest_per_key
from veilgate.operators.shield import shield
from veilgate.sources.sinks import append_audit
from veilgate.streaming import outbox


def shield_stream(stream: DataFrame, text: str, rules: RuleSet, role: str | None = None) -> DataFrame:
    """The shield is a projection, so a stream is protected by the same expressions."""
    return shield(stream, text, rules, role)


def calls_per_window(
    stream: DataFrame, time: str, keys: list[str], width: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Calls per tumbling window and key.

    In append and update mode rows that come after the watermark has passed their window are dropped; in
    complete mode no row is late and all windows stay in the state.
    """
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(F.col("w.start").alias("window_start"), *keys, "calls")
    )


def metrics_per_window(
    stream: DataFrame, time: str, is_error: Column, width: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    share = lambda condition: F.avg(F.when(condition, 1.0).otherwise(0.0))
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("calls"),
            share(is_error).alias("error_rate"),
            share(F.col("pii_detected")).alias("pii_rate"),
            share(F.col("event_type") == "PROMPT_BLOCKED").alias("blocked_rate"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            "calls",
            "error_rate",
            "pii_rate",
            "blocked_rate",
        )
    )


def sessions_by_gap(
    stream: DataFrame, time: str, key: str, gap: str = "6 hours", delay: str = "1 hour"
) -> DataFrame:
    """Activity periods of a key, closed by a gap of silence."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("calls"), F.count_if("pii_detected").alias("pii_events"))
        .select(
            key,
            F.col("w.start").alias("started"),
            F.col("w.end").alias("ended"),
            "calls",
            "pii_events",
        )
    )


def without_duplicates(
    stream: DataFrame, time: str, key: str = "event_id", delay: str = "1 hour"
) -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def finished(query) -> None:
    """Wait until a stream has processed all there is; a failed stream raises its error."""
    query.awaitTermination()


def run_available(
    stream: DataFrame, path: str, mode: str = "append", keys: list[str] | None = None
) -> DataFrame:
    """Process everything available into a table and return it.

    Append results use the file sink. Complete results replace the table in each batch. Update results
    are stored per batch and folded on reading: of each of the ``keys`` the newest version counts. The
    state lives next to the table, so calling again with the same path goes on with what has arrived since.
    """
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True)
    )
    if mode == "append":
        query = writer.format("parquet").start(f"{path}-rows")
    elif mode == "update" and not keys:
        raise ValueError("update results need the keys their versions are folded by")
    else:

        def keep(batch: DataFrame, number: int) -> None:
            target = f"{path}-rows/batch={number}" if mode == "update" else f"{path}-rows"
            batch.write.mode("overwrite").parquet(target)

        query = writer.foreachBatch(keep).start()
    finished(query)
    spark = stream.sparkSession
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{path}-rows")
    stored = spark.read.schema(stream.schema.add("batch", "long")).option("basePath", f"{path}-rows")
    versions = stored.parquet(f"{path}-rows/batch=*")
    return latest_per_key(versions, keys, ["batch"]).drop("batch")


def audit_stream(
    stream: DataFrame, path: str, state: str, callback: Callable[[dict], None] | None = None, slice_rows: int = 1
):
    """Append each batch to the audit log and hand its CRITICAL events to the callback, each once (see ``outbox``).

    A batch that runs again replaces its own rows; the outbox beside the log knows what it has delivered before.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_audit(batch, path, batch=number)
        if callback is not None:
            outbox.deliver(batch, f"{path}-outbox", number, callback, slice_rows)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def upsert_features(stream: DataFrame, path: str, state: str, tie_break: str = "source"):
    """Last write wins per (token, set) without rewriting the table.

    Each batch adds its newest row per key in a folder of its own; readers take the newest row
    over all folders. A batch that runs again after a failure overwrites its own folder only.
    """

    def add(batch: DataFrame, number: int) -> None:
        newest = latest_features(with_expiry(batch.drop("expires_at")), tie_break)
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def read_upserted(spark: SparkSession, path: str, tie_break: str = "source") -> DataFrame:
    """The current row per (token, set) over all batches."""
    stored = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    return latest_features(stored, tie_break)


def compact_features(spark: SparkSession, path: str, target: str, tie_break: str = "source") -> None:
    """Rewrite an upserted table as one batch in a new place, to be done now and then."""
    read_upserted(spark, path, tie_break).write.mode("overwrite").parquet(f"{target}/batch=0")
