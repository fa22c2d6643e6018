"""Escalations that are delivered once: an outbox of what is pending, claimed, delivered and failed.

A batch first stores its pending events under its number, so a repeated batch replaces its own. What has an outcome is
taken out by an anti join. The tasks then claim a slice of events in a file of its own, call the receiver and store
the outcome. A task or batch that runs again finds the claims of the first try: what has an outcome is skipped, and what
was claimed without one was under way when its task died. It is reported as ``unsure`` and not delivered again by itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from veilgate.operators.audit import critical
from veilgate.sources.sinks import exists

OUTCOMES = "event_id string, status string, error string, attempt int"


def _stored(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    if not exists(spark, f"{folder}/{kind}"):
        return spark.createDataFrame([], OUTCOMES)
    return spark.read.schema(OUTCOMES).json(f"{folder}/{kind}")


def deliver(events: DataFrame, folder: str, batch: int, callback: Callable[[dict], None], slice_rows: int = 1) -> None:
    """Hand the CRITICAL ``events`` of a batch to a receiver, each ``event_id`` once, however often the batch runs.

    ``slice_rows`` events share a claim and an outcome file; a task that dies leaves at most one slice unsure. An error
    of the receiver is stored as ``failed`` and tried again by ``retry`` only. Batches run one after another.
    """
    spark = events.sparkSession
    place = f"{folder}/pending/batch={batch}"
    critical(events).dropDuplicates(["event_id"]).write.mode("overwrite").parquet(place)
    _settle_claims(spark, folder)
    done = _stored(spark, folder, "outcomes").select("event_id").distinct()
    _hand_over(spark.read.parquet(place).join(done, "event_id", "left_anti"), folder, callback, slice_rows, 0)


def _settle_claims(spark: SparkSession, folder: str) -> None:
    """Claims that an earlier run left without an outcome become ``unsure``."""
    left = _stored(spark, folder, "claims").join(_stored(spark, folder, "outcomes").select("event_id", "attempt"), ["event_id", "attempt"], "left_anti")
    unsure = left.select("event_id", F.lit("unsure").alias("status"), F.lit("the task ended while it delivered").alias("error"), "attempt")
    if not unsure.isEmpty():
        unsure.write.mode("append").json(f"{folder}/outcomes")


def _hand_over(rows: DataFrame, folder: str, callback: Callable[[dict], None], slice_rows: int, attempt: int) -> None:
    def run(part: Iterator[Row]) -> None:
        system, base = fs.FileSystem.from_uri(folder)
        waiting: list[dict] = []
        for row in part:
            waiting.append(row.asDict(recursive=True))
            if len(waiting) == slice_rows:
                one_slice(system, base, waiting)
                waiting = []
        if waiting:
            one_slice(system, base, waiting)

    def one_slice(system: fs.FileSystem, base: str, events: list[dict]) -> None:
        ids = [e["event_id"] for e in events]
        name = hashlib.sha256(json.dumps([attempt, *ids]).encode()).hexdigest()
        if exists_in(system, f"{base}/outcomes/{name}.json"):
            return
        if exists_in(system, f"{base}/claims/{name}.json"):
            store(system, f"{base}/outcomes", name, [(i, "unsure", "the task ended while it delivered") for i in ids])
            return
        store(system, f"{base}/claims", name, [(i, "claimed", None) for i in ids])
        results = []
        for event in events:
            try:
                callback(event)
                results.append((event["event_id"], "delivered", None))
            except Exception as failure:  # noqa: BLE001 - a failing receiver must not stop the audit
                results.append((event["event_id"], "failed", str(failure)))
        store(system, f"{base}/outcomes", name, results)

    def exists_in(system: fs.FileSystem, path: str) -> bool:
        return system.get_file_info(path).type != fs.FileType.NotFound

    def store(system: fs.FileSystem, place: str, name: str, results: list[tuple]) -> None:
        system.create_dir(place, recursive=True)
        lines = [json.dumps({"event_id": i, "status": s, "error": e, "attempt": attempt}) for i, s, e in results]
        with system.open_output_stream(f"{place}/.{name}") as out:  # whole or not there
            out.write("\n".join(lines).encode())
        system.move(f"{place}/.{name}", f"{place}/{name}.json")

    # the same rows make the same slices when a task runs again
    rows.repartition("event_id").sortWithinPartitions("event_id").foreachPartition(run)


def status(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, status, attempts, error) of every event that was ever pending: delivered, failed, unsure or pending."""
    if not exists(spark, f"{folder}/pending"):
        return spark.createDataFrame([], "event_id string, status string, attempts long, error string")
    pending = spark.read.option("basePath", f"{folder}/pending").parquet(f"{folder}/pending/batch=*").select("event_id").distinct()
    tries = _stored(spark, folder, "outcomes").groupBy("event_id").agg(
        F.max_by(F.struct("status", "error"), "attempt").alias("last"), F.count(F.lit(1)).alias("attempts")
    )
    return pending.join(tries, "event_id", "left").select(
        "event_id", F.coalesce("last.status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.col("last.error").alias("error")
    )


def retry(spark: SparkSession, folder: str, callback: Callable[[dict], None], slice_rows: int = 1, also_unsure: bool = False) -> None:
    """Deliver again what failed, and what is unsure if the receiver can tell repeats apart by ``event_id``."""
    wanted = ["failed", "unsure"] if also_unsure else ["failed"]
    _settle_claims(spark, folder)
    open_ones = status(spark, folder).where(F.col("status").isin(*wanted)).select("event_id", "attempts")
    pending = spark.read.option("basePath", f"{folder}/pending").parquet(f"{folder}/pending/batch=*").drop("batch").dropDuplicates(["event_id"])
    attempts = [r.attempts for r in open_ones.select("attempts").distinct().collect()]
    for attempt in sorted(attempts):  # events of one number of attempts go together
        mine = pending.join(open_ones.where(F.col("attempts") == attempt).select("event_id"), "event_id", "left_semi")
        _hand_over(mine, folder, callback, slice_rows, int(attempt))
