"""Feature values with a lifetime, kept in the state of a stream: event-time timers end what is not renewed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LIFETIME_HOURS = 24
CHANGES = "entity_token string, feature_set string, action string, at long, version long"


class Lifetimes(StatefulProcessor):
    """The newest value per key. A value that is not renewed within its lifetime expires and leaves the state."""

    def __init__(self, lifetime: int):
        self.lifetime = lifetime  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "at long, version long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = tuple(self.current.get()) if self.current.exists() else None
        before, out = now, []
        for one in sorted((r.at, r.version) for r in rows):
            if now is not None and one[0] >= now[0] + self.lifetime:
                out.append(self._row(key, "expired", now))
                now = None
            if now is not None and one <= now:
                continue  # older than what is known, or seen before
            out.append(self._row(key, "inserted" if now is None else "updated", one))
            now = one
        if now != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.current.update(now)
            self.handle.registerTimer(-(-(now[0] + self.lifetime) // 1000))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.current.exists():
            now = tuple(self.current.get())
            self.current.clear()
            yield self._row(key, "expired", now)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, action: str, value: tuple[int, int]) -> Row:
        return Row(entity_token=key[0], feature_set=key[1], action=action, at=value[0], version=value[1])


def with_lifetimes(stream: DataFrame, hours: int = LIFETIME_HOURS, delay: str = "1 hour") -> DataFrame:
    """Changes of feature values: one row per value that is ``inserted``, ``updated`` or ``expired``.

    ``stream(entity_token, feature_set, as_of timestamp, version long)``. A value older than the one known, or equal to
    it, changes nothing; one that comes when the known one has outlived ``hours`` is inserted anew. What nothing follows
    expires when the watermark (``delay`` behind the latest time) passes its end. Values of one key are taken in order of
    time within a batch, so the changes do not depend on how the stream is cut into batches. Rows later than the
    watermark are left out by the engine; a null time is an error of the source and is left out as well.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    given = stream.where(F.col("as_of").isNotNull()).select(
        "entity_token", "feature_set", "as_of", F.unix_micros("as_of").alias("at"), F.col("version").cast("long").alias("version")
    )
    lifetime = hours * 3_600_000_000
    changes = (
        given.withWatermark("as_of", delay)
        .groupBy("entity_token", "feature_set")
        .transformWithState(Lifetimes(lifetime), CHANGES, "append", "eventTime")
    )
    return changes.select(
        "entity_token",
        "feature_set",
        "action",
        F.timestamp_micros("at").alias("as_of"),
        "version",
        F.timestamp_micros(F.col("at") + lifetime).alias("expires_at"),
    )
