"""Suppression that ends by itself: a stream of engagements with a timer for each entity."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.buckets import BucketTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Until(StatefulProcessor):
    """Keeps an entity's last engagement (in ms) until its days are over."""

    def __init__(self, entity: str, days: int):
        self.entity, self.span = entity, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def _row(self, key: tuple, last: int, suppressed: bool) -> Row:
        return Row(**{self.entity: key[0], "last_ms": last, "suppressed": suppressed})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest, known = max(r["at_ms"] for r in rows), self.last.get()
        if known is not None:
            if known[0] >= newest:
                return
            self.handle.deleteTimer(known[0] + self.span + 1)  # the only one that this entity has
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.span + 1)
        yield self._row(key, newest, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last = self.last.get()[0]
        self.last.clear()
        yield self._row(key, last, False)

    def close(self) -> None:
        pass


def suppress_stream(spark: SparkSession, events: DataFrame, folder: str, *, days: int = 60, late: str = "0 seconds", entity: str = "nces_id", buckets: int = 64) -> DataFrame:
    """Processes the engagements that have arrived; returns the entities that are suppressed now, with last_ms of their last engagement.

    ``events`` is a stream with the entity and happened_at.  'Now' is the
    stream's watermark: the newest engagement less ``late``, and older ones that
    come after it don't count.  An entity is suppressed from an engagement on
    until ``days`` days later, as in ``search.suppress`` with that time; then its
    timer frees it, though nothing about it arrives.  State is one number for
    each suppressed entity, and goes with the timer.  Null entities and null
    times are left out.

    The result is kept in a table of buckets below ``folder``, whose checkpoint
    lets a restart go on.
    """
    rows = events.where(F.col(entity).isNotNull() & F.col("happened_at").isNotNull()).select(entity, "happened_at").withWatermark("happened_at", late)
    kind = rows.schema[entity].dataType.simpleString()
    changed = rows.withColumn("at_ms", F.unix_millis("happened_at")).groupBy(entity)
    schema = StructType.fromDDL(f"`{entity}` {kind}, last_ms long, suppressed boolean")
    changed = changed.transformWithState(statefulProcessor=_Until(entity, days), outputStructType=schema, outputMode="Update", timeMode="eventtime")
    table = BucketTable(spark, f"{folder}/table", schema, [entity], buckets)

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        r = F.max_by(F.struct(*schema.names), F.struct("last_ms", ~F.col("suppressed"))).alias("r")
        return old.unionByName(new).groupBy(entity).agg(r).select("r.*")

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # state with timers needs it
    try:
        query = changed.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, number, newest)).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
    return table.read().where("suppressed").select(entity, "last_ms")
