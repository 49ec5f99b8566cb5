"""Progress guard and wave fold over streams (T-1, T-3, T-4, W13): the rows that the batch forms give, however the events
are cut into micro-batches and wherever the query is stopped and started again.

A key's events wait in its state until the watermark has passed them; a timer of event time then hands them on in order.
So events may come in any order within ``delay``; Spark drops those that come later still, as it does for every
watermark, and so is what is not later than the epoch, where watermarks start. What is kept of a key beside its waiting events has a fixed size for the guard, and the wave's own size for the
fold.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assay.operators.coordination import RELEASE_AFTER, Wave

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Events of a key, each with the microsecond ``at`` and its number ``seq``, in this order and once the watermark passed."""

    waiting: dict[str, str]
    kept_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", ", ".join(f"{name} {kind}" for name, kind in self.waiting.items()))
        self.kept = handle.getValueState("kept", self.kept_schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(row[name] for name in self.waiting) for row in rows]
        if new:
            self.held.appendList(new)  # one call to the store for a key's rows, not one for each
            self.handle.registerTimer(-(-max(x[0] for x in new) // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, left = [], []
        for row in self.held.get():
            (ready if row[0] <= passed else left).append(row)
        if ready:
            if left:
                self.held.put([tuple(x) for x in left])
            else:
                self.held.clear()
            yield from self.steps(key, sorted(ready, key=lambda x: (x[0], x[1])))

    def steps(self, key, rows: list) -> Iterator[Row]:
        raise NotImplementedError


class Guard(InOrder):
    waiting = {"at": "long", "seq": "long", "state": "string"}
    kept_schema = "state string, blocks long"

    def steps(self, key, rows):
        state, blocks = self.kept.get() if self.kept.exists() else (None, 0)
        for _, seq, now in rows:
            # the first event, and each change, begins a run; a null state differs from all, itself included
            blocks = blocks + 1 if blocks and now is not None and now == state else 1
            state = now
            yield Row(session=key[0], seq=seq, state=now, blocks=blocks, released=blocks > RELEASE_AFTER)
        self.kept.update((state, blocks))


class Fold(InOrder):
    waiting = {"at": "long", "seq": "long", "action": "string", "leaves": "array<string>", "leaf": "string", "handle": "string", "reason": "string"}
    kept_schema = "state string, leaves array<string>, handles array<string>, started array<string>, returned array<string>"

    def steps(self, key, rows):
        wave = Wave()
        if self.kept.exists():
            wave.state, leaves, *some = self.kept.get()
            wave.leaves = tuple(leaves)
            wave.handles, wave.started, wave.returned = map(set, some)
        for _, seq, action, leaves, leaf, handle, reason in rows:
            refused = wave.step(action, leaves, leaf, handle, reason)
            yield Row(wave=key[0], seq=seq, action=action, refused=refused, state=wave.state, started=len(wave.started), returned=len(wave.returned))
        self.kept.update((wave.state, list(wave.leaves), sorted(wave.handles), sorted(wave.started), sorted(wave.returned)))


def block_runs(events: DataFrame, session: str, time: str, seq: str, state: Column, delay: str) -> DataFrame:
    """coordination.block_runs over a stream in the order of ``time`` and ``seq``: session, seq, state, blocks, released."""
    rows = events.withWatermark(time, delay).select(F.col(session).cast("string").alias("session"), F.unix_micros(time).alias("at"), F.col(seq).cast("long").alias("seq"), state.alias("state"), F.col(time).alias("__time"))
    return rows.groupBy("session").transformWithState(Guard(), "session string, seq long, state string, blocks long, released boolean", "Append", "EventTime")


def fold_waves(events: DataFrame, time: str, delay: str) -> DataFrame:
    """coordination.fold_waves over a stream of EVENT and ``time``, whose order must be that of seq in a wave."""
    given = [name for name in Fold.waiting if name != "at"]
    rows = events.withWatermark(time, delay).select("wave", F.unix_micros(time).alias("at"), *given, F.col(time).alias("__time"))
    return rows.groupBy("wave").transformWithState(Fold(), "wave string, seq long, action string, refused string, state string, started long, returned long", "Append", "EventTime")


@contextlib.contextmanager
def state_store(spark):
    """The state store that transformWithState needs, for queries that are started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there now; its rows so far, with what earlier runs with this folder gave."""
    spark = stream.sparkSession
    with state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
