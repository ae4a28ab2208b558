"""Curation and alerts over streams.

Windows that forget what they suppressed keep a state per key, which may start from a ledger, and
expire with event time.  Whatever must happen once goes through `foreachBatch`: output first,
then the ledger, both keyed, so a batch that is run again adds nothing.  `emit` is given the
batch's number; an output that is keyed by it (see `to_folder`) is written over by a batch
that is run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedsieve.functions import vocab as V
from feedsieve.functions.keys import subject_key
from feedsieve.operators import calendar as A
from feedsieve.operators import curate as C
from feedsieve.sources import ledgers

Emit = Callable[[DataFrame, int], None]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AcceptWindow(StatefulProcessor):
    """Accepts a row if fewer than `most` rows were accepted within the window before it.

    A key's state goes when the watermark has passed its last accepted row by the window.
    """

    def __init__(self, key: str, time: str, window: int, most: int, strict: bool, columns: list[str]):
        self.key, self.time, self.window, self.most, self.strict, self.columns = key, time, window, most, strict, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "times array<long>")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Starts with a key's accepted times before the stream."""
        times = sorted(int(t) for t in initialState[self.time])
        self.accepted.update((times,))
        self.handle.registerTimer((max(times) + self.window + 1) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.accepted.get()
        times = [int(t) for t in held[0]] if held else []
        batch = pd.concat(list(rows)).sort_values([self.time, *[c for c in ("rank", "arrival") if c in self.columns]])
        flags = []
        for t in batch[self.time].tolist():
            times = [x for x in times if (t - x < self.window if self.strict else t - x <= self.window)]
            flags.append(len(times) < self.most)
            if flags[-1]:
                times.append(t)
        self.accepted.update((times,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((max(times, default=0) + self.window + 1) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield batch[self.columns].assign(accepted=flags)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass


def _windowed(stream: DataFrame, key: str, time: str, window: int, most: int, strict: bool, late_hours: int, earlier: DataFrame | None) -> DataFrame:
    """Rows that come later than `late_hours` after the newest one are left out, as the age filter would do.

    earlier: rows that were accepted before the stream began (the key and time columns), as from a
    ledger; read once, when the stream starts without a checkpoint.
    """
    schema = ", ".join(f"{c} {t}" for c, t in stream.dtypes) + ", accepted boolean"
    worker = AcceptWindow(key, time, window, most, strict, stream.columns)
    timed = stream.withColumn("_at", F.timestamp_seconds(F.col(time))).withWatermark("_at", f"{late_hours} hours")
    start = None if earlier is None else earlier.select(key, time).groupBy(key)
    return timed.groupBy(key).transformWithStateInPandas(worker, schema, "Append", "eventTime", start)


def stream_story_dedup(stream: DataFrame, hours: int = V.STORY_HOURS, time: str = "cycle_s", late_hours: int = V.MAX_AGE_HOURS, earlier: DataFrame | None = None) -> DataFrame:
    return _windowed(stream, "story_key", time, hours * 3600, 1, False, late_hours, earlier)


def stream_subject_cap(stream: DataFrame, hours: int = V.SUBJECT_HOURS, most: int = V.SUBJECT_MAX, time: str = "cycle_s", late_hours: int = V.MAX_AGE_HOURS, earlier: DataFrame | None = None) -> DataFrame:
    return _windowed(stream, "subject_key", time, hours * 3600, most, True, late_hours, earlier)


def to_folder(path: str) -> Emit:
    """An output for `emit`: the rows of each batch in a folder of their own, which a batch that is run again writes over."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _cycles(stream: DataFrame, cycle_seconds: int, late_hours: int) -> DataFrame:
    return stream.withColumn("_at", F.timestamp_seconds("observed_s")).withWatermark("_at", f"{late_hours} hours")


def stream_funnel(stream: DataFrame, cycle_seconds: int = V.CYCLE_SECONDS, late_hours: int = V.MAX_AGE_HOURS) -> DataFrame:
    """Counters of each cycle over a stream of items, for update output; equal to `curate.funnel` however the stream is split.

    A cycle's state goes when the watermark has passed it.
    """
    rows = C.judged(_cycles(stream, cycle_seconds, late_hours), cycle_seconds)
    by_cycle = rows.groupBy(F.window("_at", f"{cycle_seconds} seconds"), "cycle_s")
    return by_cycle.agg(*[c.alias(k) for k, c in C.gate_counts().items()]).drop("window")


def stream_source_counts(stream: DataFrame, cycle_seconds: int = V.CYCLE_SECONDS, late_hours: int = V.MAX_AGE_HOURS) -> DataFrame:
    """Items of each cycle and source over a stream, for update output."""
    rows = _cycles(stream, cycle_seconds, late_hours).withColumn("cycle_s", C.cycle_start(F.col("observed_s"), cycle_seconds))
    return rows.groupBy(F.window("_at", f"{cycle_seconds} seconds"), "cycle_s", "source_id").agg(F.count(F.lit(1)).alias("n")).drop("window")


def recent_once(stream: DataFrame, hours: int = V.MAX_AGE_HOURS) -> DataFrame:
    """Each uid once in the recent past, for input that delivers every item once."""
    return stream.withWatermark("observed_at", f"{hours} hours").dropDuplicatesWithinWatermark(["uid"])


def curate_batch(ledger: str, rejected: str, emit: Emit, cycle_seconds: int = V.CYCLE_SECONDS, most: int = V.CYCLE_MAX, max_age: int = V.MAX_AGE_HOURS) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: judges a batch, emits what is new, and marks it sent afterwards.

    Items rejected for age or history go to a ledger of their own and are not judged again; low
    scores are not marked.  Emission comes before the ledger, so a failure is tried again.  The
    story and subject windows and the cycle's cap go on from the sent ledger.

    A batch reads the ledgers' days from its oldest item's age limit and longest window on: what is
    older cannot be delivered again within its age, and holds no window.
    """
    reach = 3600 * max(max_age, V.STORY_HOURS, V.SUBJECT_HOURS)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        oldest = batch.agg(F.min("observed_s")).first()[0]
        if oldest is None:
            batch.unpersist()
            return
        since = F.to_date(F.timestamp_seconds(F.lit(oldest - reach)))
        seen = ledgers.load_seen(spark, ledger, since).select("uid").union(ledgers.load_seen(spark, rejected, since).select("uid")).distinct()
        fresh = C.with_keys(batch).join(seen, "uid", "left_anti").persist()
        judged = C.judged(fresh, cycle_seconds, max_age=max_age)
        stale = judged.where(C.STALE)
        sent = ledgers.read(spark, ledger, ledgers.SENT, since).withColumn("subject_key", F.coalesce("subject_key", subject_key(F.col("title"))))
        sent = sent.withColumn("cycle_s", C.cycle_start(F.unix_seconds("sent_at"), cycle_seconds))
        chosen = C.curate_after(fresh.drop("uid", "story_key", "subject_key"), sent, most, cycle_seconds=cycle_seconds, max_age=max_age).persist()
        emit(chosen, batch_id)
        keys = ("uid", "story_key", "subject_key", "source_id", "title", "link")
        # a late item was sent in the cycle that it was judged in
        days = 1 + reach // 86400
        ledgers.append_sent(chosen.select(*keys, F.timestamp_seconds(F.greatest("observed_s", "cycle_s")).alias("sent_at")), ledger, days)
        ledgers.append_sent(stale.select(*keys, F.timestamp_seconds("observed_s").alias("sent_at")), rejected, days)
        for df in (chosen, fresh, batch):
            df.unpersist()

    return run


def stream_curate(stream: DataFrame, checkpoint: str, ledger: str, rejected: str, emit: Emit, available_now: bool = False, **how):
    """Starts the curation of a stream of items."""
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{V.CYCLE_SECONDS} seconds"}
    return stream.writeStream.foreachBatch(curate_batch(ledger, rejected, emit, **how)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


Calendar = DataFrame | Callable[[SparkSession], DataFrame]


def alert_batch(events: Calendar, ledger: str, emit: Emit, grace_minutes: int = V.GRACE_MINUTES) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function over ticks (tick_s): emits due alerts once and marks them fired afterwards.

    events: a calendar, or a function that reads it as it stands.  The latter is read anew for each
    batch, so an event that is moved, cancelled or added while the stream runs fires by its last state.
    """

    def run(ticks: DataFrame, batch_id: int) -> None:
        spark = ticks.sparkSession
        now = events(spark) if callable(events) else events
        oldest = ticks.agg(F.min("tick_s")).first()[0]
        # an alert that is due was fired within the grace before, or not at all
        since = None if oldest is None else F.to_date(F.timestamp_seconds(F.lit(oldest - grace_minutes * 60)))
        fired = ledgers.read(spark, ledger, ledgers.FIRED, since)
        new = A.render_alert(A.unfired(A.due_alerts(now, ticks.select("tick_s").distinct(), grace_minutes), fired)).persist()
        emit(new, batch_id)
        ledgers.mark_alerts_fired(new.withColumn("fired_at", F.timestamp_seconds("tick_s")), ledger)
        new.unpersist()

    return run


def ticks(spark: SparkSession, seconds: int = V.TICK_SECONDS) -> DataFrame:
    """A stream of ticks (tick_s), one every so many seconds."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return rate.select(F.unix_seconds("timestamp").alias("tick_s")).where(F.col("tick_s") % seconds == 0)


def stream_alerts(ticking: DataFrame, events: Calendar, checkpoint: str, ledger: str, emit: Emit, available_now: bool = False, grace_minutes: int = V.GRACE_MINUTES):
    """Starts the alerts of a calendar over a stream of ticks."""
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{V.TICK_SECONDS} seconds"}
    return ticking.writeStream.foreachBatch(alert_batch(events, ledger, emit, grace_minutes)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
