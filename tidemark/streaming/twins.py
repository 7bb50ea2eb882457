"""Structured Streaming twins of the event operators: the same functions serve streams and stored tables.

Events are (media_id, ts, ...); a watermark bounds how late they may come, and by it the state. On a finite stream the
results equal those of the stored table.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor


def with_time(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("media_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") / 500).alias("strength"))


def arriving(spark: SparkSession, folder: str, schema, late: str, files_at_once: int = 1) -> DataFrame:
    """The events of a folder's Parquet files as they arrive, up to late behind the newest."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return with_time(rows).withWatermark("ts", late)


def hopping_counts(events: DataFrame, width: str, hop: str) -> DataFrame:
    """(media_id, lo, hi, n): events in windows of width that begin every hop."""
    out = events.groupBy("media_id", F.window("ts", width, hop).alias("w")).agg(F.count("*").alias("n"))
    return out.select("media_id", F.col("w.start").alias("lo"), F.col("w.end").alias("hi"), "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(media_id, first, last, n): runs of events less than gap apart; an equal gap begins a new one."""
    out = events.groupBy("media_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return out.select("media_id", "first", "last", "n")


def _high(xs: list[float], share: float) -> float:
    """The share's percentile, linear between the values beside it."""
    xs, at = sorted(xs), share * (len(xs) - 1)
    lo = int(at)
    return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (at - lo)


def against_ring(events: DataFrame, silence: float, half: int = 15, share: float = 0.85) -> DataFrame:
    """(media_id, us, event_id, excess): an event's strength above the share's percentile of the ring of 2 * half + 1 events around it.

    events are (media_id, ts, event_id, strength); a gap of over silence seconds ends a run. A run's first half events
    are its warm-up and have no row, nor has a run that doesn't fill the ring; its last half events are held against
    its last ring. Equal times go by event_id. Rows with a null are ignored, as are those of an empty table.
    """
    size = 2 * half + 1
    rows = events.select("media_id", F.unix_micros("ts").alias("us"), "event_id", F.col("strength").cast("double").alias("strength")).dropna()
    order = W.partitionBy("media_id").orderBy("us", "event_id")
    begins = F.coalesce(F.col("us") - F.lag("us").over(order) > int(silence * 1e6), F.lit(False))
    rows = rows.withColumn("begins", begins).withColumn("run", F.count_if("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    of = W.partitionBy("media_id", "run").orderBy("us", "event_id")
    rows = rows.withColumns({"ring": F.collect_list(F.struct("us", "event_id", "strength")).over(of.rowsBetween(1 - size, 0)), "ends": F.lead("us").over(of).isNull()}).where(F.size("ring") == size)
    at = share * (size - 1)
    values = F.array_sort(F.transform("ring", lambda r: r["strength"]))
    lo, hi = F.get(values, F.lit(int(at))), F.get(values, F.lit(min(int(at) + 1, size - 1)))
    rows = rows.withColumn("high", lo + (hi - lo) * (at - int(at)))
    held = F.explode(F.when(F.col("ends"), F.slice("ring", half + 1, half + 1)).otherwise(F.slice("ring", half + 1, 1))).alias("e")
    return rows.select("media_id", held, "high").select("media_id", "e.us", "e.event_id", (F.col("e.strength") - F.col("high")).alias("excess"))


class _InOrder(StatefulProcessor):
    """Events wait until the watermark has passed them, then are taken by time and event_id; a timer ends a run that stays silent.

    A machine keeps rows of state for its run, the last of which begins with the last event's time. Events that come
    behind the watermark are ignored.
    """

    kept_as: str
    columns: list[str]

    def __init__(self, silence: float) -> None:
        self.silence = int(silence * 1e6)

    def take(self, key, kept: list[tuple], row: tuple, out: list[tuple]) -> list[tuple]:
        """The state after an event; what it says goes to out."""
        raise NotImplementedError

    def end(self, key, kept: list[tuple], out: list[tuple]) -> None:
        """What the end of a run says."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, strength double")
        self.kept = handle.getListState("kept", self.kept_as)

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = [(int(u), int(e), float(x)) for df in rows for u, e, x in zip(df.us, df.event_id, df.strength) if u > passed]
        if new:
            self.waiting.appendList(new)
            self._wake(min(new)[0], passed)
        return iter(())

    def _wake(self, us: int, passed: int) -> None:
        self.handle.registerTimer(max(us, passed) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        kept, later, out = [tuple(r) for r in self.kept.get()], [r for r in waiting if r[0] > passed], []
        for row in waiting[: len(waiting) - len(later)]:
            if kept and row[0] - kept[-1][0] > self.silence:
                self.end(key, kept, out)
                kept = []
            kept = self.take(key, kept, row, out)
        if kept and passed >= kept[-1][0] + self.silence:
            self.end(key, kept, out)
            kept = []
        self.waiting.put(later) if later else self.waiting.clear()
        self.kept.put(kept) if kept else self.kept.clear()
        if later:
            self._wake(later[0][0], passed)
        if kept:
            self._wake(kept[-1][0] + self.silence, passed)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class _Ring(_InOrder):
    kept_as = "us long, event_id long, strength double"
    columns = ["media_id", "us", "event_id", "excess"]

    def __init__(self, silence: float, half: int, share: float) -> None:
        super().__init__(silence)
        self.half, self.share = half, share

    def _held(self, key, ring: list[tuple], first: int, out: list[tuple]) -> None:
        if len(ring) == 2 * self.half + 1:
            high = _high([r[2] for r in ring], self.share)
            out.extend((key[0], u, e, x - high) for u, e, x in ring[first:])

    def take(self, key, kept, row, out):
        ring = [*kept, row][-2 * self.half - 1 :]
        held = []
        self._held(key, ring, self.half, held)
        out.extend(held[:1])
        return ring

    def end(self, key, kept, out):
        self._held(key, kept, self.half + 1, out)


class _Switch(_InOrder):
    kept_as = "us long, turned boolean"
    columns = ["media_id", "us", "turned"]

    def __init__(self, forget: float, lo: float, hi: float) -> None:
        super().__init__(forget)
        self.lo, self.hi = lo, hi

    def take(self, key, kept, row, out):
        was = kept[-1][1] if kept else False
        says = True if row[2] >= self.hi else False if row[2] < self.lo else was
        if says != was:
            out.append((key[0], row[0], says))
        return [(row[0], says)]


def _machine(events: DataFrame, machine: _InOrder, made: str) -> DataFrame:
    rows = events.select("media_id", "ts", F.unix_micros("ts").alias("us"), "event_id", F.col("strength").cast("double").alias("strength")).dropna()
    return rows.groupBy("media_id").transformWithStateInPandas(machine, made, "append", "EventTime")


def ring_stream(events: DataFrame, silence: float, half: int = 15, share: float = 0.85) -> DataFrame:
    """against_ring for a stream with a watermark on ts: the rows of the stored table but for events that came behind the watermark, which are ignored.

    State is the ring and what the watermark hasn't passed yet; a medium that falls silent leaves none. It needs the
    RocksDB state store.
    """
    return _machine(events, _Ring(silence, half, share), "media_id long, us long, event_id long, excess double")


def turns(events: DataFrame, lo: float, hi: float, forget: float) -> DataFrame:
    """(media_id, us, turned) whenever a medium turns on (strength >= hi) or off (< lo), in order of time and event_id.

    A medium begins off, and is off again, without a turn, after forget seconds without an event. Rows with a null
    are ignored.
    """
    if lo > hi:
        raise ValueError("lo must not be above hi")
    rows = events.select("media_id", F.unix_micros("ts").alias("us"), "event_id", F.col("strength").cast("double").alias("strength")).dropna()
    order = W.partitionBy("media_id").orderBy("us", "event_id")
    begins = F.coalesce(F.col("us") - F.lag("us").over(order) > int(forget * 1e6), F.lit(False))
    rows = rows.withColumn("begins", begins).withColumn("run", F.count_if("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    of = W.partitionBy("media_id", "run").orderBy("us", "event_id")
    says = F.when(F.col("strength") >= hi, True).when(F.col("strength") < lo, False)
    rows = rows.withColumn("turned", F.coalesce(F.last(says, ignorenulls=True).over(of.rowsBetween(W.unboundedPreceding, 0)), F.lit(False)))
    return rows.withColumn("was", F.lag("turned", 1, False).over(of)).where("turned <> was").select("media_id", "us", "turned")


def turns_stream(events: DataFrame, lo: float, hi: float, forget: float) -> DataFrame:
    """turns for a stream with a watermark on ts: those of the stored table but for events behind the watermark.

    State is one flag a medium and what the watermark hasn't passed yet; both end with the medium's silence. It needs
    the RocksDB state store.
    """
    if lo > hi:
        raise ValueError("lo must not be above hi")
    return _machine(events, _Switch(forget, lo, hi), "media_id long, us long, turned boolean")
