"""Clips (track_id, clip_id, src_in, src_out, speed, tl_start) on a film, samples of signals, windows over intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.intervals import binned


def clips(rallies: DataFrame) -> DataFrame:
    """Rallies as clips of their medium's track, a third of them at double speed."""
    speed = F.when(F.pmod("rally_id", F.lit(3)) == 0, 2.0).otherwise(1.0)
    return rallies.select(F.col("media_id").alias("track_id"), F.col("rally_id").alias("clip_id"), F.col("start").alias("src_in"), F.col("end").alias("src_out"), speed.alias("speed"), F.pmod("rally_id", F.lit(50)).cast("double").alias("tl_start"))


def length() -> Column:
    return (F.col("src_out") - F.col("src_in")) / F.greatest("speed", F.lit(1e-6))


def compacted(clips: DataFrame) -> DataFrame:
    """(track_id, clip_id, tl_start): clips without gaps, in their order."""
    before = W.partitionBy("track_id").orderBy("tl_start", "clip_id").rowsBetween(W.unboundedPreceding, -1)
    return clips.select("track_id", "clip_id", F.coalesce(F.sum(length()).over(before), F.lit(0.0)).alias("tl_start"))


def rippled(clips: DataFrame, gone: Column) -> DataFrame:
    """(track_id, clip_id, tl_start) of the clips that stay, earlier by the lengths of those removed before them."""
    rows = clips.withColumn("gone", gone)
    before = W.partitionBy("track_id").orderBy("tl_start").rangeBetween(W.unboundedPreceding, 0)
    same = W.partitionBy("track_id", "tl_start")
    off = F.when(F.col("gone"), length()).otherwise(0.0)
    rows = rows.withColumn("at", F.col("tl_start") - (F.sum(off).over(before) - F.sum(off).over(same)))
    return rows.where(~F.col("gone")).select("track_id", "clip_id", F.col("at").alias("tl_start"))


def durations(clips: DataFrame) -> DataFrame:
    return clips.groupBy("track_id").agg(F.max(F.col("tl_start") + length()).alias("duration"))


def source_times(placed: DataFrame, clips: DataFrame, at: float) -> DataFrame:
    """(track_id, clip_id, src_t): the clip that plays at a time of the film, and where in its source."""
    rows = clips.drop("tl_start").join(placed, ["track_id", "clip_id"])
    return rows.where((F.col("tl_start") <= at) & (F.lit(at) < F.col("tl_start") + length())).select("track_id", "clip_id", (F.col("src_in") + (at - F.col("tl_start")) * F.col("speed")).alias("src_t"))


def render_plan(clips: DataFrame) -> DataFrame:
    """(track_id, n, plan): one pass unless there are over 80 clips, or they are sparse in what they span."""
    out = clips.groupBy("track_id").agg(F.count("*").alias("n"), (F.max("src_out") - F.min("src_in")).alias("span"), F.sum(F.col("src_out") - F.col("src_in")).alias("content"))
    sparse = (F.col("span") > 1.5 * F.col("content")) & (F.col("content") > 1)
    return out.select("track_id", "n", F.when((F.col("n") <= 80) & ~sparse, "single").otherwise("segmented").alias("plan"))


def midpoints(signal: DataFrame, n: int) -> DataFrame:
    """(media_id, i, idx, value): the sample in the middle of each of n equal stretches."""
    sizes = signal.groupBy("media_id").agg(F.count("*").alias("n"))
    grid = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    grid = grid.select("media_id", "i", F.floor(F.col("n") * (F.col("i") + 0.5) / n).alias("idx"))
    return grid.join(signal.select("media_id", "idx", "value"), ["media_id", "idx"]).select("media_id", "i", "idx", "value")


def hopping(intervals: DataFrame, width: float, hop: float) -> DataFrame:
    """(..., lo, hi): windows from each interval's start, hop apart, until one reaches its end."""
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start") - width) / hop) + 1).cast("int")
    rows = intervals.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    lo = F.col("start") + F.col("i") * hop
    return rows.withColumn("lo", lo).withColumn("hi", lo + width).drop("i")


def events_in(intervals: DataFrame, events: DataFrame, margin: float, width: float) -> DataFrame:
    """(media_id, rally_id, n, phrases): distinct phrases within margin of an interval, by their first time. width: of the join's bins."""
    wide = intervals.select("media_id", "rally_id", (F.col("start") - margin).alias("lo"), (F.col("end") + margin).alias("hi"))
    found = events.withColumn("bin", F.floor(F.col("t") / width)).join(binned(wide, width, "lo", "hi"), ["media_id", "bin"]).where("t >= lo and t <= hi")
    first = found.groupBy("media_id", "rally_id", "phrase").agg(F.min("t").alias("t"))
    out = first.groupBy("media_id", "rally_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("t", "phrase"))).alias("p"))
    return out.select("media_id", "rally_id", "n", F.array_join(F.col("p.phrase"), ",").alias("phrases"))


def next_after(rallies: DataFrame, margin: float) -> DataFrame:
    """next_id: of each interval, the first of its medium that starts over margin after its end; null if none.

    Ends and starts are put in one order, so each medium is sorted once instead of joined with itself.
    """
    points = rallies.select("media_id", F.col("start").alias("p"), F.lit(1).alias("kind"), "rally_id").unionAll(rallies.select("media_id", (F.col("end") + margin).alias("p"), F.lit(2).alias("kind"), "rally_id"))
    ahead = W.partitionBy("media_id").orderBy(F.desc("p"), F.desc("kind"), F.desc("rally_id")).rowsBetween(W.unboundedPreceding, -1)
    found = F.last(F.when(F.col("kind") == 1, F.col("rally_id")), ignorenulls=True).over(ahead)
    return points.withColumn("next_id", found).where("kind = 2").select("media_id", "rally_id", "next_id")


def next_targets(positions: DataFrame, queue: DataFrame, width: float, tail: float = 0.06, ahead: float = 0.02) -> DataFrame:
    """positions (position, scope, media_id, t) with verdict, next_media and next_id: what to play next.

    queue is (scope, nth_medium, media_id, rally_id, start, end), played by nth_medium, start and rally_id; positions
    carry nth_medium, too, as their medium need not have a rally. Inside a rally (of several, the first in the queue) the verdict is 'stay' until tail before its end, and then the rally
    after it. Outside, it is the medium's first one that starts more than ahead later, else the first of a later
    medium. The verdict is 'go', or 'end' where the queue has no more; width is about a rally's length.
    Positions without a time or scope end. An empty queue ends all.
    """
    order = W.partitionBy("scope").orderBy("nth_medium", "start", "rally_id")
    q = queue.withColumn("next", F.lead(F.struct("media_id", "rally_id")).over(order))
    inside = q.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    here = positions.withColumn("bin", F.floor(F.col("t") / width)).join(inside.select("scope", "media_id", "bin", "start", "end", "rally_id", "next"), ["scope", "media_id", "bin"])
    here = here.where(F.col("t").between(F.col("start"), F.col("end"))).groupBy("position").agg(F.min_by(F.struct("end", "next"), F.struct("start", "rally_id")).alias("now"))
    marks = q.select("scope", "nth_medium", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("position"), F.struct("start", "rally_id", "media_id").alias("rally"))
    asks = positions.select("scope", "nth_medium", (F.col("t") + ahead).alias("at"), F.lit(1).alias("kind"), "position", F.lit(None).cast(marks.schema["rally"].dataType).alias("rally"))
    later = W.partitionBy("scope").orderBy(F.desc("nth_medium"), F.desc("at"), F.desc("kind"), F.desc("rally.rally_id"))
    found = marks.unionByName(asks)
    found = found.where("at is not null").withColumn("after", F.last("rally", ignorenulls=True).over(later.rowsBetween(W.unboundedPreceding, 0)))
    found = found.where("kind = 1").select("position", "after")
    rows = positions.join(here, "position", "left").join(found, "position", "left")
    target = F.when(F.col("now").isNotNull(), F.col("now.next")).otherwise(F.struct(F.col("after.media_id").alias("media_id"), F.col("after.rally_id").alias("rally_id")))
    stay = F.col("now").isNotNull() & (F.col("t") < F.col("now.end") - tail)
    rows = rows.withColumn("target", F.when(~F.coalesce(stay, F.lit(False)), target))
    verdict = F.when(F.coalesce(stay, F.lit(False)), "stay").when(F.col("target.rally_id").isNotNull(), "go").otherwise("end")
    return rows.select("position", verdict.alias("verdict"), F.col("target.media_id").alias("next_media"), F.col("target.rally_id").alias("next_id"))
