"""Spans of time and frames: anchoring at hits, film coverage, nearest frames, runs, curves along tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators import series as se
from tidemark.operators.intervals import binned, run


def near_polygon(x: Column, y: Column, polygon: list[tuple[float, float]], margin: float) -> Column:
    """Whether the point is in the convex polygon, its edges moved outward by margin."""
    area = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]))
    inside = F.lit(True)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        inward = ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length * (1 if area > 0 else -1)
        inside = inside & (inward >= -margin)
    return inside


def with_overrides(base: Column, raw: Column) -> Column:
    """The map base with the values that raw has for its keys; other keys of raw count for nothing."""
    return F.transform_values(base, lambda k, v: F.coalesce(raw[k], v))


def film_overlaps(clips: DataFrame, rallies: DataFrame, width: float) -> DataFrame:
    """Overlaps of clips (media_id, clip_id, src_in, src_out) with rallies, each once. width: of the join's bins."""
    cut = binned(clips.select("media_id", "clip_id", "src_in", "src_out"), width, "src_in", "src_out")
    both = cut.join(binned(rallies.select("media_id", "rally_id", "start", "end"), width), ["media_id", "bin"])
    over = F.least("src_out", "end") - F.greatest("src_in", "start")
    return both.where(F.col("bin") == F.floor(F.greatest("src_in", "start") / width)).withColumn("overlap", over).where("overlap > 0")


def remapped(clips: DataFrame, rallies: DataFrame, width: float, least: float = 0.05) -> DataFrame:
    """(media_id, clip_id, rally_id): the rally that a clip overlaps most, of equal ones the first, if by more than least; else null."""
    best = film_overlaps(clips, rallies, width).groupBy("media_id", "clip_id").agg(F.max(F.struct("overlap", (-F.col("rally_id")).alias("back"))).alias("m"))
    best = best.where(F.col("m.overlap") > least).select("media_id", "clip_id", (-F.col("m.back")).alias("rally_id"))
    return clips.select("media_id", "clip_id").join(best, ["media_id", "clip_id"], "left")


def film_coverage(clips: DataFrame, rallies: DataFrame, width: float, enough: float = 0.75) -> DataFrame:
    """(media_id, rally_id, ratio, covered, best): the share of a rally that clips cover, if that is enough, and the clip that covers most of it, of equal ones the first."""
    found = film_overlaps(clips, rallies, width).groupBy("media_id", "rally_id").agg(F.sum("overlap").alias("sum"), F.max(F.struct("overlap", (-F.col("clip_id")).alias("back"))).alias("m"))
    rows = rallies.select("media_id", "rally_id", "start", "end").join(found, ["media_id", "rally_id"], "left")
    ratio = F.least(F.lit(1.0), F.coalesce("sum", F.lit(0.0)) / F.greatest(F.lit(0.05), F.col("end") - F.col("start")))
    return rows.withColumn("ratio", ratio).select("media_id", "rally_id", "ratio", (F.col("ratio") >= enough).alias("covered"), (-F.col("m.back")).alias("best"))


def nearest_frame(times: DataFrame, frames: DataFrame, tolerance: float) -> DataFrame:
    """(media_id, hit_idx, frame_t, age) of times (media_id, hit_idx, t): the nearest of frames (media_id, u), of equally near ones the earlier; none beyond tolerance.

    One sort of both by time; no join.
    """
    both = times.select("media_id", "t", "hit_idx", F.lit(None).cast("double").alias("u")).union(frames.select("media_id", F.col("u").alias("t"), F.lit(None).cast("long"), "u"))
    order = W.partitionBy("media_id").orderBy("t", F.col("u").asc_nulls_last(), "hit_idx")
    turned = W.partitionBy("media_id").orderBy(F.desc("t"), F.col("u").desc_nulls_first(), F.desc("hit_idx"))
    back, ahead = (o.rowsBetween(W.unboundedPreceding, 0) for o in (order, turned))
    rows = both.withColumn("a", F.last("u", ignorenulls=True).over(back)).withColumn("b", F.last("u", ignorenulls=True).over(ahead)).where("hit_idx is not null")
    nearest = F.when(F.col("a").isNull() | (F.col("t") - F.col("a") > F.col("b") - F.col("t")), F.col("b")).otherwise(F.col("a"))
    rows = rows.withColumn("near", nearest).withColumn("age", F.abs(F.col("t") - F.col("near")))
    kept = F.col("age") <= tolerance
    return rows.select("media_id", "hit_idx", F.when(kept, F.col("near")).alias("frame_t"), F.when(kept, F.col("age")).alias("age"))


def longest_run(df: DataFrame, flag: str) -> DataFrame:
    """(media_id, first, last, n): each medium's longest run of samples whose flag is 1, of equal ones the first."""
    order = W.partitionBy("media_id").orderBy(F.desc("n"), "first")
    return se.runs(df, flag).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def directed_max(df: DataFrame, width: int, forward: bool, out: str = "top") -> DataFrame:
    """The largest of width samples. As the filter's origin is placed, forward takes the sample and those before it; otherwise those from it on, one earlier for an even width."""
    frame = se.run().rowsBetween(1 - width, 0) if forward else se.run().rowsBetween(width % 2 - 1, width - 2 + width % 2)
    return df.withColumn(out, F.max("value").over(frame))


def adaptive_threshold(df: DataFrame, width: int, k: float) -> DataFrame:
    """(media_id, idx, threshold): rolling median plus k times 1.4826 times the rolling median of what is off it (width odd); only where both windows are whole."""
    half = width // 2
    frame = se.run().rowsBetween(-half, half)
    n = F.count("*").over(se.key())
    rows = df.withColumn("median", F.percentile("value", F.lit(0.5)).over(frame)).withColumn("n", n)
    rows = rows.withColumn("mad", F.percentile(F.abs(F.col("value") - F.col("median")), F.lit(0.5)).over(frame))
    whole = F.col("idx").between(2 * half, F.col("n") - 1 - 2 * half)
    return rows.where(whole).select("media_id", "idx", (F.col("median") + k * (F.col("mad") * 1.4826 + 1e-6)).alias("threshold"))


def arc_length(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """points (x, y) with the length of the way along them up to each."""
    w = W.partitionBy(*keys).orderBy(*order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("length", F.sum("step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("step")


def in_flight(tracks: DataFrame) -> DataFrame:
    """(media_id, frame, flight): of each frame in the span (first, last) of a track, the largest confidence of such tracks."""
    frames = tracks.select("media_id", F.explode(F.sequence("first", "last")).alias("frame"), se.clipped(F.col("confidence"), 0.0, 1.0).alias("c"))
    return frames.groupBy("media_id", "frame").agg(F.max("c").alias("flight"))


def from_segments(segments: DataFrame, gap: float = 0.3) -> DataFrame:
    """(media_id, group, start, end, n, confidence) of segments (media_id, rally_id, start, end, score): a segment that begins less than gap after the end of the one before, by start and falling end, joins it."""
    order = W.partitionBy("media_id").orderBy("start", F.desc("end"), "rally_id")
    new = F.when(F.col("start") - F.lag("end").over(order) < gap, 0).otherwise(1)
    rows = segments.withColumn("new", new).withColumn("group", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy("media_id", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max("score").alias("score"))
    return out.select("media_id", "group", "start", "end", "n", se.clipped(0.25 + 0.75 * F.col("score"), 0.05, 1.0).alias("confidence"))


def shots(hits: DataFrame, gap: float) -> DataFrame:
    """(media_id, cluster, hit_idx, time, kind): the first hit of a cluster is the serve, the second the receive, others are unknown."""
    order = W.partitionBy("media_id", "cluster").orderBy("t", "hit_idx")
    nth = F.row_number().over(order)
    return ev.named_clusters(hits, gap).select("media_id", "cluster", "hit_idx", F.round("t", 3).alias("time"), F.when(nth == 1, "serve").when(nth == 2, "receive").otherwise("unknown").alias("kind"))


def anchored(intervals: DataFrame, hits: DataFrame, limit: float, width: float, pre: float = 1.0, post: float = 1.6, tail: float = 0.9, trim_start: bool = True, clamped: bool = True) -> DataFrame:
    """(media_id, rally_id, start, end, n, tail_gap, serve, receive): intervals with their ends moved to their hits.

    Hits from 1.0 before to 1.2 after count, up to the neighbours (if clamped). The end goes to tail after the
    last hit inside, earlier only if no other hit follows within limit; the start to pre before the first hit,
    without trim_start only if that is earlier. Without hits both are padded. width: of the join's bins.
    """
    before, after = F.lag("end").over(run()), F.lead("start").over(run())
    lo = F.greatest(F.col("start") - 1.0, before) if clamped else F.col("start") - 1.0
    hi = F.least(F.col("end") + 1.2, after) if clamped else F.col("end") + 1.2
    rows = intervals.select("media_id", "rally_id", "start", "end").withColumn("lo", lo).withColumn("hi", hi)
    middle, empty = (F.col("start") + F.col("end")) / 2, F.col("hi") < F.col("lo")
    rows = rows.select("media_id", "rally_id", "start", "end", F.when(empty, middle).otherwise(F.col("lo")).alias("lo"), F.when(empty, middle).otherwise(F.col("hi")).alias("hi"))
    times = hits.select("media_id", "t").distinct()
    follow = times.withColumn("next", F.lead("t").over(W.partitionBy("media_id").orderBy("t")))
    at = hits.select("media_id", "hit_idx", "t").join(follow, ["media_id", "t"]).withColumn("bin", F.floor(F.col("t") / width))
    inside = at.join(binned(rows, width, "lo", "hi"), ["media_id", "bin"]).where("t between lo and hi")
    inside = inside.withColumn("nth", F.row_number().over(W.partitionBy("media_id", "rally_id").orderBy("t", "hit_idx")))
    hit = F.struct("t", "next")
    found = inside.groupBy("media_id", "rally_id").agg(F.count("*").alias("n"), F.min(hit).alias("first"), F.max(F.when(F.col("t") <= F.col("end"), hit)).alias("last"), F.max(F.when(F.col("nth") == 2, F.col("t"))).alias("receive"))
    out = rows.join(found, ["media_id", "rally_id"], "left").withColumn("last", F.coalesce("last", "first"))
    last, first, none = F.col("last.t"), F.col("first.t"), F.col("n").isNull()
    gap = F.coalesce(F.col("last.next") - last, F.lit(float("inf")))
    end = F.greatest(F.when(gap > limit, F.least("end", last + tail)).otherwise(F.greatest("end", last + tail)), last + 0.05)
    begin = F.greatest(F.lit(0.0), first - pre)
    start = begin if trim_start else F.least("start", begin)
    out = out.select(
        "media_id", "rally_id",
        F.when(none, F.greatest(F.lit(0.0), F.col("start") - pre)).otherwise(start).alias("start"),
        F.when(none, F.col("end") + post).otherwise(end).alias("end"),
        F.coalesce("n", F.lit(0)).alias("n"), F.when(~none, F.least(gap, F.lit(999.0))).alias("tail_gap"), first.alias("serve"), "receive",
    )
    return out.where("end > start")


def histogram_steps(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(media_id, frame, step): half the sum of what the shares of value in [0, 1] by bin differ by from the frame before (of those with rows)."""
    at = F.least(F.lit(bins - 1), F.floor(F.col(value) * bins)).cast("int")
    n = rows.groupBy("media_id", "frame", at.alias("bin")).agg(F.count("*").alias("k"))
    shares = n.withColumn("share", F.col("k") / F.sum("k").over(W.partitionBy("media_id", "frame")))
    frames = rows.select("media_id", "frame").distinct().withColumn("next", F.lead("frame").over(W.partitionBy("media_id").orderBy("frame")))
    shares = shares.join(frames, ["media_id", "frame"]).select("media_id", "frame", "next", "bin", "share")
    moved = shares.where("next is not null").select("media_id", F.col("next").alias("frame"), "bin", (-F.col("share")).alias("share"))
    first = frames.groupBy("media_id").agg(F.min("frame").alias("first"))
    own = shares.select("media_id", "frame", "bin", "share").join(first, "media_id").where("frame > first").drop("first")
    return own.union(moved).groupBy("media_id", "frame", "bin").agg(F.abs(F.sum("share")).alias("d")).groupBy("media_id", "frame").agg((F.sum("d") / 2).alias("step"))


def snap_patch(start: Column, end: Column, side: Column, snap: Column, least: float = 0.5) -> Column:
    """(start, end) of a patch that moves one side to snap; null if that leaves less than least or the side is neither."""
    to_start = F.struct(snap.alias("start"), F.lit(None).cast("double").alias("end"))
    to_end = F.struct(F.lit(None).cast("double").alias("start"), snap.alias("end"))
    return F.when((side == "start") & (snap < end - least), to_start).when((side == "end") & (snap > start + least), to_end)


def fit_document(numbers: Column, known: list[str]) -> Column:
    """A map of numbers with its known, finite entries alone, at four places."""
    kept = F.map_filter(numbers, lambda k, v: k.isin(*known) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.transform_values(kept, lambda k, v: F.round(v, 4))


def windowed_picks(rows: DataFrame, size: int, step: int, k: int, most: int) -> DataFrame:
    """(media_id, track): of each window of size frames, every step, the k tracks with the largest area in sum; of all these the most with the most frames."""
    first = F.floor((F.col("frame") - size) / step) + 1
    spread = rows.withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), first), F.floor(F.col("frame") / step))))
    sums = spread.groupBy("media_id", "window", "track").agg(F.sum("area").alias("area"))
    picked = sums.withColumn("nth", F.row_number().over(W.partitionBy("media_id", "window").orderBy(F.desc("area"), "track"))).where(F.col("nth") <= k)
    long = rows.groupBy("media_id", "track").agg(F.count("*").alias("n")).join(picked.select("media_id", "track").distinct(), ["media_id", "track"])
    return long.withColumn("nth", F.row_number().over(W.partitionBy("media_id").orderBy(F.desc("n"), "track"))).where(F.col("nth") <= most).select("media_id", "track")


def dense_density(hits: DataFrame, slot: float, window: int, least_confidence: float) -> DataFrame:
    """(media_id, idx, value): confident hits in each slot from the first to the last, smoothed over window slots, between its percentiles."""
    n = ev.density(hits, slot, least_confidence)
    spans = n.groupBy("media_id").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    grid = spans.select("media_id", "lo", F.explode(F.sequence("lo", "hi")).alias("slot"))
    dense = grid.join(n, ["media_id", "slot"], "left").select("media_id", (F.col("slot") - F.col("lo")).alias("idx"), F.coalesce("n", F.lit(0)).cast("double").alias("value"))
    smooth = se.smooth(dense, window).select("media_id", "idx", F.col("smooth").alias("value"))
    return se.robust_norm(smooth).select("media_id", "idx", F.col("norm").alias("value"))


def strong_or_all(hits: DataFrame, least: float, enough: int = 2) -> DataFrame:
    """The hits of a strength of at least `least`; all of a medium that has fewer than `enough` such."""
    strong = hits.where(F.col("strength") >= least)
    many = strong.groupBy("media_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("media_id")
    return strong.join(many, "media_id", "left_semi").unionByName(hits.join(many, "media_id", "left_anti").select(*strong.columns))


def over_short_gaps(intervals: DataFrame, hits: DataFrame, longest: float = 4.0, side: float = 1.0, slack: float = 0.3) -> DataFrame:
    """(media_id, rally_id, start, end, n): intervals, by start and id, joined over a gap of up to longest with a hit (media_id, t) on each side of it.

    One lies from side before the gap's beginning to slack after it, the other from slack before its end to side
    after it. A joined interval has the first one's id and ends where its last one does. Intervals that overlap or touch stay apart.
    """
    order = W.partitionBy("media_id").orderBy("start", "rally_id")
    rows = intervals.select("media_id", "rally_id", "start", "end").withColumn("before", F.lag("end").over(order))
    gaps = rows.where((F.col("start") - F.col("before") > 0) & (F.col("start") - F.col("before") <= longest))
    width = side + slack
    marks = hits.select("media_id", "t", F.floor(F.col("t") / width).alias("bin")).distinct()
    sides = F.array(F.struct((F.col("before") - side).alias("lo"), (F.col("before") + slack).alias("hi"), F.lit(0).alias("k")), F.struct((F.col("start") - slack).alias("lo"), (F.col("start") + side).alias("hi"), F.lit(1).alias("k")))
    near = binned(gaps.select("media_id", "rally_id", F.inline(sides)), width, "lo", "hi").join(marks, ["media_id", "bin"]).where("t >= lo and t <= hi")
    both = near.groupBy("media_id", "rally_id").agg(F.count_distinct("k").alias("k")).where("k = 2").select("media_id", "rally_id", F.lit(0).alias("new"))
    rows = rows.join(both, ["media_id", "rally_id"], "left").withColumn("island", F.sum(F.coalesce("new", F.lit(1))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = rows.groupBy("media_id", "island").agg(F.min(F.struct("start", "rally_id")).alias("a"), F.max(F.struct("start", "rally_id", "end")).alias("b"), F.count("*").alias("n"))
    return out.select("media_id", "a.rally_id", "a.start", "b.end", "n")
