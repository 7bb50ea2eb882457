"""Evidence for boundaries along a signal, hysteresis with run lengths, verification by presence, gates of stored hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import series as se
from tidemark.operators.intervals import SPAN, binned

#: Seconds: outside and inside of a start, of an end; the slope's window and how far it looks; the swing's window.
START, END, SLOPE, LOOK, SWING = (1.5, 1.5), (1.5, 1.5), 0.5, 0.5, 1.0
CHANNELS = ("motion_contrast", "motion_slope", "swing", "overhead")


def samples(seconds: float, fps: float) -> int:
    return max(1, round(seconds * fps))


def side_channels(signal: DataFrame, side: str, fps: float, quiet: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(media_id, idx, keep, channels) of the signal (media_id, idx, value, swing, overhead), the channels being those of one side, start or end.

    The contrast is the mean after a start (before an end) less that on the other side; the slope is the
    steepest rise (fall) of the smoothed value near the sample; the swing is the largest in its window above
    quiet, the overhead its mean. Windows are shorter at the edges, and empty ones are 0; a null swing counts as 0.
    """
    rising, (out, inner) = side == "start", START if side == "start" else END
    run, k, look, w = se.run(), samples(SLOPE, fps), samples(LOOK, fps), samples(SWING, fps)
    ahead = lambda c, n: F.coalesce(F.avg(c).over(run.rowsBetween(0, n - 1)), F.lit(0.0))
    behind = lambda c, n: F.coalesce(F.avg(c).over(run.rowsBetween(-n, -1)), F.lit(0.0))
    inside, outside = (ahead("value", samples(inner, fps)), behind("value", samples(out, fps))) if rising else (behind("value", samples(inner, fps)), ahead("value", samples(out, fps)))
    rows = signal.withColumns({"swing": F.coalesce("swing", F.lit(0.0)), "overhead": F.coalesce("overhead", F.lit(0.0))})
    rows = rows.withColumn("smooth", F.sum("value").over(run.rowsBetween(-(k // 2), (k - 1) // 2)) / k)
    rows = rows.withColumn("d", F.coalesce((F.col("smooth") - F.lag("smooth", k).over(run)) / (k / fps), F.lit(0.0)))
    near = run.rowsBetween(-look, look)
    # as the filter's origin is placed, a start looks back at the swing and an end ahead
    swings = run.rowsBetween(1 - w, 0) if rising else run.rowsBetween(w % 2 - 1, w - 2 + w % 2)
    made = {
        "motion_contrast": inside - outside,
        "motion_slope": F.max("d").over(near) if rising else -F.min("d").over(near),
        "swing_near": F.greatest(F.lit(0.0), F.max("swing").over(swings) - quiet),
        "overhead_near": ahead("overhead", w) if rising else behind("overhead", w),
    }
    return rows.withColumns(made).select("media_id", "idx", *keep, "motion_contrast", "motion_slope", F.col("swing_near").alias("swing"), F.col("overhead_near").alias("overhead"))


def packing(ranges: dict[str, tuple[float, float]], weights: dict[str, float]) -> Column:
    """The weighted mean of the channels, each from 0 to 1 over its range."""
    used = {c: w for c in CHANNELS if (w := weights.get(c, 0.0)) > 1e-9}
    total = sum(used.values())
    parts = [w * se.clipped((F.col(c) - ranges[c][0]) / max(ranges[c][1] - ranges[c][0], 1e-9), 0.0, 1.0) for c, w in used.items()]
    return sum(parts[1:], parts[0]) / total if parts else F.lit(0.0)


def packed(channels: DataFrame, ranges: dict[str, tuple[float, float]], weights: dict[str, float]) -> DataFrame:
    """(media_id, idx, score): packing of the channels."""
    return channels.select("media_id", "idx", packing(ranges, weights).alias("score"))


def hit_feature(points: DataFrame, hits: DataFrame, side: str, cap: float) -> DataFrame:
    """(media_id, idx, other columns, hit) of points (media_id, idx, t, other columns): from 1 at a hit to 0 at cap before a start's next hit (after an end's last); hits 0.05 on the wrong side count as there. One sort, no join."""
    shift = -0.05 if side == "start" else 0.05
    others = [c for c in points.columns if c not in ("media_id", "idx", "t")]
    both = points.select("media_id", "idx", *others, F.col("t").alias("at"), (F.col("t") + shift).alias("key"), F.lit(None).cast("double").alias("u"))
    both = both.unionByName(hits.select("media_id", F.col("t").alias("key"), F.col("t").alias("u")), allowMissingColumns=True)
    if side == "start":
        near = F.last("u", ignorenulls=True).over(W.partitionBy("media_id").orderBy(F.desc("key"), F.col("u").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    else:
        near = F.last("u", ignorenulls=True).over(W.partitionBy("media_id").orderBy("key", F.col("u").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    rows = both.withColumn("near", near).where("idx is not null")
    gap = F.greatest(F.lit(0.0), F.col("near") - F.col("at") if side == "start" else F.col("at") - F.col("near"))
    return rows.select("media_id", "idx", *others, F.coalesce(se.clipped(1 - gap / cap, 0.0, 1.0), F.lit(0.0)).alias("hit"))


def active_spans(signal: DataFrame, ends: DataFrame, on: int, off: int, gap: int, least: int) -> DataFrame:
    """(media_id, first, last, confidence) where a signal is on, for ends (media_id, hi, lo) with lo <= hi.

    It goes on, from their first, at on samples in a row of hi or more, and off, from their first, at off samples
    in a row below lo. Spans at most gap apart join; those shorter than least go. confidence: the mean value over
    1.5 times hi, up to 1.
    """
    run = se.run()
    since = lambda n: run.rowsBetween(1 - n, 0)
    rows = signal.join(ends, "media_id").withColumn("n", F.count("*").over(se.key()))
    says = F.when((F.count("*").over(since(on)) == on) & (F.min(F.col("value") - F.col("hi")).over(since(on)) >= 0), 1).when((F.count("*").over(since(off)) == off) & (F.max(F.col("value") - F.col("lo")).over(since(off)) < 0), 0)
    rows = rows.withColumn("says", says)
    rows = rows.withColumn("on", F.coalesce(F.last("says", ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    turns = rows.withColumn("was", F.coalesce(F.lag("on").over(run), F.lit(0))).where("on <> was")
    turns = turns.withColumn("last", F.coalesce(F.lead("idx").over(run) - off + 1, F.col("n") - 1)).where("on = 1").select("media_id", (F.col("idx") - on + 1).alias("first"), "last")
    order = W.partitionBy("media_id").orderBy("first")
    named = turns.withColumn("new", F.when(F.col("first") - F.lag("last").over(order) <= gap, 0).otherwise(1)).withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = named.groupBy("media_id", "span").agg(F.min("first").alias("first"), F.max("last").alias("last")).where(F.col("last") - F.col("first") >= least)
    inside = signal.withColumn("bin", F.floor(F.col("idx") / SPAN)).join(binned(spans, SPAN, "first", "last"), ["media_id", "bin"]).where("idx between first and last")
    means = inside.groupBy("media_id", "first", "last").agg(F.avg("value").alias("mean")).join(ends, "media_id")
    conf = se.clipped(se.clipped(F.col("mean") / F.greatest("hi", F.lit(1e-9)), 0.0, 1.5) / 1.5, 0.05, 1.0)
    return means.select("media_id", "first", "last", conf.alias("confidence"))


def verified(intervals: DataFrame, presence: DataFrame, fps: float, width: int, pre: float, post: float, least: float, above: float = 0.15) -> DataFrame:
    """Intervals (media_id, rally_id, start, end) that a presence signal (media_id, idx, value) bears out, tightened to it.

    Only in media where it is above the mark in 5 to 90 % of the samples: an interval in which it is in under 2 %
    goes; others shrink to half of pre before its first sample above and half of post after its last, if there are
    two, and go if shorter than least. An interval without samples stays. width: of the join's bins.
    """
    up = F.col("value") > above
    cover = presence.groupBy("media_id").agg(F.avg(up.cast("double")).alias("cover"))
    rows = intervals.withColumn("lo", F.greatest(F.lit(0), F.floor(F.col("start") * fps)))
    rows = rows.withColumn("hi", F.greatest(F.col("lo") + 1, F.floor(F.col("end") * fps)) - 1)
    found = presence.withColumn("bin", F.floor(F.col("idx") / width)).join(binned(rows.select("media_id", "rally_id", "lo", "hi"), width, "lo", "hi"), ["media_id", "bin"]).where("idx between lo and hi")
    at = F.when(up, F.col("idx"))
    found = found.groupBy("media_id", "rally_id").agg(F.avg(up.cast("double")).alias("share"), F.count(at).alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    rows = rows.join(cover, "media_id", "left").join(found, ["media_id", "rally_id"], "left")
    usable = F.coalesce(F.col("cover").between(0.05, 0.9), F.lit(False)) & F.col("share").isNotNull()
    tight = usable & (F.col("n") >= 2)
    start = F.when(tight, F.greatest(F.col("start"), F.col("a") / fps - pre * 0.5)).otherwise(F.col("start"))
    end = F.when(tight, F.least(F.col("end"), (F.col("b") + 1) / fps + post * 0.5)).otherwise(F.col("end"))
    rows = rows.withColumns({"start": start, "end": end})
    return rows.where(~usable | ((F.col("share") >= 0.02) & (F.col("end") - F.col("start") >= least))).select("media_id", "rally_id", "start", "end")


def rebuilt_hits(stored: DataFrame) -> DataFrame:
    """(media_id, nth, t, strength, confidence, raw) of stored arrays (media_id, times, strengths, confidences, raw_times, raw_strengths, raw_confidences).

    The raw ones count if there are any, else the gated ones; missing strengths are 1, confidences 0.5.
    """
    raw = F.coalesce(F.size("raw_times") > 0, F.lit(False))
    pick = lambda a, b: F.when(raw, F.col(a)).otherwise(F.col(b))
    rows = stored.select("media_id", raw.alias("raw"), pick("raw_times", "times").alias("t"), pick("raw_strengths", "strengths").alias("s"), pick("raw_confidences", "confidences").alias("c"))
    rows = rows.select("media_id", "raw", "s", "c", F.posexplode("t").alias("nth", "t"))
    at = lambda c, other: F.coalesce(F.try_element_at(F.col(c), F.col("nth") + 1), F.lit(other))
    return rows.select("media_id", "nth", "t", at("s", 1.0).alias("strength"), at("c", 0.5).alias("confidence"), "raw")


def regated(hits: DataFrame, media: DataFrame, threshold: float, least_keep: float = 0.12, most_keep: float = 0.97) -> DataFrame:
    """(media_id, hit_idx, regate) of the raw hits (media_id, hit_idx, evidence, local_pct) that stay, and what was done.

    media (media_id, use_audio, use_pose, has_raw, coverage, force): without audio nothing stays (audio_off);
    without raw hits (no_raw), pose (pose_off) or its signal (coverage null: no_pose) all do. Else the larger of
    the evidence and 0.6 of the local share must reach the threshold (applied), unless the coverage is below 0.35
    or the share that stays is outside [least_keep, most_keep] and it isn't forced (skipped).
    """
    reaches = F.greatest(F.coalesce("evidence", F.lit(0.0)), 0.6 * F.coalesce("local_pct", F.lit(0.0))) >= threshold
    rows = hits.withColumn("reaches", reaches)
    shares = rows.groupBy("media_id").agg(F.avg(F.col("reaches").cast("double")).alias("share"))
    guarded = ~F.col("force") & ((F.col("coverage") < 0.35) | ~F.col("share").between(least_keep, most_keep))
    code = F.when(~F.col("use_audio"), "audio_off").when(~F.col("has_raw"), "no_raw").when(~F.col("use_pose"), "pose_off").when(F.col("coverage").isNull(), "no_pose").when(guarded, "skipped").otherwise("applied")
    plan = media.join(shares, "media_id").select("media_id", code.alias("regate"))
    kept = (F.col("regate") != "audio_off") & ((F.col("regate") != "applied") | F.col("reaches"))
    return rows.join(plan, "media_id").where(kept).select("media_id", "hit_idx", "regate")


def pauses(signal: DataFrame, intervals: DataFrame, fps: float, margin: float, level: Column, width: float) -> DataFrame:
    """(media_id, rally_id, t): the signal's local minima where level holds, at least margin inside an interval: what a boundary must not be mistaken for."""
    run = se.run()
    low = (F.col("value") < F.lag("value").over(run)) & (F.col("value") <= F.lead("value").over(run)) & level
    at = signal.withColumn("low", low).where("low").select("media_id", (F.col("idx") / fps).alias("t")).withColumn("bin", F.floor(F.col("t") / width))
    return at.join(binned(intervals.select("media_id", "rally_id", "start", "end"), width), ["media_id", "bin"]).where((F.col("t") >= F.col("start") + margin) & (F.col("t") <= F.col("end") - margin)).select("media_id", "rally_id", "t")


def boundary_samples(labels: DataFrame, stops: DataFrame, channels: DataFrame, fps: float, window: tuple[float, float] | None = None) -> DataFrame:
    """(media_id, t, positive, channels' columns): what a side's boundary template is fitted on.

    labels are (media_id, t) of the side, those within window count; stops are the negatives (see pauses), the same
    ones for both sides, each once however many labels hold it. The features are those of the nearest frame,
    halves to the even one, the last frame for later times. channels are (media_id, idx, ...). Times without a medium's channels go.
    """
    rows = labels.where("t is not null").select("media_id", "t", F.lit(True).alias("positive"))
    if window:
        rows = rows.where(F.col("t").between(*window))
    rows = rows.unionByName(stops.select("media_id", "t").distinct().withColumn("positive", F.lit(False)))
    tops = channels.groupBy("media_id").agg(F.max("idx").alias("top"))
    idx = F.least("top", F.greatest(F.lit(0), F.bround(F.col("t") * fps))).cast("long")
    return rows.join(tops, "media_id").withColumn("idx", idx).drop("top").join(channels, ["media_id", "idx"]).drop("idx")


def weighted_density(hits: DataFrame, signal: DataFrame, fps: float, width: int, power: float = 1.0, weight: float = 0.5, least: float = 0.02) -> DataFrame:
    """(media_id, idx, density, activity): hits' density, each hit as heavy as its evidence says, and the signal damped where it is thin.

    hits are (media_id, t, evidence from 0 to 1, its power counts; below least, or null, none); signal is
    (media_id, idx, value) without holes. A medium without heavy hits has density 0 and its signal as it is,
    both scaled to [0, 1].
    """
    w = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("evidence"))), F.lit(power))
    tops = signal.groupBy("media_id").agg(F.max("idx").alias("top"))
    at = F.least("top", F.greatest(F.lit(0), F.bround(F.col("t") * fps))).cast("long")
    heavy = hits.withColumn("w", w).where(F.col("w") > least).join(tops, "media_id").groupBy("media_id", at.alias("idx")).agg(F.sum("w").alias("w"))
    some = heavy.groupBy("media_id").agg(F.lit(True).alias("some"))
    rows = signal.join(heavy, ["media_id", "idx"], "left").select("media_id", "idx", F.col("value").alias("raw"), F.coalesce("w", F.lit(0.0)).alias("value"))
    rows = se.smooth(rows, width).withColumn("value", F.col("smooth"))
    rows = se.robust_norm(rows, out="density").withColumn("value", F.col("raw"))
    rows = se.robust_norm(rows, out="own").join(some, "media_id", "left")
    rows = rows.withColumn("value", F.col("own") * F.when(F.col("some"), 1 - weight + weight * F.col("density")).otherwise(1.0))
    return se.robust_norm(rows, out="activity").select("media_id", "idx", "density", "activity")
