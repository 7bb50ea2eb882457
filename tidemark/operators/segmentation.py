"""Intervals out of signals: between quiet stretches, and chosen from two segmentations by which of them can be trusted.

Signals are (media_id, idx, value), intervals (media_id, rally_id, start, end, score), times in seconds. Samples meet
intervals by bins of time, so those of one medium are spread over tasks; rows with a null medium or time drop out
of the joins, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.intervals import SPAN, binned, join_abutting
from tidemark.operators.kernels import longest_of_overlapping, split_at_quiet
from tidemark.operators.labels import around
from tidemark.operators.lineage import cut
from tidemark.operators.series import clipped, spread

def samples_in(spans: DataFrame, samples: DataFrame) -> DataFrame:
    """The samples with the columns of the spans (media_id, span, lo, hi) that hold them, lo <= idx < hi."""
    rows = spans.withColumn("top", F.col("hi") - 1).where("top >= lo")
    found = samples.withColumn("bin", F.floor(F.col("idx") / SPAN)).join(binned(rows, SPAN, "lo", "top"), ["media_id", "bin"])
    return found.where("idx >= lo and idx <= top").drop("bin", "top")


def clumps(spans: DataFrame, samples: DataFrame, gap: int) -> DataFrame:
    """(media_id, span, first, last, n): the runs of samples (media_id, idx) within each span, those at most gap apart in one."""
    run = W.partitionBy("media_id", "span").orderBy("idx")
    found = samples_in(spans.select("media_id", "span", "lo", "hi"), samples.select("media_id", "idx"))
    found = found.withColumn("new", F.when(F.col("idx") - F.lag("idx").over(run) <= gap, 0).otherwise(1))
    found = found.withColumn("clump", F.sum("new").over(run.rowsBetween(W.unboundedPreceding, 0)))
    return found.groupBy("media_id", "span", "clump").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).drop("clump")


def longest_clumps(spans: DataFrame, samples: DataFrame, gap: int) -> DataFrame:
    """The longest clump of each span, of equal ones the first."""
    best = clumps(spans, samples, gap).groupBy("media_id", "span").agg(F.max(F.struct((F.col("last") - F.col("first")).alias("size"), (-F.col("first")).alias("back"), "last", "n")).alias("b"))
    return best.select("media_id", "span", (-F.col("b.back")).alias("first"), "b.last", "b.n")


#: Bits of a span's number within its medium and parameters.
BITS = 24
#: What a segmentation is steered by: seconds before and after a core, the least and most of an interval (0: no limit), the least of a core and of a rest, seconds between quiet stretches and how far they stand out.
SETTINGS = {"pre": 1.0, "post": 1.6, "least": 2.0, "most": 120.0, "core": 1.0, "rest": 0.8, "apart": 0.7, "ratio": 0.18}
OWN = ("media_id", "param_id")


def settled(media: DataFrame, **settings: float) -> DataFrame:
    """media with param_id 0 and the settings as columns, defaults where none are given."""
    return media.withColumns({"param_id": F.lit(0).cast("long")} | {k: F.lit(float(settings.get(k, v))) for k, v in SETTINGS.items()})


def between_quiet(quiet: DataFrame, media: DataFrame, fps: float, resting: bool) -> DataFrame:
    """(media_id, span, lo, hi): samples from a quiet stretch (media_id, apart, ratio, first, last, bottom) to the next, before the first and after the last.

    media: (media_id, param_id, n, duration, known, settings), known being the first sample that can be trusted;
    param_id stands in the upper bits of span. Resting, a stretch shorter than the rest begins no span, spans have a
    core's samples at least, and the first is longer than a core and begins at known; else all stretches begin
    spans, the first begins at 0, and a medium without quiet stretches is one span.
    """
    rows = quiet.join(media, ["media_id", "apart", "ratio"])
    order = W.partitionBy(*OWN).orderBy("bottom", "first")
    rows = rows.withColumns({"next": F.lead("first").over(order), "nth": F.row_number().over(order).cast("long")})
    least = F.floor(F.col("core") * fps)
    between = F.col("next") > F.col("last")
    if resting:
        between &= ((F.col("last") - F.col("first")) / fps >= F.col("rest")) & (F.col("next") - F.col("last") >= least)
        head = (F.col("first") / fps > F.col("core")) & (F.col("first") > F.col("known"))
        tail = F.col("duration") - F.col("last") / fps > F.col("core")
    else:
        head, tail = F.col("first") > least, F.col("n") - F.col("last") > least
    none, own = F.lit(0).cast("long"), F.shiftleft("param_id", BITS)
    spans = F.array(
        F.when(between, F.struct((own + F.col("nth")).alias("span"), F.col("last").alias("lo"), F.col("next").alias("hi"))),
        F.when(head & (F.col("nth") == 1), F.struct(own.alias("span"), (F.col("known") if resting else none).alias("lo"), F.col("first").alias("hi"))),
        F.when(tail & F.col("next").isNull(), F.struct((own + F.col("nth")).alias("span"), F.col("last").alias("lo"), F.col("n").alias("hi"))),
    )
    found = rows.select("media_id", F.explode(spans).alias("s")).where("s is not null").select("media_id", "s.span", "s.lo", "s.hi")
    if resting:
        return found
    return found.union(media.join(quiet.select("media_id", "apart", "ratio").distinct(), ["media_id", "apart", "ratio"], "left_anti").select("media_id", own, none, "n"))


def with_settings(spans: DataFrame, media: DataFrame, *columns: str) -> DataFrame:
    """spans with param_id and some columns of media."""
    return spans.withColumn("param_id", F.shiftright("span", BITS)).join(media.select(*OWN, *columns), list(OWN))


def near_known(spans: DataFrame, known: DataFrame, reach: int, places: list[Column]) -> DataFrame:
    """The spans all of whose places have a known sample (media_id, idx) at most reach off: the last before or the next after it, from one order of both."""
    at = spans.select("media_id", F.col("span").alias("rally_id"), F.explode(F.array(*places)).alias("at"))
    near = around(at, known=known.select("media_id", F.col("idx").alias("u"))).where((F.col("at") - F.col("last_known") <= reach) | (F.col("next_known") - F.col("at") <= reach))
    fine = near.groupBy("media_id", F.col("rally_id").alias("span")).agg(F.count("*").alias("fine")).where(F.col("fine") == len(places))
    return spans.join(fine.select("media_id", "span"), ["media_id", "span"], "left_semi")


def rolled_out(cores: DataFrame, signal: DataFrame, media: DataFrame, fps: float) -> DataFrame:
    """(media_id, param_id, rally_id, start, end, score) around cores (media_id, span, first, last, score), pre before and post after them, within the medium.

    Those shorter than least go, those longer than most are cut where they are quietest, and of those that overlap
    by over 0.05 the longest stay.
    """
    rows = with_settings(cores, media, "duration", "pre", "post", "least", "most", "core", "apart", "ratio")
    rows = rows.withColumns({"start": F.greatest(F.lit(0.0), F.col("first") / fps - F.col("pre")), "end": F.least("duration", (F.col("last") + 1) / fps + F.col("post"))})
    rows = rows.where(F.col("end") - F.col("start") >= F.col("least"))
    fits = (F.col("most") <= 0) | (F.col("end") - F.col("start") <= F.col("most"))
    rows = cut(rows)
    long = rows.where(~fits).select("media_id", "span", "start", "end", "apart", (F.col("ratio") * 0.7).alias("ratio"), "core", (F.col("start") * fps).cast("long").alias("lo"), (F.col("end") * fps).cast("long").alias("hi"))
    pieces = split_at_quiet(samples_in(long, signal), fps)
    rows = rows.where(fits).select("media_id", "span", "start", "end", "score").union(pieces.select("media_id", "span", "start", "end", F.lit(0.0)))
    rows = rows.withColumn("param_id", F.shiftright("span", BITS))
    rows = cut(rows.withColumn("rally_id", F.row_number().over(W.partitionBy(*OWN).orderBy("start", F.desc("end"), "span")).cast("long")))
    return longest_of_overlapping(rows, OWN).join(rows.select(*OWN, "rally_id", "score"), [*OWN, "rally_id"])


def cut_by_motion(signal: DataFrame, quiet: DataFrame, media: DataFrame, fps: float, coverage: DataFrame | None = None) -> DataFrame:
    """(media_id, param_id, rally_id, start, end, score): by_motion of each row of media (media_id, param_id, n, duration, settings), the samples being read once for all."""
    if coverage is None:
        media = media.withColumn("known", F.lit(0).cast("long"))
    else:
        known = coverage.where("value >= 0.5")
        media = media.join(known.groupBy("media_id").agg(F.min("idx").cast("long").alias("known")), "media_id")
    spans = cut(between_quiet(quiet, media, fps, True).where("hi > lo"))
    moving = signal.join(spread(signal, 0.2, 0.95), "media_id").where(F.col("value") >= F.col("base") + 0.25 * F.col("width")).select("media_id", "idx")
    tight = with_settings(spans.join(longest_clumps(spans, moving, max(1, round(0.35 * fps))), ["media_id", "span"]), media, "core")
    tight = cut(tight.where((F.col("n") / (F.col("last") - F.col("first") + 1) >= 0.35) & ((F.col("last") - F.col("first")) / fps >= F.col("core"))))
    if coverage is not None:
        tight = near_known(tight, known, round(0.75 * fps), [F.col("lo"), F.col("hi") - 1, F.col("first"), F.col("last")])
    inside = samples_in(tight.select("media_id", "span", "first", "last", F.col("first").alias("lo"), (F.col("last") + 1).alias("hi")), signal)
    cores = inside.groupBy("media_id", "span", "first", "last").agg(F.avg("value").alias("mean"), F.percentile("value", F.array(F.lit(0.2), F.lit(0.95))).alias("p"))
    score = clipped((F.col("mean") - F.col("p")[0]) / F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(1e-9)), 0.0, 1.0)
    return rolled_out(cores.select("media_id", "span", "first", "last", score.alias("score")), signal, media, fps)


def by_motion(signal: DataFrame, quiet: DataFrame, durations: DataFrame, fps: float, coverage: DataFrame | None = None, **settings: float) -> DataFrame:
    """Intervals (media_id, rally_id, start, end, score) in which somebody moves, between the quiet stretches of a motion signal.

    A span between two stretches shrinks to its longest clump of samples above p20 + (p95 - p20) / 4 of the medium
    (at most 0.35 s apart); it must last a core and hold such samples to 35 %. Its score is how far its mean stands
    between its own 20th and 95th percentile. Ends of spans and clumps need a sample of coverage (media_id, idx,
    value) of 0.5 or more within 0.75 s; a medium of a coverage without any gives nothing. durations: (media_id, duration).
    A medium without quiet stretches gives nothing. settings: those of SETTINGS.
    """
    media = settled(lengths(signal).join(durations, "media_id"), **settings)
    return cut_by_motion(signal, marked(quiet, **settings), media, fps, coverage).drop("param_id")


def lengths(signal: DataFrame) -> DataFrame:
    """(media_id, n): a medium's samples, up to its last."""
    return signal.groupBy("media_id").agg((F.max("idx") + 1).cast("long").alias("n"))


def marked(quiet: DataFrame, **settings: float) -> DataFrame:
    """quiet with the settings that it was found with."""
    return quiet.withColumns({k: F.lit(float(settings.get(k, SETTINGS[k]))) for k in ("apart", "ratio")})


def by_activity(signal: DataFrame, quiet: DataFrame, durations: DataFrame, fps: float, **settings: float) -> DataFrame:
    """Intervals (media_id, rally_id, start, end, score) of activity, between the quiet stretches of its signal.

    A span shrinks to its longest clump of samples above p20 + 0.3 (p95 - p20) of the medium (at most 0.8 s apart),
    which must last a core; its score is how far its mean stands between these percentiles. Media of under two
    seconds or eight samples give nothing. settings: those of SETTINGS; there is no rest.
    """
    levels = cut(spread(signal, 0.2, 0.95))
    media = settled(lengths(signal).where(F.col("n") >= max(8, int(fps * 2))).join(durations, "media_id"), **settings)
    spans = with_settings(between_quiet(marked(quiet, **settings), media, fps, False), media, "core").where(F.col("hi") - F.col("lo") >= F.greatest(F.lit(1), F.floor(F.col("core") * fps)))
    live = signal.join(levels, "media_id").where(F.col("value") >= F.col("base") + 0.3 * F.col("width")).select("media_id", "idx")
    tight = with_settings(longest_clumps(spans, live, max(1, round(0.8 * fps))), media, "core").where((F.col("last") - F.col("first")) / fps >= F.col("core"))
    inside = samples_in(tight.select("media_id", "span", "first", "last", F.col("first").alias("lo"), (F.col("last") + 1).alias("hi")), signal)
    cores = inside.groupBy("media_id", "span", "first", "last").agg(F.avg("value").alias("mean")).join(levels, "media_id")
    score = clipped((F.col("mean") - F.col("base")) / F.col("width"), 0.0, 1.0)
    return rolled_out(cores.select("media_id", "span", "first", "last", score.alias("score")), signal, media, fps).drop("param_id")


def sample_range(start: Column, end: Column, n: Column, fps: float) -> list[Column]:
    """(lo, hi) of the samples of a window, at least one."""
    lo = F.greatest(F.lit(0), F.least(n - 1, (start * fps).cast("long")))
    return [lo.alias("lo"), F.greatest(lo + 1, F.least(n, (end * fps).cast("long"))).alias("hi")]


def elementary(sets: list[DataFrame], media: DataFrame, least: float) -> DataFrame:
    """(media_id, span, w0, w1): the windows between neighbouring ends of the intervals of all sets, 0 and the medium's end; those shorter than least go."""
    marks = media.select("media_id", F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("w0"))
    for one in sets:
        marks = marks.union(one.select("media_id", F.explode(F.array("start", "end")).alias("w0")))
    order = W.partitionBy("media_id").orderBy("w0")
    marks = marks.distinct().withColumn("w1", F.lead("w0").over(order)).withColumn("span", F.row_number().over(order))
    return marks.where(F.col("w1") - F.col("w0") >= least).select("media_id", "span", "w0", "w1")


def longest_at(windows: DataFrame, intervals: DataFrame, width: float) -> DataFrame:
    """(media_id, span, start, end, score): the longest interval at each window's middle, of equal ones the first. width: of the join's bins."""
    mid = windows.select("media_id", "span", ((F.col("w0") + F.col("w1")) / 2).alias("mid")).withColumn("bin", F.floor(F.col("mid") / width))
    found = mid.join(binned(intervals.select("media_id", "rally_id", "start", "end", "score"), width), ["media_id", "bin"]).where("start <= mid and mid < end")
    best = found.groupBy("media_id", "span").agg(F.max(F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("s"), (-F.col("rally_id")).alias("r"), "end", "score")).alias("b"))
    return best.select("media_id", "span", (-F.col("b.s")).alias("start"), "b.end", "b.score")


def chosen_windows(seen: DataFrame, active: DataFrame, media: DataFrame, fps: float, width: float, coverage: DataFrame | None = None, motion: DataFrame | None = None, least: float = 0.2) -> DataFrame:
    """(media_id, span, w0, w1, source, start, end, score): each elementary window of two segmentations and the interval that it takes.

    media: (media_id, n, duration). Where half of a window's samples of coverage are above 0.5 (all, without one),
    `seen` decides, source player_motion; if it has nothing there, but the motion signal a clump of 1.2 s above p20 + (p95 - p20) / 4,
    to 35 % at least and with holes of 0.35 s at most, active does (rescued). Elsewhere active decides
    (activity_valleys). Windows for which the one that decides has no interval are empty.
    """
    windows = cut(elementary([seen, active], media, least))
    spans = windows.join(media.select("media_id", "n"), "media_id").select("media_id", "span", *sample_range(F.col("w0"), F.col("w1"), F.col("n"), fps))
    rows = windows
    if coverage is None:
        rows = rows.withColumn("valid", F.lit(True))
    else:
        share = samples_in(spans, coverage).groupBy("media_id", "span").agg((F.avg((F.col("value") > 0.5).cast("double")) >= 0.5).alias("valid"))
        rows = rows.join(share, ["media_id", "span"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    mine = longest_at(windows, seen, width).select("media_id", "span", F.struct("start", "end", "score").alias("mine"))
    theirs = longest_at(windows, active, width).select("media_id", "span", F.struct("start", "end", "score").alias("theirs"))
    rows = cut(rows.join(mine, ["media_id", "span"], "left").join(theirs, ["media_id", "span"], "left"))
    if motion is None:
        rows = rows.withColumn("moved", F.lit(False))
    else:
        asked = spans.join(rows.where("valid and mine is null").select("media_id", "span"), ["media_id", "span"], "left_semi")
        moving = motion.join(spread(motion, 0.2, 0.95), "media_id").where(F.col("value") >= F.col("base") + 0.25 * F.col("width")).select("media_id", "idx")
        long = (F.col("last") - F.col("first") >= 1.2 * fps) & (F.col("n") / (F.col("last") - F.col("first") + 1) >= 0.35)
        bursts = clumps(asked, moving, max(1, round(0.35 * fps))).where(long).select("media_id", "span").distinct()
        rows = rows.join(bursts.withColumn("moved", F.lit(True)), ["media_id", "span"], "left").withColumn("moved", F.coalesce("moved", F.lit(False)))
    source = F.when(~F.col("valid"), "activity_valleys").when(F.col("mine").isNotNull(), "player_motion").when(F.col("moved"), "rescued")
    taken = F.when(source == "player_motion", F.col("mine")).when(source.isNotNull(), F.col("theirs"))
    rows = rows.withColumn("taken", taken).withColumn("source", F.when(F.col("taken").isNull(), "empty").otherwise(source))
    return rows.select("media_id", "span", "w0", "w1", "source", F.greatest("w0", "taken.start").alias("start"), F.least("w1", "taken.end").alias("end"), "taken.score")


def by_availability(seen: DataFrame, active: DataFrame, media: DataFrame, fps: float, width: float, coverage: DataFrame | None = None, motion: DataFrame | None = None, gap: float = 0.3, least: float = 1.0) -> DataFrame:
    """(media_id, start, end, score): what the windows of chosen_windows take, joined where less than gap apart; what is shorter than least goes.

    In a medium that one segmentation has no intervals in, those of the other stay as they are.
    """
    both = cut(seen.select("media_id").distinct().join(active.select("media_id").distinct(), "media_id"))
    mixed = chosen_windows(seen.join(both, "media_id", "left_semi"), active.join(both, "media_id", "left_semi"), media.join(both, "media_id", "left_semi"), fps, width, coverage, motion)
    taken = mixed.where("source <> 'empty'").select("media_id", F.col("span").alias("rally_id"), "start", "end", F.col("score").alias("confidence"))
    merged = join_abutting(taken, gap).where(F.col("end") - F.col("start") >= least).select("media_id", "start", "end", F.col("confidence").alias("score"))
    alone = seen.union(active.select(seen.columns)).join(both, "media_id", "left_anti")
    return merged.union(alone.select("media_id", "start", "end", "score"))
