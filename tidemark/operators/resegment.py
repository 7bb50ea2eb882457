"""Cutting stored signals anew: evidence of motion and hits, the best of several segmentations, their finishing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import segmentation as sg
from tidemark.operators import series as se
from tidemark.operators.intervals import join_abutting
from tidemark.operators.kernels import cut_overlaps, quiet_spans
from tidemark.operators.labels import segment_quality
from tidemark.operators.lineage import cut
from tidemark.operators.spans import anchored, from_segments

#: By how much a hybrid choice must find activity better than motion.
AHEAD = 0.05


def hit_density(hits: DataFrame, media: DataFrame, fps: float, window: float = 2.0, least_confidence: float = 0.15) -> DataFrame:
    """(media_id, idx, value): how many hits (media_id, t, confidence) each sample of media (media_id, n) has around it, between its percentiles.

    Hits surer than least_confidence count, all of a medium that has none such; media without hits have no rows.
    """
    sure = F.col("confidence") >= least_confidence
    kept = hits.withColumn("some", F.max(sure).over(W.partitionBy("media_id"))).where(sure | ~F.coalesce("some", F.lit(False)))
    at = kept.join(media.select("media_id", "n"), "media_id").select("media_id", F.least(F.greatest(F.bround(F.col("t") * fps).cast("long"), F.lit(0)), F.col("n") - 1).alias("idx"))
    counts = at.groupBy("media_id", "idx").agg(F.count("*").cast("double").alias("value"))
    grid = media.join(at.select("media_id").distinct(), "media_id", "left_semi").select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx"))
    rows = grid.join(counts, ["media_id", "idx"], "left").select("media_id", "idx", F.coalesce("value", F.lit(0.0)).alias("value"))
    smooth = cut(se.smooth(rows, max(1, round(window * fps))).select("media_id", "idx", F.col("smooth").alias("value")))
    return se.robust_norm(smooth).select("media_id", "idx", F.col("norm").alias("value"))


def joint_evidence(motion: DataFrame, density: DataFrame, weight: float = 0.7) -> DataFrame:
    """(media_id, idx, value): motion where hits are dense, each between its percentiles; motion alone in media whose density is nothing but zeros or missing."""
    p = se.robust_norm(motion).select("media_id", "idx", F.col("norm").alias("p"))
    h = se.robust_norm(density).select("media_id", "idx", F.col("norm").alias("h"))
    heard = density.groupBy("media_id").agg((F.max("value") > 0).alias("heard"))
    rows = p.join(h, ["media_id", "idx"], "left").join(heard, "media_id", "left").withColumn("heard", F.coalesce("heard", F.lit(False)))
    rows = cut(rows)
    both = rows.where("heard").select("media_id", "idx", (F.col("p") * ((1 - weight) + weight * F.coalesce("h", F.lit(0.0)))).alias("value"))
    return se.robust_norm(both).select("media_id", "idx", F.col("norm").alias("value")).union(rows.where("not heard").select("media_id", "idx", F.col("p").alias("value")))


def dispatched(candidates: list[tuple[str, DataFrame]], density: DataFrame | None, fps: float, hybrid: bool = False) -> DataFrame:
    """(media_id, method, quality, rally_id, start, end, score): of each medium the candidate, a name and segments, of the best quality, the first of equal ones.

    Hybrid, the last candidate is taken only if it is AHEAD of the first; there are two.
    """
    rows = None
    for place, (name, segments) in enumerate(candidates):
        one = segments.select("media_id", "rally_id", "start", "end", "score").withColumns({"method": F.lit(name), "place": F.lit(place)})
        rows = one if rows is None else rows.union(one)
    rows = cut(rows)
    found = segment_quality(rows.withColumnRenamed("score", "confidence"), ("media_id", "method", "place"), density, fps)
    better = F.col("quality") - F.when(F.col("place") > 0, AHEAD + 1e-12).otherwise(0.0) if hybrid else F.col("quality")
    best = found.withColumn("nth", F.row_number().over(W.partitionBy("media_id").orderBy(F.desc(better), "place"))).where("nth = 1").select("media_id", "method", "quality")
    return rows.drop("place").join(best, ["media_id", "method"])


def finished(intervals: DataFrame, hits: DataFrame, media: DataFrame, limit: float, width: float, least: float, pre: float, post: float, tail: float = 0.9) -> DataFrame:
    """(media_id, start, end, n, confidence) of intervals (media_id, rally_id, start, end, confidence, method) of media (media_id, duration).

    In media with hits the ends go to the hits (anchored), starts of player_motion only outward; elsewhere only
    those of the state machine are padded. Then overlaps are cut, intervals shorter than least go, and those less than 0.3 apart
    join. n: how many went into each.
    """
    heard = hits.select("media_id").distinct()
    mine = intervals.join(heard, "media_id", "left_semi")
    at = lambda which, trim: anchored(mine.where(which), hits, limit, width, pre, post, tail, trim).select("media_id", "rally_id", "start", "end")
    rows = at("method = 'player_motion'", False).union(at("method <> 'player_motion'", True))
    still = intervals.join(heard, "media_id", "left_anti").join(media.select("media_id", "duration"), "media_id")
    tight = F.col("method") == "activity_state_machine"
    rows = rows.union(still.select("media_id", "rally_id", F.when(tight, F.greatest(F.lit(0.0), F.col("start") - pre)).otherwise(F.col("start")), F.when(tight, F.least("duration", F.col("end") + post)).otherwise(F.col("end"))))
    rows = cut_overlaps(rows, hits).where(F.col("end") - F.col("start") >= least)
    return join_abutting(rows.join(intervals.select("media_id", "rally_id", "confidence"), ["media_id", "rally_id"]), 0.3).select("media_id", "start", "end", "n", "confidence")


def resegmented(motion: DataFrame, activity: DataFrame, hits: DataFrame, media: DataFrame, fps: float, limit: float, width: float, coverage: DataFrame | None = None, fallback: DataFrame | None = None, hybrid: bool = False, **settings: float) -> DataFrame:
    """(media_id, start, end, n, confidence, method) from stored signals (media_id, idx, value), hits (media_id, hit_idx, t, strength, confidence) and media (media_id, n, duration).

    Motion together with the density of hits gives intervals (player_motion), activity others (activity_valleys),
    and in media without hits both by availability a third kind; the best by quality is taken and finished. Media of which none has
    any take the fallback's intervals (media_id, rally_id, start, end, score; activity_state_machine). What is read
    more than once is written between the steps.
    """
    o = sg.SETTINGS | settings
    density = cut(hit_density(hits, media, fps))
    evidence = cut(joint_evidence(motion, density))
    durations = media.select("media_id", "duration")
    quiet = lambda x: quiet_spans(x, fps, o["apart"], 0.0, o["ratio"])
    seen = cut(sg.by_motion(evidence, cut(quiet(evidence)), durations, fps, coverage, **settings))
    active = cut(sg.by_activity(activity, cut(quiet(activity)), durations, fps, **settings))
    candidates = [("player_motion", seen)]
    if not hybrid and coverage is not None:
        silent = lambda x: x.join(density.select("media_id").distinct(), "media_id", "left_anti")
        both = silent(seen.select("media_id").distinct()).join(active.select("media_id").distinct(), "media_id")
        some = lambda x: x.join(both, "media_id", "left_semi")
        merged = sg.by_availability(some(seen), some(active), some(media), fps, width, coverage, motion)
        merged = merged.withColumn("rally_id", F.row_number().over(W.partitionBy("media_id").orderBy("start", "end")).cast("long"))
        candidates.append(("player_motion+activity", cut(merged)))
    chosen = cut(dispatched([*candidates, ("activity_valleys", active)], density, fps, hybrid))
    methods = chosen.select("media_id", "method").distinct()
    rows = from_segments(chosen.select("media_id", "rally_id", "start", "end", "score")).withColumnRenamed("group", "rally_id").join(methods, "media_id")
    rows = rows.select("media_id", F.col("rally_id").cast("long").alias("rally_id"), "start", "end", "confidence", "method")
    if fallback is not None:
        rows = rows.union(fallback.join(methods, "media_id", "left_anti").select("media_id", "rally_id", "start", "end", "score", F.lit("activity_state_machine")))
    rows = cut(rows)
    out = finished(rows, hits, media, limit, width, o["least"], o["pre"], o["post"])
    return out.join(rows.select("media_id", "method").distinct(), "media_id")
