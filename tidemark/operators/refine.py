"""Moving the ends of intervals to the bottoms of quiet stretches nearby, where evidence bears it out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import series as se
from tidemark.operators.evidence import CHANNELS, packing
from tidemark.operators.intervals import binned
from tidemark.operators.kernels import walked

#: What a channel must reach of its range to fire; how many must.
FIRES, LEAST_CHANNELS = 0.5, 2


def joint_scores(channels: DataFrame, hits: DataFrame | None, ranges: dict[str, tuple[float, float]], weights: dict[str, float]) -> DataFrame:
    """(media_id, idx, other columns, score, fires) of the channels (media_id, idx, ...) and the hit feature (media_id, idx, hit; none: 0); without hits, the channels have it.

    The score is the mean of all channels over their ranges by weight; fires counts those of positive weight that
    reach half of their range. Without weights both are 0.
    """
    rows = channels if hits is None else channels.join(hits, ["media_id", "idx"], "left")
    rows = rows.withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    motion = sum(max(0.0, weights.get(c, 0.0)) for c in CHANNELS)
    total = motion + max(0.0, weights.get("hit", 0.0))

    def part(c: str) -> Column:
        lo, hi = ranges.get(c, (0.0, 1.0))
        return se.clipped((F.col(c) - lo) / (hi - lo), 0.0, 1.0) if hi - lo > 1e-9 else F.lit(0.0)

    fires = [F.when(part(c) >= FIRES, 1).otherwise(0) for c in (*CHANNELS, "hit") if weights.get(c, 0.0) > 1e-9]
    score = se.clipped((packing(ranges, weights) * motion + part("hit") * (total - motion)) / total, 0.0, 1.0) if total > 1e-9 else F.lit(0.0)
    others = [c for c in channels.columns if c not in ("media_id", "idx", "hit", *CHANNELS)]
    return rows.select("media_id", "idx", *others, score.alias("score"), (sum(fires[1:], fires[0]) if fires else F.lit(0)).alias("fires"))


def well_covered(coverage: DataFrame, fps: float) -> DataFrame:
    """coverage (media_id, idx, value, other columns) with `covered` in place of value: whether half of the samples within half a second are 0.5 or more."""
    w = max(1, round(0.5 * fps))
    share = F.avg((F.col("value") >= 0.5).cast("double")).over(se.run().rowsBetween(-w, w))
    return coverage.withColumn("covered", share >= 0.5).drop("value")


def moves(intervals: DataFrame, valleys: DataFrame, evidence: DataFrame, media: DataFrame, fps: float, reach: float, margin: float, thresholds: dict[str, float], least: float = 0.5) -> DataFrame:
    """(media_id, rally_id, side, bottom, score, gain): the valleys that an end of an interval may move to, its neighbours and own moves aside.

    They lie within reach seconds and the medium, at least `least` from the interval's other end; their score is the side's
    threshold or more, above the present one by the margin, two channels fire there and it is covered.
    intervals: (media_id, rally_id, start, end); valleys: (media_id, bottom); evidence: (media_id, side, idx, score,
    fires, covered); media: (media_id, n, duration).
    """
    rows = intervals.select("media_id", "rally_id", "start", "end").join(media.select("media_id", "n", "duration"), "media_id")
    side = lambda s, at, lo, hi: F.struct(F.lit(s).alias("side"), at.alias("at"), lo.alias("lo"), hi.alias("hi"), F.lit(float(thresholds[s])).alias("least"))
    low, high = (lambda c: F.greatest(F.lit(0.0), F.col(c) - reach)), (lambda c: F.least(F.col("duration"), F.col(c) + reach))
    rows = rows.withColumn("s", F.explode(F.array(side("start", F.col("start"), low("start"), F.least(high("start"), F.col("end") - least)), side("end", F.col("end"), low("end"), high("end")))))
    rows = rows.select("media_id", "rally_id", "n", "s.*").where("hi > lo")
    frame = lambda c: F.bround(F.col(c) * fps).cast("long")
    rows = rows.withColumns({"lo": frame("lo"), "hi": frame("hi"), "now": F.least(F.greatest(frame("at"), F.lit(0)), F.col("n") - 1)})
    width = max(1, int(2 * reach * fps))
    found = binned(rows, width, "lo", "hi").join(valleys.select("media_id", F.col("bottom"), F.floor(F.col("bottom") / width).alias("bin")).distinct(), ["media_id", "bin"]).where("bottom between lo and hi and bottom <> now")
    there = evidence.where((F.col("fires") >= LEAST_CHANNELS) & F.col("covered")).select("media_id", "side", F.col("idx").alias("bottom"), "score")
    here = evidence.select("media_id", "side", F.col("idx").alias("now"), F.col("score").alias("before"))
    found = found.join(there, ["media_id", "side", "bottom"]).join(here, ["media_id", "side", "now"])
    return found.where((F.col("score") >= F.col("least")) & (F.col("score") >= F.col("before") + margin)).select("media_id", "rally_id", "side", "bottom", "score", (F.col("score") - F.col("before")).alias("gain"))


def refined(intervals: DataFrame, valleys: DataFrame, evidence: DataFrame, media: DataFrame, fps: float, reach: float = 3.0, margin: float = 0.12, thresholds: dict[str, float] | None = None, least: float = 0.5, least_pose: float = 0.35) -> DataFrame:
    """(media_id, rally_id, start, end, start_gain, end_gain): each interval with its ends moved to the best valley that may take them (moves), and by how much the score rose; null where an end stays.

    Intervals come by start and id, their starts before their ends; a start doesn't pass the end of the one before
    as it has been moved, nor an end the start of the one after, and an interval keeps `least` seconds. Of equal scores the
    first valley counts. Intervals further apart than twice the reach don't meet, so each chain of nearer ones is
    walked by itself; chains without a move aren't walked. media: (media_id, n, duration, pose), pose being the
    share of time with poses; media below least_pose stay as they are. Nothing moves without evidence.
    """
    sides = thresholds or {"start": 0.55, "end": 0.55}
    able = media.where(F.col("pose") >= least_pose)
    found = moves(intervals, valleys, evidence, able, fps, reach, margin, sides, least)
    lists = found.groupBy("media_id", "rally_id").agg(*(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("bottom", "score", "gain")))).alias(f"{s}s") for s in ("start", "end")))
    order = W.partitionBy("media_id").orderBy("start", "rally_id")
    rows = intervals.select("media_id", "rally_id", "start", "end").withColumns({"before": F.lag("end").over(order), "after": F.lead("start").over(order)})
    new = F.when(F.col("start") - F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)) > 2 * reach, 1).otherwise(0)
    rows = rows.withColumn("new", new).withColumn("chain", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")
    rows = rows.join(lists, ["media_id", "rally_id"], "left").join(media.select("media_id", "duration"), "media_id", "left")
    rows = rows.withColumn("movable", F.max(F.coalesce(F.size("starts") + F.size("ends"), F.lit(0))).over(W.partitionBy("media_id", "chain")) > 0)

    def walk(c, lo, hi):
        end = None
        frame = lambda t: round(t * fps)
        best = lambda options, lo, hi: max((o for o in options if frame(lo) <= o["bottom"] <= frame(hi)), key=lambda o: (o["score"], -o["bottom"]), default=None) if hi > lo else None
        listed = lambda x: x if x is not None and not isinstance(x, float) else []
        for i in range(lo, hi):
            a, b, duration, gains = float(c["start"][i]), float(c["end"][i]), float(c["duration"][i]), [None, None]
            before = end if i > lo else (0.0 if np.isnan(c["before"][i]) else float(c["before"][i]))
            if o := best(listed(c["starts"][i]), max(0.0, a - reach, before), min(duration, a + reach, b - least)):
                a, gains[0] = round(o["bottom"] / fps, 3), o["gain"]
            after = duration if np.isnan(c["after"][i]) else float(c["after"][i])
            if o := best(listed(c["ends"][i]), max(0.0, b - reach, a + least), min(duration, b + reach, after)):
                b, gains[1] = round(o["bottom"] / fps, 3), o["gain"]
            end = b
            yield i, a, b, *gains

    none = F.lit(None).cast("double")
    moved = walked(rows.where("movable"), ("media_id", "chain"), ["start", "rally_id"], ["media_id", "rally_id"], walk, start="double", end="double", start_gain="double", end_gain="double")
    return moved.union(rows.where("not movable").select("media_id", "rally_id", "start", "end", none, none))
