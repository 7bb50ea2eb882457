"""Intervals (media_id, rally_id, start, end): merging, matching, events in them, placement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Samples of a bin in which samples meet intervals: about as many as a short interval has. Wider ones pair each sample with all intervals near it, narrower ones repeat long intervals.
SPAN = 64


def run():
    return W.partitionBy("media_id").orderBy("start", "rally_id")


def join_abutting(intervals: DataFrame, gap: float) -> DataFrame:
    """Islands of intervals that begin less than gap after the latest end so far."""
    latest = F.max("end").over(run().rowsBetween(W.unboundedPreceding, -1))
    flagged = intervals.withColumn("new", F.when(F.col("start") - latest < gap, 0).otherwise(1))
    named = flagged.withColumn("island", F.sum("new").over(run().rowsBetween(W.unboundedPreceding, 0)))
    return named.groupBy("media_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def binned(intervals: DataFrame, width: float, lo: str = "start", hi: str = "end") -> DataFrame:
    """One row for each bin of time that an interval touches: the equi-key of a range join. width: about an interval's length."""
    return intervals.withColumn("bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def overlaps(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """Pairs of intervals of a medium that overlap: rally_id of a, other_id of b, overlap, iou. Each pair comes from the first bin that both touch."""
    other = binned(b.select("media_id", F.col("rally_id").alias("other_id"), F.col("start").alias("s"), F.col("end").alias("e")), width, "s", "e")
    both = binned(a.select("media_id", "rally_id", "start", "end"), width).join(other, ["media_id", "bin"])
    both = both.where(F.col("bin") == F.floor(F.greatest("start", "s") / width))
    over = F.least("end", "e") - F.greatest("start", "s")
    out = both.withColumn("overlap", over).where("overlap > 0")
    return out.withColumn("iou", F.col("overlap") / (F.greatest("end", "e") - F.least("start", "s")))


def best_overlap(a: DataFrame, b: DataFrame, width: float) -> DataFrame:
    """For each interval of a the one of b that it overlaps most, if by half of its length; of equal ones the least id."""
    best = overlaps(a, b, width).groupBy("media_id", "rally_id", "start", "end").agg(F.max(F.struct("overlap", (-F.col("other_id")).alias("back"))).alias("m"))
    kept = best.where(F.col("m.overlap") >= 0.5 * F.greatest(F.lit(0.1), F.col("end") - F.col("start")))
    return kept.select("media_id", "rally_id", (-F.col("m.back")).alias("other_id"), F.col("m.overlap").alias("overlap"))


def hits_in_window(intervals: DataFrame, hits: DataFrame, before: float, after: float, width: float) -> DataFrame:
    """(media_id, rally_id, n, strongest): hits in an interval's window, which its neighbours bound; where they cross, their midpoint."""
    lo = F.greatest(F.col("start") - before, F.coalesce(F.lag("end").over(run()), F.lit(float("-inf"))))
    hi = F.least(F.col("end") + after, F.coalesce(F.lead("start").over(run()), F.lit(float("inf"))))
    framed = intervals.withColumn("lo", lo).withColumn("hi", hi)
    mid = (F.col("lo") + F.col("hi")) / 2
    crossed = F.col("hi") < F.col("lo")
    framed = framed.select("media_id", "rally_id", F.when(crossed, mid).otherwise(F.col("lo")).alias("lo"), F.when(crossed, mid).otherwise(F.col("hi")).alias("hi"))
    found = hits.withColumn("bin", F.floor(F.col("t") / width)).join(binned(framed, width, "lo", "hi"), ["media_id", "bin"]).where("t >= lo and t <= hi")
    counted = found.groupBy("media_id", "rally_id").agg(F.count("*").alias("n"), F.max("strength").alias("strongest"))
    return framed.select("media_id", "rally_id").join(counted, ["media_id", "rally_id"], "left").select("media_id", "rally_id", F.coalesce("n", F.lit(0)).alias("n"), "strongest")


def nearest(points: DataFrame, labels: DataFrame, tolerance: float) -> DataFrame:
    """For each point (media_id, hit_idx, t) the nearest label (media_id, label_idx, u) within tolerance, if any; of equal ones the later."""
    at = F.floor(F.col("t") / tolerance)
    near = labels.withColumn("b", F.floor(F.col("u") / tolerance)).select("media_id", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("bin"), "label_idx", "u")
    pairs = points.withColumn("bin", at).join(near, ["media_id", "bin"]).withColumn("dt", F.abs(F.col("t") - F.col("u"))).where(F.col("dt") <= tolerance)
    best = pairs.groupBy("media_id", "hit_idx").agg(F.min(F.struct("dt", (-F.col("u")).alias("v"), (-F.col("label_idx")).alias("back"))).alias("m"))
    return best.select("media_id", "hit_idx", (-F.col("m.back")).alias("label_idx"), F.col("m.dt").alias("dt"))


def placed(intervals: DataFrame, pre: float, post: float, gap: float) -> DataFrame:
    """Intervals one after another on a medium's film, each padded and gap apart: (media_id, rally_id, src_in, src_out, tl_start)."""
    src_in = F.greatest(F.lit(0.0), F.least(F.col("start") - pre, F.col("end")))
    rows = intervals.withColumn("src_in", src_in).withColumn("src_out", F.greatest(F.col("src_in") + 0.2, F.col("end") + post))
    order = W.partitionBy("media_id").orderBy("src_in", "rally_id").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("src_out") - F.col("src_in") + gap).over(order), F.lit(0.0))
    return rows.select("media_id", "rally_id", "src_in", "src_out", at.alias("tl_start"))


def prf(tp, fp, fn):
    """Precision, recall and F1 columns; 0 where undefined."""
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
