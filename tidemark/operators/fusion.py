"""Several component signals (media_id, idx, name, value) combined into one activity, its thresholds and segments; gates and features of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import series as se
from tidemark.operators.intervals import binned


def weights(components: DataFrame, base: dict[str, float]) -> DataFrame:
    """(media_id, name, w) that add up to 1: base weights times 0.35 + 0.65 of how far a component tells things apart; none for one that is all zero."""
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = components.groupBy("media_id", "name").agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("top"), p.alias("p"))
    span = F.col("p")[2] - F.col("p")[0]
    power = F.when(F.col("n") < 32, 0.35).when(span < 1e-9, 0.05).otherwise(se.clipped(((F.col("p")[2] - F.col("p")[1]) / span - 0.42) / 0.45, 0.05, 1.0))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[F.col("name")], F.lit(0.0))
    out = out.withColumn("raw", F.when(F.col("top") > 1e-9, named * (0.35 + 0.65 * power)).otherwise(0.0))
    total = F.sum("raw").over(W.partitionBy("media_id"))
    return out.select("media_id", "name", F.when(total > 1e-9, F.col("raw") / total).otherwise(0.0).alias("w"))


def combined(components: DataFrame, base: dict[str, float]) -> DataFrame:
    """(media_id, idx, value): the weighted sum; 0.5 throughout where nothing weighs."""
    rows = components.join(weights(components, base), ["media_id", "name"])
    out = rows.groupBy("media_id", "idx").agg(F.sum(F.col("value") * F.col("w")).alias("v"), F.sum("w").alias("w"))
    return out.select("media_id", "idx", F.when(F.col("w") > 1e-9, F.col("v")).otherwise(0.5).alias("value"))


def thresholds(signal: DataFrame) -> DataFrame:
    """(media_id, hi, lo): max(p78, 1.25 median) and max(0.92 p55, 1.05 median)."""
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.55), F.lit(0.78)))
    out = signal.groupBy("media_id").agg(p.alias("p"))
    return out.select("media_id", F.greatest(F.col("p")[2], 1.25 * F.col("p")[0]).alias("hi"), F.greatest(0.92 * F.col("p")[1], 1.05 * F.col("p")[0]).alias("lo"))


def active_runs(signal: DataFrame, least: int, merge: int) -> DataFrame:
    """(media_id, first, last, confidence): on from a value >= hi until one < lo, runs up to merge samples apart joined, of least samples.

    Where lo is above hi, lo counts as hi. confidence: the mean value between p20 and p95 of the medium.
    """
    ends = thresholds(signal).withColumn("lo", F.least("lo", "hi"))
    rows = signal.join(ends, "media_id")
    run = W.partitionBy("media_id").orderBy("idx")
    says = F.when(F.col("value") >= F.col("hi"), 1).when(F.col("value") < F.col("lo"), 0)
    on = rows.withColumn("on", F.coalesce(F.last(says, ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))).where("on = 1")
    new = F.when(F.col("idx") - F.lag("idx").over(run) <= merge + 1, 0).otherwise(1)
    named = on.withColumn("new", new).withColumn("island", F.sum("new").over(run.rowsBetween(W.unboundedPreceding, 0)))
    out = named.groupBy("media_id", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.avg("value").alias("mean"))
    spread = signal.groupBy("media_id").agg(F.percentile("value", F.array(F.lit(0.2), F.lit(0.95))).alias("p"))
    out = out.where(F.col("last") - F.col("first") + 1 >= least).join(spread, "media_id")
    conf = se.clipped((F.col("mean") - F.col("p")[0]) / F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(1e-9)), 0.05, 1.0)
    return out.select("media_id", "first", "last", conf.alias("confidence"))


def blended(a: DataFrame, b: DataFrame, share: float) -> DataFrame:
    """(media_id, idx, value): a * (1 - share + share * b), between its 5th and 95th percentile."""
    rows = a.select("media_id", "idx", F.col("value").alias("a")).join(b.select("media_id", "idx", F.col("value").alias("b")), ["media_id", "idx"])
    mixed = rows.select("media_id", "idx", (F.col("a") * (1 - share + share * F.col("b"))).alias("value"))
    return se.robust_norm(mixed).select("media_id", "idx", F.col("norm").alias("value"))


def sliced(signal: DataFrame, intervals: DataFrame, fps: float, width: int) -> DataFrame:
    """(media_id, rally_id, n, mean, top, p90) of the samples [int(start fps), int(end fps)) of an interval, one at least. width: of the join's bins."""
    lo = F.floor(F.col("start") * fps)
    rows = intervals.withColumn("lo", lo).withColumn("hi", F.greatest(F.col("lo") + 1, F.floor(F.col("end") * fps)) - 1)
    found = signal.withColumn("bin", F.floor(F.col("idx") / width)).join(binned(rows.select("media_id", "rally_id", "lo", "hi"), width, "lo", "hi"), ["media_id", "bin"]).where("idx between lo and hi")
    return found.groupBy("media_id", "rally_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"), F.percentile("value", F.lit(0.9)).alias("p90"))


def gated(hits: DataFrame, evidence: str, threshold: float, least_keep: float = 0.12, most_keep: float = 0.97) -> DataFrame:
    """Hits whose evidence reaches the threshold; all of a medium where that keeps a share outside [least_keep, most_keep]."""
    kept = (F.coalesce(evidence, F.lit(0.0)) >= threshold).cast("double")
    shares = hits.groupBy("media_id").agg(F.avg(kept).alias("share"))
    rows = hits.join(shares, "media_id")
    return rows.where((kept == 1) | ~F.col("share").between(least_keep, most_keep)).drop("share")


def matched_swings(hits: DataFrame, swings: DataFrame, window: float) -> DataFrame:
    """(media_id, hit_idx, evidence): each hit's nearest swing (media_id, u, prominence), the earlier of two, within window; a swing counts for one hit.

    Of the hits of a swing the one with the least distance less a thousandth of its strength has it. The evidence is
    the prominence, down to half at the window's end; other hits have 0.
    """
    near = swings.withColumn("b", F.floor(F.col("u") / window)).withColumn("bin", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).drop("b")
    pairs = hits.withColumn("bin", F.floor(F.col("t") / window)).join(near, ["media_id", "bin"]).withColumn("dt", F.abs(F.col("t") - F.col("u"))).where(F.col("dt") <= window)
    best = pairs.groupBy("media_id", "hit_idx", "strength").agg(F.min(F.struct("dt", "u", "prominence")).alias("m"))
    cost = (F.col("m.dt") - 1e-3 * F.col("strength")).alias("cost")
    owner = best.groupBy("media_id", F.col("m.u").alias("u")).agg(F.min(F.struct(cost, "hit_idx", F.col("m.dt").alias("dt"), F.col("m.prominence").alias("prominence"))).alias("o"))
    given = owner.select("media_id", F.col("o.hit_idx").alias("hit_idx"), se.clipped(F.col("o.prominence") * (1 - 0.5 * F.col("o.dt") / window), 0.0, 1.0).alias("evidence"))
    return hits.select("media_id", "hit_idx").join(given, ["media_id", "hit_idx"], "left").select("media_id", "hit_idx", F.coalesce("evidence", F.lit(0.0)).alias("evidence"))


def features(hits: DataFrame, keys: list[str], streak: float) -> DataFrame:
    """Of each group of hits: shots, span, mean and p90 strength, mean confidence, tempo, its variance and that of its last third, streak, smashes.

    tempo is one over the median gap; a streak is the longest run of gaps up to streak, in hits; smashes reach the 85th
    percentile of the group's strengths. A group of one hit has no tempo, its streak is 1.
    """
    run = W.partitionBy(*keys).orderBy("t", "hit_idx")
    rows = hits.withColumn("gap", F.col("t") - F.lag("t").over(run))
    rows = rows.withColumn("run", F.sum(F.when(F.col("gap") <= streak, 0).otherwise(1)).over(run.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("length", F.count("*").over(W.partitionBy(*keys, "run")))
    rows = rows.withColumn("back", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("t"), F.desc("hit_idx")))).withColumn("all", F.count("*").over(W.partitionBy(*keys)))
    tail = F.when(F.col("back") <= F.greatest(F.lit(2), F.floor((F.col("all") - 1) / 3)), F.col("gap"))
    p85 = hits.groupBy(*keys).agg(F.percentile("strength", F.lit(0.85)).alias("p85"))
    rows = rows.join(p85, keys)
    over = lambda x: 1 / F.greatest(F.percentile(x, F.lit(0.5)), F.lit(1e-3))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("shots"), (F.max("t") - F.min("t")).alias("span"), F.avg("strength").alias("strength"), F.percentile("strength", F.lit(0.9)).alias("strength_p90"), F.avg("confidence").alias("confidence"),
        over(F.col("gap")).alias("tempo"), over(tail).alias("finish_tempo"), F.var_pop("gap").alias("tempo_variance"), F.max("length").alias("streak"), F.count_if(F.col("strength") >= F.col("p85")).alias("smashes"),
    )
