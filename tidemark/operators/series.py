"""Windows over a regular signal (media_id, idx, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def key():
    return W.partitionBy("media_id")


def run():
    return key().orderBy("idx")


def whole():
    return run().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def smooth(df: DataFrame, width: int, out: str = "smooth") -> DataFrame:
    """Moving average whose edges repeat the first and last value; an even width reaches further back."""
    left, right = width // 2, width - 1 - width // 2
    n = F.count("*").over(key())
    missing_left = F.greatest(F.lit(0), left - F.col("idx"))
    missing_right = F.greatest(F.lit(0), right - (n - 1 - F.col("idx")))
    inner = F.sum("value").over(run().rowsBetween(-left, right))
    return df.withColumn(out, (inner + missing_left * F.first("value").over(whole()) + missing_right * F.last("value").over(whole())) / width)


def same_mean(df: DataFrame, width: int, out: str = "same") -> DataFrame:
    """Mean of a centred window, zeros beyond the edges."""
    return df.withColumn(out, F.sum("value").over(run().rowsBetween(-(width // 2), (width - 1) // 2)) / width)


def spread(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """(media_id, base, width): a percentile of each medium, and how far the higher one is above it (at least 1e-9)."""
    ends = df.groupBy("media_id").agg(F.percentile("value", F.array(F.lit(lo), F.lit(hi))).alias("p"))
    return ends.select("media_id", F.col("p")[0].alias("base"), F.greatest(F.col("p")[1] - F.col("p")[0], F.lit(1e-9)).alias("width"))


def robust_norm(df: DataFrame, lo: float = 0.05, hi: float = 0.95, out: str = "norm") -> DataFrame:
    """Clipped to [0, 1] between two percentiles of the medium; a flat signal is 0. The percentiles are aggregated, not windowed."""
    ends = df.groupBy("media_id").agg(F.percentile("value", F.lit(lo)).alias("p_lo"), F.percentile("value", F.lit(hi)).alias("p_hi"))
    span = F.col("p_hi") - F.col("p_lo")
    norm = F.when(span < 1e-9, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - F.col("p_lo")) / span)))
    return df.join(ends, "media_id").withColumn(out, norm).drop("p_lo", "p_hi")


def roll_mean(df: DataFrame, width: int, forward: bool, out: str) -> DataFrame:
    """Mean of [idx, idx + width) or of [idx - width, idx), shorter at the edges; of nothing, 0."""
    frame = run().rowsBetween(0, width - 1) if forward else run().rowsBetween(-width, -1)
    return df.withColumn(out, F.coalesce(F.avg("value").over(frame), F.lit(0.0)))


def extent(df: DataFrame, half: int) -> DataFrame:
    frame = run().rowsBetween(-half, half)
    return df.withColumn("lowest", F.min("value").over(frame)).withColumn("highest", F.max("value").over(frame))


def slope(df: DataFrame, width: int, lag: int, fps: float) -> DataFrame:
    """Change of the smoothed signal over lag samples, a second; 0 for the first lag ones."""
    out = smooth(df, width)
    return out.withColumn("slope", F.coalesce((F.col("smooth") - F.lag("smooth", lag).over(run())) / (lag / fps), F.lit(0.0)))


def decay(df: DataFrame, rate: float, out: str = "decayed") -> DataFrame:
    """y[i] = max(x[i], rate * y[i - 1]) of x >= 0, in closed form: a running maximum of ln x - i ln rate."""
    lifted = F.when(F.col("value") > 0, F.ln("value") - F.col("idx") * math.log(rate))
    top = F.max(lifted).over(run().rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(out, F.coalesce(F.exp(top + F.col("idx") * math.log(rate)), F.lit(0.0)))


def hysteresis(df: DataFrame, lo: float, hi: float, out: str = "on") -> DataFrame:
    """On from a value >= hi until one < lo: the last sample that decides. Only where lo <= hi."""
    if lo > hi:
        raise ValueError("lo must not be above hi")
    says = F.when(F.col("value") >= hi, 1).when(F.col("value") < lo, 0)
    return df.withColumn(out, F.coalesce(F.last(says, ignorenulls=True).over(run().rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))


def runs(df: DataFrame, flag: str) -> DataFrame:
    """(media_id, first, last, n): the runs of samples whose flag is 1."""
    island = F.col("idx") - F.row_number().over(run())
    return df.where(F.col(flag) == 1).withColumn("island", island).groupBy("media_id", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).drop("island")


def fill(df: DataFrame, column: str, out: str = "filled") -> DataFrame:
    """Nulls by linear interpolation on idx, the ends by the nearest value."""
    back, ahead = (order.rowsBetween(W.unboundedPreceding, 0) for order in (run(), key().orderBy(F.desc("idx"))))  # a frame that only grows is one pass; one that shrinks is read anew at each row
    at = F.when(F.col(column).isNotNull(), F.struct("idx", F.col(column).alias("v")))
    a, b = F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(ahead)
    line = a["v"] + (b["v"] - a["v"]) * (F.col("idx") - a["idx"]) / (b["idx"] - a["idx"])
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.coalesce(line, a["v"], b["v"])))


def resample(df: DataFrame, src_fps: float, dst_fps: float) -> DataFrame:
    """The signal read at idx / dst_fps by linear interpolation. Each sample makes the points from it up to the next one, so nothing is joined; points whose neighbours are missing drop out."""
    ratio, order = src_fps / dst_fps, run()
    rows = df.select("media_id", "idx", "value", F.max("idx").over(key()).alias("top"), F.lead("idx").over(order).alias("after"), F.lead("value").over(order).alias("next"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.floor(F.col("idx") / ratio).cast("int") - 1, F.ceil((F.col("idx") + 1) / ratio).cast("int") + 1)))
    rows = rows.withColumn("p", F.least(F.col("i") * ratio, F.col("top").cast("double")))
    rows = rows.where((F.col("i") >= 0) & (F.col("i") < F.floor((F.col("top") + 1) * (dst_fps / src_fps))) & (F.floor("p") == F.col("idx")))
    rows = rows.where((F.col("idx") == F.col("top")) | (F.col("after") == F.col("idx") + 1))
    return rows.select("media_id", "i", (F.col("value") + (F.coalesce("next", "value") - F.col("value")) * (F.col("p") - F.col("idx"))).alias("value"))


def pooled(df: DataFrame, step: int) -> DataFrame:
    return df.groupBy("media_id", F.floor(F.col("idx") / step).alias("block")).agg(F.avg("value").alias("mean"))


def subsample(df: DataFrame, most: int) -> DataFrame:
    """At most most samples of each medium, evenly spread, first and last among them."""
    if most < 2:
        return df.where("idx = 0")
    rows, n = df.withColumn("n", F.count("*").over(key())), F.col("n")
    nth = lambda i: F.floor(i * (n - 1) / (most - 1))
    k = F.ceil(F.col("idx") * (most - 1) / F.greatest(n - 1, F.lit(1)))
    return rows.where((n <= most) | (nth(k) == F.col("idx"))).drop("n")


def discrimination(df: DataFrame) -> DataFrame:
    """How far the upper half of a signal's spread is its larger part, in [0.05, 1]; short signals 0.35, flat ones 0.05."""
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy("media_id").agg(F.count("*").alias("n"), p.alias("p"))
    span = F.col("p")[2] - F.col("p")[0]
    power = F.least(F.lit(1.0), F.greatest(F.lit(0.05), ((F.col("p")[2] - F.col("p")[1]) / span - 0.42) / 0.45))
    return out.select("media_id", F.when(F.col("n") < 32, 0.35).when(span < 1e-9, 0.05).otherwise(power).alias("power"))


def clipped(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))
