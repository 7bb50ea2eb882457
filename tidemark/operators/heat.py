"""Exponential means of long runs, and the box of the cells of a picture where most happens."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def eased(rows: DataFrame, keys: list[str], keep: float = 0.985, block: int = 256) -> DataFrame:
    """rows (keys, idx, value) with level: the first value, then keep of the level before and the rest of the value.

    A run (idx from 0 without holes) is cut into blocks that are eased by themselves; what a block ends with is told
    to the later blocks in which a double can still tell it. So no task holds a run. A null value counts as 0, an
    empty table gives no rows.
    """
    if not 0 < keep < 1:
        raise ValueError("keep must be between 0 and 1")
    fade = -math.log(keep)
    block = max(1, min(block, int(12 * math.log(10) / fade)))  # powers within a block stay within 12 digits
    reach = math.ceil(60 * math.log(2) / fade / block) + 1
    power = lambda n: F.pow(F.lit(keep), n)
    at = F.pmod("idx", F.lit(block))
    weight = F.when(F.col("idx") == 0, 1.0).otherwise(1 - keep)
    upto = W.partitionBy(*keys, "block").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    parts = rows.withColumn("block", F.floor(F.col("idx") / block))
    parts = parts.withColumn("own", F.sum(F.coalesce("value", F.lit(0.0)) * weight * power(-at)).over(upto) * power(at))
    ends = parts.groupBy(*keys, "block").agg(F.max_by("own", "idx").alias("end"))
    told = ends.withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(reach))))
    told = told.groupBy(*keys, (F.col("block") + F.col("ahead")).alias("block")).agg(F.sum(F.col("end") * power((F.col("ahead") - 1) * block)).alias("told"))
    level = F.col("own") + F.coalesce(F.col("told") * power(at + 1), F.lit(0.0))
    return parts.join(told, [*keys, "block"], "left").withColumn("level", level).drop("block", "own", "told")


def activity_map(changes: DataFrame, keep: float = 0.985) -> DataFrame:
    """(media_id, cell_x, cell_y, level) after a medium's last picture: the end of the mean that eased gives, by one sum.

    changes are (media_id, idx, cell_x, cell_y, value); a cell without a row, or with a null value, did not change.
    """
    last = changes.groupBy("media_id").agg(F.max("idx").alias("last"))
    weight = F.when(F.col("idx") == 0, 1.0).otherwise(1 - keep) * F.pow(F.lit(keep), F.col("last") - F.col("idx"))
    return changes.join(last, "media_id").groupBy("media_id", "cell_x", "cell_y").agg(F.sum(F.coalesce("value", F.lit(0.0)) * weight).alias("level"))


def busy_box(cells: DataFrame, width: int, height: int, share: float = 0.35, least: float = 0.02, pad: float = 0.04) -> DataFrame:
    """(media_id, x0, y0, x1, y1): around the cells above share of the highest level, widened by pad, within the picture.

    Where those are fewer than least of the cells, the cells above the 85th percentile count instead; where none is
    above it, the box is the whole picture.
    """
    tops = cells.groupBy("media_id").agg(F.max("level").alias("top"), F.percentile("level", F.lit(0.85)).alias("p"), F.count("*").alias("n"))
    hot = F.col("level") / (F.col("top") + 1e-9) > share
    count = cells.join(tops, "media_id").where(hot).groupBy("media_id").agg(F.count("*").alias("hot"))
    rule = tops.join(count, "media_id", "left").withColumn("few", F.coalesce("hot", F.lit(0)) < least * F.col("n"))
    rows = cells.join(rule, "media_id").withColumn("in", F.when(F.col("few"), F.col("level") > F.col("p")).otherwise(hot))
    side = lambda f, c: f(F.when(F.col("in"), F.col(c)))
    out = rows.groupBy("media_id").agg(side(F.min, "cell_x").alias("a"), side(F.min, "cell_y").alias("b"), side(F.max, "cell_x").alias("c"), side(F.max, "cell_y").alias("d"))
    low = lambda c, n: F.coalesce(F.greatest(F.lit(0.0), F.col(c) / n - pad), F.lit(0.0))
    high = lambda c, n: F.when(F.col(c).isNull(), 1.0).otherwise(F.least(F.lit(1.0), (F.col(c) + 1) / n + pad))
    whole = F.col("a").isNull()
    return out.select("media_id", F.when(whole, 0.0).otherwise(low("a", width)).alias("x0"), F.when(whole, 0.0).otherwise(low("b", height)).alias("y0"), high("c", width).alias("x1"), high("d", height).alias("y1"))
