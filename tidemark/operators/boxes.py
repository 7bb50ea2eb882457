"""Boxes (media_id, frame, track, box_id, x1, y1, x2, y2, conf), in units of the picture: filters, sizes, tracks, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.series import clipped

FRAME = ("media_id", "frame")


def height() -> Column:
    return F.abs(F.col("y2") - F.col("y1"))


def area() -> Column:
    return F.abs((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))


def sanitized(boxes: DataFrame, high_camera: bool = False) -> DataFrame:
    """Boxes clipped to the picture, without those too small, too large or of an odd shape; the shape is that before clipping."""
    least_h, ratios, most_area = (0.008, (0.08, 6.0), 0.30) if high_camera else (0.02, (0.12, 1.8), 0.12)
    ratio = F.greatest(F.lit(1e-9), F.col("x2") - F.col("x1")) / F.greatest(F.lit(1e-9), F.col("y2") - F.col("y1"))
    rows = boxes.withColumn("ratio", ratio)
    for c in ("x1", "y1", "x2", "y2"):
        rows = rows.withColumn(c, clipped(F.col(c), 0.0, 1.0))
    fits = (F.col("x2") - F.col("x1") > 1e-6) & (F.col("y2") - F.col("y1") > 1e-6) & (height() >= least_h) & F.col("ratio").between(*ratios) & (area() <= most_area)
    return rows.where(fits).drop("ratio")


def size_reason(boxes: DataFrame, lo: float, hi: float, least_area: float, most_area: float, relative: bool) -> DataFrame:
    """reason: the first size bound that a box breaks, null if none; 0 means no bound.

    Relative heights are measured by the tallest box of the frame; where that is at most 0.02, only areas count.
    """
    rows = boxes.withColumn("h", height()).withColumn("a", area()).withColumn("ref", F.max(height()).over(W.partitionBy(*FRAME)))
    unit = F.col("ref") if relative else F.lit(1.0)
    counts = (F.col("ref") > 0.02) if relative else F.lit(True)
    bound = lambda on, broken, name: F.when(broken & F.lit(on > 0), F.lit(name))
    reason = F.coalesce(
        bound(lo, counts & (F.col("h") < lo * unit), "short"),
        bound(hi, counts & (F.col("h") > hi * unit), "tall"),
        bound(least_area, F.col("a") < least_area, "small"),
        bound(most_area, F.col("a") > most_area, "large"),
    )
    return rows.withColumn("reason", reason).drop("h", "a", "ref")


def sized(boxes: DataFrame, **bounds) -> DataFrame:
    """Boxes within the size bounds; a frame that would lose all of its boxes keeps them."""
    rows = size_reason(boxes, **bounds)
    left = F.count_if(F.col("reason").isNull()).over(W.partitionBy(*FRAME))
    return rows.withColumn("left", left).where("reason is null or left = 0").drop("reason", "left")


def touches_edge(eps: float = 0.01) -> Column:
    return (F.col("x1") <= eps) | (F.col("y1") <= eps) | (F.col("x2") >= 1 - eps) | (F.col("y2") >= 1 - eps)


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Whether a ray from the point crosses the polygon's edges an odd number of times."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay != by:  # a level edge crosses no level ray
            crosses = (F.lit(ay) > y) != (F.lit(by) > y)
            crossings = crossings + F.when(crosses & (x < (bx - ax) * (y - ay) / (by - ay) + ax), 1).otherwise(0)
    return F.pmod(crossings, F.lit(2)) == 1


def projected(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    """The point under a projective map of nine numbers, row by row; null where its third coordinate vanishes."""
    row = lambda k: h[k] * x + h[k + 1] * y + h[k + 2]
    third = F.when(F.abs(row(6)) > 1e-12, row(6))
    return row(0) / third, row(3) / third


def reference_height(boxes: DataFrame) -> DataFrame:
    """(media_id, ref, least, most): 90th percentile of the frames' tallest boxes; 0 for fewer than 5 frames or below 0.06."""
    tallest = boxes.groupBy(*FRAME).agg(F.max(height()).alias("h"))
    out = tallest.groupBy("media_id").agg(F.count("*").alias("n"), F.percentile("h", F.lit(0.9)).alias("p"))
    weak = (F.col("n") < 5) | (F.col("p") < 0.06)
    return out.select("media_id", F.when(weak, 0.0).otherwise(F.col("p")).alias("ref"), F.when(weak, 0.0).otherwise(F.greatest(F.lit(0.03), 0.42 * F.col("p"))).alias("least"), F.when(weak, 1.0).otherwise(F.least(F.lit(1.0), 4 * F.col("p"))).alias("most"))


def height_histogram(boxes: DataFrame, bins: int = 24, top: float = 0.5) -> DataFrame:
    """(media_id, bin, n, over): heights up to top, taller ones in the last bin and counted in over."""
    h = F.least(height(), F.lit(top))
    bin_ = F.least(F.floor(h / top * bins), F.lit(bins - 1)).cast("int")
    return boxes.groupBy("media_id", bin_.alias("bin")).agg(F.count("*").alias("n"), F.count_if(height() > top).alias("over"))


def match_format(boxes: DataFrame, frames: int, least_frames: int = 300) -> DataFrame:
    """(media_id, format, share3, share4): by how many frames with a box have three or four; frames: of each medium."""
    per = boxes.groupBy(*FRAME).agg(F.count_distinct("track").alias("active"))
    out = per.groupBy("media_id").agg(F.count("*").alias("present"), F.avg((F.col("active") >= 3).cast("double")).alias("share3"), F.avg((F.col("active") >= 4).cast("double")).alias("share4"))
    enough = (F.col("present") >= least_frames) & (F.col("present") / frames >= 0.30)
    verdict = F.when(~enough, "unknown").when((F.col("share4") >= 0.34) | (F.col("share3") >= 0.60), "doubles").when(F.col("share3") <= 0.15, "single").otherwise("unknown")
    return out.select("media_id", verdict.alias("format"), "share3", "share4")


def tracks(boxes: DataFrame, fps: float) -> DataFrame:
    """Of each track: frames, mean and largest area, travelled way, 90th percentile of speed, share of slow steps, median height.

    Of a track's boxes in one frame the surest counts. Steps longer than 4 frames add no way.
    """
    surest = W.partitionBy("media_id", "track", "frame").orderBy(F.desc("conf"), "box_id")
    rows = boxes.withColumn("rn", F.row_number().over(surest)).where("rn = 1")
    back = W.partitionBy("media_id", "track").orderBy("frame")
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rows = rows.select("media_id", "track", "frame", x.alias("x"), y.alias("y"), area().alias("a"), height().alias("h"))
    rows = rows.withColumn("dt", (F.col("frame") - F.lag("frame").over(back)) / fps).withColumn("step", F.hypot(F.col("x") - F.lag("x").over(back), F.col("y") - F.lag("y").over(back)))
    rows = rows.withColumn("speed", F.col("step") / F.col("dt"))
    return rows.groupBy("media_id", "track").agg(
        F.count("*").alias("frames"), F.avg("a").alias("mean_area"), F.max("a").alias("max_area"),
        F.coalesce(F.sum(F.when(F.col("dt") <= 4 / fps, F.col("step"))), F.lit(0.0)).alias("travel"),
        F.percentile("speed", F.lit(0.9)).alias("speed_p90"), F.avg((F.col("speed") < 0.05).cast("double")).alias("static"), F.percentile("h", F.lit(0.5)).alias("median_height"),
    )


def speeds(boxes: DataFrame, fps: float, aspect: float, limit: float = 4.0, reach: int = 64) -> DataFrame:
    """(media_id, frame, track, speed, vx, vy) of each track's surest box in a frame.

    speed is that since the track's box before, in heights of the picture; vx and vy are halved at each box and
    gain half of the step's own, clipped to limit. Boxes more than reach before weigh less than a double can
    tell and aren't looked at. A track's first box has zeros; an empty table gives no rows.
    """
    surest = W.partitionBy("media_id", "track", "frame").orderBy(F.desc("conf"), "box_id")
    rows = boxes.withColumn("rn", F.row_number().over(surest)).where("rn = 1")
    back = W.partitionBy("media_id", "track").orderBy("frame")
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rows = rows.select("media_id", "track", "frame", x.alias("x"), y.alias("y"))
    dt = (F.col("frame") - F.lag("frame").over(back)) / fps
    rows = rows.withColumns({"sx": (F.col("x") - F.lag("x").over(back)) / dt, "sy": (F.col("y") - F.lag("y").over(back)) / dt})
    step = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(F.least(F.lit(limit), F.greatest(F.lit(-limit), F.col(c))))
    near = back.rowsBetween(-reach, 0)
    eased = lambda c: F.aggregate(F.collect_list(step(c)).over(near), F.lit(0.0), lambda v, s: 0.5 * v + 0.5 * s)
    speed = F.coalesce(F.hypot(F.col("sx") * aspect, F.col("sy")), F.lit(0.0))
    return rows.select("media_id", "frame", "track", speed.alias("speed"), eased("sx").alias("vx"), eased("sy").alias("vy"))


def frame_counts(boxes: DataFrame) -> DataFrame:
    """(media_id, frame, active, mean_height) on every frame up to the medium's last, zeros where none has a box."""
    per = boxes.groupBy(*FRAME).agg(F.count("*").alias("active"), F.avg(height()).alias("mean_height"))
    grid = boxes.groupBy("media_id").agg(F.max("frame").alias("top")).select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("frame"))
    return grid.join(per, list(FRAME), "left").select(*FRAME, F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("mean_height", F.lit(0.0)).alias("mean_height"))


def coverage(boxes: DataFrame, half: int) -> DataFrame:
    """(media_id, frame, covered): frames with a box after a closing of half frames each way; the borders count as empty."""
    rows = frame_counts(boxes).withColumn("on", (F.col("active") > 0).cast("int"))
    near = W.partitionBy("media_id").orderBy("frame").rowsBetween(-half, half)
    wide = rows.withColumn("wide", F.max("on").over(near))
    return wide.select(*FRAME, F.when(F.count("*").over(near) == 2 * half + 1, F.min("wide").over(near)).otherwise(0).alias("covered"))


def motion(boxes: DataFrame) -> DataFrame:
    """(media_id, frame, motion): the largest step of a track from the frame before, at most 0.25; 0 where none has both."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    rows = boxes.groupBy("media_id", "track", "frame").agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    back = W.partitionBy("media_id", "track").orderBy("frame")
    step = F.hypot((F.col("x") - F.lag("x").over(back)) * 1.78, F.col("y") - F.lag("y").over(back))
    moved = F.when(F.col("frame") - F.lag("frame").over(back) == 1, F.least(step, F.lit(0.25))).otherwise(0.0)
    return rows.withColumn("moved", moved).groupBy(*FRAME).agg(F.max("moved").alias("motion"))


def nearest_steps(boxes: DataFrame, radius: float) -> DataFrame:
    """(media_id, frame, step): the largest way of a box to the nearest one of the previous frame with boxes, within radius."""
    points = boxes.select(*FRAME, "box_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    frames = points.select(*FRAME).distinct().withColumn("before", F.lag("frame").over(W.partitionBy("media_id").orderBy("frame")))
    earlier = points.select("media_id", F.col("frame").alias("before"), F.col("x").alias("px"), F.col("y").alias("py"))
    pairs = points.join(frames, list(FRAME)).join(earlier, ["media_id", "before"])
    near = pairs.groupBy(*FRAME, "box_id").agg(F.min(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).alias("d"))
    return near.where(F.col("d") <= radius).groupBy(*FRAME).agg(F.max("d").alias("step"))


def holes(boxes: DataFrame, fps: float, longest: float = 2.0) -> DataFrame:
    """Boxes between two of a track that are up to longest seconds apart, by linear interpolation, in frames without any box."""
    rows = boxes.groupBy("media_id", "track", "frame").agg(F.max(F.struct("conf", "box_id", "x1", "y1", "x2", "y2")).alias("b"))
    ahead = W.partitionBy("media_id", "track").orderBy("frame")
    rows = rows.withColumn("next", F.lead("frame").over(ahead)).withColumn("c", F.lead("b").over(ahead))
    gap = F.col("next") - F.col("frame")
    rows = rows.where((gap > 1) & (gap / fps <= longest)).withColumn("f", F.explode(F.sequence(F.col("frame") + 1, F.col("next") - 1)))
    part = (F.col("f") - F.col("frame")) / gap
    sides = [(F.col(f"b.{c}") + (F.col(f"c.{c}") - F.col(f"b.{c}")) * part).alias(c) for c in ("x1", "y1", "x2", "y2")]
    filled = rows.select("media_id", F.col("f").alias("frame"), "track", *sides, ((F.col("b.conf") + F.col("c.conf")) / 2).alias("conf"))
    return filled.join(boxes.select(*FRAME).distinct(), list(FRAME), "left_anti")


def shifted_out(polygons: DataFrame, by: float) -> DataFrame:
    """polygons (..., polygon: array<struct<x, y>>) with every edge moved outward by by, meeting at the corners' mitres.

    Edges without length go. Two edges in line meet where the first one's start went. Polygons of fewer than three
    edges, and those that don't become larger, stay as they are. A null polygon stays null.
    """
    p = F.col("polygon")
    n = F.size(p)
    to = lambda xs, i, m: F.get(xs, F.pmod(i + 1, m))
    wedge = lambda xs: F.aggregate(F.transform(xs, lambda a, i: a["x"] * to(xs, i, F.size(xs))["y"] - to(xs, i, F.size(xs))["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    ways = F.transform(p, lambda a, i: F.struct(a["x"].alias("x"), a["y"].alias("y"), (to(p, i, n)["x"] - a["x"]).alias("dx"), (to(p, i, n)["y"] - a["y"]).alias("dy")))
    rows = polygons.withColumns({"signed": wedge(p), "ways": F.filter(ways, lambda e: F.hypot(e["dx"], e["dy"]) >= 1e-9)})
    sign = F.when(F.col("signed") > 0, by).otherwise(-by)
    unit = lambda e, c: e[c] / F.hypot(e["dx"], e["dy"])
    rows = rows.withColumn("lines", F.transform("ways", lambda e: F.struct((e["x"] + sign * unit(e, "dy")).alias("x"), (e["y"] - sign * unit(e, "dx")).alias("y"), unit(e, "dx").alias("dx"), unit(e, "dy").alias("dy"))))

    def corner(i: Column) -> Column:
        """Where the line before the corner meets its own."""
        m = F.size("lines")
        a, b = F.get("lines", F.pmod(i - 1, m)), F.get("lines", i)
        turn = a["dx"] * b["dy"] - a["dy"] * b["dx"]
        t = F.when(F.abs(turn) < 1e-9, 0.0).otherwise(((b["x"] - a["x"]) * b["dy"] - (b["y"] - a["y"]) * b["dx"]) / turn)
        return F.struct((a["x"] + a["dx"] * t).alias("x"), (a["y"] + a["dy"] * t).alias("y"))

    rows = rows.withColumn("out", F.when(F.size("lines") >= 3, F.transform("lines", lambda _, i: corner(i))))
    larger = F.abs(wedge(F.col("out"))) > F.abs(F.col("signed"))
    return rows.withColumn("polygon", F.when(larger & F.lit(by > 0), F.col("out")).otherwise(p)).drop("signed", "ways", "lines", "out")


def within(x: Column, y: Column, polygon: Column) -> Column:
    """in_polygon for a column of polygons, a point on an edge's right side included; true for fewer than three corners, null for a null polygon."""
    n = F.size(polygon)

    def crosses(a: Column, i: Column) -> Column:
        b = F.get(polygon, F.pmod(i + 1, n))
        return ((a["y"] > y) != (b["y"] > y)) & (x <= (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    hits = F.aggregate(F.transform(polygon, lambda a, i: crosses(a, i).cast("int")), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    return F.when(n < 3, True).otherwise(F.pmod(hits, F.lit(2)) == 1)
