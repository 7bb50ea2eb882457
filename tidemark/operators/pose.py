"""Key points of people (media_id, frame, person, points: array<struct<x, y, conf>> in pixels): how fast wrists move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHOULDERS, WRISTS, ANKLES = (5, 6), (9, 10), (15, 16)  # places in the usual list of 17 points


def arms(people: DataFrame, height: float, seen: float = 0.35) -> DataFrame:
    """(media_id, frame, rx, ry, body, overhead) of each frame with a usable person.

    A person is usable with a shoulder and a wrist above seen and a body (shoulders to ankles, without ankles nine
    tenths of the way to the top of the picture) of at least a fiftieth of the height. The place is the first
    person's shoulders, (rx, ry) leads from it to the farthest wrist, body is the tallest; overhead tells whether the
    last person's wrist is above the place. Missing or null points aren't seen; persons of a frame are distinct.
    """
    p = lambda i: F.get("points", F.lit(i))
    on = lambda i: F.coalesce(p(i)["conf"] > seen, F.lit(False))
    shoulders = sum(on(i).cast("int") for i in SHOULDERS)
    middle = lambda c: sum(F.when(on(i), p(i)[c]).otherwise(0.0) for i in SHOULDERS) / F.nullif(shoulders, F.lit(0))
    left, right = WRISTS
    wrist = F.when(on(right) & (~on(left) | (p(right)["conf"] >= p(left)["conf"])), p(right)).when(on(left), p(left))
    rows = people.select("media_id", "frame", "person", middle("x").alias("mx"), middle("y").alias("my"), wrist.alias("w"), F.greatest(*[F.when(on(i), p(i)["y"]) for i in ANKLES]).alias("foot"))
    rows = rows.withColumn("body", F.coalesce(F.col("foot") - F.col("my"), 0.9 * F.col("my"))).where(F.col("mx").isNotNull() & F.col("w").isNotNull() & (F.col("body") >= 0.02 * height))
    out = rows.groupBy("media_id", "frame").agg(F.min_by(F.struct("mx", "my"), "person").alias("m"), F.max("body").alias("body"), F.max_by("w.y", "person").alias("wy"), F.collect_list(F.struct("person", F.col("w.x").alias("x"), F.col("w.y").alias("y"))).alias("ws"))
    away = lambda w: F.struct(F.hypot(w["x"] - F.col("m.mx"), w["y"] - F.col("m.my")).alias("d"), (-w["person"]).alias("p"), (w["x"] - F.col("m.mx")).alias("x"), (w["y"] - F.col("m.my")).alias("y"))
    far = F.array_max(F.transform("ws", away))
    return out.select("media_id", "frame", far["x"].alias("rx"), far["y"].alias("ry"), "body", (F.col("wy") < F.col("m.my")).alias("overhead"))


def _between(known: DataFrame, columns: list[str]) -> DataFrame:
    """(media_id, frame, known, columns) on every frame of 0..n-1, linear between known frames and level beyond them."""
    order = W.partitionBy("media_id").orderBy("frame")
    rows = known.withColumns({"lo": F.when(F.lag("frame").over(order).isNull(), F.lit(0)).otherwise(F.col("frame")), "next": F.lead("frame").over(order), **{f"next_{c}": F.lead(c).over(order) for c in columns}})
    rows = rows.withColumn("f", F.explode(F.sequence("lo", F.coalesce("next", "n") - 1)))
    part = F.greatest(F.lit(0), F.col("f") - F.col("frame")) / (F.col("next") - F.col("frame"))
    value = lambda c: F.coalesce(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * part, F.col(c)).alias(c)
    return rows.select("media_id", F.col("f").alias("frame"), (F.col("f") == F.col("frame")).alias("known"), *[value(c) for c in columns])


def swing(people: DataFrame, frames: DataFrame, fps: float, height: float, smoothing: float = 0.2, top: float = 6.0) -> DataFrame:
    """(media_id, frame, swing, ok, overhead) on every frame of media whose arms are seen in 4 frames and a twentieth of them.

    swing is the way from shoulder to wrist's change a second, in bodies, at most top, smoothed, and 0 in frames
    without arms. frames are (media_id, n); frames of people from n on don't count. Bodies of at most a pixel are
    ignored; with fewer than three others, a fifth of the height stands for all.
    """
    known = arms(people, height).join(frames, "media_id").where((F.col("frame") >= 0) & (F.col("frame") < F.col("n")))
    of = W.partitionBy("media_id")
    known = known.withColumns({"k": F.count("*").over(of), "bodies": F.count_if(F.col("body") > 1).over(of)}).where((F.col("k") >= 4) & (F.col("k") >= 0.05 * F.col("n")))
    ways = _between(known, ["rx", "ry"])
    bodies = _between(known.where((F.col("body") > 1) & (F.col("bodies") > 2)), ["body"]).drop("known")
    order = of.orderBy("frame")
    step = lambda c: F.col(c) - F.lag(c).over(order)
    rows = ways.join(bodies, ["media_id", "frame"], "left").join(known.select("media_id", "frame", "overhead"), ["media_id", "frame"], "left")
    rows = rows.withColumn("d", F.coalesce(F.hypot(step("rx"), step("ry")), F.lit(0.0)) * fps)
    raw = F.least(F.lit(top), F.col("d") / F.greatest(F.coalesce("body", F.lit(max(1.0, 0.2 * height))), F.lit(1e-6)))
    width = max(1, round(smoothing * fps))
    near = order.rowsBetween((width - 1) // 2 - (width - 1), (width - 1) // 2)
    rows = rows.withColumn("raw", raw).withColumn("smooth", F.sum("raw").over(near) / width)
    return rows.select("media_id", "frame", F.when(F.col("known"), F.col("smooth")).otherwise(0.0).alias("swing"), F.col("known").alias("ok"), F.coalesce("overhead", F.lit(False)).alias("overhead"))


def quiet(swings: DataFrame) -> DataFrame:
    """(media_id, coverage, quiet): the share of frames with arms, and the lower quartile of swings above 0 (0 if none is)."""
    above: Column = F.when(F.col("swing") > 0, F.col("swing"))
    return swings.groupBy("media_id").agg(F.avg(F.col("ok").cast("double")).alias("coverage"), F.coalesce(F.percentile(above, F.lit(0.25)), F.lit(0.0)).alias("quiet"))
