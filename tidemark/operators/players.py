"""Who plays: tracks of boxes scored by size, speed and presence, the pick of up to four people, and their sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import boxes as bx
from tidemark.operators.lineage import cut
from tidemark.operators.series import clipped


def surest(boxes: DataFrame) -> DataFrame:
    """Of a track's boxes in one frame the one with the highest conf, then the smallest box_id."""
    order = W.partitionBy("media_id", "track", "frame").orderBy(F.desc_nulls_last("conf"), "box_id")
    return boxes.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def features(boxes: DataFrame, fps: float, aspect: float) -> DataFrame:
    """(media_id, track, n, t0, t1, cx, reach, area, size, mean_speed, max_speed, static) of each track.

    area is the 90th percentile, size the median of the larger of height and width in heights of the picture; speeds
    are those since the box before. A track of one box is at rest.
    """
    back = W.partitionBy("media_id", "track").orderBy("frame")
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    wide, tall = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    zero = F.lit(0.0)
    rows = surest(boxes).select("media_id", "track", "frame", x.alias("x"), y.alias("y"), (F.greatest(zero, wide) * F.greatest(zero, tall)).alias("a"), F.greatest(F.abs(tall), F.abs(wide) * max(0.2, aspect)).alias("s"))
    step = F.hypot((F.col("x") - F.lag("x").over(back)) * aspect, F.col("y") - F.lag("y").over(back))
    rows = rows.withColumn("speed", step / ((F.col("frame") - F.lag("frame").over(back)) / fps))
    return rows.groupBy("media_id", "track").agg(
        F.count("*").alias("n"), (F.min("frame") / fps).alias("t0"), (F.max("frame") / fps).alias("t1"), F.avg("x").alias("cx"), (F.max("x") - F.min("x")).alias("reach"),
        F.percentile("a", F.lit(0.9)).alias("area"), F.percentile("s", F.lit(0.5)).alias("size"), F.coalesce(F.avg("speed"), zero).alias("mean_speed"),
        F.coalesce(F.max("speed"), zero).alias("max_speed"), F.coalesce(F.avg((F.col("speed") < 0.05).cast("double")), F.lit(1.0)).alias("static"),
    )


def _or_all(rows: DataFrame, fits: Column) -> DataFrame:
    """The rows that fit; of media where none does, all."""
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False)))
    some = rows.groupBy("media_id").agg(F.max("fits").alias("some"))
    return rows.join(some, "media_id").where("fits or not some").drop("fits", "some")


def scored(boxes: DataFrame, fps: float, aspect: float = 1.7778, high_camera: bool = False) -> DataFrame:
    """Candidates with score (0 to 1) and moving.

    Candidates are tracks of 0.4 seconds; of media without any, the two longest. Where the picture tells how tall
    players are (bx.reference_height), much smaller tracks go, and afterwards those less than 0.45 of the best one's
    size, but never all of a medium. Of a high camera's picture speed counts more than size, and its edges as much as
    its middle. Rows without a medium, a track or a frame are ignored.
    """
    boxes = boxes.where("media_id is not null and track is not null and frame is not null")
    least = max(3, round(0.4 * fps))
    rows = features(boxes, fps, aspect)
    longest = rows.groupBy("media_id").agg(F.max("n").alias("longest"))
    rows = rows.join(longest, "media_id")
    brief = rows.where(F.col("longest") < least).withColumn("nth", F.row_number().over(W.partitionBy("media_id").orderBy(F.desc("n"), "track"))).where("nth <= 2").drop("nth")
    rows = rows.where(F.col("n") >= least).unionByName(brief).drop("longest")
    media = bx.reference_height(boxes).join(boxes.groupBy("media_id").agg(((F.max("frame") + 1) / fps).alias("duration")), "media_id").drop("most")
    rows = cut(_or_all(rows.join(media, "media_id"), (F.col("ref") <= 0) | (F.col("size") >= F.col("least"))))
    high = lambda c: F.greatest(F.percentile(c, F.lit(0.9)), F.lit(1e-6)).alias(f"{c}_ref")
    rows = rows.join(rows.groupBy("media_id").agg(high("area"), high("mean_speed"), high("max_speed")), "media_id")
    w_area, w_speed, w_stay = (0.20, 0.65, 0.15) if high_camera else (0.45, 0.40, 0.15)
    unit = lambda c: clipped(c, 0.0, 1.0)
    lasts = F.col("t1") - F.col("t0")
    speed = F.col("n") / (F.col("n") + 2 * fps) * unit(0.65 * F.col("mean_speed") / F.col("mean_speed_ref") + 0.35 * F.col("max_speed") / F.col("max_speed_ref"))
    score = w_area * unit(F.col("area") / F.col("area_ref")) + w_speed * speed + w_stay * unit(lasts / F.greatest(F.col("duration"), F.lit(1e-6)))
    score = score - 0.35 * unit(F.col("static")) - F.when((F.col("reach") < 0.06) & (lasts > 0.5 * F.col("duration")), 0.25).otherwise(0.0)
    if not high_camera:
        score = score - 0.30 * unit((F.abs(F.col("cx") - 0.5) - 0.42) / 0.08)
    moving = (F.col("mean_speed") / F.col("mean_speed_ref") >= 0.20) & (F.col("area") / F.col("area_ref") >= 0.20)
    rows = rows.withColumns({"score": unit(score), "moving": moving})
    best = rows.groupBy("media_id").agg(F.max_by("size", F.struct("score", -F.col("track"))).alias("best_size"))
    rows = _or_all(rows.join(best, "media_id"), (F.col("ref") <= 0) | (F.col("best_size") <= 0) | (F.col("size") >= F.greatest(F.col("least"), 0.45 * F.col("best_size"))))
    return rows.select("media_id", "track", "n", "t0", "t1", "cx", "area", "size", "score", "moving")


_GROUP = "array<struct<cx: double, area: double, r0: double, r1: double, t0: double, t1: double>>"


def picked(candidates: DataFrame, most: int = 4) -> DataFrame:
    """(media_id, place, track, score): up to most tracks of each medium, best first.

    A track counts as the same person as one before if both overlap in time, lie within 0.08 of each other and differ
    in area by at most 2.5 times; it is taken if it adds two seconds and half of its own length. Tracks must move, and
    from the second on have 0.55 of the best score and 0.30. If no score is above 0, the first track is taken.
    Equal scores go by track. Each round takes one track a medium: what was taken so far is one row a medium, and the
    next is the best of the rows after it, so a medium's tracks are never gathered.
    """
    rows = cut(candidates.withColumn("key", F.struct((-F.col("score")).alias("s"), F.col("track"))))
    state = rows.groupBy("media_id").agg(F.max("score").alias("best"), F.lit(None).cast("struct<s: double, track: bigint>").alias("last")).withColumns({"groups": F.array().cast(_GROUP), "picks": F.array().cast("array<struct<track: bigint, score: double>>")})
    for _ in range(most):
        met = rows.join(state, "media_id")
        apart = lambda g: F.greatest(F.col("area"), g["area"]) / F.greatest(F.lit(1e-9), F.least(F.col("area"), g["area"]))
        same = lambda g: (F.least(F.col("t1"), g["r1"]) > F.greatest(F.col("t0"), g["r0"])) & (F.abs(F.col("cx") - g["cx"]) <= 0.08) & (apart(g) <= 2.5)
        met = met.withColumn("of", F.array_position(F.transform("groups", same), True))
        group = F.get("groups", (F.col("of") - 1).cast("int"))
        gain = F.greatest(F.lit(0.0), group["t0"] - F.col("t0")) + F.greatest(F.lit(0.0), F.col("t1") - group["t1"])
        adds = (F.col("of") == 0) | ((gain >= 2.0) & (gain >= 0.5 * F.greatest(F.lit(1e-6), F.col("t1") - F.col("t0"))))
        first = F.size("picks") == 0
        fits = F.col("moving") & adds & (first | (F.col("score") >= F.greatest(0.55 * F.col("best"), F.lit(0.30))))
        none = F.col("best") <= 1e-6
        fits = F.when(none, first).otherwise(fits) & (F.col("last").isNull() | (F.col("key") > F.col("last")))
        state = met.groupBy("media_id").agg(*[F.first(c).alias(c) for c in ("best", "last", "groups", "picks")], F.min(F.when(fits, F.struct("key", "score", "cx", "area", "t0", "t1", "of"))).alias("p"))
        p, taken = F.col("p"), F.col("p").isNotNull()
        new = F.array(F.struct(p["cx"].alias("cx"), p["area"].alias("area"), p["t0"].alias("r0"), p["t1"].alias("r1"), p["t0"].alias("t0"), p["t1"].alias("t1")))
        wider = F.transform("groups", lambda g, i: F.when(i == F.col("p.of") - 1, g.withField("t0", F.least(g["t0"], F.col("p.t0"))).withField("t1", F.greatest(g["t1"], F.col("p.t1")))).otherwise(g))
        groups = F.when(~taken, F.col("groups")).when(p["of"] == 0, F.concat("groups", new)).otherwise(wider)
        picks = F.when(taken, F.concat("picks", F.array(F.struct(p["key"]["track"].alias("track"), p["score"].alias("score"))))).otherwise(F.col("picks"))
        state = state.select("media_id", "best", F.coalesce(p["key"], F.col("last")).alias("last"), groups.alias("groups"), picks.alias("picks"))
    out = state.select("media_id", F.posexplode("picks").alias("place", "pick"))
    return out.select("media_id", (F.col("place") + 1).alias("place"), "pick.track", "pick.score")


def sides(rallies: DataFrame, boxes: DataFrame, active: DataFrame, fps: float, high_camera: bool = False) -> DataFrame:
    """(media_id, rally_id, server, receiver): near or far, or unknown.

    Of the active tracks (media_id, track) the one of the largest mean area is near, the next one far, if it is more
    than 1.05 times as large. Who moves more from 0.7 seconds before serve_time to 0.25 after serves, the near one if
    both move alike; if neither moves 0.006, or the camera is high, the time is null or two people aren't known,
    the sides are unknown.
    """
    if high_camera:
        return rallies.select("media_id", "rally_id", F.lit("unknown").alias("server"), F.lit("unknown").alias("receiver"))
    one = surest(boxes).join(active.select("media_id", "track").distinct(), ["media_id", "track"])
    areas = one.groupBy("media_id", "track").agg(F.avg(F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))).alias("a"))
    nth = W.partitionBy("media_id").orderBy(F.desc("a"), "track")
    two = areas.withColumn("nth", F.row_number().over(nth)).where("nth <= 2").groupBy("media_id").agg(F.max(F.when(F.col("nth") == 1, F.struct("track", "a"))).alias("near"), F.max(F.when(F.col("nth") == 2, F.struct("track", "a"))).alias("far"))
    two = two.where(F.col("near.a") > F.col("far.a") * 1.05).select("media_id", F.explode(F.array(F.struct(F.lit("near").alias("side"), F.col("near.track").alias("track")), F.struct(F.lit("far").alias("side"), F.col("far.track").alias("track")))).alias("who"))
    tops = boxes.groupBy("media_id").agg((F.max("frame") + 1).alias("n"))
    lo = F.greatest(F.lit(0), F.bround((F.col("serve_time") - 0.7) * fps)).cast("long")
    spans = rallies.join(tops, "media_id").select("media_id", "rally_id", lo.alias("lo"), F.bround((F.col("serve_time") + 0.25) * fps).cast("long").alias("hi"), "n")
    spans = spans.withColumn("hi", F.least(F.col("n"), F.greatest(F.col("lo") + 1, F.col("hi")))).where("lo < hi")
    frames = spans.join(two, "media_id").select("media_id", "rally_id", "who.side", "who.track", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("frame"))
    spots = frames.join(one.select("media_id", "track", "frame", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")), ["media_id", "track", "frame"])
    back = W.partitionBy("media_id", "rally_id", "side").orderBy("frame")
    steps = spots.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(back), F.col("y") - F.lag("y").over(back)))
    moved = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("step"))), F.lit(0.0))
    ways = steps.groupBy("media_id", "rally_id").agg(moved("near").alias("near"), moved("far").alias("far"))
    server = F.when(F.greatest("near", "far") >= 0.006, F.when(F.col("near") >= F.col("far"), "near").otherwise("far"))
    out = rallies.join(ways.select("media_id", "rally_id", server.alias("server")), ["media_id", "rally_id"], "left")
    return out.select("media_id", "rally_id", F.coalesce("server", F.lit("unknown")).alias("server"), F.when(F.col("server") == "near", "far").when(F.col("server") == "far", "near").otherwise("unknown").alias("receiver"))


def shot_sides(shots: DataFrame, servers: DataFrame) -> DataFrame:
    """shots (media_id, rally_id, nth from 0, ...) with player: the server's side and the receiver's in turn."""
    out = shots.join(servers, ["media_id", "rally_id"], "left")
    player = F.when(F.pmod("nth", F.lit(2)) == 0, F.col("server")).otherwise(F.col("receiver"))
    return out.withColumn("player", F.coalesce(player, F.lit("unknown"))).drop("server", "receiver")


def viewpoints(boxes: DataFrame, media: DataFrame, aspect: float) -> DataFrame:
    """(media_id, viewpoint, confidence, spread_x, spread_y, median_height, size_ratio) of each of media: where its camera stands.

    media are (media_id, calibrated, foreshort, area_ratio, h: array of nine numbers, hint). How widely boxes spread
    in the picture and, through h, on the court, how tall they are and how much a frame's two tallest differ decide.
    A medium without boxes has its hint, one with fewer than 8 none; a hint counts where the court is calibrated.
    Null corners make a box count nowhere.
    """
    rows = boxes.dropna(subset=["media_id", "frame", "x1", "y1", "x2", "y2"]).select("media_id", "frame", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), bx.height().alias("tall"))
    tallest = rows.withColumn("nth", F.row_number().over(W.partitionBy("media_id", "frame").orderBy(F.desc("tall")))).where("nth <= 2")
    two = tallest.groupBy("media_id", "frame").agg(F.max("tall").alias("a"), F.min("tall").alias("b"), F.count("*").alias("k")).where((F.col("k") == 2) & (F.col("b") > 1e-9))
    ratios = two.groupBy("media_id").agg(F.percentile(F.col("a") / F.col("b"), F.lit(0.5)).alias("size_ratio"))
    spread = lambda c: F.percentile(c, F.lit(0.92)) - F.percentile(c, F.lit(0.08))
    part = lambda k: F.get("h", F.lit(k)) * F.col("x") + F.get("h", F.lit(k + 1)) * F.col("y") + F.get("h", F.lit(k + 2))
    third = F.when(F.abs(part(6)) > 1e-12, part(6))
    placed = rows.join(media.where("calibrated").select("media_id", "h"), "media_id", "left").withColumns({"u": part(0) / third, "v": part(3) / third})
    good = (F.abs("u") < 3) & (F.abs("v") < 3)
    stats = placed.groupBy("media_id").agg(F.count("*").alias("n"), (spread("x") * aspect).alias("spread_x"), spread("y").alias("spread_y"), F.percentile("tall", F.lit(0.5)).alias("median_height"), F.count_if(good).alias("good"), spread(F.when(good, F.col("u"))).alias("su"), spread(F.when(good, F.col("v"))).alias("sv"))
    rows = media.join(stats, "media_id", "left").join(ratios, "media_id", "left")
    size, tall = F.coalesce("size_ratio", F.lit(1.0)), F.col("median_height")
    least = F.lit(1e-3)
    wide = F.col("spread_x") / F.greatest("spread_y", least)
    on_court = F.when(F.col("good") >= 8, F.col("su") / F.greatest("sv", least)).otherwise(0.0)
    short, ok, few = tall < 0.11, F.coalesce("calibrated", F.lit(False)), F.col("n") < 8
    grown = lambda base, rate, x: F.least(F.lit(0.9), base + rate * F.least(x, F.lit(3.0)))
    none = F.lit("unknown")
    rules = [
        (F.col("n").isNull(), F.coalesce("hint", none), F.when(F.col("hint").isNotNull(), 0.9).otherwise(0.0)),
        (few, none, F.lit(0.0)),
        (~ok & short & (wide < 1.6) & (size < 2.0), F.lit("elevated"), F.lit(0.45)),
        (~ok & (wide > 1.8) & (size < 2.2), F.lit("side"), F.lit(0.5)),
        (~ok & (size > 1.8) & (wide < 1.6), F.lit("rear"), F.lit(0.55)),
        (~ok, none, F.lit(0.3)),
        (F.col("hint").isin("rear", "side", "elevated", "overhead"), F.col("hint"), F.lit(0.9)),
        (short & (F.col("foreshort") > 0.80) & (F.col("area_ratio") > 0.30), F.lit("overhead"), F.least(F.lit(0.9), 0.5 + 0.5 * F.col("area_ratio"))),
        (short, F.lit("elevated"), F.lit(0.6)),
        ((on_court > 1.5) & (size < 2.2), F.lit("side"), grown(0.5, 0.12, on_court - 1.5)),
        ((on_court < 1.0) & (size > 1.35), F.lit("rear"), grown(0.5, 0.15, size - 1.35)),
        ((wide > 1.8) & (size < 2.2), F.lit("side"), F.lit(0.5)),
        ((size > 1.6) & (tall >= 0.16), F.lit("rear"), F.lit(0.55)),
        (tall >= 0.16, F.lit("rear"), F.lit(0.4)),
    ]
    seen, sure = none, F.lit(0.3)
    for when, name, confidence in reversed(rules):
        seen, sure = F.when(when, name).otherwise(seen), F.when(when, confidence).otherwise(sure)
    return rows.select("media_id", seen.alias("viewpoint"), sure.alias("confidence"), "spread_x", "spread_y", "median_height", F.when(F.col("n").isNotNull(), size).alias("size_ratio"))
