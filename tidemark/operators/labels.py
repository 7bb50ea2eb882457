"""Intervals against labelled intervals: normal form, matches, errors at the boundaries, suggestions, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.intervals import SPAN, binned, prf
from tidemark.operators.series import spread

KEYS = ("media_id", "rally_id")


def normalized(intervals: DataFrame) -> DataFrame:
    """Starts of 0 or more, three digits; without those that are not finite or do not end after they start."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    rows = intervals.where(finite("start") & finite("end")).withColumn("start", F.greatest(F.lit(0.0), F.col("start")))
    return rows.where("end > start").withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


def in_window(lo: float, hi: float) -> Column:
    return (F.col("end") > lo) & (F.col("start") < hi)


def suggestions(intervals: DataFrame) -> DataFrame:
    """Per medium: count, shortest, median and longest duration, least and median positive gap to the next start."""
    run = W.partitionBy("media_id").orderBy("start", "rally_id")
    rows = intervals.withColumn("gap", F.lead("start").over(run) - F.col("end")).withColumn("d", F.col("end") - F.col("start"))
    gap = F.when(F.col("gap") > 0, F.col("gap"))
    return rows.groupBy("media_id").agg(F.count("*").alias("n"), F.min("d").alias("shortest"), F.percentile("d", F.lit(0.5)).alias("median"), F.max("d").alias("longest"), F.min(gap).alias("least_gap"), F.percentile(gap, F.lit(0.5)).alias("median_gap"))


def grid(intervals: DataFrame, fixed: list[float], lo: float, hi: float) -> DataFrame:
    """(media_id, grid): fixed values and two from the 10th percentile of durations and the 25th of gaps, to one digit, within [lo, hi].

    A percentile of fewer than three values adds none.
    """
    run = W.partitionBy("media_id").orderBy("start", "rally_id")
    rows = intervals.withColumn("gap", F.lead("start").over(run) - F.col("end")).withColumn("d", F.col("end") - F.col("start"))
    gap = F.when(F.col("gap") > 0, F.col("gap"))
    out = rows.groupBy("media_id").agg(F.count("*").alias("n"), F.count(gap).alias("g"), F.percentile("d", F.lit(0.1)).alias("d10"), F.percentile(gap, F.lit(0.25)).alias("g25"))
    step = lambda c, n: F.when(F.col(n) >= 3, F.least(F.lit(hi), F.greatest(F.lit(lo), F.bround(F.col(c), 1))))
    made = F.filter(F.array(step("d10", "n"), step("g25", "g")), lambda x: x.isNotNull())
    return out.select("media_id", F.array_sort(F.array_union(made, F.array(*[F.lit(float(x)) for x in fixed]))).alias("grid"))


def boundary_errors(pairs: DataFrame) -> DataFrame:
    """(media_id, rally_id, other_id, side, error) from matched pairs with both intervals' times (start, end, s, e)."""
    sides = F.array(F.struct(F.lit("start").alias("side"), (F.col("start") - F.col("s")).alias("error")), F.struct(F.lit("end").alias("side"), (F.col("end") - F.col("e")).alias("error")))
    return pairs.select("media_id", "rally_id", "other_id", F.inline(sides))


def error_quantiles(errors: DataFrame) -> DataFrame:
    """(side, n, mean, median, p90) of the errors' sizes and their signed median."""
    size = F.abs("error")
    return errors.groupBy("side").agg(F.count("*").alias("n"), F.avg(size).alias("mean"), F.percentile(size, F.lit(0.5)).alias("median"), F.percentile(size, F.lit(0.9)).alias("p90"), F.percentile("error", F.lit(0.5)).alias("signed"))


def band_scores(errors: DataFrame, bands: list[float]) -> DataFrame:
    """(side, band, rate, f1) of errors with the numbers of preds and golds: boundaries within a band; a matched pair that moved further is a miss and a false one."""
    rows = errors.withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    out = rows.groupBy("side", "band", "preds", "golds").agg(F.count("*").alias("n"), F.count_if(F.abs("error") <= F.col("band")).alias("tp"))
    _, _, f1 = prf(F.col("tp"), F.col("preds") - F.col("tp"), F.col("golds") - F.col("tp"))
    return out.select("side", "band", (F.col("tp") / F.col("n")).alias("rate"), f1.alias("f1"))


def error_classes(preds: DataFrame, golds: DataFrame, overlapping: DataFrame, taken: DataFrame) -> DataFrame:
    """(media_id, class, n) of what a one-to-one match (taken) left over.

    overlapping: pairs with an IoU worth noting. A label left over is over_split with two or more partners, shifted with
    one, else missed; an interval left over is under_split, shifted or spurious in the same way. A shifted pair counts
    on the label's side only.
    """
    partners = lambda key, name: overlapping.groupBy("media_id", key).agg(F.count("*").alias(name))
    gold = golds.select("media_id", F.col("rally_id").alias("other_id")).join(taken, ["media_id", "other_id"], "left_anti").join(partners("other_id", "k"), ["media_id", "other_id"], "left")
    pred = preds.select(*KEYS).join(taken, list(KEYS), "left_anti").join(partners("rally_id", "k"), list(KEYS), "left")
    kind = lambda many, none: F.when(F.col("k") >= 2, many).when(F.col("k") == 1, "shifted").otherwise(none)
    both = gold.select("media_id", kind("over_split", "missed").alias("class")).unionAll(pred.select("media_id", kind("under_split", "spurious").alias("class")).where("class <> 'shifted'"))
    return both.groupBy("media_id", "class").agg(F.count("*").alias("n"))


def around(points: DataFrame, **marks: DataFrame) -> DataFrame:
    """points (media_id, rally_id, at, ...) with last_NAME and next_NAME for each kind of marks (media_id, u): the last at or before a point and the first at or after it. All are put in one order, and frames only grow."""
    rows = points
    for name, some in marks.items():
        rows = rows.unionByName(some.select("media_id", F.col("u").alias("at"), F.col("u").alias(name)), allowMissingColumns=True)
    back, ahead = (W.partitionBy("media_id").orderBy(o).rangeBetween(W.unboundedPreceding, 0) for o in (F.asc("at"), F.desc("at")))
    rows = rows.withColumns({f"last_{m}": F.max(m).over(back) for m in marks}).withColumns({f"next_{m}": F.min(m).over(ahead) for m in marks})
    return rows.where("rally_id is not null").drop(*marks)


def audit(intervals: DataFrame, valleys: DataFrame, hits: DataFrame, activity: DataFrame, fps: float, close: float = 0.5, far: float = 3.5, least: int = 5, quiet: float = 2.0, radius: float = 3.0, hit_far: float = 2.5, contrast: float = 1.0) -> DataFrame:
    """(media_id, rally_id, code, severity, side, distance, snap, nearest_hit): what is doubtful about labelled intervals.

    overlap, too_close: by how much a neighbour, by start and id, overlaps a side, or the gap to it below close.
    duration_outlier: a robust z (0.6745 of the distance from the median over the median distance) above far, of
    `least` intervals or more that are not all alike. evidence_contradiction: the mean of activity (media_id, idx, value) is higher by
    a tenth of its spread (p95 - p20) outside than inside of a side, each over contrast seconds. boundary_off_quiet:
    the nearest valley (media_id, u, depth) in the gap to the neighbour is more than quiet off; snap is the deepest,
    then nearest, of those within radius. boundary_no_hit: there is none, and the nearest hit (media_id, u) is more
    than hit_far off. Without such signals the last three are silent. Intervals that do not end after they start count for nothing.
    """
    run = W.partitionBy("media_id").orderBy("start", "rally_id")
    rows = intervals.where("end > start").select("media_id", "rally_id", "start", "end").withColumns({"before": F.lag("end").over(run), "after": F.lead("start").over(run), "d": F.col("end") - F.col("start")})
    note = lambda code, severity, side, distance: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(side).cast("string").alias("side"), F.round(distance, 3).alias("distance"))
    gaps = {"start": F.col("start") - F.col("before"), "end": F.col("after") - F.col("end")}
    found = [F.when(g < -1e-9, note("overlap", "warn", side, -g)).when((g >= 0) & (g < close), note("too_close", "info", side, g)) for side, g in gaps.items()]
    mid = rows.groupBy("media_id").agg(F.count("*").alias("n"), F.percentile("d", F.lit(0.5)).alias("mid"))
    mad = rows.hint("merge").join(mid, "media_id").groupBy("media_id", "n", "mid").agg(F.percentile(F.abs(F.col("d") - F.col("mid")), F.lit(0.5)).alias("mad"))
    z = 0.6745 * F.abs(F.col("d") - F.col("mid")) / F.col("mad")
    found.append(F.when((F.col("n") >= least) & (F.col("mad") > 1e-9) & (z > far), note("duration_outlier", "warn", None, z)))
    shape = rows.hint("merge").join(mad, "media_id").select(*KEYS, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))

    sides = F.array(F.struct(F.lit("start").alias("side"), F.col("start").alias("at")), F.struct(F.lit("end").alias("side"), F.col("end").alias("at")))
    ends = rows.select(*KEYS, "before", "after", F.inline(sides))
    rising = F.col("side") == "start"
    # activity before and after each side: its few samples by number
    step = lambda lo, hi: F.sequence(F.bround((F.col("at") + lo) * fps).cast("long"), F.bround((F.col("at") + hi) * fps).cast("long") - 1)
    some = lambda s: F.filter(F.when(F.element_at(s, -1) >= F.element_at(s, 1), s).otherwise(F.array().cast("array<bigint>")), lambda i: i >= 0)
    windows = F.array(F.struct(F.lit("pre").alias("part"), some(step(-contrast, 0.0)).alias("i")), F.struct(F.lit("post").alias("part"), some(step(0.0, contrast)).alias("i")))
    at_once = activity.groupBy("media_id", "idx").agg(F.sum("value").alias("sum"), F.count("value").alias("n"))  # a medium may have several signals
    read = ends.select(*KEYS, "side", F.inline(windows)).select(*KEYS, "side", "part", F.explode("i").alias("idx")).hint("merge").join(at_once, ["media_id", "idx"])
    mean = lambda part: F.try_divide(F.sum(F.when(F.col("part") == part, F.col("sum"))), F.sum(F.when(F.col("part") == part, F.col("n"))))
    turn = read.groupBy(*KEYS, "side").agg(mean("pre").alias("pre"), mean("post").alias("post")).hint("merge").join(spread(activity, 0.2, 0.95), "media_id")
    rise = F.when(rising, F.col("post") - F.col("pre")).otherwise(F.col("pre") - F.col("post")) / F.col("width")
    against = turn.where(rise < -0.1).select(*KEYS, F.lit("evidence_contradiction").alias("code"), F.lit("warn").alias("severity"), "side", F.round(rise, 3).alias("distance"))

    near = around(ends, valley=valleys, hit=hits)
    last, following = F.col("last_valley"), F.col("next_valley")
    valley = F.when(rising & (F.col("before").isNull() | (last > F.col("before"))), F.col("at") - last).when(~rising & (F.col("after").isNull() | (following < F.col("after"))), following - F.col("at"))
    near = near.select(*KEYS, "side", "at", "before", "after", valley.alias("valley"), F.least(F.col("at") - F.col("last_hit"), F.col("next_hit") - F.col("at")).alias("hit"))
    bins = valleys.withColumn("bin", F.floor(F.col("u") / radius))
    reach = near.where(F.col("valley") > quiet).withColumn("bin", F.explode(F.sequence(F.floor(F.col("at") / radius) - 1, F.floor(F.col("at") / radius) + 1))).hint("merge").join(bins, ["media_id", "bin"])
    inside = F.when(rising, (F.col("u") <= F.col("at")) & (F.col("before").isNull() | (F.col("u") > F.col("before")))).otherwise((F.col("u") >= F.col("at")) & (F.col("after").isNull() | (F.col("u") < F.col("after"))))
    snap = reach.where(inside & (F.abs(F.col("u") - F.col("at")) <= radius)).groupBy(*KEYS, "side").agg(F.max(F.struct("depth", (-F.abs(F.col("u") - F.col("at"))).alias("near"), "u")).alias("s"))
    off = near.where(F.col("valley") > quiet).hint("merge").join(snap, [*KEYS, "side"], "left").select(*KEYS, F.lit("boundary_off_quiet").alias("code"), F.lit("warn").alias("severity"), "side", F.round("valley", 3).alias("distance"), F.round("s.u", 3).alias("snap"), F.round("hit", 3).alias("nearest_hit"))
    silent = near.where(F.col("valley").isNull() & (F.col("hit") > hit_far)).select(*KEYS, F.lit("boundary_no_hit").alias("code"), F.lit("info").alias("severity"), "side", F.round("hit", 3).alias("distance"))
    none = F.lit(None).cast("double")
    plain = shape.select(*KEYS, "code", "severity", "side", "distance").union(against).union(silent)
    return plain.select("*", none.alias("snap"), none.alias("nearest_hit")).union(off)


def severities(intervals: DataFrame, notes: DataFrame) -> DataFrame:
    """(severity, n): the intervals by their worst note: warn, info, or ok without any."""
    worst = notes.groupBy(*KEYS).agg(F.max("severity").alias("severity"))
    return intervals.where("end > start").select(*KEYS).hint("merge").join(worst, list(KEYS), "left").groupBy(F.coalesce("severity", F.lit("ok")).alias("severity")).agg(F.count("*").alias("n"))


def snapped(intervals: DataFrame, valleys: DataFrame, radius: float) -> DataFrame:
    """(media_id, rally_id, snap): for each start the deepest (then nearest) valley (u, depth) within radius that lies after the last end."""
    run = W.partitionBy("media_id").orderBy("start", "rally_id")
    rows = intervals.withColumn("lo", F.greatest(F.coalesce(F.lag("end").over(run), F.lit(float("-inf"))), F.col("start") - radius))
    at = F.floor(F.col("start") / radius)
    rows = rows.withColumn("bin", F.explode(F.array(at - 1, at)))
    near = valleys.withColumn("bin", F.floor(F.col("u") / radius))
    found = rows.join(near, ["media_id", "bin"]).where("u >= lo and u <= start")
    best = found.groupBy(*KEYS).agg(F.max(F.struct("depth", "u")).alias("m"))
    return best.select(*KEYS, F.col("m.u").alias("snap"))


def segment_quality(intervals: DataFrame, keys: tuple[str, ...] = ("media_id",), density: DataFrame | None = None, fps: float = 0.0) -> DataFrame:
    """(keys, quality) of each set of intervals (keys, rally_id, start, end, confidence): pauses between them, lengths that vary but not wildly, and their confidence.

    Where a density of hits (media_id, idx, value) is not all zeros, how much of it the intervals hold and how dense it is in them (their
    F-measure) counts for seven tenths.
    """
    order = W.partitionBy(*keys).orderBy("start", "rally_id")
    rows = intervals.withColumns({"gap": F.lead("start").over(order) - F.col("end"), "d": F.col("end") - F.col("start")})
    one = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    out = rows.groupBy(*keys).agg(
        F.coalesce(F.avg((F.col("gap") > 1).cast("double")), F.lit(0.0)).alias("rest"), (F.stddev_pop("d") / F.greatest(F.avg("d"), F.lit(1e-6))).alias("cv"),
        F.avg(F.col("d").between(4, 90).cast("double")).alias("fair"), F.avg("confidence").alias("sure"),
    )
    spread_out = F.when(F.col("cv") < 0.45, one(F.col("cv") / 0.45)).otherwise(one((1.2 - F.col("cv")) / 0.6))
    out = out.select(*keys, one(0.45 * F.col("rest") + 0.25 * spread_out + 0.15 * F.col("fair") + 0.15 * F.coalesce("sure", F.lit(0.0))).alias("shape"))
    if density is None:
        return out.withColumnRenamed("shape", "quality")
    total = density.groupBy("media_id").agg(F.sum("value").alias("total"), (F.max("idx") + 1).alias("n")).where("total > 0")
    lo = F.greatest(F.lit(0), F.least(F.col("n") - 1, (F.col("start") * fps).cast("long")))
    spans = rows.join(total, "media_id").withColumn("lo", lo).withColumn("top", F.greatest(F.col("lo") + 1, F.least(F.col("n"), (F.col("end") * fps).cast("long"))) - 1)
    held = density.withColumn("bin", F.floor(F.col("idx") / SPAN)).join(binned(spans.select(*keys, "lo", "top"), SPAN, "lo", "top"), ["media_id", "bin"]).where("idx between lo and top")
    held = held.select(*keys, "idx", "value").distinct().groupBy(*keys).agg(F.avg("value").alias("p"), F.sum("value").alias("in")).join(total, "media_id")
    r = F.col("in") / F.col("total")
    held = held.select(*keys, F.coalesce(F.try_divide(2 * F.col("p") * r, F.col("p") + r), F.lit(0.0)).alias("f"))
    out = out.join(held, list(keys), "left")
    return out.select(*keys, one(F.when(F.col("f").isNull(), F.col("shape")).otherwise(0.3 * F.col("shape") + 0.7 * one(F.col("f")))).alias("quality"))


def left_one_out(scores: DataFrame) -> DataFrame:
    """(clip, variant, trained, held): per clip and variant, the median score of all other clips beside its own.

    A clip has one score for a variant; a null one counts nowhere, and a variant's only clip has no row. Without a
    clip's own rank the middle of the others is one of the ranks around the middle of all, so one sort serves all clips.
    """
    rows = scores.select("clip", "variant", "score").where("score is not null")
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("variant").orderBy("score", "clip")))
    rows = rows.join(rows.groupBy("variant").agg(F.max("r").alias("n")), "variant").where("n > 1")
    rows = rows.withColumns({"low": F.floor(F.col("n") / 2), "high": F.floor((F.col("n") + 1) / 2)})  # middle ranks of n - 1 others
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("score")))
    middle = rows.groupBy("variant").agg(at(F.col("low")).alias("a"), at(F.col("low") + 1).alias("b"), at(F.col("high")).alias("c"), at(F.col("high") + 1).alias("d"))
    value = lambda rank, own, after: F.when(F.col("r") > F.col(rank), F.col(own)).otherwise(F.col(after))
    return rows.join(middle, "variant").select("clip", "variant", ((value("low", "a", "b") + value("high", "c", "d")) / 2).alias("trained"), F.col("score").alias("held"))


def to_csv_rows(intervals: DataFrame, fps: float) -> DataFrame:
    """Rows of the label export: 1-based index within the medium, times of three digits, frames, notes without commas."""
    run = W.partitionBy("media_id").orderBy("start", "rally_id")
    text = lambda c: F.format_string("%.3f", c)
    frame = lambda c: F.bround(F.col(c) * fps).cast("long")
    return intervals.select("media_id", F.row_number().over(run).alias("index"), text(F.col("start")).alias("start"), text(F.col("end")).alias("end"), frame("start").alias("start_frame"), frame("end").alias("end_frame"), F.regexp_replace(F.coalesce("note", F.lit("")), ",", " ").alias("note"))


def fitted_template(samples: DataFrame) -> DataFrame:
    """(channel, scale, weight, threshold) from (channel, y, x): pooled 15th to 85th percentile, weight by the medians' difference.

    The threshold is the 15th percentile of the positive rows' x. A channel without spread or without one of the
    classes weighs 0.
    """
    of = lambda y: F.when(F.col("y") == y, F.col("x"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    out = samples.groupBy("channel").agg(q(F.col("x"), 0.15).alias("lo"), q(F.col("x"), 0.85).alias("hi"), q(of(1), 0.5).alias("a"), q(of(0), 0.5).alias("b"), q(of(1), 0.15).alias("threshold"))
    scale = F.col("hi") - F.col("lo")
    weight = F.when(scale < 1e-9, 0.0).otherwise(F.coalesce(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 4 * (F.col("a") - F.col("b")) / scale)), F.lit(0.0)))
    return out.select("channel", scale.alias("scale"), weight.alias("weight"), (F.col("threshold") - 1e-6).alias("threshold"))
