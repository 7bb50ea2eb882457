"""Scores and tags of intervals, relative to their batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.series import clipped

# The presets' weights of length, intensity, technique, excitement, production and highlight, and the
# shots and durations that saturate.
PRESETS = [
    ("balanced", 0.22, 0.30, 0.20, 0.20, 0.08, 0.0, 24.0, 22.0),
    ("highlight", 0.16, 0.34, 0.26, 0.20, 0.04, 0.0, 18.0, 18.0),
    ("highlight_pro", 0.10, 0.22, 0.22, 0.24, 0.02, 0.20, 14.0, 14.0),
    ("long_rally", 0.42, 0.20, 0.14, 0.18, 0.06, 0.0, 40.0, 35.0),
    ("technique", 0.14, 0.18, 0.42, 0.18, 0.08, 0.0, 20.0, 20.0),
    ("training", 0.30, 0.26, 0.18, 0.10, 0.16, 0.0, 30.0, 30.0),
]
PARTS = ["length", "intensity", "technique", "excitement", "production", "highlight"]

# Tags of older projects, and their codes.
LEGACY_TAGS = {
    "超长多拍": "ultra_long_rally",
    "多拍": "many_shots",
    "快节奏": "fast_tempo",
    "末段提速": "late_acceleration",
    "高强度跑动": "high_mobility",
    "高速球": "fast_shuttle",
    "长回合": "long_rally",
    "短回合": "short_rally",
    "高分": "high_score",
    "低置信": "low_confidence",
}

#: What is taken of a batch: (name, feature, share).
MEASURES = [
    ("speed_85", "speed", 0.85),
    ("motion_85", "motion_peak", 0.85),
    ("tempo_85", "tempo", 0.85),
    ("finish_85", "finish_tempo", 0.85),
    ("shuttle_85", "shuttle_speed", 0.85),
    ("strength_85", "strength_p90", 0.85),
    ("presence_85", "presence", 0.85),
    ("finish_50", "finish_tempo", 0.5),
    ("finish_90", "finish_tempo", 0.9),
    ("smashes_90", "smashes", 0.9),
    ("streak_90", "streak", 0.9),
    ("variance_90", "tempo_variance", 0.9),
]


def presets(spark) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, " + ", ".join(f"w_{p} double" for p in PARTS) + ", shot_saturate double, dur_saturate double")


def overall_percentiles(df: DataFrame, wanted: list[tuple[str, str, float]], bins: int = 4096) -> DataFrame:
    """One row with the exact percentiles (name, column, share) of all rows of df, linearly interpolated.

    The values are counted in bins first; only those of the bins in which the wanted ranks fall are counted one
    by one, so no task holds all distinct values. Nulls count for nothing; without values all are null.
    """
    columns = list(dict.fromkeys(c for _, c, _ in wanted))
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("c", "v")).where("v is not null")
    ends = F.broadcast(long.groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")))  # a row for each column
    at = F.least(F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * bins), F.lit(bins - 1))
    placed = long.join(ends, "c").withColumn("bin", at)
    ranks = df.sparkSession.createDataFrame(wanted, "name string, c string, q double").join(ends, "c").withColumn("p", F.col("q") * (F.col("n") - 1))
    ranks = ranks.select("name", "c", "p", F.explode(F.array_distinct(F.array(F.floor("p"), F.ceil("p")))).alias("rank"))
    before = lambda *keys: W.partitionBy("c").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    of_bins = placed.groupBy("c", "bin").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(before("bin")), F.lit(0)))
    hit = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("k"))
    found = F.broadcast(of_bins.join(F.broadcast(ranks), "c").where(hit).select("c", "bin", "before").distinct())  # two for each wanted one at most
    exact = placed.join(found, ["c", "bin"]).groupBy("c", "bin", "before", "v").agg(F.count("*").alias("k"))
    in_bin = W.partitionBy("c", "bin").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    exact = exact.withColumn("before", F.col("before") + F.coalesce(F.sum("k").over(in_bin), F.lit(0)))
    values = exact.join(F.broadcast(ranks), "c").where(hit).groupBy("name", "p").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (F.col("p") - F.floor("p"))
    return values.agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name, _, _ in wanted])


def measured(rallies: DataFrame, batch: list[str]) -> DataFrame:
    """rallies with the measures of their batch: of the rows that share the batch's columns, or of all if it has none."""
    if batch:
        of = {c: [(name, q) for name, x, q in MEASURES if x == c] for c in dict.fromkeys(c for _, c, _ in MEASURES)}  # one percentile for each feature
        tops = rallies.groupBy(*batch).agg(*[F.percentile(c, F.array(*[F.lit(q) for _, q in wanted])).alias(c) for c, wanted in of.items()], (F.max("shuttle_speed") > 0).alias("has_shuttle"))
        return rallies.join(tops.select(*batch, "has_shuttle", *[F.col(c)[i].alias(name) for c, wanted in of.items() for i, (name, _) in enumerate(wanted)]), batch)
    tops = overall_percentiles(rallies, MEASURES).crossJoin(rallies.agg((F.max("shuttle_speed") > 0).alias("has_shuttle")))
    return rallies.crossJoin(F.broadcast(tops))  # one row


def capped(x: str, top: str, cap: float) -> Column:
    return clipped(F.col(x) / (F.col(top) + 1e-9), 0.0, cap) / cap


def scores(rallies: DataFrame, batch: list[str]) -> DataFrame:
    """Every interval's sub-scores and total under every preset, relative to its batch.

    The features are duration, shots, tempo, finish_tempo, speed, motion_peak, strength_p90, shuttle_speed,
    presence, confidence, smashes, streak, tempo_variance, sharpness, shake, subject_size (null: not known, the
    production is 70) and speech_bonus. Missing features count as 0, but a streak as 1 and a confidence as 0.5.
    raw is the total before it is clipped to [0, 100].
    """
    zeros = {c: 0.0 for c in ("duration", "shots", "tempo", "finish_tempo", "speed", "motion_peak", "strength_p90", "shuttle_speed", "presence", "smashes", "tempo_variance", "speech_bonus")}
    given = rallies.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in {**zeros, "streak": 1.0}.items()})
    rows = measured(given, batch)
    over = lambda x, top: clipped(F.col(x) / F.greatest(F.col(top), F.lit(1.0)), 0.0, 1.0)
    strength, presence = capped("strength_p90", "strength_85", 1.2), capped("presence", "presence_85", 1.2)
    # what no preset changes comes before they are crossed in
    rows = rows.withColumns({
        "intensity": 100 * clipped(0.38 * capped("speed", "speed_85", 1.2) + 0.22 * capped("motion_peak", "motion_85", 1.2) + 0.18 * capped("tempo", "tempo_85", 1.2) + 0.22 * capped("finish_tempo", "finish_85", 1.3), 0, 1),
        "technique": 100 * clipped(F.when(F.col("has_shuttle"), 0.42 * capped("shuttle_speed", "shuttle_85", 1.2) + 0.34 * strength + 0.24 * presence).otherwise(0.55 * strength + 0.45 * presence), 0, 1),
        "highlight": 100 * clipped(0.40 * over("smashes", "smashes_90") + 0.35 * over("streak", "streak_90") + 0.25 * over("tempo_variance", "variance_90"), 0, 1),
        "production": F.coalesce(100 * clipped(0.45 * clipped(F.col("sharpness"), 0, 1) + 0.25 * (1 - clipped(F.col("shake"), 0, 1)) + 0.30 * clipped(F.when(F.col("subject_size").isNotNull(), F.col("subject_size") / 0.35), 0, 1), 0, 1) + F.col("sharpness") * 0 + F.col("shake") * 0 + F.col("subject_size") * 0, F.lit(70.0)),
        "surge": clipped((F.col("finish_tempo") - F.col("finish_50")) / (F.col("finish_90") - F.col("finish_50") + 1e-9), 0.0, 1.0),
    }).drop(*[name for name, _, _ in MEASURES], "has_shuttle")
    rows = rows.crossJoin(F.broadcast(presets(rallies.sparkSession)))  # six rows
    grows = lambda x, s: 1 - F.exp(-F.col(x) / F.greatest(0.55 * F.col(s), F.lit(1.0)))
    rows = rows.withColumn("length", 100 * clipped(0.62 * grows("shots", "shot_saturate") + 0.38 * grows("duration", "dur_saturate"), 0, 1))
    rows = rows.withColumn("excitement", 100 * clipped(0.30 * F.col("length") / 100 + 0.30 * F.col("intensity") / 100 + 0.20 * F.col("surge") + 0.20 * clipped((F.col("shots") - 6.0) / 14.0, 0.0, 1.0), 0, 1)).drop("surge")
    total = sum((F.col(f"w_{p}") * F.col(p) for p in PARTS[1:]), F.col("w_length") * F.col("length")) * (0.75 + 0.25 * clipped(F.coalesce("confidence", F.lit(0.5)), 0, 1)) + F.col("speech_bonus")
    return rows.withColumn("raw", total).withColumn("total", clipped(F.col("raw"), 0, 100))


def tagged(scored: DataFrame) -> DataFrame:
    """Tags in a fixed order, of those whose rule holds, then the phrases (array<string>, may be null) that aren't tags yet. scored: rows of scores of one preset; a missing confidence counts as sure."""
    shots, duration, raw = F.col("shots"), F.col("duration"), F.col("raw")
    rules = [
        ("ultra_long_rally", shots >= 20),
        ("many_shots", (shots >= 12) & (shots < 20)),
        ("fast_tempo", F.col("tempo") >= 1.5),
        ("late_acceleration", (F.col("finish_tempo") >= 1.8) & (shots >= 6)),
        ("high_mobility", F.col("motion_peak") >= 0.72),
        ("fast_shuttle", F.col("shuttle_speed") >= 0.55),
        ("long_rally", duration >= 25),
        ("short_rally", duration <= 5.5),
        ("high_score", raw >= 75),
        ("low_confidence", F.coalesce("confidence", F.lit(1.0)) < 0.35),
        ("smash", F.col("smashes") >= 2),
        ("confrontation", F.col("streak") >= 6),
        ("highlight", (raw >= 70) & ((F.col("smashes") >= 1) | (F.col("streak") >= 4))),
    ]
    own = F.filter(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]), lambda x: x.isNotNull())
    return scored.withColumn("tags", F.array_union(own, F.filter(F.coalesce("phrases", F.array().cast("array<string>")), lambda x: x != "")))


def migrated(tags: Column) -> Column:
    """Tags with older ones replaced by their codes, once each in the order in which they come first; none for null."""
    codes = F.create_map(*[F.lit(x) for kv in LEGACY_TAGS.items() for x in kv])
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.coalesce(codes[t], t)), lambda t: t != ""))


def statistics(rallies: DataFrame) -> DataFrame:
    """Count, durations and shots of each medium."""
    return rallies.groupBy("media_id").agg(F.count("*").alias("n"), F.sum("duration").alias("total"), F.avg("duration").alias("mean"), F.percentile("duration", F.lit(0.5)).alias("median"), F.max("duration").alias("longest"), F.percentile("speed", F.lit(0.9)).alias("p90"), F.count_if(F.col("speed") >= 0.7).alias("fast"))


def histogram(rallies: DataFrame, column: str, bins: int, least_top: float) -> DataFrame:
    """(bin, n) between 0 and the largest value or least_top; the last bin is closed."""
    top = F.broadcast(rallies.agg(F.greatest(F.lit(least_top), F.max(column)).alias("top")))  # one row
    at = F.least(F.floor(F.col(column) / F.col("top") * bins), F.lit(bins - 1))
    return rallies.crossJoin(top).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
