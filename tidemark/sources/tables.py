"""The data model's frames, read from the test tables.

events are hits of a medium (a user), lineitem holds a regular signal for each medium (a supplier), and
orders are the scored intervals ("rallies") of a medium (a customer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, hit_idx, t in hours, strength, confidence)."""
    rows = read(spark, sf_dir, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    confidence = F.get_json_object("props", "$.k").cast("double") / 99
    return rows.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("hit_idx"), t.alias("t"), (F.col("value") / 500).alias("strength"), confidence.alias("confidence"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, idx, value), idx from 0 without holes."""
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("media_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("l_quantity").alias("value"))


def rallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, rally_id, start in days, end, duration, shots, speed, confidence)."""
    rows = read(spark, sf_dir, "orders")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(8.64e10)
    out = rows.select(F.col("o_custkey").alias("media_id"), F.col("o_orderkey").alias("rally_id"), start.alias("start"), (F.col("o_totalprice") / 10000).alias("duration"))
    out = out.withColumn("end", F.col("start") + F.col("duration"))
    return out.withColumn("shots", F.pmod("rally_id", F.lit(29)).cast("int")).withColumn("speed", F.pmod(F.col("rally_id") * 7, F.lit(101)) / 100.0).withColumn("confidence", F.pmod(F.col("rally_id") * 3, F.lit(97)) / 96.0)


#: Features of rallies that the tables have no column for, as SQL over rally_id and media_id.
FEATURES = {
    "tempo": "(rally_id * 11 % 83) / 40e0",
    "finish_tempo": "(rally_id * 13 % 79) / 30e0",
    "motion_peak": "(rally_id * 17 % 89) / 88e0",
    "strength_p90": "(rally_id * 19 % 73) / 72e0",
    "shuttle_speed": "CASE WHEN media_id % 3 = 0 THEN 0e0 ELSE (rally_id * 23 % 71) / 70e0 END",
    "presence": "(rally_id * 29 % 67) / 66e0",
    "smashes": "(rally_id % 5) * 1e0",
    "streak": "(1 + rally_id % 9) * 1e0",
    "tempo_variance": "(rally_id * 31 % 61) / 20e0",
    "sharpness": "CASE WHEN rally_id % 7 > 0 THEN (rally_id * 37 % 59) / 58e0 END",
    "shake": "CASE WHEN rally_id % 7 > 0 THEN (rally_id * 41 % 53) / 52e0 END",
    "subject_size": "CASE WHEN rally_id % 7 > 0 THEN (rally_id * 43 % 47) / 100e0 END",
    "speech_bonus": "CASE WHEN rally_id % 10 = 0 THEN 5e0 END",
}


def scored_rallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rallies with all features that scores need, and phrases."""
    rows = rallies(spark, sf_dir)
    phrases = F.when(F.col("rally_id") % 10 == 0, F.when(F.col("rally_id") % 20 == 0, F.array(F.lit("nice"), F.lit("smash"))).otherwise(F.array(F.lit("nice"))))
    return rows.withColumns({k: F.expr(v) for k, v in FEATURES.items()}).withColumn("phrases", phrases)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media_id, frame, track, box_id, x1, y1, x2, y2, conf): four numbers of a vector as corners, some beyond the picture."""
    rows = read(spark, sf_dir, "embeddings")
    e = lambda i: F.least(F.lit(1.3), F.greatest(F.lit(-0.3), 0.5 + 1.5 * F.col("embedding")[i].cast("double")))
    corners = [f(e(i), e(i + 1)).alias(c) for c, f, i in (("x1", F.least, 0), ("y1", F.least, 2), ("x2", F.greatest, 0), ("y2", F.greatest, 2))]
    return rows.select(F.pmod("vec_id", F.lit(4)).alias("media_id"), F.floor(F.col("vec_id") / 32).alias("frame"), F.col("label").cast("long").alias("track"), F.col("vec_id").alias("box_id"), *corners, F.least(F.lit(1.0), F.greatest(F.lit(0.0), e(4))).alias("conf"))
