"""Irregular events (media_id, hit_idx, t, strength, confidence): gaps, clusters, densities, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def run():
    return W.partitionBy("media_id").orderBy("t", "hit_idx")


def gaps(hits: DataFrame) -> DataFrame:
    return hits.withColumn("gap", F.col("t") - F.lag("t").over(run()))


def named_clusters(hits: DataFrame, gap: float) -> DataFrame:
    """hits with their cluster: a gap longer than gap begins a new one; an equal one does not."""
    flagged = gaps(hits).withColumn("new", F.when(F.col("gap") > gap, 1).otherwise(0))
    return flagged.withColumn("cluster", F.sum("new").over(run().rowsBetween(W.unboundedPreceding, 0))).drop("new", "gap")


def clusters(hits: DataFrame, gap: float, least_hits: int = 2, least_span: float = 0.0) -> DataFrame:
    """(media_id, cluster, start, end, n, confidence) of the clusters with enough hits and time."""
    out = named_clusters(hits, gap).groupBy("media_id", "cluster").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"))
    out = out.where((F.col("n") >= least_hits) & (F.col("end") - F.col("start") >= least_span))
    return out.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.15), F.col("n") / 12)))


def streaks(hits: DataFrame, gap: float) -> DataFrame:
    """(media_id, streak): the longest run of gaps up to gap, counted in hits; 1 at least."""
    flagged = gaps(hits).withColumn("new", F.when(F.coalesce(F.col("gap") <= gap, F.lit(False)), 0).otherwise(1))
    named = flagged.withColumn("run", F.sum("new").over(run().rowsBetween(W.unboundedPreceding, 0)))
    return named.groupBy("media_id", "run").agg(F.count("*").alias("n")).groupBy("media_id").agg(F.max("n").alias("streak"))


def gap_limit(hits: DataFrame, lo: float, hi: float, factor: float = 1.8) -> DataFrame:
    """factor times the 70th percentile of the positive gaps, kept in [lo, hi]; lo for fewer than 3 hits or 2 gaps."""
    out = gaps(hits).groupBy("media_id").agg(F.count("*").alias("n"), F.count_if(F.col("gap") > 1e-6).alias("g"), F.percentile(F.when(F.col("gap") > 1e-6, F.col("gap")), F.lit(0.7)).alias("p"))
    limit = F.least(F.lit(hi), F.greatest(F.lit(lo), factor * F.col("p")))
    return out.select("media_id", F.when((F.col("n") < 3) | (F.col("g") < 2), F.lit(lo)).otherwise(limit).alias("gap_limit"))


def tempo_tail(hits: DataFrame) -> DataFrame:
    """(media_id, finish_tempo): one over the median of the last third of the gaps, the last two at least."""
    rows = gaps(hits).where("gap is not null")
    rows = rows.withColumn("back", F.row_number().over(W.partitionBy("media_id").orderBy(F.desc("t"), F.desc("hit_idx")))).withColumn("n", F.count("*").over(W.partitionBy("media_id")))
    tail = rows.where(F.col("back") <= F.greatest(F.lit(2), F.floor(F.col("n") / 3)))
    return tail.groupBy("media_id").agg((1 / F.greatest(F.percentile("gap", F.lit(0.5)), F.lit(1e-3))).alias("finish_tempo"))


def local_percentile(hits: DataFrame, reach: float) -> DataFrame:
    """The share of the hits within reach whose strength is not above a hit's own. Hits are binned by time, so the range join has an equi-key."""
    at = F.floor(F.col("t") / reach)
    near = hits.select("media_id", F.explode(F.array(at - 1, at, at + 1)).alias("bin"), F.col("t").alias("u"), F.col("strength").alias("s"))
    pairs = hits.withColumn("bin", at).join(near, ["media_id", "bin"]).where(F.abs(F.col("t") - F.col("u")) <= reach)
    out = pairs.groupBy("media_id", "hit_idx").agg(F.count("*").alias("n"), F.count_if(F.col("s") <= F.col("strength")).alias("below"), (F.max("s") - F.min("s")).alias("spread"))
    share = F.when(F.col("n") == 1, 1.0).when(F.col("spread") < 1e-6, 0.0).otherwise(F.col("below") / F.col("n"))
    return out.select("media_id", "hit_idx", share.alias("local_pct"))


def density(hits: DataFrame, slot: float, least_confidence: float) -> DataFrame:
    """(media_id, slot, n) of the confident hits; of all where none is."""
    good = F.max((F.col("confidence") >= least_confidence).cast("int")).over(W.partitionBy("media_id"))
    kept = hits.withColumn("any", good).where((F.col("confidence") >= least_confidence) | (F.col("any") == 0))
    return kept.groupBy("media_id", F.floor(F.col("t") / slot).alias("slot")).agg(F.count("*").alias("n"))


def reliability(hits: DataFrame, bin_: float, burst: float) -> DataFrame:
    """(media_id, n, coverage, bursts): share of bins with a hit over the time covered, and of gaps shorter than burst; below 8 hits 0."""
    rows = gaps(hits)
    out = rows.groupBy("media_id").agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("t") / bin_)).alias("bins"), (F.max("t") - F.min("t")).alias("span"), F.avg((F.col("gap") < burst).cast("double")).alias("bursts"))
    cover = F.least(F.lit(1.0), F.col("bins") / F.greatest(F.lit(1.0), F.ceil(F.col("span") / bin_)))
    few = F.col("n") < 8
    return out.select("media_id", "n", F.when(few, 0.0).otherwise(cover).alias("coverage"), F.when(few, 0.0).otherwise(F.col("bursts")).alias("bursts"))


def rank_share(hits: DataFrame) -> DataFrame:
    """Tie-averaged rank of strength over n - 1; a single hit 0.5."""
    w = W.partitionBy("media_id").orderBy("strength")
    n, ties = F.count("*").over(W.partitionBy("media_id")), F.count("*").over(W.partitionBy("media_id", "strength"))
    return hits.select("media_id", "hit_idx", F.when(n == 1, 0.5).otherwise((F.rank().over(w) + (ties - 1) / 2 - 1) / (n - 1)).alias("pct_rank"))


def bin_share(hits: DataFrame, width: float, duration: float) -> DataFrame:
    """(media_id, coverage): the share of a duration's bins with a hit."""
    return hits.groupBy("media_id").agg((F.count_distinct(F.floor(F.col("t") / width)) / (duration / width)).alias("coverage"))
