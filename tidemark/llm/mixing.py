"""Mixing sources to target weights by capped water-filling, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, numbered, staged


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, most_epochs: int) -> DataFrame:
    """sources (source, source_size long, weight) with target added.

    Together the targets are share of all sizes. A source is clamped at most_epochs times its size, and what
    it can't take goes to the others by weight, until none is above: the clamped ones are those with the least
    room per weight, so a running sum in that order finds the level at which the rest stand. If all are
    clamped, the targets fall short of share. One row per source; there are no more rows here than sources.
    """
    order = W.orderBy(F.col("room") / F.col("weight"), "room", F.col("source").asc_nulls_last())
    out = sources.withColumn("room", F.col("source_size") * most_epochs)
    out = out.withColumn("above", F.coalesce(F.sum("room").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("weights", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    out = out.withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
    out = out.withColumn("level", (F.col("total") - F.col("above")) / F.col("weights"))
    # the level stops rising at the first source that has room for it
    fits = F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("level"))
    out = out.withColumn("level", F.first(fits, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    fair = F.coalesce(F.col("level") * F.col("weight"), F.col("room").cast("double"))
    return out.select("source", "source_size", "weight", F.least(fair, F.col("room").cast("double")).alias("target"))


def unit(seed: int) -> Column:
    """48 bits of a seeded hash of doc_id: a row's place in the order of its source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("long")


def _planned(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most_epochs: int = 2, seed: int = 0, buckets: int = 1024) -> DataFrame:
    """What mix returns, with how often each row of a source is taken (whole), whether this one is taken once more, and its unit."""
    sized = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = staged(sized.withColumn("unit", unit(seed)).withColumn("bucket", F.shiftright("unit", 48 - (buckets - 1).bit_length()).cast("int")), "sizes")

    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    turn = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")).withColumn("weight", weight)
    plan = water_fill(sources, share, most_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    marks = by_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    same = marks["source"].eqNullSafe(plan["source"])
    marks = marks.join(plan, same).select(marks["source"].alias("s"), F.col("bucket").alias("b"), "source_size", "target", "whole", "rest", "before", "bucket_size")

    rows = sized.hint("merge").join(marks, sized["source"].eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    cut = (F.col("rest") > F.col("before")) & (F.col("rest") < F.col("before") + F.col("bucket_size"))
    clear = rows.where(~cut).withColumn("more", (F.col("rest") >= F.col("before") + F.col("bucket_size")) & (F.col("rest") > F.col("before")))
    run = W.partitionBy("source", "bucket").orderBy("unit", F.col("doc_id").asc_nulls_first(), "size", "row_id").rowsBetween(W.unboundedPreceding, -1)
    edge = rows.where(cut).withColumn("more", F.col("rest") > F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") / 2)
    return clear.unionByName(edge)


def mix(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs: row_id, doc_id, source, size, source_size, target, reps, taken.

    size: words of the text (null: 0). Sources in code-point order, a null source last, weigh weights in
    turn. Each text of a source is repeated floor(target / source_size) times, and seeded ones once more, in
    the order of a seeded hash until the target is met to within half a text. That order is taken in buckets
    of the hash: whole buckets by their sums, and row by row only in the one where the target falls, so no
    source has to be sorted in one task. Rows that are equal in id and size may change places. A source
    without words has target 0. Null ids are hashed as the empty text; an empty table gives no rows.
    """
    out = _planned(docs, **how).withColumn("reps", F.col("whole") + F.col("more").cast("long"))
    return out.select("row_id", "doc_id", "source", "size", "source_size", "target", "reps", (F.col("size") * F.col("reps")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0, **how) -> DataFrame:
    """The rows of docs as often as mix takes them, with their columns, whatever their names.

    A text without words (null, empty) is taken as often as its source's others; an empty table gives no rows.
    docs is read twice, so it should be a stored table; its texts are neither copied nor shuffled. Rows that mix
    takes once more are the first of their source's order, so a row's place against the last of them says how
    often it is taken. Only those that share the id of that last one, where not all are taken, are numbered and
    counted off.
    """
    place = lambda unit: F.struct(unit.alias("unit"), F.col("doc_id").alias("doc_id"))
    planned = _planned(docs, seed=seed, **how).select("source", "whole", "more", place(F.col("unit")).alias("at"))
    levels = planned.groupBy(F.col("source").alias("of")).agg(F.min("whole").alias("whole"), F.max(F.when(F.col("more"), F.col("at"))).alias("last"), F.min(F.when(~F.col("more"), F.col("at"))).alias("next"))
    levels = staged(levels.withColumn("parted", F.coalesce(F.col("last") == F.col("next"), F.lit(False))), "levels")

    rows = docs.select(F.struct(*docs.columns).alias("doc"), "source", place(unit(seed)).alias("at")).join(levels, F.col("source").eqNullSafe(F.col("of")))
    tied = F.col("parted") & (F.col("at") == F.col("last"))
    out = rows.where(~tied | F.col("last").isNull()).select("doc", (F.col("whole") + F.coalesce(F.col("at") <= F.col("last"), F.lit(False)).cast("long")).alias("reps"))
    if levels.where("parted").count():
        parted = levels.where("parted")
        more = planned.where("more").join(parted.select("of", "last"), F.col("source").eqNullSafe(F.col("of")) & (F.col("at") == F.col("last"))).groupBy("of").agg(F.count("*").alias("k"))
        some, row = numbered(rows.where(tied).select("doc", "source", "whole"))
        nth = F.row_number().over(W.partitionBy("source").orderBy("size", row))
        reps = some.select(row, "source", "whole", n_words(F.col("doc.text")).alias("size")).withColumn("nth", nth).join(more, F.col("source").eqNullSafe(F.col("of")))
        reps = reps.select(row, (F.col("whole") + (F.col("nth") <= F.col("k")).cast("long")).alias("reps"))
        out = out.union(some.hint("merge").join(reps, row).select("doc", "reps"))
    return out.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("reps").cast("int"))).alias("time")).select("doc.*")


def op4(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS unit
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 2 * source_size AS room,
         coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS above,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total, row_number() OVER o AS nth
  FROM sources WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / weight, 2 * source_size, source NULLS LAST)),
levels AS (SELECT *, (total - above) / weights AS lvl FROM ordered),
level AS (SELECT arg_min(lvl, nth) FILTER (lvl * weight <= room) AS fit FROM levels),
plan AS (
  SELECT source, source_size, least(coalesce(fit * weight, room::DOUBLE), room::DOUBLE) AS target FROM levels, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM plan),
runs AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.unit, s.doc_id NULLS FIRST, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * (whole + (rest > before + size / 2.0::DOUBLE)::BIGINT) AS taken FROM runs
"""
