"""Connected components of an undirected graph, as joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import staged, unstage

#: Into how many parts the rows of one key are dealt.
SALTS = 32


def with_least(rows: DataFrame, key: str, value: str, wanted=None) -> DataFrame:
    """The wanted rows (all, unless given) with `least`, the least value that any row of their key has.

    The rows of a key are dealt into SALTS parts by their hash and never meet in one task; only the parts' own
    least values do. Null keys have no row; columns called salt and least must not be among those of rows.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "salt").agg(F.min(value).alias("least"))
    parts = parts.withColumn("least", F.min("least").over(W.partitionBy(key)))
    return (salted if wanted is None else salted.where(wanted)).join(parts, [key, "salt"]).drop("salt")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node of node's component; nodes without an edge have no row.

    edges has columns a and b of one orderable type; null ends, loops and repeated edges count for nothing.
    Large stars and small stars alternate until nothing changes; each round gives every row its node's least
    neighbour twice, with the rows of a hot node dealt into parts.
    """
    now = staged(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "least").alias("v")).where("u != v").distinct()
        ends = F.explode(F.array(F.struct("v", "least"), F.struct(F.col("u").alias("v"), "least")))
        small = with_least(large, "u", "v").select(ends.alias("end")).select(F.col("end.v").alias("u"), F.col("end.least").alias("v"))
        last, now = now, staged(small.where("u != v").distinct(), "edges")
        unstage(last)
    else:
        raise RuntimeError("the components have not settled")
    stars = now.groupBy("u").agg(F.min("v").alias("v"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v"), F.col("v")).distinct())
