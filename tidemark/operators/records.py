"""Records of projects, media, jobs and presets: upserts, cascades, patches, orders, caps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by keys; a new row's values win where they are not null. Columns are old's."""
    rest = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *[F.col(c).alias(f"_{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(f"_{c}") for c in rest])
    return old.join(fresh, keys, "full").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])


def purged(tables: Mapping[str, DataFrame], gone: DataFrame, key: str = "media_id") -> dict[str, DataFrame]:
    """Every table without the rows whose key is gone."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def cleared(df: DataFrame, when: Column, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.coalesce(when, F.lit(False)), F.col(c)) for c in columns})


def patched(df: DataFrame, when: Column, patch: Mapping[str, object], allowed: tuple[str, ...] = ("keep", "starred", "note", "clip_start", "clip_end", "start", "end", "tags")) -> DataFrame:
    """The patch's values, of allowed columns only, in the rows where when holds; the row's updated flag says which."""
    hit = F.coalesce(when, F.lit(False))
    values = {c: F.when(hit, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in patch.items() if c in allowed and c in df.columns}
    return df.withColumns(values | {"updated": hit})


def filtered(rallies: DataFrame, **bounds) -> DataFrame:
    """Conjunction of least_/most_<column> bounds, flags and tags (any of them); no bound, every row."""
    holds = F.lit(True)
    for name, value in bounds.items():
        if name.startswith("least_"):
            holds &= F.col(name.removeprefix("least_")) >= value
        elif name.startswith("most_"):
            holds &= F.col(name.removeprefix("most_")) <= value
        elif name == "tags":
            holds &= F.arrays_overlap("tags", F.array(*[F.lit(t) for t in value]))
        elif name == "search":
            holds &= F.contains(F.col("haystack"), F.lit(value.lower()))
        else:
            holds &= F.col(name) == value
    return rallies.where(holds)


def top_share(df: DataFrame, by: str, share: float, key: list[str], tie: str) -> DataFrame:
    """kept: the best share of each group's rows, rounded up."""
    group = W.partitionBy(*key)
    return df.withColumn("kept", F.row_number().over(group.orderBy(F.desc(by), tie)) <= F.ceil(share * F.count("*").over(group)))


def newest(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def pruned(jobs: DataFrame, owner: str, finished: Column, by: str, keep: int, tie: str) -> DataFrame:
    """Jobs without each owner's finished ones beyond the newest keep."""
    rank = F.row_number().over(W.partitionBy(owner, finished).orderBy(F.desc(by), tie))
    return jobs.withColumn("rank", rank).where(~finished | (F.col("rank") <= keep)).drop("rank")


def expanded(paths: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, place): media files once each, in natural order, in which numbers within names count as numbers."""
    rows = paths.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).dropDuplicates(["path"])
    parts = F.regexp_extract_all("path", F.lit(r"(\d+|\D+)"), F.lit(1))
    natural = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")
    # paths of one folder are ordered, each folder by itself, so no task sees all of them
    folder = F.regexp_extract("path", r"^(.*)/", 1)
    rows = rows.withColumn("folder", folder).withColumn("natural", natural)
    return rows.select("path", F.row_number().over(W.partitionBy("folder").orderBy("natural", "path")).alias("place"))


def byte_range(size: Column, spec: Column) -> tuple[Column, Column, Column]:
    """(first, last, status) of a Range header: bytes=a-b, bytes=a-, bytes=-n; 416 where it lies beyond the file."""
    a, b = F.regexp_extract(spec, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(spec, r"^bytes=(\d*)-(\d*)$", 2)
    number = lambda c: F.when(c != "", c.cast("long"))
    first = F.when(a == "", F.greatest(F.lit(0), size - number(b))).otherwise(number(a))
    last = F.when((a == "") | (b == ""), size - 1).otherwise(F.least(size - 1, number(b)))
    bad = (first >= size) | (first > last) | first.isNull()
    status = F.when(F.coalesce(bad, F.lit(True)), 416).otherwise(206)
    return F.when(status == 206, first), F.when(status == 206, last), status


def free_suffix(names: DataFrame) -> DataFrame:
    """(base, suffix): the least number, from 0, that no taken name (base, taken) of the base has; a base without numbers, or with negative ones alone, gets 0.

    The n distinct numbers of a base that are not their own rank from 0 leave that rank free first.
    """
    taken = names.select("base", F.when(F.col("taken") >= 0, F.col("taken").cast("long")).alias("taken")).distinct()
    rank = F.row_number().over(W.partitionBy("base").orderBy(F.col("taken").asc_nulls_last())) - 1
    rows = taken.withColumn("rank", rank.cast("long"))
    hole = F.min(F.when(F.col("taken").isNull() | (F.col("taken") != F.col("rank")), F.col("rank")))
    return rows.groupBy("base").agg(F.coalesce(hole, F.max("rank") + 1).alias("suffix"))


def shoelace(polygon: Column) -> Column:
    """The area of a polygon column, an array of (x, y) structs."""
    ahead = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    cross = F.zip_with(polygon, ahead, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def good_polygon(polygon: Column, least_area: float = 0.02, reach: float = 1.5) -> Column:
    """4 to 24 finite points within reach that enclose least_area."""
    inside = F.forall(polygon, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) <= reach) & (F.abs(p["y"]) <= reach))
    return F.size(polygon).between(4, 24) & inside & (shoelace(polygon) >= least_area)
