"""Scalar functions of columns: clamps, phrases, time codes, grades, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x))


def phrases(raw: Column, most: int, longest: int) -> Column:
    """The first most distinct of an array's texts without white space, cut to longest characters; empty ones go."""
    cut = F.transform(raw, lambda x: F.substring(F.regexp_replace(x, r"\s", ""), 1, longest))
    return F.slice(F.array_distinct(F.filter(cut, lambda x: x != "")), 1, most)


def timecode(seconds: Column, fps: int) -> Column:
    """hh:mm:ss:ff; a null gives null."""
    n = F.floor(seconds * fps)
    parts = [F.floor(n / (3600 * fps)), F.pmod(F.floor(n / (60 * fps)), F.lit(60)), F.pmod(F.floor(n / fps), F.lit(60)), F.pmod(n, F.lit(fps))]
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d:%02d:%02d", *[p.cast("long") for p in parts]))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "S").when(score >= 70, "A").when(score >= 55, "B").when(score >= 40, "C").otherwise("D")


def proxy_size(w: Column, h: Column, longest: int) -> tuple[Column, Column]:
    """Width and height with the longest edge at most longest, both even and 2 at least."""
    k = F.least(F.lit(1.0), longest / F.greatest(w, h).cast("double"))
    even = lambda x: F.greatest(F.lit(2), 2 * F.floor(x * k / 2)).cast("int")
    return even(w), even(h)


def tempo_chain(speed: Column) -> Column:
    """Factors within [0.5, 2] whose product is a positive speed: as many 2s or 0.5s as it takes, and a rest."""
    steps = F.greatest(F.lit(0), F.ceil(F.abs(F.log2(speed))) - 1).cast("int")
    whole = F.when(speed > 1, F.lit(2.0)).otherwise(F.lit(0.5))
    return F.concat(F.array_repeat(whole, steps), F.array(speed / F.pow(whole, steps)))
