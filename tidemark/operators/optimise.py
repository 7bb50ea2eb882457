"""Finding the settings of a segmentation that fit labelled intervals best: grids, padding, coordinate descent.

Parameters are rows (media_id, param_id, settings); all of a medium's are segmented and scored together, and media
are searched side by side. What wins stays a frame from stage to stage, nothing is collected.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import segmentation as sg
from tidemark.operators.intervals import overlaps
from tidemark.operators.kernels import matched, quiet_by, quiet_depths, quietest_cuts, walked
from tidemark.operators.lineage import cut

OWN, SETTINGS = list(sg.OWN), list(sg.SETTINGS)
#: What scores weigh: intervals that match by this IoU, and ends within so many seconds of pairs that match by that one.
IOU, BAND, LOOSE, BAND_WEIGHT = 0.5, 1.0, 0.3, 0.3
#: What a descent multiplies a setting by, what it must gain, what F1 it may lose, how often it goes round.
FACTORS, GAIN, FLOOR, PASSES = (0.5, 0.75, 1.0, 1.3, 1.7), 0.002, 0.005, 2
#: The values that a search tries at least, and the bounds of those that labels suggest.
GRID = {"ratio": [0.10, 0.15, 0.22, 0.30], "core": [0.8, 1.2, 1.8, 2.5], "rest": [0.6, 0.8, 1.2], "apart": [0.6, 0.8, 1.0], "least": [2.0, 2.5, 3.0]}
#: The 288 settings that a sweep tries.
SWEPT = GRID | {"apart": [0.6, 1.0]}
BOUNDS = {"least": (1.5, 4.0), "core": (0.6, 3.0), "rest": (0.4, 1.6), "apart": (0.4, 1.4)}
SCORES = ["n", "tp", "fp", "fn", "precision", "recall", "f1", "band_f1", "score"]


def best_of(results: DataFrame, *by: str) -> DataFrame:
    """Each medium's best result by the columns (score, F1, recall, precision, unless given), of equal ones the first parameters."""
    keys = by or ("score", "f1", "recall", "precision")
    rank = F.row_number().over(W.partitionBy("media_id").orderBy(*(F.desc(k) for k in keys), "param_id"))
    return results.withColumn("rank", rank).where("rank = 1").drop("rank")


def grid(base: DataFrame, values: dict[str, list[float] | str]) -> DataFrame:
    """base (media_id, settings) with every combination of values, numbered in the order of the lists, the last field first; a field's values are a list or the name of a column that has it."""
    rows = base.withColumn("param_id", F.lit(0).cast("long"))
    for field, some in values.items():
        options = F.col(some) if isinstance(some, str) else F.array(*(F.lit(float(v)) for v in some))
        rows = rows.withColumn("options", options).select("*", F.posexplode("options").alias("at", "value"))
        rows = rows.withColumn("param_id", F.col("param_id") * F.size("options") + F.col("at")).drop(field, "at", "options").withColumnRenamed("value", field)
    return rows.select(*OWN, *SETTINGS)


def suggested(labels: DataFrame) -> DataFrame:
    """(media_id, least_grid, core_grid, rest_grid, apart_grid): GRID's values and those that labels suggest.

    Of the lengths (gaps) of three labels or more the 10th and 25th percentile are scaled, put within the bounds
    and rounded to a tenth.
    """
    order = W.partitionBy("media_id").orderBy("start", "end")
    rows = labels.withColumns({"d": F.col("end") - F.col("start"), "g": F.lead("start").over(order) - F.col("end")})
    pair = F.array(F.lit(0.1), F.lit(0.25))
    gap = F.when(F.col("g") > 0, F.col("g"))
    rows = rows.groupBy("media_id").agg(F.when(F.count("d") >= 3, F.percentile("d", pair)).alias("d"), F.when(F.count(gap) >= 3, F.percentile(gap, pair)).alias("g"))

    def values(field: str, of: str, a: float, b: float) -> Column:
        lo, hi = BOUNDS[field]
        fixed = F.array(*(F.lit(v) for v in GRID[field]))
        near = lambda x, by: F.bround(F.least(F.lit(hi), F.greatest(F.lit(lo), x * by)), 1)
        more = F.filter(F.array(near(F.col(of)[0], a), near(F.col(of)[1], b)), lambda x: x.between(lo, hi))
        return F.array_sort(F.when(F.col(of).isNull(), fixed).otherwise(F.array_union(fixed, more)))

    return rows.select("media_id", values("least", "d", 0.6, 0.8).alias("least_grid"), values("core", "d", 0.4, 0.5).alias("core_grid"), values("rest", "g", 0.5, 0.7).alias("rest_grid"), values("apart", "g", 0.5, 0.7).alias("apart_grid"))


def scored(rows: DataFrame) -> DataFrame:
    """rows with fp, fn, precision, recall, f1, band_f1 and score, of n intervals, labels, tp matches and the starts and ends of loose ones that are within BAND."""
    rows = rows.withColumns({"fp": F.col("n") - F.col("tp"), "fn": F.col("labels") - F.col("tp")})
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    f1 = lambda tp: share(2 * tp, F.col("n") + F.col("labels"))  # noqa: E731  both sums hold tp
    rows = rows.withColumns({"precision": F.round(share(F.col("tp"), F.col("n")), 4), "recall": F.round(share(F.col("tp"), F.col("labels")), 4), "f1": F.round(f1(F.col("tp")), 4)})
    rows = rows.withColumn("band_f1", F.round((F.round(f1(F.col("starts")), 4) + F.round(f1(F.col("ends")), 4)) / 2, 4))
    return rows.withColumn("score", F.round((1 - BAND_WEIGHT) * F.col("f1") + BAND_WEIGHT * F.col("band_f1"), 4))


@dataclass
class Search:
    """A motion signal (media_id, idx, value), the media's durations (media_id, duration) and labels (media_id, rally_id, start, end), and perhaps a coverage and a focus (media_id, lo, hi).

    Only what lies in the span of a medium's labels, and in its focus if that overlaps them, is scored; labels that
    do not end after they start are left out, and media without labels. width: seconds of the bins in which intervals meet.
    """

    signal: DataFrame
    durations: DataFrame
    labels: DataFrame
    fps: float
    coverage: DataFrame | None = None
    focus: DataFrame | None = None
    width: float = 30.0

    def __post_init__(self):
        self.labels = cut(self.labels.where("end > start"))
        box = self.labels.groupBy("media_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("labels"))
        if self.focus is not None:
            seen = self.focus.select("media_id", F.col("lo").alias("flo"), F.col("hi").alias("fhi"))
            inside = (F.greatest("lo", "flo") < F.least("hi", "fhi")) & F.col("flo").isNotNull()
            box = box.join(seen, "media_id", "left").select("media_id", F.when(inside, F.greatest("lo", "flo")).otherwise(F.col("lo")).alias("lo"), F.when(inside, F.least("hi", "fhi")).otherwise(F.col("hi")).alias("hi"), "labels")
        self.media = cut(sg.lengths(self.signal).join(self.durations, "media_id").join(box, "media_id"))

    def predicted(self, params: DataFrame) -> DataFrame:
        """(media_id, param_id, rally_id, start, end, score): what the parameters (media_id, param_id, settings) make of the signal, in the window."""
        media = params.select(*OWN, *SETTINGS).join(self.media.select("media_id", "n", "duration"), "media_id")
        quiet = cut(quiet_by(self.signal, params, self.fps))
        found = sg.cut_by_motion(self.signal, quiet, media, self.fps, self.coverage)
        return found.join(self.media.select("media_id", "lo", "hi"), "media_id").where("end > lo and start < hi").drop("lo", "hi")

    def pairs(self, found: DataFrame) -> DataFrame:
        """Overlaps of predicted intervals with labels; rally_id holds param_id in its upper bits."""
        rows = found.withColumn("rally_id", F.shiftleft("param_id", sg.BITS) + F.col("rally_id"))
        return overlaps(rows, self.labels, self.width).withColumn("param_id", F.shiftright("rally_id", sg.BITS))

    def evaluated(self, params: DataFrame) -> DataFrame:
        """params with n, tp, fp, fn, precision, recall, f1, band_f1, score and the medians of how far the starts and ends of loosely matched intervals are off."""
        found = cut(self.predicted(params))
        pairs = cut(self.pairs(found).where(F.col("iou") >= LOOSE).select(*OWN, "rally_id", "other_id", "iou", "start", "end", "s", "e"))
        good = matched(pairs.where(F.col("iou") >= IOU), tuple(OWN)).groupBy(*OWN).agg(F.count("*").alias("tp"))
        loose = matched(pairs, tuple(OWN)).join(pairs.drop("iou"), [*OWN, "rally_id", "other_id"])
        within = lambda a, b: F.sum((F.abs(F.col(a) - F.col(b)) <= BAND).cast("long"))
        off = lambda a, b: F.round(F.percentile(F.col(a) - F.col(b), F.lit(0.5)), 3)
        loose = loose.groupBy(*OWN).agg(within("start", "s").alias("starts"), within("end", "e").alias("ends"), off("start", "s").alias("start_off"), off("end", "e").alias("end_off"))
        rows = params.select(*OWN, *SETTINGS).join(self.media.select("media_id", "labels"), "media_id")
        for one in (found.groupBy(*OWN).agg(F.count("*").alias("n")), good, loose):
            rows = rows.join(one, OWN, "left")
        rows = scored(rows.fillna(0, ["n", "tp", "starts", "ends"]))
        return cut(rows.select(*OWN, *SETTINGS, *SCORES, "start_off", "end_off"))

    def base(self, **settings: float) -> DataFrame:
        return sg.settled(self.media.select("media_id"), **settings)

    def segmented(self, base: DataFrame, values: dict | None = None) -> DataFrame:
        """The results of a grid around base; without values, GRID's and those that the labels suggest."""
        if values is None:
            base = base.join(suggested(self.labels), "media_id")
            values = {"ratio": GRID["ratio"]} | {k: f"{k}_grid" for k in ("core", "rest", "apart", "least")}
        return self.evaluated(cut(grid(base, values)))

    def padded(self, now: DataFrame, at_first: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(now with pre and post made up for what the first result's ends are off, the results): only where they are off by a quarter second, the score rises and F1 loses FLOOR at most."""
        rows = now.join(at_first.select("media_id", F.col("start_off").alias("ds"), F.col("end_off").alias("de")), "media_id")
        rows = rows.where((F.abs("ds") >= 0.25) | (F.abs("de") >= 0.25))
        moved = lambda c, by: F.round(F.least(F.lit(2.0), F.greatest(F.lit(0.0), c + by)), 2)
        both = lambda c, by: F.array_sort(F.array_distinct(F.array(F.col(c), moved(F.col(c), by))))
        rows = rows.withColumns({"pres": both("pre", F.col("ds")), "posts": both("post", -F.col("de"))})
        tried = self.evaluated(cut(grid(rows.drop("param_id"), {"pre": "pres", "post": "posts"})))
        return accepted(now, best_of(tried), F.col("new.score") > F.col("old.score")), tried

    def descended(self, now: DataFrame, fields: dict[str, tuple[float, float]], passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
        """(now after a descent, all results): the fields, each within its range, one after another are multiplied by FACTORS.

        A field's best result (of equal scores that of the factor nearest to 1, then the first) is taken if it
        gains more than GAIN and loses FLOOR of F1 at most. A round in which no medium moves is the last.
        """
        every = None
        for _ in range(passes):
            before = now
            for field, (lo, hi) in fields.items():
                new = [F.round(F.least(F.lit(hi), F.greatest(F.lit(lo), F.col(field) * f)), 4) for f in FACTORS]
                options = F.array(*(F.struct(v.alias("value"), F.abs(F.lit(f - 1.0)).alias("far"), F.lit(i).cast("long").alias("at")) for i, (f, v) in enumerate(zip(FACTORS, new))))
                rows = now.select("media_id", *SETTINGS, F.explode(options).alias("o")).where(F.abs(F.col("o.value") - F.col(field)) >= 1e-9)
                rows = cut(rows.withColumn(field, F.col("o.value")).select("media_id", F.col("o.at").alias("param_id"), *SETTINGS, F.col("o.far").alias("far")))
                tried = self.evaluated(rows)
                every = tried if every is None else every.union(tried)
                order = W.partitionBy("media_id").orderBy(F.desc("score"), "far", "param_id")
                best = tried.join(rows.select(*OWN, "far"), OWN).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "far")
                now = accepted(now, best, F.col("new.score") > F.col("old.score") + GAIN)
            if now.exceptAll(before).isEmpty():
                break
        return now, every


def accepted(now: DataFrame, new: DataFrame, gains: Column) -> DataFrame:
    """Of each medium the new result where it gains and loses FLOOR of F1 at most, else the present one."""
    old = now.alias("old").join(new.alias("new"), F.col("old.media_id") == F.col("new.media_id"), "left")
    take = F.coalesce(gains & (F.col("new.f1") >= F.col("old.f1") - FLOOR), F.lit(False))
    return cut(old.select(*(F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in now.columns)))


def optimised(search: Search, values: dict | None = None, fields: dict[str, tuple[float, float]] | None = None, **settings: float) -> DataFrame:
    """(media_id, stage, tried, settings, scores): each medium's result at the baseline, after the grid (segment), the padding and the descent (final).

    The grid's best is taken as it is; padding and descent only where they gain. fields: what the descent varies.
    """
    first = search.evaluated(search.base(**settings))
    made = search.segmented(first, values)
    segment = best_of(made)
    padding, tried_pads = search.padded(segment, first)
    final, tried = search.descended(padding, fields) if fields else (padding, None)
    count = lambda df: df.groupBy("media_id").agg(F.count("*").alias("tried")) if df is not None else None
    out = None
    for stage, rows, n in (("baseline", first, count(first)), ("segment", segment, count(made)), ("padding", padding, count(tried_pads)), ("final", final, count(tried))):
        rows = rows.join(n, "media_id", "left") if n is not None else rows.withColumn("tried", F.lit(None).cast("long"))
        rows = rows.select("media_id", F.lit(stage).alias("stage"), F.coalesce("tried", F.lit(0)).alias("tried"), *SETTINGS, *SCORES)
        out = rows if out is None else out.union(rows)
    return out


def _percentile(x: np.ndarray, p: float) -> float:
    """Of sorted values, added up as Spark does it."""
    at = (len(x) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    return float(x[lo] if x[lo] == x[hi] else (hi - at) * x[lo] + (at - lo) * x[hi])


class _Medium:
    """A medium's samples and labels (rally_id, start, end), and the intervals by motion that settings make of them (segmentation.cut_by_motion). What settings have in common is found once."""

    def __init__(self, idx: np.ndarray, x: np.ndarray, labels: np.ndarray, n: int, duration: float, window: tuple[float, float], fps: float, known: np.ndarray | None):
        self.idx, self.x, self.labels, self.n, self.duration, self.window, self.fps, self.known = idx, x, labels, n, duration, window, fps, known
        x = np.sort(x[~np.isnan(x)])
        base, top = (_percentile(x, 0.2), _percentile(x, 0.95)) if len(x) else (0.0, 0.0)
        self.moving = idx[self.x >= base + 0.25 * max(top - base, 1e-9)]
        self.quiet, self.clumps, self.pairs = {}, {}, {}

    def clump(self, lo: int, hi: int) -> tuple[int, int] | None:
        """The longest clump of moving samples of a span, of equal ones the first, if it is dense and its and the span's ends are near known samples."""
        at = self.moving[np.searchsorted(self.moving, lo) : np.searchsorted(self.moving, hi)]
        if not len(at):
            return None
        cuts = np.flatnonzero(np.diff(at) > max(1, round(0.35 * self.fps))) + 1
        begins, ends = np.r_[0, cuts], np.r_[cuts, len(at)]
        k = int(np.argmax(at[ends - 1] - at[begins]))
        first, last, n = int(at[begins[k]]), int(at[ends[k] - 1]), int(ends[k] - begins[k])
        if n / (last - first + 1) < 0.35:
            return None
        if self.known is not None:
            places, reach = np.array([lo, hi - 1, first, last]), round(0.75 * self.fps)
            if (np.searchsorted(self.known, places - reach) == np.searchsorted(self.known, places + reach, "right")).any():
                return None
        return first, last

    def spans(self, o: dict[str, float]) -> list[tuple[int, int, int]]:
        """(number, lo, hi) of segmentation.between_quiet, resting."""
        if (mark := (o["apart"], o["ratio"])) not in self.quiet:
            self.quiet[mark] = quiet_depths(self.x, self.fps, o["apart"], 0.0, o["ratio"])
        if self.known is not None and not len(self.known):
            return []
        quiet, fps, core, known = self.quiet[mark], self.fps, o["core"], 0 if self.known is None else int(self.known[0])
        least, out = math.floor(core * fps), []
        for k, (a, b, _, _) in enumerate(quiet):
            if k == 0 and a / fps > core and a > known:
                out.append((0, known, a))
            if k + 1 < len(quiet):
                following = quiet[k + 1][0]
                if following > b and (b - a) / fps >= o["rest"] and following - b >= least:
                    out.append((k + 1, b, following))
            elif self.duration - b / fps > core and self.n > b:
                out.append((k + 1, b, self.n))
        return out

    def intervals(self, o: dict[str, float]) -> list[tuple[int, float, float]]:
        """(number, start, end) of those in the window."""
        rows, fps, idx = [], self.fps, self.idx
        for span, lo, hi in self.spans(o):
            if (lo, hi) not in self.clumps:
                self.clumps[lo, hi] = self.clump(lo, hi)
            if not (found := self.clumps[lo, hi]) or (found[1] - found[0]) / fps < o["core"]:
                continue
            start, end = max(0.0, found[0] / fps - o["pre"]), min(self.duration, (found[1] + 1) / fps + o["post"])
            if end - start < o["least"]:
                continue
            if o["most"] <= 0 or end - start <= o["most"]:
                rows.append((start, -end, span, end))
                continue
            a, b = (int(np.searchsorted(idx, int(t * fps))) for t in (start, end))
            if a < b:
                rows += [(s, -e, span, e) for s, e in quietest_cuts(self.x[a:b], int(idx[a]), start, end, fps, o["apart"], o["ratio"] * 0.7, o["core"])]
        rows.sort()
        kept: list[tuple[int, float, float]] = []
        for start, _, i, end in sorted((start, start - end, i, end) for i, (start, _, _, end) in enumerate(rows)):
            if not kept or start >= kept[-1][2] - 0.05:
                kept.append((i, start, end))
            elif end - start > kept[-1][2] - kept[-1][1]:
                kept[-1] = (i, start, end)
        return [k for k in kept if k[2] > self.window[0] and k[1] < self.window[1]]

    def matches(self, found: list[tuple[int, float, float]], least: float) -> list[tuple[float, float, float, float]]:
        """(start, end, s, e) of the intervals and labels that are one another's, greedily by IoU (kernels.matched)."""
        every = []
        for i, start, end in found:
            if (start, end) not in self.pairs:
                other, s, e = self.labels
                over = np.minimum(end, e) - np.maximum(start, s)
                iou = over / (np.maximum(end, e) - np.minimum(start, s))
                self.pairs[start, end] = [(float(iou[k]), int(other[k]), int(k)) for k in np.flatnonzero((over > 0) & (iou >= LOOSE))]
            every += [(iou, i, other, k, start, end) for iou, other, k in self.pairs[start, end] if iou >= least]
        left, right, out = set(), set(), []
        for _, i, other, k, start, end in sorted(every, reverse=True):
            if i not in left and other not in right:
                left.add(i), right.add(other)
                out.append((start, end, float(self.labels[1][k]), float(self.labels[2][k])))
        return out


def swept(search: Search, values: dict[str, list[float]] = SWEPT, **settings: float) -> DataFrame:
    """(media_id, param_id, settings, scores): of every combination of values each medium's first with the highest F1.

    A medium's samples and labels are in one task, which tries one combination after another and keeps the best. As
    rows, the intervals of all combinations would be many times the samples.
    """
    base, fps, covered = sg.SETTINGS | settings, search.fps, search.coverage is not None
    tried = [base | dict(zip(values, map(float, some))) for some in itertools.product(*values.values())]
    part = lambda df, kind, i, a, b: df.select("media_id", F.lit(kind).alias("kind"), i.cast("long").alias("id"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    none = F.lit(None)
    rows = part(search.media, 0, F.col("n"), F.col("duration"), none).union(part(search.media, 1, F.lit(0), F.col("lo"), F.col("hi")))
    rows = rows.union(part(search.labels, 2, F.col("rally_id"), F.col("start"), F.col("end"))).union(part(search.signal.where("idx is not null"), 3, F.col("idx"), F.col("value"), none))
    if covered:
        rows = rows.union(part(search.coverage.where("value >= 0.5"), 4, F.col("idx"), none, none))

    def run(c, lo, hi):
        at = lo + np.searchsorted(c["kind"][lo:hi], np.arange(6))
        if at[0] == at[1]:
            return
        i, a, b = c["id"], c["a"], c["b"]
        of = lambda k: slice(at[k], at[k + 1])
        labels = (i[of(2)], a[of(2)], b[of(2)])
        medium = _Medium(i[of(3)], a[of(3)], labels, int(i[lo]), float(a[lo]), (float(a[at[1]]), float(b[at[1]])), fps, i[of(4)] if covered else None)
        best, top = None, -1.0
        for k, o in enumerate(tried):
            found = medium.intervals(o)
            tp = len(medium.matches(found, IOU))
            if (f1 := tp / (len(found) + len(labels[0]))) > top:
                best, top = (k, found, tp), f1
        k, found, tp = best
        loose = medium.matches(found, LOOSE)
        within = [sum(abs(p[j] - p[j + 2]) <= BAND for p in loose) for j in (0, 1)]
        yield lo, k, *(tried[k][s] for s in SETTINGS), len(found), tp, len(labels[0]), *within

    made = {"param_id": "long"} | dict.fromkeys(SETTINGS, "double") | dict.fromkeys(("n", "tp", "labels", "starts", "ends"), "long")
    return scored(walked(rows, ("media_id",), ["kind", "id"], ["media_id"], run, **made)).select(*OWN, *SETTINGS, *SCORES)
