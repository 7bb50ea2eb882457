"""Points and boxes of moving things: linking them from frame to frame, fitting their way, joining its fragments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.boxes import speeds, touches_edge
from tidemark.operators.kernels import walked
from tidemark.operators.series import clipped

TRACK = ("media_id", "track")


def stretches(frames: DataFrame, most: float, at: str = "frame") -> DataFrame:
    """frames with `stretch`, a medium's number of the stretch without a step of more than most between neighbours."""
    order = W.partitionBy("media_id").orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(order) > most, 1).otherwise(0)
    return frames.withColumn("new", new).withColumn("stretch", F.sum("new").over(order.rangeBetween(W.unboundedPreceding, 0))).drop("new")


def _linked(frame: np.ndarray, xy: np.ndarray, score: np.ndarray, fps: float, height: float, least: int, patience: int, top_speed: float) -> list[list[int]]:
    """The rows of each track, in time's order, of one stretch of points, by frame and point."""
    if len(frame) < least:
        return []
    live, ended = [], []
    cuts = np.flatnonzero(np.diff(frame)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(frame)], strict=True):
        now, free = int(frame[lo]), np.ones(hi - lo, bool)
        live.sort(key=lambda rows: frame[rows[-1]])
        ended += [rows for rows in live if now - frame[rows[-1]] > patience + 1]
        live = [rows for rows in live if now - frame[rows[-1]] <= patience + 1]
        for rows in live:
            gap, guess = (now - frame[rows[-1]]) / fps, xy[rows[-1]]
            if len(rows) > 1:
                guess = guess + (guess - xy[rows[-2]]) / max(1e-6, (frame[rows[-1]] - frame[rows[-2]]) / fps) * gap
            reach = max(2.0, top_speed * height * gap)
            off = np.hypot(*(xy[lo:hi] - guess).T)
            cost = np.where(free & (off <= reach), off / reach - 0.25 * score[lo:hi], np.inf)
            k = int(np.argmin(cost))
            if cost[k] < np.inf:
                free[k] = False
                rows.append(lo + k)
        live += [[lo + int(k)] for k in np.flatnonzero(free)]
    return [rows for rows in ended + live if len(rows) >= least]


def linked(points: DataFrame, fps: float, height: float, least: int = 5, patience: int = 2, top_speed: float = 0.6) -> DataFrame:
    """(media_id, track, point) of points (media_id, frame, point, x, y, score): tracks of at least so many points.

    A track goes on at the point nearest to where its last two points lead (surer points count as nearer), within
    what top_speed heights a second, and two units at least, allow; the track that has waited longest chooses first, of equal
    costs the lower point. Points that none takes begin tracks; one that finds nothing in more than patience frames
    ends. So stretches that are further apart than that don't meet, and each is linked by itself. track is the
    track's first point. Points without a place are left out; repeated points are points of their own.
    """
    rows = points.select("media_id", "frame", "point", "x", "y", F.coalesce("score", F.lit(0.0)).alias("score")).where("frame is not null and x is not null and y is not null")

    def run(c, lo, hi):
        for t in _linked(c["frame"][lo:hi], np.stack([c["x"][lo:hi], c["y"][lo:hi]], axis=1), c["score"][lo:hi], fps, height, least, patience, top_speed):
            for i in t:
                yield lo + i, int(c["point"][lo + t[0]])

    found = walked(stretches(rows, patience + 1), ("media_id", "stretch"), ["frame", "point"], ["media_id", "point"], run, track="long")
    return found.select("media_id", "track", "point")


def fitted(points: DataFrame, fps: float, height: float, least: int = 5, max_resid: float = 0.035, speeds_in: tuple[float, float] = (0.02, 0.6), min_span: float = 0.04, accel_in: tuple[float, float] = (0.25, 12.0)) -> DataFrame:
    """(media_id, track, n, start, end, resid, mean_speed, max_speed, span, accel, confidence) of the tracks that fly like a shuttle.

    points: (media_id, track, frame, point, x, y, score). A parabola in time (a line for under five points) is fitted
    to x and to y by least squares. In heights of the picture, its root mean square error, the mean speed (up to 1.5
    times the upper bound), the way from first to last and the acceleration must keep their bounds. Tracks of fewer
    than `least` points, and those whose times don't determine the curve (fewer different ones than it has
    coefficients), go. Times count from the track's mean, so that the normal equations are three sums each.
    """
    of, order = W.partitionBy(*TRACK), W.partitionBy(*TRACK).orderBy("frame", "point")
    rows = points.where("frame is not null and x is not null and y is not null").withColumn("t", F.col("frame") / fps)
    rows = rows.withColumns({"n": F.count("*").over(of), "u": F.col("t") - F.avg("t").over(of), "times": F.size(F.collect_set("frame").over(of))})
    curved = F.col("n") >= 5
    rows = rows.where((F.col("n") >= least) & (F.col("times") >= F.when(curved, 3).otherwise(2)))
    total = lambda c: F.sum(c).over(of)
    u, n = F.col("u"), F.col("n")
    rows = rows.withColumns({"s2": total(u**2), "s3": total(u**3), "s4": total(u**4)})
    for c in ("x", "y"):
        rows = rows.withColumns({f"m{c}": F.avg(c).over(of), f"{c}1": total(F.col(c) * u), f"{c}2": total(F.col(c) * u**2)})
    bend = lambda c: F.when(curved, (F.col(f"{c}2") - F.col(f"m{c}") * F.col("s2") - F.col("s3") / F.col("s2") * F.col(f"{c}1")) / (F.col("s4") - F.col("s2") ** 2 / n - F.col("s3") ** 2 / F.col("s2"))).otherwise(0.0)
    rows = rows.withColumns({"cx": bend("x"), "cy": bend("y")})
    off = lambda c: F.col(c) - (F.col(f"m{c}") - F.col(f"c{c}") * F.col("s2") / n + (F.col(f"{c}1") - F.col(f"c{c}") * F.col("s3")) / F.col("s2") * u + F.col(f"c{c}") * u**2)
    tall = max(1.0, height)
    step = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order)) / F.greatest(F.col("t") - F.lag("t").over(order), F.lit(1e-6)) / tall
    rows = rows.withColumns({"off": off("x") ** 2 + off("y") ** 2, "speed": step})
    at = lambda f: f(F.struct("frame", "point", "x", "y"))
    out = rows.groupBy(*TRACK).agg(
        F.count("*").alias("n"), F.min("t").alias("start"), F.max("t").alias("end"), (F.sqrt(F.avg("off")) / tall).alias("resid"), F.coalesce(F.avg("speed"), F.lit(0.0)).alias("mean_speed"), F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_speed"),
        at(F.min).alias("a"), at(F.max).alias("b"), (F.hypot(2 * F.first("cx"), 2 * F.first("cy")) / tall).alias("accel"), F.avg(F.coalesce("score", F.lit(0.0))).alias("sure"), F.avg((F.col("speed") <= speeds_in[1]).cast("double")).alias("slow_enough"),
    )
    out = out.withColumn("span", F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")) / tall)
    out = out.where((F.col("resid") <= max_resid) & F.col("mean_speed").between(speeds_in[0], 1.5 * speeds_in[1]) & (F.col("span") >= min_span))
    out = out.where((F.col("accel") <= accel_in[1]) & (F.lit(accel_in[0] <= 0) | (F.col("accel") >= accel_in[0])))
    bent = clipped(F.col("accel") / (2 * accel_in[0]), 0.0, 1.0) if accel_in[0] > 0 else F.lit(1.0)
    parts = 0.28 * F.col("sure") + 0.22 * F.least(F.lit(1.0), F.col("n") / (2.0 * least)) + 0.28 * F.greatest(F.lit(0.0), 1 - F.col("resid") / max(1e-6, max_resid)) + 0.12 * F.coalesce("slow_enough", F.lit(0.0)) + 0.10 * bent
    return out.select(*TRACK, "n", "start", "end", "resid", "mean_speed", "max_speed", "span", "accel", clipped(parts, 0.0, 1.0).alias("confidence"))


#: Between fragments of one person: seconds apart, heights off, times larger, share of common frames alike, bounding boxes apart, seconds to look for a whole box, seconds between boxes that are compared.
GAP, OFF, LARGER, ALIKE, APART, TRIM, NEAR = 5.0, 0.10, 3.5, 0.5, 0.30, 0.75, 0.2


def _surest(boxes: DataFrame, fps: float) -> DataFrame:
    """(media_id, track, frame, t, x, y, area, whole, x1 ... y2) of each track's surest box in a frame."""
    rows = boxes.where("frame is not null and track is not null").withColumn("rn", F.row_number().over(W.partitionBy("media_id", "track", "frame").orderBy(F.desc("conf"), "box_id"))).where("rn = 1")
    area = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    return rows.select("media_id", "track", "frame", (F.col("frame") / fps).alias("t"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), area.alias("area"), (~touches_edge()).alias("whole"), "x1", "y1", "x2", "y2")


def _alike(dx: Column, dy: Column, a: Column, b: Column, aspect: float) -> Column:
    return (F.hypot(dx * aspect, dy) <= OFF) & (F.greatest(a, b) <= LARGER * F.least(a, b))


def junctions(boxes: DataFrame, fps: float, aspect: float = 1.78) -> DataFrame:
    """(media_id, track, other, kind): pairs of tracks, the earlier first (by start, more boxes, id), that look like one person's.

    gap: the later begins at most five seconds after the earlier has ended, where its eased velocity leads to; the
    whole boxes nearest to the seam, within 0.75 s, are of like size. overlap: at half of the boxes of the shorter
    one in the common time, the other's box nearest in time, within 0.2 s, is alike. Bounding boxes are near in both.
    """
    rows = _surest(boxes, fps)
    ends = rows.groupBy(*TRACK).agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.max(F.struct("t", "x", "y")).alias("last"), *(f(c).alias(f"b{c}") for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))))
    v = speeds(boxes, fps, aspect).groupBy(*TRACK).agg(F.max(F.struct("frame", "vx", "vy")).alias("v"))
    seam = rows.join(ends.select(*TRACK, "t0", "t1"), list(TRACK))
    first = F.min(F.when(F.col("whole") & (F.col("t") - F.col("t0") <= TRIM), F.struct("t", "x", "y", "area"))).alias("head")
    end = F.max(F.when(F.col("whole") & (F.col("t1") - F.col("t") <= TRIM), F.struct("t", "x", "y", "area"))).alias("tail")
    ends = ends.join(v, list(TRACK)).join(seam.groupBy(*TRACK).agg(first, end), list(TRACK))
    a, b = ends.alias("a"), ends.alias("b")
    near = " and ".join(f"b.b{c}1 - a.b{c}2 <= {APART} and a.b{c}1 - b.b{c}2 <= {APART}" for c in "xy")

    a = a.withColumn("bin", F.explode(F.array(F.floor(F.col("t1") / GAP), F.floor(F.col("t1") / GAP) + 1))).alias("a")
    gap = a.join(b.withColumn("bin", F.floor(F.col("t0") / GAP)).alias("b"), ["media_id", "bin"]).where(f"b.t0 > a.t1 and b.t0 - a.t1 <= {GAP} and {near} and a.tail is not null and b.head is not null")
    lead = lambda c: F.col(f"a.last.{c}") + F.col(f"a.v.v{c}") * F.greatest(F.lit(0.0), F.col("b.head.t") - F.col("a.last.t")) - F.col(f"b.head.{c}")
    low = F.least("a.tail.area", "b.head.area")
    gap = gap.where(_alike(lead("x"), lead("y"), F.col("a.tail.area"), F.col("b.head.area"), aspect) & (low > 1e-9)).select("media_id", F.col("a.track").alias("track"), F.col("b.track").alias("other"), F.lit("gap").alias("kind"))

    sides = lambda s: ends.select("media_id", *(F.col(c).alias(f"{s}{c}") for c in ("track", "n", "t0", "t1", "bx1", "by1", "bx2", "by2")))
    seen = rows.withColumn("bin", F.floor(F.col("t") / NEAR)).select("media_id", "bin", "track", "t", "x", "y", "area")
    other = seen.select("media_id", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), *(F.col(c).alias(f"o_{c}") for c in ("track", "t", "x", "y", "area")))
    pairs = seen.join(other, ["media_id", "bin"]).where(f"track <> o_track and abs(t - o_t) <= {NEAR}")
    best = pairs.groupBy("media_id", "track", "o_track", "t").agg(F.min(F.struct(F.abs(F.col("t") - F.col("o_t")).alias("dt"), F.col("o_t").alias("u"), _alike(F.col("x") - F.col("o_x"), F.col("y") - F.col("o_y"), F.col("area"), F.col("o_area"), aspect).alias("same"))).alias("m"))
    common = F.expr("t >= greatest(p_t0, q_t0) and t <= least(p_t1, q_t1)")
    earlier = F.struct("p_t0", -F.col("p_n"), F.col("track")) < F.struct("q_t0", -F.col("q_n"), F.col("o_track"))
    shorter = (F.col("p_n") < F.col("q_n")) | ((F.col("p_n") == F.col("q_n")) & earlier)
    bounded = F.expr(" and ".join(f"q_b{c}1 - p_b{c}2 <= {APART} and p_b{c}1 - q_b{c}2 <= {APART}" for c in "xy"))
    met = best.join(sides("p_").withColumnRenamed("p_track", "track"), ["media_id", "track"]).join(sides("q_").withColumnRenamed("q_track", "o_track"), ["media_id", "o_track"]).where(shorter & bounded & common)
    met = met.withColumn("earlier", earlier).groupBy("media_id", "track", "o_track", "earlier", "p_t0", "p_t1", "q_t0", "q_t1").agg(F.sum(F.col("m.same").cast("int")).alias("same")).where("same > 0")
    inside = rows.select("media_id", "track", "t").join(met, ["media_id", "track"]).where(common)
    share = inside.groupBy("media_id", "track", "o_track", "earlier", "same").agg(F.count("*").alias("total")).where(F.col("same") >= ALIKE * F.col("total"))
    pick = lambda x, y: F.when(F.col("earlier"), F.col(x)).otherwise(F.col(y))
    return gap.union(share.select("media_id", pick("track", "o_track").alias("track"), pick("o_track", "track").alias("other"), F.lit("overlap")))


class _Fragments:
    """The boxes of the fragments taken together so far: times, boxes, their number, the last centre and its velocity, the bounding box."""

    def __init__(self, t: np.ndarray, box: np.ndarray):
        self.t, self.box, self.n, self.around = t, box, len(t), np.r_[box[:, :2].min(0), box[:, 2:].max(0)]
        centre, v = (box[:, :2] + box[:, 2:]) / 2, np.zeros(2)
        for step, dt in zip(np.diff(centre, axis=0), np.diff(t), strict=True):
            v = 0.5 * v + 0.5 * np.clip(step / dt, -4.0, 4.0)
        self.last, self.v, self.found = (t[-1], centre[-1]), v, {}

    def take(self, other: "_Fragments") -> None:
        if other.t[-1] >= self.t[-1]:
            self.last, self.v = other.last, other.v
        self.n += other.n
        self.found = {}
        order = np.argsort(np.r_[self.t, other.t], kind="stable")
        self.t, self.box = np.r_[self.t, other.t][order], np.r_[self.box, other.box][order]
        self.around = np.r_[np.minimum(self.around[:2], other.around[:2]), np.maximum(self.around[2:], other.around[2:])]

    def forget(self, t: float) -> None:
        """Leave out the boxes that no fragment from t on is compared with: all within TRIM of the last and from NEAR before t on stay, and their number stays what it was."""
        k = int(np.searchsorted(self.t, min(t - NEAR, self.t[-1] - TRIM) - 1e-6))
        self.t, self.box = self.t[k:], self.box[k:]

    def whole(self, back: bool) -> tuple[float, np.ndarray] | None:
        """The time and place of the whole box nearest to an end, within TRIM of it; looked for once."""
        if back not in self.found:
            away = self.t[-1] - self.t if back else self.t - self.t[0]
            at = np.flatnonzero((away <= TRIM) & (self.box[:, :2] > 0.01).all(1) & (self.box[:, 2:] < 0.99).all(1))
            self.found[back] = (self.t[k := at[-1 if back else 0]], self.box[k]) if len(at) else None
        return self.found[back]

    def goes_on_as(self, new: "_Fragments", aspect: float) -> bool:
        if new.t[0] - self.t[-1] > GAP or (new.around[:2] - self.around[2:] > APART).any() or (self.around[:2] - new.around[2:] > APART).any():
            return False
        size = lambda b: np.prod(np.maximum(0, b[..., 2:] - b[..., :2]), axis=-1)
        off = lambda a, b: np.hypot((a[..., 0] - b[..., 0]) * aspect, a[..., 1] - b[..., 1])
        mid = lambda b: (b[..., :2] + b[..., 2:]) / 2
        if self.t[-1] < new.t[0]:
            i, j = self.whole(True), new.whole(False)
            if i is None or j is None:
                return False
            a, b = size(i[1]), size(j[1])
            led = self.last[1] + self.v * max(0.0, j[0] - self.last[0])
            return bool(off(led, mid(j[1])) <= OFF and min(a, b) > 1e-9 and max(a, b) <= LARGER * min(a, b))
        short, long = (self, new) if self.n <= new.n else (new, self)
        lo, hi = max(self.t[0], new.t[0]), min(self.t[-1], new.t[-1])
        at = np.flatnonzero((short.t >= lo) & (short.t <= hi))
        if not len(at):
            return False
        k = np.searchsorted(long.t, short.t[at])
        around = np.clip(np.stack([k - 1, k]), 0, len(long.t) - 1)
        away = np.abs(long.t[around] - short.t[at])
        near = around[np.argmin(away, axis=0), np.arange(len(at))]
        a, b = short.box[at], long.box[near]
        alike = (away.min(0) <= NEAR) & (off(mid(a), mid(b)) <= OFF) & (np.maximum(size(a), size(b)) <= LARGER * np.maximum(1e-9, np.minimum(size(a), size(b))))
        return bool(alike.mean() >= ALIKE)


class _People:
    """The people so far, by when they end and when they have boxes, so that a fragment is compared only with those that it may go on from or show again."""

    def __init__(self):
        self.all: list[tuple[int, _Fragments]] = []
        self.ending: dict[int, set[int]] = {}
        self.seen: dict[int, set[int]] = {}

    def near(self, new: _Fragments) -> list[int]:
        """In their order, those whose last box is at most GAP before the fragment's first, and those with a box within NEAR of one of its; one without either doesn't fit."""
        at = int(new.t[0] // GAP)
        found = set().union(*(self.ending.get(k, ()) for k in range(at - 2, at + 1)))
        for k in {int(b) + d for b in np.unique(new.t // NEAR) for d in (-2, -1, 0, 1, 2)}:
            found |= self.seen.get(k, set())
        return sorted(found)

    def hold(self, i: int, t: np.ndarray, ended: float | None = None) -> None:
        """Person i has boxes at times t, too, and ended before."""
        if ended is not None:
            self.ending[int(ended // GAP)].discard(i)
        self.ending.setdefault(int(self.all[i][1].t[-1] // GAP), set()).add(i)
        for k in np.unique(t // NEAR).tolist():
            self.seen.setdefault(int(k), set()).add(i)

    def person(self, track: int, new: _Fragments, aspect: float) -> int:
        """The first person that the fragment fits, which takes it, or the fragment's own track as a new one."""
        for i in self.near(new):
            person, old = self.all[i]
            if old.goes_on_as(new, aspect):
                ended = old.t[-1]
                old.take(new)
                old.forget(new.t[0])
                self.hold(i, new.t, ended)
                return person
        self.all.append((track, new))
        self.hold(len(self.all) - 1, new.t.copy())
        return track


def merged(boxes: DataFrame, fps: float, aspect: float = 1.78) -> DataFrame:
    """(media_id, track, person): each track's person, the first of the tracks (by start, more boxes, id) that are its fragments.

    Tracks come in that order; each joins the first person so far whose boxes it goes on from or shows again
    (junctions, with a person's boxes taken together), or is a new one. Stretches of boxes that are further apart
    than fragments may be don't meet, and each is merged by itself.
    """
    rows = stretches(_surest(boxes, fps), GAP, "t")
    spans = rows.groupBy("media_id", "track").agg(F.min("stretch").alias("stretch"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["track", "t"])
        track, t, box, people = g.track.to_numpy(), g.t.to_numpy(), g[["x1", "y1", "x2", "y2"]].to_numpy(), _People()
        begins = np.flatnonzero(np.r_[True, track[1:] != track[:-1]])
        tracks = sorted((t[lo], lo - hi, track[lo], lo, hi) for lo, hi in zip(begins, np.r_[begins[1:], len(g)], strict=True))
        found = [(g.media_id.iat[0], k, people.person(k, _Fragments(t[lo:hi], box[lo:hi]), aspect)) for _, _, k, lo, hi in tracks]
        return pd.DataFrame(found, columns=["media_id", "track", "person"])

    rows = rows.drop("stretch").join(chained(spans, rows.select("media_id", "track", "stretch").distinct()), ["media_id", "track"])
    return rows.groupBy("media_id", "part").applyInPandas(run, "media_id long, track long, person long")


def chained(first: DataFrame, held: DataFrame) -> DataFrame:
    """(media_id, track, part): tracks (first: media_id, track, stretch) in parts, so that those that reach into common stretches (held) are in one."""
    last = held.groupBy("media_id", "track").agg(F.max("stretch").alias("to"))
    spans = first.join(last, ["media_id", "track"])
    order = W.partitionBy("media_id").orderBy("stretch", "track")
    new = F.when(F.col("stretch") > F.max("to").over(order.rowsBetween(W.unboundedPreceding, -1)), 1).otherwise(0)
    return spans.withColumn("new", new).withColumn("part", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).select("media_id", "track", "part")
