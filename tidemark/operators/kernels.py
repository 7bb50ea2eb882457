"""Steps that depend on their order, over one bounded group (a medium's events, a frame's boxes) at a time: grouped maps with numpy.

Each visits its rows in a total order, named in its docstring, so equal inputs give equal results. Where groups are
many and small, a task walks all of its groups in one pass (walked).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.events import named_clusters

HIT = "media_id long, hit_idx long, t double, strength double, confidence double"


def _begins(batch: pa.RecordBatch | pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """The rows whose keys are not those of the row before, the first among them."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        null, x = (np.asarray(c) for c in (batch.column(k).is_null(), batch.column(k).fill_null(0)))
        new[1:] |= (x[1:] != x[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def walked(rows: DataFrame, keys: tuple[str, ...], order: list[str | Column], keep: list[str], make: Callable[[dict[str, np.ndarray], int, int], Iterable[tuple]], **made: str) -> DataFrame:
    """The columns keep of rows and those made (name=type, double or long), group by group, many groups in one pass.

    Rows are dealt by the keys (longs, nulls are a group) and sorted by them and the order. make(columns, lo, hi) has
    a group in the rows lo to hi of numpy arrays and gives (row, made values ...) for each row of the result, keep being read from that row. A
    grouped map would call Python and build a frame for each group, which takes a thousand times as long as a small
    group's own work; here a task holds a batch, and of larger groups one.
    """
    types = {"double": pa.float64(), "long": pa.int64()}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"`{k}` {v}" for k, v in made.items()])

    def results(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        begins = _begins(table, keys).tolist()
        out = [r for lo, hi in zip(begins, [*begins[1:], table.num_rows], strict=True) for r in make(columns, lo, hi)]
        if out:
            at, *values = zip(*out, strict=True)
            kept = table.select(keep).take(pa.array(at, pa.int64()))
            for (name, kind), v in zip(made.items(), values, strict=True):
                kept = kept.append_column(name, pa.array(v, types[kind]))
            yield from kept.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(_begins(batch, keys)[-1])
            if last == 0 and held and len(_begins(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) == 1:
                held.append(batch)
                continue
            whole = [*held, batch.slice(0, last)] if last else held
            if whole:
                yield from results(whole)
            held = [batch.slice(last)]
        if held:
            yield from results(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _low_before(x: np.ndarray) -> np.ndarray:
    """The least value after the last one before it that is higher, up to it, for each."""
    out, stack = np.empty(len(x)), []
    for i, v in enumerate(x.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        out[i] = low
        stack.append((v, low))
    return out


def standing_out(x: np.ndarray, distance: int, prominence: float) -> list[tuple[int, float]]:
    """(index, prominence) of local maxima (a plateau's middle), the higher of two nearer than distance, that stand out by prominence."""
    n, tops, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i] > x[i - 1] and j < n - 1 and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    taken: list[int] = []
    for p in sorted(tops, key=lambda p: (-x[p], -p)):
        k = bisect_left(taken, p)
        if (k == 0 or p - taken[k - 1] >= distance) and (k == len(taken) or taken[k] - p >= distance):
            taken.insert(k, p)
    if not taken:
        return []
    rises = x - np.maximum(_low_before(x), _low_before(x[::-1])[::-1])
    return [(p, float(rises[p])) for p in taken if rises[p] >= prominence]


def peaks(x: np.ndarray, distance: int, prominence: float) -> list[int]:
    """The indexes of standing_out."""
    return [p for p, _ in standing_out(x, distance, prominence)]


def thinned(hits: DataFrame, least_gap: float) -> DataFrame:
    """Hits at least least_gap apart, chosen by strength * (0.5 + 0.5 confidence), of equal ones the lower hit_idx."""

    def run(c, lo, hi):
        score = c["strength"][lo:hi] * (0.5 + 0.5 * np.clip(c["confidence"][lo:hi], 0, 1))
        kept: list[float] = []
        for i in np.lexsort((c["hit_idx"][lo:hi], -score)).tolist() if hi - lo > 1 else [0]:
            t = c["t"][lo + i]
            at = bisect_left(kept, t)
            if (at == 0 or t - kept[at - 1] >= least_gap) and (at == len(kept) or kept[at] - t >= least_gap):
                kept.insert(at, t)
                yield (lo + i,)

    rows = hits.select("media_id", "hit_idx", "t", "strength", "confidence")
    islands = named_clusters(rows, float(np.nextafter(least_gap, 0)))  # hits of two islands are least_gap apart at least
    return walked(islands, ("media_id", "cluster"), ["t", "hit_idx"], rows.columns, run)


def found_peaks(signal: DataFrame, distance: int, prominence: float, valleys: bool = False) -> DataFrame:
    """(media_id, idx, value) of a signal's peaks, or valleys."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        x = g.value.to_numpy()
        return g.iloc[peaks(-x if valleys else x, distance, prominence)]

    return signal.select("media_id", "idx", "value").groupBy("media_id").applyInPandas(run, "media_id long, idx long, value double")


def quiet_depths(x: np.ndarray, fps: float, apart: float, longest: float, ratio: float) -> list[tuple[int, int, int, float]]:
    """(first, last, bottom, depth) of the quiet stretches around a signal's valleys, at least apart seconds apart and as prominent as ratio of (p95 - p20).

    A stretch is what stays at or below p20 + 0.35 (p95 - p20) around the bottom; one of less than a quarter second
    reaches 0.15 s to both sides of it, one longer than longest (0: no limit) is cut to that around its middle. Its
    depth is its prominence over (p95 - p20), up to 1.5.
    """
    if len(x) < max(8, int(fps)):
        return []
    base, top = np.percentile(x, [20, 95])
    span = max(top - base, 1e-9)
    loud, out = np.flatnonzero(x > base + 0.35 * span), []
    for p, rise in standing_out(-x, max(1, round(apart * fps)), ratio * span):
        k = np.searchsorted(loud, p)
        a = loud[k - 1] + 1 if k else 0
        k += np.searchsorted(loud[k:], p, "right")
        b = loud[k] - 1 if k < len(loud) else len(x) - 1
        a, b = min(a, p), max(b, p)
        if b - a < max(1, int(0.25 * fps)):
            a, b = max(0, p - int(0.15 * fps)), min(len(x) - 1, p + int(0.15 * fps))
        limit = round(longest * fps)
        if longest > 0 and b - a > limit:
            middle = (a + b) // 2
            a, b = middle - limit // 2, middle + limit // 2
        out.append((int(a), int(b), int(p), min(1.5, max(0.0, rise / span))))
    return out


def quiet_around(x: np.ndarray, fps: float, apart: float, longest: float, ratio: float) -> list[tuple[int, int, int]]:
    """(first, last, bottom) of quiet_depths."""
    return [q[:3] for q in quiet_depths(x, fps, apart, longest, ratio)]


def quietest_cuts(x: np.ndarray, at: int, start: float, end: float, fps: float, apart: float, ratio: float, core: float) -> list[tuple[float, float]]:
    """start to end in pieces, cut in the middle of the deepest quiet stretch (of equal ones the first), again and again, while that leaves a core on both sides. x begins at sample at."""
    todo, out = [(start, end)], []
    while todo:
        start, end = todo.pop()
        a, b, cut = int(start * fps), int(end * fps), -1
        if b - a >= int(2 * core * fps) and (found := quiet_depths(x[a - at : b - at], fps, apart, 0.0, ratio)):
            deepest = max(found, key=lambda q: q[3])
            cut = (deepest[0] + deepest[1]) // 2
        if cut < max(1, int(core * fps)) or b - a - cut < max(1, int(core * fps)):
            out.append((start, end))
        else:
            todo += [(start, (a + cut) / fps), ((a + cut) / fps, end)]
    return sorted(out)


def split_at_quiet(samples: DataFrame, fps: float) -> DataFrame:
    """(media_id, span, start, end): quietest_cuts of each span (media_id, span, start, end, apart, ratio, core) in its samples (idx, value)."""

    def run(c, lo, hi):
        for cut in quietest_cuts(c["value"][lo:hi], int(c["idx"][lo]), c["start"][lo], c["end"][lo], fps, c["apart"][lo], c["ratio"][lo], c["core"][lo]):
            yield lo, *cut

    rows = samples.select("media_id", "span", "start", "end", "apart", "ratio", "core", "idx", "value")
    return walked(rows, ("media_id", "span"), ["idx"], ["media_id", "span"], run, start="double", end="double")


def quiet_by(signal: DataFrame, marks: DataFrame, fps: float) -> DataFrame:
    """(media_id, apart, ratio, first, last, bottom): the quiet stretches of each medium for each of its marks (media_id, apart, ratio)."""

    def run(c, lo, hi):
        first = lo + int(np.isnan(c["idx"][lo:hi]).sum())
        for i in range(lo, first):
            for q in quiet_depths(c["value"][first:hi], fps, c["apart"][i], 0.0, c["ratio"][i]):
                yield i, *q[:3]

    none = lambda t: F.lit(None).cast(t)
    wanted = marks.select("media_id", "apart", "ratio").distinct().select("media_id", none("double").alias("idx"), none("double").alias("value"), "apart", "ratio")
    rows = wanted.union(signal.where("idx is not null").select("media_id", F.col("idx").cast("double"), "value", none("double"), none("double")))
    return walked(rows, ("media_id",), ["idx", "apart", "ratio"], ["media_id", "apart", "ratio"], run, first="long", last="long", bottom="long")


def quiet_spans(signal: DataFrame, fps: float, apart: float, longest: float, ratio: float) -> DataFrame:
    """(media_id, first, last, bottom): the quiet stretches of each medium's signal (quiet_around)."""

    def run(c, lo, hi):
        for q in quiet_around(c["value"][lo:hi], fps, apart, longest, ratio):
            yield lo, *q

    return walked(signal.select("media_id", "idx", "value"), ("media_id",), ["idx"], ["media_id"], run, first="long", last="long", bottom="long")


def split_long(times: list[float], longest: float, least_gap: float) -> list[list[float]]:
    """A run of times in pieces: at its largest gap (of equal ones the last) if that is least_gap or more, else once in the middle."""
    todo, out = [times], []
    while todo:
        ts = todo.pop()
        if ts[-1] - ts[0] <= longest or len(ts) < 4:
            out.append(ts)
            continue
        gaps = np.diff(ts)
        k = len(gaps) - 1 - int(np.argmax(gaps[::-1]))
        if gaps[k] < least_gap:
            out += [ts[: len(ts) // 2], ts[len(ts) // 2 :]]
        else:
            todo += [ts[: k + 1], ts[k + 1 :]]
    return sorted(out)


def long_clusters(hits: DataFrame, gap: float, longest: float, least_gap: float) -> DataFrame:
    """(media_id, start, end, n): clusters of hits, those longer than longest in pieces."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(g.t.to_numpy())
        runs = np.split(ts, np.flatnonzero(np.diff(ts) > gap) + 1)
        pieces = [p for r in runs for p in split_long(list(r), longest, least_gap)]
        return pd.DataFrame([(g.media_id.iat[0], p[0], p[-1], len(p)) for p in pieces], columns=["media_id", "start", "end", "n"])

    return hits.select("media_id", "t").groupBy("media_id").applyInPandas(run, "media_id long, start double, end double, n long")


def split_at_gaps(intervals: DataFrame, hits: DataFrame, limit: float, side_hits: int, side_span: float, motion_ok=None) -> DataFrame:
    """(media_id, rally_id, start, end): intervals cut in the middle of a hit gap above limit with enough hits and time on both sides.

    The first of the largest gaps is tried, six levels deep. motion_ok(cut), if given, must also hold.
    """

    def pieces(ts, start, end, depth):
        ts = ts[(ts >= start) & (ts <= end)]
        if depth <= 6 and end - start >= 2 * side_span and len(ts) >= 2 * side_hits:
            gaps = np.diff(ts)
            k = int(np.argmax(gaps))
            left, right = ts[: k + 1], ts[k + 1 :]
            cut = ts[k] + gaps[k] / 2
            sides = all(len(s) >= side_hits and s[-1] - s[0] >= side_span for s in (left, right))
            if gaps[k] > limit and sides and (motion_ok is None or motion_ok(cut)):
                return pieces(ts, start, cut, depth + 1) + pieces(ts, cut, end, depth + 1)
        return [(start, end)]

    def run(key, a: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        ts = np.sort(h.t.to_numpy())
        rows = [(key[0], r.rally_id, lo, hi) for r in a.itertuples() for lo, hi in pieces(ts, r.start, r.end, 0)]
        return pd.DataFrame(rows, columns=["media_id", "rally_id", "start", "end"])

    left = intervals.select("media_id", "rally_id", "start", "end").groupBy("media_id")
    return left.cogroup(hits.select("media_id", "t").groupBy("media_id")).applyInPandas(run, "media_id long, rally_id long, start double, end double")


def cut_overlaps(intervals: DataFrame, hits: DataFrame, least: float = 0.5) -> DataFrame:
    """(media_id, rally_id, start, end) without overlaps: by start, each is cut against the last kept one.

    The cut lies in the first of the largest hit gaps of what they share, 0.15 before its only hit, else in its middle.
    """

    def cut_of(ts, a, b):
        inside = ts[(ts >= a) & (ts < b)]
        if b - a >= 0.25 and len(inside) > 1:
            gaps = np.diff(inside)
            k = int(np.argmax(gaps))
            return inside[k] + gaps[k] / 2
        if b - a >= 0.25 and len(inside) == 1:
            return max(a, min(inside[0] - 0.15, b))
        return (a + b) / 2

    def run(c, lo, hi):
        n = lo + int((c["kind"][lo:hi] == 0).sum())
        ts, kept = c["t"][lo:n], []
        for i, start, end in zip(range(n, hi), c["start"][n:hi].tolist(), c["end"][n:hi].tolist(), strict=True):
            if kept and start < kept[-1][2] - 0.05:
                cut = cut_of(ts, start, min(kept[-1][2], end))
                kept[-1][2], start = min(kept[-1][2], cut), max(start, cut)
                if end - start < least:
                    continue
            kept.append([i, start, end])
        return [tuple(k) for k in kept if k[2] - k[1] >= least]

    spans = intervals.select("media_id", "rally_id", "start", "end", F.lit(None).cast("double").alias("t"), F.lit(1).alias("kind"))
    times = hits.where("t is not null").select("media_id", F.lit(None).cast("long").alias("rally_id"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), "t", F.lit(0).alias("kind"))
    rows = spans.union(times.select("media_id", "rally_id", "start", "end", "t", "kind"))
    order = ["kind", "t", F.col("start").asc_nulls_last(), "rally_id"]
    return walked(rows, ("media_id",), order, ["media_id", "rally_id"], run, start="double", end="double")


def longest_of_overlapping(intervals: DataFrame, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """Intervals of the same keys by (start, longest first): one that overlaps the last kept by over 0.05 replaces it if longer, else goes.

    Those that follow each other without such an overlap with any before don't meet, so each group of overlapping
    ones is chosen from by itself.
    """

    def run(c, lo, hi):
        start, end = c["start"][lo:hi].tolist(), c["end"][lo:hi].tolist()
        kept: list[int] = []
        for i in range(hi - lo):
            if not kept or start[i] >= end[kept[-1]] - 0.05:
                kept.append(i)
            elif end[i] - start[i] > end[kept[-1]] - start[kept[-1]]:
                kept[-1] = i
        return [(lo + i,) for i in kept]

    order = W.partitionBy(*keys).orderBy("start", "rally_id")
    apart = F.col("start") >= F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)) - 0.05
    slim = intervals.select(*keys, "rally_id", "start", "end")
    rows = slim.withColumn("new", F.when(apart, 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("new")
    return walked(rows, (*keys, "island"), [F.col("start").asc_nulls_last(), (F.col("start") - F.col("end")).asc_nulls_last(), "rally_id"], slim.columns, run)


def matched(pairs: DataFrame, keys: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """(keys, rally_id, other_id, iou): one-to-one, greedily by iou, of equal ones the larger ids first."""

    def run(c, lo, hi):
        a, b = set(), set()
        for i, x, y in zip(range(lo, hi), c["rally_id"][lo:hi].tolist(), c["other_id"][lo:hi].tolist(), strict=True):
            if x not in a and y not in b:
                a.add(x), b.add(y)
                yield (i,)

    rows = pairs.select(*keys, "rally_id", "other_id", "iou")
    return walked(rows, keys, [F.desc("iou"), F.desc("rally_id"), F.desc("other_id")], rows.columns, run)


def merged_events(events: DataFrame, within: float) -> DataFrame:
    """(media_id, t, phrase, prob): by (t, surest first), an event nearer than within to the last kept replaces it if surer, else goes."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["t", "prob", "phrase"], ascending=[True, False, True])
        kept: list[int] = []
        t, p = g.t.to_numpy(), g.prob.to_numpy()
        for i in range(len(g)):
            if not kept or t[i] - t[kept[-1]] >= within:
                kept.append(i)
            elif p[i] > p[kept[-1]]:
                kept[-1] = i
        return g.iloc[kept]

    return events.select("media_id", "t", "phrase", "prob").groupBy("media_id").applyInPandas(run, "media_id long, t double, phrase string, prob double")


def split_at_valleys(signal: DataFrame, runs: DataFrame, target: int, least: int) -> DataFrame:
    """(media_id, first, last): runs of samples longer than 1.35 target, cut at their least inner value again and again."""

    def pieces(x, a, b):
        todo, out = [(a, b)], []
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= 1.35 * target:
                out.append((lo, hi))
                continue
            inner, cut = x[lo + least : hi - least], (lo + hi) // 2
            if len(inner) > 2 and 0 < (k := int(np.argmin(inner))) < len(inner):
                cut = lo + least + k
            todo += [(lo, cut), (cut, hi)]
        return sorted(out)

    def run(key, s: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        x = s.sort_values("idx").value.to_numpy()
        rows = [(key[0], a, b) for one in r.itertuples() for a, b in pieces(x, one.first, one.last)]
        return pd.DataFrame(rows, columns=["media_id", "first", "last"])

    left = signal.select("media_id", "idx", "value").groupBy("media_id")
    return left.cogroup(runs.select("media_id", "first", "last").groupBy("media_id")).applyInPandas(run, "media_id long, first long, last long")


def _iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a (n, 4) against b (m, 4)."""
    lo, hi = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.clip(hi - lo, 0, None), axis=2)
    size = lambda x: np.prod(np.clip(x[:, 2:] - x[:, :2], 0, None), axis=1)
    return inter / np.maximum(size(a)[:, None] + size(b)[None] - inter, 1e-12)


_CORNERS = ["x1", "y1", "x2", "y2"]


def without_duplicates(boxes: DataFrame, aspect: float = 1.78) -> DataFrame:
    """A frame's boxes, surest first (of equal ones the lower id), without those that show what a kept one shows.

    Two show the same above an IoU of 0.75, or if their centres are within 0.45 of the lower height, level enough,
    and their areas differ by at most about three times.
    """

    def same(b, kept):
        iou = _iou(b[None], kept)[0]
        mid, mids = (b[:2] + b[2:]) / 2, (kept[:, :2] + kept[:, 2:]) / 2
        low = np.maximum(1e-6, np.minimum(b[3] - b[1], kept[:, 3] - kept[:, 1]))
        level = (iou > 0.30) | (np.abs(mid[1] - mids[:, 1]) <= 0.5 * low)
        close = np.hypot((mid[0] - mids[:, 0]) * aspect, mid[1] - mids[:, 1]) <= 0.45 * low
        areas = np.prod(kept[:, 2:] - kept[:, :2], axis=1)
        ratio = np.prod(b[2:] - b[:2]) / np.maximum(areas, 1e-9)
        return ((iou > 0.75) | (level & close & (ratio >= 0.30) & (ratio <= 3.2))).any()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["conf", "box_id"], ascending=[False, True])
        xy, kept = g[_CORNERS].to_numpy(), []
        for i in range(len(g)):
            if not kept or not same(xy[i], xy[kept]):
                kept.append(i)
        return g.iloc[kept]

    columns = ["media_id", "frame", "track", "box_id", *_CORNERS, "conf"]
    return boxes.select(*columns).groupBy("media_id", "frame").applyInPandas(run, "media_id long, frame long, track long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double")


def associated(boxes: DataFrame, least_iou: float, patience: int = 30) -> DataFrame:
    """(media_id, frame, box_id, found): boxes linked from frame to frame by IoU, best pairs first; a track unseen for patience frames ends."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        live: dict[int, tuple[int, np.ndarray]] = {}
        rows, fresh = [], 0
        for frame, f in g.sort_values(["frame", "box_id"]).groupby("frame"):
            live = {k: v for k, v in live.items() if frame - v[0] <= patience}
            xy, ids, names = f[_CORNERS].to_numpy(), f.box_id.to_numpy(), list(live)
            given: dict[int, int] = {}
            if names:
                iou = _iou(xy, np.stack([live[k][1] for k in names]))
                for at in np.argsort(-iou, axis=None, kind="stable"):
                    i, j = divmod(int(at), len(names))
                    if iou[i, j] < least_iou:
                        break
                    if i not in given and names[j] not in given.values():
                        given[i] = names[j]
            for i in range(len(f)):
                if i not in given:
                    given[i], fresh = fresh, fresh + 1
                live[given[i]] = (frame, xy[i])
                rows.append((f.media_id.iat[0], frame, ids[i], given[i]))
        return pd.DataFrame(rows, columns=["media_id", "frame", "box_id", "found"])

    return boxes.select("media_id", "frame", "box_id", *_CORNERS).groupBy("media_id").applyInPandas(run, "media_id long, frame long, box_id long, found long")
