"""Linking points, fitting their way and joining fragments of tracks, against plain loops and numpy's own fit."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import tracks as tr

POINT = "media_id long, frame long, point long, x double, y double, score double"
BOX = "media_id long, frame long, track long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double"


def linked_by_loops(points, fps, height, least, patience, top):
    frames = {}
    for p in sorted(points, key=lambda p: (p[1], p[2])):
        frames.setdefault(p[1], []).append(p)
    active, done = [], []
    for f in sorted(frames):
        used = set()
        active.sort(key=lambda t: t[-1][1])
        still = []
        for t in active:
            gap = f - t[-1][1]
            if gap > patience + 1:
                done.append(t)
                continue
            x, y = t[-1][3:5]
            if len(t) > 1:
                dt = max(1e-6, (t[-1][1] - t[-2][1]) / fps)
                x, y = x + (x - t[-2][3]) / dt * (gap / fps), y + (y - t[-2][4]) / dt * (gap / fps)
            radius, best = max(2.0, top * height * gap / fps), None
            for p in frames[f]:
                d = math.hypot(p[3] - x, p[4] - y)
                if p[2] not in used and d <= radius and (best is None or d / radius - 0.25 * p[5] < best[0]):
                    best = (d / radius - 0.25 * p[5], p)
            if best:
                used.add(best[1][2])
                t.append(best[1])
            still.append(t)
        active = still + [[p] for p in frames[f] if p[2] not in used]
    return {tuple(p[2] for p in t) for t in done + active if len(t) >= least}


@pytest.mark.parametrize("seed", range(4))
def test_linked_points(spark, seed):
    rnd, rows, at = random.Random(seed), [], 0
    for m in range(3):
        frame = 0
        for _ in range(120):
            frame += rnd.choice([0, 1, 1, 1, 2, 3, 9])
            at += 1
            rows.append((m, frame, at, float(rnd.randrange(0, 40)), float(rnd.randrange(0, 40)), rnd.choice([0.0, 0.5, 0.5, 1.0])))
    got = tr.linked(spark.createDataFrame(rows, POINT).repartition(4), 10.0, 60.0, 3, 2, 2.0).collect()
    tracks = {}
    for r in got:
        tracks.setdefault((r.media_id, r.track), []).append(r.point)
    order = {r[2]: r[1] for r in rows}
    found = {tuple(sorted(t, key=lambda p: order[p])) for t in tracks.values()}
    assert found == set().union(*(linked_by_loops([r for r in rows if r[0] == m], 10.0, 60.0, 3, 2, 2.0) for m in range(3)))
    assert all(min(t, key=lambda p: order[p]) == k[1] for k, t in tracks.items())


def test_nothing_to_link(spark):
    assert tr.linked(spark.createDataFrame([], POINT), 10.0, 60.0).collect() == []
    assert tr.linked(spark.createDataFrame([(1, None, 1, 0.0, 0.0, None), (1, 2, 2, None, 0.0, 1.0)], POINT), 10.0, 60.0, 1).collect() == []


def fit_by_numpy(p, fps, height, least, resid_at_most, speeds, span_least, accels):
    p = sorted(p, key=lambda r: (r[2], r[3]))
    n, deg = len(p), 2 if len(p) >= 5 else 1
    t = np.array([r[2] / fps for r in p])
    if n < least or len(set(t)) <= deg:
        return None
    x, y, s = (np.array([r[k] for r in p]) for k in (4, 5, 6))
    u = t - t[0]
    cx, cy = np.polyfit(u, x, deg), np.polyfit(u, y, deg)
    resid = np.sqrt(np.mean((x - np.polyval(cx, u)) ** 2 + (y - np.polyval(cy, u)) ** 2)) / height
    v = np.hypot(np.diff(x), np.diff(y)) / np.maximum(np.diff(t), 1e-6) / height
    span = math.hypot(x[-1] - x[0], y[-1] - y[0]) / height
    accel = math.hypot(2 * cx[0], 2 * cy[0]) / height if deg == 2 else 0.0
    if resid > resid_at_most or not speeds[0] <= v.mean() <= 1.5 * speeds[1] or span < span_least or accel < accels[0] or accel > accels[1]:
        return None
    bent = min(1.0, accel / (2 * accels[0])) if accels[0] > 0 else 1.0
    sure = 0.28 * s.mean() + 0.22 * min(1.0, n / (2 * least)) + 0.28 * max(0.0, 1 - resid / resid_at_most) + 0.12 * (v <= speeds[1]).mean() + 0.10 * bent
    return n, t[0], t[-1], resid, v.mean(), v.max(), span, accel, min(1.0, max(0.0, sure))


@pytest.mark.parametrize("accels", [(0.25, 12.0), (0.0, 12.0)])
def test_fits(spark, accels):
    rnd, rows = np.random.default_rng(2), []
    for k in range(60):
        n, fps, first = int(rnd.integers(1, 14)), 25.0, int(rnd.integers(0, 10**6))
        frames = first + np.sort(rnd.choice(40, n, replace=rnd.random() < 0.3))
        u = (frames - first) / fps
        bend = rnd.choice([0, 200, 900, 9000])
        x, y = 100 + rnd.uniform(-300, 300) * u, 300 - rnd.uniform(0, 300) * u + bend * u**2
        rows += [(k % 3, k, int(f), i, float(a), float(b), float(c)) for i, (f, a, b, c) in enumerate(zip(frames, x + rnd.normal(0, 2, n), y + rnd.normal(0, 2, n), rnd.random(n)))]
    args = (25.0, 480.0, 4, 0.035, (0.02, 2.0), 0.04, accels)
    frame = spark.createDataFrame([*rows, (9, 99, 1, 1, None, 1.0, 1.0)], "media_id long, track long, frame long, point long, x double, y double, score double")
    got = {r.track: tuple(r)[2:] for r in tr.fitted(frame, 25.0, 480.0, 4, 0.035, (0.02, 2.0), 0.04, accels).collect()}
    want = {k: w for k in range(60) if (w := fit_by_numpy([r for r in rows if r[1] == k], *args))}
    assert got.keys() == want.keys() and 5 < len(got) < 55
    for k in got:
        np.testing.assert_allclose(got[k], want[k], atol=1e-6)


def test_tracks_that_determine_no_curve(spark):
    rows = [(1, 1, 5, i, float(i), float(i), 1.0) for i in range(6)] + [(1, 2, 5 + i % 2, i, float(i), 0.0, 1.0) for i in range(6)]
    frame = spark.createDataFrame(rows, "media_id long, track long, frame long, point long, x double, y double, score double")
    assert tr.fitted(frame, 25.0, 10.0, max_resid=9.0, speeds_in=(0.0, 1e9), accel_in=(0.0, 1e9)).collect() == []


# fragments of tracks


def centre(b):
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def size(b):
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def whole(b):
    return not (b[0] <= 0.01 or b[1] <= 0.01 or b[2] >= 0.99 or b[3] >= 0.99)


class Person:
    def __init__(self, obs):
        self.obs, self.v, self.last = sorted(obs), (0.0, 0.0), None
        for t, b in self.obs:
            if self.last:
                dt = t - self.last[0]
                self.v = tuple(0.5 * v + 0.5 * max(-4.0, min(4.0, (c - o) / dt)) for v, c, o in zip(self.v, centre(b), self.last[1]))
            self.last = (t, centre(b))

    def fits(self, new, aspect):
        a, b = self.obs, new.obs
        box = lambda o: (min(x[1][0] for x in o), min(x[1][1] for x in o), max(x[1][2] for x in o), max(x[1][3] for x in o))
        p, q = box(a), box(b)
        if b[0][0] - a[-1][0] > 5.0 or q[0] - p[2] > 0.3 or p[0] - q[2] > 0.3 or q[1] - p[3] > 0.3 or p[1] - q[3] > 0.3:
            return False
        if a[-1][0] < b[0][0]:
            tail = [o for o in a if a[-1][0] - o[0] <= 0.75 and whole(o[1])]
            head = [o for o in b if o[0] - b[0][0] <= 0.75 and whole(o[1])]
            if not tail or not head:
                return False
            gap = max(0.0, head[0][0] - self.last[0])
            x, y = (c + v * gap for c, v in zip(self.last[1], self.v))
            u = centre(head[0][1])
            s = sorted((size(tail[-1][1]), size(head[0][1])))
            return math.hypot((x - u[0]) * aspect, y - u[1]) <= 0.10 and s[0] > 1e-9 and s[1] <= 3.5 * s[0]
        short, other = (a, b) if len(a) <= len(b) else (b, a)
        inside = [o for o in short if max(a[0][0], b[0][0]) <= o[0] <= min(a[-1][0], b[-1][0])]
        good = 0
        for t, k in inside:
            u, near = min(other, key=lambda o: (abs(o[0] - t), o[0]))
            c, d, s = centre(k), centre(near), sorted((size(k), size(near)))
            good += abs(u - t) <= 0.2 and math.hypot((c[0] - d[0]) * aspect, c[1] - d[1]) <= 0.10 and s[1] <= 3.5 * max(1e-9, s[0])
        return bool(inside) and good / len(inside) >= 0.5


def fragments(seed, frames=160, people=5):
    rnd, rows, box_id, track = random.Random(seed), [], 0, 0
    for m in range(3):
        for _ in range(people):
            x, y, w = rnd.uniform(0.05, 0.95), rnd.uniform(0.2, 0.8), rnd.uniform(0.01, 0.04)
            track += 1
            doubled = 0
            for f in range(frames):
                x, y = x + rnd.uniform(-0.01, 0.01), y + rnd.uniform(-0.006, 0.006)
                if rnd.random() < 0.03:
                    track += 1
                if rnd.random() < 0.02:
                    doubled = 12
                if rnd.random() < 0.25 or 60 < f < 80:
                    continue
                doubled -= 1
                for k in (0, 500) if doubled > 0 else (0,):
                    box_id += 1
                    e = rnd.uniform(-0.002, 0.002)
                    rows.append((m, f if f < 110 else f + 60, track + k, box_id, x - w + e, y - 2 * w, x + w + e, y + 2 * w, rnd.choice([0.5, 0.9])))
    return rows + rows[:4]


@pytest.mark.parametrize("seed", range(3))
def test_merged_fragments(spark, seed):
    rows, fps, want, pairs = fragments(seed), 8.0, {}, set()
    for m in range(3):
        best = {}
        for r in rows:
            if r[0] == m and (r[2], r[1]) not in best or r[0] == m and (-r[8], r[3]) < best[r[2], r[1]][0]:
                best[r[2], r[1]] = ((-r[8], r[3]), r[4:8])
        tracks = {}
        for (k, f), (_, b) in best.items():
            tracks.setdefault(k, []).append((f / fps, b))
        order = sorted(tracks, key=lambda k: (min(tracks[k])[0], -len(tracks[k]), k))
        people = []
        for k in order:
            new = Person(tracks[k])
            hit = next((p for p in people if p[1].fits(new, 1.78)), None)
            if hit:
                old, last = hit[1], hit[1].last
                v = new.v if new.last[0] >= last[0] else old.v
                end = new.last if new.last[0] >= last[0] else last
                hit[1].obs, hit[1].v, hit[1].last = sorted(old.obs + new.obs, key=lambda o: o[0]), v, end
            else:
                people.append((k, new))
            want[m, k] = hit[0] if hit else k
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                if Person(tracks[a]).fits(Person(tracks[b]), 1.78):
                    pairs.add((m, a, b))
    frame = spark.createDataFrame(rows, BOX).repartition(4)
    assert {(r.media_id, r.track): r.person for r in tr.merged(frame, fps).collect()} == want
    found = tr.junctions(frame, fps).collect()
    assert {tuple(r)[:3] for r in found} == pairs and len(found) == len(pairs) and {r.kind for r in found} == {"gap", "overlap"}


def test_no_fragments(spark):
    none = spark.createDataFrame([], BOX)
    assert tr.merged(none, 8.0).collect() == [] == tr.junctions(none, 8.0).collect()


def test_a_track_begins_at_rest(spark):
    from tidemark.operators.boxes import speeds

    rows = [(1, f, 1, f, 0.1 * f, 0.2, 0.1 * f + 0.1, 0.4, 0.5) for f in range(3)]
    got = [(r.vx, r.vy, r.speed) for r in speeds(spark.createDataFrame(rows, BOX), 1.0, 2.0).orderBy("frame").collect()]
    np.testing.assert_allclose(got, [(0, 0, 0), (0.05, 0, 0.2), (0.075, 0, 0.2)], atol=1e-12)
