"""Order-dependent steps against plain loops over random cases."""

import random

import numpy as np
import pytest

from tidemark.operators import kernels

BOX = "media_id long, frame long, track long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double"


@pytest.mark.parametrize("seed", range(4))
def test_quiet_stretches(seed):
    rnd, fps = np.random.default_rng(seed), 12.0
    x = np.repeat(rnd.choice([0.1, 0.8, 0.2, 0.9], 20), 15) + rnd.normal(0, 0.02, 300)
    lo, hi = np.percentile(x, [20, 95])
    level = lo + 0.35 * (hi - lo)
    got = kernels.quiet_around(x, fps, 1.0, 2.0, 0.3)
    assert got and [p for _, _, p in got] == sorted(kernels.peaks(-x, 12, 0.3 * (hi - lo)))
    for a, b, p in got:
        i = j = p
        while i > 0 and x[i - 1] <= level:
            i -= 1
        while j + 1 < len(x) and x[j + 1] <= level:
            j += 1
        if j - i < 3:
            i, j = max(0, p - 1), min(len(x) - 1, p + 1)
        if j - i > 24:
            i, j = (i + j) // 2 - 12, (i + j) // 2 + 12
        assert (a, b) == (i, j)


def test_quiet_stretches_of_short_and_flat_signals():
    assert kernels.quiet_around(np.zeros(5), 12.0, 1.0, 0.0, 0.3) == [] == kernels.quiet_around(np.ones(60), 12.0, 1.0, 0.0, 0.3)


@pytest.mark.parametrize("seed", range(4))
def test_long_runs_are_split_at_their_gaps(seed):
    rnd = random.Random(seed)
    times = sorted(rnd.uniform(0, 100) for _ in range(60))

    def split(ts):
        if ts[-1] - ts[0] <= 20 or len(ts) < 4:
            return [ts]
        gaps = [b - a for a, b in zip(ts, ts[1:])]
        k = max(range(len(gaps)), key=lambda i: (gaps[i], i))
        return split(ts[: k + 1]) + split(ts[k + 1 :]) if gaps[k] >= 0.35 else [ts[: len(ts) // 2], ts[len(ts) // 2 :]]

    got = kernels.split_long(times, 20, 0.35)
    assert got == split(times) and [t for part in got for t in part] == times


def test_runs_are_cut_at_valleys(spark):
    rnd = np.random.default_rng(3)
    x = rnd.random(200)
    signal = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "media_id long, idx long, value double")
    runs = spark.createDataFrame([(1, 5, 90), (1, 100, 104), (1, 110, 190)], "media_id long, first long, last long")

    def cut(a, b):
        if b - a <= 1.35 * 20:
            return [(a, b)]
        inner, at = x[a + 4 : b - 4], (a + b) // 2
        k = min(range(len(inner)), key=lambda i: (inner[i], i))
        if len(inner) > 2 and k > 0:
            at = a + 4 + k
        return cut(a, at) + cut(at, b)

    got = kernels.split_at_valleys(signal, runs, 20, 4).collect()
    assert sorted((r["first"], r["last"]) for r in got) == sorted(p for a, b in ((5, 90), (100, 104), (110, 190)) for p in cut(a, b))


def _boxes(seed, frames=6, n=8):
    rnd, rows = random.Random(seed), []
    for m in range(2):
        for f in range(frames):
            for k in range(n):
                x, y, w, h = rnd.choice([0.1, 0.4, 0.7]) + rnd.uniform(0, 0.06), rnd.choice([0.2, 0.6]) + rnd.uniform(0, 0.06), rnd.uniform(0.08, 0.14), rnd.uniform(0.15, 0.25)
                rows.append((m, f, k, len(rows), x, y, x + w, y + h, round(rnd.random(), 2)))
    return rows


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    size = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return inter / (size(a) + size(b) - inter)


def _same(a, b):
    iou, low = _iou(a, b), min(a[3] - a[1], b[3] - b[1])
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    ratio = (a[2] - a[0]) * (a[3] - a[1]) / ((b[2] - b[0]) * (b[3] - b[1]))
    return iou > 0.75 or ((iou > 0.30 or abs(dy) <= 0.5 * low) and np.hypot(dx * 1.78, dy) <= 0.45 * low and 0.30 <= ratio <= 3.2)


@pytest.mark.parametrize("seed", range(2))
def test_duplicate_boxes_go(spark, seed):
    rows, want = _boxes(seed), set()
    for key in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[8], r[3])):
            if not any(_same(r[4:8], k[4:8]) for k in kept):
                kept.append(r)
        want |= {k[3] for k in kept}
    got = {r.box_id for r in kernels.without_duplicates(spark.createDataFrame(rows, BOX)).collect()}
    assert got == want and len(want) < len(rows)


@pytest.mark.parametrize("seed", range(2))
def test_tracks_follow_the_best_pairs(spark, seed):
    rows, want = [r for r in _boxes(seed, n=4)], {}
    for m in (0, 1):
        live, fresh = {}, 0
        for f in range(6):
            own = sorted((r for r in rows if r[:2] == (m, f)), key=lambda r: r[3])
            live = {k: v for k, v in live.items() if f - v[0] <= 2}
            pairs = sorted(((-_iou(r[4:8], v[1]), i, j) for i, r in enumerate(own) for j, v in enumerate(live.values())), key=lambda p: p[0])
            names, given = list(live), {}
            for cost, i, j in pairs:
                if -cost >= 0.2 and i not in given and names[j] not in given.values():
                    given[i] = names[j]
            for i, r in enumerate(own):
                if i not in given:
                    given[i] = max([*live, *given.values(), fresh - 1], default=-1) + 1
                    fresh = given[i] + 1
                live[given[i]] = (f, r[4:8])
                want[r[3]] = (m, given[i])
    got = {r.box_id: (r.media_id, r.found) for r in kernels.associated(spark.createDataFrame(rows, BOX), 0.2, 2).collect()}
    groups = lambda d: sorted(sorted(k for k, v in d.items() if v == g) for g in set(d.values()))
    assert groups(got) == groups(want)
