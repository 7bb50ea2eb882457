"""Short gaps, two tiers of hits, free numbers and the label audit against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import labels as lb
from tidemark.operators import records as rc
from tidemark.operators import spans as sp

SPAN = "media_id long, rally_id long, start double, end double"


def some_spans(rnd, n=40):
    at, out = 0.0, []
    for i in range(n):
        at += rnd.choice([-0.6, 0.0, 0.3, 0.9, 2.5, 4.0, 6.0])
        end = at + rnd.choice([0.5, 2.0, 2.1, 9.0])
        out.append((i, round(max(0.0, at), 2), round(max(0.0, at) + end - at, 2)))
        at = end
    return sorted(out, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("seed", range(3))
def test_short_gaps(spark, seed):
    rnd, rows, hits, want = random.Random(seed), [], [], set()
    for m in range(4):
        own = some_spans(rnd)
        strong = sorted(round(rnd.uniform(0, own[-1][2]), 1) for _ in range(120)) if m else []
        rows += [(m, *r) for r in own]
        hits += [(m, t) for t in strong]
        out = []
        for i, a, b in own:
            if out:
                gap, end = a - out[-1][2], out[-1][2]
                if 0 < gap <= 4.0 and any(end - 1 <= t <= end + 0.3 for t in strong) and any(a - 0.3 <= t <= a + 1 for t in strong):
                    out[-1][2], out[-1][3] = b, out[-1][3] + 1
                    continue
            out.append([i, a, b, 1])
        want |= {(m, *o) for o in out}
    got = sp.over_short_gaps(spark.createDataFrame(rows, SPAN), spark.createDataFrame(hits, "media_id long, t double")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and any(r.n > 1 for r in got)


def test_strong_hits_or_all(spark):
    rows = [(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.1), (2, 4, 0.9), (2, 5, 0.2), (3, 6, None)]
    got = sp.strong_or_all(spark.createDataFrame(rows, "media_id long, hit_idx long, strength double"), 0.8)
    assert sorted(r.hit_idx for r in got.collect()) == [1, 2, 4, 5, 6]


def test_free_numbers(spark):
    rnd, taken = random.Random(1), {}
    for b in range(40):
        taken[b] = [rnd.choice([0, 1, 2, 3, 4, 9, -1, None]) for _ in range(rnd.randrange(1, 9))]
    taken[99] = [*range(60), 5, 7]
    frame = spark.createDataFrame([(b, t) for b, ts in taken.items() for t in ts], "base long, taken long")
    assert {r.base: r.suffix for r in rc.free_suffix(frame).collect()} == {b: next(i for i in range(99) if i not in ts) for b, ts in taken.items()}


def audit_by_loops(gt, valleys, hits, act, fps, window):
    out, n = Counter(), len(gt)
    d = np.array([e - s for _, s, e in gt])
    mid = np.median(d)
    mad = np.median(np.abs(d - mid))
    width = max(np.percentile(act, 95) - np.percentile(act, 20), 1e-9)

    def mean(a, b):
        lo, hi = max(0, round(a * fps)), min(len(act), round(b * fps))
        return act[lo:hi].mean() if hi > lo else None

    for i, (k, s, e) in enumerate(gt):
        before, after = gt[i - 1][2] if i else None, gt[i + 1][1] if i + 1 < n else None
        for side, gap in (("start", None if before is None else s - before), ("end", None if after is None else after - e)):
            if gap is not None and gap < -1e-9:
                out[k, "overlap", "warn", side, round(-gap, 2), None, None] += 1
            elif gap is not None and 0 <= gap < 0.5:
                out[k, "too_close", "info", side, round(gap, 2), None, None] += 1
        if n >= 5 and mad > 1e-9 and 0.6745 * abs(d[i] - mid) / mad > 3.5:
            out[k, "duration_outlier", "warn", None, round(0.6745 * abs(d[i] - mid) / mad, 2), None, None] += 1
        for side, t in (("start", s), ("end", e)):
            pre, post = mean(t - window, t), mean(t, t + window)
            if pre is not None and post is not None:
                rise = (post - pre if side == "start" else pre - post) / width
                if rise < -0.1:
                    out[k, "evidence_contradiction", "warn", side, round(rise, 2), None, None] += 1
            gap = [v for v in valleys if (v[0] <= t and (before is None or v[0] > before) if side == "start" else v[0] >= t and (after is None or v[0] < after))]
            dq = min((abs(v[0] - t) for v in gap), default=None)
            dh = min((abs(h - t) for h in hits), default=None)
            if dq is not None and dq > 2.0:
                near = [v for v in gap if abs(v[0] - t) <= 3.0]
                snap = min(near, key=lambda v: (-v[1], abs(v[0] - t)))[0] if near else None
                out[k, "boundary_off_quiet", "warn", side, round(dq, 2), snap, None if dh is None else round(dh, 2)] += 1
            elif dq is None and dh is not None and dh > 2.5:
                out[k, "boundary_no_hit", "info", side, round(dh, 2), None, None] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_label_audit(spark, seed):
    rnd, rows, valleys, hits, act, want = random.Random(seed), [], [], [], [], Counter()
    for m in range(3):
        own = some_spans(rnd, 30)
        end = own[-1][2]
        v = sorted({round(rnd.uniform(0, end), 1): rnd.choice([0.2, 0.5, 0.9]) for _ in range(25)}.items()) if m else []
        h = [round(rnd.uniform(0, end / 3), 1) for _ in range(20)]
        x = np.repeat([rnd.choice([0.1, 0.5, 0.9]) for _ in range(int(end / 2) + 1)], 8)
        rows += [(m, *r) for r in own] + [(m, 999, 5.0, 5.0)]
        valleys += [(m, *r) for r in v]
        hits += [(m, t) for t in h]
        act += [(m, i, float(y)) for i, y in enumerate(x)]
        want += Counter({(m, *k): c for k, c in audit_by_loops(own, v, h, x, 4.0, 1.0).items()})
    labels = spark.createDataFrame(rows, SPAN)
    notes = lb.audit(labels, spark.createDataFrame(valleys, "media_id long, u double, depth double"), spark.createDataFrame(hits, "media_id long, u double"), spark.createDataFrame(act, "media_id long, idx long, value double"), 4.0)
    short = lambda v: None if v is None else round(v, 2)
    got = Counter((r.media_id, r.rally_id, r.code, r.severity, r.side, short(r.distance), r.snap, short(r.nearest_hit)) for r in notes.collect())
    assert {k[2] for k in got} == {"overlap", "too_close", "duration_outlier", "evidence_contradiction", "boundary_off_quiet", "boundary_no_hit"}
    key = lambda c: sorted(((*k[:5], k[6]) for k in c.elements()), key=str)
    assert key(got) == key(want)
    for a, b in zip(sorted(got.elements(), key=str), sorted(want.elements(), key=str), strict=True):
        assert a[5] == pytest.approx(b[5], abs=0.011)
    worst = {r.severity: r.n for r in lb.severities(labels, notes).collect()}
    marks = {}
    for k in want:
        marks.setdefault(k[:2], set()).add(k[3])
    assert worst.get("warn", 0) == sum("warn" in s for s in marks.values()) and sum(worst.values()) == 90


def test_an_audit_of_nothing(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    args = (empty("media_id long, u double, depth double"), empty("media_id long, u double"), empty("media_id long, idx long, value double"), 4.0)
    assert lb.audit(empty(SPAN), *args).collect() == []
    lone = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 2, 4.0, 9.0)], SPAN)
    assert sorted((r.rally_id, r.code, r.side) for r in lb.audit(lone, *args).collect()) == [(1, "overlap", "end"), (2, "overlap", "start")]
