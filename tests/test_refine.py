"""Moving boundaries to valleys against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import refine as rf

FPS = 12.0
SPAN, EVIDENCE = "media_id long, rally_id long, start double, end double", "media_id long, side string, idx long, score double, fires int, covered boolean"


def by_loops(intervals, valleys, evidence, n, duration, reach, margin, thresholds):
    out = [list(r) for r in sorted(intervals, key=lambda r: (r[1], r[0]))]
    gains = {}
    for i, iv in enumerate(out):
        for k, side in ((1, "start"), (2, "end")):
            b = iv[k]
            now = int(np.clip(round(b * FPS), 0, n - 1))
            lo, hi = max(0.0, b - reach), min(duration, b + reach)
            if side == "start":
                lo, hi = max(lo, out[i - 1][2] if i else 0.0), min(hi, iv[2] - 0.5)
            else:
                lo, hi = max(lo, iv[1] + 0.5), min(hi, out[i + 1][1] if i + 1 < len(out) else duration)
            if hi <= lo:
                continue
            best = None
            for v in valleys:
                score, fires, covered = evidence[side][v]
                if round(lo * FPS) <= v <= round(hi * FPS) and v != now and covered and fires >= 2 and score >= thresholds[side] and score >= evidence[side][now][0] + margin and (best is None or score > best[0]):
                    best = (score, v)
            if best:
                gains[iv[0], side] = best[0] - evidence[side][now][0]
                iv[k] = round(best[1] / FPS, 3)
    return {r[0]: (r[1], r[2], gains.get((r[0], "start")), gains.get((r[0], "end"))) for r in out}


@pytest.mark.parametrize("seed", range(3))
def test_refined(spark, seed):
    rnd, want, rows, bottoms, evidence, media = np.random.default_rng(seed), {}, [], [], [], []
    thresholds = {"start": 0.4, "end": 0.5}
    for m in range(4):
        n = int(rnd.integers(800, 1600))
        duration, at, own = n / FPS, 0.0, []
        while at < duration - 3:
            start = at + float(rnd.choice([-0.4, 0.0, 0.7, 3.0, 9.0]))
            end = start + float(rnd.choice([0.3, 2.0, 5.0, 9.0]))
            own.append((len(own), round(max(0.0, start), 2), round(max(0.1, end), 2)))
            at = end
        valleys = sorted({int(v) for v in rnd.integers(0, n, n // 12)})
        ev = {s: [(float(rnd.choice([0.1, 0.45, 0.6, 0.6, 0.9])), int(rnd.integers(1, 4)), bool(rnd.random() < 0.8)) for _ in range(n)] for s in thresholds}
        rows += [(m, *r) for r in own]
        bottoms += [(m, v, 0.5) for v in valleys]
        evidence += [(m, s, i, *x) for s, xs in ev.items() for i, x in enumerate(xs)]
        media.append((m, n, duration, 0.2 if m == 3 else 0.9))
        want[m] = {i: (a, b, None, None) for i, a, b in own} if m == 3 else by_loops(own, valleys, ev, n, duration, 3.0, 0.12, thresholds)
    got = rf.refined(spark.createDataFrame(rows, SPAN), spark.createDataFrame(bottoms, "media_id long, bottom long, depth double"), spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(media, "media_id long, n long, duration double, pose double"), FPS, thresholds=thresholds)
    found = {}
    for r in got.collect():
        found.setdefault(r.media_id, {})[r.rally_id] = tuple(r)[2:]
    assert found.keys() == want.keys() and any(x[2] or x[3] for x in want[0].values())
    for m in want:
        assert found[m].keys() == want[m].keys()
        for k in want[m]:
            assert found[m][k] == pytest.approx(want[m][k], abs=1e-9)


def one_valley(spark, spans, bottom, reach=3.0, margin=0.1, pose=0.9):
    n = 720
    ev = [(1, s, i, 1.0 if s == "end" and abs(i - bottom) <= 5 else 0.0, 2, True) for s in ("start", "end") for i in range(n)]
    rows = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(spans)], SPAN)
    out = rf.refined(rows, spark.createDataFrame([(1, bottom, 0.5)], "media_id long, bottom long, depth double"), spark.createDataFrame(ev, EVIDENCE), spark.createDataFrame([(1, n, 60.0, pose)], "media_id long, n long, duration double, pose double"), FPS, reach, margin, {"start": 0.55, "end": 0.5})
    return [(r.start, r.end) for r in out.orderBy("rally_id").collect()]


def test_guards(spark):
    bottom = 240
    spans = [(10.0, 21.0), (22.0, 33.0), (34.0, 45.0)]
    assert one_valley(spark, spans, bottom)[0] == (10.0, 20.0) and one_valley(spark, spans, bottom)[1:] == spans[1:]
    assert one_valley(spark, spans, bottom, margin=1.01) == spans
    assert one_valley(spark, spans, bottom, reach=0.5) == spans
    assert one_valley(spark, spans, bottom, pose=0.2) == spans
    crossed = [(10.0, 21.0), (19.7, 33.0), (34.0, 45.0)]
    assert one_valley(spark, crossed, bottom)[0] == (10.0, 21.0)
    assert one_valley(spark, [], bottom) == []


def test_joint_scores(spark):
    rows = [(1, 0, 0.2, 0.5, 1.0, 0.0), (1, 1, 0.4, 0.0, 0.1, 1.0), (1, 2, -1.0, 9.0, 0.0, 0.0)]
    channels = spark.createDataFrame(rows, "media_id long, idx long, motion_contrast double, motion_slope double, swing double, overhead double")
    hits = spark.createDataFrame([(1, 0, 0.7), (1, 2, 1.0)], "media_id long, idx long, hit double")
    ranges = {"motion_contrast": (0.0, 0.4), "motion_slope": (0.0, 0.5), "swing": (0.1, 1.2), "overhead": (0.0, 0.0), "hit": (0.25, 1.0)}
    weights = {"motion_contrast": 1.0, "motion_slope": 2.0, "swing": 0.0, "overhead": 1.0, "hit": 1.0}
    got = [tuple(r)[2:] for r in rf.joint_scores(channels, hits, ranges, weights).orderBy("idx").collect()]
    clip = lambda v, lo, hi: min(1.0, max(0.0, (v - lo) / (hi - lo)))
    for (score, fires), (_, _, a, b, _, o), hit in zip(got, rows, (0.7, 0.0, 1.0)):
        parts = [clip(a, 0, 0.4), clip(b, 0, 0.5), clip(hit, 0.25, 1.0)]
        curve = (parts[0] + 2 * parts[1] + clip(o, 0, 1e-9)) / 4
        assert score == pytest.approx((curve * 4 + parts[2]) / 5) and fires == sum(p >= 0.5 for p in parts)
    assert rf.joint_scores(channels, hits, ranges, {}).agg(F.max("score"), F.max("fires")).first()[:] == (0.0, 0)


def test_coverage_around(spark):
    x = np.random.default_rng(0).random(60)
    got = [r.covered for r in rf.well_covered(spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "media_id long, idx long, value double"), FPS).orderBy("idx").collect()]
    assert got == [bool(np.mean(x[max(0, i - 6) : i + 7] >= 0.5) >= 0.5) for i in range(60)]
