"""Qualities, densities, the choice of a segmentation and cutting stored signals anew."""

import numpy as np
import pytest
from test_segmentation import SIGNAL, SPAN

from tidemark.operators import labels as lb
from tidemark.operators import resegment as rs

FPS = 12.0
HIT = "media_id long, hit_idx long, t double, strength double, confidence double"


def quality(segs, density):
    d = np.array([e - s for s, e, _ in segs])
    gaps = [max(0.0, b[0] - a[1]) for a, b in zip(segs, segs[1:])]
    cv = d.std() / max(d.mean(), 1e-6)
    spread = np.clip(cv / 0.45, 0, 1) if cv < 0.45 else np.clip((1.2 - cv) / 0.6, 0, 1)
    q = np.clip(0.45 * (np.mean(np.array(gaps) > 1.0) if gaps else 0.0) + 0.25 * spread + 0.15 * np.mean((d >= 4) & (d <= 90)) + 0.15 * np.mean([c for *_, c in segs]), 0, 1)
    if density is not None and density.sum() > 0:
        mask = np.zeros(len(density), bool)
        for s, e, _ in segs:
            a = max(0, min(len(density) - 1, int(s * FPS)))
            mask[a : max(a + 1, min(len(density), int(e * FPS)))] = True
        p, r = density[mask].mean(), density[mask].sum() / density.sum()
        q = 0.3 * q + 0.7 * min(1.0, 2 * p * r / (p + r) if p + r else 0.0)
    return float(np.clip(q, 0, 1))


def normed(x):
    lo, hi = np.percentile(x, [5, 95])
    return np.zeros_like(x) if hi - lo < 1e-9 else np.clip((x - lo) / (hi - lo), 0, 1)


def smoothed(x, w):
    return np.convolve(np.r_[[x[0]] * (w // 2), x, [x[-1]] * (w - 1 - w // 2)], np.ones(w) / w, "valid")


def signal(spark, xs):
    return spark.createDataFrame([(m, i, float(v)) for m, x in xs.items() for i, v in enumerate(x)], SIGNAL)


def test_qualities_and_the_choice(spark):
    rnd, rows, want, density = np.random.default_rng(5), {"a": [], "b": []}, {}, {}
    for m in range(12):
        n = 900
        density[m] = np.zeros(n) if m == 4 else rnd.random(n) * np.repeat(rnd.integers(0, 2, n // 60 + 1), 60)[:n]
        for name in rows:
            k, at, own = int(rnd.integers(1, 7)), 0.0, []
            for i in range(k):
                at += float(rnd.choice([0.2, 1.5, 4.0]))
                end = at + float(rnd.choice([2.0, 5.0, 9.0]))
                own.append((at, end, float(rnd.random())))
                rows[name].append((m, i, *own[-1]))
                at = end
            want[m, name] = quality(own, density[m] if m % 3 else None)
    frames = {k: spark.createDataFrame(v, SPAN) for k, v in rows.items()}
    curves = signal(spark, {m: x for m, x in density.items() if m % 3})
    got = lb.segment_quality(frames["a"].withColumnRenamed("score", "confidence"), density=curves, fps=FPS)
    assert {r.media_id: r.quality for r in got.collect()} == pytest.approx({m: want[m, "a"] for m in range(12)})
    for hybrid in (False, True):
        picked = {r.media_id: r.method for r in rs.dispatched(list(frames.items()), curves, FPS, hybrid).collect()}
        assert picked == {m: "b" if want[m, "b"] > want[m, "a"] + (0.05 if hybrid else 0) else "a" for m in range(12)}
    only = rs.dispatched([("a", frames["a"].where("media_id > 5")), ("b", frames["b"])], curves, FPS)
    assert {r.media_id for r in only.where("method = 'b'").collect()} >= set(range(6))


def test_density_and_evidence(spark):
    rnd, n = np.random.default_rng(6), 400
    hits = {0: [(t, c) for t, c in zip(rnd.uniform(-1, 36, 50), rnd.random(50))], 1: [(5.0, 0.1), (6.0, 0.05)], 2: []}
    rows = [(m, i, float(t), 0.5, float(c)) for m, xs in hits.items() for i, (t, c) in enumerate(xs)]
    media = spark.createDataFrame([(m, n, n / FPS) for m in hits], "media_id long, n long, duration double")
    density = rs.hit_density(spark.createDataFrame(rows, HIT), media, FPS)
    motion = {m: rnd.random(n) for m in hits}
    got, both = {}, {}
    for r in density.collect():
        got.setdefault(r.media_id, {})[r.idx] = r.value
    for r in rs.joint_evidence(signal(spark, motion), density).collect():
        both.setdefault(r.media_id, {})[r.idx] = r.value
    assert set(got) == {0, 1} and set(both) == {0, 1, 2}
    for m in hits:
        want = normed(motion[m])
        if hits[m]:
            kept = [t for t, c in hits[m] if c >= 0.15] or [t for t, _ in hits[m]]
            x = np.zeros(n)
            for t in kept:
                x[int(np.clip(round(t * FPS), 0, n - 1))] += 1
            h = normed(smoothed(x, 24))
            np.testing.assert_allclose([got[m][i] for i in range(n)], h, atol=1e-9)
            want = normed(want * (0.3 + 0.7 * normed(h))) if h.any() else want
        np.testing.assert_allclose([both[m][i] for i in range(n)], want, atol=1e-9)


def test_stored_signals_cut_anew(spark):
    rnd, n = np.random.default_rng(0), 1440
    x = np.full(n, 0.1)
    for a, b in ((10, 40), (60, 95)):
        x[a * 12 : b * 12] = 0.9
    motion = {m: np.clip(x + rnd.normal(0, 0.02, n), 0, 1) for m in (1, 2, 3)} | {4: np.zeros(n)}
    hits = [(1, i, float(t), 0.8, 0.9) for i, t in enumerate([*np.arange(12, 38, 1.2), *np.arange(62, 93, 1.2)])]
    media = spark.createDataFrame([(m, n, n / FPS) for m in motion], "media_id long, n long, duration double")
    cover = signal(spark, {m: np.ones(n) for m in motion})
    fallback = spark.createDataFrame([(m, 1, 20.0, 30.0, 0.5) for m in (1, 4)], SPAN)
    args = (signal(spark, motion), signal(spark, motion), spark.createDataFrame(hits, HIT), media, FPS, 3.0, 10.0)
    got = {}
    for r in rs.resegmented(*args, cover, fallback).collect():
        got.setdefault(r.media_id, []).append((r.start, r.end, r.method))
    for m in (1, 2, 3):
        a, b = sorted(got[m])
        assert 7 <= a[0] <= 12 and 37 <= a[1] <= 43 and 57 <= b[0] <= 62 and 92 <= b[1] <= 98
    assert {x[2] for x in got[1]} <= {"player_motion", "activity_valleys"}
    assert got[4] == [(19.0, 31.6, "activity_state_machine")]
    hybrid = rs.resegmented(*args, cover, None, True).select("media_id", "method").distinct().collect()
    assert {r.media_id for r in hybrid} == {1, 2, 3} and {r.method for r in hybrid} <= {"player_motion", "activity_valleys"}
