"""The staged search of settings against plain loops."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_segmentation import FPS, SIGNAL, motion_by_loops, squares

from tidemark.operators import optimise as op
from tidemark.operators import segmentation as sg
from tidemark.plans import segmentation

LABEL = "media_id long, rally_id long, start double, end double"


def task(seed, media=3, n=700):
    rnd, signals, labels = np.random.default_rng(seed), {}, {}
    for k in itertools.count(seed * 100):
        x = squares(k, n)
        found = motion_by_loops(x, None, least=2.5, core=1.2, pre=0.4, post=0.9)
        if len(found) < 3:
            continue
        if (m := len(signals)) == media:
            break
        signals[m] = x
        labels[m] = [(round(float(s + rnd.uniform(-0.2, 0.6)), 2), round(float(e + rnd.uniform(-0.3, 0.7)), 2)) for s, e, _ in found]
    return signals, labels


def search(spark, signals, labels, **more):
    rows = spark.createDataFrame([(m, i, float(v)) for m, x in signals.items() for i, v in enumerate(x)], SIGNAL)
    spans = spark.createDataFrame([(m, i, a, b) for m, xs in labels.items() for i, (a, b) in enumerate(xs)] + [(0, 99, 5.0, 5.0)], LABEL)
    return op.Search(rows, spark.createDataFrame([(m, len(x) / FPS) for m, x in signals.items()], "media_id long, duration double"), spans, FPS, **more)


def pairs_of(preds, gt, least):
    iou = lambda a, b: max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0]))
    every = sorted(((iou(a, b), i, j) for i, a in enumerate(preds) for j, b in enumerate(gt) if min(a[1], b[1]) > max(a[0], b[0]) and iou(a, b) >= least), reverse=True)
    left, right, out = set(), set(), []
    for _, i, j in every:
        if i not in left and j not in right:
            left.add(i), right.add(j), out.append((preds[i], gt[j]))
    return out


def scored(x, gt, window=None, **settings):
    lo, hi = window or (min(a for a, _ in gt), max(b for _, b in gt))
    preds = [s[:2] for s in motion_by_loops(x, None, **settings) if s[1] > lo and s[0] < hi]
    tp, loose, total = len(pairs_of(preds, gt, 0.5)), pairs_of(preds, gt, 0.3), len(preds) + len(gt)
    f1, ends = round(2 * tp / total, 4), [round(2 * sum(abs(a[k] - b[k]) <= 1.0 for a, b in loose) / total, 4) for k in (0, 1)]
    band = round(sum(ends) / 2, 4)
    off = [round(float(np.median([a[k] - b[k] for a, b in loose])), 3) if loose else None for k in (0, 1)]
    precision, recall = round(tp / len(preds), 4) if preds else 0.0, round(tp / len(gt), 4)
    return {"n": len(preds), "tp": tp, "precision": precision, "recall": recall, "f1": f1, "band_f1": band, "score": round(0.7 * f1 + 0.3 * band, 4), "start_off": off[0], "end_off": off[1]}


def close(row, want, tolerance=2e-4):
    for k, v in want.items():
        assert row[k] == (None if v is None else pytest.approx(v, abs=tolerance)), k


VALUES = {"core": [0.8, 1.8], "rest": [0.6, 1.2], "least": [2.0, 3.0]}


def test_every_combination_is_scored(spark):
    signals, labels = task(1)
    job = search(spark, signals, labels)
    rows = job.segmented(job.base(), VALUES).collect()
    combos = list(itertools.product(*VALUES.values()))
    assert len(rows) == len(combos) * len(signals)
    for r in rows:
        settings = dict(zip(VALUES, combos[r.param_id]))
        assert {k: r[k] for k in VALUES} == settings
        close(r, scored(signals[r.media_id], labels[r.media_id], **settings))


def test_the_window_is_focus_and_labels(spark):
    signals, labels = task(2)
    focus = spark.createDataFrame([(0, 10.0, 30.0), (1, 900.0, 950.0)], "media_id long, lo double, hi double")
    job = search(spark, signals, labels, focus=focus)
    rows = {r.media_id: r for r in job.evaluated(job.base()).collect()}
    box = {m: (min(a for a, _ in x), max(b for _, b in x)) for m, x in labels.items()}
    close(rows[0], scored(signals[0], labels[0], (max(10.0, box[0][0]), min(30.0, box[0][1]))))
    close(rows[1], scored(signals[1], labels[1], box[1]))


def test_the_staged_search(spark):
    signals, labels = task(3)
    fields = {"core": (0.6, 3.0), "ratio": (0.05, 0.5)}
    got = {}
    for r in op.optimised(search(spark, signals, labels), VALUES, fields).collect():
        got.setdefault(r.media_id, {})[r.stage] = r
    key = lambda m: (m["score"], m["f1"], m["recall"], m["precision"])
    for m, x in signals.items():
        gt = labels[m]
        first = scored(x, gt)
        close(got[m]["baseline"], {k: first[k] for k in ("f1", "score")})
        tried = [(scored(x, gt, **dict(zip(VALUES, c))), dict(zip(VALUES, c))) for c in itertools.product(*VALUES.values())]
        now, settings = max(tried, key=lambda t: key(t[0]))
        close(got[m]["segment"], {"score": now["score"], **settings})
        settings = sg.SETTINGS | settings
        ds, de = first["start_off"], first["end_off"]
        if abs(ds) >= 0.25 or abs(de) >= 0.25:
            pads = [sorted({settings[k], round(min(2.0, max(0.0, settings[k] + by)), 2)}) for k, by in (("pre", ds), ("post", -de))]
            tried = [(scored(x, gt, **(settings | {"pre": a, "post": b})), {"pre": a, "post": b}) for a, b in itertools.product(*pads)]
            best, patch = max(tried, key=lambda t: key(t[0]))
            if best["score"] > now["score"] and best["f1"] >= now["f1"] - 0.005:
                now, settings = best, settings | patch
        close(got[m]["padding"], {"score": now["score"], "pre": settings["pre"], "post": settings["post"]})
        for _ in range(2):
            moved = False
            for field, (lo, hi) in fields.items():
                tried = []
                for f in op.FACTORS:
                    v = round(min(hi, max(lo, settings[field] * f)), 4)
                    if abs(v - settings[field]) >= 1e-9:
                        tried.append((scored(x, gt, **(settings | {field: v})), -abs(f - 1.0), {field: v}))
                best, _, patch = max(tried, key=lambda t: (t[0]["score"], t[1]))
                if best["score"] > now["score"] + 0.002 and best["f1"] >= now["f1"] - 0.005:
                    now, settings, moved = best, settings | patch, True
            if not moved:
                break
        close(got[m]["final"], {"score": now["score"], **{k: settings[k] for k in fields}})
        assert got[m]["final"]["score"] >= got[m]["segment"]["score"]


def test_suggested_values(spark):
    labels = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([(0.0, 5.0), (6.0, 9.0), (10.5, 14.0), (16.0, 26.0)])] + [(2, 0, 0.0, 9.0)], LABEL)
    got = {r.media_id: r for r in op.suggested(labels).collect()}
    p10, p25 = np.percentile([5, 3, 3.5, 10], [10, 25])
    clip = lambda f, v: round(min(op.BOUNDS[f][1], max(op.BOUNDS[f][0], v)), 1)
    assert got[1].least_grid == sorted({*op.GRID["least"], clip("least", 0.6 * p10), clip("least", 0.8 * p25)})
    assert got[1].core_grid == sorted({*op.GRID["core"], clip("core", 0.4 * p10), clip("core", 0.5 * p25)})
    assert got[2].least_grid == op.GRID["least"] and got[2].rest_grid == op.GRID["rest"] and set(op.GRID["rest"]) <= set(got[1].rest_grid)


def test_nothing_to_search(spark):
    job = search(spark, {}, {})
    assert op.optimised(job, VALUES).collect() == [] == op.swept(job, VALUES).collect()


@pytest.mark.parametrize("more", [{}, {"most": 5.0}, {"coverage": True}])
def test_a_sweep_is_the_best_of_the_whole_grid(spark, more):
    signals, labels = task(7)
    job = search(spark, signals, labels)
    if more.pop("coverage", False):
        job.coverage = job.signal.withColumn("value", F.when((F.col("idx") % 240 > 100) & (F.col("media_id") < 2), 1.0).otherwise(0.0))
    values = {"ratio": [0.1, 0.3], "core": [0.8, 2.5], "rest": [0.3, 1.2], "apart": [0.6, 1.0], "least": [1.5, 3.0]}
    every = job.segmented(job.base(**more), values).withColumn("exact", F.col("tp") / (F.col("n") + F.col("fn") + F.col("tp")))
    want = {r.media_id: r for r in op.best_of(every, "exact").drop("exact", "start_off", "end_off").collect()}
    got = {r.media_id: r for r in op.swept(job, values, **more).collect()}
    assert got == want and len(got) == 3 and any(r.tp for r in got.values())


def test_the_query_tries_the_whole_sweep(spark, monkeypatch):
    tried = []
    monkeypatch.setattr(segmentation.op, "swept", lambda job, values=op.SWEPT: tried.append(values))
    segmentation.ALL["en_sweep"][0](spark, "/root/testdata/sf0.001")
    assert [{k: len(v) for k, v in t.items()} for t in tried] == [{"ratio": 4, "core": 4, "rest": 3, "apart": 2, "least": 3}]
