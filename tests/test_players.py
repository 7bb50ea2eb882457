"""Active players, sides, swings, busy places and shifted polygons, against plain loops and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boxes as bx
from tidemark.operators import evidence as be
from tidemark.operators import heat, players, pose
from tidemark.operators import labels as lb
from tidemark.operators import spans as sp
from tidemark.operators import timeline as tl

BOX = "media_id long, frame long, track long, box_id long, x1 double, y1 double, x2 double, y2 double, conf double"
PEOPLE = "media_id long, frame long, person long, points array<struct<x: double, y: double, conf: double>>"


@pytest.mark.parametrize("keep", [0.985, 0.5, 0.05])
def test_eased_levels(spark, keep):
    rnd = random.Random(1)
    runs = {m: [rnd.choice([None, rnd.uniform(-1, 3)]) for _ in range(n)] for m, n in ((0, 1), (1, 257), (2, 1500))}
    rows = spark.createDataFrame([(m, i, x) for m, xs in runs.items() for i, x in enumerate(xs)], "media_id long, idx long, value double").repartition(4)
    got = {(r.media_id, r.idx): r.level for r in heat.eased(rows, ["media_id"], keep, 64).collect()}
    for m, xs in runs.items():
        level = None
        for i, x in enumerate(xs):
            level = (x or 0.0) if level is None else keep * level + (1 - keep) * (x or 0.0)
            assert got[m, i] == pytest.approx(level, abs=1e-9)
    assert len(got) == 1758 and heat.eased(rows.where("idx < 0"), ["media_id"]).count() == 0


def test_the_map_is_what_cells_are_eased_to(spark):
    rnd = random.Random(2)
    rows = spark.createDataFrame([(m, i, x, y, rnd.random()) for m in range(2) for i in range(300) for x in range(3) for y in range(2)], "media_id long, idx long, cell_x int, cell_y int, value double")
    ends = heat.eased(rows, ["media_id", "cell_x", "cell_y"]).where("idx = 299")
    got = heat.activity_map(rows).join(ends.select("media_id", "cell_x", "cell_y", F.col("level").alias("end")), ["media_id", "cell_x", "cell_y"]).collect()
    assert len(got) == 12 and all(r.level == pytest.approx(r.end, abs=1e-9) for r in got)


def test_boxes_of_busy_cells(spark):
    cells = []
    for m in range(4):
        for x in range(20):
            for y in range(10):
                level = {0: 1.0 if 5 <= x <= 8 and 2 <= y <= 4 else 0.1, 1: 0.0, 2: 1.0 if (x, y) == (7, 7) else 0.01 * (x >= 10), 3: 1.0}[m]
                cells.append((m, x, y, level))
    got = {r.media_id: tuple(r)[1:] for r in heat.busy_box(spark.createDataFrame(cells, "media_id long, cell_x int, cell_y int, level double"), 20, 10).collect()}
    for m in range(4):
        a = np.array([c[3] for c in cells if c[0] == m]).reshape(20, 10).T
        hot = a / (a.max() + 1e-9) > 0.35
        if hot.sum() < 0.02 * hot.size:
            hot = a > np.percentile(a, 85)
        ys, xs = np.where(hot)
        want = (0, 0, 1, 1) if not len(ys) else (max(0, xs.min() / 20 - 0.04), max(0, ys.min() / 10 - 0.04), min(1, (xs.max() + 1) / 20 + 0.04), min(1, (ys.max() + 1) / 10 + 0.04))
        assert got[m] == pytest.approx(want)


def swung_by_loops(people, n, fps, height, smoothing):
    frames = {}
    for _, f, person, pts in sorted(people, key=lambda r: (r[1], r[2])):
        see = lambda i: pts and i < len(pts) and pts[i] and pts[i][2] is not None and pts[i][2] > 0.35  # noqa: B023, E731
        mids = [pts[i][:2] for i in (5, 6) if see(i)]
        hands = [(pts[i][2], i) for i in (9, 10) if see(i)]
        if not mids or not hands or not 0 <= f < n:
            continue
        mid = np.mean(mids, axis=0)
        feet = [pts[i][1] for i in (15, 16) if see(i)]
        body = max(feet) - mid[1] if feet else 0.9 * mid[1]
        if body < 0.02 * height:
            continue
        hand = np.array(pts[max(hands)[1]][:2])
        if f not in frames:
            frames[f] = [mid, hand, body, hand[1] < mid[1]]
        else:
            old = frames[f]
            far = hand if np.hypot(*(hand - old[0])) > np.hypot(*(old[1] - old[0])) else old[1]
            frames[f] = [old[0], far, max(old[2], body), hand[1] < old[0][1]]
    if len(frames) < max(4, 0.05 * n):
        return {}
    known, idx = sorted(frames), np.arange(n)
    rel = [np.interp(idx, known, [(frames[f][1] - frames[f][0])[k] for f in known]) for k in (0, 1)]
    d = np.concatenate([[0.0], np.hypot(np.diff(rel[0]), np.diff(rel[1]))]) * fps
    good = [f for f in known if frames[f][2] > 1]
    bodies = np.interp(idx, good, [frames[f][2] for f in good]) if len(good) > 2 else np.full(n, max(1.0, 0.2 * height))
    swing, width = np.clip(d / bodies, 0, 6), max(1, round(smoothing * fps))
    swing = np.convolve(swing, np.ones(width) / width, mode="same")
    return {f: (swing[f] if f in frames else 0.0, f in frames, bool(f in frames and frames[f][3])) for f in range(n)}


@pytest.mark.parametrize("smoothing", [0.05, 0.2, 0.3])
def test_swings(spark, smoothing):
    rnd, rows = random.Random(3), []
    for m, n in ((0, 60), (1, 60), (2, 200), (3, 30)):
        for f in range(n if m != 2 else 9):
            for person in range(rnd.choice([0, 1, 2, 3])):
                pts = [(rnd.uniform(0, 640), rnd.uniform(0, 480), rnd.choice([None, 0.2, 0.35, 0.5, 0.9])) for _ in range(17)]
                if m == 3:
                    pts[5] = pts[6] = None
                rows.append((m, f, person, rnd.choice([pts, pts, pts, pts[:10], None])))
    frames = spark.createDataFrame([(0, 60), (1, 64), (2, 200), (3, 30)], "media_id long, n long")
    out = pose.swing(spark.createDataFrame(rows, PEOPLE).repartition(3), frames, 12.0, 480.0, smoothing)
    got = {m: {r.frame: (r.swing, r.ok, r.overhead) for r in out.collect() if r.media_id == m} for m in range(4)}
    for m, n in ((0, 60), (1, 64), (2, 200), (3, 30)):
        want = swung_by_loops([r for r in rows if r[0] == m], n, 12.0, 480.0, smoothing)
        assert got[m].keys() == want.keys()
        for f, w in want.items():
            assert got[m][f][0] == pytest.approx(w[0], abs=1e-9) and got[m][f][1:] == w[1:]
    assert got[0] and not got[3]
    calm = {r.media_id: r.quiet for r in pose.quiet(out).collect()}
    for m in calm:
        above = [s for s, _, _ in got[m].values() if s > 0]
        assert calm[m] == pytest.approx(np.percentile(above, 25) if above else 0.0)


def picked_by_loops(candidates, most=4):
    ranked = sorted(candidates, key=lambda c: (-c["score"], c["track"]))
    best = ranked[0]["score"]
    if best <= 1e-6:
        return [ranked[0]["track"]]
    groups, out = [], []
    for c in ranked:
        if len(out) >= most:
            break
        own = None
        for g in groups:
            lead = g["lead"]
            ratio = max(c["area"], lead["area"]) / max(1e-9, min(c["area"], lead["area"]))
            if min(c["t1"], lead["t1"]) > max(c["t0"], lead["t0"]) and abs(c["cx"] - lead["cx"]) <= 0.08 and ratio <= 2.5:
                own = g
                break
        if own:
            gain = max(0.0, own["t0"] - c["t0"]) + max(0.0, c["t1"] - own["t1"])
            if gain < 2 or gain < 0.5 * max(1e-6, c["t1"] - c["t0"]):
                continue
        if not c["moving"]:
            continue
        if out and c["score"] < max(0.55 * best, 0.30):
            break
        out.append(c["track"])
        if own:
            own["t0"], own["t1"] = min(own["t0"], c["t0"]), max(own["t1"], c["t1"])
        else:
            groups.append({"lead": c, "t0": c["t0"], "t1": c["t1"]})
    return out


@pytest.mark.parametrize("seed", range(3))
def test_picks(spark, seed):
    rnd, rows = random.Random(seed), []
    for m in range(25):
        for track in range(rnd.randrange(1, 14)):
            t0 = rnd.choice([0.0, 1.0, 5.0, 9.0])
            score = 0.0 if m == 7 else rnd.choice([0.2, 0.3, 0.5, 0.5, 0.55, 0.8, 0.9])
            rows.append((m, track, t0, t0 + rnd.choice([0.5, 2.0, 6.0]), rnd.choice([0.2, 0.25, 0.31, 0.7]), rnd.choice([0.01, 0.02, 0.03]), score, rnd.random() < 0.8))
    df = spark.createDataFrame(rows, "media_id long, track long, t0 double, t1 double, cx double, area double, score double, moving boolean")
    got = {}
    for r in players.picked(df.repartition(3)).orderBy("media_id", "place").collect():
        got.setdefault(r.media_id, []).append(r.track)
    names = df.columns
    for m in range(25):
        assert got.get(m, []) == picked_by_loops([dict(zip(names, r)) for r in rows if r[0] == m])
    assert max(map(len, got.values())) == 4 and len(got[7]) == 1
    assert players.picked(df.where("media_id < 0")).count() == 0


def test_small_and_resting_tracks_are_not_players(spark):
    rows = []
    for track, h, step in ((1, 0.18, 0.004), (2, 0.17, 0.003), (3, 0.03, 0.004), (4, 0.17, 0.0)):
        for f in range(200):
            x, w = 0.2 * track + step * min(f % 40, 40 - f % 40), 0.01 if track == 3 else 0.05
            rows.append((0, f, track, track * 1000 + f, x - w, 0.5, x + w, 0.5 + h, 0.9))
    rows += [(1, f, 9, f, 0.1, 0.1, 0.2, 0.3, None) for f in range(2)]  # too short, but there is no other
    boxes = spark.createDataFrame(rows, BOX)
    scored = players.scored(boxes.repartition(3), 12.0)
    got = {(r.media_id, r.track): r for r in scored.collect()}
    assert got.keys() == {(0, 1), (0, 2), (0, 4), (1, 9)}
    one = got[0, 1]
    steps = [0.0] + [abs(0.004 * (min(f % 40, 40 - f % 40) - min((f - 1) % 40, 40 - (f - 1) % 40))) * 1.7778 * 12 for f in range(1, 200)]
    refs = [np.percentile([np.mean(np.array(steps[1:]) * k) for k in (1, 0.75, 0)], 90), np.percentile([max(steps) * k for k in (1, 0.75, 0)], 90)]
    area = np.percentile([0.1 * h for h in (0.18, 0.17, 0.17)], 90)
    want = 0.45 * min(1, 0.018 / area) + 0.40 * 200 / 224 * min(1, 0.65 * np.mean(steps[1:]) / refs[0] + 0.35 * max(steps) / refs[1]) + 0.15 * (199 / 12) / (200 / 12) - 0.35 * np.mean(np.array(steps[1:]) < 0.05)
    assert one.score == pytest.approx(want) and one.n == 200
    assert [r.track for r in players.picked(scored.where("media_id = 0")).orderBy("place").collect()] == [1, 2]
    high = {r.track: r.score for r in players.scored(boxes, 12.0, high_camera=True).collect()}
    assert high[1] > high[4]
    assert players.scored(boxes.where("frame < 0"), 12.0).count() == 0


def test_sides_of_servers(spark):
    rows = []
    for f in range(60):
        near, far = (0.01 * f if f >= 30 else 0.0), (0.01 * f if f < 30 else 0.0)
        rows += [(0, f, 1, 2 * f, 0.1 + near, 0.1, 0.4 + near, 0.5, 0.9), (0, f, 2, 2 * f + 1, 0.1 + far, 0.1, 0.2 + far, 0.3, 0.9)]
        rows += [(1, f, 1, 500 + 2 * f, 0.1 + near, 0.1, 0.3 + near, 0.3, 0.9), (1, f, 2, 501 + 2 * f, 0.1 + far, 0.1, 0.3 + far, 0.3, 0.9)]
    boxes = spark.createDataFrame(rows, BOX)
    active = boxes.select("media_id", "track").distinct()
    serves = spark.createDataFrame([(0, 1, 1.0), (0, 2, 4.0), (0, 3, None), (0, 4, 99.0), (1, 5, 1.0), (2, 6, 1.0)], "media_id long, rally_id long, serve_time double")
    got = {r.rally_id: (r.server, r.receiver) for r in players.sides(serves, boxes, active, 12.0).collect()}
    no = ("unknown", "unknown")
    assert got == {1: ("far", "near"), 2: ("near", "far"), 3: no, 4: no, 5: no, 6: no}
    assert {tuple(r)[2:] for r in players.sides(serves, boxes, active, 12.0, high_camera=True).collect()} == {no}
    shots = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (0, 1, 2), (0, 3, 0), (9, 9, 0)], "media_id long, rally_id long, nth int")
    named = players.shot_sides(shots, players.sides(serves, boxes, active, 12.0)).orderBy("rally_id", "nth").collect()
    assert [r.player for r in named] == ["far", "near", "far", "unknown", "unknown"]


def _polygon(spark, points):
    return spark.createDataFrame([(0, [{"x": x, "y": y} for x, y in points] if points is not None else None)], "media_id long, polygon array<struct<x: double, y: double>>")


CONVEX = [(0.2, 0.1), (0.9, 0.2), (0.8, 0.9), (0.1, 0.7)]


@pytest.mark.parametrize("points", [CONVEX, CONVEX[::-1]])
def test_a_margin_around_a_convex_polygon_is_that_of_its_edges(spark, points):
    rnd = random.Random(5)
    spots = spark.createDataFrame([(0, i, rnd.random(), rnd.random()) for i in range(3000)], "media_id long, i long, x double, y double")
    moved = spots.join(bx.shifted_out(_polygon(spark, points), 0.04), "media_id")
    got = {r.i for r in moved.where(bx.within(F.col("x"), F.col("y"), F.col("polygon"))).collect()}
    want = {r.i for r in spots.where(sp.near_polygon(F.col("x"), F.col("y"), CONVEX, 0.04)).collect()}
    assert got == want and len(want) > 1000
    plain = {r.i for r in spots.where(bx.in_polygon(F.col("x"), F.col("y"), CONVEX)).collect()}
    assert plain < want


def test_edges_of_a_notched_polygon_move_outward(spark):
    notched = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.5, 3.0), (2.5, 1.0), (1.5, 1.0), (1.5, 3.0), (0.0, 3.0)]
    want = [(-0.1, -0.1), (4.1, -0.1), (4.1, 3.1), (2.4, 3.1), (2.4, 1.1), (1.6, 1.1), (1.6, 3.1), (-0.1, 3.1)]
    for turn in (1, -1):
        got = bx.shifted_out(_polygon(spark, notched[::turn]), 0.1).first().polygon
        assert [pytest.approx((p.x, p.y)) for p in got] == want[::turn]


def test_polygons_that_cannot_grow_stay(spark):
    for points in ([], [(0.0, 0.0), (1.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 0.0)]):
        got = bx.shifted_out(_polygon(spark, points), 0.1).first().polygon
        assert [(p.x, p.y) for p in got] == points
    assert bx.shifted_out(_polygon(spark, None), 0.1).first().polygon is None
    assert [(p.x, p.y) for p in bx.shifted_out(_polygon(spark, CONVEX), 0.0).first().polygon] == CONVEX
    twice = CONVEX[:2] + CONVEX[1:]
    assert len(bx.shifted_out(_polygon(spark, twice), 0.1).first().polygon) == 4
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1]))) / 2
    grown = [(p.x, p.y) for p in bx.shifted_out(_polygon(spark, CONVEX), 0.1).first().polygon]
    round_ = sum(math.dist(a, b) for a, b in zip(CONVEX, CONVEX[1:] + CONVEX[:1]))
    assert area(grown) > area(CONVEX) + 0.1 * round_


def test_next_targets(spark):
    rnd = random.Random(8)
    queue = [(s, m, m + 10 * s, 100 * s + 20 * m + k, st, st + rnd.choice([1.0, 4.0])) for s in range(2) for m in (1, 3, 4) for k in range(6) for st in [float(rnd.randrange(0, 30))]]
    asks = [(i, rnd.choice([0, 1, 2, None]), m, None, rnd.choice([None, *[rnd.randrange(0, 360) / 10 for _ in range(9)], 30.94, 0.0])) for i in range(400) for m in [rnd.choice([0, 1, 2, 3, 4, 5])]]
    asks = [(i, s, m, None if s is None else m + 10 * s, t) for i, s, m, _, t in asks]
    got = {r.position: (r.verdict, r.next_media, r.next_id) for r in tl.next_targets(spark.createDataFrame(asks, "position long, scope long, nth_medium long, media_id long, t double").repartition(3), spark.createDataFrame(queue, "scope long, nth_medium long, media_id long, rally_id long, start double, end double").repartition(3), 3.0).collect()}
    assert len(got) == 400
    for i, s, m, media, t in asks:
        q = sorted((r for r in queue if r[0] == s), key=lambda r: (r[1], r[4], r[3]))
        want, at = None, [k for k, r in enumerate(q) if t is not None and r[2] == media and r[4] <= t <= r[5]]
        if t is None:
            pass
        elif at and t < q[at[0]][5] - 0.06:
            assert got[i] == ("stay", None, None)
            continue
        elif at:
            want = q[at[0] + 1] if at[0] + 1 < len(q) else None
        else:
            want = next((r for r in q if (r[4] > t + 0.02 if r[2] == media else r[1] > m)), None)
        assert got[i] == (("go", want[2], want[3]) if want else ("end", None, None))


def view_by_loops(rows, calibrated, foreshort, area, h, hint, aspect):
    if not rows:
        return hint or "unknown", 0.9 if hint else 0.0
    if len(rows) < 8:
        return "unknown", 0.0
    x, y = np.array([(r[1] + r[3]) / 2 for r in rows]), np.array([(r[2] + r[4]) / 2 for r in rows])
    tall = np.array([abs(r[4] - r[2]) for r in rows])
    spread = lambda v: np.percentile(v, 92) - np.percentile(v, 8)
    frames, ratios = {}, []
    for r, t in zip(rows, tall):
        frames.setdefault(r[0], []).append(t)
    for ts in frames.values():
        ts = sorted(ts, reverse=True)
        if len(ts) > 1 and ts[1] > 1e-9:
            ratios.append(ts[0] / ts[1])
    size, mid = (np.median(ratios) if ratios else 1.0), np.median(tall)
    wide = spread(x) * aspect / max(spread(y), 1e-3)
    if not calibrated:
        if mid < 0.11 and wide < 1.6 and size < 2:
            return "elevated", 0.45
        if wide > 1.8 and size < 2.2:
            return "side", 0.5
        return ("rear", 0.55) if size > 1.8 and wide < 1.6 else ("unknown", 0.3)
    k = h[6] * x + h[7] * y + h[8]
    u, v = (h[0] * x + h[1] * y + h[2]) / k, (h[3] * x + h[4] * y + h[5]) / k
    good = (abs(u) < 3) & (abs(v) < 3)
    court = spread(u[good]) / max(spread(v[good]), 1e-3) if good.sum() >= 8 else 0.0
    if hint:
        return hint, 0.9
    if mid < 0.11:
        return ("overhead", min(0.9, 0.5 + area * 0.5)) if foreshort > 0.8 and area > 0.3 else ("elevated", 0.6)
    if court > 1.5 and size < 2.2:
        return "side", min(0.9, 0.5 + 0.12 * min(court - 1.5, 3))
    if court < 1 and size > 1.35:
        return "rear", min(0.9, 0.5 + 0.15 * min(size - 1.35, 3))
    if wide > 1.8 and size < 2.2:
        return "side", 0.5
    if mid >= 0.16:
        return "rear", 0.55 if size > 1.6 else 0.4
    return "unknown", 0.3


def test_viewpoints(spark):
    rnd, rows, media = random.Random(9), {}, []
    for m in range(150):
        tall, sx, sy, other = rnd.choice([0.05, 0.14, 0.3]), rnd.choice([0.1, 0.4, 0.8]), rnd.choice([0.1, 0.4]), rnd.choice([1.0, 1.5, 3.0])
        n = rnd.choice([0, 3, 20, 20, 20, 20])
        rows[m] = [(f, 0.5 + sx * (x - 0.5), 0.5 + sy * (y - 0.5), 0.6 + sx * (x - 0.5), 0.5 + sy * (y - 0.5) + tall / (1 if k == 0 else other)) for f in range(n) for k in range(rnd.choice([1, 2, 3])) for x, y in [(rnd.random(), rnd.random())]]
        h = rnd.choice([[1.0, 0, 0, 0, 1, 0, 0, 0, 1], [1.2, 0.1, 0, 0, 2.5, 0, 0.1, 0.2, 1], [0.0] * 6 + [0.0, 0.0, 0.01]])
        media.append((m, rnd.random() < 0.7, rnd.choice([0.5, 0.9]), rnd.choice([0.2, 0.5]), [float(v) for v in h], rnd.choice([None] * 6 + ["side"])))
    boxes = spark.createDataFrame([(m, *r) for m, rs in rows.items() for r in rs] + [(0, 0, None, 0.1, 0.2, 0.3)], "media_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    got = {r.media_id: (r.viewpoint, r.confidence) for r in players.viewpoints(boxes.repartition(3), spark.createDataFrame(media, "media_id long, calibrated boolean, foreshort double, area_ratio double, h array<double>, hint string"), 1.78).collect()}
    for m, *rest in media:
        want = view_by_loops(rows[m], *rest, 1.78)
        assert got[m][0] == want[0] and got[m][1] == pytest.approx(want[1])
    assert {v for v, _ in got.values()} == {"unknown", "elevated", "side", "rear", "overhead"}


def test_rows_of_boundary_samples(spark):
    labels = spark.createDataFrame([(1, 0.4), (1, 9.9), (1, 50.0), (2, 1.0), (1, None)], "media_id long, t double")
    stops = spark.createDataFrame([(1, 7, 0.75), (1, 8, 0.75)], "media_id long, rally_id long, t double")
    channels = spark.createDataFrame([(1, i, float(i)) for i in range(21)], "media_id long, idx long, c double")
    got = sorted((r.t, r.positive, r.c) for r in be.boundary_samples(labels, stops, channels, 2.0).collect())
    assert got == [(0.4, True, 1.0), (0.75, False, 2.0), (9.9, True, 20.0), (50.0, True, 20.0)]
    assert be.boundary_samples(labels, stops, channels, 2.0, (0.0, 5.0)).count() == 2


def test_density_weighs_hits_by_evidence(spark):
    rnd = random.Random(10)
    value = {m: [rnd.random() for _ in range(60)] for m in range(3)}
    hits = [(m, rnd.uniform(-1, 70), rnd.choice([None, -0.5, 0.1, 0.5, 1.0, 2.0])) for m in (0, 2) for _ in range(40)]
    hits += [(1, 5.0, 0.1)]
    signal = spark.createDataFrame([(m, i, v) for m, vs in value.items() for i, v in enumerate(vs)], "media_id long, idx long, value double")
    got = {(r.media_id, r.idx): (r.density, r.activity) for r in be.weighted_density(spark.createDataFrame(hits, "media_id long, t double, evidence double"), signal, 1.0, 5, 2.0, 0.6).collect()}

    def scaled(a):
        lo, hi = np.percentile(a, [5, 95])
        return np.clip((a - lo) / (hi - lo), 0, 1) if hi - lo >= 1e-9 else np.zeros_like(a)

    for m in range(3):
        d = np.zeros(60)
        for _, t, e in (h for h in hits if h[0] == m):
            w = 0.0 if e is None else min(1, max(0, e)) ** 2
            d[min(59, max(0, round(t)))] += w if w > 0.02 else 0.0
        dens = scaled(np.convolve(np.pad(d, 2, mode="edge"), np.ones(5) / 5, mode="valid"))
        own = scaled(np.array(value[m]))
        act = scaled(own * (0.4 + 0.6 * dens)) if d.any() else scaled(own)
        assert [got[m, i][0] for i in range(60)] == pytest.approx(dens) and [got[m, i][1] for i in range(60)] == pytest.approx(act)


def test_medians_of_the_other_clips(spark):
    rnd = random.Random(11)
    rows = [(c, v, rnd.choice([None, 0.1, 0.2, 0.2, 0.5, rnd.random()])) for v, n in ((0, 1), (1, 2), (2, 3), (3, 8), (4, 41)) for c in range(n)]
    got = {(r.clip, r.variant): (r.trained, r.held) for r in lb.left_one_out(spark.createDataFrame(rows, "clip long, variant long, score double").repartition(3)).collect()}
    want = {}
    for c, v, x in rows:
        others = [s for k, w, s in rows if w == v and k != c and s is not None]
        if x is not None and others:
            want[c, v] = (np.median(others), x)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
