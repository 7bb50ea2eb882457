"""Queries over who plays and how: active tracks, sides, swings, places that move most, polygons with a margin, rings of events; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import boxes as bx
from tidemark.operators import evidence as be
from tidemark.operators import heat, players, pose
from tidemark.operators import timeline as tl
from tidemark.plans import evidence as pe
from tidemark.plans.boxes import MAP
from tidemark.plans.boxes import _WITH as _BOXES
from tidemark.plans.labels import rounded
from tidemark.plans.tracks import SLOW, fragments
from tidemark.sources import tables as tb
from tidemark.streaming import twins

FPS, TALL, SILENCE = 12.0, 480.0, 3 * 86400.0
NOTCHED = [(-0.3, -0.25), (0.3, -0.25), (0.3, 0.3), (0.05, 0.3), (0.0, 0.05), (-0.05, 0.3), (-0.3, 0.3)]


def pictures(s, d):
    """Vectors as pictures of 8 by 8 cells, and how much each cell changed since the medium's picture before."""
    rows = tb.read(s, d, "embeddings").select(F.pmod("vec_id", F.lit(4)).alias("media_id"), F.floor(F.col("vec_id") / 4).alias("idx"), F.col("embedding").cast("array<double>").alias("e"))
    before = rows.select("media_id", (F.col("idx") + 1).alias("idx"), F.col("e").alias("before"))
    cells = rows.join(before, ["media_id", "idx"]).select("media_id", (F.col("idx") - 1).alias("idx"), F.posexplode(F.zip_with("e", "before", lambda a, b: F.abs(a - b))).alias("cell", "value"))
    return cells.select("media_id", "idx", F.pmod("cell", F.lit(8)).cast("long").alias("cell_x"), F.floor(F.col("cell") / 8).alias("cell_y"), "value")


def people(s, d):
    """Vectors as key points of two people a frame."""
    e = lambda i: F.col("embedding")[i].cast("double")
    point = lambda k: F.struct((320 + 800 * e(3 * k)).alias("x"), (240 + 600 * e(3 * k + 1)).alias("y"), F.least(F.lit(1.0), 4 * F.abs(e(3 * k + 2))).alias("conf"))
    return tb.read(s, d, "embeddings").select(F.pmod("vec_id", F.lit(4)).alias("media_id"), F.floor(F.col("vec_id") / 8).alias("frame"), F.floor(F.pmod("vec_id", F.lit(8)) / 4).alias("person"), F.array(*[point(k) for k in range(17)]).alias("points"))


def _swings(s, d):
    rows = people(s, d)
    return pose.swing(rows, rows.groupBy("media_id").agg((F.max("frame") + 1).alias("n")), FPS, TALL)


def _moved(s, d):
    """The mean change of a picture, eased."""
    return heat.eased(pictures(s, d).groupBy("media_id", "idx").agg(F.avg("value").alias("value")), ["media_id"]).select("media_id", "idx", "level")


def _serves(s, d):
    rows = tb.read(s, d, "orders")
    return rows.select(F.pmod("o_custkey", F.lit(4)).alias("media_id"), F.col("o_orderkey").alias("rally_id"), (F.when(F.col("o_orderkey") % 11 > 0, F.pmod("o_orderkey", F.lit(600)) / 20.0)).alias("serve_time"))


def _sides(s, d):
    b = tb.boxes(s, d)
    return players.sides(_serves(s, d), b, b.where("track < 7").select("media_id", "track").distinct(), SLOW)


def _on_court(s, d):
    b = tb.boxes(s, d)
    mid = b.groupBy("media_id").agg(F.avg((F.col("x1") + F.col("x2")) / 2).alias("cx"), F.avg("y2").alias("cy"))
    courts = bx.shifted_out(mid.select("media_id", F.array(*[F.struct((F.col("cx") + x).alias("x"), (F.col("cy") + y).alias("y")) for x, y in NOTCHED]).alias("polygon")), 0.02)
    return b.join(courts, "media_id").where(bx.within((F.col("x1") + F.col("x2")) / 2, F.col("y2"), F.col("polygon"))).select("media_id", "frame", "box_id")


def _ring(s, d):
    return rounded(twins.against_ring(twins.with_time(tb.read(s, d, "events")), SILENCE), "excess")


def _views(s, d):
    """Labels in place of media, their camera in place of a customer's account."""
    b = tb.boxes(s, d).select(F.col("track").alias("media_id"), "frame", "x1", "y1", "x2", "y2")
    k = F.col("c_custkey")
    media = tb.read(s, d, "customer").where("c_custkey < 40").select(k.alias("media_id"), (k % 3 > 0).alias("calibrated"), (k % 10 / 9.0).alias("foreshort"), (k % 7 / 6.0).alias("area_ratio"), F.array(*[F.lit(float(v)) for v in MAP]).alias("h"), F.when(k % 5 == 0, "rear").alias("hint"))
    return rounded(players.viewpoints(b, media, 1.78), "confidence", "spread_x", "spread_y", "median_height", "size_ratio")


def _next(s, d):
    """Nations as scopes, hits as the places where playing stands."""
    who = tb.read(s, d, "customer").select(F.col("c_custkey").alias("media_id"), F.col("c_custkey").alias("nth_medium"), F.col("c_nationkey").alias("scope"))
    queue = tb.rallies(s, d).where("rally_id % 3 = 0").join(who, "media_id").select("scope", "nth_medium", "media_id", "rally_id", "start", "end")
    first = queue.groupBy("media_id").agg(F.min("start").alias("first"))
    asks = tb.hits(s, d).join(who, "media_id").join(first, "media_id", "left").select(F.col("hit_idx").alias("position"), "scope", "nth_medium", "media_id", (F.col("first") - 5 + F.pmod("hit_idx", F.lit(5000)) / 2.0).alias("t"))
    return tl.next_targets(asks, queue, 30.0)


def _density(s, d):
    first = tb.hits(s, d).groupBy("media_id").agg(F.min("t").alias("first"))
    h = tb.hits(s, d).join(first, "media_id").select("media_id", (F.col("t") - F.col("first")).alias("t"), F.col("confidence").alias("evidence"))
    return rounded(be.weighted_density(h, tb.signal(s, d), 1.0, 5, 2.0, 0.6), "density", "activity")


def _samples(s, d):
    ends = pe._span_intervals(s, d).select("media_id", F.col("end").alias("t"))
    return rounded(be.boundary_samples(ends, pe._pauses(s, d), be.side_channels(pe._motion(s, d), "end", pe.FPS, 0.2), pe.FPS), "t", *be.CHANNELS)


_CELLS = """WITH p AS (SELECT vec_id % 4 AS media_id, vec_id // 4 AS idx, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT a.media_id, a.idx - 1 AS idx, unnest(range(64)) AS cell, unnest(a.e) AS v, unnest(b.e) AS w FROM p a JOIN p b ON a.media_id = b.media_id AND a.idx = b.idx + 1),
d AS (SELECT media_id, idx, cell % 8 AS cell_x, cell // 8 AS cell_y, abs(v - w) AS value FROM c)"""
_MAP = _CELLS + """, t AS (SELECT media_id, max(idx) AS last FROM d GROUP BY 1),
m AS (SELECT media_id, cell_x, cell_y, sum(value * CASE WHEN idx = 0 THEN 1 ELSE 0.015::DOUBLE END * pow(0.985::DOUBLE, last - idx)) AS level FROM d JOIN t USING (media_id) GROUP BY 1, 2, 3)"""

_ACTIVE_SQL = """WITH e AS (SELECT vec_id % 4 AS media_id, vec_id // 8 AS frame, label, vec_id AS box_id, embedding[1]::DOUBLE AS e, embedding[2]::DOUBLE AS g FROM embeddings),
q AS (SELECT *, 0.2::DOUBLE + 0.25::DOUBLE * (label % 3) + 0.04::DOUBLE * e AS x, 0.5::DOUBLE + 0.03::DOUBLE * g AS y, 0.05::DOUBLE + 0.02::DOUBLE * abs(e) AS w FROM e),
m AS (SELECT media_id, frame, label * 1000 + frame // 9 AS track, box_id, x - w AS x1, y - 2 * w AS y1, x + w AS x2, y + 2 * w AS y2, abs(g) AS conf FROM q),
f AS (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, (x2 - x1) * (y2 - y1) AS a, greatest(y2 - y1, (x2 - x1) * 1.7778) AS s FROM m QUALIFY row_number() OVER (PARTITION BY media_id, track, frame ORDER BY conf DESC, box_id) = 1),
v AS (SELECT *, sqrt(((x - lag(x) OVER w) * 1.7778) ^ 2 + (y - lag(y) OVER w) ^ 2) / ((frame - lag(frame) OVER w) / 2.0::DOUBLE) AS speed FROM f WINDOW w AS (PARTITION BY media_id, track ORDER BY frame)),
g AS (SELECT media_id, track, count(*) AS n, (max(frame) - min(frame)) / 2.0::DOUBLE AS lasts, avg(x) AS cx, max(x) - min(x) AS reach, quantile_cont(a, 0.9) AS area, quantile_cont(s, 0.5) AS size, coalesce(avg(speed), 0) AS mean, coalesce(max(speed), 0) AS fast, coalesce(avg((speed < 0.05)::INT), 1) AS still FROM v GROUP BY 1, 2),
c AS (SELECT * FROM g QUALIFY n >= 3 OR (max(n) OVER (PARTITION BY media_id) < 3 AND row_number() OVER (PARTITION BY media_id ORDER BY n DESC, track) <= 2)),
h AS (SELECT media_id, frame, max(y2 - y1) AS h FROM m GROUP BY 1, 2),
r AS (SELECT media_id, CASE WHEN count(*) >= 5 AND quantile_cont(h, 0.9) >= 0.06 THEN greatest(0.03, 0.42 * quantile_cont(h, 0.9)) ELSE 0 END AS least, (max(frame) + 1) / 2.0::DOUBLE AS dur FROM h GROUP BY 1),
k AS (SELECT c.*, least, dur FROM c JOIN r USING (media_id) QUALIFY size >= least OR NOT bool_or(size >= least) OVER (PARTITION BY media_id)),
u AS (SELECT media_id, greatest(1e-6, quantile_cont(area, 0.9)) AS ar, greatest(1e-6, quantile_cont(mean, 0.9)) AS mr, greatest(1e-6, quantile_cont(fast, 0.9)) AS fr FROM k GROUP BY 1),
z AS (SELECT *, least(1, greatest(0, 0.45 * least(1, area / ar) + 0.40 * (n / (n + 4.0::DOUBLE)) * least(1, 0.65 * mean / mr + 0.35 * fast / fr) + 0.15 * least(1, lasts / dur) - 0.35 * still
  - CASE WHEN reach < 0.06 AND lasts > 0.5 * dur THEN 0.25 ELSE 0 END - 0.30 * least(1, greatest(0, (abs(cx - 0.5) - 0.42) / 0.08)))) AS score, mean / mr >= 0.2 AND area / ar >= 0.2 AS moving FROM k JOIN u USING (media_id)),
b AS (SELECT *, first(size) OVER (PARTITION BY media_id ORDER BY score DESC, track) AS top FROM z)
SELECT media_id, track, n, round(area, 6) AS area, round(size, 6) AS size, round(score, 6)::DOUBLE AS score, moving FROM b
QUALIFY least = 0 OR size >= greatest(least, 0.45 * top) OR NOT bool_or(size >= greatest(least, 0.45 * top)) OVER (PARTITION BY media_id)"""

_KEY = ", ".join(f"320 + 800 * e[{3 * i + 1}]::DOUBLE AS x{i}, 240 + 600 * e[{3 * i + 2}]::DOUBLE AS y{i}, least(1, 4 * abs(e[{3 * i + 3}]::DOUBLE)) AS c{i}" for i in (5, 6, 9, 10, 15, 16))
_MEAN = "(CASE WHEN c5 > 0.35 THEN {0}5 ELSE 0 END + CASE WHEN c6 > 0.35 THEN {0}6 ELSE 0 END) / nullif((c5 > 0.35)::INT + (c6 > 0.35)::INT, 0)"
_HAND = "CASE WHEN c10 > 0.35 AND (c9 <= 0.35 OR c10 >= c9) THEN {0}10 WHEN c9 > 0.35 THEN {0}9 END"
_SWING = f"""WITH k AS (SELECT vec_id % 4 AS media_id, vec_id // 8 AS frame, vec_id % 8 // 4 AS person, {_KEY} FROM (SELECT vec_id, embedding AS e FROM embeddings)),
a AS (SELECT media_id, frame, person, {_MEAN.format('x')} AS mx, {_MEAN.format('y')} AS my, {_HAND.format('x')} AS wx, {_HAND.format('y')} AS wy, greatest(CASE WHEN c15 > 0.35 THEN y15 END, CASE WHEN c16 > 0.35 THEN y16 END) AS foot FROM k),
v AS (SELECT *, coalesce(foot - my, 0.9 * my) AS body FROM a WHERE mx IS NOT NULL AND wx IS NOT NULL AND coalesce(foot - my, 0.9 * my) >= 9.6),
s AS (SELECT media_id, frame, arg_min(mx, person) AS sx, arg_min(my, person) AS sy, max(body) AS body, arg_max(wy, person) AS last FROM v GROUP BY 1, 2),
g AS (SELECT s.media_id, s.frame, arg_max(wx - sx, sqrt((wx - sx) ^ 2 + (wy - sy) ^ 2)) AS rx, arg_max(wy - sy, sqrt((wx - sx) ^ 2 + (wy - sy) ^ 2)) AS ry, any_value(s.body) AS body, any_value(last < sy) AS overhead FROM s JOIN v USING (media_id, frame) GROUP BY 1, 2),
n AS (SELECT media_id, max(frame) + 1 AS n FROM k GROUP BY 1),
w AS (SELECT g.*, n FROM g JOIN n USING (media_id) QUALIFY count(*) OVER (PARTITION BY media_id) >= greatest(4, 0.05 * n)),
f AS (SELECT media_id, unnest(range(n)) AS frame FROM (SELECT DISTINCT media_id, n FROM w)),
i AS (SELECT f.media_id, f.frame, w.frame IS NOT NULL AS ok, coalesce(w.overhead, false) AS overhead, max(w.frame) OVER (PARTITION BY f.media_id ORDER BY f.frame) AS lo, min(w.frame) OVER (PARTITION BY f.media_id ORDER BY f.frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM f LEFT JOIN w USING (media_id, frame)),
j AS (SELECT i.*, coalesce((i.frame - lo) / nullif(hi - lo, 0)::DOUBLE, 0) AS part, coalesce(l.rx, h.rx) AS x0, coalesce(h.rx, l.rx) AS x1, coalesce(l.ry, h.ry) AS y0, coalesce(h.ry, l.ry) AS y1, coalesce(l.body, h.body) AS b0, coalesce(h.body, l.body) AS b1
  FROM i LEFT JOIN w l ON l.media_id = i.media_id AND l.frame = lo LEFT JOIN w h ON h.media_id = i.media_id AND h.frame = hi),
o AS (SELECT *, x0 + (x1 - x0) * part AS x, y0 + (y1 - y0) * part AS y, b0 + (b1 - b0) * part AS body FROM j),
r AS (SELECT *, least(6, coalesce(sqrt((x - lag(x) OVER z) ^ 2 + (y - lag(y) OVER z) ^ 2), 0) * 12 / body) AS raw FROM o WINDOW z AS (PARTITION BY media_id ORDER BY frame)),
swings AS (SELECT media_id, frame, CASE WHEN ok THEN sum(raw) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 ELSE 0 END AS swing, ok, overhead FROM r)"""

_SIDES_SQL = _BOXES + """, ra AS (SELECT o_custkey % 4 AS media_id, o_orderkey AS rally_id, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey % 600) / 20.0::DOUBLE END AS t FROM orders),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY media_id, track, frame ORDER BY conf DESC, box_id) = 1),
r AS (SELECT media_id, track, avg(a) AS a, row_number() OVER (PARTITION BY media_id ORDER BY avg(a) DESC, track) AS nth FROM f WHERE track < 7 GROUP BY 1, 2),
two AS (SELECT a.media_id, a.track AS near, b.track AS far FROM r a JOIN r b ON a.media_id = b.media_id AND a.nth = 1 AND b.nth = 2 WHERE a.a > b.a * 1.05::DOUBLE),
n AS (SELECT media_id, max(frame) + 1 AS n FROM m GROUP BY 1),
sp AS (SELECT ra.*, greatest(0, round_even((t - 0.7::DOUBLE) * 2, 0))::BIGINT AS lo, round_even((t + 0.25::DOUBLE) * 2, 0)::BIGINT AS hi, n FROM ra JOIN n USING (media_id)),
st AS (SELECT sp.media_id, rally_id, f.track, near, sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2) AS step FROM sp JOIN two USING (media_id) JOIN f ON f.media_id = sp.media_id AND f.track IN (near, far) AND f.frame >= lo AND f.frame < least(n, greatest(lo + 1, hi)) WINDOW w AS (PARTITION BY sp.media_id, rally_id, f.track ORDER BY f.frame)),
mv AS (SELECT media_id, rally_id, coalesce(sum(step) FILTER (track = near), 0) AS a, coalesce(sum(step) FILTER (track <> near), 0) AS b FROM st GROUP BY 1, 2)
SELECT ra.media_id, rally_id, CASE WHEN greatest(a, b) >= 0.006 THEN CASE WHEN a >= b THEN 'near' ELSE 'far' END ELSE 'unknown' END AS server, CASE WHEN greatest(a, b) >= 0.006 THEN CASE WHEN a >= b THEN 'far' ELSE 'near' END ELSE 'unknown' END AS receiver FROM ra LEFT JOIN mv USING (media_id, rally_id)"""

_COURT_SQL = _BOXES + f""", mid AS (SELECT media_id, avg(x) AS cx, avg(y2) AS cy FROM m GROUP BY 1),
v AS (SELECT media_id, i, cx + px AS x, cy + py AS y FROM mid, (VALUES {", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(NOTCHED))}) t(i, px, py)),
e AS (SELECT a.media_id, a.i, a.x, a.y, (b.x - a.x) / sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2) AS dx, (b.y - a.y) / sqrt((b.x - a.x) ^ 2 + (b.y - a.y) ^ 2) AS dy FROM v a JOIN v b ON a.media_id = b.media_id AND b.i = (a.i + 1) % {len(NOTCHED)}),
l AS (SELECT media_id, i, x + 0.02::DOUBLE * dy AS x, y - 0.02::DOUBLE * dx AS y, dx, dy FROM e),
c AS (SELECT b.media_id, b.i, a.x + a.dx * ((b.x - a.x) * b.dy - (b.y - a.y) * b.dx) / (a.dx * b.dy - a.dy * b.dx) AS x, a.y + a.dy * ((b.x - a.x) * b.dy - (b.y - a.y) * b.dx) / (a.dx * b.dy - a.dy * b.dx) AS y FROM l a JOIN l b ON a.media_id = b.media_id AND b.i = (a.i + 1) % {len(NOTCHED)}),
s AS (SELECT a.media_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS ey FROM c a JOIN c b ON a.media_id = b.media_id AND b.i = (a.i + 1) % {len(NOTCHED)})
SELECT m.media_id, frame, box_id FROM m JOIN s ON s.media_id = m.media_id GROUP BY 1, 2, 3 HAVING count_if((ay > any_y) != (ey > any_y) AND any_x <= (bx - ax) * (any_y - ay) / nullif(ey - ay, 0) + ax) % 2 = 1""".replace("any_y", "y2").replace("any_x", "m.x")

_RING_SQL = """WITH h AS (SELECT user_id AS media_id, event_id, epoch_us(ts) AS us, value / 500::DOUBLE AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
b AS (SELECT *, coalesce(us - lag(us) OVER w > 259200000000, false)::INT AS begins FROM h WINDOW w AS (PARTITION BY media_id ORDER BY us, event_id)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY media_id ORDER BY us, event_id) AS run FROM b),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY media_id, run) AS n, quantile_cont(v, 0.85) OVER (w ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS high FROM r WINDOW w AS (PARTITION BY media_id, run ORDER BY us, event_id))
SELECT e.media_id, e.us, e.event_id, round(e.v - g.high, 6) AS excess FROM n e JOIN n g ON g.media_id = e.media_id AND g.run = e.run AND g.i = least(e.n, e.i + 15) WHERE e.n >= 31 AND e.i >= 16"""

_VIEWS_SQL = _BOXES + """, b AS (SELECT track AS media_id, frame, x, (y1 + y2) / 2 AS y, h FROM m),
c AS (SELECT c_custkey AS media_id, c_custkey % 3 > 0 AS ok, (c_custkey % 10) / 9.0::DOUBLE AS fore, (c_custkey % 7) / 6.0::DOUBLE AS area, CASE WHEN c_custkey % 5 = 0 THEN 'rear' END AS hint FROM customer WHERE c_custkey < 40),
w AS (SELECT *, 0.1::DOUBLE * x + 0.2::DOUBLE * y + 1 AS k FROM b),
p AS (SELECT *, (1.2 * x + 0.1 * y - 0.05) / k AS u, (0.05 * x + 0.9 * y + 0.02) / k AS v FROM w),
s AS (SELECT media_id, count(*) AS n, (quantile_cont(x, 0.92) - quantile_cont(x, 0.08)) * 1.78 AS sx, quantile_cont(y, 0.92) - quantile_cont(y, 0.08) AS sy, quantile_cont(h, 0.5) AS mh, count_if(abs(u) < 3 AND abs(v) < 3) AS good,
  quantile_cont(u, 0.92) FILTER (abs(u) < 3 AND abs(v) < 3) - quantile_cont(u, 0.08) FILTER (abs(u) < 3 AND abs(v) < 3) AS su, quantile_cont(v, 0.92) FILTER (abs(u) < 3 AND abs(v) < 3) - quantile_cont(v, 0.08) FILTER (abs(u) < 3 AND abs(v) < 3) AS sv FROM p GROUP BY 1),
t AS (SELECT media_id, frame, h, row_number() OVER (PARTITION BY media_id, frame ORDER BY h DESC) AS nth FROM b),
r AS (SELECT media_id, quantile_cont(a / z, 0.5) AS sr FROM (SELECT media_id, frame, max(h) AS a, min(h) AS z FROM t WHERE nth <= 2 GROUP BY 1, 2 HAVING count(*) = 2 AND min(h) > 1e-9) GROUP BY 1),
f AS (SELECT c.*, n, sx, sy, mh, CASE WHEN n IS NOT NULL THEN coalesce(sr, 1) END AS sr, sx / greatest(sy, 1e-3) AS hz, CASE WHEN ok AND good >= 8 THEN su / greatest(sv, 1e-3) ELSE 0 END AS uv FROM c LEFT JOIN s USING (media_id) LEFT JOIN r USING (media_id)),
g AS (SELECT *, CASE WHEN n IS NULL THEN (coalesce(hint, 'unknown'), CASE WHEN hint IS NULL THEN 0 ELSE 0.9 END::DOUBLE) WHEN n < 8 THEN ('unknown', 0::DOUBLE)
  WHEN NOT ok AND mh < 0.11 AND hz < 1.6 AND sr < 2 THEN ('elevated', 0.45::DOUBLE) WHEN NOT ok AND hz > 1.8 AND sr < 2.2 THEN ('side', 0.5::DOUBLE) WHEN NOT ok AND sr > 1.8 AND hz < 1.6 THEN ('rear', 0.55::DOUBLE) WHEN NOT ok THEN ('unknown', 0.3::DOUBLE)
  WHEN hint IS NOT NULL THEN (hint, 0.9::DOUBLE) WHEN mh < 0.11 AND fore > 0.8 AND area > 0.3 THEN ('overhead', least(0.9, 0.5 + 0.5 * area)::DOUBLE) WHEN mh < 0.11 THEN ('elevated', 0.6::DOUBLE)
  WHEN uv > 1.5 AND sr < 2.2 THEN ('side', least(0.9, 0.5 + 0.12 * least(uv - 1.5, 3))::DOUBLE) WHEN uv < 1 AND sr > 1.35 THEN ('rear', least(0.9, 0.5 + 0.15 * least(sr - 1.35, 3))::DOUBLE)
  WHEN hz > 1.8 AND sr < 2.2 THEN ('side', 0.5::DOUBLE) WHEN sr > 1.6 AND mh >= 0.16 THEN ('rear', 0.55::DOUBLE) WHEN mh >= 0.16 THEN ('rear', 0.4::DOUBLE) ELSE ('unknown', 0.3::DOUBLE) END AS z FROM f)
SELECT media_id, z[1] AS viewpoint, round(z[2], 6)::DOUBLE AS confidence, round(sx, 6)::DOUBLE AS spread_x, round(sy, 6)::DOUBLE AS spread_y, round(mh, 6)::DOUBLE AS median_height, round(sr, 6)::DOUBLE AS size_ratio FROM g"""

_NEXT_SQL = """WITH q AS (SELECT c_nationkey AS scope, o_custkey AS media_id, o_orderkey AS rally_id, epoch_us(o_orderdate) / 8.64e10 AS start, epoch_us(o_orderdate) / 8.64e10 + o_totalprice / 10000 AS end_ FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY media_id, start, rally_id) AS k FROM q),
s AS (SELECT media_id, min(start) AS first FROM q GROUP BY 1),
a AS (SELECT event_id AS position, c_nationkey AS scope, user_id AS media_id, first - 5 + (event_id % 5000) / 2.0::DOUBLE AS t FROM events JOIN customer ON c_custkey = user_id LEFT JOIN s ON s.media_id = user_id),
i AS (SELECT position, arg_min(n.end_, k) AS end_, min(k) AS k FROM a JOIN n ON n.media_id = a.media_id AND t BETWEEN n.start AND n.end_ GROUP BY 1),
l AS (SELECT position, min(k) AS k FROM a JOIN n ON n.scope = a.scope AND ((n.media_id = a.media_id AND n.start > t + 0.02::DOUBLE) OR (n.media_id > a.media_id AND t IS NOT NULL)) GROUP BY 1),
r AS (SELECT a.*, i.k IS NOT NULL AND t < i.end_ - 0.06::DOUBLE AS stay, coalesce(i.k + 1, l.k) AS k FROM a LEFT JOIN i USING (position) LEFT JOIN l USING (position))
SELECT position, CASE WHEN stay THEN 'stay' WHEN n.rally_id IS NOT NULL THEN 'go' ELSE 'end' END AS verdict, CASE WHEN NOT stay THEN n.media_id END AS next_media, CASE WHEN NOT stay THEN n.rally_id END AS next_id FROM r LEFT JOIN n ON n.scope = r.scope AND n.k = r.k"""

_SAMPLES_SQL = pe._SPANS + pe._channels_sql("end")[len(pe._MOTION):] + f""", lw AS (SELECT *, lag(value) OVER (PARTITION BY media_id ORDER BY idx) AS b, lead(value) OVER (PARTITION BY media_id ORDER BY idx) AS a FROM motion QUALIFY value < b AND value <= a AND value <= 0.5),
st AS (SELECT DISTINCT g.media_id, idx / {pe.FPS}::DOUBLE AS t FROM mg g JOIN lw ON lw.media_id = g.media_id AND idx / {pe.FPS}::DOUBLE >= g.first / {pe.FPS}::DOUBLE + 1 AND idx / {pe.FPS}::DOUBLE <= (g.last + 1) / {pe.FPS}::DOUBLE - 1),
al AS (SELECT media_id, (last + 1) / {pe.FPS}::DOUBLE AS t, true AS positive FROM mg UNION ALL SELECT media_id, t, false FROM st), tp AS (SELECT media_id, max(idx) AS top FROM motion GROUP BY 1)
SELECT al.media_id, round(t, 6) AS t, positive, {", ".join(f"round(ch.{c}, 6) AS {c}" for c in be.CHANNELS)} FROM al JOIN tp USING (media_id) JOIN ch ON ch.media_id = al.media_id AND ch.idx = least(top, round_even(t * {pe.FPS}, 0))"""

_NORM = "CASE WHEN p95_{0} - p5_{0} < 1e-9 THEN 0 ELSE least(1, greatest(0, ({0} - p5_{0}) / (p95_{0} - p5_{0}))) END"
_ENDS = "quantile_cont({0}, 0.05) OVER (PARTITION BY media_id) AS p5_{0}, quantile_cont({0}, 0.95) OVER (PARTITION BY media_id) AS p95_{0}"
_DENSITY_SQL = f"""WITH h AS (SELECT user_id AS media_id, epoch_us(ts) / 3.6e9 - min(epoch_us(ts) / 3.6e9) OVER (PARTITION BY user_id) AS t, (json_extract_string(props, '$.k')::DOUBLE / 99) ^ 2 AS w FROM events),
g AS (SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx, l_quantity AS value FROM lineitem),
top AS (SELECT media_id, max(idx) AS top FROM g GROUP BY 1),
b AS (SELECT media_id, least(top, greatest(0, round_even(t, 0)))::BIGINT AS idx, sum(w) AS w FROM h JOIN top USING (media_id) WHERE w > 0.02 GROUP BY 1, 2),
r AS (SELECT g.*, coalesce(w, 0) AS w, top FROM g JOIN top USING (media_id) LEFT JOIN b USING (media_id, idx)),
s AS (SELECT *, (sum(w) OVER (z ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 2 - idx) * first_value(w) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + greatest(0, 2 - (top - idx)) * last_value(w) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 5 AS sm FROM r WINDOW z AS (PARTITION BY media_id ORDER BY idx)),
e AS (SELECT *, {_ENDS.format('sm')}, {_ENDS.format('value')}, max(w) OVER (PARTITION BY media_id) > 0 AS heavy FROM s),
d AS (SELECT media_id, idx, heavy, {_NORM.format('sm')} AS density, {_NORM.format('value')} AS own FROM e),
a AS (SELECT *, own * CASE WHEN heavy THEN 0.4::DOUBLE + 0.6::DOUBLE * density ELSE 1 END AS act FROM d), k AS (SELECT *, {_ENDS.format('act')} FROM a)
SELECT media_id, idx, round(density, 6)::DOUBLE AS density, round({_NORM.format('act')}, 6)::DOUBLE AS activity FROM k"""

_TURNS_SQL = """WITH h AS (SELECT user_id AS media_id, event_id, epoch_us(ts) AS us, value / 500::DOUBLE AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
b AS (SELECT *, coalesce(us - lag(us) OVER w > 259200000000, false)::INT AS begins FROM h WINDOW w AS (PARTITION BY media_id ORDER BY us, event_id)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY media_id ORDER BY us, event_id) AS run, CASE WHEN v >= 0.4 THEN true WHEN v < 0.1 THEN false END AS says FROM b),
t AS (SELECT *, coalesce(last_value(says IGNORE NULLS) OVER (PARTITION BY media_id, run ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), false) AS turned FROM r)
SELECT media_id, us, turned FROM t QUALIFY turned <> coalesce(lag(turned) OVER (PARTITION BY media_id, run ORDER BY us, event_id), false)"""

ALL = {
    "ag_viewpoint": (_views, _VIEWS_SQL),
    "so_next_target": (_next, _NEXT_SQL),
    "sg_sample_rows": (_samples, _SAMPLES_SQL),
    "en_exp_density": (_density, _DENSITY_SQL),
    "jn_pip_margin": (_on_court, _COURT_SQL),
    "wn_activity_scan": (lambda s, d: rounded(_moved(s, d), "level"), _CELLS + """, a AS (SELECT media_id, idx, avg(value) AS value FROM d GROUP BY 1, 2)
SELECT a.media_id, a.idx, round(sum(b.value * CASE WHEN b.idx = 0 THEN 1 ELSE 0.015::DOUBLE END * pow(0.985::DOUBLE, a.idx - b.idx)), 6) AS level FROM a JOIN a b ON a.media_id = b.media_id AND b.idx <= a.idx GROUP BY 1, 2"""),
    "wn_activity_map": (lambda s, d: rounded(heat.activity_map(pictures(s, d)), "level"), _MAP + " SELECT media_id, cell_x, cell_y, round(level, 6) AS level FROM m"),
    "wn_activity_roi": (
        lambda s, d: rounded(heat.busy_box(heat.activity_map(pictures(s, d)).withColumn("level", F.pow("level", F.lit(8))), 8, 8), "x0", "y0", "x1", "y1"),
        _MAP + ", l AS (SELECT * REPLACE (level ^ 8 AS level) FROM m), o AS (SELECT *, level / (max(level) OVER w + 1e-9) > 0.35 AS hot, quantile_cont(level, 0.85) OVER w AS p FROM l WINDOW w AS (PARTITION BY media_id)), k AS (SELECT *, CASE WHEN count_if(hot) OVER (PARTITION BY media_id) < 1.28 THEN level > p ELSE hot END AS keep FROM o) SELECT media_id, round(greatest(0, min(cell_x) / 8 - 0.04), 6)::DOUBLE AS x0, round(greatest(0, min(cell_y) / 8 - 0.04), 6)::DOUBLE AS y0, round(least(1, (max(cell_x) + 1) / 8 + 0.04), 6)::DOUBLE AS x1, round(least(1, (max(cell_y) + 1) / 8 + 0.04), 6)::DOUBLE AS y1 FROM k WHERE keep GROUP BY 1",
    ),
    "wn_swing": (lambda s, d: rounded(_swings(s, d), "swing"), _SWING + " SELECT media_id, frame, round(swing, 6)::DOUBLE AS swing, ok, overhead FROM swings"),
    "ag_swing_quiet": (lambda s, d: rounded(pose.quiet(_swings(s, d)), "coverage", "quiet"), _SWING + " SELECT media_id, round(avg(ok::INT), 6) AS coverage, round(coalesce(quantile_cont(swing, 0.25) FILTER (swing > 0), 0), 6)::DOUBLE AS quiet FROM swings GROUP BY 1"),
    "so_active_scores": (lambda s, d: rounded(players.scored(fragments(s, d), SLOW).select("media_id", "track", "n", "area", "size", "score", "moving"), "area", "size", "score"), _ACTIVE_SQL),
    "so_active_topk": (lambda s, d: players.picked(players.scored(fragments(s, d), SLOW)), None),
    "sg_attr_sides": (_sides, _SIDES_SQL),
    "st_ring": (_ring, _RING_SQL),
    "st_turns": (lambda s, d: twins.turns(twins.with_time(tb.read(s, d, "events")), 0.1, 0.4, SILENCE), _TURNS_SQL),
}
