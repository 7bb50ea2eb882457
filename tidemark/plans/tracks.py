"""Queries over points and boxes of moving things, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import tracks as tr
from tidemark.plans.labels import rounded
from tidemark.sources import tables as tb

HEIGHT, SLOW = 400.0, 2.0
_FIT = {"least": 4, "max_resid": 0.5, "speeds_in": (0.02, 5.0), "min_span": 0.04, "accel_in": (0.0005, 12.0)}


def points(s, d):
    """Hits as points: their strength and confidence say where."""
    h = tb.hits(s, d)
    return h.select("media_id", F.floor(F.col("t") * 4).alias("frame"), F.col("hit_idx").alias("point"), (F.col("strength") * 500).alias("x"), (F.col("confidence") * HEIGHT).alias("y"), F.col("confidence").alias("score"))


def _days(s, d):
    """Two days of hits are a track."""
    return points(s, d).withColumn("track", F.floor(F.col("frame") / 192))


def fragments(s, d):
    """Boxes in place of those of tracks that break off now and then and shake around a place of their own; each third track shows what the one before it shows."""
    b = tb.read(s, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("e"), F.col("embedding")[1].cast("double").alias("g"))
    b = b.select(F.pmod("vec_id", F.lit(4)).alias("media_id"), F.floor(F.col("vec_id") / 8).alias("frame"), "label", F.col("vec_id").alias("box_id"), "e", "g")
    spot = F.pmod(F.col("label"), F.lit(3))
    x, y, w = 0.2 + 0.25 * spot + 0.04 * F.col("e"), 0.5 + 0.03 * F.col("g"), 0.05 + 0.02 * F.abs(F.col("e"))
    return b.select("media_id", "frame", (F.col("label") * 1000 + F.floor(F.col("frame") / 9)).alias("track"), "box_id", (x - w).alias("x1"), (y - 2 * w).alias("y1"), (x + w).alias("x2"), (y + 2 * w).alias("y2"), F.abs(F.col("g")).alias("conf"))


_FIT_SQL = """WITH hits AS (
  SELECT user_id AS media_id, event_id AS point, epoch_us(ts) / 3.6e9 AS h, value / 500 AS strength, json_extract_string(props, '$.k')::DOUBLE / 99 AS confidence FROM events),
p AS (SELECT media_id, floor(h * 4)::BIGINT AS frame, point, strength * 500 AS x, confidence * 400 AS y, confidence AS score FROM hits),
a AS (SELECT *, frame // 192 AS track, frame / 2.0::DOUBLE AS t FROM p),
b AS (SELECT *, count(*) OVER w AS n, t - avg(t) OVER w AS u FROM a WINDOW w AS (PARTITION BY media_id, track)),
k AS (SELECT media_id, track FROM b GROUP BY 1, 2 HAVING count(*) >= 4 AND count(DISTINCT frame) >= CASE WHEN count(*) >= 5 THEN 3 ELSE 2 END),
s AS (SELECT b.*, avg(x) OVER w AS mx, avg(y) OVER w AS my, sum(u ^ 2) OVER w AS s2, sum(u ^ 3) OVER w AS s3, sum(u ^ 4) OVER w AS s4, sum(x * u) OVER w AS x1, sum(x * u ^ 2) OVER w AS x2, sum(y * u) OVER w AS y1, sum(y * u ^ 2) OVER w AS y2
  FROM b JOIN k USING (media_id, track) WINDOW w AS (PARTITION BY media_id, track)),
c AS (SELECT *, CASE WHEN n >= 5 THEN (x2 - mx * s2 - s3 / s2 * x1) / (s4 - s2 ^ 2 / n - s3 ^ 2 / s2) ELSE 0 END AS cx, CASE WHEN n >= 5 THEN (y2 - my * s2 - s3 / s2 * y1) / (s4 - s2 ^ 2 / n - s3 ^ 2 / s2) ELSE 0 END AS cy FROM s),
o AS (SELECT *, (x - (mx - cx * s2 / n + (x1 - cx * s3) / s2 * u + cx * u ^ 2)) ^ 2 + (y - (my - cy * s2 / n + (y1 - cy * s3) / s2 * u + cy * u ^ 2)) ^ 2 AS off,
  sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2) / greatest(t - lag(t) OVER w, 1e-6) / 400 AS speed FROM c WINDOW w AS (PARTITION BY media_id, track ORDER BY frame, point)),
g AS (SELECT media_id, track, count(*) AS n, min(t) AS start, max(t) AS end_, sqrt(avg(off)) / 400 AS resid, coalesce(avg(speed), 0) AS mean_speed, coalesce(max(speed), 0) AS max_speed,
  sqrt((arg_max(x, (frame, point)) - arg_min(x, (frame, point))) ^ 2 + (arg_max(y, (frame, point)) - arg_min(y, (frame, point))) ^ 2) / 400 AS span, sqrt((2 * any_value(cx)) ^ 2 + (2 * any_value(cy)) ^ 2) / 400 AS accel, avg(score) AS sure, avg((speed <= 5)::INT) AS slow FROM o GROUP BY 1, 2)
SELECT media_id, track, n, start, end_ AS "end", round(resid, 6) AS resid, round(mean_speed, 6) AS mean_speed, round(max_speed, 6) AS max_speed, round(span, 6) AS span, round(accel, 6) AS accel,
  round(least(1, greatest(0, 0.28 * sure + 0.22 * least(1, n / 8.0) + 0.28 * greatest(0, 1 - resid / 0.5) + 0.12 * coalesce(slow, 0) + 0.10 * least(1, accel / 0.001))), 6)::DOUBLE AS confidence
FROM g WHERE resid <= 0.5 AND mean_speed BETWEEN 0.02 AND 7.5 AND span >= 0.04 AND accel BETWEEN 0.0005 AND 12"""

_JUNCTION_SQL = """WITH e AS (SELECT vec_id % 4 AS media_id, vec_id // 8 AS frame, label, vec_id AS box_id, embedding[1]::DOUBLE AS e, embedding[2]::DOUBLE AS g FROM embeddings),
q AS (SELECT *, 0.2::DOUBLE + 0.25::DOUBLE * (label % 3) + 0.04::DOUBLE * e AS x, 0.5::DOUBLE + 0.03::DOUBLE * g AS y, 0.05::DOUBLE + 0.02::DOUBLE * abs(e) AS w FROM e),
m AS (SELECT media_id, frame, label * 1000 + frame // 9 AS track, box_id, x - w AS x1, y - 2 * w AS y1, x + w AS x2, y + 2 * w AS y2, abs(g) AS conf FROM q),
f AS (SELECT media_id, track, frame, frame / 2.0::DOUBLE AS t, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS area, x1 > 0.01 AND y1 > 0.01 AND x2 < 0.99 AND y2 < 0.99 AS whole, x1, y1, x2, y2
  FROM m QUALIFY row_number() OVER (PARTITION BY media_id, track, frame ORDER BY conf DESC, box_id) = 1),
l AS (SELECT *, row_number() OVER w AS nth, (x - lag(x) OVER w) / (t - lag(t) OVER w) AS sx, (y - lag(y) OVER w) / (t - lag(t) OVER w) AS sy FROM f WINDOW w AS (PARTITION BY media_id, track ORDER BY frame)),
v AS (SELECT media_id, track, sum(CASE WHEN sx IS NULL THEN 0 ELSE least(4, greatest(-4, sx)) END * pow(2, nth - 1)) / pow(2, max(nth)) AS vx, sum(CASE WHEN sy IS NULL THEN 0 ELSE least(4, greatest(-4, sy)) END * pow(2, nth - 1)) / pow(2, max(nth)) AS vy FROM l GROUP BY 1, 2),
z AS (SELECT media_id, track, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_max(x, t) AS lx, arg_max(y, t) AS ly, min(x1) AS bx1, min(y1) AS by1, max(x2) AS bx2, max(y2) AS by2 FROM f GROUP BY 1, 2),
h AS (SELECT z.*, vx, vy, arg_min(struct_pack(t := f.t, x := f.x, y := f.y, area := f.area), f.t) FILTER (whole AND f.t - t0 <= 0.75) AS head, arg_max(struct_pack(t := f.t, x := f.x, y := f.y, area := f.area), f.t) FILTER (whole AND t1 - f.t <= 0.75) AS tail
  FROM z JOIN v USING (media_id, track) JOIN f USING (media_id, track) GROUP BY ALL),
pr AS (SELECT a.media_id, a.track, b.track AS other, a AS a, b AS b FROM h a JOIN h b ON a.media_id = b.media_id AND a.track <> b.track AND (a.t0, -a.n, a.track) < (b.t0, -b.n, b.track)
  AND b.bx1 - a.bx2 <= 0.3 AND a.bx1 - b.bx2 <= 0.3 AND b.by1 - a.by2 <= 0.3 AND a.by1 - b.by2 <= 0.3),
gap AS (SELECT media_id, track, other, 'gap' AS kind FROM pr WHERE a.t1 < b.t0 AND b.t0 - a.t1 <= 5 AND a.tail IS NOT NULL AND b.head IS NOT NULL
  AND sqrt(((a.lx + a.vx * greatest(0, b.head.t - a.t1) - b.head.x) * 1.78) ^ 2 + (a.ly + a.vy * greatest(0, b.head.t - a.t1) - b.head.y) ^ 2) <= 0.1
  AND least(a.tail.area, b.head.area) > 1e-9 AND greatest(a.tail.area, b.head.area) <= 3.5 * least(a.tail.area, b.head.area)),
ov AS (SELECT media_id, track, other, CASE WHEN a.n <= b.n THEN track ELSE other END AS short, CASE WHEN a.n <= b.n THEN other ELSE track END AS long, greatest(a.t0, b.t0) AS o0, least(a.t1, b.t1) AS o1 FROM pr WHERE a.t1 >= b.t0),
ob AS (SELECT ov.*, s.t, s.x, s.y, s.area FROM ov JOIN f s ON s.media_id = ov.media_id AND s.track = ov.short AND s.t BETWEEN o0 AND o1),
nb AS (SELECT ob.media_id, ob.track, ob.other, ob.t, arg_min(sqrt(((ob.x - g.x) * 1.78) ^ 2 + (ob.y - g.y) ^ 2) <= 0.1 AND greatest(ob.area, g.area) <= 3.5 * least(ob.area, g.area), (abs(ob.t - g.t), g.t)) FILTER (abs(ob.t - g.t) <= 0.2) AS same
  FROM ob JOIN f g ON g.media_id = ob.media_id AND g.track = ob.long GROUP BY 1, 2, 3, 4)
SELECT * FROM gap UNION ALL SELECT media_id, track, other, 'overlap' FROM nb GROUP BY 1, 2, 3 HAVING avg(coalesce(same, false)::INT) >= 0.5"""

ALL = {
    "sg_fit_track": (lambda s, d: rounded(tr.fitted(_days(s, d), SLOW, HEIGHT, **_FIT), "resid", "mean_speed", "max_speed", "span", "accel", "confidence"), _FIT_SQL),
    "jn_shuttle_assoc": (lambda s, d: tr.linked(points(s, d), 4.0, HEIGHT, 3, 40, 0.05), None),
    "jn_track_junctions": (lambda s, d: tr.junctions(fragments(s, d), SLOW), _JUNCTION_SQL),
    "jn_track_merge": (lambda s, d: tr.merged(fragments(s, d), SLOW), None),
}
