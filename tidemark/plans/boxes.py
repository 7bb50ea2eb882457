"""Queries over boxes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import boxes as bx
from tidemark.operators import kernels
from tidemark.sources import tables as tb

COURT = [(0.2, 0.1), (0.9, 0.2), (0.8, 0.9), (0.1, 0.7)]
MAP = [1.2, 0.1, -0.05, 0.05, 0.9, 0.02, 0.1, 0.2, 1.0]
FPS = 12.0

_WITH = """WITH u AS (SELECT vec_id, label, [least(1.3, greatest(-0.3, 0.5 + 1.5 * e::DOUBLE))::DOUBLE for e in embedding] AS e FROM embeddings),
boxes AS (SELECT vec_id % 4 AS media_id, vec_id // 32 AS frame, label::BIGINT AS track, vec_id AS box_id, least(e[1], e[2]) AS x1, least(e[3], e[4]) AS y1,
  greatest(e[1], e[2]) AS x2, greatest(e[3], e[4]) AS y2, least(1.0, greatest(0.0, e[5]))::DOUBLE AS conf FROM u),
m AS (SELECT *, abs(y2 - y1) AS h, abs((x2 - x1) * (y2 - y1)) AS a, max(abs(y2 - y1)) OVER (PARTITION BY media_id, frame) AS ref, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM boxes)
"""


def _b(f):
    return lambda s, d: f(tb.boxes(s, d))


def rounded(df, *columns, to=6):
    return df.select(*[F.round(c, to).alias(c) if c in columns else F.col(c) for c in df.columns])


_REASON = "CASE WHEN ref > 0.02 AND h < 0.5 * ref THEN 'short' WHEN ref > 0.02 AND h > 0.95 * ref THEN 'tall' WHEN a < 0.002 THEN 'small' WHEN a > 0.1 THEN 'large' END"
_BOUNDS = {"lo": 0.5, "hi": 0.95, "least_area": 0.002, "most_area": 0.1, "relative": True}
_CROSS = " + ".join(f"(CASE WHEN ({ay} > y2) != ({by} > y2) AND x < ({bx_} - {ax}) * (y2 - {ay}) / ({by} - {ay})::DOUBLE + {ax} THEN 1 ELSE 0 END)" for (ax, ay), (bx_, by) in zip(COURT, COURT[1:] + COURT[:1]))
_DENSE = "n AS (SELECT media_id, frame, count(*) AS active, avg(h) AS mh FROM m GROUP BY 1, 2), top AS (SELECT media_id, max(frame) AS top FROM m GROUP BY 1), g AS (SELECT media_id, unnest(range(top + 1)) AS frame FROM top), d AS (SELECT g.media_id, g.frame, coalesce(active, 0) AS active, coalesce(mh, 0) AS mh FROM g LEFT JOIN n ON n.media_id = g.media_id AND n.frame = g.frame)"

ALL = {
    "flt_sanitize": (
        _b(lambda b: rounded(bx.sanitized(b).select("box_id", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2")),
        _WITH + ", c AS (SELECT box_id, greatest(1e-9, x2 - x1) / greatest(1e-9, y2 - y1) AS ratio, least(1, greatest(0, x1)) AS x1, least(1, greatest(0, y1)) AS y1, least(1, greatest(0, x2)) AS x2, least(1, greatest(0, y2)) AS y2 FROM boxes) SELECT box_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM c WHERE x2 - x1 > 1e-6 AND y2 - y1 > 1e-6 AND y2 - y1 >= 0.02 AND ratio BETWEEN 0.12 AND 1.8 AND (x2 - x1) * (y2 - y1) <= 0.12",
    ),
    "flt_size": (_b(lambda b: bx.size_reason(b, **_BOUNDS).where("reason is null").select("media_id", "frame", "box_id")), _WITH + f"SELECT media_id, frame, box_id FROM m WHERE {_REASON} IS NULL"),
    "flt_size_client": (_b(lambda b: bx.size_reason(b, **_BOUNDS).groupBy("media_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))), _WITH + f"SELECT media_id, coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM m GROUP BY 1, 2"),
    "flt_size_frame": (
        _b(lambda b: bx.sized(b, **_BOUNDS).select("media_id", "frame", "box_id")),
        _WITH + f", r AS (SELECT *, {_REASON} AS reason FROM m), k AS (SELECT *, count_if(reason IS NULL) OVER (PARTITION BY media_id, frame) AS l FROM r) SELECT media_id, frame, box_id FROM k WHERE reason IS NULL OR l = 0",
    ),
    "flt_conf": (_b(lambda b: b.where("conf >= 0.10").select("media_id", "frame", "box_id")), _WITH + "SELECT media_id, frame, box_id FROM boxes WHERE conf >= 0.10"),
    "flt_visible": (_b(lambda b: b.where("conf is null or conf >= 0.5").select("media_id", "frame", "box_id")), _WITH + "SELECT media_id, frame, box_id FROM boxes WHERE conf IS NULL OR conf >= 0.5"),
    "flt_edge": (_b(lambda b: b.where(bx.touches_edge()).select("media_id", "frame", "box_id")), _WITH + "SELECT media_id, frame, box_id FROM boxes WHERE x1 <= 0.01 OR y1 <= 0.01 OR x2 >= 0.99 OR y2 >= 0.99"),
    "flt_overlay": (
        _b(lambda b: b.where(F.col("frame").between(int(0.2 * FPS), int(4.9 * FPS))).groupBy("media_id", "frame").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("box_id"))).cast("array<string>"), ",").alias("ids"))),
        _WITH + f"SELECT media_id, frame, count(*) AS n, string_agg(box_id::VARCHAR, ',' ORDER BY box_id) AS ids FROM boxes WHERE frame BETWEEN {int(0.2 * FPS)} AND {int(4.9 * FPS)} GROUP BY 1, 2",
    ),
    "jn_pip": (_b(lambda b: b.where(bx.in_polygon((F.col("x1") + F.col("x2")) / 2, F.col("y2"), COURT)).select("media_id", "frame", "box_id")), _WITH + f"SELECT media_id, frame, box_id FROM m WHERE ({_CROSS}) % 2 = 1"),
    "jn_homography": (
        _b(lambda b: rounded(b.select("box_id", *[p.alias(c) for p, c in zip(bx.projected((F.col("x1") + F.col("x2")) / 2, F.col("y2"), MAP), ("court_x", "court_y"))]), "court_x", "court_y")),
        _WITH + "SELECT box_id, round((1.2 * x + 0.1 * y2 - 0.05) / w, 6) AS court_x, round((0.05 * x + 0.9 * y2 + 0.02) / w, 6) AS court_y FROM (SELECT *, 0.1::DOUBLE * x + 0.2::DOUBLE * y2 + 1 AS w FROM m)",
    ),
    "ag_box_ref": (
        _b(lambda b: rounded(bx.reference_height(b), "ref", "least", "most")),
        _WITH + ", t AS (SELECT media_id, frame, max(h) AS h FROM m GROUP BY 1, 2), q AS (SELECT media_id, count(*) AS n, quantile_cont(h, 0.9) AS p FROM t GROUP BY 1) SELECT media_id, round(CASE WHEN n < 5 OR p < 0.06 THEN 0 ELSE p END, 6)::DOUBLE AS ref, round(CASE WHEN n < 5 OR p < 0.06 THEN 0 ELSE greatest(0.03, 0.42 * p) END, 6)::DOUBLE AS least, round(CASE WHEN n < 5 OR p < 0.06 THEN 1 ELSE least(1, 4 * p) END, 6)::DOUBLE AS most FROM q",
    ),
    "ag_size_hist": (_b(bx.height_histogram), _WITH + "SELECT media_id, least(floor(least(h, 0.5) / 0.5 * 24), 23)::INT AS bin, count(*) AS n, count_if(h > 0.5)::BIGINT AS over FROM m GROUP BY 1, 2"),
    "ag_match_format": (
        _b(lambda b: rounded(bx.match_format(b, 20, 5), "share3", "share4")),
        _WITH + ", p AS (SELECT media_id, frame, count(DISTINCT track) AS k FROM m GROUP BY 1, 2), s AS (SELECT media_id, count(*) AS present, avg((k >= 3)::INT) AS s3, avg((k >= 4)::INT) AS s4 FROM p GROUP BY 1) SELECT media_id, CASE WHEN present < 5 OR present / 20 < 0.30 THEN 'unknown' WHEN s4 >= 0.34 OR s3 >= 0.60 THEN 'doubles' WHEN s3 <= 0.15 THEN 'single' ELSE 'unknown' END AS format, round(s3, 6) AS share3, round(s4, 6) AS share4 FROM s",
    ),
    "ag_track": (
        _b(lambda b: rounded(bx.tracks(b, FPS), "mean_area", "max_area", "travel", "speed_p90", "static", "median_height")),
        _WITH + ", f AS (SELECT *, row_number() OVER (PARTITION BY media_id, track, frame ORDER BY conf DESC, box_id) AS rn FROM m), l AS (SELECT *, (frame - lag(frame) OVER w) / 12.0::DOUBLE AS dt, sqrt((x - lag(x) OVER w) ^ 2 + (y - lag(y) OVER w) ^ 2) AS step FROM f WHERE rn = 1 WINDOW w AS (PARTITION BY media_id, track ORDER BY frame)) SELECT media_id, track, count(*) AS frames, round(avg(a), 6) AS mean_area, round(max(a), 6) AS max_area, round(coalesce(sum(CASE WHEN dt <= 4 / 12.0::DOUBLE THEN step END), 0), 6) AS travel, round(quantile_cont(step / dt, 0.9), 6) AS speed_p90, round(avg((step / dt < 0.05)::INT), 6) AS static, round(quantile_cont(h, 0.5), 6) AS median_height FROM l GROUP BY 1, 2",
    ),
    "wn_speed": (
        _b(lambda b: rounded(bx.speeds(b, FPS, 1.78), "speed", "vx", "vy")),
        _WITH + """, f AS (SELECT *, row_number() OVER (PARTITION BY media_id, track, frame ORDER BY conf DESC, box_id) AS rn FROM m),
l AS (SELECT *, row_number() OVER w AS n, (x - lag(x) OVER w) / ((frame - lag(frame) OVER w) / 12.0::DOUBLE) AS sx, (y - lag(y) OVER w) / ((frame - lag(frame) OVER w) / 12.0::DOUBLE) AS sy FROM f WHERE rn = 1 WINDOW w AS (PARTITION BY media_id, track ORDER BY frame)),
e AS (SELECT *, sum(CASE WHEN sx IS NULL THEN 0 ELSE least(4, greatest(-4, sx)) END * pow(2, n - 1)) OVER w / pow(2, n) AS vx, sum(CASE WHEN sy IS NULL THEN 0 ELSE least(4, greatest(-4, sy)) END * pow(2, n - 1)) OVER w / pow(2, n) AS vy FROM l WINDOW w AS (PARTITION BY media_id, track ORDER BY frame ROWS UNBOUNDED PRECEDING))
SELECT media_id, frame, track, round(coalesce(sqrt((sx * 1.78::DOUBLE) ^ 2 + sy ^ 2), 0), 6)::DOUBLE AS speed, round(vx, 6)::DOUBLE AS vx, round(vy, 6)::DOUBLE AS vy FROM e""",
    ),
    "ag_frame": (_b(lambda b: rounded(bx.frame_counts(b), "mean_height")), _WITH + f", {_DENSE} SELECT media_id, frame, active, round(mh, 6)::DOUBLE AS mean_height FROM d"),
    "wn_coverage": (
        _b(lambda b: bx.coverage(b.where("box_id % 3 = 0"), 2)),
        _WITH + ", top AS (SELECT media_id, max(frame) AS top FROM m WHERE box_id % 3 = 0 GROUP BY 1), g AS (SELECT media_id, unnest(range(top + 1)) AS frame FROM top), d AS (SELECT g.*, EXISTS (SELECT 1 FROM m WHERE m.media_id = g.media_id AND m.frame = g.frame AND box_id % 3 = 0)::INT AS o FROM g), w AS (SELECT *, max(o) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM d) SELECT media_id, frame, CASE WHEN count(*) OVER z = 5 THEN min(v) OVER z ELSE 0 END AS covered FROM w WINDOW z AS (PARTITION BY media_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    ),
    "wn_box_motion": (
        _b(lambda b: rounded(bx.motion(b), "motion")),
        _WITH + ", t AS (SELECT media_id, track, frame, avg(x) AS x, avg(y) AS y FROM m GROUP BY 1, 2, 3), l AS (SELECT *, CASE WHEN frame - lag(frame) OVER w = 1 THEN least(0.25, sqrt(((x - lag(x) OVER w) * 1.78) ^ 2 + (y - lag(y) OVER w) ^ 2)) ELSE 0 END AS s FROM t WINDOW w AS (PARTITION BY media_id, track ORDER BY frame)) SELECT media_id, frame, round(max(s), 6)::DOUBLE AS motion FROM l GROUP BY 1, 2",
    ),
    "jn_nn_speed": (
        _b(lambda b: rounded(bx.nearest_steps(b, 0.3), "step")),
        _WITH + ", f AS (SELECT DISTINCT media_id, frame FROM m), l AS (SELECT *, lag(frame) OVER (PARTITION BY media_id ORDER BY frame) AS b FROM f), p AS (SELECT m.media_id, m.frame, m.box_id, min(sqrt((m.x - o.x) ^ 2 + (m.y - o.y) ^ 2)) AS d FROM m JOIN l ON m.media_id = l.media_id AND m.frame = l.frame JOIN m o ON o.media_id = m.media_id AND o.frame = l.b GROUP BY 1, 2, 3) SELECT media_id, frame, round(max(d), 6) AS step FROM p WHERE d <= 0.3 GROUP BY 1, 2",
    ),
    "wn_holes": (
        _b(lambda b: rounded(bx.holes(b.where("frame % 3 <> 1"), FPS), "x1", "y1", "x2", "y2", "conf")),
        _WITH + ", k AS (SELECT * FROM m WHERE frame % 3 != 1), f AS (SELECT *, row_number() OVER (PARTITION BY media_id, track, frame ORDER BY conf DESC, box_id DESC) AS rn FROM k), l AS (SELECT *, lead(frame) OVER w AS nx, lead(x1) OVER w AS a1, lead(y1) OVER w AS b1, lead(x2) OVER w AS a2, lead(y2) OVER w AS b2, lead(conf) OVER w AS cf FROM f WHERE rn = 1 WINDOW w AS (PARTITION BY media_id, track ORDER BY frame)), e AS (SELECT *, unnest(range(frame + 1, nx)) AS g FROM l WHERE nx - frame > 1 AND (nx - frame) / 12.0 <= 2) SELECT media_id, g AS frame, track, round(x1 + (a1 - x1) * (g - frame) / (nx - frame), 6) AS x1, round(y1 + (b1 - y1) * (g - frame) / (nx - frame), 6) AS y1, round(x2 + (a2 - x2) * (g - frame) / (nx - frame), 6) AS x2, round(y2 + (b2 - y2) * (g - frame) / (nx - frame), 6) AS y2, round((conf + cf) / 2, 6) AS conf FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.media_id = e.media_id AND k.frame = e.g)",
    ),
    "snk_boxes": (
        _b(lambda b: b.select("box_id", *[F.round(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 65535).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])),
        _WITH + "SELECT box_id, " + ", ".join(f"round(least(greatest({c}, 0), 1) * 65535)::INT AS {c}" for c in ("x1", "y1", "x2", "y2")) + " FROM boxes",
    ),
    "src_npz_boxes": (
        _b(lambda b: b.withColumn("j", F.round(F.col("frame") / 12.0 * 5.0).cast("long")).where("j between 0 and 99").groupBy("media_id", "j").agg(F.count("*").alias("n"))),
        _WITH + "SELECT media_id, round(frame / 12.0::DOUBLE * 5.0::DOUBLE)::BIGINT AS j, count(*) AS n FROM boxes WHERE round(frame / 12.0::DOUBLE * 5.0::DOUBLE) BETWEEN 0 AND 99 GROUP BY 1, 2",
    ),
    "jn_dup_boxes": (_b(lambda b: kernels.without_duplicates(b).select("media_id", "frame", "box_id")), None),
    "jn_track_assoc": (_b(lambda b: kernels.associated(b, 0.1)), None),
}
