"""Queries over boundary evidence, hysteresis, verification and stored hits, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as sf
from tidemark.operators import events as ev
from tidemark.operators import evidence as be
from tidemark.operators import records as rc
from tidemark.operators import series as se
from tidemark.plans.labels import _WITH, rounded
from tidemark.sources import tables as tb

FPS, CAP = 4.0, 36.0
RANGES = {"motion_contrast": (0.0, 0.6), "motion_slope": (0.0, 0.8), "swing": (0.0, 1.0), "overhead": (0.0, 1.0)}
WEIGHTS = {"motion_contrast": 1.0, "motion_slope": 1.0, "swing": 0.5, "overhead": 0.5}
ENDS = {"hi": 0.55, "lo": 0.45}

_MOTION = _WITH + """, motion AS (SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx,
  l_quantity / 50 AS value, l_discount * 10 AS swing, l_tax * 12 AS overhead FROM lineitem)"""


def _motion(s, d):
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return tb.read(s, d, "lineitem").select(F.col("l_suppkey").alias("media_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), (F.col("l_quantity") / 50).alias("value"), (F.col("l_discount") * 10).alias("swing"), (F.col("l_tax") * 12).alias("overhead"))


def _channels_sql(side):
    rising = side == "start"
    n, k, look, w = be.samples(1.5, FPS), be.samples(be.SLOPE, FPS), be.samples(be.LOOK, FPS), be.samples(be.SWING, FPS)
    ahead = lambda c, m: f"coalesce(avg({c}) OVER (w ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING), 0)"
    behind = lambda c, m: f"coalesce(avg({c}) OVER (w ROWS BETWEEN {m} PRECEDING AND 1 PRECEDING), 0)"
    contrast = f"{ahead('value', n)} - {behind('value', n)}" if rising else f"{behind('value', n)} - {ahead('value', n)}"
    near = f"OVER (w ROWS BETWEEN {look} PRECEDING AND {look} FOLLOWING)"
    swings = f"OVER (w ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" if rising else f"OVER (w ROWS BETWEEN {1 - w % 2} PRECEDING AND {w - 2 + w % 2} FOLLOWING)"
    return f"""{_MOTION}, sm AS (SELECT *, sum(value) OVER (PARTITION BY media_id ORDER BY idx ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING) / {k} AS smooth FROM motion),
dd AS (SELECT *, coalesce((smooth - lag(smooth, {k}) OVER (PARTITION BY media_id ORDER BY idx)) / {k / FPS}::DOUBLE, 0) AS d FROM sm),
ch AS (SELECT media_id, idx, {contrast} AS motion_contrast, {f'max(d) {near}' if rising else f'-min(d) {near}'} AS motion_slope, greatest(0, max(swing) {swings} - 0.2::DOUBLE) AS swing, {ahead('overhead', w) if rising else behind('overhead', w)} AS overhead FROM dd WINDOW w AS (PARTITION BY media_id ORDER BY idx))"""


def _evidence(s, d):
    rows = _motion(s, d)
    out = [be.packed(be.side_channels(rows, side, FPS, 0.2), RANGES, WEIGHTS).withColumnRenamed("score", side) for side in ("start", "end")]
    return rounded(out[0].join(out[1], ["media_id", "idx"]), "start", "end")


def _evidence_sql():
    score = "(" + " + ".join(f"{w} * least(1, greatest(0, ({c} - {RANGES[c][0]}) / {RANGES[c][1] - RANGES[c][0]}::DOUBLE))" for c, w in WEIGHTS.items()) + f") / {sum(WEIGHTS.values())}::DOUBLE"
    start, end = _channels_sql("start"), _channels_sql("end")[len(_MOTION):]
    for name in ("sm", "dd", "ch"):
        end = end.replace(f"{name} AS (", f"{name}2 AS (").replace(f"FROM {name} ", f"FROM {name}2 ").replace(f"FROM {name})", f"FROM {name}2)")
    return f"{start}{end} SELECT a.media_id, a.idx, round(a.s, 6) AS start, round(b.s, 6) AS \"end\" FROM (SELECT media_id, idx, {score} AS s FROM ch) a JOIN (SELECT media_id, idx, {score} AS s FROM ch2) b USING (media_id, idx)"


def _span_intervals(s, d, motion=None):
    """Spans of the motion, which is read unless given, as intervals in seconds."""
    spans = be.active_spans((motion or _motion(s, d)).select("media_id", "idx", "value"), _ends(s, d), 2, 3, 4, 6)
    return spans.select("media_id", F.col("first").alias("rally_id"), (F.col("first") / FPS).alias("start"), ((F.col("last") + 1) / FPS).alias("end"))


def _ends(s, d):
    return tb.read(s, d, "supplier").select(F.col("s_suppkey").alias("media_id"), F.lit(ENDS["hi"]).alias("hi"), F.lit(ENDS["lo"]).alias("lo"))


_SPANS = f"""{_MOTION}, ms AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS n, CASE WHEN count(*) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AND min(value - {ENDS['hi']}::DOUBLE) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 0 THEN 1
  WHEN count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AND max(value - {ENDS['lo']}::DOUBLE) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) < 0 THEN 0 END AS says FROM motion WINDOW w AS (PARTITION BY media_id ORDER BY idx)),
mo AS (SELECT *, coalesce(last_value(says IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS is_on FROM ms),
mt AS (SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY media_id ORDER BY idx), 0) AS was FROM mo) WHERE is_on <> was),
ml AS (SELECT media_id, idx - 1 AS first, last FROM (SELECT *, coalesce(lead(idx) OVER (PARTITION BY media_id ORDER BY idx) - 2, n - 1) AS last FROM mt) WHERE is_on = 1),
mn AS (SELECT *, CASE WHEN first - lag(last) OVER (PARTITION BY media_id ORDER BY first) <= 4 THEN 0 ELSE 1 END AS new FROM ml),
mg AS (SELECT media_id, min(first) AS first, max(last) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY first ROWS UNBOUNDED PRECEDING) AS span FROM mn) GROUP BY media_id, span HAVING max(last) - min(first) >= 6)"""


def _verified_sql():
    return f"""{_SPANS}, iv AS (SELECT media_id, first AS rally_id, first / {FPS}::DOUBLE AS start, (last + 1) / {FPS}::DOUBLE AS end_ FROM mg),
cv AS (SELECT media_id, avg((swing > 0.85)::INT) AS cover FROM motion GROUP BY 1),
fd AS (SELECT iv.media_id, rally_id, avg((swing > 0.85)::INT) AS share, count_if(swing > 0.85) AS n, min(idx) FILTER (swing > 0.85) AS a, max(idx) FILTER (swing > 0.85) AS b FROM iv JOIN motion m ON m.media_id = iv.media_id AND idx BETWEEN floor(start * {FPS}) AND greatest(floor(start * {FPS}) + 1, floor(end_ * {FPS})) - 1 GROUP BY 1, 2),
vv AS (SELECT iv.media_id, iv.rally_id, start, end_, share, n, coalesce(cover BETWEEN 0.05 AND 0.9, false) AND share IS NOT NULL AS usable, a, b FROM iv LEFT JOIN cv USING (media_id) LEFT JOIN fd USING (media_id, rally_id)),
tt AS (SELECT media_id, rally_id, usable, share, CASE WHEN usable AND n >= 2 THEN greatest(start, a / {FPS}::DOUBLE - 0.5) ELSE start END AS start, CASE WHEN usable AND n >= 2 THEN least(end_, (b + 1) / {FPS}::DOUBLE + 0.4::DOUBLE) ELSE end_ END AS "end" FROM vv)
SELECT media_id, rally_id, round(start, 6) AS start, round("end", 6) AS "end" FROM tt WHERE NOT usable OR (share >= 0.02 AND "end" - start >= 1)"""


def _hit_points(s, d, side):
    hits = tb.hits(s, d)
    points = hits.where("hit_idx % 2 = 0").select("media_id", F.col("hit_idx").alias("idx"), "t")
    return rounded(be.hit_feature(points, hits.where("hit_idx % 2 = 1"), side, CAP).withColumnRenamed("idx", "hit_idx"), "hit")


def _hit_sql(side):
    near = "min(h.t) FILTER (h.t >= p.t - 0.05)" if side == "start" else "max(h.t) FILTER (h.t <= p.t + 0.05)"
    gap = "near - t" if side == "start" else "t - near"
    return _WITH + f", q AS (SELECT p.media_id, p.hit_idx, p.t, {near} AS near FROM hits p LEFT JOIN hits h ON h.media_id = p.media_id AND h.hit_idx % 2 = 1 WHERE p.hit_idx % 2 = 0 GROUP BY 1, 2, 3) SELECT media_id, hit_idx, round(coalesce(least(1, greatest(0, 1 - greatest(0, {gap}) / {CAP}::DOUBLE)), 0), 6)::DOUBLE AS hit FROM q"


def _stored(s, d):
    """Hits of media as arrays in the order of their ids; raw ones of every second medium, strengths missing in every third."""
    h = tb.hits(s, d)
    a = F.array_sort(F.collect_list(F.struct("hit_idx", "t", "strength", "confidence")))
    rows = h.groupBy("media_id").agg(a.alias("a"))
    odd, third = F.col("media_id") % 2 == 1, F.col("media_id") % 3 == 0
    gated = F.filter("a", lambda x: x["strength"] >= 0.2)
    return rows.select("media_id", gated["t"].alias("times"), F.when(~third, gated["strength"]).alias("strengths"), gated["confidence"].alias("confidences"), F.when(odd, F.col("a.t")).alias("raw_times"), F.when(~third, F.col("a.strength")).alias("raw_strengths"), F.when(~third, F.col("a.confidence")).alias("raw_confidences"))


def _regate(s, d):
    h = ev.local_percentile(tb.hits(s, d), 15.0).join(tb.hits(s, d).select("media_id", "hit_idx", F.col("confidence").alias("evidence")), ["media_id", "hit_idx"])
    m = F.col("media_id")
    media = h.select("media_id").distinct().select("media_id", (m % 11 != 0).alias("use_audio"), (m % 7 != 0).alias("use_pose"), (m % 5 != 0).alias("has_raw"), F.when(m % 13 != 0, m % 10 / 9.0).alias("coverage"), (m % 3 == 0).alias("force"))
    return be.regated(h, media, 0.5)


def _pauses(s, d):
    return be.pauses(_motion(s, d), _span_intervals(s, d), FPS, 1.0, F.col("value") <= 0.5, 8.0)


ALL = {
    "wn_side_channels": (
        lambda s, d: rounded(be.side_channels(_motion(s, d), "end", FPS, 0.2), *be.CHANNELS),
        _channels_sql("end") + " SELECT media_id, idx, " + ", ".join(f"round({c}, 6) AS {c}" for c in be.CHANNELS) + " FROM ch",
    ),
    "sg_evidence": (_evidence, _evidence_sql()),
    "sg_evidence_hits": (lambda s, d: _hit_points(s, d, "start"), _hit_sql("start")),
    "en_bevidence": (lambda s, d: _hit_points(s, d, "end"), _hit_sql("end")),
    "sg_hysteresis_runs": (
        lambda s, d: rounded(be.active_spans(_motion(s, d).select("media_id", "idx", "value"), _ends(s, d), 2, 3, 4, 6), "confidence"),
        f"{_SPANS} SELECT g.media_id, g.first, g.last, round(least(1, greatest(0.05, least(1.5, avg(value) / {ENDS['hi']}::DOUBLE) / 1.5)), 6)::DOUBLE AS confidence FROM mg g JOIN motion m ON m.media_id = g.media_id AND m.idx BETWEEN g.first AND g.last GROUP BY 1, 2, 3",
    ),
    "sg_verify": (
        lambda s, d: rounded(be.verified(_span_intervals(s, d), _motion(s, d).select("media_id", "idx", F.col("swing").alias("value")), FPS, 64, 1.0, 0.8, 1.0, 0.85), "start", "end"),
        _verified_sql(),
    ),
    "sg_samples": (
        lambda s, d: rounded(_pauses(s, d), "t"),
        f"{_SPANS}, lw AS (SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY media_id ORDER BY idx) AS b, lead(value) OVER (PARTITION BY media_id ORDER BY idx) AS a FROM motion) WHERE value < b AND value <= a AND value <= 0.5) SELECT g.media_id, g.first AS rally_id, round(idx / {FPS}::DOUBLE, 6) AS t FROM mg g JOIN lw ON lw.media_id = g.media_id AND idx / {FPS}::DOUBLE >= g.first / {FPS}::DOUBLE + 1 AND idx / {FPS}::DOUBLE <= (g.last + 1) / {FPS}::DOUBLE - 1",
    ),
    "en_rebuild": (
        lambda s, d: rounded(be.rebuilt_hits(_stored(s, d)), "t", "strength", "confidence"),
        _WITH + ", o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY hit_idx) - 1 AS nth FROM hits WHERE media_id % 2 = 1 OR strength >= 0.2) SELECT media_id, nth::INT AS nth, round(t, 6) AS t, round(CASE WHEN media_id % 3 = 0 THEN 1 ELSE strength END, 6)::DOUBLE AS strength, round(CASE WHEN media_id % 3 = 0 AND media_id % 2 = 1 THEN 0.5 ELSE confidence END, 6)::DOUBLE AS confidence, media_id % 2 = 1 AS raw FROM o",
    ),
    "gt_regate": (
        _regate,
        _WITH + """, lp AS (SELECT a.media_id, a.hit_idx, a.confidence AS evidence, CASE WHEN count(*) = 1 THEN 1 WHEN max(b.strength) - min(b.strength) < 1e-6 THEN 0 ELSE count_if(b.strength <= a.strength) / count(*) END AS pct FROM hits a JOIN hits b ON a.media_id = b.media_id AND abs(a.t - b.t) <= 15 GROUP BY 1, 2, 3),
rr AS (SELECT *, greatest(coalesce(evidence, 0), 0.6::DOUBLE * pct) >= 0.5 AS reaches FROM lp), sh AS (SELECT media_id, avg(reaches::INT) AS share FROM rr GROUP BY 1),
cd AS (SELECT media_id, CASE WHEN media_id % 11 = 0 THEN 'audio_off' WHEN media_id % 5 = 0 THEN 'no_raw' WHEN media_id % 7 = 0 THEN 'pose_off' WHEN media_id % 13 = 0 THEN 'no_pose' WHEN media_id % 3 <> 0 AND ((media_id % 10) / 9.0::DOUBLE < 0.35 OR share NOT BETWEEN 0.12 AND 0.97) THEN 'skipped' ELSE 'applied' END AS regate FROM sh)
SELECT media_id, hit_idx, regate FROM rr JOIN cd USING (media_id) WHERE regate <> 'audio_off' AND (regate <> 'applied' OR reaches)""",
    ),
    "so_cap": (
        lambda s, d: se.subsample(tb.signal(s, d), 7).select("media_id", "idx", "value"),
        _WITH + ", n AS (SELECT *, count(*) OVER (PARTITION BY media_id) AS n FROM signal), w AS (SELECT DISTINCT media_id, floor(k * (n - 1) / 6)::BIGINT AS idx FROM n, range(7) r(k) WHERE n > 7) SELECT media_id, idx, value FROM n WHERE n <= 7 OR (media_id, idx) IN (SELECT (media_id, idx) FROM w)",
    ),
    "crop_plan": (
        lambda s, d: tb.read(s, d, "part").select("p_partkey", sf.tempo_chain(F.col("p_size") / 4.0).alias("c")).select("p_partkey", F.size("c").alias("n"), F.round(F.element_at("c", -1), 6).alias("rest")),
        "WITH v AS (SELECT p_partkey, p_size / 4.0::DOUBLE AS v FROM part), k AS (SELECT p_partkey, v, greatest(0, ceil(abs(log2(v))) - 1)::INT AS k FROM v) SELECT p_partkey, k + 1 AS n, round(v / pow(CASE WHEN v > 1 THEN 2.0 ELSE 0.5 END, k), 6) AS rest FROM k",
    ),
    "flt_client": (
        lambda s, d: rc.filtered(tb.rallies(s, d).join(tb.read(s, d, "orders").select(F.col("o_orderkey").alias("rally_id"), F.lower(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus")).alias("haystack")), "rally_id"), least_duration=3.0, most_duration=30.0, least_shots=4, least_confidence=0.2, search="HIGH F").select("media_id", "rally_id"),
        _WITH + "SELECT o_custkey AS media_id, o_orderkey AS rally_id FROM orders WHERE o_totalprice / 10000 BETWEEN 3 AND 30 AND o_orderkey % 29 >= 4 AND ((o_orderkey * 3) % 97) / 96.0::DOUBLE >= 0.2 AND contains(lower(o_orderkey::VARCHAR || ' ' || o_orderpriority || ' ' || o_orderstatus), 'high f')",
    ),
    "flt_patch": (
        lambda s, d: rounded(rc.patched(tb.rallies(s, d).select("rally_id", "start", "end", F.lit(True).alias("keep")), F.col("rally_id") % 4 == 1, {"keep": False, "end": 9000.5, "media_id": 7}), "start", "end"),
        _WITH + "SELECT rally_id, round(start, 6) AS start, CASE WHEN rally_id % 4 = 1 THEN 9000.5 ELSE round(end_, 6) END::DOUBLE AS \"end\", rally_id % 4 <> 1 AS keep, rally_id % 4 = 1 AS updated FROM rallies",
    ),
}
