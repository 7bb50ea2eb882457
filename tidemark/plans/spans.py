"""Queries over spans of time and frames, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators import spans as sp
from tidemark.plans.boxes import COURT
from tidemark.plans.boxes import _WITH as _BOXES
from tidemark.plans.labels import _WITH as _LABELS
from tidemark.plans.labels import rounded
from tidemark.sources import tables as tb

MARGIN, GAP, LIMIT, STRONG = 0.04, 24.0, 30.0, 0.9


def _edges():
    area = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(COURT, COURT[1:] + COURT[:1]))
    for (ax, ay), (bx, by) in zip(COURT, COURT[1:] + COURT[:1]):
        yield f"{'' if area > 0 else '-'}(({bx - ax}::DOUBLE) * (y2 - {ay}::DOUBLE) - ({by - ay}::DOUBLE) * (x - {ax}::DOUBLE)) / {((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5}::DOUBLE >= -{MARGIN}"


def _film(s, d):
    """Clips of every third rally, moved and shortened."""
    rows = tb.rallies(s, d).where("rally_id % 3 = 0")
    return rows.select("media_id", F.col("rally_id").alias("clip_id"), (F.col("start") + F.pmod("rally_id", F.lit(5))).alias("src_in"), (F.col("end") + F.pmod("rally_id", F.lit(3)) - 1).alias("src_out")).where("src_out > src_in")


def _signal(f):
    return lambda s, d: f(tb.signal(s, d))


def _hits(f):
    return lambda s, d: f(tb.hits(s, d))


def _intervals(hits):
    """Clusters of hits, cut a little at the start and drawn out at the end."""
    c = ev.clusters(hits, GAP)
    return c.select("media_id", F.col("cluster").cast("long").alias("rally_id"), (F.col("start") + 0.5).alias("start"), (F.col("end") + 6.0).alias("end"))


def _tracks(b):
    return b.groupBy("media_id", "track").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.avg("conf").alias("confidence"))


def _params(p):
    base = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), F.col("p_retailprice"))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("size"), F.lit(7.0), F.lit("unknown"), F.lit(1.0))).otherwise(F.create_map(F.lit("price"), F.lit(None).cast("double")))
    return p.select("p_partkey", sp.with_overrides(base, raw).alias("m")).select("p_partkey", F.col("m")["size"].alias("size"), F.col("m")["price"].alias("price"), F.size("m").alias("n"))


def _fit(p):
    numbers = F.create_map(F.lit("f1"), F.col("p_retailprice") / 7, F.lit("recall"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") / 7.0), F.lit("other"), F.lit(1.0))
    return p.select("p_partkey", sp.fit_document(numbers, ["f1", "precision", "recall"]).alias("m")).select("p_partkey", F.col("m")["f1"].alias("f1"), F.col("m")["recall"].alias("recall"), F.size("m").alias("n"))


def _patches(r):
    side = F.element_at(F.array(F.lit("start"), F.lit("end"), F.lit("no")), (F.col("rally_id") % 3 + 1).cast("int"))
    snap = F.col("start") + (F.col("end") - F.col("start")) * (F.col("rally_id") % 5) / 4.0
    p = r.select("rally_id", sp.snap_patch(F.col("start"), F.col("end"), side, snap).alias("p"))
    return rounded(p.select("rally_id", "p.start", "p.end"), "start", "end", to=9)


def _anchors(s, d, **how):
    hits = tb.hits(s, d)
    strong = sp.strong_or_all(hits, STRONG) if how.get("strong") else hits
    out = sp.anchored(_intervals(hits), strong, LIMIT, 48.0, clamped=not how.get("strong"), trim_start=not how.get("strong"))
    return rounded(out, "start", "end", "tail_gap", "serve", "receive")


def _anchor_sql(hits: str, clamped: bool, trim: bool) -> str:
    lo, hi = ("greatest(start - 1.0, before)", "least(end_ + 1.2, after)") if clamped else ("start - 1.0", "end_ + 1.2")
    return f""", cl AS (SELECT media_id, cluster AS rally_id, min(t) + 0.5::DOUBLE AS start, max(t) + 6.0::DOUBLE AS end_ FROM (SELECT *, sum(CASE WHEN gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t, hit_idx) AS gap FROM hits)) GROUP BY 1, 2 HAVING count(*) >= 2),
nb AS (SELECT *, lag(end_) OVER w AS before, lead(start) OVER w AS after FROM cl WINDOW w AS (PARTITION BY media_id ORDER BY start, rally_id)),
ln AS (SELECT *, {lo}::DOUBLE AS lo0, {hi}::DOUBLE AS hi0 FROM nb), lm AS (SELECT *, CASE WHEN hi0 < lo0 THEN (start + end_) / 2 ELSE lo0 END AS lo, CASE WHEN hi0 < lo0 THEN (start + end_) / 2 ELSE hi0 END AS hi FROM ln),
hh AS (SELECT * FROM hits WHERE {hits}), nx AS (SELECT media_id, t, lead(t) OVER (PARTITION BY media_id ORDER BY t) AS next FROM (SELECT DISTINCT media_id, t FROM hh)),
j AS (SELECT lm.*, hh.hit_idx, hh.t, nx.next, row_number() OVER (PARTITION BY lm.media_id, lm.rally_id ORDER BY hh.t, hh.hit_idx) AS nth FROM lm JOIN hh ON lm.media_id = hh.media_id AND hh.t BETWEEN lm.lo AND lm.hi JOIN nx ON nx.media_id = hh.media_id AND nx.t = hh.t),
ag AS (SELECT media_id, rally_id, count(*) AS n, min(t) AS first, max(t) FILTER (t <= end_) AS last, max(t) FILTER (nth = 2) AS receive FROM j GROUP BY 1, 2),
z AS (SELECT lm.media_id, lm.rally_id, lm.start, lm.end_, n, first, receive, coalesce(last, first) AS last FROM lm LEFT JOIN ag USING (media_id, rally_id)),
y AS (SELECT z.*, coalesce(nx.next - z.last, 'inf'::DOUBLE) AS gap FROM z LEFT JOIN nx ON nx.media_id = z.media_id AND nx.t = z.last),
o AS (SELECT media_id, rally_id, CASE WHEN n IS NULL THEN greatest(0, start - 1.0) ELSE {"greatest(0, first - 1.0)" if trim else "least(start, greatest(0, first - 1.0))"} END::DOUBLE AS start,
  CASE WHEN n IS NULL THEN end_ + 1.6 ELSE greatest(CASE WHEN gap > {LIMIT} THEN least(end_, last + 0.9) ELSE greatest(end_, last + 0.9) END, last + 0.05) END::DOUBLE AS "end", coalesce(n, 0) AS n, CASE WHEN n IS NOT NULL THEN least(gap, 999) END::DOUBLE AS tail_gap, first AS serve, receive FROM y)
SELECT media_id, rally_id::BIGINT AS rally_id, round(start, 6) AS start, round("end", 6) AS "end", n, round(tail_gap, 6) AS tail_gap, round(serve, 6) AS serve, round(receive, 6) AS receive FROM o WHERE "end" > start"""


_FILM = "film AS (SELECT media_id, rally_id AS clip_id, start + rally_id % 5 AS src_in, end_ + rally_id % 3 - 1 AS src_out FROM rallies WHERE rally_id % 3 = 0 AND end_ + rally_id % 3 - 1 > start + rally_id % 5), ov AS (SELECT r.media_id, rally_id, clip_id, start, end_, least(src_out, end_) - greatest(src_in, start) AS overlap FROM rallies r JOIN film f ON r.media_id = f.media_id AND least(src_out, end_) > greatest(src_in, start))"
_AREA = "abs((x2 - x1) * (y2 - y1))"

ALL = {
    "en_exp_merge": (
        lambda s, d: rounded(sp.over_short_gaps(_intervals(tb.hits(s, d)), tb.hits(s, d).where("strength >= 0.5"), 36.0, 12.0, 6.5), "start", "end"),
        _LABELS + """, cl AS (SELECT media_id, cluster AS rally_id, min(t) + 0.5::DOUBLE AS start, max(t) + 6.0::DOUBLE AS end_ FROM (SELECT *, sum(CASE WHEN gap > 24.0 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t, hit_idx) AS gap FROM hits)) GROUP BY 1, 2 HAVING count(*) >= 2),
lg AS (SELECT *, lag(end_) OVER (PARTITION BY media_id ORDER BY start, rally_id) AS before FROM cl), st AS (SELECT media_id, t FROM hits WHERE strength >= 0.5),
fl AS (SELECT *, CASE WHEN start - before > 0 AND start - before <= 36 AND EXISTS (SELECT 1 FROM st WHERE st.media_id = lg.media_id AND t >= before - 12 AND t <= before + 6.5) AND EXISTS (SELECT 1 FROM st WHERE st.media_id = lg.media_id AND t >= start - 6.5 AND t <= start + 12) THEN 0 ELSE 1 END AS fresh FROM lg),
il AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY start, rally_id ROWS UNBOUNDED PRECEDING) AS island FROM fl)
SELECT media_id, arg_min(rally_id, (start, rally_id))::BIGINT AS rally_id, round(min(start), 6) AS start, round(arg_max(end_, (start, rally_id)), 6) AS "end", count(*) AS n FROM il GROUP BY media_id, island""",
    ),
    "flt_roi": (
        lambda s, d: tb.boxes(s, d).where(sp.near_polygon((F.col("x1") + F.col("x2")) / 2, F.col("y2"), COURT, MARGIN)).select("media_id", "frame", "box_id"),
        _BOXES + f"SELECT media_id, frame, box_id FROM m WHERE {' AND '.join(_edges())}",
    ),
    "flt_param_merge": (lambda s, d: _params(tb.read(s, d, "part")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 7.0 ELSE p_size END::DOUBLE AS size, p_retailprice AS price, 2 AS n FROM part"),
    "en_fit_doc": (lambda s, d: _fit(tb.read(s, d, "part")), "SELECT p_partkey, round(p_retailprice / 7, 4) AS f1, CASE WHEN p_partkey % 3 > 0 THEN round(p_size / 7.0::DOUBLE, 4) END AS recall, CASE WHEN p_partkey % 3 > 0 THEN 2 ELSE 1 END AS n FROM part"),
    "jn_remap_clips": (
        lambda s, d: sp.remapped(_film(s, d), tb.rallies(s, d), 10.0),
        _LABELS + f", {_FILM}, b AS (SELECT media_id, clip_id, arg_max(rally_id, (overlap, -rally_id)) AS rally_id, max(overlap) AS m FROM ov GROUP BY 1, 2) SELECT f.media_id, f.clip_id, CASE WHEN m > 0.05 THEN b.rally_id END AS rally_id FROM film f LEFT JOIN b USING (media_id, clip_id)",
    ),
    "jn_coverage": (
        lambda s, d: rounded(sp.film_coverage(_film(s, d), tb.rallies(s, d), 10.0), "ratio"),
        _LABELS + f", {_FILM}, b AS (SELECT media_id, rally_id, sum(overlap) AS o, arg_max(clip_id, (overlap, -clip_id)) AS best FROM ov GROUP BY 1, 2), q AS (SELECT r.media_id, r.rally_id, least(1, coalesce(o, 0) / greatest(0.05, end_ - start))::DOUBLE AS ratio, best FROM rallies r LEFT JOIN b USING (media_id, rally_id)) SELECT media_id, rally_id, round(ratio, 6) AS ratio, ratio >= 0.75 AS covered, best FROM q",
    ),
    "jn_nearest_frame": (
        _hits(lambda h: rounded(sp.nearest_frame(h.where("hit_idx % 3 > 0"), h.where("hit_idx % 3 = 0").select("media_id", F.col("t").alias("u")), 12.0), "frame_t", "age")),
        _LABELS + ", q AS (SELECT h.media_id, h.hit_idx, arg_min(f.t, (abs(f.t - h.t), f.t)) AS frame_t, min(abs(f.t - h.t)) AS age FROM hits h LEFT JOIN hits f ON f.media_id = h.media_id AND f.hit_idx % 3 = 0 WHERE h.hit_idx % 3 > 0 GROUP BY 1, 2) SELECT media_id, hit_idx, CASE WHEN age <= 12 THEN round(frame_t, 6) END AS frame_t, CASE WHEN age <= 12 THEN round(age, 6) END AS age FROM q",
    ),
    "so_scope": (
        lambda s, d: tb.rallies(s, d).join(tb.read(s, d, "customer").select(F.col("c_custkey").alias("media_id"), F.col("c_nationkey").alias("scope"), "c_acctbal"), "media_id").where("c_acctbal >= 0").select("scope", "rally_id", F.row_number().over(W.partitionBy("scope").orderBy("media_id", "start", "rally_id")).alias("nth")),
        _LABELS + "SELECT c_nationkey AS scope, rally_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY media_id, start, rally_id)::INT AS nth FROM rallies JOIN customer ON c_custkey = media_id WHERE c_acctbal >= 0",
    ),
    "so_top_results": (
        lambda s, d: tb.rallies(s, d).orderBy(F.desc("speed"), F.desc("confidence"), F.desc("shots"), "rally_id").limit(40).select("rally_id", "speed", "confidence"),
        _LABELS + "SELECT rally_id, speed, confidence FROM rallies ORDER BY speed DESC, confidence DESC, (rally_id % 29) DESC, rally_id LIMIT 40",
    ),
    "so_longest_clump": (
        _signal(lambda x: sp.longest_run(x.withColumn("on", (F.col("value") >= 20).cast("int")), "on")),
        _LABELS + ", i AS (SELECT media_id, idx, idx - row_number() OVER (PARTITION BY media_id ORDER BY idx) AS island FROM signal WHERE value >= 20), r AS (SELECT media_id, min(idx) AS first, max(idx) AS last, count(*) AS n FROM i GROUP BY media_id, island) SELECT media_id, first, last, n FROM r QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY n DESC, first) = 1",
    ),
    "so_windowed_topk": (
        lambda s, d: sp.windowed_picks(tb.boxes(s, d).withColumn("area", F.round(F.abs((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))), 9)), 4, 2, 2, 6),
        _BOXES + f", e AS (SELECT media_id, track, frame, round({_AREA}, 9) AS area, unnest(range(greatest(0, floor((frame - 4) / 2) + 1)::BIGINT, frame // 2 + 1)) AS win FROM m), t AS (SELECT media_id, win, track, sum(area) AS area FROM e GROUP BY 1, 2, 3), p AS (SELECT DISTINCT media_id, track FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY media_id, win ORDER BY area DESC, track) <= 2)), l AS (SELECT media_id, track, count(*) AS n FROM m JOIN p USING (media_id, track) GROUP BY 1, 2) SELECT media_id, track FROM l QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY n DESC, track) <= 6",
    ),
    "wn_dir_max": (
        _signal(lambda x: sp.directed_max(sp.directed_max(x, 5, True, "ahead"), 4, False, "behind").select("media_id", "idx", "ahead", "behind")),
        _LABELS + "SELECT media_id, idx, max(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ahead, max(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS behind FROM signal WINDOW w AS (PARTITION BY media_id ORDER BY idx)",
    ),
    "wn_med_mad": (
        _signal(lambda x: rounded(sp.adaptive_threshold(x, 7, 4.4), "threshold")),
        _LABELS + ", a AS (SELECT *, median(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS med, count(*) OVER (PARTITION BY media_id) AS n FROM signal WINDOW w AS (PARTITION BY media_id ORDER BY idx)), b AS (SELECT *, median(abs(value - med)) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS mad FROM a WINDOW w AS (PARTITION BY media_id ORDER BY idx)) SELECT media_id, idx, round(med + 4.4::DOUBLE * (mad * 1.4826::DOUBLE + 1e-6), 6) AS threshold FROM b WHERE idx BETWEEN 6 AND n - 7",
    ),
    "wn_cumlen": (
        lambda s, d: rounded(sp.arc_length(tb.boxes(s, d).select("media_id", "track", "frame", "box_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")), ["media_id", "track"], ["frame", "box_id"]).select("box_id", "length"), "length"),
        _BOXES + ", st AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step FROM m WINDOW w AS (PARTITION BY media_id, track ORDER BY frame, box_id)) SELECT box_id, round(sum(step) OVER (PARTITION BY media_id, track ORDER BY frame, box_id ROWS UNBOUNDED PRECEDING), 6) AS length FROM st",
    ),
    "wn_density": (
        _hits(lambda h: rounded(sp.dense_density(h, 24.0, 3, 0.15), "value")),
        _LABELS + ", gd AS (SELECT *, max((confidence >= 0.15)::INT) OVER (PARTITION BY media_id) AS good FROM hits), c AS (SELECT media_id, floor(t / 24)::BIGINT AS slot, count(*) AS n FROM gd WHERE confidence >= 0.15 OR good = 0 OR good IS NULL GROUP BY 1, 2), sp AS (SELECT media_id, min(slot) AS lo, max(slot) AS hi FROM c GROUP BY 1), gr AS (SELECT media_id, lo, hi - lo AS top, unnest(range(lo, hi + 1)) AS slot FROM sp), de AS (SELECT gr.media_id, slot - lo AS idx, top, coalesce(n, 0)::DOUBLE AS v FROM gr LEFT JOIN c USING (media_id, slot)), sm AS (SELECT media_id, idx, (sum(v) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + CASE WHEN idx = 0 THEN v ELSE 0 END + CASE WHEN idx = top THEN v ELSE 0 END) / 3 AS v FROM de WINDOW w AS (PARTITION BY media_id ORDER BY idx)), q AS (SELECT media_id, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM sm GROUP BY 1) SELECT media_id, idx, round(CASE WHEN b - a < 1e-9 THEN 0 ELSE least(1, greatest(0, (v - a) / (b - a))) END, 6)::DOUBLE AS value FROM sm JOIN q USING (media_id)",
    ),
    "sg_in_flight": (
        lambda s, d: rounded(sp.in_flight(_tracks(tb.boxes(s, d))), "flight"),
        _BOXES + ", tr AS (SELECT media_id, track, min(frame) AS first, max(frame) AS last, avg(conf) AS c FROM m GROUP BY 1, 2), e AS (SELECT media_id, unnest(range(first, last + 1)) AS frame, c FROM tr) SELECT media_id, frame, round(max(c), 6) AS flight FROM e GROUP BY 1, 2",
    ),
    "sg_seg2iv": (
        lambda s, d: rounded(sp.from_segments(tb.rallies(s, d).withColumn("score", F.col("speed"))), "start", "end", "confidence"),
        _LABELS + ', f AS (SELECT *, CASE WHEN start - lag(end_) OVER w < 0.3 THEN 0 ELSE 1 END AS new FROM rallies WINDOW w AS (PARTITION BY media_id ORDER BY start, end_ DESC, rally_id)), k AS (SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY start, end_ DESC, rally_id ROWS UNBOUNDED PRECEDING) AS grp FROM f) SELECT media_id, grp::BIGINT AS "group", round(min(start), 6) AS start, round(max(end_), 6) AS "end", count(*) AS n, round(least(1, greatest(0.05, 0.25 + 0.75 * max(speed))), 6)::DOUBLE AS confidence FROM k GROUP BY media_id, grp',
    ),
    "sg_build": (
        _hits(lambda h: sp.shots(h, GAP)),
        _LABELS + f", gp AS (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t, hit_idx) AS gap FROM hits), c AS (SELECT *, sum(CASE WHEN gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING) AS cluster FROM gp), n AS (SELECT *, row_number() OVER (PARTITION BY media_id, cluster ORDER BY t, hit_idx) AS nth FROM c) SELECT media_id, cluster::BIGINT AS cluster, hit_idx, round(t, 3) AS time, CASE nth WHEN 1 THEN 'serve' WHEN 2 THEN 'receive' ELSE 'unknown' END AS kind FROM n",
    ),
    "sg_anchor": (lambda s, d: _anchors(s, d), _LABELS + _anchor_sql("true", True, True)),
    "en_exp_two_tier": (lambda s, d: _anchors(s, d, strong=True), _LABELS + _anchor_sql(f"strength >= {STRONG} OR media_id NOT IN (SELECT media_id FROM hits WHERE strength >= {STRONG} GROUP BY 1 HAVING count(*) >= 2)", False, False)),
    "ag_hist_1d": (
        lambda s, d: rounded(sp.histogram_steps(tb.boxes(s, d), "conf", 8), "step"),
        _BOXES + ", n AS (SELECT media_id, frame, least(7, floor(conf * 8))::INT AS bin, count(*) AS k FROM m GROUP BY 1, 2, 3), p AS (SELECT media_id, frame, bin, k / sum(k) OVER (PARTITION BY media_id, frame) AS share FROM n), fr AS (SELECT media_id, frame, lag(frame) OVER (PARTITION BY media_id ORDER BY frame) AS prev FROM (SELECT DISTINCT media_id, frame FROM m)), bins AS (SELECT unnest(range(8))::INT AS bin) SELECT fr.media_id, fr.frame, round(sum(abs(coalesce(a.share, 0) - coalesce(b.share, 0))) / 2, 6) AS step FROM fr CROSS JOIN bins LEFT JOIN p a ON a.media_id = fr.media_id AND a.frame = fr.frame AND a.bin = bins.bin LEFT JOIN p b ON b.media_id = fr.media_id AND b.frame = fr.prev AND b.bin = bins.bin WHERE prev IS NOT NULL GROUP BY 1, 2",
    ),
    "opt_snap_patch": (
        lambda s, d: _patches(tb.rallies(s, d)),
        _LABELS + ", q AS (SELECT rally_id, start, end_, rally_id % 3 AS side, start + (end_ - start) * (rally_id % 5) / 4.0::DOUBLE AS snap FROM rallies) SELECT rally_id, CASE WHEN side = 0 AND snap < end_ - 0.5 THEN round(snap, 9) END AS start, CASE WHEN side = 1 AND snap > start + 0.5 THEN round(snap, 9) END AS \"end\" FROM q",
    ),
}
