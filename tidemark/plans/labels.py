"""Queries over labelled intervals, and over the order-dependent kernels, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators import intervals as iv
from tidemark.operators import kernels
from tidemark.operators import labels as lb
from tidemark.operators import series as se
from tidemark.sources import tables as tb

_WITH = """WITH hits AS (
  SELECT user_id AS media_id, event_id AS hit_idx, epoch_us(ts) / 3.6e9 AS t, value / 500 AS strength,
         json_extract_string(props, '$.k')::DOUBLE / 99 AS confidence FROM events),
signal AS (
  SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx, l_quantity AS value FROM lineitem),
rallies AS (
  SELECT o_custkey AS media_id, o_orderkey AS rally_id, epoch_us(o_orderdate) / 8.64e10 AS start, o_totalprice / 10000 AS duration,
         epoch_us(o_orderdate) / 8.64e10 + o_totalprice / 10000 AS end_, o_orderstatus AS status, o_orderpriority AS note,
         ((o_orderkey * 7) % 101) / 100.0::DOUBLE AS speed, ((o_orderkey * 3) % 97) / 96.0::DOUBLE AS confidence FROM orders),
pairs AS (SELECT a.media_id, a.rally_id, b.rally_id AS other_id, a.start, a.end_, b.start AS s, b.end_ AS e, (least(a.end_, b.end_) - greatest(a.start, b.start)) / (greatest(a.end_, b.end_) - least(a.start, b.start)) AS iou
  FROM rallies a JOIN rallies b ON a.media_id = b.media_id AND a.rally_id % 2 = 0 AND b.rally_id % 2 = 1 AND least(a.end_, b.end_) > greatest(a.start, b.start)),
err AS (SELECT media_id, rally_id, other_id, unnest(['start', 'end']) AS side, unnest([start - s, end_ - e]) AS error FROM pairs WHERE iou >= 0.1),
g AS (SELECT *, end_ - start AS d, lead(start) OVER (PARTITION BY media_id ORDER BY start, rally_id) - end_ AS gap, lag(end_) OVER (PARTITION BY media_id ORDER BY start, rally_id) AS before FROM rallies)
"""


def rounded(df, *columns, to=6):
    return df.select(*[F.round(c, to).alias(c) if c in columns else F.col(c) for c in df.columns])


def _r(f):
    return lambda s, d: f(tb.rallies(s, d))


def _rh(f):
    return lambda s, d: f(tb.rallies(s, d), tb.hits(s, d))


def _h(f):
    return lambda s, d: f(tb.hits(s, d))


def _s(f):
    return lambda s, d: f(tb.signal(s, d))


def halves(r):
    return r.where("rally_id % 2 = 0"), r.where("rally_id % 2 = 1")


def pairs(r, least=0.1):
    return iv.overlaps(*halves(r), 10.0).where(F.col("iou") >= least)


def _dirty(r):
    """Orders with intervals that begin before 0 or end before they start."""
    shift = F.when(F.pmod("rally_id", F.lit(7)) == 0, -F.col("duration") * 2).otherwise(F.col("duration"))
    return r.withColumn("start", F.col("start") - 9500).withColumn("end", F.col("start") + shift)


def _bands(r):
    sizes = r.agg(F.count_if(F.expr("rally_id % 2 = 0")).alias("preds"), F.count_if(F.expr("rally_id % 2 = 1")).alias("golds"))
    errors = lb.boundary_errors(pairs(r)).crossJoin(F.broadcast(sizes))  # the one row of an aggregate
    return rounded(lb.band_scores(errors, [0.5, 1.0, 2.0]), "rate", "f1")


def _classes(r):
    preds, golds = halves(r)
    best = iv.best_overlap(preds, golds, 10.0).select("media_id", "rally_id", "other_id")
    return lb.error_classes(preds, golds, pairs(r, 0.05), best)


def _loco(r):
    clip, variant = F.pmod("media_id", F.lit(5)).alias("clip"), F.pmod("rally_id", F.lit(3)).alias("variant")
    return lb.left_one_out(r.groupBy(clip, variant).agg(F.avg("speed").alias("score")))


def _valleys(h):
    return h.select("media_id", (F.col("t") / 24).alias("u"), (1 - F.col("strength")).alias("depth"))


def _grid_search(s, d):
    """(gap, least_hits, precision, recall, f1): clusters under each of 12 parameter rows against the purchases' hours."""
    params = s.createDataFrame([(float(g), n) for g in (3, 6, 12, 24) for n in (2, 3, 4)], "limit double, least int")
    rows = ev.gaps(tb.hits(s, d)).crossJoin(F.broadcast(params))  # 12 rows
    key = ["limit", "least", "media_id"]
    new = F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)
    rows = rows.withColumn("cluster", F.sum(new).over(W.partitionBy(*key).orderBy("t", "hit_idx").rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy(*key, "cluster")))
    hit, gold = F.col("n") >= F.col("least"), F.pmod("hit_idx", F.lit(5)) == 0
    out = rows.groupBy("limit", "least").agg(F.count_if(hit & gold).alias("tp"), F.count_if(hit & ~gold).alias("fp"), F.count_if(~hit & gold).alias("fn"))
    p, r, f1 = iv.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select(F.col("limit").alias("gap"), "least", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def _prf(labels):
    count = lambda e: F.count_if(F.expr(e))
    out = labels.agg(count("quality = 1 and toxic = 0").alias("tp"), count("toxic = 0 and quality <> 1").alias("fp"), count("toxic <> 0 and quality = 1").alias("fn"))
    p, r, _ = iv.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return out.select("tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"))


_CLEAN = "q AS (SELECT media_id, rally_id, greatest(0, start - 9500) AS s, (start - 9500) + CASE WHEN rally_id % 7 = 0 THEN -2 * duration ELSE duration END AS e FROM rallies)"
_CLUSTERS = "ga AS (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t, hit_idx) AS gap FROM hits)"

def _audited(f):
    """Labels, valleys, hits and activity of media that share the last digits of their ids, on one scale of time."""

    def query(s, d):
        media = F.pmod("media_id", F.lit(100)).alias("media_id")
        r = tb.rallies(s, d).select(media, "rally_id", (F.col("start") - 9000).alias("start"), (F.col("end") - 9000).alias("end"))
        marks = tb.hits(s, d).select(media, "hit_idx", F.pmod(F.col("t") / 24 * 100, F.lit(2000.0)).alias("u"), (1 - F.col("strength")).alias("depth"))
        return f(r, lb.audit(r, marks.where("hit_idx % 3 = 0"), marks.where("hit_idx % 3 = 1"), tb.signal(s, d).withColumn("media_id", F.pmod("media_id", F.lit(100))), 0.25, contrast=8.0))

    return query


_AUDIT = _WITH + """, r AS (SELECT media_id % 100 AS media_id, rally_id, start - 9000 AS start, end_ - 9000 AS end_ FROM rallies WHERE end_ > start),
mk AS (SELECT media_id % 100 AS media_id, hit_idx, (t / 24 * 100) % 2000 AS u, 1 - strength AS depth FROM hits), va AS (SELECT * FROM mk WHERE hit_idx % 3 = 0), hi AS (SELECT * FROM mk WHERE hit_idx % 3 = 1),
ac AS (SELECT media_id % 100 AS media_id, idx, value FROM signal), wd AS (SELECT media_id, greatest(quantile_cont(value, 0.95) - quantile_cont(value, 0.2), 1e-9) AS width FROM ac GROUP BY 1),
bb AS (SELECT *, end_ - start AS d, lag(end_) OVER w AS before, lead(start) OVER w AS after FROM r WINDOW w AS (PARTITION BY media_id ORDER BY start, rally_id)),
md AS (SELECT media_id, count(*) AS n, quantile_cont(d, 0.5) AS mid FROM bb GROUP BY 1), ma AS (SELECT media_id, n, mid, quantile_cont(abs(d - mid), 0.5) AS mad FROM bb JOIN md USING (media_id) GROUP BY 1, 2, 3),
ed AS (SELECT media_id, rally_id, before, after, unnest(['start', 'end']) AS side, unnest([start, end_]) AS at_, unnest([start - before, after - end_]) AS gap FROM bb),
rd AS (SELECT e.media_id, rally_id, side, part, avg(value) AS m FROM (SELECT media_id, rally_id, side, unnest(['pre', 'post']) AS part, unnest([round_even((at_ - 8) * 0.25, 0), round_even(at_ * 0.25, 0)])::BIGINT AS lo, unnest([round_even(at_ * 0.25, 0), round_even((at_ + 8) * 0.25, 0)])::BIGINT AS hi FROM ed) e
  JOIN ac ON ac.media_id = e.media_id AND idx >= lo AND idx < hi GROUP BY 1, 2, 3, 4),
tn AS (SELECT a.media_id, a.rally_id, a.side, CASE a.side WHEN 'start' THEN b.m - a.m ELSE a.m - b.m END / width AS rise FROM rd a JOIN rd b ON a.media_id = b.media_id AND a.rally_id = b.rally_id AND a.side = b.side AND a.part = 'pre' AND b.part = 'post' JOIN wd ON wd.media_id = a.media_id),
vd AS (SELECT ed.media_id, rally_id, side, min(abs(u - at_)) AS valley FROM ed JOIN va ON va.media_id = ed.media_id AND CASE side WHEN 'start' THEN u <= at_ AND (before IS NULL OR u > before) ELSE u >= at_ AND (after IS NULL OR u < after) END GROUP BY 1, 2, 3),
hd AS (SELECT ed.media_id, rally_id, side, min(abs(u - at_)) AS hit FROM ed JOIN hi ON hi.media_id = ed.media_id GROUP BY 1, 2, 3),
nr AS (SELECT ed.*, valley, hit FROM ed LEFT JOIN vd USING (media_id, rally_id, side) LEFT JOIN hd USING (media_id, rally_id, side)),
sn AS (SELECT nr.media_id, rally_id, side, u FROM nr JOIN va ON va.media_id = nr.media_id AND abs(u - at_) <= 3 AND CASE side WHEN 'start' THEN u <= at_ AND (before IS NULL OR u > before) ELSE u >= at_ AND (after IS NULL OR u < after) END WHERE valley > 2
  QUALIFY row_number() OVER (PARTITION BY nr.media_id, rally_id, side ORDER BY depth DESC, abs(u - at_), u DESC) = 1),
notes AS (SELECT media_id, rally_id, 'overlap' AS code, 'warn' AS severity, side, round(-gap, 3) AS distance, NULL::DOUBLE AS snap, NULL::DOUBLE AS nearest_hit FROM ed WHERE gap < -1e-9
  UNION ALL SELECT media_id, rally_id, 'too_close', 'info', side, round(gap, 3), NULL, NULL FROM ed WHERE gap >= 0 AND gap < 0.5
  UNION ALL SELECT bb.media_id, rally_id, 'duration_outlier', 'warn', NULL, round(0.6745::DOUBLE * abs(d - mid) / mad, 3), NULL, NULL FROM bb JOIN ma USING (media_id) WHERE n >= 5 AND mad > 1e-9 AND 0.6745::DOUBLE * abs(d - mid) / mad > 3.5
  UNION ALL SELECT media_id, rally_id, 'evidence_contradiction', 'warn', side, round(rise, 3), NULL, NULL FROM tn WHERE rise < -0.1
  UNION ALL SELECT nr.media_id, nr.rally_id, 'boundary_off_quiet', 'warn', nr.side, round(valley, 3), round(u, 3), round(hit, 3) FROM nr LEFT JOIN sn ON sn.media_id = nr.media_id AND sn.rally_id = nr.rally_id AND sn.side = nr.side WHERE valley > 2
  UNION ALL SELECT media_id, rally_id, 'boundary_no_hit', 'info', side, round(hit, 3), NULL, NULL FROM nr WHERE valley IS NULL AND hit > 2.5)
"""

ALL = {
    "flt_normalize_labels": (
        _r(lambda r: lb.normalized(_dirty(r)).select("media_id", "rally_id", "start", "end")),
        _WITH + f", {_CLEAN} SELECT media_id, rally_id, round(s, 3)::DOUBLE AS start, round(e, 3) AS \"end\" FROM q WHERE e > s",
    ),
    "flt_in_window": (_r(lambda r: r.where(lb.in_window(9800, 9900)).select("media_id", "rally_id")), _WITH + "SELECT media_id, rally_id FROM rallies WHERE end_ > 9800 AND start < 9900"),
    "flt_labels_usable": (
        _h(lambda h: h.join(h.groupBy("media_id").agg(F.max("confidence").alias("m")).where("m >= 0.99").select("media_id"), "media_id", "left_semi").select("media_id", "hit_idx")),
        _WITH + "SELECT media_id, hit_idx FROM hits WHERE media_id IN (SELECT media_id FROM hits GROUP BY 1 HAVING max(confidence) >= 0.99)",
    ),
    "flt_hit_keep": (
        _h(lambda h: h.join(h.groupBy("media_id").agg(F.percentile("strength", F.lit(0.35)).alias("p35")), "media_id").where("strength >= p35 and confidence >= 0.15").select("media_id", "hit_idx")),
        _WITH + ", q AS (SELECT media_id, quantile_cont(strength, 0.35) AS p FROM hits GROUP BY 1) SELECT media_id, hit_idx FROM hits JOIN q USING (media_id) WHERE strength >= p AND confidence >= 0.15",
    ),
    "ag_suggest": (
        _r(lambda r: rounded(lb.suggestions(r), "shortest", "median", "longest", "least_gap", "median_gap", to=2)),
        _WITH + "SELECT media_id, count(*) AS n, round(min(d), 2) AS shortest, round(quantile_cont(d, 0.5), 2) AS median, round(max(d), 2) AS longest, round(min(gap) FILTER (gap > 0), 2) AS least_gap, round(quantile_cont(gap, 0.5) FILTER (gap > 0), 2) AS median_gap FROM g GROUP BY 1",
    ),
    "ag_dyn_grid": (
        _r(lambda r: lb.grid(r, [1.0, 2.5, 4.0], 0.5, 30.0).select("media_id", F.explode("grid").alias("value"))),
        _WITH + ", q AS (SELECT media_id, count(*) AS n, count_if(gap > 0) AS k, quantile_cont(d, 0.1) AS a, quantile_cont(gap, 0.25) FILTER (gap > 0) AS b FROM g GROUP BY 1), v AS (SELECT media_id, unnest([1.0, 2.5, 4.0, CASE WHEN n >= 3 THEN least(30, greatest(0.5, round_even(a, 1))) END, CASE WHEN k >= 3 THEN least(30, greatest(0.5, round_even(b, 1))) END]) AS value FROM q) SELECT DISTINCT media_id, value::DOUBLE AS value FROM v WHERE value IS NOT NULL",
    ),
    "ag_err_quant": (
        _r(lambda r: rounded(lb.error_quantiles(lb.boundary_errors(pairs(r))), "mean", "median", "p90", "signed")),
        _WITH + "SELECT side, count(*) AS n, round(avg(abs(error)), 6) AS mean, round(quantile_cont(abs(error), 0.5), 6) AS median, round(quantile_cont(abs(error), 0.9), 6) AS p90, round(quantile_cont(error, 0.5), 6) AS signed FROM err GROUP BY 1",
    ),
    "ag_boundary": (
        _r(_bands),
        _WITH + ", z AS (SELECT count_if(rally_id % 2 = 0) AS p, count_if(rally_id % 2 = 1) AS l FROM rallies), b AS (SELECT side, band, count(*) AS n, count_if(abs(error) <= band) AS tp FROM err, (VALUES (0.5), (1.0), (2.0)) v(band) GROUP BY 1, 2) SELECT side, band::DOUBLE AS band, round(tp / n, 6) AS rate, round(coalesce(2 * tp / nullif(p + l, 0), 0), 6)::DOUBLE AS f1 FROM b, z",
    ),
    "jn_error_class": (
        _r(_classes),
        _WITH + ", best AS (SELECT * FROM (SELECT *, (least(end_, e) - greatest(start, s)) AS o, row_number() OVER (PARTITION BY media_id, rally_id ORDER BY least(end_, e) - greatest(start, s) DESC, other_id) AS rn FROM pairs) WHERE rn = 1 AND o >= 0.5 * greatest(0.1, end_ - start)), ov AS (SELECT * FROM pairs WHERE iou >= 0.05), c AS (SELECT r.media_id, count(o.iou) AS k, true AS gold, r.rally_id FROM rallies r LEFT JOIN ov o ON o.media_id = r.media_id AND o.other_id = r.rally_id WHERE r.rally_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.media_id = r.media_id AND b.other_id = r.rally_id) GROUP BY r.media_id, r.rally_id UNION ALL SELECT r.media_id, count(o.iou), false, r.rally_id FROM rallies r LEFT JOIN ov o ON o.media_id = r.media_id AND o.rally_id = r.rally_id WHERE r.rally_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.media_id = r.media_id AND b.rally_id = r.rally_id) GROUP BY r.media_id, r.rally_id) SELECT media_id, CASE WHEN gold THEN CASE WHEN k >= 2 THEN 'over_split' WHEN k = 1 THEN 'shifted' ELSE 'missed' END ELSE CASE WHEN k >= 2 THEN 'under_split' ELSE 'spurious' END END AS class, count(*) AS n FROM c WHERE gold OR k <> 1 GROUP BY 1, 2",
    ),
    "opt_quality": (_audited(lambda r, notes: notes), _AUDIT + "SELECT * FROM notes"),
    "ag_label_sev": (
        _audited(lb.severities),
        _AUDIT + ", w AS (SELECT media_id, rally_id, max(severity) AS severity FROM notes GROUP BY 1, 2) SELECT coalesce(severity, 'ok') AS severity, count(*) AS n FROM r LEFT JOIN w USING (media_id, rally_id) GROUP BY 1",
    ),
    "jn_snap": (
        lambda s, d: rounded(lb.snapped(tb.rallies(s, d).withColumn("media_id", F.pmod("media_id", F.lit(100))).withColumn("start", F.col("start") - 9000).withColumn("end", F.col("end") - 9000), _valleys(tb.hits(s, d)).withColumn("media_id", F.pmod("media_id", F.lit(100))).withColumn("u", F.pmod(F.col("u") * 100, F.lit(2000.0))), 3.0), "snap"),
        _WITH + ", r AS (SELECT media_id % 100 AS media_id, rally_id, start - 9000 AS start, end_ - 9000 AS end_ FROM rallies), b AS (SELECT *, lag(end_) OVER (PARTITION BY media_id ORDER BY start, rally_id) AS before FROM r), v AS (SELECT media_id % 100 AS media_id, (t / 24 * 100) % 2000 AS u, 1 - strength AS depth FROM hits), p AS (SELECT b.media_id, rally_id, u, row_number() OVER (PARTITION BY b.media_id, rally_id ORDER BY depth DESC, u DESC) AS rn FROM b JOIN v ON v.media_id = b.media_id AND u <= start AND u >= start - 3 AND (before IS NULL OR u >= before)) SELECT media_id, rally_id, round(u, 6) AS snap FROM p WHERE rn = 1",
    ),
    "ag_segquality": (
        _r(lambda r: rounded(lb.segment_quality(r), "quality", to=9)),
        _WITH + "SELECT media_id, round(least(1, greatest(0, 0.45::DOUBLE * coalesce(avg((gap > 1)::INT), 0) + 0.25::DOUBLE * least(1, greatest(0, CASE WHEN stddev_pop(d) / greatest(avg(d), 1e-6) < 0.45 THEN stddev_pop(d) / greatest(avg(d), 1e-6) / 0.45 ELSE (1.2 - stddev_pop(d) / greatest(avg(d), 1e-6)) / 0.6 END)) + 0.15::DOUBLE * avg((d BETWEEN 4 AND 90)::INT) + 0.15::DOUBLE * avg(confidence))), 9)::DOUBLE AS quality FROM g GROUP BY 1",
    ),
    "ag_loco": (
        _r(lambda r: rounded(_loco(r), "trained", "held")),
        _WITH + ", c AS (SELECT media_id % 5 AS clip, rally_id % 3 AS variant, avg(speed) AS score FROM rallies GROUP BY 1, 2) SELECT a.clip, a.variant, round(quantile_cont(b.score, 0.5), 6) AS trained, round(any_value(a.score), 6) AS held FROM c a JOIN c b ON a.variant = b.variant AND a.clip <> b.clip GROUP BY 1, 2",
    ),
    "snk_csv": (
        lambda s, d: lb.to_csv_rows(tb.rallies(s, d).join(tb.read(s, d, "orders").select(F.col("o_orderkey").alias("rally_id"), F.concat_ws(",", "o_orderpriority", "o_orderstatus").alias("note")), "rally_id"), 25.0).drop("start", "end"),
        _WITH + "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start, rally_id)::INT AS index, round_even(start * 25, 0)::BIGINT AS start_frame, round_even(end_ * 25, 0)::BIGINT AS end_frame, replace(note || ',' || status, ',', ' ') AS note FROM rallies",
    ),
    "ag_fit_template": (
        lambda s, d: rounded(lb.fitted_template(tb.read(s, d, "labels").join(tb.read(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("x"), F.col("source").alias("channel")), "doc_id").select("channel", F.col("quality").alias("y"), "x")), "scale", "weight", "threshold"),
        "WITH s AS (SELECT source AS channel, quality AS y, n_chars::DOUBLE AS x FROM labels JOIN documents USING (doc_id)), q AS (SELECT channel, quantile_cont(x, 0.85) - quantile_cont(x, 0.15) AS scale, quantile_cont(x, 0.5) FILTER (y = 1) AS a, quantile_cont(x, 0.5) FILTER (y = 0) AS b, quantile_cont(x, 0.15) FILTER (y = 1) AS th FROM s GROUP BY 1) SELECT channel, round(scale, 6) AS scale, round(CASE WHEN scale < 1e-9 THEN 0 ELSE coalesce(least(2, greatest(0, 4 * (a - b) / scale)), 0) END, 6)::DOUBLE AS weight, round(th - 1e-6, 6) AS threshold FROM q",
    ),
    "ag_prf_labels": (
        lambda s, d: _prf(tb.read(s, d, "labels")),
        "WITH c AS (SELECT count_if(quality = 1 AND toxic = 0) AS tp, count_if(toxic = 0 AND quality <> 1) AS fp, count_if(toxic <> 0 AND quality = 1) AS fn FROM labels) SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c",
    ),
    "opt_grid": (
        _grid_search,
        _WITH + f", {_CLUSTERS}, p AS (SELECT a.unnest::DOUBLE AS lim, b.unnest::INT AS least FROM unnest([3, 6, 12, 24]) a, unnest([2, 3, 4]) b), c AS (SELECT ga.*, lim, least, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY lim, least, media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING) AS cluster FROM ga, p), n AS (SELECT *, count(*) OVER (PARTITION BY lim, least, media_id, cluster) >= least AS hit FROM c), s AS (SELECT lim, least, count_if(hit AND hit_idx % 5 = 0) AS tp, count_if(hit AND hit_idx % 5 <> 0) AS fp, count_if(NOT hit AND hit_idx % 5 = 0) AS fn FROM n GROUP BY 1, 2) SELECT lim AS gap, least, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)::DOUBLE AS f1 FROM s",
    ),
    "jn_iou_greedy": (_r(lambda r: rounded(kernels.matched(pairs(r)), "iou")), None),
    "sg_thin": (_h(lambda h: kernels.thinned(h, 2.0).select("media_id", "hit_idx")), None),
    "sg_swing_peaks": (_s(lambda x: kernels.found_peaks(x, 5, 10.0)), None),
    "sg_quiet": (_s(lambda x: kernels.quiet_spans(se.smooth(x, 9).select("media_id", "idx", F.col("smooth").alias("value")), 12.0, 0.2, 20.0, 0.2)), None),
    "sg_split_long": (_h(lambda h: rounded(kernels.long_clusters(h, 6.0, 24.0, 1.0), "start", "end")), None),
    "sg_split_gaps": (_rh(lambda r, h: rounded(kernels.split_at_gaps(ev.clusters(h, 24.0, 2).withColumnRenamed("cluster", "rally_id"), h, 8.0, 2, 1.0), "start", "end")), None),
    "sg_overlap_cut": (_rh(lambda r, h: rounded(kernels.cut_overlaps(r, h.withColumn("t", F.col("t") / 24)), "start", "end")), None),
    "sg_dedupe_long": (
        _r(lambda r: rounded(kernels.longest_of_overlapping(r), "start", "end")),
        None,
    ),
    "sg_split_valley": (_s(lambda x: kernels.split_at_valleys(x, se.runs(se.hysteresis(x, 5.0, 20.0), "on"), 6, 2)), None),
    "sp_merge_events": (
        lambda s, d: kernels.merged_events(tb.hits(s, d).select("media_id", "t", F.col("hit_idx").cast("string").alias("phrase"), F.col("confidence").alias("prob")), 1.5),
        None,
    ),
}
