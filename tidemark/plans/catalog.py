"""Every query of the library by name, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators import intervals as iv
from tidemark.operators import scoring as sc
from tidemark.operators import series as se
from tidemark.plans import boxes, evidence, fusion, labels, players, records, scores, segmentation, spans, tracks
from tidemark.sources import tables as tb

FLAGSHIP = "segment_score"


def rounded(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    """Sums and percentiles in another order differ in their last digits."""
    return df.select(*[F.round(c, to).alias(c) if c in columns else F.col(c) for c in df.columns])


_WITH = """WITH hits AS (
  SELECT user_id AS media_id, event_id AS hit_idx, epoch_us(ts) / 3.6e9 AS t, value / 500 AS strength,
         json_extract_string(props, '$.k')::DOUBLE / 99 AS confidence FROM events),
signal AS (
  SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx, l_quantity AS value FROM lineitem),
rallies AS (
  SELECT o_custkey AS media_id, o_orderkey AS rally_id, epoch_us(o_orderdate) / 8.64e10 AS start, o_totalprice / 10000 AS duration,
         epoch_us(o_orderdate) / 8.64e10 + o_totalprice / 10000 AS end_, (o_orderkey % 29)::INT AS shots,
         ((o_orderkey * 7) % 101) / 100.0::DOUBLE AS speed, ((o_orderkey * 3) % 97) / 96.0::DOUBLE AS confidence FROM orders)
"""
_GAPS = "gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t, hit_idx) AS gap FROM hits)"
_RUN = "PARTITION BY media_id ORDER BY idx"
_SMOOTH = """sm AS (SELECT *, (sum(value) OVER (r ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
  + greatest(0, 3 - idx) * first_value(value) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  + greatest(0, 3 - (count(*) OVER (PARTITION BY media_id) - 1 - idx)) * last_value(value) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 7 AS smooth
  FROM signal WINDOW r AS (PARTITION BY media_id ORDER BY idx))"""


def _labels(hits: DataFrame) -> DataFrame:
    """The purchases are the labelled hits that the others are compared with."""
    return hits.where(F.pmod("hit_idx", F.lit(5)) == 0).select("media_id", F.col("hit_idx").alias("label_idx"), F.col("t").alias("u"))


def _halves(rallies: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rallies.where("rally_id % 2 = 0"), rallies.where("rally_id % 2 = 1")


def _h(f):
    return lambda s, d: f(tb.hits(s, d))


def _s(f):
    return lambda s, d: f(tb.signal(s, d))


def _r(f):
    return lambda s, d: f(tb.rallies(s, d))


def _holes(signal: DataFrame) -> DataFrame:
    return signal.withColumn("v", F.when(F.pmod("idx", F.lit(4)) == 0, F.col("value")))


def _clip_metrics(rallies: DataFrame) -> DataFrame:
    a, b = _halves(rallies)
    hit = iv.overlaps(a, b, 10.0).where("iou >= 0.3")
    tp = hit.groupBy("media_id").agg(F.count_distinct("rally_id").alias("tp"))
    n = rallies.groupBy("media_id").agg(F.count_if(F.expr("rally_id % 2 = 0")).alias("preds"), F.count_if(F.expr("rally_id % 2 = 1")).alias("golds"))
    n = n.join(tp, "media_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    total = n.rollup("media_id").agg(F.sum("tp").alias("tp"), F.sum("preds").alias("preds"), F.sum("golds").alias("golds"))
    p, r, f1 = iv.prf(F.col("tp"), F.col("preds") - F.col("tp"), F.greatest(F.lit(0), F.col("golds") - F.col("tp")))
    return total.select("media_id", "tp", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))


#: name: (query, SQL)
_ALL = {
    "wn_smooth": (_s(lambda x: rounded(se.smooth(x, 7), "smooth")), _WITH + f", {_SMOOTH} SELECT media_id, idx, value, round(smooth, 6) AS smooth FROM sm"),
    "wn_same": (_s(lambda x: rounded(se.same_mean(x, 6), "same")), _WITH + f"SELECT media_id, idx, value, round(sum(value) OVER ({_RUN} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) / 6, 6) AS same FROM signal"),
    "wn_robust_norm": (
        _s(lambda x: rounded(se.robust_norm(x), "norm")),
        _WITH + ", q AS (SELECT media_id, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM signal GROUP BY 1) SELECT media_id, idx, value, round(CASE WHEN hi - lo < 1e-9 THEN 0 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (value - lo) / (hi - lo))) END, 6) AS norm FROM signal JOIN q USING (media_id)",
    ),
    "wn_roll_dir": (
        _s(lambda x: rounded(se.roll_mean(se.roll_mean(x, 5, True, "ahead"), 5, False, "back"), "ahead", "back")),
        _WITH + f"SELECT media_id, idx, value, round(avg(value) OVER ({_RUN} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), 6) AS ahead, round(coalesce(avg(value) OVER ({_RUN} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 6) AS back FROM signal",
    ),
    "wn_maxmin_filter": (_s(lambda x: se.extent(x, 4)), _WITH + f"SELECT media_id, idx, value, min(value) OVER w AS lowest, max(value) OVER w AS highest FROM signal WINDOW w AS ({_RUN} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"),
    "wn_slope": (
        _s(lambda x: rounded(se.slope(x, 7, 3, 12.0), "smooth", "slope")),
        _WITH + f", {_SMOOTH} SELECT media_id, idx, value, round(smooth, 6) AS smooth, round(coalesce((smooth - lag(smooth, 3) OVER ({_RUN})) / (3 / 12.0::DOUBLE), 0), 6) AS slope FROM sm",
    ),
    "wn_decay": (
        _s(lambda x: rounded(se.decay(x, 0.93), "decayed")),
        _WITH + f"SELECT media_id, idx, value, round(coalesce(exp(max(CASE WHEN value > 0 THEN ln(value) - idx * ln(0.93::DOUBLE) END) OVER ({_RUN}) + idx * ln(0.93::DOUBLE)), 0), 6) AS decayed FROM signal",
    ),
    "sg_hysteresis": (
        _s(lambda x: se.runs(se.hysteresis(x, 15.0, 40.0), "on")),
        _WITH + f", f AS (SELECT *, coalesce(last_value(CASE WHEN value >= 40 THEN 1 WHEN value < 15 THEN 0 END IGNORE NULLS) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS o FROM signal), g AS (SELECT *, idx - row_number() OVER ({_RUN}) AS island FROM f WHERE o = 1) SELECT media_id, min(idx) AS first, max(idx) AS last, count(*) AS n FROM g GROUP BY media_id, island",
    ),
    "wn_fill": (
        _s(lambda x: rounded(se.fill(_holes(x), "v").drop("v"), "filled")),
        _WITH + ", a AS (SELECT *, max(idx) OVER (PARTITION BY media_id) // 4 * 4 AS top FROM signal), k AS (SELECT media_id, idx, value FROM signal WHERE idx % 4 = 0) SELECT a.media_id, a.idx, a.value, round(CASE WHEN b.idx >= a.top THEN b.value ELSE b.value + (c.value - b.value) * (a.idx - b.idx) / 4.0::DOUBLE END, 6) AS filled FROM a JOIN k b ON b.media_id = a.media_id AND b.idx = a.idx // 4 * 4 LEFT JOIN k c ON c.media_id = a.media_id AND c.idx = b.idx + 4",
    ),
    "jn_resample": (
        _s(lambda x: rounded(se.resample(x, 12.0, 8.0), "value")),
        _WITH + ", top AS (SELECT media_id, max(idx) AS top FROM signal GROUP BY 1), g AS (SELECT media_id, top, unnest(range(floor((top + 1) * (8.0::DOUBLE / 12.0::DOUBLE))::BIGINT)) AS i FROM top), p AS (SELECT *, least(i * 1.5::DOUBLE, top::DOUBLE) AS p FROM g) SELECT p.media_id, i::INT AS i, round(a.value + (b.value - a.value) * (p - floor(p)), 6) AS value FROM p JOIN signal a ON a.media_id = p.media_id AND a.idx = floor(p)::BIGINT JOIN signal b ON b.media_id = p.media_id AND b.idx = least(floor(p)::BIGINT + 1, top)",
    ),
    "prj_pool": (_s(lambda x: rounded(se.pooled(x, 16), "mean")), _WITH + "SELECT media_id, idx // 16 AS block, round(avg(value), 6) AS mean FROM signal GROUP BY 1, 2"),
    "ag_discrim": (
        _s(lambda x: rounded(se.discrimination(x), "power")),
        _WITH + ", q AS (SELECT media_id, count(*) AS n, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.9) AS c FROM signal GROUP BY 1) SELECT media_id, round(CASE WHEN n < 32 THEN 0.35 WHEN c - a < 1e-9 THEN 0.05 ELSE least(1, greatest(0.05, ((c - b) / (c - a) - 0.42) / 0.45)) END, 6)::DOUBLE AS power FROM q",
    ),
    "sg_cluster": (
        _h(lambda x: rounded(ev.clusters(x, 6.0, 3, 1.0), "start", "end", "confidence")),
        _WITH + f", {_GAPS}, c AS (SELECT *, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM gaps) SELECT media_id, cluster, round(min(t), 6) AS start, round(max(t), 6) AS \"end\", count(*) AS n, round(least(1, greatest(0.15, count(*) / 12.0::DOUBLE)), 6)::DOUBLE AS confidence FROM c GROUP BY 1, 2 HAVING count(*) >= 3 AND max(t) - min(t) >= 1",
    ),
    "ag_streak": (
        _h(lambda x: ev.streaks(x, 6.0)),
        _WITH + f", {_GAPS}, c AS (SELECT *, sum(CASE WHEN gap <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING) AS run FROM gaps), n AS (SELECT media_id, run, count(*) AS n FROM c GROUP BY 1, 2) SELECT media_id, max(n) AS streak FROM n GROUP BY 1",
    ),
    "wn_gap_limit": (
        _h(lambda x: rounded(ev.gap_limit(x, 3.0, 40.0), "gap_limit")),
        _WITH + f", {_GAPS}, q AS (SELECT media_id, count(*) AS n, count_if(gap > 1e-6) AS g, quantile_cont(gap, 0.7) FILTER (gap > 1e-6) AS p FROM gaps GROUP BY 1) SELECT media_id, round(CASE WHEN n < 3 OR g < 2 THEN 3 ELSE least(40, greatest(3, 1.8 * p)) END, 6)::DOUBLE AS gap_limit FROM q",
    ),
    "ag_tempo_tail": (
        _h(lambda x: rounded(ev.tempo_tail(x), "finish_tempo")),
        _WITH + f", {_GAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t DESC, hit_idx DESC) AS back, count(*) OVER (PARTITION BY media_id) AS n FROM gaps WHERE gap IS NOT NULL) SELECT media_id, round(1 / greatest(quantile_cont(gap, 0.5), 1e-3), 6) AS finish_tempo FROM r WHERE back <= greatest(2, n // 3) GROUP BY 1",
    ),
    "wn_local_pct": (
        _h(lambda x: rounded(ev.local_percentile(x, 12.0), "local_pct")),
        _WITH + ", p AS (SELECT a.media_id, a.hit_idx, count(*) AS n, count_if(b.strength <= a.strength) AS below, max(b.strength) - min(b.strength) AS spread FROM hits a JOIN hits b ON a.media_id = b.media_id AND abs(a.t - b.t) <= 12 GROUP BY 1, 2) SELECT media_id, hit_idx, round(CASE WHEN n = 1 THEN 1.0 WHEN spread < 1e-6 THEN 0.0 ELSE below / n END, 6)::DOUBLE AS local_pct FROM p",
    ),
    "ag_reliability": (
        _h(lambda x: rounded(ev.reliability(x, 24.0, 2.0), "coverage", "bursts")),
        _WITH + f", {_GAPS}, q AS (SELECT media_id, count(*) AS n, count(DISTINCT floor(t / 24)) AS bins, max(t) - min(t) AS span, avg((gap < 2)::INT) AS bursts FROM gaps GROUP BY 1) SELECT media_id, n, round(CASE WHEN n < 8 THEN 0 ELSE least(1, bins / greatest(1, ceil(span / 24))) END, 6)::DOUBLE AS coverage, round(CASE WHEN n < 8 THEN 0 ELSE bursts END, 6)::DOUBLE AS bursts FROM q",
    ),
    "wn_pct_rank": (
        _h(lambda x: rounded(ev.rank_share(x), "pct_rank")),
        _WITH + "SELECT media_id, hit_idx, round(CASE WHEN count(*) OVER (PARTITION BY media_id) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY media_id ORDER BY strength) + (count(*) OVER (PARTITION BY media_id, strength) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY media_id) - 1) END, 6)::DOUBLE AS pct_rank FROM hits",
    ),
    "jn_nearest_label": (
        _h(lambda x: rounded(iv.nearest(x.where("hit_idx % 5 <> 0"), _labels(x), 6.0), "dt")),
        _WITH + ", p AS (SELECT a.media_id, a.hit_idx, b.hit_idx AS label_idx, abs(a.t - b.t) AS dt, b.t AS u FROM hits a JOIN hits b ON a.media_id = b.media_id AND a.hit_idx % 5 <> 0 AND b.hit_idx % 5 = 0 AND abs(a.t - b.t) <= 6), r AS (SELECT *, row_number() OVER (PARTITION BY media_id, hit_idx ORDER BY dt, u DESC, label_idx DESC) AS rn FROM p) SELECT media_id, hit_idx, label_idx, round(dt, 6) AS dt FROM r WHERE rn = 1",
    ),
    "sg_join_abut": (
        _r(lambda x: rounded(iv.join_abutting(x, 20.0), "start", "end", "confidence")),
        _WITH + ", m AS (SELECT *, max(end_) OVER (PARTITION BY media_id ORDER BY start, rally_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM rallies), k AS (SELECT *, sum(CASE WHEN start - latest < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start, rally_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM m) SELECT media_id, island, round(min(start), 6) AS start, round(max(end_), 6) AS \"end\", count(*) AS n, round(max(confidence), 6) AS confidence FROM k GROUP BY 1, 2",
    ),
    "jn_iou_match": (
        _r(lambda x: rounded(iv.overlaps(*_halves(x), 10.0).where("iou >= 0.1").select("media_id", "rally_id", "other_id", "overlap", "iou"), "overlap", "iou")),
        _WITH + ", p AS (SELECT a.media_id, a.rally_id, b.rally_id AS other_id, least(a.end_, b.end_) - greatest(a.start, b.start) AS overlap, greatest(a.end_, b.end_) - least(a.start, b.start) AS u FROM rallies a JOIN rallies b ON a.media_id = b.media_id AND a.rally_id % 2 = 0 AND b.rally_id % 2 = 1) SELECT media_id, rally_id, other_id, round(overlap, 6) AS overlap, round(overlap / u, 6) AS iou FROM p WHERE overlap > 0 AND overlap / u >= 0.1",
    ),
    "jn_best_overlap": (
        _r(lambda x: rounded(iv.best_overlap(*_halves(x), 10.0), "overlap")),
        _WITH + ", p AS (SELECT a.media_id, a.rally_id, a.start, a.end_, b.rally_id AS other_id, least(a.end_, b.end_) - greatest(a.start, b.start) AS overlap FROM rallies a JOIN rallies b ON a.media_id = b.media_id AND a.rally_id % 2 = 0 AND b.rally_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY media_id, rally_id ORDER BY overlap DESC, other_id) AS rn FROM p WHERE overlap > 0) SELECT media_id, rally_id, other_id, round(overlap, 6) AS overlap FROM r WHERE rn = 1 AND overlap >= 0.5 * greatest(0.1, end_ - start)",
    ),
    "jn_hits_in_window": (
        lambda s, d: rounded(iv.hits_in_window(ev.clusters(tb.hits(s, d), 6.0, 3).withColumnRenamed("cluster", "rally_id"), tb.hits(s, d), 2.0, 3.0, 24.0), "strongest"),
        _WITH + f", {_GAPS}, c AS (SELECT *, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS rally_id FROM gaps), k AS (SELECT media_id, rally_id, min(t) AS s, max(t) AS e FROM c GROUP BY 1, 2 HAVING count(*) >= 3), w AS (SELECT media_id, rally_id, greatest(s - 2, coalesce(lag(e) OVER (PARTITION BY media_id ORDER BY s, rally_id), '-infinity'::DOUBLE)) AS lo, least(e + 3, coalesce(lead(s) OVER (PARTITION BY media_id ORDER BY s, rally_id), 'infinity'::DOUBLE)) AS hi FROM k), v AS (SELECT media_id, rally_id, CASE WHEN hi < lo THEN (lo + hi) / 2 ELSE lo END AS lo, CASE WHEN hi < lo THEN (lo + hi) / 2 ELSE hi END AS hi FROM w) SELECT v.media_id, v.rally_id, count(h.t) AS n, round(max(strength), 6) AS strongest FROM v LEFT JOIN hits h ON h.media_id = v.media_id AND h.t >= lo AND h.t <= hi GROUP BY 1, 2",
    ),
    "auto_cut": (
        _r(lambda x: rounded(iv.placed(x, 1.0, 2.0, 0.5), "src_in", "src_out", "tl_start")),
        _WITH + ", a AS (SELECT media_id, rally_id, greatest(0, least(start - 1, end_))::DOUBLE AS src_in, end_ FROM rallies), b AS (SELECT *, greatest(src_in + 0.2, end_ + 2)::DOUBLE AS src_out FROM a) SELECT media_id, rally_id, round(src_in, 6) AS src_in, round(src_out, 6) AS src_out, round(coalesce(sum(src_out - src_in + 0.5) OVER (PARTITION BY media_id ORDER BY src_in, rally_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS tl_start FROM b",
    ),
    "ag_macro_micro": (
        _r(_clip_metrics),
        _WITH + ", h AS (SELECT a.media_id, count(DISTINCT a.rally_id) AS tp FROM rallies a JOIN rallies b ON a.media_id = b.media_id AND a.rally_id % 2 = 0 AND b.rally_id % 2 = 1 WHERE least(a.end_, b.end_) - greatest(a.start, b.start) > 0 AND (least(a.end_, b.end_) - greatest(a.start, b.start)) / (greatest(a.end_, b.end_) - least(a.start, b.start)) >= 0.3 GROUP BY 1), n AS (SELECT r.media_id, count_if(rally_id % 2 = 0) AS preds, count_if(rally_id % 2 = 1) AS golds, coalesce(any_value(tp), 0) AS tp FROM rallies r LEFT JOIN h USING (media_id) GROUP BY 1), t AS (SELECT media_id, sum(tp)::BIGINT AS tp, sum(preds) AS preds, sum(golds) AS golds FROM n GROUP BY ROLLUP (media_id)), m AS (SELECT media_id, tp, coalesce(tp / nullif(preds, 0), 0)::DOUBLE AS p, coalesce(tp / nullif(tp + greatest(0, golds - tp), 0), 0)::DOUBLE AS r FROM t) SELECT media_id, tp, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM m",
    ),
    "ag_stats": (
        _r(lambda x: rounded(sc.statistics(x), "total", "mean", "median", "longest", "p90", to=10)),
        _WITH + "SELECT media_id, count(*) AS n, round(sum(duration), 10) AS total, round(avg(duration), 10) AS mean, round(quantile_cont(duration, 0.5), 10) AS median, round(max(duration), 10) AS longest, round(quantile_cont(speed, 0.9), 10) AS p90, count_if(speed >= 0.7)::BIGINT AS fast FROM rallies GROUP BY 1",
    ),
    "ag_histogram": (
        _r(lambda x: sc.histogram(x, "duration", 10, 30.0)),
        _WITH + ", t AS (SELECT greatest(30, max(duration))::DOUBLE AS top FROM rallies) SELECT least(floor(duration / top * 10), 9)::INT AS bin, count(*) AS n FROM rallies, t GROUP BY 1",
    ),
    "src_stable_id": (
        lambda s, d: tb.read(s, d, "part").select("p_partkey", F.concat(F.lit("m_"), F.substring(F.sha1(F.concat_ws("|", F.lower("p_name"), F.col("p_size").cast("string")).cast("binary")), 1, 12)).alias("media_id")),
        "SELECT p_partkey, 'm_' || substr(sha1(lower(p_name) || '|' || p_size::VARCHAR), 1, 12) AS media_id FROM part",
    ),
    "set_unpivot": (
        lambda s, d: tb.read(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").cast("double").alias("rows")).unpivot("l_suppkey", ["quantity", "rows"], "name", "value"),
        "SELECT l_suppkey, unnest(['quantity', 'rows']) AS name, unnest([sum(l_quantity), count(*)::DOUBLE]) AS value FROM lineitem GROUP BY 1",
    ),
}


for _more in (boxes, labels, records, fusion, scores, spans, evidence, segmentation, tracks, players):
    if _twice := _ALL.keys() & _more.ALL.keys():
        raise ValueError(f"queries of the same name: {sorted(_twice)}")
    _ALL |= _more.ALL


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict:
    """Of the queries that SQL can express; the steps that depend on their order have none."""
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
