"""Queries that fuse signals, gate hits and score segments end to end, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators import fusion as fu
from tidemark.operators import series as se
from tidemark.operators.lineage import cut
from tidemark.plans.labels import rounded
from tidemark.sources import tables as tb
from tidemark.streaming import twins

BASE = {"quantity": 0.5, "price": 0.3, "discount": 0.2}
_SIGNAL = """WITH line AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx FROM lineitem),
comp AS (SELECT l_suppkey AS media_id, idx, unnest(['quantity', 'price', 'discount']) AS name, unnest([l_quantity / 50, l_extendedprice / 100000, l_discount * 10]) AS value FROM line),
q AS (SELECT media_id, name, count(*) AS n, max(abs(value)) AS top, quantile_cont(value, 0.1) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.9) AS c FROM comp GROUP BY 1, 2),
r AS (SELECT media_id, name, CASE WHEN top > 1e-9 THEN CASE name WHEN 'quantity' THEN 0.5 WHEN 'price' THEN 0.3 ELSE 0.2 END::DOUBLE * (0.35::DOUBLE + 0.65::DOUBLE * CASE WHEN n < 32 THEN 0.35 WHEN c - a < 1e-9 THEN 0.05 ELSE least(1, greatest(0.05, ((c - b) / (c - a) - 0.42) / 0.45)) END) ELSE 0 END AS raw FROM q),
w AS (SELECT media_id, name, raw / sum(raw) OVER (PARTITION BY media_id) AS w FROM r),
act AS (SELECT media_id, idx, sum(value * w) AS value FROM comp JOIN w USING (media_id, name) GROUP BY 1, 2),
th AS (SELECT media_id, greatest(quantile_cont(value, 0.78), 1.25 * quantile_cont(value, 0.5)) AS hi, greatest(0.92 * quantile_cont(value, 0.55), 1.05 * quantile_cont(value, 0.5)) AS lo FROM act GROUP BY 1)
"""
_HITS = """WITH hits AS (SELECT user_id AS media_id, event_id AS hit_idx, epoch_us(ts) / 3.6e9 AS t, value / 500 AS strength, json_extract_string(props, '$.k')::DOUBLE / 99 AS confidence FROM events)"""


def components(s, d):
    order = "partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax"
    rows = tb.read(s, d, "lineitem").withColumn("idx", F.expr(f"row_number() over ({order}) - 1").cast("long"))
    rows = rows.select(F.col("l_suppkey").alias("media_id"), "idx", (F.col("l_quantity") / 50).alias("quantity"), (F.col("l_extendedprice") / 100000).alias("price"), (F.col("l_discount") * 10).alias("discount"))
    return rows.unpivot(["media_id", "idx"], list(BASE), "name", "value")


def _act(f):
    return lambda s, d: f(fu.combined(components(s, d), BASE))


def _slices(s, d):
    spans = s.range(8).select((F.col("id") * 10).alias("start"), (F.col("id") * 10 + 7).alias("end"), F.col("id").alias("rally_id"))
    signal = tb.signal(s, d)
    media = signal.select("media_id").distinct().crossJoin(F.broadcast(spans))  # 8 rows
    return fu.sliced(signal, media, 2.0, 16)


def _local(s, d):
    hits = tb.hits(s, d)
    share = ev.local_percentile(hits, 12.0)
    rows = hits.join(share, ["media_id", "hit_idx"]).withColumn("evidence", F.greatest(F.col("confidence"), 0.6 * F.col("local_pct")))
    return fu.gated(rows, "evidence", 0.5).select("media_id", "hit_idx")


def _swings(s, d):
    hits = tb.hits(s, d)
    peak = F.pmod("hit_idx", F.lit(3)) == 0
    return fu.matched_swings(hits.where(~peak), hits.where(peak).select("media_id", F.col("t").alias("u"), F.col("confidence").alias("prominence")), 2.0)


def run_analysis(s, d):
    """Hits to clusters, gated by their surroundings, to features and a score relative to the batch: the whole analysis over stored hits."""
    hits = tb.hits(s, d)
    flagged = hits.withColumn("local", F.col("strength"))
    named = ev.named_clusters(fu.gated(flagged, "local", 0.2).drop("local"), 12.0)
    rows = fu.features(named, ["media_id", "cluster"], 6.0).where("shots >= 2")
    tops = rows.agg(F.percentile("tempo", F.lit(0.85)).alias("p_tempo"), F.percentile("strength_p90", F.lit(0.85)).alias("p_strength"))
    rows = rows.crossJoin(F.broadcast(tops))  # the one row of an aggregate
    part = lambda x, p: se.clipped(F.col(x) / (F.col(p) + 1e-9), 0, 1.2) / 1.2
    length = 1 - F.exp(-F.col("shots") / (0.55 * 24))
    total = 100 * (0.4 * length + 0.3 * part("tempo", "p_tempo") + 0.3 * part("strength_p90", "p_strength")) * (0.75 + 0.25 * F.col("confidence"))
    return rows.select("media_id", "cluster", "shots", F.round("span", 6).alias("span"), "streak", "smashes", F.round(total, 6).alias("total"))


_FEATURES = """, ga AS (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t, hit_idx) AS g0 FROM kept),
c AS (SELECT *, sum(CASE WHEN g0 > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM ga),
g AS (SELECT *, t - lag(t) OVER z AS gap, row_number() OVER (PARTITION BY media_id, cluster ORDER BY t DESC, hit_idx DESC) AS back, count(*) OVER (PARTITION BY media_id, cluster) AS alln FROM c WINDOW z AS (PARTITION BY media_id, cluster ORDER BY t, hit_idx)),
u AS (SELECT *, sum(CASE WHEN gap <= 6 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id, cluster ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING) AS run FROM g),
v AS (SELECT *, count(*) OVER (PARTITION BY media_id, cluster, run) AS len FROM u),
p AS (SELECT media_id, cluster, quantile_cont(strength, 0.85) AS p85 FROM v GROUP BY 1, 2),
f AS (SELECT v.media_id, v.cluster, count(*) AS shots, max(t) - min(t) AS span, avg(strength) AS strength, quantile_cont(strength, 0.9) AS strength_p90, avg(confidence) AS confidence, 1 / greatest(quantile_cont(gap, 0.5), 1e-3) AS tempo,
  1 / greatest(quantile_cont(gap, 0.5) FILTER (back <= greatest(2, (alln - 1) // 3)), 1e-3) AS finish_tempo, var_pop(gap) AS tempo_variance, max(len) AS streak, count_if(strength >= p85)::BIGINT AS smashes FROM v JOIN p ON p.media_id = v.media_id AND p.cluster = v.cluster GROUP BY 1, 2 HAVING count(*) >= 2)"""

ALL = {
    "sg_weights": (lambda s, d: rounded(fu.weights(components(s, d), BASE), "w"), _SIGNAL + "SELECT media_id, name, round(w, 6) AS w FROM w"),
    "sg_combine": (_act(lambda a: rounded(a, "value")), _SIGNAL + "SELECT media_id, idx, round(value, 6) AS value FROM act"),
    "sg_thresholds": (_act(lambda a: rounded(fu.thresholds(a), "hi", "lo")), _SIGNAL + "SELECT media_id, round(hi, 6) AS hi, round(lo, 6) AS lo FROM th"),
    "sg_segment": (
        _act(lambda a: rounded(fu.active_runs(cut(a), 2, 1), "confidence")),
        _SIGNAL + ", f AS (SELECT act.*, coalesce(last_value(CASE WHEN value >= hi THEN 1 WHEN value < least(lo, hi) THEN 0 END IGNORE NULLS) OVER (PARTITION BY act.media_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS o FROM act JOIN th ON th.media_id = act.media_id), n AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY media_id ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS nw FROM f WHERE o = 1), i AS (SELECT *, sum(nw) OVER (PARTITION BY media_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS k FROM n), s AS (SELECT media_id, k, min(idx) AS first, max(idx) AS last, avg(value) AS mean FROM i GROUP BY 1, 2 HAVING max(idx) - min(idx) + 1 >= 2), z AS (SELECT media_id, quantile_cont(value, 0.2) AS a, quantile_cont(value, 0.95) AS b FROM act GROUP BY 1) SELECT s.media_id, first, last, round(least(1, greatest(0.05, (mean - a) / greatest(b - a, 1e-9))), 6)::DOUBLE AS confidence FROM s JOIN z ON z.media_id = s.media_id",
    ),
    "sg_blend": (
        lambda s, d: rounded(fu.blended(tb.signal(s, d), components(s, d).where("name = 'discount'"), 0.7), "value"),
        _SIGNAL + ", m AS (SELECT l_suppkey AS media_id, idx, l_quantity * (1 - 0.7::DOUBLE + 0.7::DOUBLE * (l_discount * 10)) AS v FROM line), z AS (SELECT media_id, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM m GROUP BY 1) SELECT m.media_id, idx, round(CASE WHEN b - a < 1e-9 THEN 0 ELSE least(1, greatest(0, (v - a) / (b - a))) END, 6)::DOUBLE AS value FROM m JOIN z ON z.media_id = m.media_id",
    ),
    "jn_slice": (
        lambda s, d: rounded(_slices(s, d), "mean", "top", "p90"),
        _SIGNAL + "SELECT l_suppkey AS media_id, i AS rally_id, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(max(l_quantity), 6) AS top, round(quantile_cont(l_quantity, 0.9), 6) AS p90 FROM line JOIN range(8) t(i) ON idx >= i * 20 AND idx < i * 20 + 14 GROUP BY 1, 2",
    ),
    "gt_composite": (
        _local,
        _HITS + ", p AS (SELECT a.media_id, a.hit_idx, any_value(a.confidence) AS confidence, count(*) AS n, count_if(b.strength <= a.strength) AS below, max(b.strength) - min(b.strength) AS spread FROM hits a JOIN hits b ON a.media_id = b.media_id AND abs(a.t - b.t) <= 12 GROUP BY 1, 2), e AS (SELECT media_id, hit_idx, greatest(confidence, 0.6::DOUBLE * CASE WHEN n = 1 THEN 1.0 WHEN spread < 1e-6 THEN 0.0 ELSE below / n END) >= 0.5 AS k FROM p), s AS (SELECT *, avg(k::INT) OVER (PARTITION BY media_id) AS share FROM e) SELECT media_id, hit_idx FROM s WHERE k OR share NOT BETWEEN 0.12 AND 0.97",
    ),
    "gt_gate": (
        lambda s, d: fu.gated(tb.hits(s, d), "confidence", 0.7).select("media_id", "hit_idx"),
        _HITS + ", s AS (SELECT *, avg((confidence >= 0.7)::INT) OVER (PARTITION BY media_id) AS share FROM hits) SELECT media_id, hit_idx FROM s WHERE confidence >= 0.7 OR share NOT BETWEEN 0.12 AND 0.97",
    ),
    "jn_nearest_swing": (
        lambda s, d: rounded(_swings(s, d), "evidence"),
        _HITS + ", pr AS (SELECT a.media_id, a.hit_idx, a.strength, b.t AS u, b.confidence AS prom, abs(a.t - b.t) AS dt FROM hits a JOIN hits b ON a.media_id = b.media_id AND a.hit_idx % 3 <> 0 AND b.hit_idx % 3 = 0 AND abs(a.t - b.t) <= 2), n AS (SELECT *, row_number() OVER (PARTITION BY media_id, hit_idx ORDER BY dt, u, prom) AS rn FROM pr), o AS (SELECT *, row_number() OVER (PARTITION BY media_id, u ORDER BY dt - 1e-3 * strength, hit_idx) AS k FROM n WHERE rn = 1) SELECT h.media_id, h.hit_idx, round(coalesce(least(1, greatest(0, prom * (1 - 0.5 * dt / 2))), 0), 6)::DOUBLE AS evidence FROM hits h LEFT JOIN o ON o.media_id = h.media_id AND o.hit_idx = h.hit_idx AND k = 1 WHERE h.hit_idx % 3 <> 0",
    ),
    "ag_features": (
        lambda s, d: rounded(rounded(fu.features(ev.named_clusters(tb.hits(s, d), 12.0), ["media_id", "cluster"], 6.0).where("shots >= 2"), "span", "tempo", "finish_tempo", "tempo_variance", to=5), "strength", "strength_p90", "confidence", to=9),
        _HITS + ", kept AS (SELECT * FROM hits)" + _FEATURES + " SELECT media_id, cluster, shots, round(span, 5) AS span, round(strength, 9) AS strength, round(strength_p90, 9) AS strength_p90, round(confidence, 9) AS confidence, round(tempo, 5) AS tempo, round(finish_tempo, 5) AS finish_tempo, round(tempo_variance, 5) AS tempo_variance, streak, smashes FROM f",
    ),
    "en_run": (
        run_analysis,
        _HITS + ", sh AS (SELECT *, avg((strength >= 0.2)::INT) OVER (PARTITION BY media_id) AS share FROM hits), kept AS (SELECT * FROM sh WHERE strength >= 0.2 OR share NOT BETWEEN 0.12 AND 0.97)" + _FEATURES + ", b AS (SELECT quantile_cont(tempo, 0.85) AS pt, quantile_cont(strength_p90, 0.85) AS ps FROM f) SELECT media_id, cluster, shots, round(span, 6) AS span, streak, smashes, round(100 * (0.4::DOUBLE * (1 - exp(-shots / (0.55::DOUBLE * 24))) + 0.3::DOUBLE * least(1.2::DOUBLE, greatest(0, tempo / (pt + 1e-9))) / 1.2::DOUBLE + 0.3::DOUBLE * least(1.2::DOUBLE, greatest(0, strength_p90 / (ps + 1e-9))) / 1.2::DOUBLE) * (0.75::DOUBLE + 0.25::DOUBLE * confidence), 6) AS total FROM f, b",
    ),
    "st_hopping": (
        lambda s, d: twins.hopping_counts(twins.with_time(tb.read(s, d, "events")), "2 hours", "1 hour").select("media_id", F.unix_micros("lo").alias("lo"), "n"),
        "WITH e AS (SELECT user_id AS media_id, epoch_us(ts) AS u FROM events), k AS (SELECT media_id, unnest([u // 3600000000 * 3600000000, u // 3600000000 * 3600000000 - 3600000000]) AS lo FROM e) SELECT media_id, lo, count(*) AS n FROM k GROUP BY 1, 2",
    ),
    "st_sessions": (
        lambda s, d: twins.sessions(twins.with_time(tb.read(s, d, "events")), "6 hours").select("media_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n"),
        "WITH e AS (SELECT user_id AS media_id, epoch_us(ts) AS u, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, event_id FROM events), k AS (SELECT *, sum(CASE WHEN gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY u, event_id ROWS UNBOUNDED PRECEDING) AS c FROM e) SELECT media_id, min(u) AS first, max(u) AS last, count(*) AS n FROM k GROUP BY media_id, c",
    ),
}
