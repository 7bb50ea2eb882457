"""Queries over segmentations of a signal, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evidence as be
from tidemark.operators import kernels
from tidemark.operators import optimise as op
from tidemark.operators import refine as rf
from tidemark.operators import resegment as rs
from tidemark.operators import segmentation as sg
from tidemark.operators import series as se
from tidemark.operators.lineage import cut
from tidemark.plans import evidence as pe
from tidemark.sources import tables as tb

#: Samples a second of a signal that is only cut, and of one whose windows are chosen from.
FPS, SLOW = 12.0, 4.0
#: Marks on the smoothed signal above which the two segmentations see something.
SEEN, ACTIVE = 27.0, 23.0


def raw(s, d):
    """The signal, numbered once: a query reads it several times, and each time would sort all samples anew."""
    return cut(tb.signal(s, d))


def smoothed(signal, width: int = 7):
    """The smoothed signal, written once as well."""
    return cut(se.smooth(signal, width).select("media_id", "idx", F.col("smooth").alias("value")))


def media(signal, fps: float):
    n = signal.groupBy("media_id").agg(F.max("idx").alias("top"))
    return n.select("media_id", (F.col("top") + 1).alias("n"), ((F.col("top") + 1) / fps).alias("duration"))


def covered(signal):
    """Nobody is seen in a third of the time, 40 samples at once."""
    return signal.select("media_id", "idx", F.when((F.floor(F.col("idx") / 40) + F.col("media_id")) % 3 > 0, 1.0).otherwise(0.0).alias("value"))


def _cut(how, **more):
    def query(s, d):
        x = smoothed(tb.signal(s, d), 9)
        quiet = cut(kernels.quiet_spans(x, FPS, 0.7, 0.0, 0.18))
        out = how(x, quiet, media(x, FPS).select("media_id", "duration"), FPS, most=4.0, **({"coverage": covered(x)} if more else {}))
        return out.select("media_id", "rally_id", *(F.round(c, 6).alias(c) for c in ("start", "end", "score")))

    return query


def _above(x, mark: float):
    r = se.runs(x.withColumn("on", (F.col("value") >= mark).cast("int")), "on")
    return r.select("media_id", F.col("first").alias("rally_id"), (F.col("first") / SLOW).alias("start"), ((F.col("last") + 1) / SLOW).alias("end"), (F.col("n") / 100.0).alias("score"))


def _chosen(f):
    def query(s, d):
        signal = raw(s, d)
        x = smoothed(signal)
        return f(cut(_above(x, SEEN)), cut(_above(x, ACTIVE)), cut(media(signal, SLOW)), SLOW, 8.0, covered(signal), signal)

    return query


#: What the search tries, and what its descent varies.
VALUES, FIELDS = {"core": [0.5, 1.0], "ratio": [0.1, 0.18], "least": [1.5, 2.5]}, {"rest": (0.2, 2.0)}


def _search(f):
    """Stretches above a mark are the labels that the settings are to fit."""

    def query(s, d):
        x = smoothed(tb.signal(s, d), 9)
        runs = se.runs(x.withColumn("on", (F.col("value") >= SEEN).cast("int")), "on").where("n >= 12")
        labels = runs.select("media_id", F.col("first").alias("rally_id"), (F.col("first") / FPS).alias("start"), ((F.col("last") + 1) / FPS).alias("end"))
        return f(op.Search(x, media(x, FPS).select("media_id", "duration"), labels, FPS, width=8.0))

    return query


def _refined(s, d):
    rows, sides = cut(pe._motion(s, d)), []  # numbered once
    hits = rows.where("swing > 0.9").select("media_id", (F.col("idx") / pe.FPS).alias("t"))
    seen = rf.well_covered(rows.withColumns({"motion": F.col("value"), "value": F.col("overhead") + 0.3}), pe.FPS).withColumnRenamed("motion", "value")
    for side in ("start", "end"):  # the columns go along from step to step, so that no samples are joined with themselves
        channels = be.side_channels(seen, side, pe.FPS, 0.2, ("covered",)).withColumn("t", F.col("idx") / pe.FPS)
        scores = rf.joint_scores(be.hit_feature(channels, hits, side, 4.0), None, pe.RANGES | {"hit": (0.25, 1.0)}, pe.WEIGHTS | {"hit": 1.0})
        sides.append(scores.withColumn("side", F.lit(side)))
    evidence = cut(sides[0].unionByName(sides[1]))
    signal = rows.select("media_id", "idx", "value")
    valleys = cut(kernels.quiet_spans(signal, pe.FPS, 0.6, 0.0, 0.10))
    pose = media(signal, pe.FPS).withColumn("pose", F.when(F.col("media_id") % 5 == 0, 0.2).otherwise(0.9))
    out = rf.refined(cut(pe._span_intervals(s, d, rows)), valleys, evidence, pose, pe.FPS, 3.0, 0.05, {"start": 0.4, "end": 0.4})
    return out.select("media_id", "rally_id", *(F.round(c, 6).alias(c) for c in ("start", "end", "start_gain", "end_gain")))


def _stored(s, d):
    """Signals of the suppliers at FPS; two in three also have hits, where their values are high."""
    signal = raw(s, d)
    x = smoothed(signal, 9)
    hits = signal.where("value >= 46 and media_id % 3 > 0").select("media_id", F.col("idx").alias("hit_idx"), (F.col("idx") / FPS).alias("t"), (F.col("value") / 50).alias("strength"), (F.pmod(F.col("idx") * 7, F.lit(10)) / 9.0).alias("confidence"))
    return x, smoothed(signal, 15), cut(hits), cut(media(x, FPS)), covered(x)


def _resegmented(s, d):
    motion, activity, hits, m, cover = _stored(s, d)
    fallback = _above(motion, SEEN).where("score >= 0.1")
    out = rs.resegmented(motion, activity, hits, m, FPS, 3.0, 8.0, cover, fallback, least=1.5, core=0.5, rest=0.3, pre=0.3, post=0.5)
    return out.select("media_id", "method", "n", *(F.round(c, 6).alias(c) for c in ("start", "end", "confidence")))


def _dispatched(hybrid: bool):
    def query(s, d):
        motion, activity, hits, m, _ = _stored(s, d)
        one = lambda x, mark: _above(x, mark).withColumns({"start": F.col("start") * SLOW / FPS, "end": F.col("end") * SLOW / FPS})
        out = rs.dispatched([("player_motion", one(motion, 28.0)), ("activity_valleys", one(activity, 25.0))], cut(rs.hit_density(hits, m, FPS)), FPS, hybrid)
        return out.groupBy("media_id", "method").agg(F.count("*").alias("n"), F.round(F.first("quality"), 6).alias("quality"))

    return query


_WITH = f"""WITH signal AS (
  SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx, l_quantity AS value FROM lineitem),
nn AS (SELECT media_id, count(*) AS n, count(*) / {SLOW}::DOUBLE AS duration FROM signal GROUP BY 1),
sm AS (SELECT *, (sum(value) OVER (r ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + greatest(0, 3 - idx) * first_value(value) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
  + greatest(0, 3 - (n - 1 - idx)) * last_value(value) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 7 AS smooth
  FROM signal JOIN nn USING (media_id) WINDOW r AS (PARTITION BY media_id ORDER BY idx)),
lv AS (SELECT media_id, quantile_cont(value, 0.2) AS base, greatest(quantile_cont(value, 0.95) - quantile_cont(value, 0.2), 1e-9) AS width FROM signal GROUP BY 1),
seg AS (SELECT mark, media_id, min(idx) AS rally_id, min(idx) / {SLOW}::DOUBLE AS start, (max(idx) + 1) / {SLOW}::DOUBLE AS end_, count(*) / 100.0::DOUBLE AS score
  FROM (SELECT *, idx - row_number() OVER (PARTITION BY mark, media_id ORDER BY idx) AS island FROM sm, (SELECT unnest([{SEEN}, {ACTIVE}])::DOUBLE AS mark) WHERE smooth >= mark) GROUP BY mark, media_id, island),
two AS (SELECT media_id FROM seg GROUP BY 1 HAVING count(DISTINCT mark) = 2),
marks AS (SELECT media_id, unnest([0, duration]) AS w0 FROM nn JOIN two USING (media_id) UNION SELECT media_id, unnest([start, end_]) FROM seg JOIN two USING (media_id)),
win AS (SELECT * FROM (SELECT media_id, w0, lead(w0) OVER w AS w1, row_number() OVER w AS span FROM marks WINDOW w AS (PARTITION BY media_id ORDER BY w0)) WHERE w1 - w0 >= 0.2),
rng AS (SELECT *, greatest(lo + 1, least(n, floor(w1 * {SLOW})::BIGINT)) AS hi FROM (SELECT win.*, n, greatest(0, least(n - 1, floor(w0 * {SLOW})::BIGINT)) AS lo FROM win JOIN nn USING (media_id))),
cov AS (SELECT r.media_id, span, avg(CASE WHEN (idx // 40 + r.media_id) % 3 > 0 THEN 1 ELSE 0 END) >= 0.5 AS valid FROM rng r JOIN signal s ON r.media_id = s.media_id AND idx >= lo AND idx < hi GROUP BY 1, 2),
held AS (SELECT mark, w.media_id, span, start, end_, score FROM win w JOIN seg s ON w.media_id = s.media_id AND start <= (w0 + w1) / 2 AND (w0 + w1) / 2 < end_
  QUALIFY row_number() OVER (PARTITION BY mark, w.media_id, span ORDER BY end_ - start DESC, start, rally_id) = 1),
mv AS (SELECT r.media_id, span, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY r.media_id, span ORDER BY idx) <= 1 THEN 0 ELSE 1 END AS fresh
  FROM rng r JOIN signal s ON r.media_id = s.media_id AND idx >= lo AND idx < hi JOIN lv ON lv.media_id = r.media_id WHERE value >= base + 0.25 * width),
burst AS (SELECT DISTINCT media_id, span FROM (SELECT media_id, span, min(idx) AS a, max(idx) AS b, count(*) AS c FROM (SELECT *, sum(fresh) OVER (PARTITION BY media_id, span ORDER BY idx) AS k FROM mv) GROUP BY media_id, span, k)
  WHERE b - a >= {1.2 * SLOW} AND c / (b - a + 1) >= 0.35),
src AS (SELECT win.*, CASE WHEN NOT coalesce(valid, false) THEN 'activity_valleys' WHEN m.span IS NOT NULL THEN 'player_motion' WHEN b.span IS NOT NULL THEN 'rescued' END AS source, m.start AS ms, m.end_ AS me, m.score AS mc, t.start AS ts, t.end_ AS te, t.score AS tc
  FROM win LEFT JOIN cov USING (media_id, span) LEFT JOIN held m ON m.mark = {SEEN} AND m.media_id = win.media_id AND m.span = win.span
  LEFT JOIN held t ON t.mark = {ACTIVE} AND t.media_id = win.media_id AND t.span = win.span LEFT JOIN burst b ON b.media_id = win.media_id AND b.span = win.span),
tk AS (SELECT media_id, span, w0, w1, source, CASE source WHEN 'player_motion' THEN ms WHEN 'rescued' THEN ts WHEN 'activity_valleys' THEN ts END AS s, CASE source WHEN 'player_motion' THEN me WHEN 'rescued' THEN te WHEN 'activity_valleys' THEN te END AS e,
  CASE source WHEN 'player_motion' THEN mc WHEN 'rescued' THEN tc WHEN 'activity_valleys' THEN tc END AS score FROM src),
ch AS (SELECT media_id, span, w0, w1, CASE WHEN s IS NULL THEN 'empty' ELSE source END AS source, CASE WHEN s IS NOT NULL THEN greatest(w0, s) END AS start, CASE WHEN s IS NOT NULL THEN least(w1, e) END AS end_, score FROM tk)
"""

ALL = {
    "sg_player": (_cut(sg.by_motion, coverage=True), None),
    "sg_activity": (_cut(sg.by_activity), None),
    "sg_refine": (_refined, None),
    "sg_dispatch": (_dispatched(False), None),
    "sg_dispatch_hybrid": (_dispatched(True), None),
    "en_reseg": (_resegmented, None),
    "opt_predict": (_search(lambda x: x.predicted(x.base(least=1.5, core=0.5)).select("media_id", "rally_id", *(F.round(c, 6).alias(c) for c in ("start", "end", "score")))), None),
    "opt_stages": (_search(lambda x: op.optimised(x, VALUES, FIELDS)), None),
    "en_sweep": (_search(lambda x: op.swept(x)), None),
    "sg_avail_windows": (
        _chosen(lambda *a: sg.chosen_windows(*a).groupBy("media_id", "source").agg(F.count("*").alias("n"), F.round(F.sum(F.col("w1") - F.col("w0")), 6).alias("seconds"))),
        _WITH + "SELECT media_id, source, count(*) AS n, round(sum(w1 - w0), 6) AS seconds FROM ch GROUP BY 1, 2",
    ),
    "sg_merge_avail": (
        _chosen(sg.by_availability),
        _WITH
        + """, o AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY start, span) AS island FROM (SELECT *, CASE WHEN start - max(end_) OVER (PARTITION BY media_id ORDER BY start, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 0.3 THEN 0 ELSE 1 END AS fresh FROM ch WHERE source <> 'empty'))
SELECT media_id, min(start) AS start, max(end_) AS "end", max(score) AS score FROM o GROUP BY media_id, island HAVING max(end_) - min(start) >= 1.0
UNION ALL SELECT media_id, start, end_, score FROM seg WHERE media_id NOT IN (SELECT media_id FROM two)""",
    ),
}
