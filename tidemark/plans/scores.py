"""Queries that score and tag intervals, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import scoring as sc
from tidemark.sources import tables as tb

SCORES = [*sc.PARTS, "total"]


def rounded(df, *columns, to=6):
    return df.select(*[F.round(c, to).alias(c) if c in columns else F.col(c) for c in df.columns])


def _f(f):
    return lambda s, d: f(tb.scored_rallies(s, d))


_FEATURED = (
    """WITH base AS (SELECT o_custkey AS media_id, o_orderkey AS rally_id, o_totalprice / 10000 AS duration, (o_orderkey % 29)::INT AS shots,
  ((o_orderkey * 7) % 101) / 100e0 AS speed, ((o_orderkey * 3) % 97) / 96e0 AS confidence FROM orders),
rallies AS (SELECT *, """
    + ", ".join(f"{v} AS {k}" for k, v in tb.FEATURES.items())
    + " FROM base)"
)


def _capped(x, top, cap):
    return f"least({cap}e0, greatest(0e0, {x} / ({top} + 1e-9))) / {cap}e0"


def _over(x, top):
    return f"least(1e0, greatest(0e0, {x} / greatest({top}, 1e0)))"


def _unit(x):
    return f"100 * least(1e0, greatest(0e0, {x}))"


def _scores(batch: str) -> str:
    """Statements that end in x (of every preset); batch: the columns after GROUP BY, or nothing."""
    measures = ", ".join(f"quantile_cont({c}, {q}) AS {name}" for name, c, q in sc.MEASURES)
    names = ", ".join(["preset", *(f"w_{p}" for p in sc.PARTS), "ss", "ds"])
    join = f"JOIN q USING ({batch})" if batch else "CROSS JOIN q"
    strength, presence = _capped("strength_p90", "strength_85", 1.2), _capped("presence", "presence_85", 1.2)
    length = _unit("0.62e0 * (1 - exp(-shots / greatest(0.55e0 * ss, 1))) + 0.38e0 * (1 - exp(-duration / greatest(0.55e0 * ds, 1)))")
    intensity = _unit(f"0.38e0 * {_capped('speed', 'speed_85', 1.2)} + 0.22e0 * {_capped('motion_peak', 'motion_85', 1.2)} + 0.18e0 * {_capped('tempo', 'tempo_85', 1.2)} + 0.22e0 * {_capped('finish_tempo', 'finish_85', 1.3)}")
    technique = f"CASE WHEN has_shuttle THEN {_unit(f'0.42e0 * {_capped("shuttle_speed", "shuttle_85", 1.2)} + 0.34e0 * {strength} + 0.24e0 * {presence}')} ELSE {_unit(f'0.55e0 * {strength} + 0.45e0 * {presence}')} END"
    highlight = _unit(f"0.40e0 * {_over('smashes', 'smashes_90')} + 0.35e0 * {_over('streak', 'streak_90')} + 0.25e0 * {_over('tempo_variance', 'variance_90')}")
    production = f"CASE WHEN sharpness IS NULL THEN 70e0 ELSE {_unit('0.45e0 * least(1, greatest(0, sharpness)) + 0.25e0 * (1 - least(1, greatest(0, shake))) + 0.30e0 * least(1, greatest(0, subject_size / 0.35e0))')} END"
    surge = "least(1e0, greatest(0e0, (finish_tempo - finish_50) / (finish_90 - finish_50 + 1e-9)))"
    excitement = _unit(f"0.30e0 * length / 100 + 0.30e0 * intensity / 100 + 0.20e0 * {surge} + 0.20e0 * least(1e0, greatest(0e0, (shots - 6e0) / 14e0))")
    total = " + ".join(f"w_{p} * {p}" for p in sc.PARTS)
    return f"""{_FEATURED}, pre({names}) AS (VALUES {", ".join(str((p[0], *p[1:])) for p in sc.PRESETS)}),
q AS (SELECT {batch + ", " if batch else ""}{measures}, max(shuttle_speed) > 0 AS has_shuttle FROM rallies{" GROUP BY " + batch if batch else ""}),
p AS (SELECT *, {length} AS length, {intensity} AS intensity, {technique} AS technique, {highlight} AS highlight, {production} AS production FROM rallies {join} CROSS JOIN pre),
e AS (SELECT *, {excitement} AS excitement FROM p),
x AS (SELECT *, ({total}) * (0.75e0 + 0.25e0 * least(1, greatest(0, confidence))) + coalesce(speech_bonus, 0) AS raw FROM e)"""


_ROUNDED = ", ".join(f"round({p}, 6) AS {p}" for p in sc.PARTS) + ", round(least(100, greatest(0, raw)), 6)::DOUBLE AS total"
_RULES = [("ultra_long_rally", "shots >= 20"), ("many_shots", "shots >= 12 AND shots < 20"), ("fast_tempo", "tempo >= 1.5"), ("late_acceleration", "finish_tempo >= 1.8 AND shots >= 6"), ("high_mobility", "motion_peak >= 0.72"), ("fast_shuttle", "shuttle_speed >= 0.55"), ("long_rally", "duration >= 25"), ("short_rally", "duration <= 5.5"), ("high_score", "raw >= 75"), ("low_confidence", "confidence < 0.35"), ("smash", "smashes >= 2"), ("confrontation", "streak >= 6"), ("highlight", "raw >= 70 AND (smashes >= 1 OR streak >= 4)")]
_TAGS = "list_concat(list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _RULES) + "], lambda x: x IS NOT NULL), CASE WHEN rally_id % 20 = 0 AND smashes < 2 THEN ['nice', 'smash'] WHEN rally_id % 10 = 0 THEN ['nice'] ELSE [] END)"
_BALANCED = "preset = 'balanced'"


def _old_tags(df):
    """Tags as older projects have them: the first legacy name, a code, the legacy name again, an unknown one."""
    old = F.array(*[F.lit(x) for x in sc.LEGACY_TAGS])
    at = lambda k: F.element_at(old, (F.pmod(F.col("rally_id") * k, F.lit(len(sc.LEGACY_TAGS))) + 1).cast("int"))
    return df.select("rally_id", F.array(at(1), F.lit("smash"), at(3), at(1), F.lit(""), F.lit("own")).alias("tags"))


ALL = {
    "segment_score": (
        _f(lambda x: rounded(sc.scores(x, ["media_id"]).select("media_id", "rally_id", "preset", *SCORES), *SCORES)),
        f"{_scores('media_id')} SELECT media_id, rally_id, preset, {_ROUNDED} FROM x",
    ),
    "sc_rescore_cross": (
        _f(lambda x: rounded(sc.scores(x, []).where(_BALANCED).select("rally_id", *SCORES), *SCORES)),
        f"{_scores('')} SELECT rally_id, {_ROUNDED} FROM x WHERE {_BALANCED}",
    ),
    "sc_tags": (
        _f(lambda x: sc.tagged(sc.scores(x, ["media_id"]).where(_BALANCED)).select("media_id", "rally_id", F.array_join("tags", ",").alias("tags"))),
        f"{_scores('media_id')} SELECT media_id, rally_id, array_to_string({_TAGS}, ',') AS tags FROM x WHERE {_BALANCED}",
    ),
    "ag_tagcounts": (
        _f(lambda x: sc.tagged(sc.scores(x, ["media_id"]).where(_BALANCED)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).withColumn("nth", F.row_number().over(W.orderBy(F.desc("n"), "tag"))).where("nth <= 12 or tag in ('smash', 'nice')").drop("nth")),
        f"{_scores('media_id')}, t AS (SELECT unnest({_TAGS}) AS tag FROM x WHERE {_BALANCED}), n AS (SELECT tag, count(*) AS n FROM t GROUP BY 1) SELECT tag, n FROM n QUALIFY row_number() OVER (ORDER BY n DESC, tag) <= 12 OR tag IN ('smash', 'nice')",
    ),
    "flt_rally": (
        _f(lambda x: rounded(sc.tagged(sc.scores(x, ["media_id"]).where(_BALANCED)).where(F.col("total").between(20, 90) & F.col("duration").between(3, 30) & (F.col("shots") >= 4) & (F.col("confidence") >= 0.2) & F.arrays_overlap("tags", F.array(F.lit("fast_tempo"), F.lit("many_shots")))).select("media_id", "rally_id", "duration", "shots"), "duration")),
        f"{_scores('media_id')} SELECT media_id, rally_id, round(duration, 6) AS duration, shots FROM x WHERE {_BALANCED} AND least(100, greatest(0, raw)) BETWEEN 20 AND 90 AND duration BETWEEN 3 AND 30 AND shots >= 4 AND confidence >= 0.2 AND (tempo >= 1.5 OR (shots >= 12 AND shots < 20))",
    ),
    "sc_migrate": (
        lambda s, d: _old_tags(tb.rallies(s, d)).select("rally_id", F.array_join(sc.migrated(F.col("tags")), ",").alias("tags")),
        "WITH m(i, code) AS (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(sc.LEGACY_TAGS.values())) + f") SELECT o_orderkey AS rally_id, a.code || ',smash' || CASE WHEN b.code <> a.code THEN ',' || b.code ELSE '' END || ',own' AS tags FROM orders JOIN m a ON a.i = o_orderkey % {len(sc.LEGACY_TAGS)} JOIN m b ON b.i = o_orderkey * 3 % {len(sc.LEGACY_TAGS)}",
    ),
}
