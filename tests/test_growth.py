"""What large tables need: no call or frame for each small group, no frame that is read anew at each row, no pairs beyond those that meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence as ed
from tidemark.operators import intervals as iv
from tidemark.operators import kernels
from tidemark.operators import labels as lb
from tidemark.operators import lineage, optimise, resegment
from tidemark.operators import segmentation as sg
from tidemark.operators import series as se
from tidemark.operators import spans as sp
from tidemark.operators import timeline as tl
from tidemark.operators import tracks as tr
from tidemark.plans import catalog, fusion, segmentation


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def hits(spark, n=50):
    return spark.range(n).select((F.col("id") % 7).alias("media_id"), F.col("id").alias("hit_idx"), (F.col("id") * 10.0).alias("t"), F.lit(0.5).alias("strength"), F.lit(0.5).alias("confidence"))


def rallies(spark, n=50):
    return spark.range(n).select((F.col("id") % 7).alias("media_id"), F.col("id").alias("rally_id"), (F.col("id") * 3.0).alias("start"), (F.col("id") * 3.0 + 2).alias("end"))


def signal(spark, n=50):
    return spark.range(n).select((F.floor(F.col("id") / 100000) + 1).alias("media_id"), F.col("id").alias("idx"), (F.col("id") % 9).cast("double").alias("value"))


@pytest.mark.parametrize("kernel", ["thinned", "longest", "matched", "cut_overlaps", "linked", "quiet_spans", "quiet_by", "split_at_quiet"])
def test_small_groups_cost_no_call_each(spark, capsys, kernel):
    h, r, x = hits(spark), rallies(spark), signal(spark)
    points = h.select("media_id", F.col("hit_idx").alias("frame"), F.col("hit_idx").alias("point"), F.col("t").alias("x"), F.col("t").alias("y"), F.lit(0.1).alias("score"))
    held = x.withColumns({"span": F.col("idx") % 3, "start": F.lit(0.0), "end": F.lit(4.0), "apart": F.lit(0.5), "ratio": F.lit(0.1), "core": F.lit(1.0)})
    made = {
        "thinned": lambda: kernels.thinned(h, 2.0), "longest": lambda: kernels.longest_of_overlapping(r), "matched": lambda: kernels.matched(r.select("media_id", "rally_id", F.col("rally_id").alias("other_id"), F.lit(0.5).alias("iou"))),
        "cut_overlaps": lambda: kernels.cut_overlaps(r, h), "linked": lambda: tr.linked(points, 4.0, 400.0, 3), "quiet_spans": lambda: kernels.quiet_spans(x, 4.0, 0.5, 0.0, 0.1),
        "quiet_by": lambda: kernels.quiet_by(x, x.select("media_id", F.lit(0.5).alias("apart"), F.lit(0.1).alias("ratio")), 4.0), "split_at_quiet": lambda: kernels.split_at_quiet(held, 4.0),
    }[kernel]()
    assert "GroupsInPandas" not in plan(made, capsys)
    made.count()


def test_groups_that_go_on_over_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(6)]), rng.choice([None, 0, 1]), i, rng.random()) for i in range(300)]
    groups = {}
    for a, b, i, x in rows:
        groups.setdefault((a, b), []).append((x, i))
    want = {(a, b, i, len(g), x) for (a, b), g in groups.items() for x, i in sorted(g)[::2]}

    def every_other(c, lo, hi):
        for i in range(lo, hi, 2):
            yield i, hi - lo, float(c["x"][i])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = kernels.walked(spark.createDataFrame(rows, "a long, b long, i long, x double"), ("a", "b"), ["x"], ["a", "b", "i"], every_other, n="long", y="double").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("window", ["fill", "nearest_frame", "hit_feature", "next_after", "around"])
def test_frames_only_grow(spark, capsys, window):
    h, r, x = hits(spark), rallies(spark), signal(spark)
    marks = h.select("media_id", F.col("t").alias("u"))
    made = {
        "fill": lambda: se.fill(x, "value"), "nearest_frame": lambda: sp.nearest_frame(h, marks, 5.0), "next_after": lambda: tl.next_after(r, 1.0),
        "hit_feature": lambda: ed.hit_feature(x.withColumn("t", F.col("idx") / 4), h, "start", 4.0), "around": lambda: lb.around(r.withColumn("at", F.col("start")), valley=marks),
    }[window]()
    assert "unboundedfollowing" not in plan(made, capsys)


@pytest.mark.parametrize("n", range(1, 12))
def test_resampled_lengths(spark, n):
    x = [(1, i, float(i * i % 7)) for i in range(n)]
    got = {r.i: r.value for r in se.resample(spark.createDataFrame(x, "media_id long, idx long, value double"), 12.0, 8.0).collect()}
    at = [min(i * 1.5, n - 1.0) for i in range(int(n * (8.0 / 12.0)))]
    assert got == pytest.approx(dict(enumerate(np.interp(at, range(n), [v for *_, v in x]))))


def test_resampling_joins_nothing(spark, capsys):
    assert "Join" not in plan(se.resample(signal(spark), 12.0, 8.0), capsys)


def test_samples_meet_the_spans_near_them(spark):
    n = 3000
    spans = spark.range(n // 10).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("span"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 9).alias("hi"))
    pairs = signal(spark, n).withColumn("bin", F.floor(F.col("idx") / iv.SPAN)).join(iv.binned(spans, iv.SPAN, "lo", "hi"), ["media_id", "bin"])
    assert pairs.count() < 10 * n
    assert sg.samples_in(spans, signal(spark, n)).count() == n - n // 10


def test_an_audit_broadcasts_nothing(spark, capsys):
    r = rallies(spark)
    marks = hits(spark).select("media_id", F.col("t").alias("u"), F.lit(0.5).alias("depth"))
    notes = lb.audit(r, marks, marks, signal(spark), 4.0)
    assert "Broadcast" not in plan(lb.severities(r, notes), capsys)


def test_an_audit_of_several_signals_reads_each_sample_once(spark, capsys):
    r, x = spark.createDataFrame([(1, 1, 4.0, 8.0)], "media_id long, rally_id long, start double, end double"), signal(spark, 60)
    x = x.withColumn("value", F.when(F.col("idx").between(16, 31), 0.0).otherwise(9.0))
    none = x.where("false").select("media_id", F.lit(0.0).alias("u"), F.lit(0.0).alias("depth"))
    many = x
    for k in (1.0, 2.0):
        many = many.union(x.withColumn("value", F.col("value") + k))
    got = {(n.code, n.side): n.distance for n in lb.audit(r, none, none, many, 4.0).collect()}
    assert got == {("evidence_contradiction", s): round(-9.0 / float(np.ptp(np.percentile(np.r_[[v + k for v in [0.0] * 16 + [9.0] * 44 for k in (0, 1, 2)]], [20, 95]))), 3) for s in ("start", "end")}


def test_a_long_person_is_not_kept_whole():
    box = np.array([[0.4, 0.4, 0.5, 0.6]] * 8)
    person = tr._Fragments(np.arange(8) / 2, box)
    for k in range(1, 400):
        new = tr._Fragments(4.0 * k + np.arange(8) / 2, box)
        assert person.goes_on_as(new, 1.78)
        person.take(new)
        person.forget(new.t[0])
    assert person.n == 3200 and len(person.t) < 20


def test_a_fragment_is_compared_with_those_near_it_alone(monkeypatch):
    """Tracks that are seen again long after don't end for all those between."""
    asked, fits, rnd = [], tr._Fragments.goes_on_as, random.Random(5)
    monkeypatch.setattr(tr._Fragments, "goes_on_as", lambda self, new, aspect: asked.append(1) or fits(self, new, aspect))
    tracks = []
    for k in range(300):
        t = np.r_[k + np.arange(rnd.randint(1, 6)) / 2, 9000.0 + k + np.arange(3) / 2]
        x = np.array([[rnd.choice([0.2, 0.5]) + rnd.uniform(-0.02, 0.02), 0.4] for _ in t])
        tracks.append((t, np.c_[x, x + 0.1]))
    people, got = tr._People(), []
    for k, (t, box) in enumerate(tracks):
        got.append(people.person(k, tr._Fragments(t, box), 1.78))
    near = len(asked)
    every, want = [], []
    for k, (t, box) in enumerate(tracks):
        new = tr._Fragments(t, box)
        hit = next(((p, old) for p, old in every if fits(old, new, 1.78)), None)
        hit[1].take(new) if hit else every.append((k, new))
        want.append(hit[0] if hit else k)
    assert got == want and len(set(got)) < 300 and near < 10 * 300


def test_tables_that_take_little_in_a_file_are_not_broadcast(spark, capsys):
    """Two million rows of a few bytes each would take 100 MB of the driver."""
    rows = lineage.cut(spark.range(2000000).select(F.floor(F.col("id") / 200000).alias("media_id"), F.col("id").alias("idx"), (F.col("id") % 9).alias("n"), (F.col("id") % 5).alias("k")))
    assert rows.count() == 2000000 and rows.where("n <> idx % 9").count() == 0
    other = spark.range(50000000).select((F.col("id") % 9).alias("media_id"), F.col("id").alias("idx"))
    assert "Broadcast" not in plan(other.join(rows, ["media_id", "idx"]), capsys)
    few = lineage.cut(rows.where("idx < 1000"))
    assert "Broadcast" in plan(other.join(few, ["media_id", "idx"]), capsys)


def test_samples_near_spans_are_not_made_up(spark, capsys):
    spans = spark.range(100).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("span"), (F.col("id") * 100).alias("lo"))
    known = signal(spark, 10000).where("idx % 300 < 5")
    near = sg.near_known(spans, known, 9, [F.col("lo"), F.col("lo") + 12])
    assert {r.span for r in near.collect()} == set(range(0, 100, 3)) and "sequence" not in plan(near, capsys)


@pytest.mark.parametrize("name", ["en_reseg", "opt_predict", "opt_stages", "sg_activity", "sg_avail_windows", "sg_dispatch", "sg_dispatch_hybrid", "sg_merge_avail", "sg_segment"])
def test_samples_are_numbered_once(spark, capsys, monkeypatch, name):
    """Each read of the table sorts all samples anew."""
    plans = []
    for module in (fusion, segmentation, sg, optimise, resegment):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", lambda df: plans.append(plan(df, capsys)) or lineage.cut(df))
    plans.append(plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"), capsys))
    assert sum(p.count("lineitem.parquet") for p in plans) == (2 if name == "sg_segment" else 1)  # once for the weights


def test_refining_joins_no_samples_with_themselves(spark, capsys, monkeypatch):
    plans = []
    monkeypatch.setattr(segmentation, "cut", lambda df: plans.append(plan(df, capsys)) or lineage.cut(df))
    plans.append(plan(catalog.queries()["sg_refine"](spark, "/root/testdata/sf0.001"), capsys))
    assert sum(p.count("lineitem.parquet") for p in plans) == 1
    scores = [p for p in plans if "overhead" in p and "lineitem" not in p]
    assert len(scores) == 1 and "Join" not in scores[0]
