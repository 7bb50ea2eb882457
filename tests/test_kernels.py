import random

import numpy as np
import pytest

from tidemark.functions import scalars
from tidemark.operators import kernels, records
from pyspark.sql import functions as F


def _hits(seed, n=40, media=3):
    r = random.Random(seed)
    return [(m, m * 1000 + i, round(r.uniform(0, 30), 2), round(r.random(), 1), round(r.random(), 1)) for m in range(media) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_thinned_hits_are_the_greedy_choice(spark, seed):
    rows = _hits(seed)
    want = set()
    for m in {r[0] for r in rows}:
        kept = []
        for r in sorted([r for r in rows if r[0] == m], key=lambda r: (-(r[3] * (0.5 + 0.5 * r[4])), r[1])):
            if all(abs(r[2] - k[2]) >= 0.5 for k in kept):
                kept.append(r)
        want |= {k[1] for k in kept}
    got = kernels.thinned(spark.createDataFrame(rows, kernels.HIT), 0.5)
    assert {r.hit_idx for r in got.collect()} == want


def test_peaks_of_plateaus_and_neighbours():
    assert kernels.peaks(np.array([0, 2, 2, 2, 0, 1, 0.0]), 1, 0.5) == [2, 5]
    assert kernels.peaks(np.array([0, 2, 0, 3, 0.0]), 3, 0.5) == [3]
    assert kernels.peaks(np.array([0, 5, 4, 4.2, 4, 0.0]), 1, 0.5) == [1]
    assert kernels.peaks(np.array([1.0]), 1, 0.1) == [] == kernels.peaks(np.zeros(0), 1, 0.1)


def test_small_gaps_are_not_split_and_large_ones_are_in_their_middle(spark):
    times = [0.5 + 0.6 * i for i in range(50)] + [35 + 0.6 * i for i in range(26)]
    hits = spark.createDataFrame([(1, t) for t in times] + [(2, t) for t in (0.5, 20.0)], "media_id long, t double")
    spans = spark.createDataFrame([(1, 1, 0.0, 50.0), (2, 2, 0.0, 25.0)], "media_id long, rally_id long, start double, end double")
    got = sorted((r.media_id, round(r.start, 2), round(r.end, 2)) for r in kernels.split_at_gaps(spans, hits, 3.0, 2, 2.0).collect())
    assert len(got) == 3 and got[2] == (2, 0.0, 25.0) and 29 <= got[0][2] <= 35 and got[0][2] == got[1][1]


def test_overlaps_are_cut_and_short_rests_go(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 8.0, 20.0), (1, 3, 19.9, 20.2)], "media_id long, rally_id long, start double, end double")
    none = spark.createDataFrame([], "media_id long, t double")
    got = [(r.rally_id, r.start, r.end) for r in kernels.cut_overlaps(spans, none).orderBy("start").collect()]
    assert got[0] == (1, 0.0, 9.0) and got[1][0] == 2 and len(got) == 2


def test_greedy_matches_are_one_to_one(spark):
    pairs = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 5, 0.8), (1, 2, 6, 0.3), (1, 1, 6, 0.85)], "media_id long, rally_id long, other_id long, iou double")
    assert sorted((r.rally_id, r.other_id) for r in kernels.matched(pairs).collect()) == [(1, 5), (2, 6)]


def test_of_events_within_reach_the_surer_stays(spark):
    rows = [(1, 12.0, "b", 1.0), (1, 12.3, "r", 0.9), (1, 12.6, "r", 0.5), (1, 20.0, "r", 0.8)]
    got = kernels.merged_events(spark.createDataFrame(rows, "media_id long, t double, phrase string, prob double"), 1.5)
    assert sorted(r.t for r in got.collect()) == [12.0, 20.0]


def test_of_overlapping_intervals_the_longer_stays(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 3.0, 9.0), (1, 3, 9.0, 10.0)], "media_id long, rally_id long, start double, end double")
    assert sorted(r.rally_id for r in kernels.longest_of_overlapping(spans).collect()) == [2, 3]


def test_tempo_factors_multiply_to_the_speed(spark):
    for speed in (0.1, 0.5, 1.0, 3.0, 9.0):
        chain = spark.range(1).select(scalars.tempo_chain(F.lit(speed)).alias("c")).first().c
        assert np.isclose(np.prod(chain), speed) and all(0.5 - 1e-9 <= c <= 2 + 1e-9 for c in chain)


def test_upserts_keep_what_new_rows_do_not_know(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", None)], "k long, x string, y int")
    assert sorted(map(tuple, records.upserted(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", None)]
