import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import files
from tidemark.streaming import twins

SF = "/root/testdata/sf0.001"


def _streamed(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return df.sparkSession.table(name)


def test_hopping_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = twins.hopping_counts(twins.arriving(spark, str(tmp_path / "events"), events.schema, "1000 days"), "2 hours", "1 hour")
    got = _streamed(stream, "hopping", "complete")
    want = twins.hopping_counts(twins.with_time(events), "2 hours", "1 hour")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def _turned_by_loops(rows, lo, hi, forget):
    """rows are (media_id, us, event_id, strength)."""
    out, on, last = [], {}, {}
    for m, us, _, x in sorted(rows, key=lambda r: r[:3]):
        if m in last and us - last[m] > forget * 1e6:
            on[m] = False
        last[m] = us
        says = True if x >= hi else False if x < lo else on.get(m, False)
        if says != on.get(m, False):
            on[m] = says
            out.append((m, us, says))
    return sorted(out)


@pytest.mark.parametrize("forget", [3e4, 1e9])
def test_turns_of_stored_events(spark, forget):
    events = twins.with_time(spark.read.parquet(f"{SF}/events.parquet"))
    rows = [(r.media_id, r.us, r.event_id, r.strength) for r in events.select("*", F.unix_micros("ts").alias("us")).collect()]
    got = sorted(map(tuple, twins.turns(events.repartition(3), 0.1, 0.4, forget).collect()))
    assert got == _turned_by_loops(rows, 0.1, 0.4, forget) and len(got) > 20
    with pytest.raises(ValueError):
        twins.turns(events, 0.5, 0.4, forget)


def test_turns_of_a_stream_in_disorder_are_those_of_its_events_in_order(spark, tmp_path, rocksdb):
    """Three files hold the events at random, all within the delay; a last one brings one event behind the watermark."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    top = events.agg(F.max("ts")).first()[0]
    folder = str(tmp_path / "events")
    events.where("event_id % 3 > 0").coalesce(1).write.parquet(folder)
    events.where("event_id % 3 = 0").coalesce(1).write.mode("append").parquet(folder)
    end = lambda user, days: events.limit(1).select(*[F.lit(user).cast("long").alias(c) if c == "user_id" else F.timestamp_add("DAY", F.lit(days), F.lit(top)).cast(events.schema["ts"].dataType).alias(c) if c == "ts" else c for c in events.columns])
    run = lambda: _kept(twins.turns_stream(twins.arriving(spark, folder, events.schema, "60 days"), 0.1, 0.4, 1e9), tmp_path)
    for days in (100, 200):
        end(-1, days).coalesce(1).write.mode("append").parquet(folder)
        run()
    end(1, -10).withColumn("value", F.lit(500.0)).coalesce(1).write.mode("append").parquet(folder)
    run()
    rows = [(r.media_id, r.us, r.event_id, r.strength) for r in twins.with_time(events).select("*", F.unix_micros("ts").alias("us")).collect()]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.media_id >= 0)
    assert got == _turned_by_loops(rows, 0.1, 0.4, 1e9)


def _kept(stream, tmp_path):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None


def test_projects_with_and_without_sidecars_and_broken_documents(spark, tmp_path):
    (tmp_path / "p").mkdir(), (tmp_path / "s").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps({"project_id": "a", "name": "A", "media": [{"media_id": "m1"}, {"media_id": "m2"}]}))
    (tmp_path / "p" / "b.json").write_text("{ broken")
    (tmp_path / "s" / "m1.json").write_text(json.dumps({"media_id": "m1", "status": "done", "rallies": [{"start": 1.0, "end": 2.0}]}))
    got = {r.media_id: r.status for r in files.projects(spark, str(tmp_path / "p"), str(tmp_path / "s")).collect()}
    assert got == {"m1": "done", "m2": None}


def test_sound_is_the_mean_of_its_channels(spark, tmp_path):
    x = (np.sin(np.arange(2000) / 9) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(8000)
        f.writeframes(np.stack([x, np.zeros_like(x)], axis=1).tobytes())
    rows = files.sounds(spark, str(tmp_path), 700).orderBy("at").collect()
    assert [r["at"] for r in rows] == [0, 700, 1400] and rows[0].rate == 8000
    assert np.allclose(np.concatenate([r.samples for r in rows]), x / 2**16)


def test_only_the_partitions_written_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4).select("id", F.pmod("id", F.lit(2)).alias("k"))
    files.write_partitioned(rows, path, "k")
    files.write_partitioned(rows.where("k = 1").withColumn("id", F.col("id") + 10), path, "k")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 11, 13]


def _held_by_loops(rows, silence, half, share):
    """(media_id, us, event_id) to excess, run by run."""
    out, runs = {}, []
    for m, us, e, x in sorted(rows):
        if not runs or runs[-1][-1][0] != m or us - runs[-1][-1][1] > silence * 1e6:
            runs.append([])
        runs[-1].append((m, us, e, x))
    size = 2 * half + 1
    for run in runs:
        if len(run) < size:
            continue
        for i in range(half, len(run)):
            at = min(i - half, len(run) - size)
            out[run[i][:3]] = run[i][3] - np.percentile([r[3] for r in run[at : at + size]], share * 100)
    return out


def _ring_rows(seed):
    rng, rows, e = np.random.default_rng(seed), [], 0
    for m in range(6):
        us = 0
        for _ in range([0, 3, 7, 8, 40, 90][m]):
            us += int(rng.choice([0, 1, 2, 5, 30])) * 1_000_000 + int(rng.integers(0, 3)) * 250
            e += 1
            rows.append((m, us, e, float(rng.choice([0.0, 1.0, rng.random()]))))
    return rows


def _ring_frame(spark, rows):
    return spark.createDataFrame(rows, "media_id long, us long, event_id long, strength double").select("media_id", F.timestamp_micros("us").alias("ts"), "event_id", "strength")


def test_rings_of_stored_events(spark):
    rows = _ring_rows(1)
    df = _ring_frame(spark, rows).union(spark.createDataFrame([(4, None, 999, 1.0)], "media_id long, ts timestamp, event_id long, strength double"))
    got = {(r.media_id, r.us, r.event_id): r.excess for r in twins.against_ring(df.repartition(3), 20.0, 3).collect()}
    want = _held_by_loops(rows, 20.0, 3, 0.85)
    assert got.keys() == want.keys() and want and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert twins.against_ring(df.where("media_id < 0"), 20.0, 3).count() == 0


def test_rings_of_a_stream_with_late_rows_and_a_restart(spark, tmp_path, rocksdb):
    """Files come in disorder within the watermark's delay; a row behind it is ignored; the second half comes to a query restarted from its checkpoint."""
    rows = _ring_rows(2)
    rows.sort(key=lambda r: (r[1], r[2]))
    top = max(r[1] for r in rows)
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    for a, b in zip(parts, parts[1:]):  # neighbours swap an event
        a[-1], b[0] = b[0], a[-1]
    late = (5, 1, 100_000, 5.0)
    parts[-1] = [*parts[-1], late]
    ends = [[(77, top + k * 600_000_000, 200_000 + k, 0.0)] for k in (1, 2)]
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "media_id long, ts timestamp, event_id long, strength double"

    def add(n, part):
        _ring_frame(spark, part).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (file,) = (tmp_path / f"w{n}").glob("*.parquet")
        file.rename(folder / f"{n:03d}.parquet")

    def run():
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", "90 seconds")
        _kept(twins.ring_stream(src, 20.0, 3), tmp_path)

    half = len(parts) // 2
    for n, part in enumerate(parts[:half]):
        add(n, part)
    run()
    for n, part in enumerate(parts[half:] + ends):
        add(half + n, part)
    run()
    got = [((r.media_id, r.us, r.event_id), r.excess) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = _held_by_loops(rows, 20.0, 3, 0.85)
    assert len(got) == len(dict(got)) and dict(got).keys() == want.keys()
    assert all(abs(x - want[k]) < 1e-9 for k, x in got)
