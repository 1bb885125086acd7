"""Streaming results equal the batch operators on the same rows."""

import datetime as dt
import time

import numpy as np

from eventide.core.series import Series
from eventide.operators import events as ev
from eventide.streaming import events as se

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(spark, tmp_path, rows, schema, build, name):
    src = str(tmp_path / f"{name}-in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = (
        build(stream).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_bouts_equal_batch(spark, tmp_path):
    times = [0, 0.5, 1.0, 5, 9, 9.2, 9.4, 10.4, 500]
    rows = [("a", at(t)) for t in times]
    got = run(spark, tmp_path, rows, "k string, ts timestamp", lambda s: se.bouts(s, ["k"], max_gap="1 second"), "bouts")
    batch = spark.createDataFrame([("a", float(t)) for t in times], "k string, t double")
    want = ev.bouts(batch, Series(("k",), "t", 2.0), max_gap=1.0, min_count=3)
    assert sorted(((r.onset - T0).total_seconds(), (r.offset - T0).total_seconds(), r.n) for r in got) == sorted(
        (r.onset_t, r.offset_t, r.n) for r in want.collect()
    )


def test_tumbling_and_sliding(spark, tmp_path):
    rows = [("a", at(60 * m), float(m)) for m in (0, 10, 59, 61, 500)]
    schema = "k string, ts timestamp, value double"
    got = run(spark, tmp_path, rows, schema, lambda s: se.tumbling_counts(s, ["k"]), "bins")
    assert {(r.start - T0).total_seconds() / 3600: (r.n, r.total) for r in got} == {0.0: (3, 69.0), 1.0: (1, 61.0)}
    got = run(spark, tmp_path, rows, schema, lambda s: se.sliding_mean(s, ["k"], width="20 minutes", slide="20 minutes"), "means")
    assert {(r.start - T0).total_seconds() / 60: r["mean"] for r in got} == {0.0: 5.0, 40.0: 59.0, 60.0: 61.0}


def test_first_after_reference(spark, tmp_path):
    schema = "k string, ts timestamp, kind string"
    rows = [("a", at(10), "r"), ("a", at(29), "e"), ("a", at(12), "e"), ("a", at(40), "e"), ("b", at(50), "r"), ("b", at(75), "e"),
            ("a", at(60), "r"), ("a", at(60), "e"), ("z", at(900), "r"), ("z", at(901), "e")]

    def build(s):
        return se.first_after_reference(s.filter("kind = 'r'"), s.filter("kind = 'e'"), "k")

    got = run(spark, tmp_path, rows, schema, build, "pairs")
    assert sorted((r.k, (r.ref_ts - T0).total_seconds(), (r.event_ts - T0).total_seconds()) for r in got) == [
        ("a", 10.0, 12.0), ("a", 60.0, 60.0)]


def test_pulses_take_late_samples_in_order(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(c, i * 0.5, float(rng.choice([0.0, 5.0]))) for c in "cd" for i in range(120)]
    rows += [(c, 1000.0, 0.0) for c in "cde"]
    src, schema = str(tmp_path / "in"), "channel string, ts timestamp, v double"
    # Every file is out of order, and files overlap by less than the lateness.
    files = [min(6, max(0, int((t + rng.uniform(-4, 4)) // 10))) for _, t, _ in rows]
    for k in range(7):
        part = [r for r, f in zip(rows, files) if f == k]
        rng.shuffle(part)
        time.sleep(0.01)
        spark.createDataFrame([(c, at(float(t)), float(v)) for c, t, v in part], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (se.pulses(stream, lateness="12 seconds").writeStream.format("memory").queryName("late").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(240)
    got = {(r.channel, (r.onset - T0).total_seconds(), (r.offset - T0).total_seconds()) for r in spark.sql("SELECT * FROM late").collect()}
    want = set()
    for c in "cd":
        own = sorted(r[1:] for r in rows if r[0] == c)
        high, onset = own[0][1] > 1.5, None
        for t, v in own[1:]:
            if v > 1.5 and not high:
                onset = t
            if v <= 1.5 and high and onset is not None and t < 1000:  # the last samples are still held back
                want.add((c, onset, t))
            high = v > 1.5
    assert got == want and len(want) > 40


def test_pulses(spark, tmp_path):
    rows = [("c", at(i), v) for i, v in enumerate([5.0, 0.0, 0.0, 5.0, 5.0, 0.0, 5.0])] + [("c", at(100), 5.0)]
    got = run(spark, tmp_path, rows, "channel string, ts timestamp, v double", lambda s: se.pulses(s), "pulses")
    assert [((r.onset - T0).total_seconds(), (r.offset - T0).total_seconds()) for r in got] == [(3.0, 5.0)]
