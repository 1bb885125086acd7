import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventide.core.checks import ContractError
from eventide.sinks import bundle as bu
from eventide.sinks import provenance as pv
from eventide.sinks import tables as tbl
from eventide.sources import identity as idn
from eventide.sources import manifest as mf
from eventide.sources import recordings as rec
from eventide.sources import sessions as se


def text(tmp_path, content, name="m.csv"):
    p = tmp_path / name
    p.write_text(content, encoding="utf-8")
    return str(p)


def test_manifest(spark, tmp_path):
    p = text(tmp_path, "\ufeff mouse , date,run,note\n M1 ,001234, 002,x\n,,,\nM2,240101,3,\n")
    rows = {r.mouse: r for r in mf.load(spark, p).collect()}
    assert (rows["M1"].date, rows["M1"].run, rows["M1"].note) == ("001234", 2, "x")
    assert set(rows) == {"M1", "M2"}


@pytest.mark.parametrize(
    "content,message",
    [
        ("mouse,date,run\nM1,260101,1\nM1,260101,01\n", "duplicate"),
        ("mouse,date\nM1,260101\n", "lacks columns"),
        ("mouse,date,run\nM1,260101,x\n", "invalid row"),
        ("mouse,date,run\nM1,,1\n", "invalid row"),
        ("mouse,date,run\nM1,260101,-1\n", "invalid row"),
        ("mouse,date,run\n,,\n", "no sessions"),
    ],
)
def test_manifest_errors(spark, tmp_path, content, message):
    with pytest.raises(ContractError, match=message):
        mf.load(spark, text(tmp_path, content))


def test_lifetime_manifest(spark, tmp_path):
    p = text(tmp_path, "mouse,date,run,doric_path,junk\nM1,240101,1,/a.doric,zz\n")
    r = mf.load_lifetime(spark, p, "fluopulse")
    assert r.columns == ["mouse", "date", "run", "group", "condition", "doric_path", "nidaq_path", "running_path"]
    with pytest.raises(ContractError, match="duplicate"):
        mf.load_lifetime(spark, text(tmp_path, "mouse,date,run\nM1,240101,1\nm1,240101,1\n", "d.csv"), "iflip3")
    with pytest.raises(ContractError, match="six digits"):
        mf.load_lifetime(spark, text(tmp_path, "mouse,date,run\nM1,2401,1\n", "e.csv"), "iflip3")


def test_editor_and_filters(spark):
    rows = spark.createDataFrame(
        [("M1", "240101", "1", " Dry ", "a", ""), ("M2", "240101", "2", "wet", "A", "2")],
        "mouse string, date string, run string, group string, condition string, channel string",
    )
    assert {r.mouse: r.channel for r in mf.editor_rows(rows).collect()} == {"M1": 1, "M2": 2}
    assert mf.select_sessions(rows, group="DRY").count() == 1
    assert mf.select_sessions(rows, condition="a ").count() == 2
    with pytest.raises(ContractError, match="channel"):
        mf.editor_rows(rows.withColumn("channel", F.lit("3")))
    mf.require_one_group(rows)
    with pytest.raises(ContractError, match="several groups"):
        mf.require_one_group(rows.withColumn("mouse", F.lit("M1")))


def test_identity(spark):
    names = [
        "/x/260923_SC81_run1_0000.doric", "C:\\d\\SC81_260923_run12_0000.doric", "/y/SC8_260923_004.iFLiP3",
        "/y/SC8_260923004.iFLiP3", "/z/SC8-260923-007-nidaq.mat", "/z/other.txt",
    ]
    df = spark.createDataFrame([(n,) for n in names], "path string").select(idn.identity("path").alias("w"))
    got = [None if r.w is None else (r.w.mouse, r.w.date, r.w.run) for r in df.collect()]
    assert got == [("SC81", "260923", 1), ("SC81", "260923", 12), ("SC8", "260923", 4), ("SC8", "260923", 4), ("SC8", "260923", 7), None]


HEADER = (
    "header.acq.nChannels = {c};\nheader.acq.LTCurveLength = 2;\nheader.acq.LTResolution = 0.1;\n"
    "header.state.samplingFreq.Value = 10;\nheader.init.syncRate = 8e7;\nheader.note = 'a;b ''q''\nline';\n"
    "header.range = [0.4 12.3];\nheader_end\n"
)


def test_lifetime_binary(spark, tmp_path):
    values = np.arange(7 * 2 * 3, dtype="<u4").reshape(7, 2, 3)
    values[0, 0, 2] = 2**31 + 9
    (tmp_path / "a.iFLiP3").write_bytes(HEADER.format(c=2).encode() + values.tobytes())
    rec.register(spark)
    df = spark.read.format("iflip3").option("samplesPerTask", "3").load(str(tmp_path))
    rows = {(r.i, r.channel): r for r in df.collect()}
    assert len(rows) == 14 and df.rdd.getNumPartitions() == 3
    assert rows[(0, 0)].mark == 2**31 + 9 and rows[(0, 0)].counts == [0.0, 1.0]
    assert rows[(6, 1)].counts == [float(v) for v in values[6, 1, :2]]
    assert rows[(3, 0)].t == pytest.approx(0.35)
    h, _ = rec.read_header(str(tmp_path / "a.iFLiP3"))
    assert h["note"] == "a;b 'q'\nline" and h["range"] == [0.4, 12.3] and h["acq.nChannels"] == 2


def test_header_is_never_evaluated():
    with pytest.raises(ValueError, match="unsupported header"):
        rec.parse_header("header.x = system('rm');")
    with pytest.raises(ValueError, match="unsupported header"):
        rec.parse_header("import os;")
    with pytest.raises(ValueError, match="conflict"):
        rec.parse_header("header.a = 1; header.a.b = 2;")


def mat_bytes(variables, compress):
    out = b"MATLAB 5.0 MAT-file".ljust(124) + b"\x00\x01IM"

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    for name, a in variables.items():
        a = np.atleast_2d(np.asarray(a, float))
        body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", *a.shape))
        body += element(1, name.encode()) + element(9, a.tobytes(order="F"))
        m = struct.pack("<II", 14, len(body)) + body
        if compress:
            z = zlib.compress(m)
            m = struct.pack("<II", 15, len(z)) + z
        out += m
    return out


@pytest.mark.parametrize("compress", [False, True])
def test_mat_sources(spark, tmp_path, compress):
    data = np.arange(80.0).reshape(8, 10)
    f = {"data": data, "timestamps": np.arange(10) / 100, "Fs": 100.0}
    (tmp_path / "M1-240101-001-nidaq.mat").write_bytes(mat_bytes(f, compress))
    rec.register(spark)
    df = spark.read.format("labmat").load(str(tmp_path))
    assert df.count() == 80
    lick = df.filter("channel = 'licking'").orderBy("i").collect()
    assert [r.v for r in lick] == list(data[3]) and lick[4].t == 0.04
    run = tmp_path / "run"
    run.mkdir()
    (run / "r.mat").write_bytes(mat_bytes({"speed": [1.0, 2.0], "time": [0.0, 0.1]}, compress))
    assert [(r.channel, r.v) for r in spark.read.format("labmat").load(str(run)).orderBy("i").collect()] == [("speed", 1.0), ("speed", 2.0)]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "b.mat").write_bytes(mat_bytes({**f, "timestamps": np.zeros(10)}, compress))
    with pytest.raises(Exception, match="strictly increasing"):
        spark.read.format("labmat").load(str(bad)).count()


def test_npz_source(spark, tmp_path):
    np.savez(
        tmp_path / "s.npz", continuous_tau_time=np.arange(3.0), continuous_tau_values=np.array([5.0, 6.0, 7.0]),
        events_licks=np.array([0.5]), intervals_cue_starts=np.array([1.0]), intervals_cue_ends=np.array([2.0]),
        version=np.array("1.3"),
    )
    rec.register(spark)
    rows = spark.read.format("npz").load(str(tmp_path))
    t = se.from_archive(rows)
    assert [(r.signal, r.t, r.v) for r in t["signals"].orderBy("i").collect()] == [("tau", 0.0, 5.0), ("tau", 1.0, 6.0), ("tau", 2.0, 7.0)]
    assert t["events"].first().t == 0.5 and t["intervals"].first().t1 == 2.0
    assert rows.filter("key = 'version'").first().text == "1.3"


def test_doric_needs_h5py(spark, tmp_path):
    (tmp_path / "a.doric").write_bytes(b"x")
    rec.register(spark)
    with pytest.raises(Exception, match="h5py|file signature"):
        spark.read.format("doric").load(str(tmp_path)).count()


def test_intervals(spark):
    a = spark.createDataFrame([("s", i, float(t)) for i, t in enumerate([1, 5, 9])], "k string, i int, t double")
    b = spark.createDataFrame([("s", 0, 2.0), ("s", 1, 4.0)], "k string, i int, t double")
    x = se.pair_intervals(a, b, ["k"])
    assert {r.i: r.t1 for r in x.collect()} == {0: 2.0, 1: None, 2: None}
    assert sorted(r.i for r in se.overlapping(x, (2.0, 6.0)).collect()) == [0, 1]


def test_registry_and_calibration(spark, tmp_path):
    p = text(tmp_path, json.dumps({"schema_version": "1.0", "datasets": {"a": "x/y.mat"}}), "r.json")
    assert se.load_registry(p) == {"a": "x/y.mat"}
    for bad in ("../x", "/x", "C:/x"):
        with pytest.raises(ContractError):
            se.load_registry(text(tmp_path, json.dumps({"schema_version": "1.0", "datasets": {"a": bad}}), "b.json"))
    good = {"schema_version": "2.1", "lifetimes": [0.5, 1.8], "t0": 1.0, "pulse_interval": 12.5, "success": True}
    assert se.load_calibrations(spark, text(tmp_path, json.dumps(good), "c.json")).count() == 1
    for change in ({"success": False}, {"lifetimes": [0.5]}, {"schema_version": "9"}, {"fixed_background": 2.0}):
        with pytest.raises(ContractError):
            se.load_calibrations(spark, text(tmp_path, json.dumps({**good, **change}), "d.json"))


def test_fingerprint():
    a = pv.fingerprint({"b": 1, "a": [1.5, "x"]})
    assert a == pv.fingerprint({"a": (1.5, "x"), "b": 1}) and len(a) == 64
    with pytest.raises(ValueError):
        pv.fingerprint({"a": float("nan")})
    r = pv.run_record("psth", {"dt": 0.1}, [], ["out"])
    assert r["parameters_sha256"] == pv.fingerprint({"dt": 0.1})


def test_fingerprint_column_equals_python(spark):
    df = spark.createDataFrame([(2, "x")], "b int, a string")
    got = df.select(pv.fingerprint_column({"b": F.col("b"), "a": F.col("a")}).alias("f")).first().f
    assert got == pv.fingerprint({"a": "x", "b": 2})


def test_session_store_and_export(spark, tmp_path):
    root = str(tmp_path / "store")
    sig = spark.createDataFrame([("s1", "dff", 0, 0.0, 1.0), ("s1", "tau", 0, 0.0, 2.0)], se.SCHEMAS["signals"])
    tbl.write_sessions({"signals": sig}, root)
    again = spark.read.schema(se.SCHEMAS["signals"]).parquet(f"{root}/signals")
    assert again.filter("signal = 'tau'").first().v == 2.0
    other = sig.withColumn("session_id", F.lit("s2"))
    tbl.write_sessions({"signals": other}, root)  # leaves the first session alone
    assert {r[0] for r in spark.read.schema(se.SCHEMAS["signals"]).parquet(f"{root}/signals").select("session_id").collect()} == {"s1", "s2"}
    tbl.write_sessions({"signals": other.withColumn("v", F.lit(9.0))}, root)
    assert sorted(r.v for r in spark.read.schema(se.SCHEMAS["signals"]).parquet(f"{root}/signals").collect()) == [1.0, 2.0, 9.0, 9.0]
    # A signal or an event table that the session no longer has disappears with it.
    events = spark.createDataFrame([("s1", "lick", 1.0), ("s2", "lick", 2.0), ("s:3", "lick", 3.0)], "session_id string, event string, t double")
    tbl.write_sessions({"signals": sig.unionByName(other), "events": events}, root)
    tbl.write_sessions({"signals": sig.filter("signal = 'dff'").unionByName(sig.withColumn("session_id", F.lit("s:3"))), "events": events.limit(0)}, root)
    left = {(r.session_id, r.signal) for r in spark.read.schema(se.SCHEMAS["signals"]).parquet(f"{root}/signals").collect()}
    assert left == {("s1", "dff"), ("s2", "dff"), ("s2", "tau"), ("s:3", "dff"), ("s:3", "tau")}
    assert {r.session_id for r in spark.read.schema(events.schema).parquet(f"{root}/events").collect()} == {"s2"}
    todo = tbl.pending(spark.createDataFrame([("s1",), ("s2",)], "session_id string"), sig, ["session_id"])
    assert [r[0] for r in todo.collect()] == ["s2"]
    rows = spark.createDataFrame([(0.0, 1.0, "a"), (1.0, float("nan"), "a")], "time_s double, value double, mouse string")
    tbl.write_csv(rows, str(tmp_path / "csv"))
    back = tbl.saved_traces(spark, str(tmp_path / "csv"))
    assert [r.value for r in back.orderBy("time_s").collect()] == ["1.0", None]
    both = back.unionByName(back.withColumn("value", F.lit("3.0")))
    assert tbl.trace_conflicts(both, [], ["mouse"]).count() == 1
    assert tbl.trace_conflicts(back.unionByName(back), [], ["mouse"]).count() == 0


def test_bundle(spark, tmp_path):
    root = str(tmp_path / "bundle")
    b = bu.Bundle(spark, root, title="t")
    df = spark.createDataFrame([("M1", 0.0, 1.0), ("M2", 0.0, 2.0)], "mouse string, time_s double, value double")
    b.add_table("traces", df, columns=df.columns, description="d", units={"value": "z"}, primary_key=("mouse", "time_s"))
    with pytest.raises(ContractError, match="undeclared"):
        b.add_table("x", df, columns=["mouse"], description="d")
    with pytest.raises(ContractError, match="primary key"):
        b.add_table("y", df, columns=df.columns, description="d", primary_key=("time_s",))
    with pytest.raises(ContractError):
        b.add_table("../z", df, columns=df.columns, description="d")
    b.add_figure("1a", title="f", sources=["traces"], command="run")
    assert b.finalize()["tables"]["traces"]["rows"] == 2
    assert bu.validate(spark, root).count() == 0
    victim = next((tmp_path / "bundle" / "traces").glob("*.csv.gz"))
    (victim.parent / f".{victim.name}.crc").unlink()
    victim.write_bytes(victim.read_bytes()[:-8] + b"12345678")
    assert [r.problem for r in bu.validate(spark, root).collect()] == ["checksum differs"]
    victim.unlink()
    assert [r.problem for r in bu.validate(spark, root).collect()] == ["missing file"]
