"""Recorder files as Spark data sources.

Every source lists its files on the driver (names and headers only) and reads
content in tasks.  Formats with fixed-size samples are split by sample range,
so one huge recording is read by many tasks.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _files(options: dict, suffix: str) -> list[str]:
    path = options.get("path")
    if not path:
        raise ValueError("the source needs a path")
    if os.path.isdir(path):
        return sorted(glob.glob(os.path.join(path, "**", f"*{suffix}"), recursive=True))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


# ------------------------------------------------------------ lifetime binary

_STATEMENT = re.compile(r"(?:'(?:[^']|'')*'|[^';])+")
_NUM = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def header_value(text: str):
    """Quoted text, number or numeric list; nothing is ever evaluated."""
    text = text.strip()
    if re.fullmatch(r"'(?:[^']|'')*'", text, re.S):
        return text[1:-1].replace("''", "'")
    if _NUM.fullmatch(text):
        return int(text) if re.fullmatch(r"[+-]?\d+", text) else float(text)
    if text[:1] == "[" and text[-1:] == "]":
        items = text[1:-1].replace(",", " ").split()
        if all(_NUM.fullmatch(i) for i in items):
            return [header_value(i) for i in items]
    raise ValueError(f"unsupported header value: {text!r}")


def parse_header(text: str) -> dict:
    """Flat mapping of dotted header paths to values."""
    out: dict = {}
    for m in _STATEMENT.finditer(text):
        statement = m.group().strip()
        if not statement:
            continue
        target, equals, value = statement.partition("=")
        root, *parts = target.rstrip().split(".")
        if root != "header" or not (equals and parts and all(p.isidentifier() and p.isascii() for p in parts)):
            raise ValueError(f"unsupported header line {statement!r}")
        path = ".".join(parts)
        clash = [p for p in out if p.startswith(path + ".") or path.startswith(p + ".")]
        if clash:
            raise ValueError(f"header path conflict at {path!r}")
        out[path] = header_value(value)
    return out


def read_header(path: str, chunk: int = 1 << 20) -> tuple[dict, int]:
    """Header and byte offset of the payload; reads on until the header's end."""
    head, m = b"", None
    with open(path, "rb") as f:
        while m is None:
            more = f.read(chunk)
            if not more:
                raise ValueError(f"{path}: the file ends inside its header")
            head += more
            m = re.search(rb"(?m)^header_end\r?\n", head)
    return parse_header(head[: m.start()].decode("utf-8")), m.end()


class SampleRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class LifetimeBinaryReader(DataSourceReader):
    """Rows ``path, i, channel, t, counts, mark`` of .iFLiP3 recordings."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        step = int(self.options.get("samplesPerTask", "20000"))
        out = []
        for path in _files(self.options, ".iFLiP3"):
            header, offset = read_header(path)
            per = (int(header["acq.LTCurveLength"]) + 1) * int(header["acq.nChannels"])
            size = os.path.getsize(path) - offset
            if size % 4:
                raise ValueError(f"{path}: the last count is cut short")
            if (size // 4) % per:
                raise ValueError(f"{path}: the last sample is cut short")
            n = size // 4 // per
            out += [SampleRange(path, a, min(a + step, n)) for a in range(0, max(n, 1), step)]
        return out

    def read(self, part):
        header, offset = read_header(part.path)
        bins, channels = int(header["acq.LTCurveLength"]), int(header["acq.nChannels"])
        fs = float(header["state.samplingFreq.Value"])
        per = (bins + 1) * channels
        n = part.stop - part.start
        if n <= 0:
            return
        with open(part.path, "rb") as f:
            f.seek(offset + 4 * per * part.start)
            raw = np.frombuffer(f.read(4 * per * n), dtype="<u4")
        cube = raw.reshape(n, channels, bins + 1)
        marks = cube[:, 0, -1].astype(np.int64)
        i = np.arange(part.start, part.stop)
        for c in range(channels):
            counts = cube[:, c, :-1].astype(float)
            offsets = np.arange(n + 1, dtype=np.int32) * bins
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.path] * n),
                    pa.array(i, pa.int64()),
                    pa.array(np.full(n, c), pa.int32()),
                    pa.array((i + 0.5) / fs),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel())),
                    pa.array(marks),
                ],
                names=["path", "i", "channel", "t", "counts", "mark"],
            )


class LifetimeBinarySource(DataSource):
    """``spark.read.format('iflip3').load(path)``"""

    @classmethod
    def name(cls):
        return "iflip3"

    def schema(self):
        return "path string, i bigint, channel int, t double, counts array<double>, mark bigint"

    def reader(self, schema):
        return LifetimeBinaryReader(self.options)


# ------------------------------------------------------------ MATLAB level 5

_MI = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}


def _elements(buf: bytes, order: str):
    """Data elements ``(type, bytes)`` of a buffer, padding skipped."""
    pos = 0
    while pos + 8 <= len(buf):
        tag, size = struct.unpack_from(order + "II", buf, pos)
        if tag >> 16:
            # Small element: size in the upper half word, data in the tag.
            yield tag & 0xFFFF, buf[pos + 4 : pos + 4 + (tag >> 16)]
            pos += 8
        else:
            yield tag, buf[pos + 8 : pos + 8 + size]
            pos += 8 + size + (0 if tag == 15 else -size % 8)


def _matrix(buf: bytes, order: str):
    """Name and value of one numeric or character matrix (None for others)."""
    parts = list(_elements(buf, order))
    flags = struct.unpack_from(order + "I", parts[0][1])[0]
    dims = np.frombuffer(parts[1][1], dtype=order + "i4")
    name = parts[2][1].decode("ascii")
    if (flags & 0xFF) not in range(4, 16) or len(parts) < 4:
        return name, None
    kind, raw = parts[3]
    if kind not in _MI:
        return name, raw.decode("utf-8", "replace") if (flags & 0xFF) == 4 else None
    values = np.frombuffer(raw, dtype=order + _MI[kind])
    return name, values.reshape(dims, order="F")


def read_mat(path: str, names: tuple[str, ...] | None = None) -> dict:
    """Numeric variables of a level-5 MAT file."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) < 128:
        raise ValueError(f"{path} is not a level-5 MAT file")
    order = "<" if raw[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(raw[128:], order):
        if kind == 15:
            for inner, data in _elements(zlib.decompress(body), order):
                if inner == 14:
                    name, value = _matrix(data, order)
                    if names is None or name in names:
                        out[name] = value
        elif kind == 14:
            name, value = _matrix(body, order)
            if names is None or name in names:
                out[name] = value
    return out


# Default rows of the acquisition matrix.
CHANNEL_ROWS = {
    "photoreceiver_1": 0, "sync": 1, "photoreceiver_2": 2, "licking": 3,
    "visual_cue": 4, "ttl_465": 5, "ttl_405": 6, "ensure": 7,
}


def check_recording(path: str, data, time, fs) -> None:
    if data is None or data.ndim != 2:
        raise ValueError(f"{path}: data must be two-dimensional")
    if time.size != data.shape[1] or not np.isfinite(time).all() or (np.diff(time) <= 0).any():
        raise ValueError(f"{path}: timestamps must be finite, strictly increasing and match data")
    if not np.isfinite(fs) or fs <= 0:
        raise ValueError(f"{path}: Fs must be finite and positive")


class AcquisitionReader(DataSourceReader):
    """Rows ``path, channel, i, t, v`` of NI-DAQ or running MAT files."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [SampleRange(p, 0, 0) for p in _files(self.options, self.options.get("suffix", ".mat"))]

    def read(self, part):
        m = read_mat(part.path)
        if "speed" in m:
            time = m.get("timestamps", m.get("time"))
            if time is None:
                raise ValueError(f"{part.path}: running data lack timestamps")
            time = np.ravel(time).astype(float)
            rows = {k: np.ravel(m[k]).astype(float) for k in ("speed", "position") if k in m}
            if any(v.shape != time.shape for v in rows.values()):
                raise ValueError(f"{part.path}: running arrays differ in length")
        else:
            data, time = m.get("data"), np.ravel(m["timestamps"]).astype(float)
            check_recording(part.path, data, time, float(np.ravel(m["Fs"])[0]))
            wanted = {**CHANNEL_ROWS}
            if max(wanted.values()) >= data.shape[0]:
                raise ValueError(f"{part.path}: channel rows exceed the data")
            rows = {k: data[r].astype(float) for k, r in wanted.items()}
        piece = 1 << 18
        for channel, v in rows.items():
            for a in range(0, v.size, piece):
                z = min(a + piece, v.size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.path] * (z - a)),
                        pa.array([channel] * (z - a)),
                        pa.array(np.arange(a, z), pa.int64()),
                        pa.array(time[a:z]),
                        pa.array(v[a:z]),
                    ],
                    names=["path", "channel", "i", "t", "v"],
                )


class AcquisitionSource(DataSource):
    """``spark.read.format('labmat').load(path)``"""

    @classmethod
    def name(cls):
        return "labmat"

    def schema(self):
        return "path string, channel string, i bigint, t double, v double"

    def reader(self, schema):
        return AcquisitionReader(self.options)


# ------------------------------------------------------------ NumPy archives


class ArchiveReader(DataSourceReader):
    """Rows ``path, key, i, value, text`` of .npz archives (pickles refused)."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [SampleRange(p, 0, 0) for p in _files(self.options, ".npz")]

    def read(self, part):
        with np.load(part.path, allow_pickle=False) as z:
            for key in z.files:
                a = np.atleast_1d(z[key]).ravel()
                n = a.size
                number = a.dtype.kind in "fiub"
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.path] * n, pa.string()),
                        pa.array([key] * n, pa.string()),
                        pa.array(np.arange(n), pa.int64()),
                        pa.array(a.astype(float) if number else [None] * n, pa.float64()),
                        pa.array([None] * n if number else [str(x) for x in a], pa.string()),
                    ],
                    names=["path", "key", "i", "value", "text"],
                )


class ArchiveSource(DataSource):
    """``spark.read.format('npz').load(path)``"""

    @classmethod
    def name(cls):
        return "npz"

    def schema(self):
        return "path string, key string, i bigint, value double, text string"

    def reader(self, schema):
        return ArchiveReader(self.options)


# ------------------------------------------------------------ Doric HDF5

SERIES = "/DataAcquisition/FluoPulse/Signals/Series0001"
CONFIGURATION = "/Configurations/FluoPulse"


# Where versions of the format keep the same thing, newest first.
PLACES = {
    "results": (f"{SERIES}/Calculation01", f"{SERIES}/Calculation"),
    "response": (f"{SERIES}/IRF01", f"{CONFIGURATION}/IRF"),
}


def _place(f, thing: str, paths: tuple[str, ...]) -> str:
    here = [p for p in paths if p in f]
    if not here:
        raise ValueError(f"no {thing} at {' or '.join(paths)}")
    return here[0]


def _label(f, channel: str) -> str:
    """The name a user gave a digital channel, else the channel's own."""
    node = f.get(f"{CONFIGURATION}/{channel}/Settings")
    given = None if node is None else node.attrs.get("Username")
    if isinstance(given, bytes):
        return given.decode("utf-8", "replace")
    return channel if given is None else str(given)


class DoricReader(DataSourceReader):
    """Rows ``path, table, channel, i, t, v`` of lifetime, IRF and digital data.

    Digital traces are read in slices.  Needs the optional h5py package.
    """

    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [SampleRange(p, 0, 0) for p in _files(self.options, ".doric")]

    def read(self, part):
        try:
            import h5py
        except ImportError as error:
            raise ImportError("reading .doric files needs the h5py package") from error

        def batch(table, channel, start, t, v):
            n = len(v)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part.path] * n), pa.array([table] * n), pa.array([channel] * n),
                    pa.array(np.arange(start, start + n), pa.int64()),
                    pa.array(np.asarray(t, float)), pa.array(np.asarray(v, float)),
                ],
                names=["path", "table", "channel", "i", "t", "v"],
            )

        with h5py.File(part.path, "r") as f:
            calc = _place(f, "results", PLACES["results"])
            amplitude = _place(f, "amplitude", (f"{calc}/Amplitude", f"{calc}/Amplitude01"))
            time = np.asarray(f[f"{calc}/Time"], float)
            named = {
                "tau": f"{calc}/Tau01", "amplitude": amplitude,
                "chi_square": f"{calc}/Chisquare", "fit_r_square": f"{calc}/Rsquare",
            }
            for channel, dataset in named.items():
                yield batch("lifetime", channel, 0, time, f[dataset][...])
            irf = _place(f, "response", PLACES["response"])
            it = np.asarray(f[f"{irf}/Time"], float)
            yield batch("irf", "values", 0, (it - it[0]) * 1e9, f[f"{irf}/Values"][...])
            digital = f"{SERIES}/DigitalIO"
            if digital in f:
                names = sorted(k for k in f[digital] if k != "Time")
                n = f[f"{digital}/Time"].shape[0]
                for k in names:
                    user = _label(f, k)
                    for a in range(0, n, 1 << 18):
                        z = min(a + (1 << 18), n)
                        yield batch("digital", f"{k}\t{user}", a, f[f"{digital}/Time"][a:z], f[f"{digital}/{k}"][a:z])


class DoricSource(DataSource):
    """``spark.read.format('doric').load(path)``"""

    @classmethod
    def name(cls):
        return "doric"

    def schema(self):
        return "path string, table string, channel string, i bigint, t double, v double"

    def reader(self, schema):
        return DoricReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the recorder formats available to ``spark.read.format``."""
    for source in (LifetimeBinarySource, AcquisitionSource, ArchiveSource, DoricSource):
        spark.dataSource.register(source)
