"""LAS files as a Spark data source (plain LAS 1.2 - 1.4, no LAZ).

Point records have a fixed length, so a file is cut into byte ranges and every
range is one input partition; NumPy decodes a range into Arrow batches.
Writing produces one file per partition.

    spark.dataSource.register(LasDataSource)
    spark.read.format("las").load(path)
    df.write.format("las").mode("append").save(folder)
"""

from __future__ import annotations

import glob
import os
import struct
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = ("file_id string, chunk_id bigint, point_id bigint, x double, y double, z double, red double, green double, "
          "blue double, intensity double, classification int")
ROWS_PER_PARTITION = 1_000_000
ROWS_PER_BATCH = 100_000

# fixed values: byte offset of the colour channels per point format, base record length
RGB_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
BASE_LENGTH = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}


@dataclass
class Header:
    version: str
    point_format: int
    record_length: int
    offset: int
    count: int
    scale: tuple
    shift: tuple
    low: tuple
    high: tuple

    @property
    def has_rgb(self) -> bool:
        return self.point_format in RGB_AT


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        h = f.read(375)
    if h[:4] != b"LASF":
        raise ValueError(f"not a LAS file: {path}")
    offset, = struct.unpack_from("<I", h, 96)
    fmt, length, count = struct.unpack_from("<BHI", h, 104)
    scale, shift = struct.unpack_from("<3d", h, 131), struct.unpack_from("<3d", h, 155)
    mm = struct.unpack_from("<6d", h, 179)  # max x, min x, max y, ...
    if h[25] >= 4 and len(h) >= 255:
        count = struct.unpack_from("<Q", h, 247)[0] or count
    return Header(f"{h[24]}.{h[25]}", fmt & 0x3F, length, offset, count, scale, shift, mm[1::2], mm[0::2])


def _record(fmt: int, length: int) -> np.dtype:
    names, formats, offsets = ["x", "y", "z", "intensity"], ["<i4", "<i4", "<i4", "<u2"], [0, 4, 8, 12]
    names.append("cls"), formats.append("u1"), offsets.append(16 if fmt >= 6 else 15)
    if fmt in RGB_AT:
        for i, c in enumerate(("red", "green", "blue")):
            names.append(c), formats.append("<u2"), offsets.append(RGB_AT[fmt] + 2 * i)
    return np.dtype({"names": names, "formats": formats, "offsets": offsets, "itemsize": length})


class Range(InputPartition):
    def __init__(self, path: str, first: int, rows: int, header: Header, file_no: int):
        super().__init__(path)
        self.path, self.first, self.rows, self.header, self.file_no = path, first, rows, header, file_no


class LasReader(DataSourceReader):
    def __init__(self, options):
        path = options.get("path")
        self.files = sorted(glob.glob(os.path.join(path, "*.las"))) if os.path.isdir(path) else sorted(glob.glob(path))
        self.chunk = int(options.get("chunkSize", 10_000_000))

    def partitions(self):
        out = []
        for no, path in enumerate(self.files):
            h = read_header(path)
            out += [Range(path, s, min(ROWS_PER_PARTITION, h.count - s), h, no) for s in range(0, h.count, ROWS_PER_PARTITION)]
        return out

    def read(self, part: Range):
        h, dt = part.header, _record(part.header.point_format, part.header.record_length)
        with open(part.path, "rb") as f:
            f.seek(h.offset + part.first * h.record_length)
            for s in range(0, part.rows, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, part.rows - s)
                rec = np.frombuffer(f.read(n * h.record_length), dt)
                pos = part.first + s + np.arange(n, dtype=np.int64)
                xyz = [rec[a] * h.scale[i] + h.shift[i] for i, a in enumerate("xyz")]
                rgb = [pa.array(rec[c] / 65535.0) if h.has_rgb else pa.nulls(n, pa.float64()) for c in ("red", "green", "blue")]
                cls = rec["cls"] if h.point_format >= 6 else rec["cls"] & 0x1F
                yield pa.RecordBatch.from_arrays(
                    [pa.array([os.path.basename(part.path)] * n), pa.array(pos // self.chunk),
                     # ids stay unique over files: file number in the high bits
                     pa.array((np.int64(part.file_no) << 40) + pos), *[pa.array(v) for v in xyz], *rgb,
                     pa.array(rec["intensity"].astype(np.float64)), pa.array(cls.astype(np.int32))],
                    names=["file_id", "chunk_id", "point_id", "x", "y", "z", "red", "green", "blue", "intensity", "classification"])


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class LasWriter(DataSourceArrowWriter):
    """One file per partition; classes above 31 select the 1.4 record, colours the RGB record."""

    def __init__(self, options):
        self.folder = options["path"]
        self.wide = options.get("wide", "auto")
        self.scale = float(options.get("scale", 0.001))

    def write(self, batches):
        # first pass: spool the partition to a task-local file and learn what the header needs
        spool = tempfile.TemporaryFile()
        sink, rows, top, rgb = None, 0, 0, True
        low, high = np.full(3, np.inf), np.full(3, -np.inf)
        for b in batches:
            if sink is None:
                sink = pa.ipc.new_stream(spool, b.schema)
                rgb = "red" in b.schema.names
            sink.write_batch(b)
            rows += b.num_rows
            if b.num_rows:
                top = max(top, pc.max(b.column("classification")).as_py())
                rgb = rgb and b.column("red").null_count == 0
                xyz = np.column_stack([b.column(a).to_numpy() for a in "xyz"])
                low, high = np.minimum(low, xyz.min(0)), np.maximum(high, xyz.max(0))
        if rows == 0:
            return Written("", 0)
        sink.close()
        spool.seek(0)
        wide = top > 31 if self.wide == "auto" else self.wide == "true"
        fmt = (7 if rgb else 6) if wide else (3 if rgb else 1)
        length = BASE_LENGTH[fmt]
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"part-{uuid.uuid4().hex}.las.tmp")
        size = 375 if wide else 227
        h = bytearray(size)
        h[0:4] = b"LASF"
        h[24], h[25] = 1, 4 if wide else 2
        struct.pack_into("<HII", h, 94, size, size, 0)
        struct.pack_into("<BHI", h, 104, fmt, length, 0 if wide else rows)
        struct.pack_into("<3d3d", h, 131, *([self.scale] * 3), *low)
        struct.pack_into("<6d", h, 179, *[v for i in range(3) for v in (high[i], low[i])])
        if wide:
            struct.pack_into("<Q", h, 247, rows)
        with open(path, "wb") as f:
            f.write(bytes(h))
            for b in pa.ipc.open_stream(spool):
                f.write(self._encode(b, fmt, length, low, rgb).tobytes())
        return Written(path, rows)

    def _encode(self, b: pa.RecordBatch, fmt: int, length: int, low: np.ndarray, rgb: bool) -> np.ndarray:
        rec = np.zeros(b.num_rows, _record(fmt, length))
        for i, a in enumerate("xyz"):
            rec[a] = np.rint((b.column(a).to_numpy() - low[i]) / self.scale)
        if "intensity" in b.schema.names:
            rec["intensity"] = (np.nan_to_num(b.column("intensity").to_numpy(zero_copy_only=False)) * 65535).astype(np.uint16)
        rec["cls"] = b.column("classification").to_numpy()
        if rgb:
            for c in ("red", "green", "blue"):
                rec[c] = (b.column(c).to_numpy(zero_copy_only=False) * 65535).astype(np.uint16)
        return rec

    def commit(self, messages):
        for m in messages:
            if m is not None and m.rows:
                os.replace(m.path, m.path[:-4])

    def abort(self, messages):
        for m in messages:
            if m is not None and m.rows and os.path.exists(m.path):
                os.remove(m.path)


class LasDataSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LasReader(self.options)

    def writer(self, schema, overwrite):
        return LasWriter(self.options)


def file_info(spark, path: str):
    """Header facts per file: version, format, count, bounds, colours, size."""
    files = sorted(glob.glob(os.path.join(path, "*.las"))) if os.path.isdir(path) else [path]
    one = spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), 64))

    def parse(batches):
        for b in batches:
            rows = []
            for f in b.column("path").to_pylist():
                h = read_header(f)
                rows.append((os.path.basename(f), h.version, h.point_format, h.count, *h.low, *h.high, h.has_rgb, os.path.getsize(f) / (1024 * 1024)))
            names = ["file", "version", "point_format", "n_points", "x_min", "y_min", "z_min", "x_max", "y_max", "z_max", "has_rgb", "size_mb"]
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)})

    return one.mapInArrow(parse, "file string, version string, point_format bigint, n_points bigint, x_min double, y_min double, "
                                 "z_min double, x_max double, y_max double, z_max double, has_rgb boolean, size_mb double")
