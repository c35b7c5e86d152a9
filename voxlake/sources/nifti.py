"""NIfTI-1 volumes: headers and voxels as tables, and back to files."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: data-type codes.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CODES = {v: k for k, v in KINDS.items()}
SLAB = 1 << 16


def parse_header(data: bytes) -> dict:
    """Dimensions, resolutions, type, scaling and data offset; either byte order."""
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(f"{order}i", data)[0] != 348:
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack_from(f"{order}8h", data, 40)
    kind, _ = struct.unpack_from(f"{order}2h", data, 70)
    pix = struct.unpack_from(f"{order}8f", data, 76)
    offset, slope, inter = struct.unpack_from(f"{order}3f", data, 108)
    if kind not in KINDS:
        raise ValueError(f"unsupported data type {kind}")
    size = [max(1, d) for d in dim[1 : dim[0] + 1]] + [1] * (4 - min(4, dim[0]))
    return {"order": order, "size": size[:4], "resolution": list(pix[1:4]), "kind": KINDS[kind], "offset": int(offset), "slope": slope if slope else 1.0, "inter": inter if slope else 0.0}


def encode(volume: np.ndarray, resolution: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> bytes:
    """A single-file NIfTI-1 image of an array in x, y, z[, t] order."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    dims = [volume.ndim, *volume.shape] + [1] * (7 - volume.ndim)
    struct.pack_into("<8h", head, 40, *dims)
    code = CODES[volume.dtype.str[1:]]
    struct.pack_into("<2h", head, 70, code, volume.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *resolution, 1.0, 0.0, 0.0, 0.0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + volume.astype(volume.dtype.newbyteorder("<")).tobytes(order="F")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{nii,nii.gz}").load(path).select("path", "content")


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Headers: vol_id, nx, ny, nz, nt, rx, ry, rz, kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = parse_header(_plain(content)[:352])
                rows.append((name, *h["size"], *map(float, h["resolution"]), h["kind"]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 3, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["vol_id", "nx", "ny", "nz", "nt", "rx", "ry", "rz", "kind"])

    return _files(spark, path).mapInArrow(run, "vol_id string, nx int, ny int, nz int, nt int, rx double, ry double, rz double, kind string")


def read_voxels(spark: SparkSession, path: str, skip_zero: bool = True) -> DataFrame:
    """vol_id, x, y, z, t, v, in slabs of bounded size; zeros are left out unless asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _plain(content)
                h = parse_header(data[:352])
                n = int(np.prod(h["size"]))
                flat = np.frombuffer(data, h["order"] + h["kind"], n, h["offset"])
                for at in range(0, n, SLAB):
                    v = flat[at : at + SLAB].astype(np.float64) * h["slope"] + h["inter"]
                    own = np.flatnonzero(v) if skip_zero else np.arange(len(v))
                    place = own + at
                    cols = []
                    for size in h["size"]:
                        place, k = np.divmod(place, size)
                        cols.append(pa.array(k.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), *cols, pa.array(v[own])], ["vol_id", "x", "y", "z", "t", "v"])

    return _files(spark, path).mapInArrow(run, "vol_id string, x int, y int, z int, t int, v double")


def encoded_volumes(voxels: DataFrame, size: tuple[int, int, int], kind: str = "f4") -> DataFrame:
    """vol_id and the bytes of its image, one volume a task; absent voxels are 0."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        volume = np.zeros(size, "<" + kind)
        volume[tuple(table[k].to_numpy() for k in "xyz")] = table["v"].to_numpy()
        return pa.table({"vol_id": [key[0].as_py()], "content": pa.array([encode(volume)], pa.binary())})

    return voxels.select("vol_id", "x", "y", "z", F.col("v").cast("double").alias("v")).groupBy("vol_id").applyInArrow(build, "vol_id string, content binary")
