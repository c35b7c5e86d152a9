"""Packing of tokenised documents into fixed-length sequences by length patterns.

Patterns are all pairs and triples of piece lengths that fill a sequence exactly. Non-negative least squares fits
their repeat counts to the histogram of lengths, counts are rounded down, and best fit packs what is left. Only the
histogram (one count per length) reaches the driver; pieces find their places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import extended, read_table, store

#: Rows of one length that a task ranks at a time.
RANK_ROWS = 100_000
#: Sweeps of the least-squares fit at most; it stops when a sweep improves the fit by less than a thousandth.
SWEEPS = 80

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all are full, but the first may be shorter."""
    first = n % room or room
    return [(0, min(n, first)), *((s, room) for s in range(first, n, room))]


def pieces(docs: DataFrame, room: int, end_id: int = 0, vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian unsigned 32-bit) of docs(doc_id, text).

    A null or empty text has the end id alone. Texts are encoded whole.
    """
    path, pattern = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path, pattern)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([coder.encode(text or ""), end]).astype("<u4")
                for i, (start, n) in enumerate(cut(len(ids), room)):
                    own = ids[start : start + n].tobytes()
                    rows.append((doc_id, i, start, n, zlib.crc32(own), own) if with_ids else (doc_id, i, start, n, zlib.crc32(own)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names[: len(cols)])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def fit_patterns(counts: np.ndarray, room: int) -> dict[tuple[int, ...], float]:
    """Repeat counts of exact pairs and triples by non-negative least squares against counts[length].

    Block coordinate descent: in a sweep, patterns are taken by the steepest gradient, each length in one pattern
    at most, and each coefficient moves to its own optimum, not below zero. Triples are enumerated as a length
    beside the best pair of the rest, so every pattern is in reach of every sweep.
    """
    want = counts[: room + 1].astype(np.float64).copy()
    want[0] = want[room] = 0
    left = want.copy()
    live = want > 0
    found: dict[tuple[int, ...], float] = defaultdict(float)
    lengths = np.flatnonzero(live)
    if not len(lengths):
        return {}
    before = float(left @ left)
    for _ in range(SWEEPS):
        price = np.where(live, left, -np.inf)
        price[0] = 0.0  # a pair is a triple with an empty third part
        pair = price[:, None] + price[None, :]
        best_b = np.zeros(room + 1, np.int64)
        best_v = np.full(room + 1, -np.inf)
        for rest in range(1, room):
            b = np.arange(0, rest // 2 + 1)
            v = pair[b, rest - b]
            k = int(np.argmax(v))
            best_b[rest], best_v[rest] = b[k], v[k]
        value = left[lengths] + best_v[room - lengths]
        order = lengths[np.argsort(-value, kind="stable")]
        moved: set[int] = set()
        steps = [tuple(sorted(x for x in (int(a), int(best_b[room - a]), int(room - a - best_b[room - a])) if x)) for a in order if np.isfinite(best_v[room - a])]
        steps += sorted(found, key=lambda p: sum(left[x] for x in p))[:64]  # coefficients that are too large
        for pattern in steps:
            if any(x in moved for x in pattern):
                continue
            parts = defaultdict(int)
            for x in pattern:
                parts[x] += 1
            slope = sum(n * left[x] for x, n in parts.items())
            step = max(slope / sum(n * n for n in parts.values()), -found.get(pattern, 0.0))
            if abs(step) < 1e-3:
                continue
            found[pattern] += step
            for x, n in parts.items():
                left[x] -= n * step
            moved.update(parts)
        now = float(left @ left)
        if not moved or before - now < 1e-3 * before:
            break
        before = now
    return {p: x for p, x in found.items() if x > 0}


def plan(counts: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that hold each length as often as counts[length] says."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []
    if left[room]:
        out.append(((room,), int(left[room])))
        left[room] = 0
    for pattern, x in sorted(fit_patterns(left, room).items(), key=lambda p: (-p[1], p[0])):
        parts = defaultdict(int)
        for a in pattern:
            parts[a] += 1
        repeats = min(int(x + 1e-9), *(int(left[a]) // n for a, n in parts.items()))
        if repeats > 0:
            out.append((pattern, repeats))
            for a, n in parts.items():
                left[a] -= n * repeats
    return out + best_fit(left, room)


def best_fit(counts: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram: equal sequences are kept as one entry with a count."""
    open_: list[dict[tuple[int, ...], int]] = [defaultdict(int) for _ in range(room + 1)]  # by free room
    filled = np.zeros(room + 1, bool)
    for length in range(room, 0, -1):
        n = int(counts[length])
        while n:
            free = np.flatnonzero(filled[length:])
            if len(free):
                gap = int(free[0]) + length
                held = open_[gap]
                parts = next(iter(held))
                take = min(n, held[parts])
                held[parts] -= take
                if not held[parts]:
                    del held[parts]
                filled[gap] = bool(held)
            else:
                gap, parts = room, ()
                fits = room // length
                take = n if fits == 1 or n < fits else n // fits
                if n >= fits > 1:  # whole sequences of this length at once
                    open_[room - fits * length][(length,) * fits] += take
                    filled[room - fits * length] = True
                    n -= take * fits
                    continue
                take = 1 if fits > 1 else n
            open_[gap - length][(*parts, length)] += take
            filled[gap - length] = True
            n -= take
    return [(parts, n) for held in open_ for parts, n in held.items()]


def pack(parts: DataFrame, room: int) -> DataFrame:
    """parts(doc_id, piece, ids_crc32, length, ...) with sequence_id and offset, gapless from 0 in each sequence.

    Lengths are 1 to room. The histogram has `room` rows at most; ranks within a length are dealt over sub-buckets
    of some RANK_ROWS rows, so a frequent length does not meet in one task. Rows that are equal in id, piece and
    checksum take their places in any order. An empty table gives an empty result.
    """
    spark = parts.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}
    counts = np.zeros(room + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    entries, key, first, at = [], [], 0, np.zeros(room + 1, np.int64)
    for lengths, repeats in plan(counts, room):
        offset = 0
        for length in lengths:
            key.append((length << 44) + int(at[length]))
            entries.append((first - int(at[length]), offset))
            at[length] += repeats
            offset += length
        first += repeats
    order = np.argsort(np.array(key, np.int64))
    keys = np.array(key, np.int64)[order]
    table = np.array(entries, np.int64).reshape(-1, 2)[order]

    subs = spark.createDataFrame([(length, -(-n // RANK_ROWS)) for length, n in histogram.items()], "length long, _subs long")
    dealt = parts.join(F.broadcast(subs), "length").withColumn("_sub", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_subs")))
    sizes = dealt.groupBy("length", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    rank = F.row_number().over(Window.partitionBy("length", "_sub").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("_rank", rank).join(offsets, ["length", "_sub"]).withColumn("_rank", F.col("_from") + F.col("_rank") - 1)
    ranked = ranked.select(*parts.columns, "_rank")
    names = [*parts.columns, "sequence_id", "offset"]
    length_at = parts.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(len(names) - 2).to_numpy(zero_copy_only=False)
            length = batch.column(length_at).to_numpy(zero_copy_only=False)
            entry = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            cols = [*batch.columns[:-1], pa.array(table[entry, 0] + rank), pa.array(table[entry, 1])]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = extended(parts, "sequence_id long, offset long")
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, room: int = 2048, end_id: int = 0, vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text) with their places in sequences of at most `room` ids."""
    return pack(store(pieces(docs, room, end_id, vocabulary, with_ids), "pieces"), room)


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
