"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are cut into blocks such that two fingerprints within the threshold differ in at most one
bit of some block: threshold // 2 + 1 blocks or, beyond MANY fingerprints, all pairs of threshold + 1 pieces, whose
blocks are longer and have more anchors. The anchors of a block are the words of a covering code: a perfect Hamming code
of 15 bits (covering radius 1) beside the block's remaining bits. A fingerprint belongs to its nearest anchor and is
replicated to each anchor within covering radius plus one, where every partner of that block must meet it; fingerprints
are compared per anchor over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, read_table, store
from .components import connected_components

#: Rows of an anchor that are compared in one task; larger anchors are cut into chunks, one task per pair of chunks.
CELL_ROWS = 8192
#: Up to this size, groups of one anchor are compared together, with array shifts.
SMALL_GROUP = 64
BUFFER_ROWS = 1 << 17
#: Links held at a time before they are passed on.
PAIR_ROWS = 1 << 20
HAMMING_BITS = 15
#: Distinct fingerprints from which blocks are made of two pieces: 10 x 2^21 anchors for a threshold of 4, not 3 x 2^17.
MANY = 1 << 22


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, shingles of `words` words hashed by XXH64 with seed 42."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = end - size
    width = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    spans = zip(start[: len(found) - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(found) - width + 1)
    return majority(hashes)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp long) of every document; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t or b"", words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks(threshold: int, rows: int = 0) -> list[list[tuple[int, int]]]:
    """Blocks as pieces (first bit, bits), one of which holds at most one of `threshold` differing bits."""
    n, take = threshold // 2 + 1, 1
    if rows > MANY and 128 // (threshold + 1) > 64 // n:
        n, take = threshold + 1, 2
    if 64 * take // n < HAMMING_BITS:
        raise ValueError("at most 7 differing bits are supported")
    cuts = [64 * i // n for i in range(n + 1)]
    return [list(c) for c in combinations([(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], take)]


@lru_cache(maxsize=1)
def _syndromes() -> np.ndarray:
    word = np.arange(1 << HAMMING_BITS)
    s = np.zeros(1 << HAMMING_BITS, np.int64)
    for bit in range(HAMMING_BITS):
        s ^= np.where(word >> bit & 1, bit + 1, 0)
    return s


def home_words(word: np.ndarray) -> np.ndarray:
    """The nearest code word of each word of HAMMING_BITS bits."""
    s = _syndromes()[word]
    return np.where(s > 0, word ^ (1 << np.maximum(s - 1, 0)), word)


def anchors(fp: np.ndarray, threshold: int, rows_in_all: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs: each fingerprint at all anchors within covering radius plus its block's share of bits."""
    syndrome = _syndromes()
    rows, keys = [], []
    at = np.arange(len(fp))
    for number, pieces in enumerate(blocks(threshold, rows_in_all)):
        block, bits = np.zeros(len(fp), np.int64), 0
        for first, size in pieces:
            block |= ((fp >> np.uint64(first)).astype(np.int64) & ((1 << size) - 1)) << bits
            bits += size
        word, rest = block & ((1 << HAMMING_BITS) - 1), block >> HAMMING_BITS
        s, home = syndrome[word], home_words(word)
        key = lambda code, other, n=number: (n << 58) | (other << HAMMING_BITS) | code
        rows.append(at)
        keys.append(key(home, rest))
        for bit in range(bits - HAMMING_BITS):
            rows.append(at)
            keys.append(key(home, rest ^ (1 << bit)))
        for bit in range(HAMMING_BITS):  # one more wrong bit leads to the code word that a third bit completes
            third = s ^ (bit + 1)
            take = np.flatnonzero((s > 0) & (third > bit + 1))
            rows.append(at[take])
            keys.append(key(home[take] ^ (1 << (s[take] - 1)) ^ (1 << bit) ^ (1 << (third[take] - 1)), rest[take]))
    return np.concatenate(rows), np.concatenate(keys)


def replicate(distinct: DataFrame, threshold: int, rows: int = 0) -> DataFrame:
    """(anchor, fp) for every anchor of each of some `rows` fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            row, key = anchors(fp.view(np.uint64), threshold, rows)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["anchor", "fp"])

    return distinct.mapInArrow(run, "anchor long, fp long")


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _small_links(group: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside small groups of equal `group` (sorted), as each row's root."""
    end = np.searchsorted(group, group, side="right")
    at, a, b = np.arange(len(fp)), [], []
    step = 1
    while len(at := at[at + step < end[at]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= threshold]
        a.append(near)
        b.append(near + step)
        step += 1
    if not a:
        return fp[:0], fp[:0]
    root = rooted(len(fp), np.concatenate(a), np.concatenate(b))
    own = np.flatnonzero(root != np.arange(len(fp)))
    return fp[own], fp[root[own]]


def _large_links(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one group: a search that compares each reached row with the rows not reached yet."""
    left, a, b = np.unique(fp), [], []
    while len(left):
        root, front, left = left[0], [int(left[0])], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ np.uint64(front.pop())) <= threshold
            if near.any():
                a.append(left[near])
                b.append(np.full(near.sum(), root))
                front += left[near].tolist()
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def by_cell(rows: DataFrame, columns: list[str], links: Callable) -> DataFrame:
    """Links (a long, b long) from rows sorted by (anchor, cell), some whole cells at a time.

    links(group, size, first, *columns) gives pairs of arrays; group numbers the rows' cells from 0, size and first
    are those of the cells, and all but `node` of the columns are unsigned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            pairs = np.concatenate([np.stack([np.minimum(a, b), np.maximum(a, b)], 1) for a, b in found]) if found else np.zeros((0, 2), np.uint64)
            pairs = np.unique(pairs, axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["a", "b"])

        def flush(anchor: np.ndarray, cell: np.ndarray, *own: np.ndarray) -> Iterator[pa.RecordBatch]:
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]
            group = np.cumsum(new) - 1
            own = [x.view(np.uint64) for x in own]
            found, n = [], 0
            for a, b in links(group, np.bincount(group), np.flatnonzero(new), *own):
                found.append((a, b))
                n += len(a)
                if n >= PAIR_ROWS:
                    yield distinct(found)
                    found, n = [], 0
            yield distinct(found)

        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            n += batch.num_rows
            if n < BUFFER_ROWS:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last cell may go on
            if cut:
                yield from flush(*(c[:cut] for c in cols))
            held, n = [tuple(c[cut:] for c in cols)], n - cut
        if n:
            yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.select("anchor", "cell", *columns).mapInArrow(run, "a long, b long")


def cells(replicas: DataFrame, ties: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """Replicas dealt by (anchor, cell) and sorted so. An anchor with more than `cell_rows` rows is cut into chunks by a
    hash of the fingerprint and `ties`, and each pair of chunks is compared in a cell of its own."""
    hot = store(
        replicas.groupBy("anchor").count().where(F.col("count") > cell_rows).select("anchor", F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks")),
        "hot-anchors",
    )
    chunk = F.pmod(F.xxhash64("fp", *ties), F.col("chunks")).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(F.col("chunk"), j) * F.col("chunks") + F.greatest(F.col("chunk"), j))
    dealt = (
        replicas.join(hot, "anchor", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", chunk)
        .select("anchor", F.explode(cell).alias("cell"), "fp", *ties)
    )
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "anchor", "cell").sortWithinPartitions("anchor", "cell", "fp", *ties)


def similar(distinct: DataFrame, threshold: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp long) that connect exactly those within `threshold` bits.

    Per anchor a link leads to the least fingerprint that the anchor's own links reach, so the rows stay below
    the number of replicas.
    """

    def links(group: np.ndarray, size: np.ndarray, first: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        small = size[group] <= SMALL_GROUP
        yield _small_links(group[small], fp[small], threshold)
        for g in np.flatnonzero(size > SMALL_GROUP):
            yield _large_links(fp[first[g] : first[g] + size[g]], threshold)

    return by_cell(cells(replicate(distinct.select("fp"), threshold, distinct.count()), [], cell_rows), ["fp"], links)


def near_duplicates(docs: DataFrame, words: int = 5, threshold: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text).

    component_id is the least doc_id reachable over links of fingerprints that differ in `threshold` bits at
    most; equal fingerprints are linked. Null and empty texts share fingerprint 0, which links like any other.
    A row with a null id keeps its place and takes the component's least id, null if it has none. Repeated rows
    stay. An empty table gives no rows. Only distinct fingerprints are compared.
    """
    prints = store(fingerprints(docs, words), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct-fingerprints")
    links = similar(distinct, threshold)
    rooted = connected_components(links)
    named = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = store(named.join(least, "root").select("fp", "component_id"), "classes")
    return hot_join(prints, classes, "fp", distinct, prints.count()).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: 4-word shingles, at most 4 differing bits."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), words=4, threshold=4)
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
