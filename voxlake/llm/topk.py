"""Exact top-k by inner product: term-at-a-time accumulation of postings into dense score arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, read_table, store

#: Queries of one pass over the candidates; what reaches the driver and each task is a block of vectors at most.
QUERY_BLOCK = 8192
#: Candidates whose scores stand in memory at a time.
ROW_BLOCK = 8192
#: Terms up to this are held as 64-bit integers; rows with larger ones as Python integers.
PLAIN = 2.0**31
#: Scores from here on may leave 64 bits and are summed as Python integers.
EXACT = 2**62
LEAST, MOST = -(2**63), 2**63 - 1
#: Bytes of the order key of scores that don't fit a long: 64-bit floats times 256, squared and summed, stay below.
WIDE_BYTES = 272


def quantized(values: list[list[float] | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that take part (by position), and their terms floor(256 * x): int64, or Python integers beyond PLAIN."""
    keep, rows = [], []
    for i, v in enumerate(values):
        if v is None or None in v:
            continue
        x = np.asarray(v, np.float64)
        if not np.all(np.isfinite(x)):
            continue
        keep.append(i)
        if len(x) and np.abs(x).max() > PLAIN / 512:
            rows.append(np.array([math.floor(256 * Fraction(e)) for e in x.tolist()], object))
        else:
            rows.append(np.floor(256.0 * x).astype(np.int64))
    return np.array(keep, np.int64), rows


class Candidates:
    """Some rows as postings, term -> (rows, weights) without zeros."""

    def __init__(self, ids: np.ndarray, rows: list[np.ndarray]) -> None:
        self.ids, self.rows = ids, rows
        width = max(map(len, rows), default=0)
        self.kind = object if any(r.dtype == object for r in rows) else np.int64
        dense = np.zeros((len(rows), width), self.kind)
        for i, r in enumerate(rows):
            dense[i, : len(r)] = r
        self.most = int(np.abs(dense).max()) if dense.size else 0
        self.lists = {t: (hit, dense[hit, t]) for t in range(width) if len(hit := np.flatnonzero(dense[:, t]))}

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Inner products with one query, exact: 64-bit where no sum can leave it, else Python integers."""
        reach = int(np.abs(query).max()) * self.most * len(query) if len(query) else 0
        kind = np.int64 if self.kind is not object and query.dtype != object and reach < EXACT else object
        scores = np.zeros(len(self.rows), kind)
        accumulate(query.astype(kind), self.lists if kind is self.kind else {t: (h, w.astype(kind)) for t, (h, w) in self.lists.items()}, scores)
        return scores

    def own(self, query_id: int, query: np.ndarray) -> np.ndarray:
        """Rows that are the query's own: of its id and terms."""
        same = np.flatnonzero(self.ids == query_id)
        return np.array([i for i in same if np.array_equal(self.rows[i], query)], np.int64)


def accumulate(query: np.ndarray, lists: dict, scores: np.ndarray) -> None:
    """Scatter one sparse query's weighted postings into its dense score array."""
    for t in np.flatnonzero(query):
        if (found := lists.get(int(t))) is not None:
            hit, weight = found
            if len(hit) == len(scores):
                scores += query[t] * weight
            else:
                scores[hit] += query[t] * weight


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id ascending), by partition selection."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _wide(score: int) -> bytes | None:
    """A key in the order of scores that don't fit a long."""
    return None if LEAST < score < MOST else (score + (1 << (8 * WIDE_BYTES - 1))).to_bytes(WIDE_BYTES, "big")


def _pass(rows: DataFrame, numbers: list[int], query_ids: list[int], query_terms: list[np.ndarray], k: int) -> DataFrame:
    """The k + 1 best rows of every block of candidates for each query, the query's own marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(ids: list[int], vectors: list) -> Iterator[pa.RecordBatch]:
            keep, terms = quantized(vectors)
            ids = np.array(ids, np.int64)[keep]
            wide = np.array([r.dtype == object for r in terms], bool)
            for part in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                if not len(part):
                    continue
                block, out = Candidates(ids[part], [terms[i] for i in part]), []
                for number, query_id, query in zip(numbers, query_ids, query_terms, strict=True):
                    scores = block.scores(query)
                    best = select(scores, block.ids, k + 1)
                    own = np.isin(best, block.own(query_id, query))
                    exact = scores[best].tolist()
                    out += [(number, query_id, int(block.ids[i]), min(max(s, LEAST), MOST), _wide(s), bool(o)) for i, s, o in zip(best, exact, own, strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["number", "query_id", "vec_id", "score", "wide", "own"])

        held: list[int] = []
        vectors: list = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            if len(held) >= ROW_BLOCK:
                yield from flush(held, vectors)
                held, vectors = [], []
        if held:
            yield from flush(held, vectors)

    return rows.mapInArrow(run, "number long, query_id long, vec_id long, score long, wide binary, own boolean")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """The k best candidates of every query row: query_id, rank from 1, vec_id, score; ties to the smaller id.

    Both tables hold (vec_id, embedding). Queries are dealt to blocks of some `block` vectors by a hash; each block is
    one scan of all candidates, whose tasks give k + 1 rows per query and candidate block to a table, and a window
    merges them. Vectors that are null or hold null, NaN or infinite components take no part, nor do null ids; vectors
    of other lengths meet on the terms they share. Every query row asks, repeated ids and rows too, and finds all rows
    but one of its own id and vector. Sums are exact; a score beyond a long ranks by its value and is given as the
    nearest long. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    usable = "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable)
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable)
    asked = asked.groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    asked = store(asked.withColumn("number", F.monotonically_increasing_id()), "queries")
    passes = -(-asked.count() // max(block // 2, 1))
    best = None
    if passes:
        path = new_path(spark, "best")
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(passes)))
        for i in range(passes):
            got = dealt.where(F.col("block") == i).select("number", "vec_id", "embedding").collect()  # some `block` / 2 rows
            keep, terms = quantized([r[2] for r in got])
            if got:
                _pass(rows, [got[j][0] for j in keep], [got[j][1] for j in keep], terms, k).write.mode("append").parquet(path)
        best = spark.read.parquet(path)
    if best is None:
        best = spark.createDataFrame([], "number long, query_id long, vec_id long, score long, wide binary, own boolean")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.desc("wide"), "vec_id", F.desc("own"))
    passed = F.sum(F.col("own").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = best.withColumns({"passed": passed, "place": F.row_number().over(order)})
    ranked = ranked.withColumn("rank", F.col("place") - F.least(F.col("passed"), F.lit(1)).cast("int")).where(~(F.col("own") & (F.col("passed") == 1)) & (F.col("rank") <= k))
    repeated = ranked.join(asked.select("number", "times"), "number").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return repeated.select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other embeddings for every vec_id divisible by 50."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
