"""Clustering and graphs: fuzzy and hard centroids, affinity edges, mutual-best merging and loop counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuzzy_centroids(rows: DataFrame, value: str, centroids: list[float], rounds: int) -> list[float]:
    """Fuzzy c-means centroids (exponent 2) of one intensity; each round is one aggregation to a row."""
    v = F.col(value)
    for _ in range(rounds):
        inverse = [1 / (F.pow(v - c, F.lit(2)) + F.lit(1e-12)) for c in centroids]
        total = sum(inverse[1:], inverse[0])
        squares = [F.pow(i / total, F.lit(2)) for i in inverse]
        centroids = list(rows.agg(*[(F.sum(s * v) / F.sum(s)) for s in squares]).first())
    return centroids


def memberships(rows: DataFrame, value: str, centroids: list[float]) -> DataFrame:
    """Hard class from 1 (the largest fuzzy membership) and that membership."""
    inverse = [1 / (F.pow(F.col(value) - c, F.lit(2)) + F.lit(1e-12)) for c in centroids]
    total = sum(inverse[1:], inverse[0])
    shares = F.array(*[i / total for i in inverse])
    best = F.array_max(shares)
    return rows.withColumn("membership", best).withColumn("cluster", F.array_position(shares, best).cast("int"))


def affinity(a: Column, b: Column, scale: float, how: str = "gaussian") -> Column:
    """Similarity of two neighbouring values."""
    d = (a - b) / scale
    return {"gaussian": F.exp(-d * d / 2), "cauchy": 1 / (1 + d * d)}[how]


def best_partners(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Pairs that are each other's best link, ties to the smaller partner: one round of hierarchical merging."""
    both = edges.select(a, b, weight).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), weight))
    best = both.groupBy(a).agg(F.max_by(b, F.struct(weight, -F.col(b))).alias("best"))
    back = best.select(F.col(a).alias("best"), F.col("best").alias(a))
    return best.join(back, [a, "best"]).where(F.col(a) < F.col("best"))


def degrees(edges: DataFrame, a: str, b: str) -> DataFrame:
    long = edges.select(F.explode(F.array(a, b)).alias("node"))
    return long.groupBy("node").agg(F.count("*").alias("degree"))


def loops(edges: DataFrame, a: str, b: str, parts: DataFrame) -> DataFrame:
    """Independent loops per component: edges - vertices + 1; parts(node, component)."""
    n = parts.groupBy("component").agg(F.count("*").alias("nodes"))
    e = edges.join(parts.withColumnRenamed("node", a), a).groupBy("component").agg(F.count("*").alias("edges"))
    return n.join(e, "component", "left").select("component", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), (F.coalesce("edges", F.lit(0)) - F.col("nodes") + 1).alias("loops"))


def octree(rows: DataFrame, keys: list[str], value: str, levels: int) -> DataFrame:
    """Mean, count and squared deviation of every octree cell, all levels from one pass over the finest sums."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    moved = rows.select(cell, *keys, value)
    up = [F.floor(F.col(k) / F.pow(F.lit(2), F.col("level"))).cast("int").alias(k) for k in keys]
    return moved.groupBy("level", *up).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count("*")).alias("deviation"))


def covariance(rows: DataFrame, vector: str, n: int) -> DataFrame:
    """Covariance of the first n components: i, j (i <= j), value. Each task sums its vectors' outer products around the
    first vector it meets; n * n rows a task are merged by pairwise formulas."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, spread = 0, np.zeros(n), np.zeros((n, n))
        for batch in batches:
            x = np.array([v[:n] for v in batch.column(0).to_pylist() if v is not None and None not in v[:n] and len(v) >= n], float).reshape(-1, n)
            if len(x):
                own = x.mean(axis=0)
                gap = own - mean
                total = count + len(x)
                spread += (x - own).T @ (x - own) + np.outer(gap, gap) * count * len(x) / total
                mean, count = mean + gap * len(x) / total, total
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], ["n", "mean", "spread"])

    parts = rows.select(vector).mapInArrow(sums, "n long, mean array<double>, spread array<double>")
    at = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("k")
    flat = parts.select("n", "mean", "spread", at).withColumns({"i": F.floor(F.col("k") / n).cast("int"), "j": (F.col("k") % n).cast("int")}).where("i <= j")
    a, b = F.col("mean")[F.col("i")], F.col("mean")[F.col("j")]
    sums_ = flat.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("spread")[F.col("k")]).alias("s"), F.sum(F.col("n") * a).alias("a"), F.sum(F.col("n") * b).alias("b"), F.sum(F.col("n") * a * b).alias("ab"))
    return sums_.select("i", "j", ((F.col("s") + F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.col("n")).alias("value"))
