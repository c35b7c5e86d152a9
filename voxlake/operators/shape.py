"""Shape models: principal components of vectors, projections, and Laplacian embeddings of small graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import covariance


def principal_components(rows: DataFrame, vector: str, n: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variances (descending) and axes of the first n components of a vector column.

    Sums of products are one aggregation; only the n x n covariance reaches the driver. Each axis has its largest
    entry positive, so the result doesn't depend on the solver's signs.
    """
    matrix = np.zeros((n, n))
    for i, j, value in covariance(rows, vector, n).collect():
        matrix[i, j] = matrix[j, i] = value
    mean = np.array(rows.agg(F.array(*[F.avg(F.col(vector)[i]) for i in range(n)])).first()[0])
    values, axes = np.linalg.eigh(matrix)
    order = np.argsort(-values)[:keep]
    axes = axes[:, order].T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return mean, values[order], axes * signs[:, None]


def projected(rows: DataFrame, ids: list[str], vector: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """Coordinates of each vector on the axes, as columns c0, c1, ..."""
    centred = [F.col(vector)[i] - float(m) for i, m in enumerate(mean)]
    coordinates = [sum((c * float(a) for c, a in zip(centred[1:], axis[1:], strict=True)), centred[0] * float(axis[0])) for axis in axes]
    return rows.select(*ids, *[c.alias(f"c{k}") for k, c in enumerate(coordinates)])


def spectral_embedding(edges: DataFrame, a: str, b: str, weight: str, keep: int) -> list[tuple[int, list[float]]]:
    """First non-trivial eigenvectors of the normalised Laplacian of a graph of few nodes (regions, not voxels)."""
    table = edges.select(a, b, weight).collect()  # pairs of regions
    nodes = sorted({r[0] for r in table} | {r[1] for r in table})
    at = {v: i for i, v in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for x, y, v in table:
        if x != y:
            w[at[x], at[y]] += v
            w[at[y], at[x]] += v
    degree = w.sum(axis=1)
    scale = 1 / np.sqrt(np.maximum(degree, 1e-12))
    laplacian = np.eye(len(nodes)) - scale[:, None] * w * scale[None, :]
    _, vectors = np.linalg.eigh(laplacian)
    chosen = vectors[:, 1 : keep + 1] * scale[:, None]
    signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])
    return [(v, list(map(float, row))) for v, row in zip(nodes, chosen * signs, strict=True)]
