"""Operators that repeat a step until nothing changes: components, holes, distances, diffusion and propagation."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stencil


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the folder in spark.checkpoint.dir, which executors share. Where it is unset, a local session
    takes a folder of its own and a cluster is refused."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="fixpoint-"))
    return df.checkpoint()


def fixpoint(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], tuple], rounds: int | None = None) -> DataFrame:
    """Repeat step until the measure of two states is the same, or `rounds` times where given; each state is checkpointed."""
    state = cut(state)
    seen = measure(state)
    for _ in count() if rounds is None else range(rounds):
        state = cut(step(state))
        now = measure(state)
        if now == seen:
            break
        seen = now
    return state


#: Side of the blocks whose parts are labelled in one step.
BLOCK = 32


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of all ends of edges (a long, b long), the label the least node reachable: neighbours above a node
    hang on its least neighbour, then those below it, in turns, so rounds grow with the logarithm of a path."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select("b", "b").distinct())
        seen = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(hung.unionAll(least.select("a", F.col("m").alias("b"))).distinct())


def components(mask: DataFrame, keys: list[str], size: tuple[int, ...], connectivity: int = 6, within: str | None = None) -> DataFrame:
    """keys and component (the least linear place, x fastest) of a mask's voxels; with `within`, a column of labels, parts
    of each label.

    Blocks of BLOCK voxels a side are labelled by themselves, a block a task at most; pairs of neighbours across their
    borders then connect the blocks' parts, so only border voxels meet in joins.
    """
    place, scale = F.lit(0).cast("long"), 1
    for k, n in zip(keys, size, strict=True):
        place, scale = place + F.col(k).cast("long") * scale, scale * n
    own = F.col(within).cast("long") if within else F.lit(0).cast("long")
    home = [F.floor(F.col(k) / BLOCK).cast("int").alias(f"_b{i}") for i, k in enumerate(keys)]
    nodes = mask.select(*[F.col(k).cast("int").alias(k) for k in keys], own.alias("_own"), place.alias("_node"), *home)
    steps = [o for o in stencil.neighbours(connectivity, len(keys)) if o > (0,) * len(keys)]

    def label(key: tuple, table: pa.Table) -> pa.Table:
        at = np.stack([table[k].to_numpy() for k in keys], 1)
        at = at - at.min(axis=0)
        cube = np.full(at.max(axis=0) + 2, -1)  # one voxel of air on the far sides, which index -1 reaches as well
        cube[tuple(at.T)] = np.arange(len(at))
        labels, node = table["_own"].to_numpy(), table["_node"].to_numpy()
        pairs = []
        for step in steps:
            other = cube[tuple((at + step).T)]
            hit = np.flatnonzero(other >= 0)
            pairs.append(np.stack([hit, other[hit]]))
        a, b = np.concatenate(pairs, axis=1)
        same = labels[a] == labels[b]
        a, b = a[same], b[same]
        rank = np.argsort(np.argsort(node))
        by = np.argsort(node)
        root = rank.copy()
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = np.minimum(new, new[by[new]])
            if np.array_equal(new, root):
                break
            root = new
        return pa.table({**{k: table[k] for k in keys}, "_own": table["_own"], "_part": pa.array(node[by[root]])})

    schema = ", ".join(f"{k} int" for k in keys) + ", _own long, _part long"
    parts = cut(nodes.groupBy(*[f"_b{i}" for i in range(len(keys))]).applyInArrow(label, schema))
    edge = reduce(Column.__or__, [(F.col(k) % BLOCK == 0) | (F.col(k) % BLOCK == BLOCK - 1) for k in keys])
    rim = parts.where(edge)
    pairs = stencil.stencil(rim, [*keys, "_own"], [(*o, 0) for o in steps], ["_part"], ["_part"])
    links = connected(pairs.select(F.col("_part").alias("a"), F.col("n__part").alias("b")))
    done = parts.join(links, parts["_part"] == links["node"], "left").withColumn("component", F.coalesce("label", "_part"))
    return done.select(*keys, *([F.col("_own").alias(within)] if within else []), "component")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 1 in an order, which must tell all rows apart: ranges of rows are numbered by
    themselves, after the rows of the ranges before them."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    up = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = dealt.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(F.sum("_c").over(up), F.lit(0)).alias("_from"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_k", place).join(before, "_p").withColumn(name, (F.col("_k") + F.col("_from")).cast("int")).drop("_p", "_k", "_from")


def component_sizes(parts: DataFrame) -> DataFrame:
    """component, voxels and rank by size, the largest first."""
    sizes = parts.groupBy("component").agg(F.count("*").alias("voxels"))
    return numbered(sizes, [F.desc("voxels"), F.col("component")], "rank").select("component", "voxels", "rank")


def largest(parts: DataFrame, n: int = 1) -> DataFrame:
    best = parts.groupBy("component").agg(F.count("*").alias("voxels")).orderBy(F.desc("voxels"), "component").limit(n)
    return parts.join(best.select("component"), "component", "left_semi")


def filled(mask: DataFrame, grid: DataFrame, keys: list[str], size: tuple[int, ...], connectivity: int = 6) -> DataFrame:
    """The mask with its holes: parts of its complement in the grid that don't touch the grid's edge."""
    outside = grid.select(*keys).join(mask.select(*keys), keys, "left_anti")
    parts = components(outside, keys, size, connectivity)
    edge = reduce(Column.__or__, [(F.col(k) == 0) | (F.col(k) == n - 1) for k, n in zip(keys, size, strict=True)])
    open_ = parts.where(edge).select("component").distinct()
    return mask.select(*keys).unionByName(parts.join(open_, "component", "left_anti").select(*keys))


def detection(a: DataFrame, b: DataFrame, keys: list[str], size: tuple[int, ...], connectivity: int = 18) -> DataFrame:
    """Detected clusters of b that a touches, total clusters of b, and clusters of a without overlap."""
    of_a, of_b = components(a, keys, size, connectivity), components(b, keys, size, connectivity)
    hit_b = of_b.join(a.select(*keys), keys, "left_semi").agg(F.countDistinct("component").alias("detected"))
    hit_a = of_a.join(b.select(*keys), keys, "left_semi").agg(F.countDistinct("component").alias("_hit"))
    all_b = of_b.agg(F.countDistinct("component").alias("total_clusters"))
    all_a = of_a.agg(F.countDistinct("component").alias("total_detections"))
    one = hit_b.crossJoin(all_b).crossJoin(all_a).crossJoin(hit_a)  # four one-row tables
    return one.select("detected", "total_clusters", "total_detections", (F.col("total_detections") - F.col("_hit")).alias("false_detections"))


def chamfer_distance(grid: DataFrame, keys: list[str], source: Column, weights: dict[int, float], rounds: int | None = None) -> DataFrame:
    """Least weighted path length from `source` voxels through present voxels; weights by number of moved axes."""
    near = [(o, weights[sum(map(abs, o))]) for o in stencil.neighbours(26, len(keys)) if sum(map(abs, o)) in weights]
    moves = F.array(*[F.struct(*[F.lit(d).alias(k) for k, d in zip(keys, o, strict=True)], F.lit(w).alias("w")) for o, w in near])
    start = grid.select(*keys, F.when(source, F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("distance"))

    def step(state: DataFrame) -> DataFrame:
        sent = state.where(F.col("distance") < float("inf")).select(*keys, "distance", F.explode(moves).alias("m"))
        reach = sent.select(*[(F.col(k) + F.col(f"m.{k}")).alias(k) for k in keys], (F.col("distance") + F.col("m.w")).alias("d")).groupBy(*keys).agg(F.min("d").alias("d"))
        return state.join(reach, keys, "left").select(*keys, F.least("distance", F.coalesce("d", "distance")).alias("distance"))

    def measure(state: DataFrame) -> tuple:
        finite = F.when(F.col("distance") < float("inf"), F.round(F.col("distance"), 6).cast("decimal(20,6)"))
        return tuple(state.agg(F.count(finite), F.sum(finite)).first())

    return fixpoint(start, step, measure, rounds)


def diffused(grid: DataFrame, keys: list[str], value: str, rate: float, rounds: int) -> DataFrame:
    """Explicit diffusion over present 6-neighbours: v += rate * (mean of neighbours - v), `rounds` times."""
    state = grid.select(*keys, F.col(value).alias("diffused"))
    for _ in range(rounds):
        mean = stencil.neighbour_mean(state, keys, "diffused", stencil.neighbours(6, len(keys)))
        state = state.join(mean, keys, "left").select(*keys, (F.col("diffused") + rate * (F.coalesce("mean", "diffused") - F.col("diffused"))).alias("diffused"))
        state = cut(state)
    return state


def propagated(grid: DataFrame, keys: list[str], value: str, known: Column, rounds: int) -> DataFrame:
    """Mean of known 26-neighbours carried into unknown voxels, one shell a round; null where nothing arrives."""
    state = grid.select(*keys, F.when(known, F.col(value)).alias("carried"))
    for _ in range(rounds):
        near = stencil.shifted(state.where("carried is not null"), keys, stencil.neighbours(26, len(keys)), ["carried"]).groupBy(*keys).agg(F.avg("n_carried").alias("near"))
        state = state.join(near, keys, "left").select(*keys, F.coalesce("carried", "near").alias("carried"))
        state = cut(state)
    return state
