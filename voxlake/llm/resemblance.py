"""Near-duplicates by resemblance of word shingles, found with SimHash fingerprints over covering anchors.

At a resemblance of 0.8 two fingerprints differ in about 15 of 100 bits, too many for a guarantee by blocks. So each text
gets 64 * WORDS bits of independent hashes, and blocks of them are drawn until a pair at the resemblance meets with a
probability of RECALL. The anchors of a block are the words of a covering code, a Hamming code of 15 bits beside raw bits
whose number follows the corpus; a text goes to the anchor within covering radius of its block, with a threshold of no
more bits. What meets there, differs in few enough of the first 128 bits and has a number of shingles that the
resemblance allows is a candidate.

Candidates only say who may belong together. Their connected groups are then compared whole, on the exact sets of
shingles: a group of up to GROUP_BYTES in one task; a larger one in chunks, first dealt twice by hashes, which settles
groups of true copies, then all pairs of chunks that still hold different classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import columns, extended, fresh, hot_join, numbered, store
from .components import connected_components

WORDS, RECALL = 4, 0.99
#: Texts that share an anchor by chance, some so many; raw bits of a block grow with the corpus to keep it so.
CROWD_BITS = 6
#: Deviations above the mean of differing bits that a candidate may show.
DEVIATIONS = 3.5
#: Bytes of shingle hashes compared in one task.
GROUP_BYTES = 1 << 20
SEED = 20_240_613


def shingle_hashes(text: bytes, words: int) -> tuple[int, np.ndarray]:
    """(hash of the normalised text, hashes of its shingles): A-Z lower-cased, split at white space."""
    found = text.lower().split()
    joined = b" ".join(found)
    if not found:
        return 0, np.zeros(0, np.uint64)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    width = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    spans = zip((end - size)[: len(found) - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)
    return digest(joined, 1), np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(found) - width + 1)


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Independent 64-bit hashes from hashes; word 0 leaves them as they are."""
    if not word:
        return hashes
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(uid, doc_id, node, shingles, f0.., hashes) per document: uid is unique, node the same for equal normalised
    texts, shingles the number of different ones and hashes 32 bits of each, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints, sets = [], [], [], []
            for text in batch.column(2).to_pylist():
                node, hashes = shingle_hashes(text or b"", words)
                hashes = np.unique(hashes)
                nodes.append(node)
                prints.append([simhash.majority(_mixed(hashes, w)) for w in range(WORDS)])
                short = np.unique((_mixed(hashes, WORDS) >> np.uint64(32)).astype(np.uint32))
                sizes.append(len(short))
                sets.append(short.tobytes())
            table = np.array(prints, np.uint64).reshape(-1, WORDS).view(np.int64)
            cols = [*batch.columns[:2], pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(table[:, w])) for w in range(WORDS)), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "node", "shingles", *(f"f{w}" for w in range(WORDS)), "hashes"])

    schema = "uid long, doc_id long, node long, shingles long, " + ", ".join(f"f{w} long" for w in range(WORDS)) + ", hashes binary"
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, schema)


def bit_rate(similarity: float) -> float:
    """Share of fingerprint bits in which sets of that resemblance differ: the angle between them over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def layout(similarity: float, rows: int) -> np.ndarray:
    """Bits of each block (a row per block), the first 15 for the code, as many blocks as RECALL takes.

    Two words of 15 bits have the same nearest code word if they agree, and in one of eight cases if they differ in one
    or two bits.
    """
    raw = min(max(2, (max(rows, 1) - 1).bit_length() - (simhash.HAMMING_BITS - 4) - CROWD_BITS), 24)
    p = bit_rate(similarity)
    q = 1 - p
    home = q**15 + (15 * p * q**14 + 105 * p**2 * q**13) / 8
    n = math.ceil(math.log(1 - RECALL) / math.log(1 - home * q**raw))
    size = simhash.HAMMING_BITS + raw
    rng = np.random.default_rng(SEED)
    drawn: list[np.ndarray] = []
    while len(drawn) < n:  # blocks of one permutation share no bit
        order = rng.permutation(64 * WORDS)
        drawn += [order[at : at + size] for at in range(0, len(order) - size + 1, size)]
    return np.array(drawn[:n])


def replicas(nodes: DataFrame, similarity: float, rows: int) -> DataFrame:
    """(anchor, fp, fp2, node, shingles): each of nodes(node, shingles, f0..) at its anchor of every block."""
    drawn = layout(similarity, rows)
    code = 1 << np.arange(drawn.shape[1], dtype=np.int64)
    low = (1 << simhash.HAMMING_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, shingles, *prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            bits = np.unpackbits(np.stack(prints, 1).view(np.uint8), axis=1, bitorder="little")
            for number, own in enumerate(drawn):
                word = bits[:, own] @ code
                key = (number << 48) | (word & ~low) | simhash.home_words(word & low)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, prints[0], prints[1], node, shingles)], ["anchor", "fp", "fp2", "node", "shingles"])

    return nodes.select("node", "shingles", *(f"f{w}" for w in range(WORDS))).mapInArrow(run, "anchor long, fp long, fp2 long, node long, shingles long")


class _Near:
    """Which texts may have the resemblance, by 128 bits and the numbers of shingles."""

    def __init__(self, similarity: float) -> None:
        p = bit_rate(similarity)
        self.bits, self.similarity = int(128 * p + DEVIATIONS * math.sqrt(128 * p * (1 - p))), similarity

    def __call__(self, rows: tuple[np.ndarray, ...], i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        f, g, size = rows
        x, y = size[i], size[j]
        return (np.bitwise_count(f[i] ^ f[j]) + np.bitwise_count(g[i] ^ g[j]) <= self.bits) & (np.minimum(x, y) >= self.similarity * np.maximum(x, y))


def candidates(cells: DataFrame, similarity: float) -> DataFrame:
    """(a, b) that connect the candidates of each cell, in fewer links than rows."""
    near = _Near(similarity)

    def links(group: np.ndarray, size: np.ndarray, first: np.ndarray, fp: np.ndarray, fp2: np.ndarray, node: np.ndarray, shingles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = (fp, fp2, shingles.astype(np.float64))
        at, a, b = np.flatnonzero(size[group] <= simhash.SMALL_GROUP), [], []
        end = (first + size)[group]
        step = 1
        while len(at := at[at + step < end[at]]):
            hit = at[near(rows, at, at + step)]
            a.append(hit)
            b.append(hit + step)
            step += 1
        if a:
            root = simhash.rooted(len(fp), np.concatenate(a), np.concatenate(b))
            own = np.flatnonzero(root != np.arange(len(fp)))
            yield node[own], node[root[own]]
        for k in np.flatnonzero(size > simhash.SMALL_GROUP):
            left = np.arange(first[k], first[k] + size[k])
            while len(left):
                root, front, left = left[0], [left[0]], left[1:]
                while front and len(left):
                    hit = near(rows, front.pop(), left)
                    if hit.any():
                        yield np.full(hit.sum(), node[root]), node[left[hit]]
                        front += left[hit].tolist()
                        left = left[~hit]

    return simhash.by_cell(cells, ["fp", "fp2", "node", "shingles"], links)


def compare(node: np.ndarray, root: np.ndarray, rows: tuple[np.ndarray, ...], sets: list[np.ndarray], similarity: float, near: _Near) -> list[tuple[int, int]]:
    """Pairs of nodes that join the classes (equal root) of one cell wherever two of them hold texts of the resemblance.

    Every pair of different classes that may have the resemblance is measured on its whole sets.
    """
    label = np.unique(root, return_inverse=True)[1]
    if not label.any():
        return []
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    term = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(term, kind="stable")
    holders, edge = owner[order], np.searchsorted(term[order], np.arange(term.max(initial=-1) + 2))
    start, out = np.cumsum(size) - size, []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[label[j] != label[i]]
        j = j[near(rows, i, j)] if len(j) else j
        if not len(j):
            continue
        own = term[start[i] : start[i] + size[i]]
        both = np.bincount(np.concatenate([holders[edge[t] : edge[t + 1]] for t in own]), minlength=len(sets))[j] if len(own) else np.zeros(len(j))
        for k in j[both >= similarity * (size[i] + size[j] - both)].tolist():
            if label[k] != label[i]:
                out.append((node[i], node[k]))
                label[label == label[k]] = label[i]
        if (label == label[0]).all():
            break
    return out


def verified(cells: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """(a, b) from cells(component, cell, uid, node, root): links that `compare` finds in each cell."""
    near = _Near(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> pa.RecordBatch:
            node, root, f, g, shingles, sets = zip(*held, strict=True)
            rows = np.array(f, np.int64).view(np.uint64), np.array(g, np.int64).view(np.uint64), np.array(shingles, np.float64)
            pairs = compare(np.array(node, np.int64), np.array(root, np.int64), rows, [np.frombuffer(s, np.uint32) for s in sets], similarity, near)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        held: list[tuple] = []
        now = None
        for batch in batches:
            for key, cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, cell) != now:
                    if len(held) > 1:
                        yield found()
                    now, held = (key, cell), []
                held.append(row)
        if len(held) > 1:
            yield found()

    rows = cells.select("component", "cell", "uid", "node", "root").hint("merge").join(prints.select("uid", "f0", "f1", "shingles", "hashes"), "uid").select("component", "cell", "node", "root", "f0", "f1", "shingles", "hashes")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "component", "cell").sortWithinPartitions("component", "cell").mapInArrow(run, "a long, b long")


def _part(parts: Column, seed: int) -> Column:
    """A text's chunk by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), "node"), parts)


def classes(nodes: DataFrame, prints: DataFrame, similarity: float, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(node, component) of all nodes(node, uid, shingles, f0..) that have a partner of the resemblance."""
    replicated = replicas(nodes, similarity, nodes.count())
    met = connected_components(candidates(simhash.cells(replicated, ["fp2", "node", "shingles"]), similarity).distinct())
    groups = store(nodes.select("node", "uid", "shingles").join(met, "node"), "groups")
    parts = groups.groupBy("component").agg(F.ceil(F.sum("shingles") * 4 / group_bytes).alias("parts")).where("parts > 1")
    dealt = store(groups.join(parts, "component", "left").withColumn("root", F.col("node")), "dealt")
    parts = F.coalesce("parts", F.lit(1))
    twice = F.when(parts == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array(_part(parts, 1), parts + _part(parts, 2)))
    links = store(verified(dealt.withColumn("cell", F.explode(twice)), prints, similarity), "links")
    rooted = connected_components(links)
    large = dealt.where("parts > 1")
    if large.isEmpty():
        return rooted
    again = large.drop("root").join(rooted.select("node", F.col("component").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = again.groupBy("component", "root").agg(F.sum("shingles").alias("size"))
    main = sizes.groupBy("component").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("size", "root")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all")).where("roots > 1")
    chunks = lambda c: F.greatest(F.ceil(c * 4 / group_bytes), F.lit(1).cast("long"))
    main = store(main.select("component", "main", chunks(F.col("most")).alias("mains"), chunks(F.col("all") - F.col("most")).alias("others")), "classes-left")
    if main.isEmpty():
        return rooted
    # chunks of the largest class meet those of all others, which meet one another
    left = again.join(main, "component").withColumn("own", F.when(F.col("root") == F.col("main"), _part(F.col("mains"), 3)).otherwise(_part(F.col("others"), 3)))
    others = F.sequence(F.lit(0).cast("long"), F.col("others") - 1)
    to_others = F.transform(others, lambda j: F.least("own", j) * F.col("others") + F.greatest("own", j))
    to_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mains") - 1), lambda j: F.col("others") * F.col("others") + F.col("own") * F.col("mains") + j)
    from_main = F.transform(others, lambda i: F.col("others") * F.col("others") + i * F.col("mains") + F.col("own"))
    cell = F.explode(F.when(F.col("root") == F.col("main"), from_main).otherwise(F.concat(to_others, to_main)))
    more = store(verified(left.withColumn("cell", cell), prints, similarity), "links")
    return connected_components(links.unionAll(more))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, node, component) of every row of docs(doc_id, text): documents of resemblance `similarity` or more
    share a component, and so do equal ones; node is the same for equal normalised texts.

    Null and empty texts are equal to each other. Texts of fewer words are one shingle. component is a node. Repeated
    rows and null ids keep their rows; an empty table gives no rows. A pair at the resemblance becomes a candidate with
    a probability of some RECALL, a more similar one almost surely; what is below `similarity` is not linked.
    """
    prints = store(signatures(docs, words), "signatures")
    firsts = [F.first(c).alias(c) for c in ["shingles", *(f"f{w}" for w in range(WORDS))]]
    nodes = store(prints.groupBy("node").agg(F.min("uid").alias("uid"), F.count("*").alias("n"), *firsts), "nodes")
    rooted = store(classes(nodes, prints, similarity, group_bytes), "classes")
    found = hot_join(prints.select("doc_id", "node"), rooted, "node", nodes, prints.count(), "left")
    return found.select("doc_id", "node", F.coalesce("component", "node").alias("component"))


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of docs, all columns, that stand for their group: the least doc_id's, nulls last, exactly one per group.

    Of rows that repeat the chosen id and text, the one that sorts first by all columns stays.
    """
    node, chosen_node, own = (fresh(n, docs) for n in ("node", "chosen", "own"))
    found = store(near_duplicates(docs, words, similarity), "classes")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("node").alias("k"))).alias("m"))
    best = best.join(found.groupBy("doc_id", "node").count(), F.col("m.i").eqNullSafe(F.col("doc_id")) & (F.col("m.k") == F.col("node")))
    chosen = store(best.select(F.col("m.i").alias(own), F.col("m.k").alias(chosen_node), F.col("count").alias("n")), "representatives")
    same = (F.col(node) == F.col(chosen_node)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own))
    marked = with_node(docs, node)
    kept = marked.join(chosen.where("n = 1").select(own, chosen_node).hint("merge"), same, "left_semi").select(*columns(docs))
    repeated = chosen.where("n > 1").select(own, chosen_node)
    if repeated.isEmpty():
        return kept
    rows = marked.join(repeated, same, "left_semi")
    first = rows.groupBy(node, F.col("doc_id").cast("long").alias(own)).agg(F.min(F.struct(*columns(docs))).alias(chosen_node))
    return kept.unionByName(first.select(f"{chosen_node}.*"))


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """docs with the hash of the normalised text as a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            node = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w), 1) if (w := (t or b"").lower().split()) else 0 for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(node.view(np.int64))], schema.names)

    schema = extended(docs, f"{name} long")
    return numbered(docs.select(*columns(docs), F.col("text").cast("binary").alias(fresh("text", docs)))).mapInArrow(run, schema)
