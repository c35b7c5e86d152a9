"""Token counts under edits: a segment tree of pre-tokens per document, re-encoded only where edits touch it.

A leaf holds LEAF pre-token runs or so: its characters and its tokens. An edit finds its leaves by descending the
sums, takes the leaf before and after as boundary context, and widens that region until its borders are places where
pre-tokenisation can't reach across (white space after a visible character). Only the region is encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import read_table

#: Characters a leaf has at least, but for the last; it ends before the next blank that follows a visible character.
LEAF_CHARS = 256
#: A blank after a visible character starts a new pre-token, whatever stands around it.
_BORDER = re.compile(r"(?<=\S) ")


class TokenTree:
    """Characters and tokens of a text's leaves under a binary tree of sums."""

    def __init__(self, text: str, coder: bpe.BytePairs, leaves: list[tuple[int, int]] | None = None) -> None:
        """A tree built from a text, or from its kept leaves (characters, tokens), which needs no encoding."""
        self.coder = coder
        self.encoded = 0  # characters encoded so far, by edits after the first build
        if leaves is None:
            self._build(self._leaves(text))
        else:
            ends = np.cumsum([n for n, _ in leaves]).tolist()
            self._build([(text[b - n : b], tokens) for b, (n, tokens) in zip(ends, leaves, strict=True)])
        self.encoded = 0

    @property
    def leaves(self) -> list[tuple[int, int]]:
        """Characters and tokens of each leaf, from which the tree can be built again."""
        return [(self.chars[self.base + i], self.tokens[self.base + i]) for i in range(len(self.texts))]

    def _leaves(self, text: str) -> list[tuple[str, int]]:
        out, at = [], 0
        while at < len(text):
            border = _BORDER.search(text, min(at + LEAF_CHARS, len(text)))
            end = border.start() if border else len(text)
            out.append(text[at:end])
            at = end
        self.encoded += len(text)
        return [(t, len(self.coder.encode_ordinary(t))) for t in out]

    def _build(self, leaves: list[tuple[str, int]]) -> None:
        self.texts = [t for t, _ in leaves]
        self.base = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = ([0] * (2 * self.base) for _ in range(2))
        for i, (t, n) in enumerate(leaves):
            self.chars[self.base + i], self.tokens[self.base + i] = len(t), n
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) that holds a place; the last leaf holds the end."""
        i, first = 1, 0
        while i < self.base:
            left = self.chars[2 * i]
            if place < first + left or not self.chars[2 * i + 1]:
                i = 2 * i
            else:
                first += left
                i = 2 * i + 1
        return i - self.base, first

    def edit(self, start: int, stop: int, put: str) -> None:
        """Replace characters start to stop (clipped to the text) by `put`."""
        total = self.chars[1]
        start = max(0, min(start, total))
        stop = max(start, min(stop, total))
        if not total:
            self._build(self._leaves(put))
            return
        low, first = self.leaf_at(start)
        high, _ = self.leaf_at(max(start, stop - 1))
        if low:  # what is put in may join the leaf before
            low -= 1
            first -= len(self.texts[low])
        high = min(len(self.texts) - 1, high + 1)
        old = "".join(self.texts[low : high + 1])
        new = old[: start - first] + put + old[stop - first :]
        while high + 1 < len(self.texts) and not (new and not new[-1].isspace()):  # the next leaf's blank is no border now
            high += 1
            new += self.texts[high]
        while low and not new.startswith(" "):  # the leaf before would run on
            low -= 1
            new = self.texts[low] + new
        leaves = self._leaves(new)
        if len(leaves) == high + 1 - low:
            for i, (t, n) in zip(range(low, high + 1), leaves, strict=True):
                self.texts[i] = t
                at = self.base + i
                self.chars[at], self.tokens[at] = len(t), n
            touched = {(self.base + i) >> 1 for i in range(low, high + 1)}
            while touched and 0 not in touched:
                for at in touched:
                    self._sum(at)
                touched = {at >> 1 for at in touched}
        else:  # leaves come or go: their sums are kept, the tree above is built anew
            known = [(t, self.tokens[self.base + i]) for i, t in enumerate(self.texts)]
            self._build(known[:low] + leaves + known[high + 1 :])


TREE = "doc_id long, text string, leaves array<struct<chars:long,tokens:long>>, tokens long"
_EDITS = "array<struct<start:long,stop:long,put:string>>"


def _applied(tree: TokenTree, changes: list[dict] | None) -> None:
    for change in changes or []:
        if change and change["start"] is not None and change["stop"] is not None:
            tree.edit(change["start"], change["stop"], change["put"] or "")


def trees(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, text, leaves and tokens of docs(doc_id, text): each document's tree, to be kept as a table. A null text is
    empty and has no leaves; repeated rows have a tree each."""
    path, pattern = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path, pattern)
        for batch in batches:
            yield _kept(batch.column(0), [TokenTree(t or "", coder) for t in batch.column(1).to_pylist()])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREE)


def edited(kept: DataFrame, edits: Column, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Trees of `trees` after `edits`, again as such a table: only what the edits touch is encoded."""
    path, pattern = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path, pattern)
        for batch in batches:
            found = []
            for text, leaves, changes in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                tree = TokenTree(text or "", coder, [(x["chars"], x["tokens"]) for x in leaves])
                _applied(tree, changes)
                found.append(tree)
            yield _kept(batch.column(0), found)

    return kept.select("doc_id", "text", "leaves", edits.cast(_EDITS).alias("edits")).mapInArrow(run, TREE)


def _kept(doc_ids: pa.Array, found: list[TokenTree]) -> pa.RecordBatch:
    leaf = pa.list_(pa.struct([("chars", pa.int64()), ("tokens", pa.int64())]))
    leaves = pa.array([[{"chars": c, "tokens": n} for c, n in t.leaves] for t in found], leaf)
    return pa.RecordBatch.from_arrays([doc_ids, pa.array([t.text for t in found], pa.string()), leaves, pa.array([t.count for t in found], pa.int64())], ["doc_id", "text", "leaves", "tokens"])


def recount(docs: DataFrame, edits: Column, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, tokens_before, tokens_after, chars_after, encoded_chars of docs(doc_id, text) under `edits`, a column of
    arrays of (start, stop, put) that apply one after another to the text as it then is.

    Places are code points and are clipped to the text. A null text is empty; null edits change nothing and a null
    `put` is empty. Special tokens' strings are ordinary text. Each row comes back once; nothing is shuffled.
    """
    path, pattern = vocabulary or bpe.default_vocabulary()
    names = ["doc_id", "tokens_before", "tokens_after", "chars_after", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text, changes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = TokenTree(text or "", coder)
                before = tree.count
                _applied(tree, changes)
                rows.append((doc_id, before, tree.count, tree.chars[1], tree.encoded))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    shaped = edits.cast(_EDITS).alias("edits")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), shaped)
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def fixed_edits(doc_id: Column, text: Column, n: int = 4) -> Column:
    """n edits per document from its id: each takes out up to 31 characters somewhere and puts in a short phrase."""
    length = F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1)).cast("long")

    def one(i: int) -> Column:
        draw = F.crc32(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(i))).cast("binary"))
        start = draw % length
        put = F.element_at(F.array(*map(F.lit, ["", " and then", "\n\n", "x", "  two  blanks ", "1234"])), (draw % 6 + 1).cast("int"))
        return F.struct(start.alias("start"), (start + F.shiftright(draw, 8) % 32).alias("stop"), put.alias("put"))

    return F.array(*map(one, range(n)))


def op3_edit_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after four edits each."""
    docs = read_table(spark, sf_dir, "documents")
    return recount(docs, fixed_edits(F.col("doc_id"), F.col("text")))
