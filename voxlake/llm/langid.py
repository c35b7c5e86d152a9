"""Language identification by hyperdimensional profiles.

Each letter has a random +1/-1 vector. An n-gram is bound by multiplying its letters' vectors, rotated by their
place; a text is the bundle (sum) of its n-grams, and a language's prototype is the bundle of its training texts.
A text takes the language whose prototype has the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, fold, fresh, numbered, quoted, read_table

DIMENSIONS, LETTERS = 1024, 3
SEED = 20_240_131
#: A block of texts is cut at so many code points, or so many texts; longer texts are blocks of their own.
BLOCK_CHARS, BLOCK_TEXTS = 1 << 19, 256
#: Cells of the dense table that finds the n-grams of a block; blocks with more letters are sorted instead.
DENSE_CELLS = 1 << 22
UNKNOWN = "und"
#: n-grams whose vectors stand in memory at a time, code points whose vectors a worker keeps, languages of a model.
GRAM_SLICE, KEPT_LETTERS, MOST_LANGUAGES = 1 << 12, 1 << 15, 4096


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """A +1/-1 row per code point, from the code point alone, so every worker draws the same."""
    return np.stack([np.random.default_rng((SEED, int(c))).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1 for c in codes]).astype(np.int8)


class Space:
    """Letter vectors that a worker has met."""

    def __init__(self, dimensions: int, letters: int) -> None:
        self.dimensions, self.letters = dimensions, letters
        self.rows: dict[int, np.ndarray] = {}

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """n-gram vectors (float32) of rows of code points."""
        codes, where = np.unique(grams, return_inverse=True)
        if len(self.rows) + len(codes) > KEPT_LETTERS:
            self.rows.clear()
        for c in codes.tolist():
            if c not in self.rows:
                self.rows[c] = letter_vectors(np.array([c]), self.dimensions)[0]
        base = np.stack([self.rows[c] for c in codes.tolist()])
        where = where.reshape(grams.shape)
        out = np.ones((len(grams), self.dimensions), np.float32)
        for place in range(self.letters):
            out *= np.roll(base, self.letters - 1 - place, axis=1)[where[:, place]]
        return out


def grams_of(texts: list[str], letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams as code points, text and n-gram of each group of equal ones, count) of a block.

    Texts are lower-cased; every run of other characters than letters, and both ends, is one blank. An n-gram
    holds at least one letter and lies within its text.
    """
    lower = [t.lower() for t in texts]
    size = np.fromiter(map(len, lower), np.int64, len(lower))
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[code] = True
    used = np.flatnonzero(seen)
    alphabet = np.array([c for c in used.tolist() if chr(c).isalpha()], np.int64)
    number = np.zeros(0x110000, np.int32)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    own = number[code]
    # a blank before and after each text; runs of blanks within a text shrink to one
    stream = np.zeros(len(own) + 2 * len(lower), np.int64)
    stream[np.arange(len(own)) + 2 * np.repeat(np.arange(len(lower)), size) + 1] = own
    owner = np.repeat(np.arange(len(lower)), size + 2)
    letter = stream > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[0] = True
    stream, owner = stream[keep], owner[keep]
    n = len(stream) - letters + 1
    if n <= 0 or not len(alphabet):
        return np.zeros((0, letters), np.int64), *(np.zeros(0, np.int64),) * 3
    base = len(alphabet) + 1
    packed = np.zeros(n, np.int64)
    for place in range(letters):
        packed = packed * base + stream[place : place + n]
    ok = (owner[:n] == owner[letters - 1 :]) & (packed > 0)
    packed, first = packed[ok], owner[:n][ok]
    if base**letters <= DENSE_CELLS:
        there = np.zeros(base**letters, bool)
        there[packed] = True
        kinds = np.flatnonzero(there)
        index = np.zeros(base**letters, np.int32)
        index[kinds] = np.arange(len(kinds))
        gram = index[packed].astype(np.int64)
    else:
        kinds, gram = np.unique(packed, return_inverse=True)
    cells = first * len(kinds) + gram
    if len(kinds) * len(texts) <= DENSE_CELLS:
        count = np.bincount(cells)
        cell = np.flatnonzero(count)
        count = count[cell]
    else:
        cell, count = np.unique(cells, return_counts=True)
    points = np.concatenate([[32], alphabet])
    digits = np.stack([kinds // base ** (letters - 1 - p) % base for p in range(letters)], 1)
    return points[digits], cell // max(len(kinds), 1), cell % max(len(kinds), 1), count


def exact_product(weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """weights @ vectors in doubles, whose vectors are widened 1024 at a time."""
    return sum((weights[:, i : i + 1024] @ vectors[i : i + 1024].astype(np.float64) for i in range(0, len(vectors), 1024)), np.zeros((len(weights), vectors.shape[1])))


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of blocks of bounded size."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and (size + len(t or "") > BLOCK_CHARS or len(held) >= BLOCK_TEXTS):
            yield first, held
            first, held, size = i, [], 0
        held.append(t or "")
        size += len(t or "")
    if held:
        yield first, held


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, letters: int = LETTERS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit prototypes from labelled(text, lang); null texts and labels take no part.

    Each task bundles per language; one row per language and task is summed in two steps. The result has one
    vector per distinct language, of which there may be MOST_LANGUAGES. Texts without letters leave no trace; a language
    of such texts alone is unknown.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dimensions, letters), {}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for first, block in _blocks(texts):
                grams, text, gram, count = grams_of(block, letters)
                if not len(grams):
                    continue
                names, which = np.unique(np.array(langs[first : first + len(block)], object), return_inverse=True)
                totals = np.zeros((len(names), dimensions))
                for at in range(0, len(grams), GRAM_SLICE):
                    own = (gram >= at) & (gram < at + GRAM_SLICE)
                    vectors = space.bound(grams[at : at + GRAM_SLICE])
                    weights = np.zeros((len(names), len(vectors)))
                    np.add.at(weights, (which[text[own]], gram[own] - at), count[own])
                    totals += exact_product(weights, vectors)
                for name, total in zip(names, totals, strict=True):
                    sums[name] = sums.get(name, 0) + total
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "bundle"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "bundle"])

    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    parts = rows.mapInArrow(bundle, "lang string, bundle binary")
    merged = parts.repartition(16, "lang").mapInArrow(merge, "lang string, bundle binary")
    sums: dict[str, np.ndarray] = {}
    for name, v in merged.collect():  # a row per language
        sums[name] = sums.get(name, 0) + np.frombuffer(v)
    known = sorted(k for k, v in sums.items() if np.any(v))
    if not known:
        return [], np.zeros((0, dimensions), np.float32)
    matrix = np.stack([sums[k] for k in known])
    return known, (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str], names: tuple[str, str] = ("lang_pred", "score"), dimensions: int = DIMENSIONS, letters: int = LETTERS) -> DataFrame:
    """docs' `keep` columns with lang_pred and score (or other `names`) (the cosine, not below 0) from the whole text.

    `und` with score 0 for a null text, one without a letter, or a model without languages. Ties go to the language
    that sorts first. Rows keep their number; the input may be empty.
    """
    known, prototypes = model
    kept = docs.select(*map(F.col, map(quoted, keep)))
    fields = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dimensions, letters)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            best = np.full(len(texts), -1)
            score = np.zeros(len(texts))
            for first, block in _blocks(texts):
                grams, text, gram, count = grams_of(block, letters)
                if not len(grams) or not known:
                    continue
                bundles = np.zeros((len(block), dimensions), np.float64 if len(gram) > GRAM_SLICE * 512 else np.float32)
                for low in range(0, len(grams), GRAM_SLICE):
                    inside = np.flatnonzero((gram >= low) & (gram < low + GRAM_SLICE)) if len(grams) > GRAM_SLICE else slice(None)
                    vectors = space.bound(grams[low : low + GRAM_SLICE])
                    whose, which, times = text[inside], gram[inside] - low, count[inside]
                    for at in range(0, len(block), 128):  # texts whose counts stand in memory at a time
                        own = slice(*np.searchsorted(whose, (at, at + 128)))
                        rows = np.zeros((min(128, len(block) - at), len(vectors)), np.float32)
                        rows[whose[own] - at, which[own]] = times[own]
                        bundles[at : at + 128] += rows @ vectors
                there = np.bincount(text, minlength=len(block)) > 0
                cosine = bundles @ prototypes.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)
                top = cosine.argmax(axis=1)
                where = first + np.flatnonzero(there)
                best[where] = top[there]
                score[where] = np.clip(cosine[np.arange(len(top)), top], 0, 1)[there]
            found = [known[i] if i >= 0 else UNKNOWN for i in best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score)], fields.names)

    text = F.col("text").cast("string").alias(fresh("text", kept))
    return numbered(docs.select(*columns(kept), text)).mapInArrow(run, fields)


def in_a_language(docs: DataFrame, learn: Column) -> DataFrame:
    """Rows of docs, all columns, whose text takes the profile of a language learnt from the rows where `learn` is true;
    null texts and those without a letter go."""
    names = fresh("lang_pred", docs), fresh("score", docs)
    found = predict(docs, train(docs.where(learn)), docs.columns, names)
    return found.where(F.col(names[0]) != UNKNOWN).select(*columns(docs))


def op6_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learnt from those whose fold of four is not 2."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
