"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = floor(rate * m) edits. Cut into k + 1 pieces, one piece at least
occurs unchanged in any such occurrence; all pieces of all items are found in one pass over a text (Aho-Corasick), and
the text around each hit is verified by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, drop_path, fresh, new_path, numbered, read_table, store

#: Edits allowed per character of an item. At this rate pieces have some 12 characters, which ordinary prose seldom hits.
RATE = 0.08
#: Shorter normalised items must occur unchanged, between characters that are no letters or digits.
SHORT_CHARS = 24
#: Characters of normalised items in one automaton; more items take more passes over the documents.
BLOCK_CHARS = 1 << 20
FOUND = "doc_id long, item_id long, distance int, start long, stop long"


def normalize(text: str) -> str:
    """Lower case, and each run of white space one blank."""
    return " ".join(text.lower().split())


def origins(text: str) -> list[int]:
    """Place in the text of each character of normalize(text), and the text's length after them."""
    at, blank = [], False
    for i, ch in enumerate(text):
        if ch.isspace():
            blank = bool(at)
            continue
        if blank:
            at.append(i - 1)
            blank = False
        at += [i] * len(ch.lower())
    return [*at, len(text)]


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the pattern's best occurrence in the text, the first of equals (Myers, 1999)."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, ch in enumerate(pattern):
        masks[ch] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for j, ch in enumerate(text):
        eq = get(ch, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(across | plus) & full)
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """Test items as one automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.ids, self.texts, self.edits = [], [], []
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            m, k = len(text), int(rate * len(text)) if len(text) >= SHORT_CHARS else 0
            number = len(self.ids)
            self.ids.append(item_id)
            self.texts.append(text)
            self.edits.append(k)
            edges = [m * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(edges, edges[1:], strict=False):
                places[text[a:b]].append((number, a))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if items:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item, in characters of the normalised text."""
        windows: dict[int, set[int]] = defaultdict(set)
        if not self.ids:
            return
        for last, (size, where) in self.automaton.iter(text):
            for number, offset in where:
                windows[number].add(last + 1 - size - offset)
        for number, starts in windows.items():
            pattern, k = self.texts[number], self.edits[number]
            if len(pattern) < SHORT_CHARS:
                alone = [s for s in sorted(starts) if not text[max(0, s - 1) : s].isalnum() and not text[s + len(pattern) : s + len(pattern) + 1].isalnum()]
                if alone:
                    yield number, 0, alone[0], alone[0] + len(pattern)
                continue
            m, found = len(pattern), None
            ordered = sorted(starts)
            spans: list[list[int]] = []
            for s in ordered:
                a, b = max(0, s - k), min(len(text), s + m + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans:
                distance, end = best_match(pattern, text[a:b])
                if distance <= k and (found is None or distance < found[0]):
                    back, length = best_match(pattern[::-1], text[a : a + end][::-1])
                    found = (distance, a + end - length, a + end) if back == distance else (distance, max(a, a + end - m), a + end)
                    if not distance:
                        break
            if found:
                yield number, *found


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (item_id, normalised text) of some `block_chars` characters each, dealt by a hash in the shared folder
    and read one at a time; null, blank and repeated rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalize(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["item_id", "text"]).filter(pa.array([bool(t) for t in texts], pa.bool_()))

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = store(rows.mapInArrow(run, "item_id long, text string").distinct(), "items")
    blocks = -(-int(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if own:
            yield sorted(((i, t) for i, t in own), key=lambda x: (x[0] is None, x))


def _found(docs: DataFrame, block: list[tuple[int, str]], rate: float) -> DataFrame:
    """Occurrences of one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block, rate)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                at: list[int] = []
                for number, distance, a, b in items.find(normalize(text)):
                    at = at or origins(text)
                    rows.append((doc_id, items.ids[number], distance, at[a], at[b - 1] + 1 if b > a else at[a]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "stop"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, FOUND)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, stop: the best occurrence of each test item in each document that has one.

    Both sides are lower-cased with white space made one blank; distance counts edits there, up to floor(rate * length)
    of the item. Items below SHORT_CHARS must occur unchanged as whole words. start and stop are code points of the
    whole original text. Null and empty texts and items hold nothing. Repeated documents each have their rows; items
    equal in id and text count once. An empty table gives no rows. Each block of items is one pass over the documents,
    whose finds are added to a table, so the driver and a task hold one block however large the benchmark is.
    """
    spark, path = docs.sparkSession, None
    for block in item_blocks(benchmark, block_chars):
        path = path or new_path(spark, "leaks")
        _found(docs, block, rate).write.mode("append").parquet(path)
    return spark.read.schema(FOUND).parquet(path) if path else spark.createDataFrame([], FOUND)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of docs, all columns, whose text holds no test item, as `leaks` finds them. Null texts and repeated rows
    stay. Nothing is shuffled; from the second block of items on, what is left is written between passes."""
    spark, path, columns_of, schema = docs.sparkSession, None, columns(docs), docs.schema
    for number, block in enumerate(item_blocks(benchmark, block_chars)):
        if number:
            old, path = path, new_path(spark, "without-leaks")
            docs.write.parquet(path)
            docs = spark.read.schema(schema).parquet(path)
            if old:
                drop_path(spark, old)

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            items = Items(block, rate)
            for batch in batches:
                clean = [next(items.find(normalize(t or "")), None) is None for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema.names).filter(pa.array(clean, pa.bool_()))

        docs = numbered(docs.select(*columns_of, F.col("text").cast("string").alias(fresh("text", docs)))).mapInArrow(run, schema)
    return docs


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that whole documents hold, with up to 8 edits per 100 characters."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
