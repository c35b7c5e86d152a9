"""Katz back-off model of any order over whole documents; trigrams by default.

P(w | h) is the Good-Turing discounted count of the n-gram h w over the count of h where it was seen in training, else
the back-off weight of h times P(w | h without its first word), down to P(w), which is the discounted count of w over
all tokens, or the mass left for unknown words. Counts up to LARGE are discounted by Good-Turing, larger ones lose TRIM,
so that every context keeps mass for unseen words; back-off weights make each context sum to exactly one.

Documents are held in blocks, stored once. Each order is one round of questions and answers. A block asks the buckets of
its different n-grams, by context, with its own training counts: what travels is one row per n-gram and block, so a
frequent word, pair or context is combined before its shuffle, and the n-grams of the most frequent contexts are dealt
by word as well. A bucket adds the counts up, writes them with the sums that make the contexts' weights to the model's
table, numbers its n-grams and answers. An n-gram's number and a word's number make the key of the next order, so keys
are exact beyond the 64-bit hashes of words. In the end a block scores its documents from all its answers.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, fold, new_path, read_table, store

ORDER = 3
#: Counts up to this are discounted by Good-Turing; larger ones lose TRIM of a count.
LARGE, TRIM = 5, 0.01
#: Tokens of a block, and of a bucket. The pieces that a round exchanges are all tokens squared over their product.
BLOCK_TOKENS, BUCKET_TOKENS = 2_000_000, 2_000_000
#: Contexts of so many training tokens have their n-grams dealt by word.
HOT_TOKENS = BUCKET_TOKENS // 4
#: Tasks of a round over blocks at most.
TASKS = 100_000
#: Word hashes kept per Python worker.
CACHE_WORDS = 200_000
END = xxhash.xxh64_intdigest(b"")  # no word is empty
#: The number of the context before a text; words are numbered from the number of buckets on.
BEGIN = 0


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


def discounts(n: dict[int, int]) -> list[float]:
    """Discounted counts of 1 to LARGE from counts of counts n: Katz's Good-Turing ratios, times the count.

    Where they don't exist or leave (0, 1), as in tiny or oddly repeated corpora, each count loses one half.
    """
    if all(n.get(r, 0) > 0 for r in range(1, LARGE + 2)):
        over = (LARGE + 1) * n[LARGE + 1] / n[1]
        ratios = [((r + 1) * n[r + 1] / (n[r] * r) - over) / (1 - over) for r in range(1, LARGE + 1)] if over < 1 else []
        if ratios and all(0 < d < 1 for d in ratios):
            return [d * r for r, d in zip(range(1, LARGE + 1), ratios, strict=True)]
    return [r - 0.5 for r in range(1, LARGE + 1)]


def _discounted(count: np.ndarray, table: list[float]) -> np.ndarray:
    small = np.concatenate([[0.0], table])
    return np.where(count <= LARGE, small[np.minimum(count, LARGE)], count - TRIM)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; whole numbers are cut to the bytes they need and stored by significance."""
    head, body = [struct.pack("<H", len(arrays))], []
    for x in arrays:
        if x.dtype.kind in "iub":
            x = x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
        head.append(struct.pack("<2sQ", x.dtype.str[1:].encode(), len(x)))
        body.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(head + body))


def _unpack(blob: bytes) -> list[np.ndarray]:
    """Arrays of a blob; whole numbers come as 64 bits."""
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    (n,) = struct.unpack_from("<H", data)
    kinds = [struct.unpack_from("<2sQ", data, 2 + 10 * i) for i in range(n)]
    at, out = 2 + 10 * n, []
    for kind, size in kinds:
        kind = np.dtype("<" + kind.decode())
        x = np.ascontiguousarray(np.frombuffer(data, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size).T).view(kind).reshape(size)
        out.append(x if kind.kind == "f" else x.astype(np.int64) if kind.itemsize < 8 else x.view(np.int64))
        at += size * kind.itemsize
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, with its first element."""
    return np.diff(x, prepend=x[:1] * 0)


def _mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a pair of numbers."""
    with np.errstate(over="ignore"):
        x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def blocks(docs: DataFrame) -> DataFrame:
    """(block, tokens, starts, blob) of docs(doc_id, training, text): some BLOCK_TOKENS tokens of whole documents each;
    tokens and starts are those of training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        hashes = _Hashes()
        held: list[np.ndarray] = []
        rows: list[tuple] = []
        total = 0

        def flush() -> pa.RecordBatch:
            words, index = np.unique(np.concatenate(held), return_inverse=True)
            size = np.array([len(t) for t in held])
            train = np.array([bool(r[1]) for r in rows])
            ids = np.array([r[0] or 0 for r in rows], np.int64).view(np.uint64)
            blob = _pack(ids, np.array([r[0] is None for r in rows]), train, size, _steps(words), index.astype(np.uint64))
            cols = [pa.array([number]), pa.array([int(size[train].sum())]), pa.array([int(train.sum())]), pa.array([blob], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["block", "tokens", "starts", "blob"])

        for batch in batches:
            for doc_id, training, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or b"").lower().split()
                tokens = np.empty(len(words) + 1, np.uint64)
                tokens[:-1] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                tokens[-1] = END
                held.append(tokens)
                rows.append((doc_id, training))
                total += len(tokens)
                if total >= BLOCK_TOKENS:
                    yield flush()
                    held, rows, total, number = [], [], 0, number + 1
        if held:
            yield flush()

    return docs.mapInArrow(run, "block long, tokens long, starts long, blob binary")


class Model:
    """What all tasks know: sizes, where tables lie, and the discounts of the orders counted so far."""

    def __init__(self, path: str, order: int, tokens: int, starts: int) -> None:
        self.path, self.order, self.tokens, self.starts = path, order, tokens, starts
        self.buckets = max(32, -(-tokens // BUCKET_TOKENS))
        self.hot = HOT_TOKENS
        self.types, self.unknown = 0, 1.0
        self.tables: list[list[float]] = [[]]

    def learn(self, n: int, counts: dict[int, int], types: int, large: int) -> None:
        """Discounts of order n from its counts of counts; types and large (the sum of counts above LARGE + 1's own)
        give the mass that order 1 leaves for unknown words."""
        self.tables.append(discounts(counts))
        if n == 1:
            self.types = types
            over = types - sum(counts.get(r, 0) for r in range(1, LARGE + 1))
            kept = sum(counts.get(r, 0) * self.tables[1][r - 1] for r in range(1, LARGE + 1)) + large - TRIM * over
            self.unknown = 1 - kept / self.tokens if self.tokens else 1.0


def _rows(path: str, block: int) -> list[tuple[int, bytes]]:
    """(bucket, blob) of a block's rows in a table that is partitioned by block."""
    where, root = fs.FileSystem.from_uri(f"{path}/block={block}")
    if where.get_file_info(root).type == fs.FileType.NotFound:
        return []
    files = [f.path for f in where.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet")]
    out = []
    for name in files:
        with where.open_input_file(name) as file:
            table = pq.read_table(file)
            at = table.column("bucket").to_pylist() if "bucket" in table.column_names else [0] * len(table)
            out += list(zip(at, table.column("blob").to_pylist(), strict=True))
    return out


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values in order, a place of each, and which one each key is."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(key), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], which


class Block:
    """The tokens of some documents, and what the rounds have told of the n-grams that end at each of them.

    The n-grams of an order have places in the order of their numbers, in arrays of training counts and numbers; `place`
    says which one ends at each token, -1 for none. The context before all texts is the first of the words.
    """

    def __init__(self, model: Model, number: int) -> None:
        self.model, self.number = model, number
        ids, null, train, size, words, index = _unpack(_rows(f"{model.path}/blocks", number)[0][1])
        self.ids, self.null, self.train, self.size = ids, null.astype(bool), train.astype(bool), size
        self.words = np.cumsum(words.view(np.uint64), dtype=np.uint64)
        self.index = index.astype(np.int32)
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.learnt = self.train[self.doc]
        self.first = np.zeros(len(index), bool)
        self.first[np.cumsum(size) - size] = True
        self.place: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        self.numbers: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}

    def before(self, values: np.ndarray, at_first: int) -> np.ndarray:
        """Values of the token before each, `at_first` where a document starts."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_first
        return out

    def count(self, n: int) -> np.ndarray:
        """Training count of the n-gram that ends at each token."""
        return np.where(self.place[n] >= 0, self.counts[n][self.place[n]], 0) if len(self.counts[n]) else np.zeros(len(self.first), np.int64)

    def context(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, training count) of each token's context of order n; count 0 where there is none."""
        place = self.before(self.place[n - 1], 0 if n == 2 else -1)
        return place, np.where(place >= 0, self.counts[n - 1][place], 0) if len(self.counts[n - 1]) else np.zeros(len(place), np.int64)

    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        """Words in order of their buckets, and where each bucket starts."""
        at = (self.words % np.uint64(self.model.buckets)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        return order, np.searchsorted(at[order], np.arange(self.model.buckets + 1))

    def _grams(self, n: int) -> SimpleNamespace:
        """Contexts and n-grams of order n to be asked for, dealt to buckets. A context's n-grams that can't have been
        seen, as their lower order wasn't, are left out; contexts of documents to be scored come with or without any."""
        buckets, numbers = self.model.buckets, self.numbers[n - 1]
        context, size = self.context(n)
        entries = np.flatnonzero((size > 0) & (self.count(n - 1) > 0))
        asked = np.zeros(len(numbers), bool)
        asked[context[(size > 0) & ~self.learnt]] = True
        key, example, which = _distinct(context[entries].astype(np.int64) * len(self.counts[1]) + self.place[1][entries])
        of, example = key // len(self.counts[1]), entries[example]
        known = asked.copy()
        known[of] = True
        hot = known & (self.counts[n - 1] >= self.model.hot)
        at = (_mix(numbers, numbers) % np.uint64(buckets)).astype(np.int64)
        home = np.flatnonzero(known & ~hot)
        cells = at[of] * len(numbers) + of
        spread = np.flatnonzero(hot[of])
        cells[spread] = (_mix(numbers[of[spread]], self.numbers[1][self.place[1][example[spread]]]) % np.uint64(buckets)).astype(np.int64) * len(numbers) + of[spread]
        order = np.argsort(cells, kind="stable")
        # contexts of each piece: those at home there, and hot ones with an n-gram there
        pairs = np.sort(np.concatenate([at[home] * len(numbers) + home, np.unique(cells[spread])]))
        cells = cells[order]
        bounds = np.arange(buckets + 1) * len(numbers)
        return SimpleNamespace(
            asked=asked, hot=hot, entries=entries, example=example, which=which, order=order, of=of,
            edge=np.searchsorted(cells, bounds),
            first=np.searchsorted(pairs, bounds),
            followers=np.diff(np.searchsorted(cells, np.append(pairs, np.iinfo(np.int64).max))),
            cell=pairs % max(len(numbers), 1),
        )

    def _below(self, n: int, g: SimpleNamespace) -> np.ndarray:
        """Training counts of the contexts' own contexts, by place; all tokens for order 2."""
        if n == 2:
            return np.full(len(self.counts[1]), max(self.model.tokens, 1))
        place, _ = self.context(n)
        low = np.ones(len(self.counts[n - 1]), np.int64)
        there = place >= 0
        low[place[there]] = self.before(self.count(n - 2), 0)[there]
        return low

    def ask(self, n: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob) of the questions of order n."""
        if n == 1:
            times = np.bincount(self.index[self.learnt], minlength=len(self.words))
            order, edge = self._words()
            for b in np.flatnonzero(np.diff(edge)).tolist():
                own = order[edge[b] : edge[b + 1]]
                yield b, _pack(_steps(self.words[own]), times[own])
            return
        g = self._grams(n)
        times = np.bincount(g.which[self.learnt[g.entries]], minlength=len(g.example))
        word, below = self.numbers[1][self.place[1][g.example]], self.count(n - 1)[g.example]
        low, numbers = self._below(n, g), self.numbers[n - 1]
        for b in np.flatnonzero(np.diff(g.first)).tolist():
            own, mine = g.order[g.edge[b] : g.edge[b + 1]], slice(g.first[b], g.first[b + 1])
            c = g.cell[mine]
            yield b, _pack(_steps(numbers[c]), g.followers[mine], g.asked[c] + 2 * g.hot[c], low[c][g.hot[c]], word[own], times[own], below[own])

    def _placed(self, n: int, place: np.ndarray, count: np.ndarray, number: np.ndarray) -> None:
        """Keep counts and numbers in the order of the numbers; the context before all texts leads the words."""
        order = np.argsort(number, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        lead = [self.model.starts], [BEGIN]
        self.counts[n] = np.concatenate([lead[0], count[order]]) if n == 1 else count[order]
        self.numbers[n] = np.concatenate([lead[1], number[order]]) if n == 1 else number[order]
        self.place[n] = rank[place] + 1 if n == 1 else np.where(place >= 0, rank[place], -1).astype(np.int32) if len(rank) else place

    def hear(self, n: int) -> None:
        """Take the answers of order n."""
        answers = _rows(f"{self.model.path}/answers{n}", self.number)
        if n == 1:
            order, edge = self._words()
            count, number = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
            for b, blob in answers:
                own = order[edge[b] : edge[b + 1]]
                count[own], number[own] = _unpack(blob)
            self._placed(1, self.index, count, number)
            return
        g, last = self._grams(n), n == self.model.order
        count, number = np.zeros(len(g.order), np.int64), np.zeros(len(g.order), np.int64)
        weight, low = np.full(len(g.asked), np.nan), self._below(n, g)
        for b, blob in answers:
            c, steps, *sums, mass = _unpack(blob)
            own = g.order[g.edge[b] : g.edge[b + 1]]
            count[own] = c
            if not last:
                number[own] = np.cumsum(steps) * self.model.buckets + b
            mine = g.cell[g.first[b] : g.first[b + 1]]
            mine = mine[g.asked[mine] & ~g.hot[mine]]
            weight[mine] = log_weight(np.stack(sums), mass / low[mine], self.model.tables[n])
        self.weights[n] = weight
        place = np.full(len(self.first), -1, np.int32)
        place[g.entries] = g.which
        if last:
            self.place[n], self.counts[n] = place, count
        else:
            self._placed(n, place, count, number)

    def score(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(known, base, score) per document, and (document, order, context, times) of hot contexts backed off from."""
        model, docs = self.model, len(self.size)
        one = self.count(1)
        known = np.bincount(self.doc[one > 0], minlength=docs)
        words = np.log10((self.counts[1] + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        base = np.bincount(self.doc, words[self.place[1]], docs)
        words = np.log10(np.where(self.counts[1] > 0, _discounted(self.counts[1], model.tables[1]) / max(model.tokens, 1), model.unknown))
        value, events = words[self.place[1]], []
        for n in range(2, model.order + 1):
            context, size = self.context(n)
            count = self.count(n)
            seen = np.flatnonzero(count)
            value[seen] = np.log10(_discounted(count[seen], model.tables[n]) / size[seen])
            back = np.flatnonzero((size > 0) & (count == 0))
            hot = size[back] >= model.hot
            value[back[~hot]] += self.weights[n][context[back[~hot]]]
            if hot.any():
                pair, times = np.unique(np.stack([self.doc[back[hot]], context[back[hot]]]), axis=1, return_counts=True)
                events.append((pair[0], np.full(len(times), n), self.numbers[n - 1][pair[1]], times))
        return [known, base, np.bincount(self.doc, value, docs)], [np.concatenate(e) for e in zip(*events, strict=True)] if events else []


def log_weight(sums: np.ndarray, mass: np.ndarray, table: list[float]) -> np.ndarray:
    """log10 of contexts' back-off weights from sums (counts of 1 to LARGE, number and sum of larger ones) and the
    lower order's probability of their seen words."""
    held = sum(sums[r] * table[r] for r in range(LARGE)) + sums[LARGE + 1] - TRIM * sums[LARGE]
    total = sum(sums[r] * (r + 1) for r in range(LARGE)) + sums[LARGE + 1]
    return np.log10(1 - held / total) - np.log10(1 - mass)


#: What a bucket writes, by kind: 0 its part of the model's table, 1 an answer, 2 its counts of counts (r1 to r5, large:
#: of LARGE + 1, types, larges: the sum of counts above LARGE), 3 its share of a hot context's sums.
SUMS = [*(f"r{r}" for r in range(1, LARGE + 1)), "large", "larges"]
FOUND = "kind int, block long, bucket int, blob binary, context long, " + ", ".join(f"{s} long" for s in SUMS) + ", types long, mass double, low long"


def _found(kind: int, n: int, **cols: object) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in FOUND.split(", ")]
    cols["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(cols[f], kinds[k]) if f in cols else pa.nulls(n, kinds[k]) for f, k in fields], [f for f, _ in fields])


def _statistics(count: np.ndarray) -> pa.RecordBatch:
    hist = np.bincount(np.minimum(count, LARGE + 2), minlength=LARGE + 3)
    cols = {f"r{r}": [int(hist[r])] for r in range(1, LARGE + 1)}
    return _found(2, 1, **cols, large=[int(hist[LARGE + 1])], larges=[int(count[count > LARGE].sum())], types=[len(count)])


def answer_words(model: Model, bucket: int, questions: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Answers of order 1; frequent words have small numbers."""
    parts = [_unpack(b) for _, b in questions]
    words = [np.cumsum(p[0].view(np.uint64), dtype=np.uint64) for p in parts]
    every, of = np.unique(np.concatenate(words), return_inverse=True)
    count = np.bincount(of, np.concatenate([p[1] for p in parts]), len(every)).astype(np.int64)
    number = np.empty(len(every), np.int64)
    number[np.argsort(-count, kind="stable")] = (np.arange(len(every)) + 1) * model.buckets + bucket
    seen = count > 0
    yield _found(0, 1, bucket=[bucket], blob=[_pack(_steps(every[seen]), number[seen], count[seen])])
    yield _statistics(count[seen])
    at = 0
    for block, w in zip((q[0] for q in questions), words, strict=True):
        own = of[at : at + len(w)]
        at += len(w)
        yield _found(1, 1, block=[block], bucket=[bucket], blob=[_pack(count[own], number[own] * seen[own])])


def answer(model: Model, n: int, bucket: int, questions: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Answers of order n, two or more: counts and numbers of n-grams, and the sums of contexts asked for."""
    if n == 1:
        yield from answer_words(model, bucket, questions)
        return
    parts = [_unpack(b) for _, b in questions]
    contexts = [np.cumsum(p[0]) for p in parts]
    context = np.concatenate([np.repeat(c, p[1]) for c, p in zip(contexts, parts, strict=True)])
    word, times, below = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
    key = word
    if len(context) * (int(word.max(initial=0)) + 1) >= 2**62:  # too many words for one key
        key = _distinct(word)[2].astype(np.int64)
    _, example, of = _distinct(_distinct(context)[2].astype(np.int64) * (int(key.max(initial=0)) + 1) + key)
    count = np.bincount(of, times, len(example)).astype(np.int64)
    seen = np.flatnonzero(count > 0)
    lead, c = example[seen], count[seen]
    own, followers = np.unique(context[lead], return_counts=True)
    edge = np.cumsum(followers) - followers
    add = lambda x: np.add.reduceat(x, edge) if len(edge) else x[:0]
    large = c > LARGE
    sums = [add((c == r).astype(np.int64)) for r in range(1, LARGE + 1)] + [add(large.astype(np.int64)), add(np.where(large, c, 0))]
    mass = add(_discounted(below[lead], model.tables[n - 1]))
    yield _found(0, 1, bucket=[bucket], blob=[_pack(_steps(own), followers, word[lead], c, mass.astype(np.float32))])
    yield _statistics(c)
    every, flags, low = (np.concatenate(x) for x in (contexts, [p[2] for p in parts], [p[3] for p in parts]))
    hot, example = np.unique(every[flags >= 2], return_index=True)
    at = np.flatnonzero(np.isin(own, hot))
    if len(at):
        lows = low[example][np.searchsorted(hot, own[at])]
        yield _found(3, len(at), context=own[at], mass=mass[at], low=lows, **{s: x[at] for s, x in zip(SUMS, sums, strict=True)})
    number = np.cumsum(count > 0) - (count > 0)  # an unseen n-gram has the number of the next, and count 0
    at = 0
    for (block, _), p, c in zip(questions, parts, contexts, strict=True):
        mine = of[at : at + len(p[4])]
        at += len(p[4])
        asked = np.searchsorted(own, c[p[2] == 1])
        steps = _steps(number[mine]) if n < model.order else number[:0]
        yield _found(1, 1, block=[block], bucket=[bucket], blob=[_pack(count[mine], steps, *(x[asked] for x in sums), mass[asked])])


def _round(spark: SparkSession, model: Model, n: int, ids: DataFrame, tasks: int) -> None:
    """Count the n-grams of order n: the table's parts, statistics and hot contexts go below path/order<n>, answers to
    path/answers<n>, partitioned by block."""
    path, buckets = model.path, model.buckets
    shared = spark.sparkContext.broadcast(model)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                block = Block(shared.value, number)
                for m in range(1, n):
                    block.hear(m)
                for bucket, blob in block.ask(n):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([number]), pa.array([blob], pa.binary())], ["bucket", "block", "blob"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        now = None
        for batch in batches:  # sorted by bucket
            for bucket, *question in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from answer(shared.value, n, now, held)
                    held = []
                now = bucket
                held.append(tuple(question))
        if held:
            yield from answer(shared.value, n, now, held)

    questions = ids.mapInArrow(ask, "bucket int, block long, blob binary").repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    questions.mapInArrow(work, FOUND).write.partitionBy("kind").parquet(f"{path}/order{n}")
    found = spark.read.schema(FOUND).parquet(f"{path}/order{n}")
    answers = found.where("kind = 1").select("block", "bucket", "blob")
    answers.repartition(tasks, "block").sortWithinPartitions("block").write.partitionBy("block").parquet(f"{path}/answers{n}")
    drop_path(spark, f"{path}/order{n}/kind=1")
    s = spark.read.schema(FOUND).parquet(f"{path}/order{n}").where("kind = 2").agg(*[F.sum(x) for x in [*SUMS, "types"]]).first()
    *small, large, larges, types = (int(x or 0) for x in s)
    model.learn(n, dict(enumerate([*small, large], 1)), types, larges)


def scores(docs: DataFrame, training: Column, path: str | None = None, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs(doc_id, text).

    The model learns from the rows where `training` is true and is left below `path`, a table per order in parts by
    bucket; `order` is two or more. A text's first token has the one context before all texts. Every row is scored once:
    repeated ids keep their rows, null ids are scored too; a null text is the end token alone. Without training rows
    every token is unknown with probability one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "katz")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("training"), F.col("text").cast("binary").alias("text"))
    blocks(rows).write.partitionBy("block").parquet(f"{path}/blocks")
    held = spark.read.schema("tokens long, starts long, blob binary, block long").parquet(f"{path}/blocks")
    n, tokens, starts = (int(x or 0) for x in held.agg(F.count("*"), F.sum("tokens"), F.sum("starts")).first())
    model = Model(path, order, tokens, starts)
    tasks = min(max(n, 1), TASKS)
    ids = held.select("block").repartition(tasks)
    for m in range(1, order + 1):
        _round(spark, model, m, ids, tasks)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "order", "context", "times"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            for number in batch.column(0).to_pylist():
                block = Block(shared.value, number)
                for m in range(1, order + 1):
                    block.hear(m)
                (known, base, score), events = block.score()
                row = (number << 22) + np.arange(len(known))  # a document has a token at least
                cols = [row, pa.array(block.ids.view(np.int64), mask=block.null), ~block.train, block.size, known, base, score, None, None, None]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(row), k) if c is None else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                if events:
                    doc, which, context, times = events
                    cols = [row[doc], *[None] * 6, which, context, times]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(doc), k) if c is None else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, order int, context long, times long"
    found = store(ids.mapInArrow(run, schema), "scores")
    texts, events = found.where("order is null"), found.where("order is not null")
    if not events.isEmpty():
        hot = None
        for m in range(2, order + 1):
            sums = spark.read.schema(FOUND).parquet(f"{path}/order{m}").where("kind = 3").groupBy("context").agg(*[F.sum(s).alias(s) for s in SUMS], F.sum("mass").alias("mass"), F.first("low").alias("low"))
            kept = sum((F.col(f"r{r}") * F.lit(model.tables[m][r - 1]) for r in range(1, LARGE + 1)), F.col("larges") - F.col("large") * TRIM)
            total = sum((F.col(f"r{r}") * r for r in range(1, LARGE + 1)), F.col("larges"))
            own = sums.select(F.lit(m).alias("order"), "context", (F.log10(1 - kept / total) - F.log10(1 - F.col("mass") / F.col("low"))).alias("weight"))
            hot = own if hot is None else hot.unionAll(own)
        backed = events.select("row", "order", "context", "times").join(hot, ["order", "context"]).groupBy("row").agg(F.sum(F.col("times") * F.col("weight")).alias("more"))
        texts = texts.join(backed, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0)))
    return texts.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def read_table_of(spark: SparkSession, path: str, order: int) -> DataFrame:
    """(context, word, c, mass) rows of a model's table of order two or more: numbers of context and word, the count,
    and the context's sum of discounted lower counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                context, followers, word, c, mass = _unpack(blob)
                cols = [np.repeat(np.cumsum(context), followers), word, c, np.repeat(mass.astype(np.float64), followers)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["context", "word", "c", "mass"])

    return spark.read.schema(FOUND).parquet(f"{path}/order{order}").where("kind = 0").select("blob").mapInArrow(run, "context long, word long, c long, mass double")


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and trigram scores of all documents, learnt from those whose fold of ten is not 0."""
    docs = read_table(spark, sf_dir, "documents")
    return scores(docs, fold(F.col("doc_id"), 10) != 0)
