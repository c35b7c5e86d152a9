"""Counting, sharding, search, archives and packing against brute force and round trips."""

import base64
import hashlib
import math
import random
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
import zstandard
from .conftest import ODD

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.llm import bpe, packing, recount, sharding, topk, warc


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 2**60, 20000).astype(np.uint64)
    for n in range(1, 20):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert a.max() < n and np.all((a == b) | (b == n))
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02


def jump(key, n):
    """The published loop for one key."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_shards_of_odd_rows(spark, odd):
    rows = sharding.op4_jump_shards(spark, odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        key = int(hashlib.md5(b"" if r.doc_id is None else str(r.doc_id).encode()).hexdigest()[:15], 16)
        assert (r.shard, r.grown_shard) == (jump(key, 16), jump(key, 17))
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    sizes = sorted((r.size, r.text_crc32) for r in rows)
    assert sizes == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in ODD)


def test_shards_of_no_rows(spark, empty):
    assert sharding.op4_jump_shards(spark, empty).count() == 0


def test_top_k_with_ties_nulls_and_lengths(spark, table):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8]) for i in range(120)]
    rows += [(200, None), (250, [None, 1.0]), (300, [float("nan")]), (350, [0.5, 0.5]), (400, []), (51, rows[50][1]), (None, [1.0])]
    folder = table("embeddings", [(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, topk.op9_topk(spark, folder).collect()))
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.all(np.isfinite(v))]
    want = []
    for q, a in good:
        if q % 50 == 0:
            scored = sorted((-int(a[: min(len(a), len(b))] @ b[: min(len(a), len(b))]), i) for i, b in good if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert got == sorted(want)


def test_top_k_in_blocks_is_the_same(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = v.where("vec_id % 50 = 0")
    assert sorted(topk.top_k(v, asked, 5).collect()) == sorted(topk.top_k(v, asked, 5, block=3).collect())


def best_by_force(rows, k=5, every=50):
    """All rows against all others, in Python integers."""
    good = [(n, i, [math.floor(256 * Fraction(x)) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and None not in v and np.all(np.isfinite(v))]
    out = []
    for n, q, a in good:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for m, i, b in good if m != n)
            out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_every_query_row_asks_and_large_components_count(spark, table, kind):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.integers(-9, 10, 5)]) for i in rng.integers(0, 100, 150)]
    rows += [(50, [None, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [2.0, -1.0]), (50, [float("inf")])]
    rows += [(150, [1e6] * 5), (150, [-1e6] * 5), (7, [262145.0] * 5), (8, [1e30, 1.0])]
    if kind == "double":
        rows += [(9, [1e300, -1e-300]), (100, [-1e300, 1.0]), (100, [1.7e308, 1.7e308])]
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) if kind == "float" else x for x in v]) for i, v in rows]
    folder = table("embeddings", rows, f"vec_id long, embedding array<{kind}>")
    assert sorted(map(tuple, topk.op9_topk(spark, folder).collect())) == best_by_force(rows)


def test_top_k_of_no_rows_and_of_one(spark, table):
    assert topk.op9_topk(spark, table("embeddings", [], "vec_id long, embedding array<float>")).count() == 0
    assert topk.op9_topk(spark, table("embeddings", [(50, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_archives_round_trip(spark, table):
    pages = [(5, "http://a", "<p>é"), (2, "http://b\r\nX: y", "<p>é"), (7, None, None), (8, "u", ""), (2, "again", "<p>é"), (None, "n", "<p>é"), (9, "big", "z" * 300000)]
    folder = table("pages", pages, "page_id long, url string, html string")
    rows = warc.op7_warc_round_trip(spark, folder).collect()
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    first = {"<p>é": 2, "": 7, "z" * 300000: 9}
    want = [(i, len((h or "").encode()), digest(h), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in pages]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_no_pages(spark, table):
    assert warc.op7_warc_round_trip(spark, table("pages", [], "page_id long, url string, html string")).count() == 0


def test_foreign_records_and_cut_frames(spark, tmp_path):
    pack = zstandard.ZstdCompressor().compress
    date = ("WARC-Date", "2020-01-01T00:00:00Z")
    kinds = [("request", "application/http;msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"), ("metadata", "application/warc-fields", b"a: b\r\n"), ("resource", "text/plain", b"whole"), ("conversion", "text/plain", b"text")]
    records = [warc.record(k, [("WARC-Record-ID", f"<{k}>"), date, ("Content-Type", c)], b) for k, c, b in kinds]
    records.append(warc.record("response", [("WARC-Record-ID", "<r>"), date, ("Content-Type", "application/http;msgtype=response"), ("X-Page-Id", "none")], b"HTTP/1.1 200 OK\r\n\r\nbody"))
    whole = warc.dictionary_frame(b"some dictionary") + b"".join(pack(r) for r in records)
    (tmp_path / "a.warc.zst").write_bytes(b"".join(pack(r) for r in records))
    rows = {r.kind: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert bytes(rows["resource"].payload) == b"whole" and bytes(rows["response"].payload) == b"body" and rows["response"].page_id is None
    assert rows["response"].digest == base64.b32encode(hashlib.sha1(b"body").digest()).decode() and set(rows) == {"request", "metadata", "resource", "conversion", "response"}
    for bad in (whole[:6], whole[:20], b"".join(pack(r) for r in records) + struct.pack("<II", 0x184D2A50, 99) + b"x", pack(records[0]) + struct.pack("<I", 0x184D2A50)):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))


def test_archives_of_lost_attempts_do_not_count(spark, tmp_path):
    rows = spark.createDataFrame([(i, "u", bytes([65 + i]), None, False) for i in range(5)], "page_id long, url string, payload binary, refers_to long, revisit boolean")
    path = f"file://{tmp_path}"
    warc.write_archives(rows.repartition(2), path, b"d").collect()  # as an attempt whose rows were lost
    manifest = spark.createDataFrame(warc.write_archives(rows.repartition(2), path, b"d").collect(), "archive string, records long")
    assert warc.read_archives(spark, path, manifest).count() == 5 and warc.read_archives(spark, path).count() == 10


def test_reader_rejects_breaches():
    good = warc.page_record(1, "http://a", b"payload", None, False)
    assert warc.parse_record(good)[0]["x-page-id"] == "1"
    for bad in (good[:-4], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"payload", b"payl0ad"), good.replace(b"WARC-Date", b"No-Date"), good + b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    with pytest.raises(warc.WarcError):
        list(warc.frames(warc.dictionary_frame(b"abc")[:-1]))


@pytest.fixture(scope="module")
def coder():
    return bpe.load(*bpe.default_vocabulary())


def test_ids_are_the_tokenizer_library_s(coder):
    library = Tokenizer.from_file(bpe.default_vocabulary()[0])
    for text in ["", " ", "  a  b ", "a\n b", "don't  stop 123 \t4", "<|endoftext|> x", "日本語 テスト ", "\U0001f600 \U0001f600"]:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [70_000, 2_000_000, 10_000_000])
def test_ids_of_long_white_space(coder, n):
    library = Tokenizer.from_file(bpe.default_vocabulary()[0])
    blank, other = " " * n, "\n\u3000\x85" * (n // 3)
    for text in (blank + "a", "a" + other + " b", f"x{blank}<|endoftext|>{other}", "a  b" + blank):
        want = np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)
        assert np.array_equal(coder.encode(text), want)
        if n > 2_000_000:
            break
    tree = recount.TokenTree("so " + blank + "on", coder)
    tree.edit(5, 9, "x")
    assert tree.count == len(coder.encode_ordinary("so   x" + blank[6:] + "on"))


def test_packing_of_odd_rows(spark, odd):
    rows = packing.op8_pattern_packing(spark, odd).collect()
    library = Tokenizer.from_file(bpe.default_vocabulary()[0])
    want = []
    for doc_id, text, *_ in ODD:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids), 2048))]
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    for sequence in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_of_no_rows(spark, empty):
    assert packing.op8_pattern_packing(spark, empty).count() == 0


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(16, 8) == [(0, 8), (8, 8)] and packing.cut(18, 8) == [(0, 2), (2, 8), (10, 8)]


def test_plan_holds_every_piece_near_the_bound():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(np.exp(rng.normal(4, 1, 20000)).astype(int), 1, 256), minlength=257)
    done = np.zeros(257, int)
    total = 0
    for lengths, n in packing.plan(counts, 256):
        assert sum(lengths) <= 256
        total += n
        for x in lengths:
            done[x] += n
    assert np.array_equal(done, counts)
    assert total <= 1.002 * -(-(counts @ np.arange(257)) // 256)


def test_edits_count_like_a_full_encoding(coder, monkeypatch):
    monkeypatch.setattr(recount, "LEAF_CHARS", 8)
    random.seed(2)
    parts = ["a", "b", " ", "  ", "\n", "don't ", "'s", "12", "é", "word ", "longer words here ", "\t", "!!", "日"]
    for _ in range(150):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 60)))
        tree = recount.TokenTree(text, coder)
        for _ in range(6):
            a = random.randint(0, len(text) + 2)
            b, put = a + random.randint(0, 12), "".join(random.choice(parts) for _ in range(random.randint(0, 4)))
            text = text[:a] + put + text[max(a, b) :]
            tree.edit(a, b, put)
            assert tree.text == text and tree.count == len(coder.encode_ordinary(text))


def test_only_touched_regions_are_encoded(coder):
    tree = recount.TokenTree("some words of a long text " * 20000, coder)
    tree.edit(250_000, 250_004, "new")
    assert 0 < tree.encoded < 3000


def test_recount_of_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = recount.recount(docs, F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("stop"), F.lit(None).cast("string").alias("put")))).collect()
    assert len(rows) == len(ODD) and recount.op3_edit_recount(spark, odd).count() == len(ODD)
    assert recount.recount(docs, F.lit(None)).where("tokens_before <> tokens_after").count() == 0
