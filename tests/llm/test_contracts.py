"""Whole queries against slow versions written from their contracts, clashing names, long texts and empty tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.llm import bpe, decontam, katz, langid, packing, pii, recount, sharding, simhash

from .conftest import ODD

#: Names that operators use for columns of their own.
CLASHING = ["lang_pred", "score", "text_", "node", "chosen", "own", "key", "spans", "salt", "row", "_text", "_node", "_row", "_spans", "_lang", "_score", "_chosen", "component", "a.b", "kind", "start"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(spark, table, stage):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    table("benchmark", [(1, "an item that nothing holds, long enough to be searched")], "item_id long, text string")
    rows = [(i, t, lang, *[f"{i}:{n}" for n in CLASHING]) for i, t, lang, _ in ODD]
    folder = table("documents", rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) >= 6 and all(list(r[3:]) == [f"{r[0]}:{n}" for n in CLASHING] for r in got)


def test_every_query_takes_documents_with_more_columns(spark, table):
    rows = [(i, t, lang, *["z"] * len(CLASHING)) for i, t, lang, _ in ODD]
    folder = table("documents", rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for query in (katz.op2_katz_scores, recount.op3_edit_recount, simhash.op5_simhash_components, langid.op6_language_profiles, pii.op10_personal_data):
        assert query(spark, folder).count() == len(ODD)


def test_no_documents_and_no_items(spark, table, empty):
    for name in ("benchmark", "documents"):
        folder = table("benchmark", [] if name == "benchmark" else [(1, "some item of the benchmark")], "item_id long, text string")
        assert decontam.op1_benchmark_leaks(spark, folder).count() == 0
    assert recount.op3_edit_recount(spark, empty).count() == 0 and packing.op8_pattern_packing(spark, empty).count() == 0


def plain_fingerprint(text, words=4):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not found:
        return "0" * 16
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"


def test_fingerprints_and_components_are_the_contract_s(spark, data):
    rows = simhash.op5_simhash_components(spark, data).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == prints
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if least[j] < least[i] and (int(prints[i], 16) ^ int(prints[j], 16)).bit_count() <= 4:
                    least[i], changed = least[j], True
    assert {r.doc_id: r.component_id for r in rows} == least


def plain_bundle(text, dimensions=langid.DIMENSIONS, letters=langid.LETTERS):
    line = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in (text or '').lower()).split())} "
    out = np.zeros(dimensions)
    for i in range(len(line) - letters + 1):
        gram = line[i : i + letters]
        if gram.strip():
            vectors = [langid.letter_vectors(np.array([ord(c)]), dimensions)[0].astype(float) for c in gram]
            out += np.prod([np.roll(v, letters - 1 - p) for p, v in enumerate(vectors)], axis=0)
    return out


def test_predictions_are_those_of_plain_bundles(spark, table, monkeypatch):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est là", "fr"), ("die katze saß da", "de"), ("a dog", "en"), ("un chien", "fr"), (None, "fr"), ("12 !", "en"), ("der hund", "de"), ("le dog", None), ("ein chat", "de")])]
    folder = table("documents", rows, "doc_id long, text string, lang string")
    profiles = defaultdict(lambda: np.zeros(langid.DIMENSIONS))
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and t is not None and lang is not None:
            profiles[lang] += plain_bundle(t)
    units = {k: v / np.linalg.norm(v) for k, v in sorted(profiles.items()) if np.any(v)}
    for r in langid.op6_language_profiles(spark, folder).collect():
        own = plain_bundle(rows[r.doc_id][1])
        if not np.any(own):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosine = {k: float(own @ v) / np.linalg.norm(own) for k, v in units.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) and r.score == pytest.approx(min(max(max(cosine.values()), 0), 1), abs=1e-5)


def test_bundles_in_slices_are_the_same(monkeypatch):
    texts = ["the quick brown fox", "漢字かな交じり文" * 30, "abc"]
    whole = [plain_bundle(t) for t in texts]
    monkeypatch.setattr(langid, "GRAM_SLICE", 3)
    space = langid.Space(langid.DIMENSIONS, langid.LETTERS)
    grams, text, gram, count = langid.grams_of(texts, langid.LETTERS)
    sums = np.zeros((3, langid.DIMENSIONS))
    for low in range(0, len(grams), 3):
        own = (gram >= low) & (gram < low + 3)
        vectors = space.bound(grams[low : low + 3])
        for t, g, n in zip(text[own], gram[own] - low, count[own], strict=True):
            sums[t] += n * vectors[g]
    assert np.array_equal(sums, np.stack(whole))


def test_leaks_of_whole_tables_are_those_of_all_pairs(spark, table, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 4000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()][:20]
    some = next(t for _, t in docs if t and len(t) > 200)
    items += [(900, some[50:61].strip()), (901, "xyzzy"), (902, "  "), (903, None)]
    docs += [(9001, "say xyzzy, please"), (9002, "xyzzyx"), (9001, "say xyzzy, please"), (9003, None)]
    folder = table("documents", docs, "doc_id long, text string")
    table("benchmark", items, "item_id long, text string")
    want = defaultdict(int)
    for i, text in docs:
        clean = decontam.normalize(text or "")
        for j, item in items:
            pattern = decontam.normalize(item or "")
            if not pattern or not clean:
                continue
            if len(pattern) < decontam.SHORT_CHARS:
                want[i, j, 0] += bool(re.search(rf"(?<![^\W_]){re.escape(pattern)}(?![^\W_])", clean))
            elif (k := decontam.best_match(pattern, clean)[0]) <= int(decontam.RATE * len(pattern)):
                want[i, j, k] += 1
    got = defaultdict(int)
    for r in decontam.op1_benchmark_leaks(spark, folder).collect():
        got[r.doc_id, r.item_id, r.distance] += 1
    assert dict(got) == {k: n for k, n in want.items() if n} and got[9001, 901, 0] == 2


def test_items_in_many_blocks_are_found_alike(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "benchmark"))
    assert sorted(decontam.leaks(docs, items).collect()) == sorted(decontam.leaks(docs, items, block_chars=700).collect())
    assert decontam.without_leaks(docs, items).count() == decontam.without_leaks(docs, items, block_chars=2000).count()


def test_recounts_of_the_query_are_full_encodings(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    edits = {r.doc_id: (r.text or "", r.e) for r in docs.select("doc_id", "text", recount.fixed_edits(F.col("doc_id"), F.col("text")).alias("e")).collect()}
    library = Tokenizer.from_file(bpe.default_vocabulary()[0])
    library.encode_special_tokens = True
    for r in recount.op3_edit_recount(spark, data).collect():
        text, changes = edits[r.doc_id]
        before = len(library.encode(text, add_special_tokens=False).ids)
        for e in changes:
            start = min(e.start, len(text))
            text = text[:start] + e.put + text[max(start, min(e.stop, len(text))) :]
        assert (r.tokens_before, r.tokens_after, r.chars_after) == (before, len(library.encode(text, add_special_tokens=False).ids), len(text))


def test_packing_of_the_query_is_near_the_bound(spark, data):
    rows = packing.op8_pattern_packing(spark, data).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= -(-sum(r.length for r in rows) // 2048) * 1.02 + 1


def test_very_long_texts(spark, table):
    text = "".join(chr(0x4E00 + i * 7919 % 20000) + (" " if i % 9 == 0 else "") for i in range(200_000)) + " mail a.b@example.org " + "word " * 60_000
    rows = [(1, text, "zh"), (2, "x" * 400_000, "en"), (3, " " * 1_200_000 + "end", "en"), (4, "short and plain", "en"), (5, "1." * 150_000, None)]
    folder = table("documents", rows, "doc_id long, text string, lang string")
    table("benchmark", [(1, "mail a.b@example.org word word word word word"), (2, text[5000:5400])], "item_id long, text string")
    for query in (katz.op2_katz_scores, simhash.op5_simhash_components, langid.op6_language_profiles, recount.op3_edit_recount):
        assert query(spark, folder).count() == 5
    assert {r.item_id for r in decontam.op1_benchmark_leaks(spark, folder).collect()} == {1, 2}
    found = {r.doc_id: r for r in pii.op10_personal_data(spark, folder).collect()}
    assert found[1].n_email == 1 and found[2].spans == ""
    sizes = {r.doc_id: r[1] for r in packing.op8_pattern_packing(spark, folder).groupBy("doc_id").sum("length").collect()}
    library = Tokenizer.from_file(bpe.default_vocabulary()[0])
    assert sizes == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t, _ in rows}


def test_kept_trees_take_edits_round_after_round(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 20000 or text is null").unionByName(spark.createDataFrame([(None, None), (7, "")], "doc_id long, text string"), allowMissingColumns=True)
    kept = recount.trees(docs)
    library = Tokenizer.from_file(bpe.default_vocabulary()[0])
    library.encode_special_tokens = True
    for _ in range(3):
        kept = recount.edited(kept, recount.fixed_edits(F.col("doc_id"), F.col("text")))
    rows = kept.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.tokens == sum(x.tokens for x in r.leaves) == len(library.encode(r.text, add_special_tokens=False).ids)


@pytest.mark.parametrize("hot", [10**9, 40])
def test_slots_of_repeated_keys_are_gapless_and_in_order(spark, hot, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", hot)
    rows = [(i % 700, f"t{i}") for i in range(2000)] + [(5, "same")] * 300 + [(None, f"n{i}") for i in range(200)] + [(33, f"u{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "id long, sub string").repartition(7)
    got = sharding.assign(docs, "id", 4, ["id"], sub_buckets=3).collect()
    assert sorted((str(r.id), r["sub"]) for r in got) == sorted((str(i), t) for i, t in rows)
    by_shard, home = defaultdict(list), defaultdict(set)
    for r in got:
        by_shard[r.shard].append(r)
        home[r.id].add(r.shard)
        assert r.grown_shard in (r.shard, 4)
    assert all(len(s) == 1 for s in home.values())
    for own in by_shard.values():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        runs = [i for n, i in enumerate(r.id for r in own) if n == 0 or own[n - 1].id != i]
        assert len(runs) == len(set(runs))  # rows of a key are neighbours
