"""Near-duplicates, language models, languages, personal data, leaks and the pipeline against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import common, components, decontam, katz, langid, pii, resemblance, simhash

from .conftest import ODD, ODD_SCHEMA


def linked(items, near):
    """Least id reachable for each item."""
    root = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_anchors_meet_within_four_bits():
    rng = np.random.default_rng(0)
    for bits in range(5):
        for _ in range(200):
            x = rng.integers(0, 2**63, 1, dtype=np.uint64)
            flip = np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
            assert set(simhash.anchors(x, 4)[1]) & set(simhash.anchors(x ^ flip, 4)[1])


@pytest.mark.parametrize("cell_rows", [simhash.CELL_ROWS, 7])
def test_links_connect_what_brute_force_connects(spark, cell_rows):
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 60, dtype=np.uint64)
    more = [int(f) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for f in np.repeat(fp[:20], 12)]
    every = sorted({int(np.array(f, np.uint64).view(np.int64)) for f in [*map(int, fp), *more]})
    x = np.array(every, np.int64).view(np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    want = linked(range(len(every)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    links = simhash.similar(spark.createDataFrame([(e,) for e in every], "fp long"), 4, cell_rows).collect()
    at = {e: i for i, e in enumerate(every)}
    assert all(near is not None for near in links)
    assert linked(range(len(every)), [(at[r.a], at[r.b]) for r in links]) == want


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    rows = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_odd_rows(spark, odd, table):
    rows = simhash.op5_simhash_components(spark, odd).collect()
    assert len(rows) == len(ODD)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r.fingerprint].add(r.component_id)
    assert by_text["0" * 16] == {3}  # null, empty and blank texts
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}


def test_no_rows(spark, empty):
    for query in (simhash.op5_simhash_components, katz.op2_katz_scores, langid.op6_language_profiles, pii.op10_personal_data):
        assert query(spark, empty).count() == 0


def test_resemblance_finds_near_copies_and_leaves_others(spark):
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [random.choice(words) for _ in range(200)]
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 4):
            text = list(base)
            for _ in range(2):
                text[random.randrange(200)] = "changed"
            rows.append((g * 10 + k, " ".join(text)))
        half = base[:100] + [random.choice(words) for _ in range(100)]
        rows.append((g * 10 + 9, " ".join(half)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in resemblance.representatives(docs).collect()}
    assert kept == {g * 10 for g in range(25)} | {g * 10 + 9 for g in range(25)}


def test_representatives_of_odd_rows(spark):
    kept = resemblance.representatives(spark.createDataFrame(ODD, ODD_SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in (1, 3, 7, 8, 9, 11)] + [(True, 0)]


def brute_katz(docs, training, order=katz.ORDER):
    """The model from its definition: counts of whole n-grams, weights from their followers, recursion by word."""
    counts = [Counter() for _ in range(order + 1)]
    follow = defaultdict(set)
    for words, t in zip(docs, training, strict=True):
        if t:
            line = ["<s>", *words]
            counts[1].update(words)
            counts[1]["<s>"] += 1
            for n in range(2, order + 1):
                for i in range(n, len(line) + 1):
                    gram = tuple(line[i - n : i])
                    counts[n][gram] += 1
                    follow[gram[:-1]].add(gram[-1])
    starts = counts[1].pop("<s>", 0)
    total, types = sum(counts[1].values()), len(counts[1])
    tables = [None, *(katz.discounts(Counter(c.values())) for c in counts[1:])]
    cut = lambda r, n: tables[n][r - 1] if r <= katz.LARGE else r - katz.TRIM
    unknown = 1 - sum(cut(r, 1) for r in counts[1].values()) / total if total else 1.0
    size = lambda h: starts if h == ("<s>",) else counts[1][h[0]] if len(h) == 1 else counts[len(h)][h]

    def p(w, h):
        if not h:
            return cut(counts[1][w], 1) / total if counts[1][w] else unknown
        if counts[len(h) + 1][(*h, w)]:
            return cut(counts[len(h) + 1][(*h, w)], len(h) + 1) / size(h)
        return (alpha(h) if size(h) else 1.0) * p(w, h[1:])

    @lru_cache(maxsize=None)
    def alpha(h):
        return (1 - sum(p(w, h) for w in follow[h])) / (1 - sum(p(w, h[1:]) for w in follow[h]))

    for h in list(follow)[:300] + [("<s>",)] * bool(total):  # exactly normalised: all words and the unknown one sum to one
        assert len(counts[1]) > 2000 or sum(p(w, h) for w in counts[1]) + p(object(), h) == pytest.approx(1)
    for words in docs:
        line = ["<s>", *words]
        score = sum(math.log10(p(line[i], tuple(line[max(0, i - order + 1) : i]))) for i in range(1, len(line)))
        base = sum(math.log10((counts[1][w] + 0.1) / (total + 0.1 * (types + 1))) for w in words)
        yield len(words), sum(counts[1][w] > 0 for w in words), total, base, score


def check_katz(rows, got, order=katz.ORDER):
    words = [[*(r.text or "").encode().lower().split(), b""] for r in rows]
    training = [zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 10 != 0 for r in rows]
    want = sorted((str(r.doc_id), not t, *x) for r, t, x in zip(rows, training, brute_katz(words, training, order), strict=True))
    got = sorted((str(r.doc_id), *tuple(r)[1:]) for r in got)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


@pytest.mark.parametrize("hot, block", [(katz.HOT_TOKENS, katz.BLOCK_TOKENS), (20, 3000)])
def test_katz_is_the_brute_force_model(spark, data, odd, hot, block, monkeypatch):
    monkeypatch.setattr(katz, "HOT_TOKENS", hot)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    for folder in (data, odd):
        rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
        check_katz(rows, katz.op2_katz_scores(spark, folder).collect())


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz_of_a_corpus_of_one_pair(spark, table, order, monkeypatch):
    monkeypatch.setattr(katz, "HOT_TOKENS", 50)
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 200)
    rows = [(n, "a b " * (n % 40) + ("c" if n % 3 else "a a")) for n in range(90)]
    folder = table("documents", rows, "doc_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = common.new_path(spark, "model")
    check_katz(docs.collect(), katz.scores(docs, common.fold(F.col("doc_id"), 10) != 0, path, order).collect(), order)
    assert katz.read_table_of(spark, path, order).agg(F.sum("c")).first()[0] > 2000


def test_katz_beats_the_base_on_held_out_texts(spark, data):
    rows = katz.op2_katz_scores(spark, data).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_grams_stay_in_their_text():
    texts = ["Abc. déf!! x", "", "...", "a", "zz\n\nqq", "..x..", "日本 語"]
    grams, text, gram, count = langid.grams_of(texts, 3)
    got = defaultdict(Counter)
    for t, g, n in zip(text, gram, count):
        got[t]["".join(map(chr, grams[g]))] = int(n)
    for i, t in enumerate(texts):
        clean = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        line = f" {' '.join(clean)} " if clean else ""
        assert got[i] == Counter(line[k : k + 3] for k in range(len(line) - 2))


def test_languages_of_held_out_texts(spark, data, odd):
    rows = langid.op6_language_profiles(spark, data).where("held_out").join(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    got = {r.doc_id: r for r in langid.op6_language_profiles(spark, odd).collect()}
    assert len(got) == len({d for d, *_ in ODD})
    for i in (3, 4, 5, 9):
        assert got[i].lang_pred == "und" and got[i].score == 0.0
    assert all(0 <= r.score <= 1 for r in got.values())


RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, rule in RULES:
        for m in rule.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_of_random_texts(spark, table):
    random.seed(5)
    parts = ["a", "@", ".", "1", "2", "55", "-", " ", "+", "(", ")", "b.c", "é", "\U0001f600", "4111111111111111", "1.2.3.4", "_", "%", "a@b.c", "+1 555 010-2030"]
    rows = [(i, "".join(random.choice(parts) for _ in range(random.randint(0, 60)))) for i in range(600)]
    rows += [(9000, None), (9001, ""), (9002, "x" * 100000), (9003, "1" * 50000), (9004, "a@b.co " * 1000), (9005, "+" * 20000 + "1"), (9006, "1-" * 20000), (9007, "9." * 30000)]
    got = {r.doc_id: r for r in pii.op10_personal_data(spark, table("documents", rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        want, r = base_spans(text or ""), got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text or "")[:200]
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k, _ in RULES]


def test_contexts_of_seeds_find_unseen_identifiers(spark, table):
    rows = [(i, f"lorem the {i} text tel: +1 (98{i % 10}) 555-20{i:02d} and more mail: u{i}@x.org end") for i in range(30)]
    rows += [(100, "please tel: 555-0199-7 now"), (101, "the version 12345 of tel"), (102, "mail: joe1@intranet, thanks"), (103, "room 12345 is here")]
    folder = table("documents", rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.op10_personal_data(spark, folder).collect()}
    assert (got[100], got[101], got[102], got[103]) == ("phone:12:22", "", "email:6:19", "")
    clean = {r.doc_id: r.text for r in pii.redact(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert clean[3] == "lorem the 3 text tel: [PHONE] and more mail: [EMAIL] end" and clean[103] == rows[-1][1]


def test_odd_rows_keep_their_number(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert pii.op10_personal_data(spark, odd).count() == len(ODD)
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs).count() == len(ODD)


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    random.seed(3)
    for _ in range(200):
        p, t = ("".join(random.choice("ab c") for _ in range(random.randint(a, b))) for a, b in ((1, 70), (0, 100)))
        assert decontam.best_match(p, t)[0] == edit_distance(p, t)


def test_edited_items_are_found_and_others_left(spark):
    random.seed(6)
    letters = "abcdefghij  "
    items = [(i, "".join(random.choice(letters) for _ in range(250))) for i in range(15)] + [(90, None), (91, "short"), (92, "")]
    rows = []
    for n in range(120):
        noise = "".join(random.choice(letters) for _ in range(400))
        if n % 2:
            text = list(decontam.normalize(items[n % 15][1]))
            for _ in range(random.randint(0, 15)):
                k = random.randrange(len(text))
                text[k : k + 1] = random.choice([["z"], [], ["y", text[k]]])
            rows.append((n, noise + "\n" + "".join(text).upper() + noise))
        else:
            rows.append((n, noise))
    rows += [(500, None), (501, ""), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs, benchmark).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in got) == sorted([str((n, n % 15)) for n in range(1, 120, 2)] + [str((None, 0))])
    texts = dict(rows)
    for r in got:
        assert edit_distance(decontam.normalize(items[r.item_id][1]), decontam.normalize(texts[r.doc_id][r.start : r.stop])) <= r.distance
    kept = decontam.without_leaks(docs, benchmark).collect()
    assert sorted(r.doc_id for r in kept) == [*range(0, 120, 2), 500, 501]
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0 and decontam.without_leaks(docs.limit(0), benchmark).count() == 0


def test_pipeline_keeps_columns_and_clean_documents(spark, data):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns
        seen.append((name, after.count()))
    packed = corpus_pipeline.run(spark, data)
    assert packed.count() >= packed.select("doc_id").distinct().count() > 100
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_of_odd_rows(spark, table, rows):
    import corpus_pipeline

    table("benchmark", [(1, "an item that nothing holds, long enough to be searched")], "item_id long, text string")
    folder = table("documents", rows, ODD_SCHEMA)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    ids = {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()}
    assert ids == ({1, 7, 8, None, 11} if rows else set())


def alike(rows, words=5):
    """Exact resemblance of all pairs, as a function of two positions."""
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (t.lower().split() for _, t in rows)]
    return lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])


@pytest.mark.parametrize("low, high, length, changes", [(0.8, 0.82, 300, 6), (0.8, 0.82, 900, 18), (0.83, 1, 300, 5)])
def test_pairs_just_above_the_resemblance_are_linked_and_none_below(spark, low, high, length, changes):
    random.seed(11)
    rows = []
    while len(rows) < 700:
        base = [f"p{len(rows)}w{i}" for i in range(length)]
        at = set(random.sample(range(length), changes if len(rows) % 8 else changes + 2))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join("new" if i in at else w for i, w in enumerate(base)))]
    value = alike(rows)
    above = [i for i in range(0, 700, 2) if low <= value(i, i + 1) < high]
    below = [i for i in range(0, 700, 2) if value(i, i + 1) < 0.8]
    assert len(above) > 100
    of = {r.doc_id: r.component for r in resemblance.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(of[i] == of[i + 1] for i in above) >= 0.97 * len(above)
    assert not any(of[i] == of[i + 1] for i in below)


@pytest.mark.parametrize("group_bytes", [resemblance.GROUP_BYTES, 20_000])
def test_classes_of_families_are_those_of_all_pairs(spark, group_bytes):
    """A family just below the resemblance with copies in it, and one of true copies, in one cell and in many chunks."""
    random.seed(8)
    changed = lambda text, n: [f"c{random.random()}" if i in at else w for at in [set(random.sample(range(200), n))] for i, w in enumerate(text)]
    template, other = [f"w{i}" for i in range(200)], [f"v{i}" for i in range(200)]
    rows = []
    for n in range(200):
        rows.append((n, " ".join(variant := changed(template, 3))))
        rows.append((2000 + n, " ".join(changed(other, 1))))
        if n % 4 == 0:
            rows.append((1000 + n, " ".join(changed(variant, 2 if n % 8 else 1))))
    value = alike(rows)
    want = linked(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if value(i, j) >= 0.8])
    found = resemblance.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=group_bytes).collect()
    of = {r.doc_id: r.component for r in found}
    want, got = [want[i] for i in range(len(rows))], [of[i] for i, _ in rows]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True))) > 20


def test_a_context_counts_from_the_same_seeds_in_a_large_corpus(spark, table):
    rows = [(n, " ".join(f"their mail u{n}i{i}@x.org" for i in range(1000))) for n in range(45)]
    rows += [(100 + n, f"their badge: q{n}@y.org here") for n in range(4)] + [(200, "their badge: joe1@intranet here")]
    got = {r.doc_id: r.spans for r in pii.op10_personal_data(spark, table("documents", rows, "doc_id long, text string")).collect()}
    assert got[200] == "email:13:26"
