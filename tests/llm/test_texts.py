"""Operators on texts against plain Python."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventloom.llm import ctw, exact_dedup, license_scan, minhash, mixing, packing, sharding, token_file, toxicity
from eventloom.llm.common import WordTokenizer, byte_bpe

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_ids(text):
    t = plain_ids.__dict__.setdefault("t", WordTokenizer(byte_bpe()).library)
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def classes_of(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_tokenizer_memo_equals_library():
    t = WordTokenizer(byte_bpe())
    odd = ["a  b\n\nc 's don't  ", "\x85y \xa0z", "l'été 12ab34  --!! \t\n x", "\x1c a\x1fb", "x​y 漢字", "<|endoftext|> a", None, "", "\nx y\n", " a ", "ªº² x", "a\0b"]
    t.LIMIT = 5  # the memo turns over
    for _ in range(2):
        got = t.encode_all(odd + [f"w{i} the" for i in range(50)])
    for text, ids in zip(odd, got):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain_ids(text)[:-1]


def test_added_tokens_as_in_a_fresh_library():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(byte_bpe())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "l'été  <|endoftext|>\n", "漢 <|endoftext|> 字", "<|endoftext", "|>", "a b"]
    for text, ids in zip(texts * 2, WordTokenizer(byte_bpe()).encode_all(texts * 2)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids
    assert 50256 in fresh.encode(texts[0], add_special_tokens=False).ids


@pytest.mark.parametrize("block", [8, 16_384])
def test_exact_classes(docs, rows, block):
    got = exact_dedup.exact_classes(docs, block).collect()
    norm = [(r[0], re.sub(r"[ \t-\r]+", " ", r[1] or "")) for r in rows if len(r[1] or "") < 1000 or block > 8]
    if block == 8:
        got = exact_dedup.exact_classes(docs.where("text IS NULL OR length(text) < 1000"), block).collect()
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is None, x))):
            want[(i, keep, len(ids), i == keep and k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r[:5]) for r in got) == want


def test_drop_copies(docs, rows):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    texts = [re.sub(r"[ \t-\r]+", " ", r.text or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[ \t-\r]+", " ", r[1] or "") for r in rows})


def test_near_classes(docs, rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(FOLD))
        if i is not None:
            sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes_of(links, ids)
    got = minhash.near_classes(docs).collect()
    assert len(got) == len(rows) and len(links) > 20
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = minhash.signature(x[:2500], 4000), minhash.signature(x[500:], 4000)
    assert abs((a == b).mean() - 2000 / 3000) < 0.03


def test_signature_of_a_large_set_works_in_the_cache():
    x = np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64)
    tracemalloc.start()
    a = minhash.signature(x, 336)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_200_000  # three arrays of 336 x 1,024 numbers, and more, before
    # the minimum over a set is the least of the minima over its parts, wherever the parts are cut
    parts = [minhash.signature(p, 336) for p in (x[:700], x[700:701], x[701:])]
    assert (np.minimum.reduce(parts) == a).all()


def test_shingles_need_no_table_of_words():
    texts = [b"A  b\tc a b", b"a", b"", b" \n", b"x x x x", "\u00c4 \u00e4 z".encode()]
    for t in texts:
        w = t.lower().split()
        want = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())
        got = minhash.shingle_set(t, 2)
        assert len(got) == len(want) and (np.diff(got.view(np.int64).astype(object)) != 0).all() and (got[:-1] < got[1:]).all()


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for i, t, _, s, *_ in rows:
        size[s] += len(re.findall(r"[^ \t-\r]+", t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    taken = Counter()
    for r in got:
        assert r.taken == r.copies * r.size <= 3 * r.size and r.source_size == size[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9)
        taken[r.source] += r.taken
    expected = Counter()
    for r in got:
        expected[r.source] += r.rate * r.size
    assert all(math.isclose(expected[s], target[s], rel_tol=1e-6) for s in names if target[s] < 3 * size[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_pack(docs, rows):
    got = packing.pack(docs, capacity=128, window=500).collect()
    docs_of = defaultdict(list)
    for r in got:
        docs_of[r.doc_id].append(r)
    for i, t, *_ in rows:
        if i == rows[-2][0] or i is None:
            continue
        ids, at = plain_ids(t), 0
        for r in sorted(docs_of[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and np.frombuffer(r.ids, dtype="<u4").tolist() == ids[at : at + r.length]
            at += r.length
        assert at == len(ids)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 128


def test_best_cuts_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        pos = np.unique(np.concatenate([[0], rng.integers(1, 200, 30)]))
        if np.diff(pos).max() > 40:
            continue
        pen = rng.choice([0, 8.0, 32.0], len(pos))
        best = [0.0] + [math.inf] * (len(pos) - 1)
        pad = lambda n: 0 if n & (n - 1) == 0 else 40 - n
        for j in range(1, len(pos)):
            best[j] = min(best[i] + pad(int(pos[j] - pos[i])) + pen[j] + 8 for i in range(j) if pos[j] - pos[i] <= 40)
        cuts = packing.best_cuts(pos, pen, 40, 8.0, 1)
        cost = dict(zip(pos.tolist(), pen.tolist()))
        assert math.isclose(sum(pad(b - a) + cost[b] + 8 for a, b in zip(cuts, cuts[1:])), best[-1])


def test_token_file_round_trip(spark, docs, rows, tmp_path):
    token_file.write_tokens(docs, str(tmp_path / "t"), str(tmp_path / "s"), block_tokens=1000)
    got = sorted(token_file.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    want = sorted(((r[0] if r[0] is not None else -1, plain_ids(r[1])) for r in rows))
    at = 0
    for r, (i, ids) in zip(got, want, strict=True):
        assert (-1 if r.doc_id is None else r.doc_id, r.start, np.frombuffer(r.ids, dtype="<u4").tolist()) == (i, at, ids)
        at += r.n_tokens


def test_byte_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1003):
        x = rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)
        assert (token_file.unpack_numbers(*token_file.pack_numbers(x), n) == x).all()


def test_shards(docs, rows):
    got = sharding.shard(docs, 4, min_ranges=32).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(len((r[1] or "").encode()) + 1 for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.doc_id, r.text_crc32) for r in got} == {(r[0], zlib.crc32((r[1] or "").encode())) for r in rows}


def test_hot_text_is_spread_and_the_rest_stays_together(spark):
    rows = [(i, "hot text of some length" if i % 3 else f"cold {i // 6}") for i in range(6000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), 8).collect()
    size, where = Counter(), defaultdict(set)
    for r in got:
        size[r.shard] += r["size"]
        where[r.text_crc32].add(r.shard)
    assert max(size.values()) < 1.02 * sum(size.values()) / 8 and sum(len(s) > 1 for s in where.values()) == 1


def test_groups_that_fit_a_shard_stay_whole(spark):
    """Groups of a third, a quarter and a tenth of all bytes: with three shards each fits; with six the first two cannot."""
    rows = [(i, f"text {'third' if i % 60 < 19 else 'quart' if i % 60 < 34 else 'tenth' if i % 60 < 40 else 100_000 + i // 3}") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for shards, split in ((3, 0), (6, 2)):
        got = sharding.shard(docs, shards).collect()
        size, where, slots = Counter(), defaultdict(set), defaultdict(list)
        for r in got:
            size[r.shard] += r["size"]
            where[r.text_crc32].add(r.shard)
            slots[r.shard].append(r.slot)
        assert len(size) == shards and max(size.values()) < 1.02 * sum(size.values()) / shards and sum(len(s) > 1 for s in where.values()) == split
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.shard(docs.repartition(2), shards).collect()))


def test_placements_fill_the_fullest_shard_that_has_room():
    assert sharding.placements({7: 50, 5: 30, 3: 25, 9: 120}, 200, 2) == ({7: 0, 5: 0, 3: 1}, [20.0, 75.0])


def test_licence_places(docs, rows):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t, *_ in rows:
        w = rx.findall((t or "").translate(FOLD))
        p = [(k, label) for label, phrase, _ in license_scan.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        want[(i, len(w), len(p), min((k for k, _ in p), default=None), max((k for k, _ in p), default=None), ",".join(sorted({x for _, x in p})))] += 1
    got = license_scan.scan(docs).collect()
    assert Counter(tuple(r[:6]) for r in got) == want and sum(r.n_base for r in got) == 3
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_licence_scan_is_native(docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_context_tree_weights_equal_sequential_coding():
    """The batch trees give the code length of the classical recursion, and predictions are probabilities."""
    rng = np.random.default_rng(4)
    words = [bytes(rng.choice([97, 98], rng.integers(1, 5)).tolist()) for _ in range(200)]
    keys, _, _ = ctw.ngram_keys(words, 3)
    uniq, n = np.unique(keys, return_counts=True)
    context, length, byte = ctw._split(uniq)
    some = length >= 2
    g = (context & 0xFFFF) == (context[some][0] & 0xFFFF)
    t = ctw.Trees(context[g & some], length[g & some], byte[g & some], n[g & some].astype(float), 7, 3)

    def block(rows, d):
        n1 = sum(c for k, b, c in rows if b & 1)
        pe, n0 = 1.0, sum(c for *_, c in rows) - n1
        for a, m in ((0, n0), (n0, n1)):
            for k in range(m):
                pe *= (k + 0.5) / (a + k + 1)
        kids = {k[0][: d + 1] for k in [(x[0],) for x in rows] if len(k[0]) > d}
        if not kids:
            return pe
        under = math.prod(block([r for r in rows if r[0][: d + 1] == kid], d + 1) for kid in kids)
        return 0.5 * pe + 0.5 * under

    for node, pw in zip(t.levels[2]["nodes"], t.levels[2]["pw"]):
        rows = []
        for c, ln, b, m in zip(context[g & some], length[g & some], byte[g & some], n[g & some]):
            path = tuple((int(c) >> (8 * i)) & 255 for i in range(int(ln)))
            if ((1 << 7) | (int(b) >> 1)) == int(node) & 0xFF:
                rows.append((path, int(b), int(m)))
        assert math.isclose(math.log(block(rows, 2)), pw, rel_tol=1e-9)


def test_context_tree_scores(docs, rows):
    got = ctw.score_texts(docs, folds=4, top=20).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 0
    c = Counter()
    for i, t, *_ in rows:
        if not held(i):
            c.update(re.findall(r"[^ \t-\r]+", (t or "").translate(FOLD)) + [None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate(FOLD)) + [None]
        want[(i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    again = ctw.score_texts(docs, folds=4, top=100_000)
    assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(sorted(r.score for r in got), sorted(r.score for r in again.collect())))


def test_log_gamma():
    x = np.array([0.5, 1.0, 3.5, 8.0, 1e3, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12)


def test_toxicity_learns_and_marks_held_out_rows(spark):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.15
        words = [rng.choice("alpha beta gamma delta eta theta iota".split()) for _ in range(40)]
        if toxic:
            words[rng.randrange(40)] = rng.choice(["Vile", "nasty!"])
        rows.append((i, " ".join(words), None))
        labels.append((i, 1, int(toxic)))
    rows += [(600, None, None), (601, "", None), (None, "vile", None), (5, rows[5][1], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    marks = spark.createDataFrame(labels + [(7, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, marks)).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in got if r.doc_id in truth) >= 598
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.where("text = 'vile'").count() == 0 and kept.where("doc_id = 600").count() == 1
    blank = marks.limit(0)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, blank)).collect()} == {1 / (1 + math.exp(40))}


def test_toxicity_finds_hidden_positives(spark):
    """Few toxic texts are labelled, others hide among the labels of 0 and among texts without a label; the mixture is all of them."""
    import random

    rng = random.Random(2)
    rows, labels, truth = [], [], {}
    for i in range(2400):
        truth[i] = int(rng.random() < 0.2)
        words = [rng.choice("alpha beta gamma delta eta theta iota".split()) for _ in range(30)]
        if truth[i]:
            words[rng.randrange(30)] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(words)))
        if i < 800:
            labels.append((i, truth[i] if rng.random() < 0.3 else 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    sample, _ = toxicity.sampled_ids(docs, marks)
    got = {r.doc_id: (r.p, r.u) for r in sample.collect()}
    marked = dict(labels)
    free = lambda i: zlib.crc32(str(i).encode()) % toxicity.FOLDS != 0
    assert got == {i: (int(marked.get(i) == 1), 1) for i in truth if free(i)}
    scores = toxicity.score(docs, toxicity.train(docs, marks, prior=0.2)).collect()
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in scores) >= 2380


def test_toxicity_fits_on_one_row_per_id(spark, monkeypatch):
    seen = []
    fit = toxicity._fit_local
    monkeypatch.setattr(toxicity, "_fit_local", lambda sample, keep, prior: seen.extend(sample) or fit(sample, keep, prior))
    rows = [(i, "vile words" if i % 4 == 0 else "plain words") for i in range(80)] + [(i, f"repeated {k % 3}") for k in range(300) for i in (8, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40) if i != 9], "doc_id bigint, toxic int")
    toxicity.train(docs, marks)
    assert 0 < len(seen) == toxicity.sampled_ids(docs, marks)[0].count() <= 80


def test_non_negative_step_keeps_hidden_positives():
    rows = [np.array([0]) if i < 30 else np.array([1]) for i in range(100)]
    w = toxicity.fit_nnpu(rows, np.arange(100) < 10, 0.3, 2)
    assert w[0] + w[2] > 0 > w[1] + w[2]


def test_empty_tables(spark, none, tmp_path):
    assert exact_dedup.exact_classes(none).count() == exact_dedup.drop_copies(none).count() == 0
    assert minhash.near_classes(none).count() == minhash.drop_near(none).count() == 0
    assert mixing.mix(none).count() == mixing.mixed(none).count() == 0
    assert packing.pack(none).count() == sharding.shard(none).count() == license_scan.scan(none).count() == 0
    assert ctw.score_texts(none).count() == 0
    token_file.write_tokens(none, str(tmp_path / "t"), str(tmp_path / "s"))
    assert token_file.read_tokens(spark, str(tmp_path / "t")).count() == 0
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0
