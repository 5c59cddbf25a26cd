"""Resampling, spelling variants and archives against plain Python."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from eventloom.llm import resampling, spelling, warc

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, gram):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    return len(w), [" ".join(w[i : i + g]) for g in range(1, gram + 1) for i in range(len(w) - g + 1)]


def plain_draw(docs, target, gram, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    d = [(i, *features(t, gram)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, x in d for f in x), Counter(bucket(f) for x in target for f in features(x, gram)[1])
    S, T = sum(s.values()), sum(t.values())
    out, enough = [], []
    for i, n, x in d:
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, x)]
        w = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = (i, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        (enough if n >= 20 else out).append(row)
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    k = 10 * len(enough) // 100
    return Counter([(*r, None) for r in out] + [(*r, j + 1 if j < k else None) for j, r in enumerate(enough)])


@pytest.mark.parametrize("gram,buckets,digit_bits,block_bits", [(1, 10_000, 16, 18), (3, 50, 3, 4)])
def test_draw(spark, docs, rows, gram, buckets, digit_bits, block_bits):
    target = ["released under one", None, "", "MIT license an be co du el fi go"]
    table = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    got = resampling.draw(docs, table, gram, buckets, digit_bits=digit_bits, block_bits=block_bits)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert Counter(tuple(r) for r in got.collect()) == plain_draw([r[:2] for r in rows], target, gram, buckets)


def test_draw_of_tied_wide_and_missing(spark, none):
    text = "a b c d e f g h i j " * 3
    ids = [2**63 - 1, -(2**63), 0, None, 7, 7, 7] + list(range(100, 200))
    rows = [(i, text + " x" * (k % 3)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    empty = spark.createDataFrame([], "text string")
    assert Counter(tuple(r) for r in resampling.draw(docs, empty).collect()) == plain_draw(rows, [], 1, 10_000)
    assert resampling.draw(none, empty).collect() == []
    assert [tuple(r) for r in resampling.draw(docs.where("doc_id = 0").withColumn("text", docs.text.substr(1, 3)), empty).collect()][0][4] is None


def test_pieces_of_long_texts_do_not_matter():
    text = ("Ab-cd é漢x " * 50 + "z" * 40).encode()
    for gram in (1, 3):
        whole = [(n, f) for n, f in resampling.bucket_lists(text, resampling.Buckets(97), gram)]
        cut = [(n, f) for n, f in resampling.bucket_lists(text, resampling.Buckets(97), gram, 7)]
        assert len(whole) == 1 < len(cut)
        assert whole[0][0] == sum(n for n, _ in cut) and Counter(whole[0][1]) == Counter(x for _, f in cut for x in f)
    assert [w for part in spelling.runs("ab1cd" * 30, 7) for w in part] == re.findall("[a-z]+", "ab1cd" * 30)


def test_radix_order_of_several_keys(spark):
    rng = random.Random(5)
    rows = [(rng.randint(-4, 4), rng.choice([-(2**63), 2**63 - 1, 5, -5]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, pos bigint").repartition(4)
    got = resampling.radix_order(df.withColumn("of", df.pos), ["a", "b"], 5, 4).collect()
    assert [r.of for r in sorted(got, key=lambda r: r.pos)] == [r[2] for r in sorted(rows)]
    assert sorted(r.pos for r in got) == list(range(400))


def plain_variants(docs, min_length, min_count, dropped):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % dropped == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}
    letters = {c for w in n for c in w}

    def edits(w):
        gone = {w[:i] + w[i + 1 :] for i in range(len(w))}
        changed = {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        more = {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return (gone | changed | more) - {w}

    near = {w: [v for v in edits(w) if v in n] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize("min_length,min_count,dropped", [(5, 3, 97), (1, 1, 5)])
def test_variants(spark, docs, rows, min_length, min_count, dropped):
    rng = random.Random(11)
    more = []
    for i in range(300):
        base = rng.choice(["aaaaa", "abcde", "abcdé", "ÿbcde", "ABAB", "letter", "lettter", "lettr", "a" * 3000])
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(base))
            base = base[:at] + rng.choice(["", "a", "É", "é", "bb"]) + base[at + rng.randint(0, 1) :]
        more.append((1000 + i % 250, f"{base} {base},{base}×漢{base[:7]}1"))
    table = docs.select("doc_id", "text", "word", "n", "size").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True)
    got = spelling.variants(table.repartition(5), min_length, min_count, dropped=dropped)
    want = plain_variants([r[:2] for r in rows] + more, min_length, min_count, dropped)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_variants_of_nothing(none, docs):
    assert spelling.variants(none).collect() == []
    assert spelling.variants(docs.where("text IS NULL")).collect() == []


PAGES = [
    (5, "http://a/x?é b", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "u\r\nX: y", None), (8, "u", ""), (1, "u", "p" * 300_000), (2, "u", "p" * 300_000),
    (7, "u", "a\r\n\r\nb\x00"), (None, "u", "a\r\n\r\nb\x00"), (None, "n", "only"), (4, "u", "same"), (4, "u", "same"), (6, "v%20w", "same"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "d", "s", 1) for r in PAGES], "page_id bigint, url string, html string, digest string, sha1 string, bytes int").repartition(3)


@pytest.mark.parametrize("smallest,salt", [(0, 200_000), (6, 2)])
def test_archive_round_trip(spark, pages, tmp_path, smallest, salt):
    path = f"{tmp_path}/a"
    warc.write_archive(pages, path, smallest, rows_per_task=salt)
    assert spark.read.parquet(f"{path}/payloads").count() == len({r[2] or "" for r in PAGES})
    records = warc.read_records(spark, path, salt)
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, bytes(r.payload)) for r in records.collect())
    want = Counter()
    for i, _, html in PAGES:
        p = (html or "").encode()
        of = min((j for j, _, h in PAGES if (h or "").encode() == p and j is not None), default=None)
        again = len(p) >= smallest and i != of
        text = lambda x: None if x is None else str(x)
        want[(text(i), "revisit" if again else "response", text(of) if again else None, base64.b32encode(hashlib.sha1(p).digest()).decode(), len(p), p)] += 1
    assert got == want


def test_records_as_in_a_file(spark, pages, tmp_path):
    path = f"{tmp_path}/a"
    warc.write_archive(pages, path)
    records = warc.read_records(spark, path)
    for r in records.withColumn("whole", warc.record_bytes(records)).collect():
        head, rest = bytes(r.whole).split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.0" and len(fields) == len(lines) - 1 and "X" not in fields
        assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        http, body = rest[:-4].split(b"\r\n\r\n", 1)
        assert body == (b"" if r.record_type == "revisit" else bytes(r.payload)) and f"Content-Length: {len(r.payload)}".encode() in http
    assert {r.url for r in records.collect()} == {"http://a/x?%C3%A9%20b", None, "u%0D%0AX:%20y", "u", "n", "v%20w"}


def test_changed_or_missing_payloads_raise(spark, pages, tmp_path):
    path = f"{tmp_path}/a"
    warc.write_archive(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/b/headers")
    stored.where("octet_length(payload) <> 4").write.parquet(f"{tmp_path}/b/payloads")
    with pytest.raises(Exception, match="lacks its payload"):
        warc.read_records(spark, f"{tmp_path}/b").collect()
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/c/headers")
    stored.selectExpr("digest", "CASE WHEN octet_length(payload) = 4 THEN CAST('none' AS BINARY) ELSE payload END AS payload").write.parquet(f"{tmp_path}/c/payloads")
    with pytest.raises(Exception, match="not what its digest says"):
        warc.read_records(spark, f"{tmp_path}/c").collect()


def test_archive_of_nothing(spark, pages, tmp_path):
    warc.write_archive(pages.limit(0), f"{tmp_path}/a")
    assert warc.read_records(spark, f"{tmp_path}/a").collect() == []
