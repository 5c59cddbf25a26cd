"""Language-model scores by context-tree weighting.

A text is coded byte by byte, A-Z as a-z, each byte as eight binary decisions.  The context of a byte is what stands before it in
its segment, a word with the white-space byte (or end) behind it, up to ``DEPTH`` bytes back.  Every context of every depth
holds a Krichevsky-Trofimov estimate per decision; context-tree weighting mixes the depths, a node's weight being its own block
probability against the product of its children's.  A context never seen leaves the decision to its parent.

As contexts end at the segment, a segment's code length is a number of its own, and all statistics come from counts of
distinct segments.  Those counts, the n-grams of bytes under them and the context trees are tables, spread by key: trees below
depth 1 by their last two bytes, one group per such pair; the driver sees the two top levels (at most 256 * 255 nodes).
Segment scores return to the documents from a table of the ``top`` most frequent segments, of fixed size, and by a join for all others.

Defined cases: a null or empty text is its end token.  A null id is never held out.  Rows that repeat an id are scored one by
one.  Without training text every decision has probability one half and every count is 0.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map, is_held_out, raw, slices
from eventloom.operators.ordered import CHUNK, chunk_by_range
from eventloom.session import pin, scratch_path

DEPTH = 5
FOLDS = 10
TOP = 250_000
MARK = 0xFF  # starts a segment as context and ends the text as symbol; never a byte of UTF-8
ENDS = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, MARK]
LAST = {bytes([c]): k for k, c in enumerate(ENDS)}
COUNTS = [f"n{k}" for k in range(len(ENDS))]


def segments(text: bytes) -> list[bytes]:
    """Words with the one white-space byte behind them, the last with the end mark."""
    t = text.lower()
    if b"\0" in t:
        import re

        return re.findall(rb"[^ \t-\r]*[ \t-\r]|[^ \t-\r]*\xff", t + b"\xff")
    for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"):
        if c in t:
            t = t.replace(c, c + b"\0")
    return (t + b"\xff").split(b"\0")


def _counter(folds: int):
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def rows(seen):
            keys = list(seen)
            arrays = [pa.array([k[:-1] for k in keys], pa.binary()), pa.array([LAST[k[-1:]] for k in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "last", "n"])

        seen: Counter = Counter()
        for b in slices(batches):
            for doc_id, t in zip(b.column("doc_id").to_pylist(), raw(b.column("text"))):
                s = segments(t)
                if is_held_out(doc_id, folds):
                    seen.update(dict.fromkeys(s, 0))
                else:
                    seen.update(s)
            if len(seen) > 400_000:
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    return run


def word_table(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``word, n0..n6``: training count of each word before each kind of end; null where the pair never occurs, 0 where only
    held-out texts have it."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = arrow_map(rows, _counter(folds), "word binary, last int, n bigint")
    return found.groupBy("word").agg(*[F.sum(F.when(F.col("last") == k, F.col("n"))).alias(c) for k, c in enumerate(COUNTS)])


def ngram_keys(words: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the words, each with its context: ``(key, word number, place in the word)``.

    A key holds the context's length, its bytes (the nearest lowest) and the byte: ``length << 48 | context << 8 | byte``."""
    lens = np.array([len(w) + 1 for w in words], dtype=np.int64)
    flat = np.frombuffer(b"".join(b"\xff" + w for w in words), dtype=np.uint8).astype(np.int64)
    number = np.repeat(np.arange(len(words)), lens)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    context = np.zeros(len(flat), np.int64)
    for d in range(1, depth + 1):
        back = np.concatenate([np.zeros(min(d, len(flat)), np.int64), flat[:-d]])
        context |= np.where(place >= d, back, 0) << (8 * (d - 1))
    key = (np.minimum(place, depth) << 48) | (context << 8) | flat
    some = place > 0
    return key[some], number[some], place[some]


def end_contexts(words: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For each word the key of the byte behind it, that byte left out."""
    return ngram_keys([w + b"\0" for w in words], depth)[0][np.cumsum([len(w) + 1 for w in words]) - 1] if words else np.zeros(0, np.int64)


def _ngrams(batches):
    """Distinct n-gram keys of a batch of words with their training counts."""
    import pyarrow as pa

    for b in slices(batches, 50_000):
        words = raw(b.column("word"))
        n = np.stack([np.asarray(b.column(c).fill_null(-1).to_numpy(zero_copy_only=False)) for c in COUNTS], axis=1).astype(np.int64)
        key, number, _ = ngram_keys(words)
        tails = end_contexts(words)
        has = n >= 0
        row, kind = np.nonzero(has)
        keys = np.concatenate([key, tails[row] | np.array(ENDS)[kind]])
        weight = np.concatenate([np.maximum(n, 0).sum(axis=1)[number], n[row, kind]])
        uniq, inv = np.unique(keys, return_inverse=True)
        chunk = b.column(CHUNK)[0].as_py() if b.num_rows else 0
        if b.num_rows and not (np.asarray(b.column(CHUNK)) == chunk).all():
            raise ValueError("a batch holds words of two chunks")
        total = np.bincount(inv, weights=weight, minlength=len(uniq)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uniq), chunk)), pa.array(uniq), pa.array(total)], names=[CHUNK, "key", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x > 0."""
    shift = np.zeros_like(x)
    y = x.astype(float)
    for _ in range(8):
        low = y < 8
        shift -= np.where(low, np.log(np.where(low, y, 1.0)), 0.0)
        y = np.where(low, y + 1, y)
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


HALF = np.log(0.5)


class Trees:
    """Context trees below depth 1 of one pair of last bytes, for one of the eight decisions of a byte.

    Rows are n-grams ``(context, length, byte, n)``; nodes of a depth are the distinct (context, bits so far)."""

    def __init__(self, context, length, byte, n, bit: int, depth: int):
        self.prefix = (1 << bit) | (byte >> (8 - bit))
        self.one = (byte >> (7 - bit)) & 1
        self.at, self.levels = {}, {}
        for d in range(2, depth + 1):
            rows = np.flatnonzero(length >= d)
            if not len(rows):
                break
            node = ((context[rows] & ((1 << (8 * d)) - 1)) << 8) | self.prefix[rows]
            uniq, first, inv = np.unique(node, return_index=True, return_inverse=True)
            n1 = np.bincount(inv, weights=n[rows] * self.one[rows], minlength=len(uniq))
            n0 = np.bincount(inv, weights=n[rows], minlength=len(uniq)) - n1
            self.at[d] = (rows, inv)
            self.levels[d] = {"n0": n0, "n1": n1, "leaf": (length[rows[first]] == d), "pe": log_kt(n0, n1), "up": rows[first], "nodes": uniq}
        below = None
        for d in sorted(self.levels, reverse=True):
            v = self.levels[d]
            if below is None:
                v["pw"] = v["pe"]
            else:
                child = self.levels[d + 1]
                place = np.zeros(len(context), np.int64)
                place[self.at[d][0]] = self.at[d][1]
                under = np.bincount(place[child["up"]], weights=child["pw"], minlength=len(v["n0"]))
                v["pw"] = np.where(v["leaf"], v["pe"], np.logaddexp(HALF + v["pe"], HALF + under))
            v["w"] = np.where(v["leaf"] | (below is None), 1.0, np.exp(np.minimum(0.0, HALF + v["pe"] - v["pw"])))
            below = d

    def probabilities(self, done: np.ndarray, rest: np.ndarray, kt: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Probability of each row's decision, from the state its depth 1 left: mass mixed so far, mass open, estimate, weight."""
        done, rest, kt, w = done.copy(), rest.copy(), kt.copy(), w.copy()
        for d in sorted(self.levels):
            rows, inv = self.at[d]
            v = self.levels[d]
            n = v["n0"] + v["n1"]
            seen = n[inv] > 0
            r, i = rows[seen], inv[seen]
            done[r] += rest[r] * w[r] * kt[r]
            rest[r] *= 1 - w[r]
            kt[r], w[r] = ((v["n1"] + 0.5) / (n + 1.0))[i], v["w"][i]
        p1 = np.clip(done + rest * kt, 1e-12, 1 - 1e-12)
        return np.where(self.one == 1, p1, 1 - p1)


def _groups(batches, columns: list[str]):
    """Whole groups, keyed by ``g``, out of batches sorted by it."""
    held, key = [], None
    for b in batches:
        g = np.asarray(b.column("g"))
        edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else [0]
        for lo, hi in zip(edges, edges[1:]):
            if held and g[lo] != key:
                yield key, [np.concatenate(c) for c in zip(*held)]
                held = []
            key = g[lo]
            held.append([np.asarray(b.column(c))[lo:hi] for c in columns])
    if held:
        yield key, [np.concatenate(c) for c in zip(*held)]


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (key >> 8) & ((1 << 40) - 1), key >> 48, key & 0xFF


def _summaries(depth: int):
    """Per group and bits so far: the counts and the weighted probability its depth-2 node passes up to depth 1."""

    def run(batches):
        import pyarrow as pa

        for g, (key, n) in _groups(batches, ["key", "n"]):
            context, length, byte = _split(key)
            for bit in range(8):
                t = Trees(context, length, byte, n, bit, depth)
                leaf = length[0] == 1
                prefix, inv = np.unique(t.prefix, return_inverse=True)
                n1 = np.bincount(inv, weights=n * t.one, minlength=len(prefix))
                n0 = np.bincount(inv, weights=n, minlength=len(prefix)) - n1
                pw = np.zeros(len(prefix)) if leaf else t.levels[2]["pw"]
                last = np.full(len(prefix), int(context[0] & 0xFF))
                yield pa.RecordBatch.from_arrays([pa.array(last), pa.array(prefix.astype(np.int64)), pa.array(n0), pa.array(n1), pa.array(pw)], names=["last", "prefix", "n0", "n1", "pw"])

    return run


class Roots:
    """The two top levels: for each last byte and bits so far, the state in which depth 1 leaves a decision."""

    def __init__(self, rows):
        n0, n1, under = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for r in rows:
            n0[r.last, r.prefix], n1[r.last, r.prefix], under[r.last, r.prefix] = r.n0, r.n1, r.pw
        n, pe = n0 + n1, log_kt(n0, n1)
        pw = np.logaddexp(HALF + pe, HALF + under)
        pw[MARK] = pe[MARK]  # the mark starts a segment: nothing stands before it
        w = np.exp(np.minimum(0.0, HALF + pe - pw))
        w[MARK] = 1.0
        kt = (n1 + 0.5) / (n + 1.0)
        m0, m1 = n0.sum(axis=0), n1.sum(axis=0)
        top_pe = log_kt(m0, m1)
        top_w = np.exp(np.minimum(0.0, HALF + top_pe - np.logaddexp(HALF + top_pe, HALF + pw.sum(axis=0))))
        top_kt = (m1 + 0.5) / (m0 + m1 + 1.0)
        seen = n > 0
        self.done = np.where(seen, top_w * top_kt, 0.0)
        self.rest = np.where(seen, 1 - top_w, 1.0)
        self.kt, self.w = np.where(seen, kt, top_kt), np.where(seen, w, top_w)


def _ngram_scores(roots: Roots, depth: int):
    """Log10 probability of each n-gram's byte in its context."""

    def run(batches):
        import pyarrow as pa

        for _, (key, n) in _groups(batches, ["key", "n"]):
            context, length, byte = _split(key)
            last, out = context & 0xFF, np.zeros(len(key))
            for bit in range(8):
                t = Trees(context, length, byte, n, bit, depth)
                state = (a[last, t.prefix] for a in (roots.done, roots.rest, roots.kt, roots.w))
                out += np.log10(t.probabilities(*state))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(out)], names=["key", "lp"])

    return run


def _word_scores(batches):
    """Words of a chunk behind the chunk's n-gram scores: log10 probability of a word with each of its ends."""
    import pyarrow as pa

    keys, values, chunk = None, None, None
    held: list = []
    for b in slices(batches, 20_000):
        at = np.asarray(b.column(CHUNK))
        kind = np.asarray(b.column("kind"))
        edges = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            p = b.slice(lo, hi - lo)
            if at[lo] != chunk:
                chunk, held, keys = at[lo], [], None
            if kind[lo] == 0:
                held.append((np.asarray(p.column("key")), np.asarray(p.column("lp"))))
                continue
            if keys is None:
                keys, values = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
            words = raw(p.column("word"))
            own, number, _ = ngram_keys(words)
            base = np.bincount(number, weights=values[np.searchsorted(keys, own)], minlength=len(words))
            tails = end_contexts(words)
            arrays = [p.column("word")]
            for c, end in zip(COUNTS, ENDS):
                got = np.asarray(p.column(c).is_valid())
                place = np.searchsorted(keys, tails[got] | end)
                full = np.full(len(words), np.nan)
                full[got] = base[got] + values[place]
                arrays.append(pa.array(full, from_pandas=True))
            arrays.append(p.column("c"))
            yield pa.RecordBatch.from_arrays(arrays, names=["word", *[f"s{k}" for k in range(len(ENDS))], "c"])


def segment_scores(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``word, c, s0..s6``: training count of a word and the model's log10 probability of it with each end."""
    # a chunk is a stretch of the word order: its words share most of their n-grams
    words = chunk_by_range(words, ["word"])
    grams = arrow_map(words, _ngrams, f"{CHUNK} bigint, key bigint, n bigint").groupBy(CHUNK, "key").agg(F.sum("n").alias("n"))
    grams = pin(grams)
    length = F.shiftright("key", 48)
    g = F.when(length == 1, F.lit(-1)).otherwise(F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    total = grams.groupBy("key").agg(F.sum("n").alias("n")).withColumn("g", g)
    total = pin(total.repartition("g").sortWithinPartitions("g"))  # one group: the n-grams that end in two given bytes
    sums = arrow_map(total, _summaries(depth), "last bigint, prefix bigint, n0 double, n1 double, pw double").groupBy("last", "prefix").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "pw")])
    roots = Roots(sums.collect())  # at most 256 * 255 rows
    scored = arrow_map(total, _ngram_scores(roots, depth), "key bigint, lp double")
    answers = grams.select(CHUNK, "key").join(scored, "key").select(CHUNK, F.lit(0).alias("kind"), "key", "lp", F.lit(None).cast("binary").alias("word"), *[F.lit(None).cast("bigint").alias(c) for c in [*COUNTS, "c"]])
    asks = words.select(CHUNK, F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("double").alias("lp"), "word", *COUNTS, "c")
    both = answers.unionByName(asks).repartition(CHUNK).sortWithinPartitions(CHUNK, "kind")
    return arrow_map(both, _word_scores, "word binary, " + ", ".join(f"s{k} double" for k in range(len(ENDS))) + ", c bigint")


def _doc_scores(top: dict, base: np.ndarray, model: np.ndarray, known: np.ndarray):
    """Sums over the segments in ``top``, and the others with their counts."""

    def run(batches):
        from collections import Counter
        from itertools import repeat

        import pyarrow as pa

        get = top.get
        for b in slices(batches):
            rows, rest = [], []
            for t in raw(b.column("text")):
                s = segments(t)
                i = np.fromiter(map(get, s, repeat(-1)), np.int64, len(s))
                miss = np.flatnonzero(i < 0)
                i = i[i >= 0]
                blank = sum(len(x) == 1 for x in s)
                rows.append((len(s) - blank + 1, int(known[i].sum()), float(base[i].sum()), float(model[i].sum())))
                c = Counter([s[m] for m in miss.tolist()])
                rest.append([{"word": k[:-1], "last": LAST[k[-1:]], "n": n} for k, n in c.items()])
            cols = list(zip(*rows))
            arrays = [b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64())))]
            arrays.append(pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("last", pa.int32()), ("n", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "k", "b", "m", "rest"])

    return run


def score_texts(docs: DataFrame, folds: int = FOLDS, depth: int = DEPTH, top: int = TOP) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = docs.sparkSession
    counts = word_table(docs, folds)
    c = sum((F.coalesce(F.col(x), F.lit(0)) for x in COUNTS[1:]), F.coalesce(F.col("n0"), F.lit(0)))
    path = scratch_path(spark, "segments")
    segment_scores(counts.withColumn("c", c), depth).write.parquet(path)
    scored = spark.read.parquet(path)
    blank = F.length("word") == 0
    totals = scored.agg(F.sum(F.when(~blank, F.col("c"))), F.count(F.when(~blank & (F.col("c") > 0), 1))).first()
    train_docs = counts_of_end(docs, folds)
    n, v = (totals[0] or 0) + train_docs, totals[1] + (train_docs > 0)
    unit = lambda x: F.log10((x + 0.1) / F.lit(n + 0.1 * (v + 1)))
    per_word = scored.withColumns({"lb": F.when(blank, 0.0).otherwise(unit(F.col("c"))), "known": (~blank & (F.col("c") > 0)).cast("int")})
    many = per_word.orderBy(F.desc("c"), "word").limit(top).toArrow()  # at most ``top`` rows
    index: dict[bytes, int] = {}
    base, model, known = [], [], []
    words, lb, kn = raw(many.column("word")), many.column("lb").to_numpy(), many.column("known").to_numpy()
    for k, end in enumerate(ENDS):
        lp = many.column(f"s{k}").to_numpy()
        some = np.flatnonzero(~np.isnan(lp))
        index.update(zip([words[i] + bytes([end]) for i in some.tolist()], range(len(index), len(index) + len(some))))
        base.append(lb[some])
        model.append(lp[some])
        known.append(kn[some])
    del many, words
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    fn = _doc_scores(index, *(np.concatenate(x) for x in (base, model, known)))
    part = arrow_map(rows, fn, "doc_id bigint, n_tokens bigint, k bigint, b double, m double, rest array<struct<word: binary, last: int, n: int>>")
    path = scratch_path(spark, "scores")
    part.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    part = spark.read.parquet(path)
    rare = part.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    value = F.element_at(F.array(*[F.col(f"s{k}") for k in range(len(ENDS))]), F.col("last") + 1)
    sums = rare.join(per_word, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("known")).alias("k2"), F.sum(F.col("n") * F.col("lb")).alias("b2"), F.sum(F.col("n") * value).alias("m2"))
    end_known, end_base = int(train_docs > 0), float(np.log10((train_docs + 0.1) / (n + 0.1 * (v + 1))))
    out = part.drop("rest").join(sums, "row", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select(
        "doc_id", "n_tokens", (F.col("k") + zero("k2") + end_known).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("b") + zero("b2") + end_base).alias("base_score"), (F.col("m") + zero("m2")).alias("score"),
    )


def counts_of_end(docs: DataFrame, folds: int = FOLDS) -> int:
    """Training documents: each has one end token."""
    from eventloom.llm.common import held_out

    return docs.where(~held_out(F.col("doc_id"), folds)).count()
