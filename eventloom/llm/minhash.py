"""Near-duplicate documents by circulant MinHash.

A document is its set of distinct shingles, each a 64-bit number.  One permutation of the 32-bit universe scatters the
shingles; a second, shifted circularly by k, gives coordinate k of the signature, so two permutations serve all coordinates.
Bands of the signature name candidates and the exact Jaccard similarity of the full sets decides.

No bucket is expanded into pairs.  Each member is compared with the bucket's smallest document; members that are then in one
component need no further test, and in what remains the members outside the bucket's largest component meet all others
inside tasks, which let only pairs through whose signatures allow the threshold.  Every pair of a bucket ends either in one component or tested, so the components equal those of all candidate
pairs.  Equal sets are folded to their smallest document first, so thousands of copies are one node.

Defined cases: a null, empty or blank text has an empty set and links with nothing.  A text of fewer words than a shingle has
one shingle, the whole sequence.  Rows that repeat an id count as one document with several sets.  A null id is listed with
null as its component, kept, and links with nothing.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map, raw, slices, spare
from eventloom.operators.graph import components
from eventloom.session import pin

BANDS, ROWS = 48, 7  # at a similarity of 0.8 a pair misses every band with a chance of 1.2e-5, at 0.3 it shares one with 1 %

FEW = 400  # shingles of a set that is compared whole before its text is fetched
BLOCK = 4096  # members of a bucket that meet in one task

_U64 = np.uint64


def word_numbers(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; a hash is cheaper than a look-up in a table of words seen."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), dtype=_U64, count=len(words))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct shingles of ``n`` words of a text whose A-Z count as a-z; words are parted by ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, _U64)
    h = word_numbers(words)
    n = min(n, len(h))
    s = np.full(len(h) - n + 1, n, dtype=_U64)
    for k in range(n):
        s ^= h[k : len(h) - n + 1 + k]
        s *= _U64(0x9E3779B97F4A7C15)
        s ^= s >> _U64(29)
    s.sort()
    return s[np.append(True, s[1:] != s[:-1])]


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: ``min over x of pi(sigma(x) - k)`` for k below ``size``, all modulo 2**32.

    ``pi`` multiplies, folds and multiplies; its first product is spread over the difference, so a coordinate costs a subtraction,
    a fold, a product and a minimum for every shingle, in two arrays that stay in the processor's cache."""
    first, second, wide = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), 512
    x = (shingles >> _U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    x = _mix(x * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)) * first
    out = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    shift = (np.arange(size, dtype=np.uint32) * first)[:, None]
    for at in range(0, len(x), wide):
        part = x[None, at : at + wide]
        if at == 0 or part.shape[1] < wide:
            y, fold = (np.empty((size, part.shape[1]), dtype=np.uint32) for _ in range(2))
        np.subtract(part, shift, out=y)
        np.right_shift(y, np.uint32(15), out=fold)
        np.bitwise_xor(y, fold, out=y)
        np.multiply(y, second, out=y)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit number per band."""
    s = sig.reshape(bands, rows).astype(_U64)
    key = np.arange(1, bands + 1, dtype=_U64)
    for k in range(rows):
        key = (key ^ s[:, k]) * _U64(0x9E3779B97F4A7C15)
        key ^= key >> _U64(32)
    return key.view(np.int64)


def _sketcher(n: int, bands: int, rows: int) -> Callable:
    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in slices(batches):
            sizes, prints, keys = [], [], []
            for t in raw(b.column("text")):
                s = shingle_set(t, n)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else [])
            arrays = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "print", "bands"])

    return run


def _judge(n: int, threshold: float) -> Callable:
    def run(batches):
        import pyarrow as pa

        last, held = None, None
        for b in slices(batches, 256):
            keep = []
            for left, ta, tb in zip(b.column("a").to_pylist(), raw(b.column("ta")), raw(b.column("tb"))):
                if left != last or held is None:
                    last, held = left, shingle_set(ta, n)
                other = shingle_set(tb, n)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= round(100 * threshold) * (len(held) + len(other) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets reach the threshold; only texts of documents in a pair travel."""
    used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    few = pin(texts.join(used, texts["doc_id"] == used["id"], "left_semi"))
    left = few.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = few.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pin(arrow_map(pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb"), _judge(n, threshold), "a bigint, b bigint").distinct())


def _resketch(n: int, size: int) -> Callable:
    """Per text the low bytes of its signature and, of small sets, the shingles themselves as 32-bit numbers."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            sets = [shingle_set(t, n) for t in raw(b.column("text"))]
            low = [signature(x, size).astype(np.uint8).tobytes() if len(x) else b"" for x in sets]
            few = [x.astype("<u4").tobytes() if len(x) <= FEW else None for x in sets]
            arrays = [b.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(low, pa.binary()), pa.array(few, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["m", "size", "low", "few"])

    return run


def _screen(threshold: float, size: int) -> Callable:
    """Pairs of a bucket's smaller components with its other members that may reach the threshold.

    Signatures discard what is five deviations below it; where both sets are at hand, their intersection decides."""
    least = threshold - 5.5 * (threshold * (1 - threshold) / size) ** 0.5

    def judge(t):
        import pyarrow as pa

        node, c, n, minor = (np.array(t[k].to_pylist()) for k in ("node", "c", "size", "minor"))
        low = np.frombuffer(b"".join(t["low"].to_pylist()), dtype=np.uint8).reshape(len(node), size)
        few = [None if x is None else np.frombuffer(x, dtype="<u4") for x in t["few"].to_pylist()]
        found = []
        for p in np.flatnonzero(minor):
            q = np.flatnonzero(~minor & (c != c[p]) & (n >= threshold * n[p] - 1e-6) & (n[p] >= threshold * n - 1e-6))
            q = q[(low[q] == low[p]).mean(axis=1) >= least]
            for x in q.tolist():
                if few[p] is not None and few[x] is not None:
                    both = len(np.intersect1d(few[p], few[x]))
                    if both < threshold * (n[p] + n[x] - both) - 1e-6:
                        continue
                found.append((min(node[p], node[x]), max(node[p], node[x])))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        import pyarrow as pa

        held, key = [], None
        for b in batches:
            ids = list(zip(*(b.column(k).to_pylist() for k in ("key", "i", "j"))))
            at = 0
            while at < len(ids):
                end = at
                while end < len(ids) and ids[end] == ids[at]:
                    end += 1
                if ids[at] != key and held:
                    yield judge(pa.Table.from_batches(held))
                    held = []
                key = ids[at]
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield judge(pa.Table.from_batches(held))

    return run


def _screened(tagged: DataFrame, texts: DataFrame, shingle: int, threshold: float, size: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` of ``tagged (key, node, c, major)`` to verify.

    A bucket's members outside its largest component meet all its members, inside tasks: both sides are cut into blocks of
    ``BLOCK`` members and every pair of blocks is a unit of its own, so a bucket of any size is spread over the cluster."""
    need = tagged.select(F.col("node").alias("id")).distinct()
    sketch = arrow_map(texts.join(need, texts["doc_id"] == need["id"], "left_semi"), _resketch(shingle, size), "m bigint, size bigint, low binary, few binary").where("size > 0")
    is_minor = F.col("c") != F.col("major")
    counts = tagged.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.ceil(F.count(F.when(is_minor, 1)) / BLOCK).alias("minors"))
    rows = tagged.join(counts, F.col("key") == F.col("k"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    member = rows.select("key", "node", "c", F.explode(upto("minors")).alias("i"), own("blocks").alias("j"), F.lit(False).alias("minor"))
    minor = rows.where(is_minor).select("key", "node", "c", own("minors").alias("i"), F.explode(upto("blocks")).alias("j"), F.lit(True).alias("minor"))
    both = member.unionByName(minor).join(sketch, F.col("node") == F.col("m")).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "node", "c", "minor", "size", "low", "few")
    return arrow_map(both, _screen(threshold, size), "a bigint, b bigint").distinct()


def near_classes(docs: DataFrame, shingle: int = 2, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = pin(arrow_map(texts, _sketcher(shingle, bands, rows), "doc_id bigint, n bigint, print binary, bands array<bigint>"))
    owned = sketch.where("doc_id IS NOT NULL AND n > 0")
    node = owned.groupBy("print").agg(F.min("doc_id").alias("node"))
    # a document with several sets belongs to all their classes, linked below
    members = pin(owned.select("doc_id", "print").distinct().join(node, "print").select("doc_id", "node", "print"))
    chosen = owned.groupBy("print").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("node"), F.min("n").alias("n"))
    spread = chosen.select(F.explode("bands").alias("key"), "node", "n")
    one = F.struct("node", "n")
    shared = spread.groupBy("key").agg(F.min(one).alias("low"), F.max("node").alias("high")).where("low.node < high").select("key", "low")
    bucket = pin(spread.join(shared, "key"))  # members of buckets that hold more than one document

    whole = round(100 * threshold)
    fits = lambda x, y: (x * 100 >= y * whole) & (y * 100 >= x * whole)  # what the set sizes alone allow
    star = bucket.where((F.col("node") > F.col("low.node")) & fits(F.col("n"), F.col("low.n"))).select(F.col("low.node").alias("a"), F.col("node").alias("b")).distinct()
    star = pin(star)
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    links = _verified(star, plain, shingle, threshold)
    linked = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # what stars left open: buckets whose members lie in several components
    named = bucket.join(linked.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left").select("key", "node", "n", F.coalesce("component", "node").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
    named = pin(named.join(mixed, "key"))
    counts = named.groupBy("key", "c").agg(F.count("*").alias("k"))
    major = counts.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("major"))
    tagged = pin(named.join(major, "key"))
    rest = pin(_screened(tagged, plain, shingle, threshold, bands * rows).join(star, ["a", "b"], "left_anti"))
    more = links
    if not rest.isEmpty():
        more = links.union(_verified(rest, plain, shingle, threshold))
    several = members.where("doc_id <> node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
    several = several.join(members.select(F.col("node").alias("src")).distinct(), "src", "left_semi")  # ids that are nodes and members
    edges = more.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(several)
    final = components(edges).withColumnRenamed("node", "m")
    class_of = members.join(final, F.col("node") == F.col("m"), "left").select("doc_id", F.coalesce("component", "node").alias("c")).groupBy("doc_id").agg(F.min("c").alias("c"))
    out = sketch.select("doc_id", "n").join(class_of.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"), "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate class (the smallest id), all columns as they are."""
    (owner,) = spare(docs, "owner")
    kept = near_classes(docs, shingle, threshold).where("kept").select(F.col("doc_id").alias(owner)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(owner)), "left_semi")
