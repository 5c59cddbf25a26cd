"""Importance resampling towards a target corpus: array-scored weights, ranks by a distributed LSD radix sort.

Words are hashed into a fixed number of buckets, counted over all documents and over all target texts.  The gains of the
buckets, the log ratio of both shares, are one array of fixed size that every task holds; a document's weight is the floored
mean of the gains of its features, taken by array look-up.  A Gumbel term drawn from the document's id turns the largest
scores into a sample without replacement.

The drawn documents' ranks come from stable counting passes over the digits of the composite key (score descending, id
ascending), the least digit first.  A pass counts each digit per block of ``BLOCK`` positions, sums the counts over digits and
blocks into the offset of every (digit, block), and moves a row to that offset plus its place among the rows of its digit in
its block: no range is sampled, no row is compared with another block's, and no task holds more than a block.  A digit that
is the same in all keys is left out.

Defined results: a null text is empty; without features the weight is 0; a null id hashes as the empty text and comes after all
ids; rows that share an id are documents of their own, ties among them go to fewer features; an empty table gives no rows, an
empty target only zero counts of it; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map, raw, slices
from eventloom.session import pin

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Positions of a block of the radix sort: the most rows of one digit that a task sorts.
BLOCK_BITS = 18
DIGIT_BITS = 16
MEMO = 300_000  # features whose bucket a worker remembers; more are hashed each time
PIECE = 1 << 20  # bytes of a text that are words at a time

#: A-Z to a-z; ASCII outside letters and digits to blanks; all other bytes are parts of words.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


class Buckets(dict):
    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.n
        if len(self) < MEMO:
            self[feature] = bucket
        return bucket


def word_lists(text: bytes, piece: int = PIECE):
    """Words of a text in lists of about ``piece`` bytes."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + piece)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def bucket_lists(text: bytes, bucket: Buckets, gram: int, piece: int = PIECE):
    """Number of words and buckets of all runs of 1 to ``gram`` words, list by list."""
    before: list[bytes] = []
    for words in word_lists(text, piece):
        found = [bucket[w] for w in words]
        run = before + words
        for g in range(2, gram + 1):
            # runs that end in this list; those within the words before it are counted already
            first = max(len(before) - g + 1, 0)
            found.extend(bucket[b" ".join(run[i : i + g])] for i in range(first, len(run) - g + 1))
        before = run[-(gram - 1) :] if gram > 1 else []
        yield len(words), found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, gram: int = 1) -> list[int]:
    """Features of all ``text`` values per bucket: one dense array a task, summed by bucket; the result has a fixed size."""

    def count(batches):
        import pyarrow as pa

        bucket, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches):
            for text in raw(batch.column(0)):
                for _, found in bucket_lists(text, bucket, gram):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = [0] * buckets
    for r in arrow_map(texts.select("text"), count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(all_counts: list[int], target_counts: list[int]) -> np.ndarray:
    """Floored thousandths of the log ratio of a bucket's smoothed share in the target to that in all documents."""
    n = len(all_counts)
    s_all, t_all = float(sum(all_counts) + n), float(sum(target_counts) + n)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(all_counts, target_counts)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, gram: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""

    def weigh(batches):
        import pyarrow as pa

        bucket = Buckets(len(gain))
        for batch in slices(batches):
            words, features, weight = [], [], []
            for text in raw(batch.column(1)):
                n = m = total = 0
                for some, found in bucket_lists(text, bucket, gram):
                    n, m, total = n + some, m + len(found), total + int(gain[found].sum()) if found else total
                words.append(n)
                features.append(m)
                weight.append(total // m if m else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), weigh, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel draw fixed by the id."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(head, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def counting_pass(state: DataFrame, digit: Column, block_bits: int) -> DataFrame:
    """Positions after one stable pass: by ``digit``, rows of one digit in their order so far."""
    dealt = state.withColumns({"digit": digit, "block": F.shiftright("pos", block_bits)})
    cells = dealt.groupBy("digit", "block").agg(F.count("*").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    # one row per digit, at most 2 ** DIGIT_BITS of them
    starts = cells.groupBy("digit").agg(F.sum("n").alias("m")).select("digit", F.coalesce(F.sum("m").over(before(Window.orderBy("digit"))), none).alias("start"))
    offsets = cells.join(F.broadcast(starts), "digit").select(
        "digit", "block", (F.col("start") + F.coalesce(F.sum("n").over(before(Window.partitionBy("digit").orderBy("block"))), none)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("digit", "block").orderBy("pos"))
    return dealt.withColumn("place", place).join(offsets, ["digit", "block"]).withColumn("pos", F.col("offset") + F.col("place") - 1).select(*state.columns)


def radix_order(df: DataFrame, keys: list[str], digit_bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` with ``pos``, its 0-based place in ascending order of ``keys`` (bigint, none null, the first the most significant).

    ``pos`` in ``df`` holds distinct numbers on the way in, its partitions as high bits; every pass is written to the checkpoint
    folder, so a lost executor costs one pass at most."""
    edges = df.agg(*[F.min(k) for k in keys], *[F.max(k) for k in keys]).first()
    mask = (1 << digit_bits) - 1
    state, passes = df, 0
    for i in reversed(range(len(keys))):
        low, high = edges[i], edges[len(keys) + i]
        if low is None:
            continue
        if high - low < 1 << 63:
            key, width = F.col(keys[i]) - F.lit(low), (high - low).bit_length()
        else:
            # ids of both signs and of full width: with the sign bit turned they are ordered as unsigned numbers
            key, width = F.col(keys[i]).bitwiseXOR(F.lit(-(1 << 63))), 64
        for shift in range(0, width, digit_bits):
            state = pin(counting_pass(state, F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(mask)), block_bits))
            passes += 1
    if not passes:  # at most one key value: any order is the order, but places must be dense
        state = pin(counting_pass(state, F.lit(0).cast("bigint"), block_bits))
    return state


def draw(
    docs: DataFrame, target: DataFrame, gram: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
    digit_bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS,
) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score`` and its ``rank`` from 1 if drawn, else null.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred are drawn, the highest scores first."""
    gain = gains(bucket_counts(docs, buckets, gram), bucket_counts(target, buckets, gram))
    scored = weights(docs, gain, gram).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = pin(scored.withColumn("pos", F.monotonically_increasing_id()))
    enough = F.col("n_words") >= min_words
    keyed = scored.where(enough).select(
        "doc_id", "n_features", "weight", "score", "pos", (-F.col("score")).alias("down"),
        F.col("doc_id").isNull().cast("bigint").alias("last"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"),
    )
    n = keyed.count()
    ranked = radix_order(keyed, ["down", "last", "id", "n_features"], digit_bits, block_bits) if n else keyed
    out = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("pos") < n * percent // 100, F.col("pos") + 1)
    return ranked.select(*out, rank.alias("rank")).unionByName(scored.where(~enough).select(*out, F.lit(None).cast("bigint").alias("rank")))
