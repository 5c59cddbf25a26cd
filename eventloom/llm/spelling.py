"""Spelling variants: exact neighbours at one edit by pairs of trie nodes.

Words are numbered in code-point order.  Every distinct prefix of a word is a node of the forward trie and gets an integer,
every distinct suffix one of the trie of the reversed words: in sorted order a word shares with the word before it the nodes
of their common prefix and opens one new node per code point beyond it, so one pass over sorted ranges numbers a whole trie.
The last path of a range is the only state the next one needs; ranges are numbered apart and then agree on the nodes they
share.  A word of length L gives, by two integers each,

* L *skips*: (prefix node before position i, suffix node after it), and
* L + 1 *splits*: (prefix node before a gap, suffix node behind it), which spell the word itself.

Words with a skip in common differ by one replaced code point at that position.  A skip of a longer word that is a split of
a shorter one is an inserted or deleted code point; of the equal code points of a run only the first one's skip counts, so
each neighbour is met once.  A group of one pair holds at most one split word and one word per letter of the alphabet, so
counts and the most frequent neighbour are read off the group's order, and no pairs are formed.

Defined results: a null text has no words; a null id hashes as the empty text; rows that share an id count each; words of any
length are whole (their nodes are linear in the length); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map, raw, slices
from eventloom.operators.joins import salted_join
from eventloom.session import pin

DROPPED = 97
MIN_LENGTH = 5
MIN_COUNT = 3
FACTOR = 2
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
PIECE = 1 << 20

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Ranges are told apart in a node's high bits.
RANGE_BITS = 40


def runs(text: str, piece: int = PIECE):
    """Letter runs of a text in lists of about ``piece`` code points."""
    at = 0
    while at < len(text):
        end = at + piece
        while end < len(text) and RUN.match(text, end):
            end = RUN.match(text, end).end()  # a run over the edge stays whole
        yield RUN.findall(text, at, end)
        at = end


def word_counts(docs: DataFrame, dropped: int = DROPPED) -> DataFrame:
    """``word, n`` over all texts; of about one in ``dropped`` (document, run) one code point is deleted, as their crc32 says."""

    def count(batches):
        import pyarrow as pa

        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                for found in runs(text.translate(LOWER).decode()):
                    here = Counter(found)
                    for w in [w for w in here if not zlib.crc32(w.encode(), start) % dropped]:
                        n, at = here.pop(w), zlib.crc32(w.encode(), start) % len(w)
                        total[w[:at] + w[at + 1 :]] += n
                    total.update(here)
                    if len(total) > HELD:
                        yield flush()
        if total:
            yield flush()

    return arrow_map(docs.select("doc_id", "text"), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """``words`` pinned in ranges of ascending ``word``, with ``no`` ascending along them."""
    return pin(words.repartitionByRange("word").sortWithinPartitions("word").withColumn("no", F.monotonically_increasing_id()))


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def trie_paths(sorted_words: DataFrame) -> DataFrame:
    """``no, path`` of words sorted as by ``numbered``: the numbers of the trie nodes of all their prefixes, shortest first."""

    def walk(batches):
        import pyarrow as pa

        last, path, nodes = "", [], 0
        for batch in slices(batches):
            paths = []
            for word in batch.column(1).to_pylist():
                keep = shared(last, word)
                new = len(word) - keep
                path = path[:keep] + list(range(nodes + 1, nodes + new + 1))
                last, nodes = word, nodes + new
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.list_(pa.int64()))], ["no", "word", "path"])

    walked = pin(arrow_map(sorted_words.select("no", "word"), walk, "no bigint, word string, path array<bigint>"))
    part = F.shiftright("no", 33)
    # one row per range: its first word, and its last one with the nodes of its path
    edges = walked.groupBy(part.alias("part")).agg(F.min_by("word", "no").alias("first"), F.max_by(F.struct("word", "path"), "no").alias("last")).orderBy("part").collect()
    alias: dict[int, list[int]] = {}  # the nodes of a range's first word that an earlier range has numbered
    before, carried = "", []
    for e in edges:
        own = alias[e.part] = carried[: shared(before, e.first)]
        before, carried = e.last.word, [own[x - 1] if x <= len(own) else (e.part << RANGE_BITS) + x for x in e.last.path]
    spark = sorted_words.sparkSession
    rows = [(p, a) for p, a in alias.items()]
    table = F.broadcast(spark.createDataFrame(rows, "part bigint, own array<bigint>"))
    # the first word of a range opens its nodes 1, 2, ... along its path
    real = F.transform("path", lambda x: F.when(x <= F.size("own"), F.get("own", (x - 1).cast("int"))).otherwise(F.shiftleft("part", RANGE_BITS) + x))
    return walked.withColumn("part", part).join(table, "part").select("no", real.alias("path"))


def neighbours(words: DataFrame) -> DataFrame:
    """``no, n_near, near_n, near_no`` of numbered ``words``: how many are one edit away, and the most frequent of them (ties: smallest
    ``no``); words without one are missing."""
    forward = trie_paths(words)
    reversed_words = numbered(words.select(F.reverse("word").alias("word"), F.col("no").alias("of")))
    backward = trie_paths(reversed_words).join(reversed_words.select("no", "of"), "no").select(F.col("of").alias("no"), F.col("path").alias("back"))
    both = words.select("no", "n", F.split("word", "").alias("c")).join(forward, "no").join(backward, "no")
    size = F.size("path")
    node = lambda path, length: F.when(length > 0, F.get(path, length - 1)).otherwise(0)
    # entry 2 i: the split at gap i; entry 2 i + 1: the skip of position i
    at = F.explode(F.sequence(F.lit(0), 2 * size)).alias("e")
    entries = both.select("no", "n", "c", "path", "back", at)
    i, skip = F.shiftright("e", 1), F.col("e").bitwiseAND(F.lit(1)) == 1
    tail = size - i - skip.cast("int")
    # of a run of equal code points, the skip of the first one stands for all
    opens = skip & ((i == 0) | (F.get("c", i) != F.get("c", F.greatest(i - 1, F.lit(0)))))
    pairs = entries.select(
        node(F.col("path"), i).alias("p"), node(F.col("back"), tail).alias("s"), "no", "n",
        F.when(opens, 2).when(skip, 1).otherwise(0).cast("tinyint").alias("kind"),
    )
    group = Window.partitionBy("p", "s")
    is_skip, is_open = F.col("kind") > 0, F.col("kind") == 2
    pick = lambda cond: F.when(cond, F.struct(F.col("n").alias("n"), (-F.col("no")).alias("no")))
    # the two largest skips, the largest open skip and the split word of a group of at most the alphabet's size
    ranked = pairs.withColumn("size", F.count("*").over(group)).where("size > 1")
    best = F.max(pick(is_skip)).over(group)
    place = F.row_number().over(group.orderBy(is_skip.desc(), F.col("n").desc(), "no"))
    ranked = ranked.withColumns({
        "skips": F.count_if(is_skip).over(group), "opens": F.count_if(is_open).over(group), "best": best, "open": F.max(pick(is_open)).over(group),
        "split": F.max(pick(F.col("kind") == 0)).over(group), "place": place,
    })
    ranked = ranked.withColumn("second", F.max(F.when(is_skip & (F.col("place") == 2), F.struct("n", (-F.col("no")).alias("no")))).over(group))
    other = F.when(F.col("place") == 1, F.col("second")).otherwise(F.col("best"))
    met = ranked.select(
        "no",
        F.when(is_skip, F.col("skips") - 1 + F.when(is_open & F.col("split").isNotNull(), 1).otherwise(0)).otherwise(F.col("opens")).alias("met"),
        F.when(is_skip, F.greatest(other, F.when(is_open, F.col("split")))).otherwise(F.col("open")).alias("top"),
    )
    return met.where("met > 0").groupBy("no").agg(F.sum("met").alias("n_near"), F.max("top").alias("top")).select(
        "no", "n_near", F.col("top.n").alias("near_n"), (-F.col("top.no")).alias("near_no")
    )


def roots(links: DataFrame, steps: int) -> DataFrame:
    """``no, root_no`` at the end of the chains ``no -> near_no`` of at most ``steps`` links, by doubling."""
    hops = links.select("no", F.col("near_no").alias("root_no"))
    for _ in range(max(steps - 1, 0).bit_length()):
        on = hops.select(F.col("no").alias("root_no"), F.col("root_no").alias("beyond"))
        hops = pin(salted_join(hops, on, ["root_no"], "left").select("no", F.coalesce("beyond", "root_no").alias("root_no")))
    return hops


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR, dropped: int = DROPPED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of at least ``min_length`` code points that occurs ``min_count`` times.

    A word's form is its most frequent neighbour if that is at least ``factor`` (2 or more) times as frequent."""
    words = numbered(word_counts(docs, dropped).where((F.length("word") >= min_length) & (F.col("n") >= min_count)))
    near = pin(neighbours(words))
    links = words.join(near, "no").where(F.col("near_n") >= factor * F.col("n")).select("no", "near_no", "near_n")
    top = words.agg(F.max("n"), F.min("n")).first()
    # counts grow by the factor with each link
    steps = int(math.log(top[0] / top[1], factor)) + 1 if top[0] else 0
    ends = links.join(roots(links, steps), "no")
    named = lambda no, name: words.select(F.col("no").alias(no), F.col("word").alias(name))
    ends = salted_join(ends, named("near_no", "form"), ["near_no"])
    ends = salted_join(ends, named("root_no", "root"), ["root_no"]).select("no", "form", "root", F.col("near_n").alias("form_n"))
    out = words.join(near.select("no", "n_near"), "no", "left").join(ends, "no", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
