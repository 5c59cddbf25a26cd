"""Token ids in a byte-aligned variable-length file.

Ids are replaced by their rank in corpus frequency, so frequent ids are small numbers, and written with one to four bytes each.
Lengths stand apart, two bits each, four to a control byte; the reader turns control bytes into lengths and places by table
lookup and gathers all bytes of a block at once.

The file is a Parquet table of blocks in document order, a folder ``blocks`` beside a folder ``ranks`` (rank to id, the size of
the vocabulary).  A block holds whole documents: ``part, block, first_token, doc_ids, lengths, control, data``, with
``first_token`` counted within its part; a part is one range of ids.  Where a part begins follows from the parts' totals, one row each.

Defined cases: a null or empty text is its end token alone.  Null ids come first.  Rows that repeat an id are separate documents,
ordered by a hash of the text.  An empty table gives an empty file and no rows.
"""

from __future__ import annotations


import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map, binary_column, byte_bpe, flat, sized, word_tokenizer

END_ID = 0
BLOCK_TOKENS = 1 << 18

#: For each control byte the lengths of its four numbers.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack_numbers(x: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers; the last control byte is filled up with zeros' lengths."""
    x = x.astype("<u4")
    size = 1 + (x > 0xFF).astype(np.uint8) + (x > 0xFFFF) + (x > 0xFFFFFF)
    codes = np.zeros(-(-len(x) // 4) * 4, dtype=np.uint8)
    codes[: len(x)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    used = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.tobytes(), x.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` numbers."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    used = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[used] = np.frombuffer(data, dtype=np.uint8)
    return out.view("<u4").reshape(-1)


def _tokens(path: str, kind: str):
    def run(batches):
        import pyarrow as pa

        tokenizer, part, at = word_tokenizer(path), TaskContext.get().partitionId(), 0
        for b in sized(batches, 1):
            ids, ends = tokenizer.encode_column(b.column("text"))
            ids = np.insert(ids, ends, np.uint32(END_ID)).astype(kind)
            n = np.diff(ends, prepend=0) + 1
            before = at + np.cumsum(n) - n
            at += len(ids)
            cols = [b.column("doc_id"), pa.array(np.full(len(n), part)), pa.array(before), pa.array(n), binary_column(ids, np.cumsum(n))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "before", "n", "ids"])

    return run


def _counts(kind: str):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for b in sized(batches, 0):
            c = np.bincount(flat(b.column("ids"))[0].view(kind))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return run


def _blocks(ids_by_rank: np.ndarray, block_tokens: int, kind: str):
    def run(batches):
        import pyarrow as pa

        rank = np.zeros(int(ids_by_rank.max(initial=0)) + 1, dtype=np.uint32)
        rank[ids_by_rank] = np.arange(len(ids_by_rank))
        names = ["part", "first_token", "doc_ids", "lengths", "control", "data"]
        docs, lens, held, size, part, first = [], [], [], 0, None, 0

        def write():
            control, data = pack_numbers(rank[np.concatenate(held)])
            arrays = [pa.array([part]), pa.array([first]), pa.array([docs], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for b in sized(batches, 4, 1 << 22):
            ids = flat(b.column("ids"))[0].view(kind)
            doc_ids, parts, before, n = (b.column(c).to_pylist() for c in ("doc_id", "part", "before", "n"))
            # documents from ``low`` on, tokens from ``at`` on are not in a block yet
            low = at = end = 0
            for i in range(len(n) + 1):
                last = i == len(n)
                full = size + end - at >= block_tokens
                moved = not last and (parts[i] != part or before[i] != first + size + end - at)
                if last or full or moved:
                    if i > low:
                        docs += doc_ids[low:i]
                        lens += n[low:i]
                        held.append(ids[at:end].copy())
                        size += end - at
                    low, at = i, end
                    if held and (full or moved):
                        yield write()
                        docs, lens, held, size = [], [], [], 0
                    if not held and not last:
                        part, first = parts[i], before[i]
                if not last:
                    end += n[i]
        if held:
            yield write()

    return run


def write_tokens(docs: DataFrame, path: str, scratch: str, tokenizer: str | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the texts of ``docs`` to ``path`` in ascending id order; ``scratch`` keeps the plain ids between the two passes."""
    spark = docs.sparkSession
    placed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    schema = "doc_id bigint, part bigint, before bigint, n bigint, ids binary"
    path_of, spell = tokenizer or byte_bpe(), "<u4"
    if word_tokenizer(path_of).library.get_vocab_size() <= 1 << 16:
        spell = "<u2"  # ids of a small vocabulary between the passes
    arrow_map(placed, _tokens(path_of, spell), schema).write.option("compression", "zstd").parquet(scratch)
    plain = spark.read.parquet(scratch)
    freq = arrow_map(plain.select("ids"), _counts(spell), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    order = freq.orderBy(F.desc("n"), "id").toArrow()  # the vocabulary at most
    ids = order.column("id").to_numpy().astype(np.int64)
    ranks = spark.createDataFrame(list(enumerate(ids.tolist())), "rank bigint, id bigint")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    arrow_map(plain, _blocks(ids, block_tokens, spell), "part bigint, first_token bigint, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")


def _reader(ids_by_rank: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):
                b = batch.slice(at, 1)
                part, first = b.column("part")[0].as_py(), b.column("first_token")[0].as_py()
                docs, lens = b.column("doc_ids").flatten(), b.column("lengths").flatten().to_numpy()
                ids = ids_by_rank[unpack_numbers(b.column("control")[0].as_py(), b.column("data")[0].as_py(), int(lens.sum()))].astype("<u4")
                ends = np.cumsum(lens)
                cols = [docs, pa.array(np.full(len(lens), part)), pa.array(first + ends - lens), pa.array(lens), binary_column(ids, ends)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "start", "n_tokens", "ids"])

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file: ``doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)``."""
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").toArrow()  # the vocabulary at most
    ids = ranks.column("id").to_numpy().astype(np.uint32)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.max(F.col("first_token") + F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = arrow_map(blocks, _reader(ids), "doc_id bigint, part bigint, start bigint, n_tokens bigint, ids binary")
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


