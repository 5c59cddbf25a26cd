"""Packing documents into fixed windows by order-preserving dynamic programming.

The token stream of a partition, in document order, is cut into sequences of at most ``capacity`` tokens.  Cuts may fall at
document ends (free), sentence ends (``sentence_cost``) and, where sentences are long, inside them (``inner_cost``); a
sequence costs its padding (none when its length is a power of two from 64 on) plus ``sequence_cost``.  The cheapest series of cuts is a
shortest path whose transitions read a sliding-window minimum, kept in a monotone queue.

Range partitions follow the document order and are worked through in windows of ``window`` tokens; the last, open sequence
of a window starts the next, so memory holds one window (or the largest document).  A piece is a row; each token is in one.

Defined cases: a null or empty text is its end token alone.  Null ids come first.  Rows that repeat an id are separate
documents, ordered by a hash of the text; rows repeated whole are interchangeable.  An empty table gives no piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map, byte_bpe, sized, word_tokenizer

CAPACITY = 1024
END_ID = 0


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, grain: int, sentence_cost: float, inner_cost: float) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts ``(position, cost)``, ascending, from 0 to the end: document ends, one sentence end per ``grain`` tokens at
    most, and every ``grain`` tokens where neither comes for four of them."""
    s = np.flatnonzero(sentence[ids]) + 1
    s = s[np.flatnonzero(np.diff(s // grain, prepend=-1))]
    cost = {"doc": 0.0, "sentence": sentence_cost, "inner": inner_cost}
    near = np.unique(np.concatenate([[0], s, doc_ends]))
    wide = np.flatnonzero(np.diff(near) > 4 * grain)
    inner = [np.arange(near[w] + grain, near[w + 1], grain) for w in wide]
    pos = np.unique(np.concatenate([near, *inner])).astype(np.int64)
    pen = np.full(len(pos), cost["inner"])
    pen[np.searchsorted(pos, s)] = cost["sentence"]
    pen[np.searchsorted(pos, doc_ends)] = cost["doc"]
    return pos, pen


def best_cuts(pos: np.ndarray, pen: np.ndarray, capacity: int, sequence_cost: float, shortest: int = 64) -> list[int]:
    """Positions of the cheapest cuts, first and last included; unpadded powers of two are used from ``shortest`` tokens on."""
    m = len(pos) - 1
    exact: dict[int, list[int]] = {}
    k = shortest
    while k < capacity:
        i = np.searchsorted(pos, pos - k)
        for j in np.flatnonzero((pos[np.minimum(i, m)] == pos - k) & (pos >= k)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
        k *= 2
    p, c = pos.tolist(), (pen + sequence_cost).tolist()
    best, came = [0.0] * (m + 1), [0] * (m + 1)
    queue, value, head = [0] * (m + 1), [0.0] * (m + 1), 0
    tail = 0  # the queue is queue[head:tail], values ascending
    for j in range(1, m + 1):
        v = best[j - 1] + p[j - 1]
        while tail > head and value[tail - 1] > v:
            tail -= 1
        queue[tail], value[tail] = j - 1, v
        tail += 1
        at = p[j]
        while p[queue[head]] < at - capacity:
            head += 1
        low, frm = value[head] + capacity - at, queue[head]
        if j in exact:
            for i in exact[j]:
                if best[i] < low:
                    low, frm = best[i], i
        best[j], came[j] = low + c[j], frm
    cuts, j = [p[m]], m
    while j:
        j = came[j]
        cuts.append(p[j])
    return cuts[::-1]


@lru_cache(maxsize=4)
def sentence_ends(path: str) -> np.ndarray:
    """For each id, whether its token ends a sentence or a line."""
    library = word_tokenizer(path).library
    n = library.get_vocab_size()
    return np.array([str(t).rstrip("\"')").endswith((".", "!", "?", "Ċ")) for t in (library.id_to_token(i) or "" for i in range(n))])


def _packer(path: str, capacity: int, window: int, grain: int, sentence_cost: float, inner_cost: float, sequence_cost: float):
    def run(batches):
        import pyarrow as pa

        tokenizer, sentence, number = word_tokenizer(path), sentence_ends(path), TaskContext.get().partitionId() << 32
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        held, size = [], 0  # (doc_id, doc_tokens, start, ids) not yet in a closed sequence

        def close(last: bool):
            nonlocal held, size, number
            ids, ends = np.concatenate([h[3] for h in held]), np.cumsum([len(h[3]) for h in held])
            cuts = best_cuts(*cut_points(ids, ends, sentence, grain, sentence_cost, inner_cost), capacity, sequence_cost)
            rows, rest, stop = [], [], cuts[-1] if last else cuts[-2]
            edges = np.unique(np.concatenate([cuts, ends])).tolist()
            doc, seq, lo = 0, 0, 0
            for hi in edges[1:] if edges[0] == 0 else edges:
                while ends[doc] <= lo:
                    doc += 1
                while cuts[seq + 1] <= lo:
                    seq += 1
                doc_id, total, start, own = held[doc]
                first = int(ends[doc]) - len(own)
                part = own[lo - first : hi - first]
                if lo >= stop:
                    rest.append((doc_id, total, start + lo - first, part))
                else:
                    rows.append((doc_id, start + lo - first, hi - lo, part.tobytes(), total, number + seq, lo - cuts[seq]))
                lo = hi
            number += len(cuts) - 1 if last else len(cuts) - 2
            held, size = rest, sum(len(r[3]) for r in rest)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[at : at + 4096]), kinds)], names=names)

        for b in sized(batches, 1):
            ids, ends = tokenizer.encode_column(b.column("text"))
            ids = np.insert(ids, ends, np.uint32(END_ID)).astype("<u4")
            ends = (ends + np.arange(1, len(ends) + 1)).tolist()
            for doc_id, first, end in zip(b.column("doc_id").to_pylist(), [0, *ends], ends):
                held.append((doc_id, end - first, 0, ids[first:end].copy()))
                size += end - first
                if size >= window:
                    yield from close(False)
        if held:
            yield from close(True)

    return run


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, window: int = 1 << 18, grain: int = 16,
    sentence_cost: float = 4.0, inner_cost: float = 16.0, sequence_cost: float = 32.0,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset``.

    ``sequence_id`` ascends with the document order; it counts up within a partition.  The one shuffle is the range
    partitioning by id.
    """
    placed = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return arrow_map(placed, _packer(tokenizer or byte_bpe(), capacity, window, grain, sentence_cost, inner_cost, sequence_cost), schema)
