"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
BATCH_ROWS = 2_000
ROOT = str(Path(__file__).resolve().parents[2])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package from any working folder.

    Lowers the session's rows per Arrow batch to ``BATCH_ROWS`` where it is higher."""
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    # whole texts travel: smaller batches than the default keep the buffers on both sides small
    if int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def spare(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches, rows: int = 512):
    """Small pieces of Arrow batches, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized(batches, column: int, size: int = 3 << 20):
    """Pieces of Arrow batches whose texts in ``column`` are together about ``size`` bytes at most, or one row if that has more."""
    for batch in batches:
        ends = flat(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            end = max(int(np.searchsorted(ends, ends[at] + size, "right")) - 1, at + 1)
            yield batch.slice(at, end - at)
            at = end


def raw(column) -> list:
    """An Arrow string column as a list of UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def crc32_of(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def held_out(doc_id: Column, folds: int) -> Column:
    """True for rows whose crc32 of the id as text is divisible by ``folds``; a null id is never held out."""
    return F.coalesce(F.pmod(crc32_of(doc_id), F.lit(folds)) == 0, F.lit(False))


def is_held_out(doc_id, folds: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


#: Classes of the bytes of ASCII and Latin-1 letters: blank, other white space, letter, digit, any other sign.
BLANK, WHITE, LETTER, DIGIT, SIGN = range(5)
CLASSES = np.array(
    [BLANK if c == 32 else WHITE if 9 <= c <= 13 else DIGIT if 48 <= c <= 57 else LETTER if c >= 128 or chr(c).isalpha() else SIGN for c in range(256)],
    dtype=np.uint8,
)
#: Lead bytes of characters outside ASCII and U+00C0 to U+00FF.
FOREIGN = np.array([c >= 0xC2 and c != 0xC3 for c in range(256)])


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of an Arrow string or binary column, and the offsets of its values in them; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def binary_column(values: np.ndarray, ends: np.ndarray):
    """An Arrow binary column whose values lie one after another in the array ``values`` and end at its elements ``ends``."""
    import pyarrow as pa

    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    whole = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return whole.cast(pa.binary())


@contextmanager
def paused_gc():
    """Many small containers live at once here and none is part of a cycle."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class WordTokenizer:
    """Byte-level BPE of the tokenizers library with a memo of pre-tokens.

    Byte-level BPE never merges across the pre-tokens its pattern cuts, so the ids of a text are the ids of its pre-tokens one
    after another.  Texts of ASCII and Latin-1 letters are cut by array comparisons of neighbouring bytes' classes, all texts of a
    batch at once; Arrow reduces a batch's pre-tokens to its distinct ones, the memo and the library see only those, and the
    ids are gathered by offsets.  Texts made of other characters up to U+024F, whose classes no Unicode version changed, are
    cut by the pattern; any other text goes to the library whole, as does a text that holds an added token such as
    ``<|endoftext|>``, which the library finds before it cuts.
    """

    LIMIT = 400_000  # pre-tokens of the memo; beyond it those met in one batch only go, which changes nothing but speed
    CHUNK = 1_000_000  # pre-tokens whose ids are gathered at a time

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        # a byte-level token spells each of its bytes as one character
        self.width = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())], dtype=np.int64)
        space = r"\t-\r \x85\xa0"
        self.cut = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.low = regex.compile("[\x00-\u024f]*").fullmatch
        self.place: dict[bytes, int] = {}  # number of a pre-token in the arrays below
        self.ids = np.zeros(0, np.uint32)
        self.first = self.count = self.hits = np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def encode_all(self, texts: list) -> list[bytes]:
        """Ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        import pyarrow as pa

        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        cuts = [0, *ends.tolist()]
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string column one after another, and where each text's ids end; null is empty."""
        data, offsets = flat(column)
        rows = len(offsets) - 1
        odd = np.zeros(rows, dtype=bool)
        odd[np.searchsorted(offsets, np.flatnonzero(FOREIGN[data]), "right") - 1] = True
        for mark in self.added:
            if data.tobytes().find(mark.encode()) >= 0:
                odd |= np.array([mark in (t or "") for t in column.to_pylist()], dtype=bool)
        starts = np.flatnonzero(pre_token_starts(data, offsets))
        edges = np.append(starts, len(data))
        of_row = np.searchsorted(starts, offsets)
        counts = np.zeros(len(starts) + 1, np.int64)
        parts = []
        with paused_gc():
            for at in range(0, len(starts), self.CHUNK):
                some = edges[at : at + self.CHUNK + 1]
                ids, n = self.look_up(data, some, self.usable(odd, of_row, at, len(some) - 1))
                parts.append(ids)
                counts[at + 1 : at + len(some)] = n
        ids = np.concatenate(parts) if len(parts) != 1 else parts[0] if parts else np.zeros(0, np.uint32)
        ends = np.cumsum(counts)[of_row]
        if not odd.any():
            return ids, ends[1:]
        pieces, sizes = [], np.diff(ends)
        for r in range(rows):
            if odd[r]:
                own = self.special(column[r].as_py())
                sizes[r] = len(own)
                pieces.append(own)
            else:
                pieces.append(ids[ends[r] : ends[r + 1]])
        return np.concatenate(pieces), np.cumsum(sizes)

    @staticmethod
    def usable(odd: np.ndarray, of_row: np.ndarray, at: int, n: int) -> np.ndarray | None:
        """Which of the pre-tokens ``at`` to ``at + n`` lie in texts cut by bytes; None for all of them."""
        if not odd.any():
            return None
        return ~np.repeat(odd, np.diff(of_row))[at : at + n]

    def look_up(self, data: np.ndarray, edges: np.ndarray, usable: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens between ``edges``, and how many each has; none for those not usable."""
        import pyarrow as pa

        n = len(edges) - 1
        low = edges[0] if n else 0
        spans = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((edges - low).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[low : edges[-1]]))])
        if usable is not None:
            spans = spans.filter(pa.array(usable))
        coded = spans.dictionary_encode()
        place = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        found = self.count[place]
        ids = self.gather(place, found)
        if usable is None:
            return ids, found
        counts = np.zeros(n, np.int64)
        counts[usable] = found
        return ids, counts

    def gather(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.first[place] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]

    def places(self, tokens: list[bytes]) -> np.ndarray:
        """Numbers of distinct pre-tokens; those not met before are learnt."""
        if len(self.place) > self.LIMIT:
            self.forget()
        get = self.place.get
        found = list(map(get, tokens))
        if None in found:
            self.learn([t for t, f in zip(tokens, found) if f is None])
            found = list(map(get, tokens))
        out = np.array(found, dtype=np.int64)
        self.hits[out] += 1
        return out

    def forget(self) -> None:
        """Keep pre-tokens met again since the last time, or none if those are too many."""
        keep = self.hits > 1
        if keep.sum() > self.LIMIT // 2:
            keep[:] = False
        old = np.flatnonzero(keep)
        new = np.cumsum(keep) - 1
        self.place = {t: int(new[i]) for t, i in self.place.items() if keep[i]}
        count = self.count[old]
        self.ids = self.gather(old, count)
        self.count, self.hits = count, np.zeros(len(old), np.int64)
        self.first = np.cumsum(count) - count

    def learn(self, tokens: list[bytes]) -> None:
        """Add pre-tokens to the memo.  All but white space go to the library as one text: those with a blank first one after another,
        before each of the others a line end; where each one's ids end follows from the bytes they stand for."""
        alone = [t for t in tokens if not t.decode().strip()]
        lone = set(alone)
        joined = [t for t in tokens if t[0] == 32 and t not in lone]
        lined = [t for t in tokens if t[0] != 32 and t not in lone]
        order, ids, count = joined + lined + alone, [], []
        if joined or lined:
            text = b"".join(joined) + b"".join([b"\n" + t for t in lined])
            found = np.array(self.library.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            width = np.fromiter(map(len, joined + lined), np.int64, len(joined) + len(lined))
            ends = np.cumsum(width)
            ends[len(joined) :] += np.arange(1, len(lined) + 1)
            at = np.concatenate([[0], np.cumsum(self.width[found])])
            first, last = np.searchsorted(at, ends - width), np.searchsorted(at, ends)
            if not (np.array_equal(at[first], ends - width) and np.array_equal(at[last], ends)):
                raise ValueError("the tokenizer's ids do not end where its pre-tokens do")
            ids.append(np.delete(found, first[len(joined) :] - 1))
            count.append(last - first)
        for t in alone:
            ids.append(self.whole(t.decode()))
            count.append(np.array([len(ids[-1])]))
        n = len(self.count)
        self.place.update(zip(order, range(n, n + len(order))))
        self.ids = np.concatenate([self.ids, *ids])
        self.count = np.concatenate([self.count, *count]).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.hits = np.concatenate([self.hits, np.zeros(len(order), np.int64)])

    def special(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(a in text for a in self.added) or not self.low(text):
            return self.whole(text)
        cut = [p.encode() for p in self.cut(text)]
        distinct = list(dict.fromkeys(cut))
        number = dict(zip(distinct, self.places(distinct).tolist()))
        place = np.array([number[p] for p in cut], dtype=np.int64)
        return self.gather(place, self.count[place])


def pre_token_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts of ASCII and Latin-1 letters begin.

    A sign run, letter run or digit run takes one blank before it; of white space before other signs the last character stands
    apart from the rest; an apostrophe that no sign or blank precedes takes the ending of a contraction with it."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=bool)
    kind = CLASSES[data]
    times = np.flatnonzero(data == 0xC3)  # the two signs among the Latin-1 letters
    times = times[np.isin(data[np.minimum(times + 1, n - 1)], (0x97, 0xB7))]
    kind[times], kind[np.minimum(times + 1, n - 1)] = SIGN, SIGN
    white = kind <= WHITE
    begin = np.zeros(n + 1, dtype=bool)
    begin[offsets[:-1]] = True
    starts = begin[:n].copy()
    before, here = white[:-1], white[1:]
    starts[1:] |= np.where(here, ~before, np.where(before, kind[:-1] == WHITE, kind[1:] != kind[:-1]))
    starts[:-1] |= before & ~here & ~begin[1:n]
    marks = np.flatnonzero(data == 39)
    marks = marks[starts[marks]]
    if len(marks):
        end = offsets[np.searchsorted(offsets, marks, "right")]
        near = lambda k: np.where(marks + k < end, data[np.minimum(marks + k, n - 1)], 0)
        one, two = near(1), near(2)
        short = np.isin(one, list(b"stmd"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        marks, size = marks[short | long], np.where(short, 2, 3)[short | long]
        starts[marks + 1] = False
        after = marks + size
        starts[after[after < n]] = True
    return starts


def byte_bpe() -> str:
    """Place of the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
