"""Toxicity scores by non-negative positive-unlabelled learning.

Documents labelled toxic are the positives; all documents, labelled or not, with their labels hidden, are the unlabelled mixture;
both lie outside the held-out fold.  The class prior is the share of toxic documents among the labelled ones there (or a parameter); labels of
0 serve for that share only and are never negatives.  A linear numpy classifier on word and word-beginning features minimises
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``: where the corrected negative risk turns negative, the step goes back up,
so the classifier cannot fit the positives hidden in the mixture as negatives.  Its penalty is chosen on a quarter of the sample.

Only the fit works on samples, of at most ``max_rows`` positives and ``max_rows`` mixture documents, those whose ids come
first by hash; every whole text is scored, in one map over the documents without a shuffle of texts.  The sample's features are counted on the executors; the driver holds ``width``
feature weights and the sample's sparse rows, both bounded.

Defined cases: a null or empty text has no feature and gets the score of the intercept.  Null labels and null ids are never
trained on.  A document with several labels is toxic if one says so.  Without a positive, or without labels, every score is the
prior (0 without labels).  With every document labelled and sampled the fit is that of plain logistic regression.  Rows that repeat an id are scored one by one; the
fit takes one of them, the text first by hash.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map, held_out, raw, slices

FOLDS = 5
MAX_ROWS = 20_000
BUCKETS = 1 << 20
WIDTH = 4096
PENALTIES = (5e-5, 1e-3, 3e-3, 1e-2)

#: A-Z to a-z, other ASCII than letters and digits to blanks, all else as it is.
FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_set(text: bytes) -> set[bytes]:
    return set(text.translate(FOLD).split())


def buckets_of(word: bytes) -> tuple[int, ...]:
    """Feature numbers of a word: itself and its beginnings of three to eight bytes."""
    return tuple(zlib.crc32(x) % BUCKETS for x in (word, *(bytes([n]) + word[:n] for n in range(3, 9) if len(word) > n)))


def _features(batches):
    import pyarrow as pa

    for b in slices(batches):
        rows = [sorted({f for w in word_set(t) for f in buckets_of(w)}) for t in raw(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("p"), b.column("u"), pa.array(rows, pa.list_(pa.int32()))], names=["p", "u", "f"])


def fit_nnpu(
    rows: list[np.ndarray], positive: np.ndarray, prior: float, width: int, steps: int = 500, rate: float = 0.1, l2: float = 5e-5, mixture: np.ndarray | None = None
) -> np.ndarray:
    """Weights of ``width`` binary features and, last, the intercept.  ``rows``: feature numbers of each sample row; those marked
    ``positive`` are the positives, those marked ``mixture`` (by default all) the unlabelled mixture."""
    lens = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if lens.sum() else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), lens)
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    n = len(rows)
    p = prior * positive / positive.sum()
    u = np.full(n, 1 / n) if mixture is None else mixture / mixture.sum()
    for t in range(1, steps + 1):
        z = np.bincount(doc, weights=w[flat], minlength=n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        cost = np.logaddexp(0, z)  # of calling a row negative; its slope is s
        plus, minus = (s - 1) * p, s * (u - p)
        slope = plus + minus if (cost * (u - p)).sum() >= 0 else -minus
        g = np.append(np.bincount(flat, weights=slope[doc], minlength=width), slope.sum())
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def choose_l2(rows: list[np.ndarray], positive: np.ndarray, mixture: np.ndarray, prior: float, width: int) -> float:
    """The penalty with the least positive-unlabelled error on every fourth sample row, fitted on the others; no label of 0 is used."""
    test = np.arange(len(rows)) % 4 == 3
    if not (test & positive).any() or not (test & mixture).any() or not (~test & positive).any() or not (~test & mixture).any():
        return PENALTIES[0]
    fit = [r for r, t in zip(rows, test) if not t]

    def error(l2):
        w = fit_nnpu(fit, positive[~test], prior, width, steps=200, l2=l2, mixture=mixture[~test])
        called = np.array([w[r].sum() + w[-1] >= 0 for r, t in zip(rows, test) if t])
        found = called[positive[test]].mean()
        return prior * (1 - found) + max(0.0, called[mixture[test]].mean() - prior * found)

    return min(PENALTIES, key=error)


def sampled_ids(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_rows: int = MAX_ROWS) -> tuple[DataFrame, float]:
    """``doc_id, p, u`` of the positives and of the mixture, at most ``max_rows`` each, and the share of toxic labels."""
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)
    marks = labels.select("doc_id", "toxic").where(usable & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    first = lambda ids: ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows narrow rows
    n, n_p = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    positives = first(marks.where("toxic = 1")).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    mixture = first(docs.select("doc_id").where(usable).distinct()).select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    return positives.unionByName(mixture).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u")), n_p / n if n else 0.0


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, max_rows: int = MAX_ROWS, width: int = WIDTH, prior: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """``(feature buckets ascending, weights, intercept)`` learnt from positives and unlabelled texts outside the held-out fold."""
    sample, share = sampled_ids(docs, labels, folds, max_rows)
    prior = share if prior is None else prior
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "p", "u").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("p", "u", "text")  # one row per sampled id
    rows = arrow_map(texts, _features, "p int, u int, f array<int>").persist()
    try:
        n_p, n_u = rows.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0))).first()
        if not n_p or not n_u or not 0 < prior < 1:
            return np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (40.0 if prior > 0 else -40.0)
        counts = rows.select("p", "u", F.explode("f").alias("f")).groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p >= 2")
        lift = F.log((F.col("p") / n_p) / ((F.col("u") + 1) / (n_u + 1)))
        best = counts.where(lift > 0).orderBy(F.desc(F.col("p") * lift), "f").limit(width).select("f")
        keep = np.sort(np.array([r.f for r in best.collect()], dtype=np.int64))
        return _fit_local(arrow_map(rows, _project(keep), "p int, u int, f binary").collect(), keep, prior)
    finally:
        rows.unpersist()


def _project(keep: np.ndarray):
    """Feature buckets to their places in ``keep``, as bytes of 16-bit numbers."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for f in b.column("f").to_pylist():
                a = np.array(f, dtype=np.int64)
                at = np.searchsorted(keep, a)
                out.append(at[(at < len(keep)) & (keep[np.minimum(at, len(keep) - 1)] == a)].astype("<u2").tobytes() if len(keep) else b"")
            yield pa.RecordBatch.from_arrays([b.column("p"), b.column("u"), pa.array(out, pa.binary())], names=["p", "u", "f"])

    return run


def _fit_local(sample, keep: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    found = sorted((r.p, r.u, bytes(r.f)) for r in sample)
    p, u = (np.array([f[k] for f in found]) == 1 for k in (0, 1))
    f = [np.frombuffer(f, dtype="<u2") for *_, f in found]
    l2 = choose_l2(f, p, u, prior, len(keep))
    w = fit_nnpu(f, p, prior, len(keep), l2=l2, mixture=u)
    return keep, w[:-1], float(w[-1])


class Scorer:
    """Scores of texts given as bytes; remembers which features of a word have a weight."""

    def __init__(self, keep: np.ndarray, weights: np.ndarray, intercept: float):
        self.of, self.intercept = dict(zip(keep.tolist(), weights.tolist())), intercept
        self.known: dict[bytes, tuple] = {}

    def __call__(self, texts: list[bytes]) -> list[float]:
        import math

        of, known, out = self.of, self.known, []
        for t in texts:
            found: set[int] = set()
            for w in word_set(t):
                f = known.get(w)
                if f is None:
                    if len(known) > 120_000:
                        known.clear()
                    f = known[w] = tuple(x for x in buckets_of(w) if x in of)
                if f:
                    found.update(f)
            z = self.intercept + math.fsum(of[x] for x in found)
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return out


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``*keys, score`` for every row of ``docs``: the estimated probability that the text is toxic."""
    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    types = dict(docs.dtypes)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(*model)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(scorer(raw(b.column("text"))), pa.float64())], names=[*keys, "score"])

    return arrow_map(rows, run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", score double")


def predicted(score: Column) -> Column:
    return (score >= 0.5).cast("int")


def drop_toxic(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``docs`` without the rows the classifier calls toxic; all columns as they are, texts never shuffled."""
    model = train(docs, labels, folds)

    def keep(batches):
        import pyarrow as pa

        scorer = Scorer(*model)
        for b in slices(batches):
            yield b.filter(pa.array([s < 0.5 for s in scorer(raw(b.column("text")))], pa.bool_()))

    return arrow_map(docs, keep, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
