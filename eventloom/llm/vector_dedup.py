"""Near-duplicate vectors by rotated binary codes with correction factors.

Unit vectors are turned by fixed random rotations; the signs of the turned coordinates are the code.  A code and its correction
factor (the cosine of the code and the vector it stands for) give an unbiased estimate of an inner product and a bound on its
error.  Runs of code bits name buckets: pairs that share one are candidates, the estimate's upper bound decides which of them
are recomputed exactly, in double precision, and only exact values make links.

A pair is judged in the first bucket it shares, so nothing is counted twice.  Each bucket returns link counts per vector and a
spanning forest of its links, never the pairs.  Equal vectors are folded to the smallest id first.  A bucket of more than
``block`` vectors is cut into blocks and every pair of blocks is a unit of its own, spread over the cluster.

Defined cases: vectors with a null label, that are null, empty or zero, or hold null or non-finite components link with
nothing, nor do vectors of different length.  A null id is listed as its own component and kept.  Rows that repeat an id are separate
vectors, and share the component if either links.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_map
from eventloom.operators.graph import components
from eventloom.session import pin

MISS = 1e-5  # chance that a pair at the threshold shares no bucket
BUCKET = 64  # wanted vectors in a bucket
SIGMAS = 5.0  # width of the confidence bound


def layout(threshold: float, most: int, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket name and number of tables, for ``most`` vectors with one label."""
    bits = int(min(24, max(4, math.ceil(math.log2(max(most, 1) / BUCKET + 1)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def rotation(dim: int, columns: int, seed: int = 7) -> np.ndarray:
    """Independent random rotations side by side, cut to ``columns``."""
    rng = np.random.default_rng([seed, dim])
    q = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-columns // dim))]
    return np.concatenate(q, axis=1)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (bool) of the turned vectors and, for each rotation, the correction factor."""
    dim = unit.shape[1]
    turned = unit @ turn
    return turned > 0, np.abs(turned).reshape(len(unit), -1, dim).sum(axis=2) / math.sqrt(dim)


def upper_bounds(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray, sigmas: float = SIGMAS) -> np.ndarray:
    """Upper confidence bounds of the inner products of coded vectors (rows) with turned ones (columns)."""
    n, r = factors.shape
    dim = signs.shape[1] // r
    scaled = np.where(signs, 1.0, -1.0).reshape(n, r, dim) / (factors[:, :, None] * math.sqrt(dim) * r)
    estimate = scaled.reshape(n, -1).astype(np.float32) @ turned.T.astype(np.float32)
    spread = np.sqrt((np.maximum(0.0, 1 - factors**2) / np.maximum(factors, 1e-9) ** 2).sum(axis=1)) / (r * math.sqrt(max(1, dim - 1)))
    return estimate + (sigmas * spread[:, None] + 1e-5)


def names(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket number in each table."""
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs[:, : bits * tables].reshape(len(signs), tables, bits) @ weights


def _units(column, dim: int) -> np.ndarray:
    v = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1)[:, None]


def _namer(bits: int, tables: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            dims = np.array(b.column("dim").to_pylist(), dtype=np.int64)
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                turn = rotation(dim, bits * tables)
                for at in range(0, part.num_rows, 2048):
                    p = part.slice(at, 2048)
                    keys = names(encode(_units(p.column("embedding"), dim), turn)[0], bits, tables)
                    arrays = [p.column(c) for c in ("node", "label", "dim", "copies", "embedding")]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "label", "dim", "copies", "embedding", "keys"])

    return run


def _linker(threshold: float, bits: int, tables: int):
    def judge(rows):
        """Link counts and forest of one bucket, or of two blocks of one."""
        import pyarrow as pa

        dim, table, bi, bj = (rows[c][0].as_py() for c in ("dim", "table", "bi", "bj"))
        cross = bi != bj
        turn = rotation(dim, bits * tables)
        unit = _units(rows["embedding"], dim)
        signs, factors = encode(unit, turn)
        turned = unit @ turn
        keys = np.asarray(rows["keys"].flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(unit), -1)
        copies, nodes = np.array(rows["copies"].to_pylist(), dtype=np.int64), np.array(rows["node"].to_pylist(), dtype=np.int64)
        block = np.array(rows["block"].to_pylist())
        links, root = np.zeros(len(unit), np.int64), np.arange(len(unit))
        found = []
        for at in range(0, len(unit), 512):
            i, j = np.nonzero(upper_bounds(signs[at : at + 512], factors[at : at + 512], turned) >= threshold)
            i += at
            ok = (i < j) & ((block[i] != block[j]) if cross else True)
            i, j = i[ok], j[ok]
            if table:
                new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
                i, j = i[new], j[new]
            exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold if len(i) else np.zeros(0, bool)
            found.append((i[exact], j[exact]))
        i, j = (np.concatenate(x) for x in zip(*found))
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        while len(i):  # the smaller root of both ends, until nothing moves
            low = np.minimum(root[i], root[j])
            if (low == root[i]).all() and (low == root[j]).all():
                break
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            root = root[root]
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[root[some]])], names=["node", "links", "other"])

    def run(batches):
        import pyarrow as pa

        held, key = [], None
        for b in batches:
            ids = list(zip(*(b.column(c).to_pylist() for c in ("label", "dim", "table", "bucket", "bi", "bj"))))
            at = 0
            while at < len(ids):
                end = at
                while end < len(ids) and ids[end] == ids[at]:
                    end += 1
                if ids[at] != key and held:
                    yield judge(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                key = ids[at]
                held.append(b.slice(at, end - at))
                at = end
        if held:
            yield judge(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def vector_classes(vectors: DataFrame, threshold: float = 0.98, block: int = 4096) -> DataFrame:
    """Per row of ``vectors (vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(usable & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = v.where(usable)
    folded = pin(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")))
    most = folded.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, tables = layout(threshold, most)
    named = arrow_map(folded.select("node", "label", "dim", "copies", "embedding"), _namer(bits, tables), "node bigint, label string, dim int, copies bigint, embedding array<double>, keys array<bigint>")
    spread = named.select("*", F.posexplode("keys").alias("table", "bucket"))
    place = ["label", "dim", "table", "bucket"]
    counts = spread.groupBy(*place).agg(F.count("*").alias("k")).where("k > 1").select(*place, F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    rows = spread.join(counts, place).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"bi": F.least("block", "with"), "bj": F.greatest("block", "with")})
    unit = [*place, "bi", "bj"]
    rows = rows.repartition(*unit).sortWithinPartitions(*unit).select(*unit, "block", "node", "copies", "embedding", "keys")
    links = pin(arrow_map(rows, _linker(threshold, bits, tables), "node bigint, links bigint, other bigint"))
    group = components(links.where("node <> other").select(F.col("node").alias("src"), F.col("other").alias("dst")).distinct())
    per = folded.select("label", "embedding", "node", "copies").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(group, "node", "left")
    per = per.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    tagged = v.withColumn("ok", usable)
    out = tagged.join(per.withColumn("ok", F.lit(True)), ["label", "embedding", "ok"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
