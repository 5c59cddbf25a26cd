"""Anomaly scores and their ensemble: isolation forest, local outlier factor, density noise, robust deviation."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.bins import at_least_quantile, average_ranks
from eventloom.operators.cluster import dbscan, knn
from eventloom.operators.quantiles import exact_quantiles
from eventloom.session import pin, tabled

TREES, TREE_ROWS, SEED = 100, 256, 42


def _average_path(n: np.ndarray | float):
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, depth: int, rng) -> tuple:
    lo, hi = x.min(0), x.max(0)
    usable = np.flatnonzero(hi > lo)
    if depth == 0 or len(x) <= 1 or not len(usable):
        return (None, float(_average_path(len(x))))
    f = int(rng.choice(usable))
    cut = float(rng.uniform(lo[f], hi[f]))
    left = x[:, f] < cut
    return (f, cut, _grow(x[left], depth - 1, rng), _grow(x[~left], depth - 1, rng))


def _depths(tree: tuple, x: np.ndarray, base: float = 0.0) -> np.ndarray:
    if tree[0] is None:
        return np.full(len(x), base + tree[1])
    out = np.empty(len(x))
    left = x[:, tree[0]] < tree[1]
    out[left] = _depths(tree[2], x[left], base + 1)
    out[~left] = _depths(tree[3], x[~left], base + 1)
    return out


def isolation_scores(points: DataFrame, trees: int = TREES, rows: int = TREE_ROWS) -> DataFrame:
    """Isolation score per point.  Each tree draws its own ``rows`` rows from the whole table and grows in a task of its own;
    scoring is distributed and the forest, ``trees * rows`` leaves at most, is broadcast."""
    n = points.count()
    if not n:
        return points.select("id", F.lit(None).cast("double").alias("score"))
    chance = min(1.0, 2.0 * rows / n)
    draw = lambda t: F.pmod(F.xxhash64("id", t, F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("u"))), lambda d: d["u"] < chance)
    sample = points.select("vec", F.explode(drawn).alias("d")).select("d.tree", "d.u", "vec")  # about 2 * trees * rows rows

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u").head(rows)
        x = np.stack(pdf["vec"].to_numpy())
        depth = int(np.ceil(np.log2(max(len(x), 2))))
        return pd.DataFrame({"tree": [pickle.dumps(_grow(x, depth, np.random.default_rng([SEED, int(pdf["tree"].iloc[0])])))]})

    forest = [pickle.loads(t.tree) for t in sample.groupBy("tree").applyInPandas(grow, "tree binary").collect()]
    shared = points.sparkSession.sparkContext.broadcast((forest, float(_average_path(min(rows, n)))))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest_, c = shared.value
        for b in batches:
            if b.empty:
                continue
            m = np.stack(b["vec"].to_numpy())
            d = np.mean([_depths(t, m) for t in forest_], axis=0)
            yield pd.DataFrame({"id": b["id"], "score": 2.0 ** (-d / c)})

    return points.select("id", "vec").mapInPandas(score, f"id {points.schema['id'].dataType.simpleString()}, score double")


def local_outlier_factor(points: DataFrame, k: int, radius: float) -> DataFrame:
    """LOF from exact neighbours: ratio of the neighbours' reachability density to the point's own."""
    near = tabled(knn(points, k, radius))
    kdist = near.groupBy(F.col("lid").alias("rid")).agg(F.max("dist").alias("kd"))
    reach = near.join(kdist, "rid").withColumn("reach", F.greatest("dist", "kd"))
    lrd = pin(reach.groupBy(F.col("lid").alias("id")).agg((1.0 / (F.avg("reach") + F.lit(1e-10))).alias("lrd")))
    j = near.join(lrd.select(F.col("id").alias("rid"), F.col("lrd").alias("other")), "rid").groupBy(F.col("lid").alias("id")).agg(F.avg("other").alias("mean_other"))
    return j.join(lrd, "id").select("id", (F.col("mean_other") / F.col("lrd")).alias("score"))


def robust_deviation(points: DataFrame) -> DataFrame:
    """Mean over features of ``|x - median| / MAD`` with exact medians; a zero MAD counts as 1."""
    long = points.select("id", F.posexplode("vec").alias("f", "x"))
    med = exact_quantiles(long, ["f"], "x", {"med": 0.5})
    dev = long.join(F.broadcast(med), "f").withColumn("dev", F.abs(F.col("x") - F.col("med")))  # one row per feature
    mad = exact_quantiles(dev, ["f"], "dev", {"mad": 0.5}).withColumn("mad", F.when(F.col("mad") == 0, F.lit(1.0)).otherwise(F.col("mad")))
    return dev.join(F.broadcast(mad), "f").groupBy("id").agg(F.avg(F.col("dev") / F.col("mad")).alias("score"))


def ensemble(points: DataFrame, k: int, radius: float, eps: float, min_samples: int) -> DataFrame:
    """Flags of four methods, their agreement, and the mean percentile rank of the three scores."""
    # dealt over all cores: a small file is one partition, and a row has many trees to pass
    points = pin(points.repartition(2 * points.sparkSession.sparkContext.defaultParallelism, "id"))
    iso = isolation_scores(points).select("id", F.col("score").alias("anomaly_score_isolation_forest"))
    lof = local_outlier_factor(points, k, radius).select("id", F.col("score").alias("anomaly_score_lof"))
    rob = robust_deviation(points).select("id", F.col("score").alias("anomaly_score_robust_z"))
    noise = dbscan(points, eps, min_samples).select("id", F.col("cluster").isNull().alias("anomaly_flag_dbscan_noise"))
    t = pin(iso.join(lof, "id").join(rob, "id").join(noise, "id"))
    t = at_least_quantile(t, "anomaly_score_robust_z", 0.98, "anomaly_flag_robust_z")
    t = t.withColumns({"anomaly_flag_isolation_forest": F.col("anomaly_score_isolation_forest") > 0.5, "anomaly_flag_lof": F.col("anomaly_score_lof") > 1.5})
    scores = [c for c in t.columns if c.startswith("anomaly_score_")]
    flags = [c for c in t.columns if c.startswith("anomaly_flag_")]
    for s in scores:
        t = average_ranks(t, s, f"__r_{s}", f"__p_{s}").drop(f"__r_{s}")
    agree = sum((F.col(f).cast("int") for f in flags[1:]), F.col(flags[0]).cast("int"))
    mean = sum((F.col(f"__p_{s}") for s in scores[1:]), F.col(f"__p_{scores[0]}")) / len(scores)
    out = t.withColumns({"anomaly_method_agreement": agree, "anomaly_score": mean})
    return out.withColumn("anomaly_flag", F.col("anomaly_method_agreement") >= 2).drop(*[f"__p_{s}" for s in scores])
