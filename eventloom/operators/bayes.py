"""Discrete Bayesian networks on counts: structure score and search, tables, blanket, exact inference."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import pin

# ---- fixed values: the state reported as positive, first match wins ----
POSITIVE_STATES = ["yes", "high", "resolved", "heavy", "intense", "extreme", "critical", "very_long", "very_far", "very_high"]
MIN_CELL = 10
# ---- end of fixed values ----


def contingency(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Joint counts of the state combinations; every later count is an aggregate of this small table."""
    return pin(df.groupBy(*variables).agg(F.count("*").alias("n")))


def family_scores(counts: DataFrame, families: Sequence[tuple[str, tuple[str, ...]]], cards: dict[str, int], total: int) -> dict:
    """BIC part of every ``(child, parents)`` family, all in one job."""
    parts = []
    for i, (child, parents) in enumerate(families):
        g = counts.groupBy(child, *parents).agg(F.sum("n").alias("c"))
        if parents:
            g = g.withColumn("p", F.sum("c").over(Window.partitionBy(*parents)))
        else:
            g = g.withColumn("p", F.lit(total))
        parts.append(g.agg(F.sum(F.col("c") * F.log(F.col("c") / F.col("p"))).alias("ll")).select(F.lit(i).alias("i"), "ll"))
    rows = reduce(lambda a, b: a.unionByName(b), parts).collect()  # one row per family
    out = {}
    for r in rows:
        child, parents = families[r["i"]]
        q = math.prod(cards[p] for p in parents)
        out[(child, parents)] = r["ll"] - 0.5 * math.log(total) * (cards[child] - 1) * q
    return out


def _cyclic(parents: dict[str, frozenset], child: str, new: str) -> bool:
    stack, seen = [new], set()
    while stack:
        v = stack.pop()
        if v == child:
            return True
        if v not in seen:
            seen.add(v)
            stack += parents[v]
    return False


def hill_climb(df: DataFrame, variables: Sequence[str], max_indegree: int = 3, forbidden: Sequence[tuple[str, str]] = ()) -> dict:
    """Greedy search over edge additions, removals and reversals by BIC; returns edges and the total score.

    The table is read once, into joint counts; the search itself only compares a handful of family scores.
    """
    counts = contingency(df.select(*variables), variables)
    row = counts.agg(F.sum("n").alias("n"), *[F.count_distinct(v).alias(v) for v in variables]).first()
    total, cards = row["n"], {v: row[v] for v in variables}
    parents = {v: frozenset() for v in variables}
    banned, cache = set(forbidden), {}

    def score(needed):
        todo = [f for f in dict.fromkeys(needed) if f not in cache]
        if todo:
            cache.update(family_scores(counts, todo, cards, total))

    key = lambda v, ps: (v, tuple(sorted(ps)))
    while True:
        moves = []
        for a in variables:
            for b in variables:
                if a == b:
                    continue
                if a in parents[b]:
                    moves.append(("drop", a, b, [(b, parents[b] - {a})]))
                    if len(parents[a]) < max_indegree and (b, a) not in banned and not _cyclic({**parents, b: parents[b] - {a}}, a, b):
                        moves.append(("flip", a, b, [(b, parents[b] - {a}), (a, parents[a] | {b})]))
                elif b not in parents[a] and len(parents[b]) < max_indegree and (a, b) not in banned and not _cyclic(parents, b, a):
                    moves.append(("add", a, b, [(b, parents[b] | {a})]))
        score([key(v, parents[v]) for v in variables] + [key(v, ps) for m in moves for v, ps in m[3]])
        gain = lambda m: sum(cache[key(v, ps)] - cache[key(v, parents[v])] for v, ps in m[3])
        best = max(moves, key=lambda m: (gain(m), m[0], m[1], m[2]), default=None)
        if best is None or gain(best) <= 1e-9:
            break
        for v, ps in best[3]:
            parents[v] = frozenset(ps)
    edges = sorted((p, v) for v, ps in parents.items() for p in ps)
    return {"edges": edges, "score": sum(cache[key(v, parents[v])] for v in variables), "n_rows": total, "cards": cards}


def cpt(df: DataFrame, child: str, parents: Sequence[str]) -> DataFrame:
    """Maximum-likelihood table ``(parents..., child, n, probability)``."""
    g = df.groupBy(*parents, child).agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*parents)) if parents else g.agg(F.sum("n")).scalar()
    return g.withColumn("probability", F.col("n") / whole)


def markov_blanket(edges: DataFrame) -> DataFrame:
    """Parents, children and co-parents of every node."""
    e = edges.select("source", "target")
    mates = e.alias("a").join(e.alias("b"), F.col("a.target") == F.col("b.target")).where(F.col("a.source") != F.col("b.source"))
    rows = (
        e.select(F.col("target").alias("node"), F.col("source").alias("member"), F.lit("parent").alias("role"))
        .union(e.select("source", "target", F.lit("child")))
        .union(mates.select("a.source", "b.source", F.lit("co_parent")))
    )
    return rows.distinct()


def node_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents and children of every node as sorted text, with their counts."""
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")  # bounded by the number of variables
    p = edges.groupBy(F.col("target").alias("node")).agg(join("source").alias("parents"), F.count("*").alias("in_degree"))
    c = edges.groupBy(F.col("source").alias("node")).agg(join("target").alias("children"), F.count("*").alias("out_degree"))
    return nodes.join(p, "node", "left").join(c, "node", "left").fillna("", ["parents", "children"]).fillna(0, ["in_degree", "out_degree"])


def adjacency(edges: DataFrame, nodes: Sequence[str]) -> DataFrame:
    return edges.groupBy("source").pivot("target", list(nodes)).agg(F.count("source")).fillna(0)


def positive_state(df: DataFrame, target: str):
    """First listed positive state that occurs, else the last state in order, as a scalar."""
    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(POSITIVE_STATES) for x in (s, i)]), F.col(target)), F.lit(99))
    known = F.min_by(target, F.when(order < 99, order))
    return df.groupBy(target).count().agg(F.coalesce(known, F.max(target))).scalar()


def conditional_table(df: DataFrame, target: str, a: str, b: str, min_rows: int = MIN_CELL) -> DataFrame:
    """P(target is positive | a, b) for every pair of states of ``a`` and ``b``, null for cells with too few rows or none."""
    hit = df.withColumn("__pos", F.col(target) == positive_state(df, target))
    g = hit.groupBy(a, b).agg(F.count("*").alias("n"), F.avg(F.col("__pos").cast("double")).alias("p"))
    grid = df.select(a).distinct().withColumn("__one", F.lit(1)).join(df.select(b).distinct().withColumn("__one", F.lit(1)), "__one")  # a cell per pair of states
    g = grid.drop("__one").join(g, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return g.select(a, b, "n", F.when(F.col("n") >= min_rows, F.col("p")).alias("probability"))


def infer(tables: dict[str, tuple[DataFrame, Sequence[str]]], query: str, evidence: dict[str, str]) -> DataFrame:
    """P(query | evidence) by variable elimination: factors are joined on shared variables and summed out.

    ``tables`` maps a variable to its CPT and parents; all factors are small and stay as tables.
    """
    factors = []
    for child, (t, parents) in tables.items():
        f = t.select(child, *parents, F.col("probability").alias("v"))
        for var, state in evidence.items():
            if var in f.columns:
                f = f.where(F.col(var) == state).drop(var)
        factors.append(f)
    scope = lambda f: [c for c in f.columns if c != "v"]

    def multiply(x: DataFrame, y: DataFrame) -> DataFrame:
        shared = [c for c in scope(x) if c in scope(y)]
        y = y.withColumnRenamed("v", "w").withColumn("__one", F.lit(1))
        x = x.withColumn("__one", F.lit(1))
        return x.join(y, [*shared, "__one"]).withColumn("v", F.col("v") * F.col("w")).drop("w", "__one")

    hidden = [v for v in tables if v != query and v not in evidence]
    while hidden:
        width = lambda v: len({c for f in factors if v in scope(f) for c in scope(f)})
        v = min(hidden, key=lambda x: (width(x), x))
        hidden.remove(v)
        touched = [f for f in factors if v in scope(f)]
        rest = [f for f in factors if v not in scope(f)]
        prod = reduce(multiply, touched)
        keep = [c for c in scope(prod) if c != v]
        factors = [*rest, prod.groupBy(*keep).agg(F.sum("v").alias("v"))]
    out = reduce(multiply, factors).select(query, "v")
    return out.withColumn("probability", F.col("v") / out.agg(F.sum("v")).scalar()).drop("v")


def empirical(df: DataFrame, query: str, evidence: dict[str, str]) -> DataFrame:
    """Observed frequencies under the evidence: the fallback for inference."""
    cond = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in evidence.items()])
    return cpt(df.where(cond), query, []).select(query, "probability")
