import math
import random

from eventloom.operators.bins import rank_bins


def test_rank_bins_place_ties_on_both_sides_of_an_edge(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1.0, 1.0, 1.0, 2.0, 2.5, 7.0, float(i)])) for i in range(400)]
    order = sorted((v, i) for i, v in rows if v is not None)
    n, d = len(order), len({v for v, _ in order})
    for q in (4, 10):
        want = {i: max(0, math.ceil(k * min(q, d) / (n - 1)) - 1) for k, (_, i) in enumerate(order)}
        got = {r.i: r.bin for r in rank_bins(spark.createDataFrame(rows, "i int, v double"), "v", ["i"], q).collect()}
        assert got == {i: want.get(i) for i, _ in rows}
    one = spark.createDataFrame([(1, 3.0), (2, 3.0)], "i int, v double")
    assert {r.bin for r in rank_bins(one, "v", ["i"], 4).collect()} == {None}
