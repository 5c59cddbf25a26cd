import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import joins as J


@pytest.mark.parametrize("hot", [False, True])
def test_overlaps_of_cold_keys_are_found_without_counting_buckets(spark, monkeypatch, hot):
    rng = random.Random(3)
    span = lambda n, long: [(rng.choice("ab"), i, s := rng.randrange(400), s + rng.randrange(-2, long)) for i in range(n)]
    left, right = span(60, 90), span(40, 30)
    salted = []
    monkeypatch.setattr(J, "salted_join", lambda *a, keep=J.salted_join: salted.append(1) or keep(*a))
    monkeypatch.setattr(J, "ROWS_PER_TASK", 10 if hot else 100)
    table = lambda rows, p: spark.createDataFrame(rows, f"k string, {p}id long, s long, e long").select("k", f"{p}id", F.timestamp_seconds("s").alias(f"{p}s"), F.timestamp_seconds("e").alias(f"{p}e"))
    got = J.overlap_join(table(left, "l"), table(right, "r"), ["k"], ("ls", "le"), ("rs", "re"), 25)
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= a[3] and b[2] <= b[3] and b[2] <= a[3] and b[3] >= a[2])
    assert sorted((r.lid, r.rid) for r in got.collect()) == want and len(want) > 100
    assert len(salted) == hot
