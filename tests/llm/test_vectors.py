"""Vector links against all pairs in double precision."""

import math
from collections import defaultdict

import numpy as np
import pytest

from eventloom.llm import vector_dedup
from tests.llm.test_texts import classes_of

FIELDS = "vec_id bigint, embedding array<float>, label int, node string, copies string, dim string, n_links string"


def clustered(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((12, dim))
    return [(centre[rng.integers(12)] + spread * rng.standard_normal(dim)).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize("block", [40, 4096])
def test_links_equal_all_pairs(spark, block):
    vecs = clustered(500, 24, 1, 0.12)
    vecs[7] = vecs[8] = vecs[9]
    rows = [(i, v, i % 3 if i % 50 else None) for i, v in enumerate(vecs)]
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 24, 1), (503, [float("nan")] + [1.0] * 23, 1), (504, [None] + [1.0] * 23, 1), (505, vecs[1][:20], 1), (506, [float("inf")] * 24, 1), (None, vecs[4], 1)]
    want, links = defaultdict(int), []
    usable = [(i, np.array(v, dtype=float) / np.linalg.norm(v), lab) for i, v, lab in rows[:500] if lab is not None]
    for k, (i, a, x) in enumerate(usable):
        for j, b, y in usable[k + 1 :]:
            if x == y and a @ b >= 0.98:
                links.append((i, j))
                want[i] += 1
                want[j] += 1
    root = classes_of(links, [r[0] for r in rows if r[0] is not None])
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], FIELDS).repartition(3)
    got = vector_dedup.vector_classes(df, block=block).collect()
    assert len(got) == len(rows) and len(links) > 500
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (want[r.vec_id], root[r.vec_id], root[r.vec_id] == r.vec_id)
    assert vector_dedup.vector_classes(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((200, 64))
    b = 0.8 * a + 0.6 * rng.standard_normal((200, 64))
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    turn = vector_dedup.rotation(64, 256)
    signs, factors = vector_dedup.encode(a, turn)
    centre = np.diag(vector_dedup.upper_bounds(signs, factors, b @ turn, sigmas=0.0))
    exact = (a * b).sum(axis=1)
    assert abs((centre - exact).mean()) < 0.02
    assert (np.diag(vector_dedup.upper_bounds(signs, factors, b @ turn)) >= exact).all()


def test_layout_keeps_the_miss_small():
    for most in (1, 1000, 10**6, 10**9):
        bits, tables = vector_dedup.layout(0.98, most)
        agree = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - agree) ** tables <= vector_dedup.MISS and bits <= 24
