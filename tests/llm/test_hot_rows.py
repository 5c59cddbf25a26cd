"""Stages on tables with a hot id, rows repeated whole, clashing names, and without rows."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from eventloom.llm import exact_dedup, minhash, mixing
from tests.llm.conftest import syllables

NAMES = ["sha", "_sha", "__sha", "__id", "__no", "__copies", "__copy", "owner", "who", "what", "rows", "copies", "part", "nth", "before", "again", "hash", "place"]
FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} int" for n in NAMES)


@pytest.fixture(scope="module")
def hot(spark):
    rng = random.Random(9)
    rest = lambda k: ("en", rng.choice(["a", "b", None]), 1, *[k] * len(NAMES))
    rows = [(None, syllables(rng, rng.randint(1, 30)), *rest(1)) for _ in range(60)]
    rows += [(7, "the same words again", "en", "a", 1, *[2] * len(NAMES))] * 60
    rows += [(7, "the same words again", "de", "a", 1, *[3] * len(NAMES))] * 2
    rows += [(i, syllables(rng, rng.randint(0, 40)), *rest(4)) for i in range(100, 160)]
    return spark.createDataFrame(rows, FIELDS).repartition(6)


def test_mix_of_hot_rows(hot):
    rows = hot.count()
    plan = mixing.mix(hot, rows_per_chunk=8).collect()
    assert len(plan) == rows
    by_source = {}
    for r in plan:
        assert 0 <= r.copies <= 3
        s = by_source.setdefault(r.source, [0, r.target])
        s[0] += r.taken
    for taken, target in by_source.values():
        assert abs(taken - target) <= 0.1 * target + 120
    again = Counter(tuple(r) for r in mixing.mix(hot, rows_per_chunk=8).collect())
    assert again == Counter(tuple(r) for r in plan)


def test_mixed_numbers_repeated_rows(hot):
    plan = mixing.mix(hot)
    out = mixing.mixed(hot)
    assert out.columns == hot.columns
    assert out.count() == plan.agg({"copies": "sum"}).first()[0]
    got = Counter((r.doc_id, r.lang, r["__sha"]) for r in out.where("doc_id = 7").collect())
    assert max(got.values()) <= 3 * 60 and set(got) == {(7, "en", 2), (7, "de", 3)} or sum(got.values()) < 62


def test_copies_are_dropped_the_same_way_each_time(hot):
    a, b = ([tuple(r) for r in exact_dedup.drop_copies(d).where("doc_id = 7").collect()] for d in (hot, hot.repartition(2)))
    assert a == b and len(a) == 1 and a[0][2] == "de"


def test_near_copies_keep_columns(hot):
    assert minhash.drop_near(hot).columns == hot.columns


@pytest.mark.parametrize("empty", [False, True])
def test_all_stages(spark, hot, empty, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(100, 1, 0), (101, 1, 0), (102, 0, None), (None, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    (hot.limit(0) if empty else hot).write.parquet(f"{sf}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert (pieces.count() == 0) == empty
