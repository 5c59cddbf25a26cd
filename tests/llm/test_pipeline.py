"""The pipeline and the registered queries on the smallest tables."""

import re
from collections import defaultdict

import corpus_pipeline
import pytest
from eventloom.llm.queries import ORACLES, QUERIES
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    before = docs.collect()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.dtypes == spark.read.parquet(f"{SF}/documents.parquet").dtypes
        docs = docs.cache()
        seen[name] = docs.collect()
    kept = {r.doc_id for r in seen["toxicity"]}
    dropped = {r.doc_id for r in before} - kept
    assert len(dropped) <= 0.2 * len(before) and (not toxic or len(toxic & kept) <= 0.4 * len(toxic))
    norm = [re.sub(r"[ \t-\r]+", " ", r.text or "") for r in seen["exact dedup"]]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[ \t-\r]+", " ", r.text or "") for r in seen["toxicity"]})
    sets = {r.doc_id: shingles(r.text) for r in seen["exact dedup"]}
    near = {r.doc_id for r in seen["near dedup"]}
    owners = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            owners[x].add(i)
    close = lambda a, b: len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])
    for i in sets:
        others = {j for x in sets[i] for j in owners[x] if j != i and close(i, j)}
        if i in near:
            assert not others & near
        else:
            assert others
    mixed = defaultdict(int)
    for r in seen["mixing"]:
        mixed[r.doc_id] += 1
    assert set(mixed) <= near and max(mixed.values()) <= 3
    pieces = defaultdict(int)
    for r in seen["packing"]:
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(mixed)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    res = connect(SF).execute(ORACLES[name])
    names = [d[0] for d in res.description]
    want = sorted(map(str, res.fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*names).collect()) == want


def test_every_operator_has_one_query():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14)) and len(QUERIES) == 13
