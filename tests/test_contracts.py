import pytest

from eventloom.operators import contracts as C

SCHEMA = "k bigint, v string"


def test_a_stage_keeps_its_rows_and_counts_them(spark):
    df = spark.createDataFrame([(i, "x") for i in range(50)], SCHEMA).repartition(4)
    out, n = C.stage(df, "base", {"k": "bigint"}, ["k"])
    assert n == 50 == out.count() and sorted(r.k for r in out.collect()) == list(range(50))
    assert C.stage(df.limit(0), "none", {}, ["k"], 0)[1] == 0


def test_a_feature_key_that_occurs_twice_is_found(spark):
    df = spark.createDataFrame([(i, "x") for i in range(5)], SCHEMA)
    features = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k bigint, f double")
    with pytest.raises(C.ContractError, match="6 rows, expected 5"):
        C.stage(df.join(features, "k", "left"), "features", {"f": "double"}, ["k"], 5)
    with pytest.raises(C.ContractError, match=r"\(1,\) occurs 2 times"):
        C.unique(features, "features", ["k"])
    C.unique(df, "base", ["k"])


def test_null_keys_and_wrong_types_are_found(spark):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (2, None)], SCHEMA)
    with pytest.raises(C.ContractError, match="1 rows without a key"):
        C.stage(df, "base", {}, ["k"])
    with pytest.raises(C.ContractError, match="2 rows without a key"):
        C.stage(df, "base", {}, ["k", "v"])
    for columns in ({"k": "int"}, {"z": "string"}):
        with pytest.raises(C.ContractError, match="expected"):
            C.columns_hold(df, "base", columns)
