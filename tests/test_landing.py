"""Plan-driven landing: a manifest committed after the data, and a crash between the two."""

import datetime as dt
from collections import Counter

import pytest

from eventloom.sources.landing import land_plan, landed


def test_a_crash_before_the_manifest_neither_repeats_nor_misses_a_month(spark, tmp_path):
    root = str(tmp_path / "root")
    rows = [(i, dt.datetime(2020, 1, 1) + dt.timedelta(days=i, hours=23)) for i in range(150)] + [(900, None)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    plan = spark.createDataFrame([("a", "2020-01-10", "2020-02-29", "first"), ("b", "2020-03-01", "2020-08-31", "second")], "archive string, start string, end string, folder string")
    asked = []

    def read(archive):
        asked.append(archive)
        return df

    def die(archive):
        if archive == "b":
            raise InterruptedError(archive)

    with pytest.raises(InterruptedError):
        land_plan(plan, read, "ts", root, before_commit=die)
    seen = landed(spark, root, df.schema).collect()
    assert {r.month for r in seen} == {"2020_01", "2020_02"} and {r.folder for r in seen} == {"first"}
    assert land_plan(plan, read, "ts", root) == 6 and asked == ["a", "b", "b"]
    assert land_plan(plan, read, "ts", root) == 0 and asked == ["a", "b", "b"]  # months without rows are not asked for again
    got = landed(spark, root, df.schema).collect()
    assert Counter(r.id for r in got) == Counter(range(9, 150))
    assert all(r.month == r.ts.strftime("%Y_%m") and r.folder == ("first" if r.ts.month < 3 else "second") for r in got)
    assert landed(spark, root, df.schema, "first").count() == 51
    wider = plan.selectExpr("archive", "start", "CASE archive WHEN 'a' THEN '2020-03-31' ELSE end END AS end", "folder")
    assert land_plan(wider, read, "ts", root) == 1 and asked[-1] == "a"


def test_nothing_planned_and_nothing_to_land(spark, tmp_path):
    root = str(tmp_path / "root")
    df = spark.createDataFrame([], "id int, ts timestamp")
    plan = spark.createDataFrame([("a", "2020-01-01", "2020-01-31", "f")], "archive string, start string, end string, folder string")
    assert land_plan(plan.limit(0), lambda a: df, "ts", root) == 0
    assert land_plan(plan, lambda a: df, "ts", root) == 1 and landed(spark, root, df.schema).count() == 0
