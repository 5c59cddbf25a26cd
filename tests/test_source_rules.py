"""Expected values written out by hand from the published rules."""

import datetime as dt
import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from eventloom.functions import text as X
from eventloom.functions import units as U
from eventloom.functions.geometry import parse_parts
from eventloom.operators.series import resolution_class
from eventloom.operators.spatial import nearest_join
from eventloom.sources import geo, landing, windows


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_resolution_classes(spark):
    t = dt.datetime(2020, 1, 1)
    step = {"a": 1800, "b": 3600, "c": 7200, "d": 86_399, "e": 86_400, "f": 172_800}
    rows = [(k, t + dt.timedelta(seconds=i * s)) for k, s in step.items() for i in range(3)] + [("g", t), ("g", t)]
    got = {r.station: r.resolution for r in resolution_class(spark.createDataFrame(rows, "station string, ts timestamp"), "station", "ts").collect()}
    assert got == {"a": "subhourly", "b": "hourly", "c": "hourly", "d": "hourly", "e": "daily", "f": "daily", "g": "unknown"}


def test_download_and_probe_windows(spark):
    day = lambda s: F.lit(dt.date.fromisoformat(s))
    r = one(spark, windows.fixed_windows(day("2020-01-01"), day("2020-03-10")).alias("f"), windows.probe_windows(day("2020-01-01"), day("2020-12-31")).alias("p"), windows.probe_windows(day("2020-01-01"), day("2020-01-01")).alias("q"))
    text = lambda w: [(str(a), str(b)) for a, b in w]
    assert text(r.f) == [("2020-01-01", "2020-02-01"), ("2020-02-02", "2020-03-04"), ("2020-03-05", "2020-03-10")]
    # 365 days: the midpoint is half past a day, both ends of the middle window are floored
    assert text(r.p) == [("2020-01-01", "2020-01-31"), ("2020-06-16", "2020-07-16"), ("2020-12-01", "2020-12-31")]
    assert text(r.q) == [("2020-01-01", "2020-01-01")]


def test_station_names_and_keys(spark):
    of = lambda d: X.station_aliases(F.lit("7"), F.lit(d))
    r = one(spark, of("GHCND").alias("a"), of("PRECIP_HLY").alias("b"), of("LCD").alias("c"), of("GLOBAL_HOURLY").alias("d"), of(None).alias("e"), X.content_key(F.lit("a"), F.lit("b")).alias("k"))
    assert (r.a, r.b) == (["GHCND:7", "7", "COOP:7", "LCD:7"], ["COOP:7", "GHCND:7", "7", "LCD:7"])
    assert (r.c, r.d, r.e) == (["LCD:7", "COOP:7", "GHCND:7", "7"], ["GHCND:7", "COOP:7", "7", "LCD:7"], ["7", "COOP:7", "GHCND:7", "LCD:7"])
    assert r.k == hashlib.sha1(b"a|b").hexdigest()[:16]


def test_tide_labels(spark):
    df = spark.createDataFrame([("hourly_height", 1.0), ("high_low", None), ("air_gap", 2.0), ("air_gap", None), ("x", 1.0)], "p string, c double")
    got = [tuple(r) for r in df.select(*U.tide_labels(F.col("p"), F.col("c"))).collect()]
    assert got == [("water_level_m", "observed_hourly"), ("high_low_m", "observed_high_low"), ("air_gap_m", "air_gap_to_tide"), ("air_gap_m", "air_gap_raw"), ("level_m", "observed_hourly")]


def test_folding_equals_compatibility_decomposition(spark):
    codes = [c for c in range(0x80, 0x1FA00) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, codes[i : i + 64])) for i in range(0, len(codes), 64)] + [None, "", "plain"]
    got = [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(X.ascii_fold(F.col("t")).alias("f")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]
    assert one(spark, X.ascii_fold(F.lit("№ ⅓ Ⅷ ⑩ é")).alias("f")).f == "No 13 VIII 10 e"


@pytest.mark.parametrize("text, parts", [
    ('{"type": "LineString", "coordinates": [[0, 1], [2, 3]]}', [[(0, 1), (2, 3)]]),
    ('{"coordinates": [[0, 1], [2, 3]]}', [[(0, 1), (2, 3)]]),
    ('{"geometry": {"type": "MultiLineString", "coordinates": [[[0, 1], [2, 3]], [[4, 5], [6, 7]]]}}', [[(0, 1), (2, 3)], [(4, 5), (6, 7)]]),
    ('{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}', [[(0, 0), (1, 0), (1, 1), (0, 0)]]),
    ('{"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]], [[[5, 5], [6, 5], [5, 5]]]]}', [[(0, 0), (1, 0), (0, 0)], [(5, 5), (6, 5), (5, 5)]]),
    ("LINESTRING (0 1, 2 3)", [[(0, 1), (2, 3)]]),
    ("MULTILINESTRING ((0 1, 2 3), (4 5, 6 7))", [[(0, 1), (2, 3)], [(4, 5), (6, 7)]]),
    ("POLYGON((0 0, 1 0, 1 1, 0 0))", [[(0, 0), (1, 0), (1, 1), (0, 0)]]),
    ("not a shape", None), ("LINESTRING (a b)", None), (None, None),
])
def test_shapes_of_all_kinds(spark, text, parts):
    got = one(spark, parse_parts(F.lit(text).cast("string")).alias("p")).p
    assert (None if got is None else [[tuple(p) for p in part] for part in got]) == parts


def test_geometry_column_is_judged_by_its_first_value(spark):
    df = spark.createDataFrame([(None, "x", None), ("words", "y", "LINESTRING (0 0, 1 1)"), ("{stray", "z", None)], "note string, other string, shape_text string").coalesce(1)
    assert geo.detect_geometry_column(df) == "shape_text"


def test_location_objects_hold_longitude_first(spark):
    r = one(spark, X.decimal_point(F.lit('{"coordinates": [-73.9, 40.7]}')).alias("a"), X.decimal_point(F.lit("(40.7, -73.9)")).alias("b"), X.decimal_point(F.lit("-173.9 40.7")).alias("c"))
    assert (tuple(r.a), tuple(r.b), tuple(r.c)) == ((-73.9, 40.7), (-73.9, 40.7), (-173.9, 40.7))


def test_nearest_ends_with_shapes_that_cannot_match(spark):
    fields = "x1 double, y1 double, x2 double, y2 double"
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, None, 0.0, None, 0.0), (3, float("nan"), 0.0, 0.0, 0.0), (4, 900.0, 0.0, 900.0, 0.0)], "a int, " + fields)
    right = spark.createDataFrame([(7, 3.0, 4.0, 3.0, 4.0), (8, None, 1.0, None, 1.0)], "b int, " + fields)
    got = {r.a: (r.b, r.dist and round(r.dist, 3)) for r in nearest_join(left, right, "a", "b", 1.0, (True, True)).collect()}
    assert got == {1: (7, 5.0), 2: (None, None), 3: (None, None), 4: (7, 897.009)}
    assert {(r.b, r.dist) for r in nearest_join(left, right.where("b = 8"), "a", "b", 1.0, (True, True)).collect()} == {(None, None)}


def test_landing_keeps_rows_without_a_time_once(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 5)), (2, None)], "i int, ts timestamp")
    path = str(tmp_path / "t")
    assert landing.land_months(df, "ts", path) == 2 and landing.land_months(df, "ts", path) == 0
    assert sorted(r.i for r in spark.read.parquet(path).collect()) == [1, 2]


def test_numbers_beyond_four_digits_stay_whole(spark):
    ids = spark.range(1, 10_002).select(F.format_string("POSSIBLE_%d_%04d", F.lit(1), "id").alias("e"))
    assert ids.distinct().count() == 10_001
