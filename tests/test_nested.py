"""Nested search against a plain recursive search, with literal payloads."""

import json

from eventloom.sources.nested import deep_find_number, station_catalog

KEYS = ["a", "b"]
CASES = {
    "depth five": ('{"x": {"x": [{"x": {"x": {"x": {"b": 3.5}}}}]}}', 3.5),
    "own key before nested": ('{"n": {"a": 1}, "b": 2}', 2.0),
    "key order within an object": ('{"b": 2, "a": 1}', 1.0),
    "document order, not name order": ('{"z": {"a": 9}, "c": {"a": 8}}', 9.0),
    "first branch to its end": ('{"p": {"q": {"r": {"a": 4}}}, "s": {"a": 5}}', 4.0),
    "passed over": ('{"a": null, "b": "", "c": [{"a": "none"}, {"b": " 7 "}]}', 7.0),
    "text that looks like an object": ('{"x": "{\\"a\\": 1}", "y": {"a": 2}}', 2.0),
    "object under the key is searched": ('{"a": {"b": 6}}', 6.0),
    "boolean": ('{"a": true}', 1.0),
    "suffix letter": ('{"a": "1d", "b": "1e3"}', 1000.0),
    "list of lists": ("[[1, 2], [[{\"a\": -1}]]]", -1.0),
    "no hit": ('{"c": 1, "d": [1, {}]}', None),
    "malformed": ('{"a": 1', None),
    "scalar": ("5", None),
    "empty": ("", None),
    "null": (None, None),
}


def test_first_number_in_document_order(spark):
    rows = [(k, v[0]) for k, v in CASES.items()]
    got = {r.id: r.hit for r in deep_find_number(spark.createDataFrame(rows + rows[:1], "id string, p string"), "id", "p", KEYS, "hit").collect()}
    assert got == {k: v[1] for k, v in CASES.items()}


def test_repeated_ids_keep_their_rows_and_an_empty_table_is_empty(spark):
    df = spark.createDataFrame([("x", '{"a": 1}'), ("x", '{"a": 2}'), (None, '{"b": 3}')], "id string, p string")
    assert sorted(r.hit for r in deep_find_number(df, "id", "p", KEYS, "hit").collect()) == [1.0, 2.0, 3.0]
    assert deep_find_number(df.limit(0), "id", "p", KEYS, "hit").count() == 0


def test_station_catalog_reads_every_payload_shape(spark):
    payloads = [
        ("1", {"id": "10", "name": "Battery", "lat": 40.7, "lng": -74.0, "details": {"deep": [{"clearance": 10}]}}),
        ("2", {"stations": [{"id": 20, "latitude": "41.5", "longitude": "", "lon": -73.5, "state": "", "stateCode": "NY"}]}),
        ("3", {"station": {"name": "", "type": "tide"}}),
        ("4", {"stationList": [], "other": 1}),
    ]
    df = spark.createDataFrame([(k, "given " + k, "r", json.dumps(p)) for k, p in payloads], "id string, name string, role string, payload string")
    got = {r.station_id: r for r in station_catalog(df, "payload", "id", "name", "role").collect()}
    assert set(got) == {"10", "20", "3", "4"}
    assert (got["10"].station_name, got["10"].lat, got["10"].lon, round(got["10"].bridge_clearance_m, 4)) == ("Battery", 40.7, -74.0, 3.048)
    assert (got["20"].station_name, got["20"].lat, got["20"].lon, got["20"].state, got["20"].bridge_clearance_m) == ("given 2", 41.5, -73.5, "NY", None)
    assert (got["3"].station_name, got["3"].station_type) == ("given 3", "tide") and got["4"].lat is None
