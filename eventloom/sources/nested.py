"""Search in nested JSON payloads at any depth, and a station catalog built with it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import pin

# ---- fixed values: names under which a station payload holds its record and fields ----
RECORD_KEYS = ("station", "stations", "stationList", "stationlist")
LATITUDE_KEYS = ("lat", "latitude")
LONGITUDE_KEYS = ("lng", "lon", "longitude")
STATE_KEYS = ("state", "stateCode")
TYPE_KEYS = ("type", "stationType")
CLEARANCE_KEYS = (
    "bridge_clearance_ft", "bridge_clearance", "clearance_ft", "clearance", "air_gap_height_ft", "air_gap_height", "vertical_clearance_ft", "vertical_clearance",
)
FT_TO_M = 0.3048
# ---- end of fixed values ----


def _kind(value: Column) -> Column:
    """First letters of a variant's type: OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number's."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _number(text: Column, kind: Column) -> Column:
    """A scalar member as a number: numbers, texts that are one, and booleans as 1 and 0; else null."""
    trimmed = F.trim(text)
    plain = F.when(~trimmed.rlike("[0-9.][dDfF]$"), trimmed.try_cast("double"))
    return F.when(kind == "BOOLEAN", (text == "true").cast("double")).when(~kind.isin("OBJECT", "ARRAY", "VOID"), plain)


def deep_find_number(df: DataFrame, id_: str, payload: str, keys: Sequence[str], out: str) -> DataFrame:
    """``(id_, out)`` for every row: the first number under any of ``keys``, at any depth of the JSON text ``payload``.

    An object's own keys come before what is nested in it, in the order of ``keys``; members and elements follow in document
    order, each searched to its end before the next.  A null, an empty text or a value that is no number is passed over.  Rows
    without a hit, null and malformed payloads and scalars give null; an id may repeat (each row has its own answer).

    One round per level of the deepest payload: each round opens the objects and arrays left, and an object that has an answer is
    not opened, as nothing inside can come before it.  Members keep document order in a map of texts; the variant beside it
    tells a text that looks like an object from an object.  State is the open containers, never a whole payload in one group."""
    rows = pin(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_).alias(id_), F.col(payload).cast("string").alias("node")))
    found, todo = None, rows.where(F.try_parse_json("node").isNotNull()).select("row", F.array().cast("array<int>").alias("path"), "node", _kind(F.try_parse_json("node")).alias("kind"))
    while True:
        todo = todo.where(F.col("kind").isin("OBJECT", "ARRAY"))
        opened = todo.select(
            "row", "path",
            F.when(F.col("kind") == "OBJECT", F.from_json("node", "map<string,string>")).alias("texts"), F.when(F.col("kind") == "OBJECT", F.from_json("node", "map<string,variant>")).alias("kinds"),
            F.when(F.col("kind") == "ARRAY", F.from_json("node", "array<string>")).alias("items"), F.when(F.col("kind") == "ARRAY", F.from_json("node", "array<variant>")).alias("item_kinds"),
        )
        hit = F.coalesce(*[_number(F.try_element_at("texts", F.lit(k)), _kind(F.try_element_at("kinds", F.lit(k)))) for k in keys])
        # members as (name free) texts and kinds in document order
        members = F.when(
            F.col("texts").isNotNull(), F.zip_with(F.map_values("texts"), F.map_values("kinds"), lambda t, v: F.struct(t.alias("node"), _kind(v).alias("kind")))
        ).otherwise(F.zip_with("items", "item_kinds", lambda t, v: F.struct(t.alias("node"), _kind(v).alias("kind"))))
        members = F.filter(F.transform(members, lambda m, i: F.struct(i.alias("i"), m["node"].alias("node"), m["kind"].alias("kind"))), lambda m: m["kind"].isin("OBJECT", "ARRAY"))
        level = pin(opened.select("row", "path", hit.alias("hit"), F.when(hit.isNull(), members).alias("members")))
        best = level.where("hit IS NOT NULL").select("row", "path", "hit")
        found = best if found is None else found.unionByName(best)
        todo = level.select("row", "path", F.explode("members").alias("m")).select("row", F.concat("path", F.array(F.col("m.i"))).alias("path"), "m.node", "m.kind")
        if level.where("size(members) > 0").isEmpty():
            first = found.groupBy("row").agg(F.min_by("hit", "path").alias(out))
            return rows.join(first, "row", "left").select(id_, out)


def _first_text(record: Column, keys: Sequence[str]) -> Column:
    """First member that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(record, f"$.{k}"), F.lit("")) for k in keys])


def _first_number(record: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[_number(F.get_json_object(record, f"$.{k}"), F.lit("STRING")) for k in keys])


def station_record(payload: Column) -> Column:
    """The record inside a payload: itself when it has an id and a place or name, else the first named object or list head, else itself."""
    has = lambda k: F.get_json_object(payload, f"$.{k}").isNotNull()
    own = has("id") & (has("lat") | has("lng") | has("name"))
    inner = []
    for k in RECORD_KEYS:
        v = F.get_json_object(payload, f"$.{k}")
        inner += [F.when(v.startswith("{"), v), F.when(v.startswith("[") & (v != "[]"), F.get_json_object(payload, f"$.{k}[0]"))]
    return F.when(own, payload).otherwise(F.coalesce(*inner, payload))


def station_catalog(df: DataFrame, payload: str, station: str, name: str, role: str) -> DataFrame:
    """One flat row per station payload: id, name (the given ones where the record has none), role, place, state, kind, clearance in metres."""
    s = pin(df.select(F.col(station).cast("string").alias("__id"), F.col(name).alias("__name"), F.col(role).alias("role"), station_record(F.col(payload)).alias("__record")).withColumn("__row", F.monotonically_increasing_id()))
    clearance = deep_find_number(s, "__row", "__record", CLEARANCE_KEYS, "__feet")
    record = F.col("__record")
    return s.join(clearance, "__row", "left").select(
        F.coalesce(F.get_json_object(record, "$.id"), "__id").alias("station_id"), F.coalesce(_first_text(record, ["name"]), "__name").alias("station_name"), "role",
        _first_number(record, LATITUDE_KEYS).alias("lat"), _first_number(record, LONGITUDE_KEYS).alias("lon"), _first_text(record, STATE_KEYS).alias("state"),
        F.get_json_object(record, "$.tidal").alias("tidal"), _first_text(record, TYPE_KEYS).alias("station_type"), (F.col("__feet") * FT_TO_M).alias("bridge_clearance_m"),
    )
