"""Planar geometry as native expressions on nested columns.

Points are ``struct<x, y>``; lines and rings are ``array<struct<x, y>>``; multi-part lines are arrays of lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: planar feet of the New York Long Island zone (Lambert conformal conic, GRS 80) ----
A_M = 6378137.0
FLATTENING = 1 / 298.257222101
LAT_1, LAT_2 = 41.03333333333333, 40.66666666666666
LAT_0, LON_0 = 40.16666666666666, -74.0
FALSE_EASTING_M = 300000.0
US_FOOT_M = 1200 / 3937
# ---- end of fixed values ----

_E = math.sqrt(2 * FLATTENING - FLATTENING**2)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - (_E * math.sin(phi)) ** 2)


def _t(phi: float) -> float:
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


_P1, _P2, _P0 = (math.radians(d) for d in (LAT_1, LAT_2, LAT_0))
_N = math.log(_m(_P1) / _m(_P2)) / math.log(_t(_P1) / _t(_P2))
_F = _m(_P1) / (_N * _t(_P1) ** _N)
_RHO0 = A_M * _F * _t(_P0) ** _N


def lonlat_to_feet(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude to planar feet."""
    phi = F.radians(lat)
    s = F.lit(_E) * F.sin(phi)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_E / 2))
    rho = F.lit(A_M * _F) * F.pow(t, F.lit(_N))
    theta = F.lit(_N) * F.radians(lon - F.lit(LON_0))
    x = F.lit(FALSE_EASTING_M) + rho * F.sin(theta)
    y = F.lit(_RHO0) - rho * F.cos(theta)
    return x / F.lit(US_FOOT_M), y / F.lit(US_FOOT_M)


def feet_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """Planar feet to longitude and latitude (series in the conformal latitude, exact to 1e-10 degrees)."""
    e = x * F.lit(US_FOOT_M) - F.lit(FALSE_EASTING_M)
    n = F.lit(_RHO0) - y * F.lit(US_FOOT_M)
    t = F.pow(F.sqrt(e * e + n * n) / F.lit(A_M * _F), F.lit(1 / _N))
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    e2 = _E * _E
    c2 = e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360
    c4 = 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520
    c6 = 7 * e2**3 / 120 + 81 * e2**4 / 1120
    c8 = 4279 * e2**4 / 161280
    phi = chi + F.lit(c2) * F.sin(2 * chi) + F.lit(c4) * F.sin(4 * chi) + F.lit(c6) * F.sin(6 * chi) + F.lit(c8) * F.sin(8 * chi)
    return F.degrees(F.atan2(e, n) / F.lit(_N)) + F.lit(LON_0), F.degrees(phi)


def projection_constants() -> dict[str, float]:
    """Derived constants, for oracles and tests."""
    return {"e": _E, "n": _N, "af": A_M * _F, "rho0": _RHO0}


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def hypot(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def edges_of(line: Column) -> Column:
    """Consecutive vertex pairs of a line as ``struct<a, b>``."""
    n = F.size(line)
    return F.when(
        n >= 2,
        F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
    ).otherwise(F.slice(F.zip_with(line, line, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), 1, 0))


def _sum(arr: Column, f) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + f(e))


def line_length(line: Column) -> Column:
    return _sum(edges_of(line), lambda e: hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def close_ring(ring: Column) -> Column:
    """Repeat the first vertex at the end when it is missing."""
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def ring_area(ring: Column) -> Column:
    """Shoelace area."""
    cross = _sum(edges_of(close_ring(ring)), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(cross) / 2


def ring_span(ring: Column) -> Column:
    """Twice the largest triangle over the first vertex and the one farthest from it: zero only when all vertices lie on a line."""
    o = F.element_at(ring, 1)
    far = F.element_at(F.array_sort(F.transform(ring, lambda v: F.struct((-hypot(v["x"] - o["x"], v["y"] - o["y"])).alias("d"), v.alias("v")))), 1)["v"]
    return F.array_max(F.transform(ring, lambda v: F.abs((far["x"] - o["x"]) * (v["y"] - o["y"]) - (far["y"] - o["y"]) * (v["x"] - o["x"]))))


def endpoints(line: Column) -> tuple[Column, Column]:
    return F.element_at(line, 1), F.element_at(line, -1)


def multi_endpoints(parts: Column) -> tuple[Column, Column]:
    """First vertex of the first part, last vertex of the last part."""
    return F.element_at(F.element_at(parts, 1), 1), F.element_at(F.element_at(parts, -1), -1)


def longest_part(parts: Column) -> Column:
    """Longest line of a multi-part geometry, the first one on ties."""
    tagged = F.transform(parts, lambda p, i: F.struct((-line_length(p)).alias("l"), i.alias("i"), p.alias("p")))
    return F.element_at(F.array_sort(tagged), 1)["p"]


def representative_point(line: Column) -> Column:
    """Inner vertex nearest to the line's centroid; a line without inner vertices uses its end points."""
    edges = edges_of(line)
    length = line_length(line)
    mid = lambda k: _sum(edges, lambda e: hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]) * (e["a"][k] + e["b"][k]) / 2)
    cx, cy = mid("x") / F.nullif(length, F.lit(0.0)), mid("y") / F.nullif(length, F.lit(0.0))
    inner = F.when(F.size(line) > 2, F.slice(line, 2, F.size(line) - 2)).otherwise(line)
    tagged = F.transform(inner, lambda v, i: F.struct(hypot(v["x"] - cx, v["y"] - cy).alias("d"), i.alias("i"), v.alias("v")))
    return F.coalesce(F.element_at(F.array_sort(tagged), 1)["v"], F.element_at(line, 1))


def inside_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule on a ring."""
    return inside_edges(edges_of(close_ring(ring)), x, y)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.try_divide((px - x1) * dx + (py - y1) * dy, F.nullif(dx * dx + dy * dy, F.lit(0.0)))
    t = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def cut_parameters(x1, y1, x2, y2, a: Column, b: Column, tol: float = 1e-12) -> tuple[Column, Column]:
    """Parameters (t on the first segment, u on segment ``a-b``); null when parallel."""
    rx, ry, sx, sy = x2 - x1, y2 - y1, b["x"] - a["x"], b["y"] - a["y"]
    den = rx * sy - ry * sx
    safe = F.when(F.abs(den) >= tol, den)
    qx, qy = a["x"] - x1, a["y"] - y1
    return (qx * sy - qy * sx) / safe, (qx * ry - qy * rx) / safe


def segments_cross(x1, y1, x2, y2, x3, y3, x4, y4) -> Column:
    a, b = F.struct(x3.alias("x"), y3.alias("y")), F.struct(x4.alias("x"), y4.alias("y"))
    t, u = cut_parameters(x1, y1, x2, y2, a, b)
    return F.coalesce(t.between(0, 1) & u.between(0, 1), F.lit(False))


def inside_edges(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule on ring edges."""
    crossings = F.aggregate(
        edges,
        F.lit(0),
        lambda acc, e: acc
        + F.when(
            ((e["a"]["y"] > y) != (e["b"]["y"] > y))
            & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"]),
            1,
        ).otherwise(0),
    )
    return F.pmod(crossings, F.lit(2)) == 1


def cuts_inside(x1, y1, x2, y2, edges: Column) -> Column:
    """Sorted parameters at which a segment is cut by ring edges, with 0 and 1 at the ends."""

    def cut(e):
        t, u = cut_parameters(x1, y1, x2, y2, e["a"], e["b"])
        return F.when(u.between(0, 1), t)

    ts = F.filter(F.transform(edges, cut), lambda t: (t > 0) & (t < 1))
    return F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), ts))


def length_between_cuts(x1, y1, x2, y2, cuts: Column, edges: Column) -> Column:
    """Length of the pieces between cuts whose middle lies inside the ring."""
    n = F.size(cuts)
    share = F.zip_with(
        F.slice(cuts, 1, n - 1),
        F.slice(cuts, 2, n - 1),
        lambda a, b: F.when(inside_edges(edges, x1 + (x2 - x1) * (a + b) / 2, y1 + (y2 - y1) * (a + b) / 2), b - a).otherwise(F.lit(0.0)),
    )
    return _sum(share, lambda s: s) * hypot(x2 - x1, y2 - y1)


def parse_parts(text: Column) -> Column:
    """Parts of a shape as lists of points: from GeoJSON text, a bare coordinates object (a line), a wrapped feature, or WKT.

    A line or point is one part, a polygon one per ring, a multi-part shape all of theirs; anything else is null.
    """
    inner = F.when(F.get_json_object(text, "$.geometry.coordinates").isNotNull(), F.get_json_object(text, "$.geometry")).otherwise(text)
    kind, coords = F.coalesce(F.get_json_object(inner, "$.type"), F.lit("LineString")), F.get_json_object(inner, "$.coordinates")
    deep = lambda n: F.from_json(coords, "array<" * n + "double" + ">" * n)
    pairs = (
        F.when(kind == "Point", F.array(F.array(deep(1))))
        .when(kind.isin("LineString", "MultiPoint"), F.array(deep(2)))
        .when(kind.isin("MultiLineString", "Polygon"), deep(3))
        .when(kind == "MultiPolygon", F.flatten(deep(4)))
    )
    from_json = F.transform(pairs, lambda part: F.transform(part, lambda p: point(p[0], p[1])))
    shaped = text.rlike(r"(?i)^\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*Z?\s*\([-+0-9.eE,()\s]+\)\s*$")
    groups = F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))
    number = lambda p, i: F.get(F.split(p, r"\s+"), i).try_cast("double")
    from_wkt = F.transform(groups, lambda g: F.transform(F.split(F.trim(g), r"\s*,\s*"), lambda p: point(number(p, 0), number(p, 1))))
    parts = F.when(text.rlike(r"^\s*\{"), from_json).when(shaped, from_wkt)  # only the branch that fits a row is evaluated
    whole = F.forall(parts, lambda part: part.isNotNull() & F.forall(part, lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.when((F.size(parts) > 0) & whole, parts)


def parse_line(text: Column) -> Column:
    """The first part of a shape."""
    return F.get(parse_parts(text), 0)


def looks_like_geometry(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return t.startswith("{") | t.startswith("LINESTRING")
