"""Geometry parsing, measures and spatial joins; shapes come from embedding dimensions scaled to feet."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import geometry as G
from eventloom.functions import labels as L
from eventloom.functions.text import decimal_point
from eventloom.functions.units import US_FT_TO_M
from eventloom.operators import spatial as S
from eventloom.operators.cells import boundary_filter, points_in_cover, polygon_cover
from eventloom.plans.registry import query, table

c = F.col


def r(e, n=6):
    return F.round(e, n)


def _d(i):
    return F.round(c("embedding")[i - 1].cast("double") * 1000, 6)


def _s(i):
    return f"round(CAST(embedding[{i}] AS DOUBLE) * 1000, 6)"


PTS = f"pts AS (SELECT vec_id, label, {_s(1)} AS x, {_s(2)} AS y FROM embeddings)"
TGT = f"tgt AS (SELECT vec_id AS tid, {_s(3)} AS x, {_s(4)} AS y FROM embeddings)"
PIECES = "ln AS (" + " UNION ALL ".join(
    f"SELECT vec_id AS lid, label AS llabel, {k} AS k, {_s(17 + 2 * k)} AS x1, {_s(18 + 2 * k)} AS y1, {_s(19 + 2 * k)} AS x2, {_s(20 + 2 * k)} AS y2 FROM embeddings" for k in range(3)
) + ")"
QUAD = "qd AS (SELECT vec_id AS gid, label AS zone, " + ", ".join(f"{_s(9 + i)} * 0.5 AS {'xy'[i % 2]}{i // 2 + 1}" for i in range(8)) + " FROM embeddings)"


def points(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", _d(1).alias("x"), _d(2).alias("y"))


def targets(spark, sf):
    return table(spark, sf, "embeddings").select(c("vec_id").alias("tid"), _d(3).alias("x"), _d(4).alias("y"))


def lines(spark, sf):
    line = F.array(*[G.point(_d(17 + 2 * k), _d(18 + 2 * k)) for k in range(4)])
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("lid"), c("label").alias("llabel"), line.alias("line"))
    return e.withColumn("length_ft", G.line_length(c("line")))


def quads(spark, sf):
    ring = F.array(*[G.point(_d(9 + 2 * k) * 0.5, _d(10 + 2 * k) * 0.5) for k in range(4)])
    return table(spark, sf, "embeddings").select(c("vec_id").alias("gid"), c("label").alias("zone"), ring.alias("ring"))


def _ps(px, py, a="", b=""):
    """SQL distance from a point to the piece x1, y1, x2, y2 (names suffixed)."""
    x1, y1, x2, y2 = (f"{a}x1", f"{a}y1", f"{a}x2", f"{a}y2")
    t = f"coalesce(least(greatest((({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1})) / nullif(({x2} - {x1}) ** 2 + ({y2} - {y1}) ** 2, 0), 0), 1), 0)"
    return f"sqrt(({px} - ({x1} + {t} * ({x2} - {x1}))) ** 2 + ({py} - ({y1} + {t} * ({y2} - {y1}))) ** 2)"


def _inside(px, py):
    """SQL even-odd test against the quad x1..y4."""
    parts = []
    for i in range(1, 5):
        j = i % 4 + 1
        parts.append(f"CASE WHEN ((y{i} > {py}) <> (y{j} > {py})) AND {px} < (x{j} - x{i}) * ({py} - y{i}) / nullif(y{j} - y{i}, 0) + x{i} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


_K = G.projection_constants()


@query(
    "project_coordinates",
    "G1",
    f"""WITH ll AS (SELECT l_orderkey, l_linenumber, l_partkey, -74.2 + l_quantity / 100 AS lon, 40.5 + l_extendedprice / 300000 AS lat FROM lineitem),
    t AS (SELECT *, tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_K['e']!r} * sin(radians(lat))) / (1 + {_K['e']!r} * sin(radians(lat))), {_K['e'] / 2!r}) AS t FROM ll),
    f AS (SELECT *, {_K['af']!r} * pow(t, {_K['n']!r}) AS rho, {_K['n']!r} * radians(lon + 74.0) AS th FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, round((300000.0 + rho * sin(th)) * 3937 / 1200, 3) AS x_ft, round(({_K['rho0']!r} - rho * cos(th)) * 3937 / 1200, 3) AS y_ft, round(lon, 6) AS lon_back, round(lat, 6) AS lat_back FROM f""",
)
def project_coordinates(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (-74.2 + c("l_quantity") / 100).alias("lon"), (40.5 + c("l_extendedprice") / 300000).alias("lat"))
    x, y = G.lonlat_to_feet(c("lon"), c("lat"))
    l = l.withColumns({"x": x, "y": y})
    lon, lat = G.feet_to_lonlat(c("x"), c("y"))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", r(c("x"), 3).alias("x_ft"), r(c("y"), 3).alias("y_ft"), r(lon).alias("lon_back"), r(lat).alias("lat_back"))


@query(
    "coordinate_coalescing",
    "P7 P8 P6 S9",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN 40 + l_quantity / 100 WHEN l_returnflag = 'N' AND l_tax > 0.06 THEN 140.5 END AS lat, CASE WHEN l_returnflag = 'A' THEN -74 + l_discount END AS lon,
      l_linestatus = 'O' AS has_loc, l_tax > 0.02 AS has_sp, l_extendedprice FROM lineitem),
    k AS (SELECT *, CASE WHEN lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 THEN 'latlon' WHEN has_loc THEN 'location' WHEN has_sp THEN 'state_plane' END AS coordinate_source FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, coordinate_source, round(CASE coordinate_source WHEN 'latlon' THEN lat WHEN 'location' THEN 40.25 END, 6) AS latitude, round(CASE coordinate_source WHEN 'latlon' THEN lon WHEN 'location' THEN CASE WHEN l_linenumber % 2 = 0 THEN -73.5 ELSE -173.5 END END, 6) AS longitude,
      CASE coordinate_source WHEN 'state_plane' THEN l_extendedprice END AS x_state_plane FROM k""",
)
def coordinate_coalescing(spark, sf):
    lat = F.when(c("l_returnflag") == "A", 40 + c("l_quantity") / 100).when((c("l_returnflag") == "N") & (c("l_tax") > 0.06), F.lit(140.5))
    lon = F.when(c("l_returnflag") == "A", -74 + c("l_discount"))
    nested = F.when(c("l_linenumber") % 2 == 0, F.lit('{"type": "Point", "coordinates": [-73.5, 40.25]}'))
    loc = F.when(c("l_linestatus") == "O", F.coalesce(nested, F.concat(F.lit("(-173.5, 40.25) part "), c("l_partkey").cast("string"))))
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", lat.alias("lat"), lon.alias("lon"), loc.alias("loc"), F.when(c("l_tax") > 0.02, c("l_extendedprice")).alias("sp"))
    t = t.withColumn("pt", decimal_point(c("loc")))
    direct = c("lat").between(-90, 90) & c("lon").between(-180, 180)
    source = F.when(direct, "latlon").when(c("pt").isNotNull(), "location").when(c("sp").isNotNull(), "state_plane")
    return t.select(
        "l_orderkey", "l_linenumber", "l_partkey", source.alias("coordinate_source"), r(F.when(source == "latlon", c("lat")).when(source == "location", c("pt.y"))).alias("latitude"),
        r(F.when(source == "latlon", c("lon")).when(source == "location", c("pt.x"))).alias("longitude"), F.when(source == "state_plane", c("sp")).alias("x_state_plane"),
    )


@query(
    "geometry_parsing",
    "S4 S5 S6 S7 G4",
    f"""SELECT vec_id, CASE label WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE CAST(round({_s(1)}) AS INTEGER)::DOUBLE END AS first_x, CASE label WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE CAST(round({_s(4)}) AS INTEGER)::DOUBLE END AS last_y,
    CASE WHEN label NOT IN (0, 1) THEN round(sqrt((round({_s(3)}) - round({_s(1)})) ** 2 + (round({_s(4)}) - round({_s(2)})) ** 2), 6) END AS length_ft, 'geom' AS geometry_column FROM embeddings""",
)
def geometry_parsing(spark, sf):
    from eventloom.sources.geo import build_geo_table, detect_geometry_column

    n = [F.round(_d(i)).cast("int").cast("string") for i in (1, 2, 3, 4)]
    pairs = F.concat(F.lit("[["), n[0], F.lit(", "), n[1], F.lit("], ["), n[2], F.lit(", "), n[3], F.lit("]]"))
    geo = F.concat(F.lit('{"type": "LineString", "coordinates": '), pairs, F.lit("}"))
    wkt = F.concat(F.lit("LINESTRING ("), n[0], F.lit(" "), n[1], F.lit(", "), n[2], F.lit(" "), n[3], F.lit(")"))
    bare = F.concat(F.lit('{"coordinates": '), pairs, F.lit("}"))
    feature = F.concat(F.lit('{"geometry": '), geo, F.lit("}"))
    k = c("label")
    text = F.when(k == 0, F.lit(None)).when(k == 1, "not a shape").when(k < 4, geo).when(k < 6, wkt).when(k < 8, bare).otherwise(feature)
    e = table(spark, sf, "embeddings").select("vec_id", F.lit("id").alias("note"), text.alias("geom"))
    column = detect_geometry_column(e)
    g = build_geo_table(e, column, drop_unparsed=False)
    a, b = G.endpoints(c("line"))
    return g.select("vec_id", a["x"].alias("first_x"), b["y"].alias("last_y"), r(G.line_length(c("line"))).alias("length_ft"), F.lit(column).alias("geometry_column"))


_AREA = "abs(" + " + ".join(f"(x{i} * y{i % 4 + 1} - x{i % 4 + 1} * y{i})" for i in range(1, 5)) + ") / 2"


@query(
    "zone_areas",
    "G2 G18",
    f"WITH {QUAD} SELECT CASE WHEN zone > 7 THEN NULL ELSE zone END AS zone, count(*) AS n, round(sum({_AREA}) / 1000000, 9) AS area_km2 FROM qd GROUP BY 1",
)
def zone_areas(spark, sf):
    z = quads(spark, sf).withColumn("zone", F.when(c("zone") <= 7, c("zone")))
    return z.groupBy("zone").agg(F.count("*").alias("n"), r(F.sum(G.ring_area(c("ring"))) / 1000000, 9).alias("area_km2"))


def _len(k):
    return f"sqrt(({_s(19 + 2 * k)} - {_s(17 + 2 * k)}) ** 2 + ({_s(20 + 2 * k)} - {_s(18 + 2 * k)}) ** 2)"


@query(
    "line_measures",
    "G2 G3 G4 G5",
    f"""WITH t AS (SELECT vec_id AS lid, {_len(0)} AS l0, {_len(1)} AS l1, {_len(2)} AS l2, {', '.join(f"{_s(17 + i)} AS v{i}" for i in range(8))} FROM embeddings),
    m AS (SELECT *, l0 + l1 + l2 AS len, (l0 * (v0 + v2) + l1 * (v2 + v4) + l2 * (v4 + v6)) / 2 / (l0 + l1 + l2) AS cx, (l0 * (v1 + v3) + l1 * (v3 + v5) + l2 * (v5 + v7)) / 2 / (l0 + l1 + l2) AS cy FROM t)
    SELECT lid, round(len, 6) AS length_ft, CASE WHEN sqrt((v2 - cx) ** 2 + (v3 - cy) ** 2) <= sqrt((v4 - cx) ** 2 + (v5 - cy) ** 2) THEN v2 ELSE v4 END AS rep_x, v0 AS start_x, v7 AS end_y, round(greatest(l0, l1, l2), 6) AS longest_ft FROM m""",
)
def line_measures(spark, sf):
    parts = F.transform(G.edges_of(c("line")), lambda e: F.array(e["a"], e["b"]))
    a, b = G.multi_endpoints(c("parts"))
    l = lines(spark, sf).withColumn("parts", parts)
    return l.select(
        "lid", r(c("length_ft")).alias("length_ft"), G.representative_point(c("line"))["x"].alias("rep_x"), a["x"].alias("start_x"), b["y"].alias("end_y"),
        r(G.line_length(G.longest_part(c("parts")))).alias("longest_ft"),
    )


@query(
    "nearest_point",
    "G7 G10 G14",
    f"""WITH {PTS}, {TGT}, d AS (SELECT vec_id, tid, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2), tid) AS rn FROM pts p, tgt t)
    SELECT vec_id, tid, round(dist, 6) AS dist FROM d WHERE rn = 1""",
)
def nearest_point(spark, sf):
    p, t = S.point_pieces(points(spark, sf), "vec_id", "x", "y"), S.point_pieces(targets(spark, sf), "tid", "x", "y")
    return S.nearest_join(p, t, "vec_id", "tid", 20.0, (True, True)).withColumn("dist", r(c("dist")))


@query(
    "nearest_station_degrees",
    "G10 G25 J7",
    """WITH st AS (SELECT s_suppkey AS station, -74.3 + s_acctbal / 20000 AS lon, 40.4 + s_nationkey / 40.0 AS lat FROM supplier), cu AS (SELECT c_custkey, -74.3 + c_acctbal / 20000 AS lon, 40.4 + c_nationkey / 40.0 AS lat FROM customer),
    d AS (SELECT c_custkey, station, row_number() OVER (PARTITION BY c_custkey ORDER BY sqrt((c.lon - s.lon) ** 2 + (c.lat - s.lat) ** 2), station) AS rn FROM cu c, st s) SELECT c_custkey, station FROM d WHERE rn = 1""",
)
def nearest_station_degrees(spark, sf):
    st = table(spark, sf, "supplier").select(c("s_suppkey").alias("station"), (-74.3 + c("s_acctbal") / 20000).alias("lon"), (40.4 + c("s_nationkey") / 40.0).alias("lat"))
    cu = table(spark, sf, "customer").select("c_custkey", (-74.3 + c("c_acctbal") / 20000).alias("lon"), (40.4 + c("c_nationkey") / 40.0).alias("lat"))
    near = S.nearest_join(S.point_pieces(cu, "c_custkey", "lon", "lat"), S.point_pieces(st, "station", "lon", "lat"), "c_custkey", "station", 0.03, (True, True))
    return near.select("c_custkey", "station")


@query(
    "nearest_segment_max",
    "G8 J9",
    f"""WITH {PTS}, {PIECES}, d AS (SELECT vec_id, lid, min({_ps('x', 'y')}) AS dist FROM pts, ln GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, lid) AS rn FROM d WHERE dist <= 15)
    SELECT vec_id, lid, round(dist, 6) AS dist, CASE WHEN dist = 0 THEN 'spatial_intersects' ELSE 'spatial_nearest' END AS match_method FROM k WHERE rn = 1""",
)
def nearest_segment_max(spark, sf):
    n = S.nearest_join(
        S.point_pieces(points(spark, sf), "vec_id", "x", "y"), S.line_pieces(lines(spark, sf), "lid", "line"), "vec_id", "lid", 15.0, (True, False), max_distance=15.0
    )
    return n.select("vec_id", "lid", r(c("dist")).alias("dist"), F.when(c("dist") == 0, "spatial_intersects").otherwise("spatial_nearest").alias("match_method"))


@query(
    "point_in_polygon",
    "G6 G19",
    f"WITH {PTS}, {QUAD} SELECT vec_id, min(gid) AS gid FROM pts LEFT JOIN qd ON {_inside('x', 'y')} GROUP BY 1",
)
def point_in_polygon(spark, sf):
    return S.first_polygon(S.point_pieces(points(spark, sf), "vec_id", "x", "y"), quads(spark, sf), "vec_id", "gid", 40.0)


_RINGS = " UNION ALL ".join(f"SELECT gid, x{i} AS x1, y{i} AS y1, x{i % 4 + 1} AS x2, y{i % 4 + 1} AS y2 FROM qd" for i in range(1, 5))


@query(
    "within_then_nearest",
    "G9 G6 G7 G19",
    f"""WITH {PTS}, {QUAD}, rg AS ({_RINGS}), w AS (SELECT vec_id, min(gid) AS gid FROM pts JOIN qd ON {_inside('x', 'y')} GROUP BY 1),
    d AS (SELECT vec_id, gid, min({_ps('x', 'y')}) AS dist FROM pts, rg WHERE vec_id NOT IN (SELECT vec_id FROM w) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, gid) AS rn FROM d)
    SELECT vec_id, gid, 'within' AS method, 0.0::DOUBLE AS dist FROM w UNION ALL SELECT vec_id, gid, 'nearest', round(dist, 6) FROM k WHERE rn = 1""",
)
def within_then_nearest(spark, sf):
    m = S.within_then_nearest(S.point_pieces(points(spark, sf), "vec_id", "x", "y"), quads(spark, sf), "vec_id", "gid", 40.0, 20.0)
    return m.withColumn("dist", r(c("dist")))


@query(
    "within_distance_counts",
    "G13 G14",
    f"""WITH {PTS}, {PIECES}, d AS (SELECT lid, vec_id, min({_ps('x', 'y')}) AS dist FROM ln, pts GROUP BY 1, 2)
    SELECT lid, count(*) FILTER (WHERE dist < 10) AS count_10ft, count(*) FILTER (WHERE dist < 25) AS count_25ft FROM d GROUP BY 1""",
)
def within_distance_counts(spark, sf):
    p = S.point_pieces(points(spark, sf), "vec_id", "x", "y")
    return S.count_within(S.line_pieces(lines(spark, sf), "lid", "line"), p, "lid", {"count_10ft": 10.0, "count_25ft": 25.0})


@query(
    "infrastructure_features",
    "G14 A34 S23",
    f"""WITH {PTS}, {TGT}, {PIECES}, a AS (SELECT lid, min({_ps('x', 'y')}) AS basin_nearest_ft FROM ln, pts GROUP BY 1), b AS (SELECT lid, min({_ps('x', 'y')}) AS outfall_nearest_ft FROM ln, tgt GROUP BY 1)
    SELECT lid, round(basin_nearest_ft, 6) AS basin_nearest_ft, round(outfall_nearest_ft, 6) AS outfall_nearest_ft FROM a JOIN b USING (lid)""",
)
def infrastructure_features(spark, sf):
    l = S.line_pieces(lines(spark, sf), "lid", "line")
    a = S.nearest_join(l, S.point_pieces(points(spark, sf), "vec_id", "x", "y"), "lid", "vec_id", 25.0, (False, True), out_distance="basin_nearest_ft")
    b = S.nearest_join(l, S.point_pieces(targets(spark, sf), "tid", "x", "y"), "lid", "tid", 25.0, (False, True), out_distance="outfall_nearest_ft")
    return a.join(b, "lid").select("lid", r(c("basin_nearest_ft")).alias("basin_nearest_ft"), r(c("outfall_nearest_ft")).alias("outfall_nearest_ft"))


def _cut(i):
    j = i % 4 + 1
    den = f"((l.x2 - l.x1) * (y{j} - y{i}) - (l.y2 - l.y1) * (x{j} - x{i}))"
    t = f"(((x{i} - l.x1) * (y{j} - y{i}) - (y{i} - l.y1) * (x{j} - x{i})) / nullif({den}, 0))"
    u = f"(((x{i} - l.x1) * (l.y2 - l.y1) - (y{i} - l.y1) * (l.x2 - l.x1)) / nullif({den}, 0))"
    return f"CASE WHEN abs({den}) >= 1e-12 AND {t} > 0 AND {t} < 1 AND {u} BETWEEN 0 AND 1 THEN {t} END"


# quads carry x1..y4 too, so the piece columns are renamed in the overlay oracle
# flood zones: small quads around the point of dimensions 9 and 10
ZONES = "qd AS (SELECT vec_id AS gid, label AS zone, " + ", ".join(f"{_s(9 + i % 2)} + {_s(11 + i)} * 0.2 AS {'xy'[i % 2]}{i // 2 + 1}" for i in range(8)) + " FROM embeddings)"


def zones(spark, sf):
    ring = F.array(*[G.point(_d(9) + _d(11 + 2 * k) * 0.2, _d(10) + _d(12 + 2 * k) * 0.2) for k in range(4)])
    return table(spark, sf, "embeddings").select(c("vec_id").alias("gid"), c("label").alias("zone"), ring.alias("ring"))


OVERLAY = f"""{PIECES}, {ZONES}, lp AS (SELECT lid, k, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_ FROM ln),
cu AS (SELECT lid, k, gid, zone, ax, ay, bx, by_, x1, y1, x2, y2, x3, y3, x4, y4, list_sort(list_filter([0.0, 1.0, {', '.join(_cut(i).replace('l.x1', 'ax').replace('l.y1', 'ay').replace('l.x2', 'bx').replace('l.y2', 'by_') for i in range(1, 5))}], lambda t: t IS NOT NULL)) AS ts FROM lp, qd),
sg AS (SELECT lid, gid, zone, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS len, ts[i] AS t0, ts[i + 1] AS t1, ax + (bx - ax) * (ts[i] + ts[i + 1]) / 2 AS mx, ay + (by_ - ay) * (ts[i] + ts[i + 1]) / 2 AS my, x1, y1, x2, y2, x3, y3, x4, y4 FROM (SELECT *, unnest(range(1, len(ts))) AS i FROM cu)),
ov AS (SELECT lid, gid, any_value(zone) AS zone, sum(CASE WHEN {_inside('mx', 'my')} THEN (t1 - t0) * len ELSE 0 END) AS overlap FROM sg GROUP BY 1, 2 HAVING sum(CASE WHEN {_inside('mx', 'my')} THEN (t1 - t0) * len ELSE 0 END) > 0)"""


@query("line_polygon_overlay", "G11", f"WITH {OVERLAY} SELECT lid, gid, round(overlap, 5) AS overlap FROM ov")
def line_polygon_overlay(spark, sf):
    o = S.overlay_lengths(S.line_pieces(lines(spark, sf), "lid", "line"), zones(spark, sf), "lid", "gid")
    return o.withColumn("overlap", r(c("overlap"), 5))


@query(
    "dominant_zone",
    "G12 F16",
    f"""WITH {OVERLAY}, rk AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY overlap DESC, CASE WHEN zone < 4 THEN 'AE' WHEN zone < 7 THEN 'X' ELSE 'VE' END, gid) AS rn, CASE WHEN zone < 4 THEN 'AE' WHEN zone < 7 THEN 'X' ELSE 'VE' END AS fz FROM ov),
    ll AS (SELECT lid, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS len FROM ln GROUP BY 1), cn AS (SELECT lid, count(*) AS n, bool_or(fz IN ('AE', 'VE')) AS sf FROM rk GROUP BY 1)
    SELECT ll.lid, coalesce(fz, 'OUTSIDE_NFHL') AS fld_zone, coalesce(CASE WHEN zone <> 2 THEN 'Z' || zone END, 'NO_INTERSECTION') AS zone_subty, round(coalesce(overlap, 0), 5) AS overlap_ft, round(coalesce(overlap / nullif(len, 0), 0), 6) AS overlap_share, coalesce(n, 0) AS zone_count,
    coalesce(sf, FALSE) AS sfha_any, CASE WHEN fz IS NULL THEN 'OUTSIDE_NFHL' WHEN fz = 'X' THEN 'MINIMAL' ELSE 'SFHA' END AS broad_class FROM ll LEFT JOIN rk ON ll.lid = rk.lid AND rn = 1 LEFT JOIN cn ON ll.lid = cn.lid""",
)
def dominant_zone(spark, sf):
    l = lines(spark, sf)
    code = F.when(c("zone") < 4, "AE").when(c("zone") < 7, "X").otherwise("VE")
    q = zones(spark, sf).select("gid", "ring", code.alias("fld_zone"), F.when(c("zone") != 2, F.concat(F.lit("Z"), c("zone").cast("string"))).alias("zone_subty"))
    d = S.dominant_zone(l, S.line_pieces(l, "lid", "line"), q, "lid", "gid", "length_ft", "fld_zone", "zone_subty", L.OUTSIDE_ZONE, L.NO_ZONE_SUBTYPE)
    return d.select("lid", "fld_zone", "zone_subty", r(c("overlap"), 5).alias("overlap_ft"), r(c("overlap_share")).alias("overlap_share"), "zone_count", "sfha_any", L.flood_zone_class(c("fld_zone")).alias("broad_class"))


def _cross(p, q):
    den = f"(({p}.x2 - {p}.x1) * ({q}.y2 - {q}.y1) - ({p}.y2 - {p}.y1) * ({q}.x2 - {q}.x1))"
    t = f"((({q}.x1 - {p}.x1) * ({q}.y2 - {q}.y1) - ({q}.y1 - {p}.y1) * ({q}.x2 - {q}.x1)) / nullif({den}, 0))"
    u = f"((({q}.x1 - {p}.x1) * ({p}.y2 - {p}.y1) - ({q}.y1 - {p}.y1) * ({p}.x2 - {p}.x1)) / nullif({den}, 0))"
    return f"coalesce({t} BETWEEN 0 AND 1 AND {u} BETWEEN 0 AND 1, FALSE)"


# one-edge lines for the segment-to-segment joins
SEG = f"sg AS (SELECT vec_id AS sid, label AS storm, {_s(33)} AS x1, {_s(34)} AS y1, {_s(33)} + {_s(35)} / 10 AS x2, {_s(34)} + {_s(36)} / 10 AS y2 FROM embeddings)"
SEGDIST = f"CASE WHEN {_cross('a', 'b')} THEN 0 ELSE least({_ps('a.x1', 'a.y1', 'b.')}, {_ps('a.x2', 'a.y2', 'b.')}, {_ps('b.x1', 'b.y1', 'a.')}, {_ps('b.x2', 'b.y2', 'a.')}) END"
# reported segments are those with a positive dimension 40; the storm is the label
STORMS = f"{SEG}, ps AS (SELECT sid, storm, x1, y1, x2, y2 FROM sg JOIN embeddings ON sid = vec_id WHERE embedding[40] > 0)"


def segments(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(c("vec_id").alias("sid"), c("label").alias("storm"), _d(33).alias("x1"), _d(34).alias("y1"), (_d(33) + _d(35) / 10).alias("x2"), (_d(34) + _d(36) / 10).alias("y2"), (c("embedding")[39] > 0).alias("reported"))


@query("storm_buffer_exclusions", "G15 O6", f"WITH {STORMS} SELECT DISTINCT a.storm, b.sid AS near FROM ps a JOIN sg b ON {SEGDIST} <= 12")
def storm_buffer_exclusions(spark, sf):
    s = segments(spark, sf)
    pos = s.where("reported")
    return S.storm_exclusions(pos, s, "storm", "sid", 12.0)


@query(
    "unreported_candidates",
    "G16 F24 A33",
    f"""WITH {STORMS}, d AS (SELECT a.storm, a.sid AS rep, b.sid AS cand, {SEGDIST} AS dist FROM ps a JOIN sg b ON {SEGDIST} <= 12), k AS (SELECT d.*, row_number() OVER (PARTITION BY storm, cand ORDER BY dist, rep) AS rn FROM d WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.storm = d.storm AND ps.sid = d.cand))
    SELECT k.storm, cand AS candidate, rep AS reported_segment, 1000 + rep AS nearest_event, round(dist * 0.304800609601219, 6) AS distance_m, CASE WHEN dist * 0.304800609601219 <= 20 AND a.storm = b.storm THEN 'high' ELSE 'low' END AS confidence FROM k JOIN sg a ON a.sid = cand JOIN sg b ON b.sid = rep WHERE rn = 1""",
)
def unreported_candidates(spark, sf):
    s = segments(spark, sf)
    pos = s.where("reported").withColumn("event", c("sid") + 1000)
    u = S.unreported_candidates(pos, s, "storm", "sid", "event", 12.0)
    zone = s.select("sid", c("storm").alias("zone"))
    u = u.join(zone.select(c("sid").alias("candidate"), c("zone").alias("za")), "candidate").join(zone.select(c("sid").alias("reported_segment"), c("zone").alias("zb")), "reported_segment")
    m, same = c("dist") * US_FT_TO_M, c("za") == c("zb")
    return u.select("storm", "candidate", "reported_segment", "nearest_event", r(m).alias("distance_m"), L.confidence(m, same, same, F.lit(False)).alias("confidence"))


# Raster: one 25 ft cell per (row, col) seen by target points, value = mean of an embedding dimension.
RASTER = f"""ra AS (SELECT CAST(floor((400 - y) / 50) AS BIGINT) AS "row", CAST(floor((x + 400) / 50) AS BIGINT) AS col, CASE WHEN min(tid) > 400 THEN NULL ELSE round(avg(x + y), 3) END AS value FROM tgt GROUP BY 1, 2)"""


@query(
    "raster_sample",
    "G20",
    f"""WITH {TGT}, {RASTER}, v AS ({' UNION ALL '.join(f"SELECT vec_id AS lid, {k} AS i, {_s(17 + 2 * k)} AS x, {_s(18 + 2 * k)} AS y FROM embeddings" for k in range(4))}),
    s AS (SELECT lid, i, value FROM v LEFT JOIN ra ON "row" = CAST(floor((400 - y) / 50) AS BIGINT) AND col = CAST(floor((x + 400) / 50) AS BIGINT)), ll AS (SELECT vec_id AS lid, {_len(0)} + {_len(1)} + {_len(2)} AS len FROM embeddings)
    SELECT s.lid, round(min(value), 6) AS dem_min, round(max(value), 6) AS dem_max, round(avg(value), 6) AS dem_mean, round(stddev_pop(value), 6) AS dem_sd, round(arg_min(value, i) FILTER (WHERE value IS NOT NULL), 6) AS dem_start, round(arg_max(value, i) FILTER (WHERE value IS NOT NULL), 6) AS dem_end,
    count(value) AS dem_vertex_n, round(abs(arg_max(value, i) FILTER (WHERE value IS NOT NULL) - arg_min(value, i) FILTER (WHERE value IS NOT NULL)) / any_value(len), 6) AS dem_slope FROM s JOIN ll USING (lid) GROUP BY s.lid""",
)
def raster_sample(spark, sf):
    t = targets(spark, sf)
    at = lambda e: F.floor(e / F.lit(50.0)).cast("bigint")
    ra = t.groupBy(at(400 - c("y")).alias("row"), at(c("x") + 400).alias("col")).agg(F.when(F.min("tid") <= 400, F.round(F.avg(c("x") + c("y")), 3)).alias("value"))
    s = S.raster_samples(lines(spark, sf), ra, "lid", "line", "length_ft", (-400.0, 400.0), (50.0, 50.0))
    return s.select("lid", "dem_vertex_n", *[r(c(x)).alias(x) for x in ("dem_min", "dem_max", "dem_mean", "dem_sd", "dem_start", "dem_end", "dem_slope")])


# Shore: the quads' outlines of half of the labels; stations are the labels' smallest ids.
SHORE = f"{QUAD}, sh AS (SELECT zone AS station, x1 + 300 AS x1, y1 AS y1, x2 + 300 AS x2, y2 AS y2 FROM qd)"
ENDS = f"""en AS (SELECT vec_id AS lid, 0 AS k, {_s(17)} AS x, {_s(18)} AS y, {_s(19)} AS px, {_s(20)} AS py FROM embeddings UNION ALL SELECT vec_id, 1, {_s(23)}, {_s(24)}, {_s(21)}, {_s(22)} FROM embeddings),
ed AS (SELECT lid, k, x, y, px, py, min({_ps('x', 'y')}) AS dist, arg_min(station, ({_ps('x', 'y')}, station)) AS station FROM en, sh GROUP BY ALL),
an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY dist, k) AS rn FROM ed) WHERE rn = 1 AND (x <> px OR y <> py)),
ux AS (SELECT *, (x - px) / sqrt((x - px) ** 2 + (y - py) ** 2) AS ux, (y - py) / sqrt((x - px) ** 2 + (y - py) ** 2) AS uy FROM an)"""


def shore(spark, sf):
    q = quads(spark, sf)
    v = lambda i: c("ring")[i]
    return q.select(c("zone").alias("station"), (v(0)["x"] + 300).alias("x1"), v(0)["y"].alias("y1"), (v(1)["x"] + 300).alias("x2"), v(1)["y"].alias("y2"))


@query("coastward_endpoint", "G21 G7", f"WITH {SHORE}, {ENDS} SELECT lid, CASE k WHEN 0 THEN 'start' ELSE 'end' END AS terminal, round(dist, 6) AS shore_distance, round(ux, 6) AS ux, round(uy, 6) AS uy, station AS nearest_station FROM ux")
def coastward_endpoint(spark, sf):
    a = S.coastward_endpoints(lines(spark, sf), shore(spark, sf), "lid", "line", "station", 60.0)
    return a.select("lid", "terminal", r(c("shore_distance")).alias("shore_distance"), r(c("ux")).alias("ux"), r(c("uy")).alias("uy"), "nearest_station")


RAYS = f"""ry AS (SELECT lid, k, dist, station, x AS x1, y AS y1, x + ux * 500.0 AS x2, y + uy * 500.0 AS y2 FROM ux),
ht AS (SELECT a.lid, b.station AS hit, (((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0)) AS t FROM ry a JOIN sh b ON {_cross('a', 'b')}),
fh AS (SELECT lid, arg_min(hit, (t, hit)) AS hit, min(t) * 500.0 AS touch FROM ht GROUP BY 1)"""


@query("ray_first_hit", "G22", f"WITH {SHORE}, {ENDS}, {RAYS} SELECT lid, hit AS station, round(touch, 5) AS touch_distance FROM fh")
def ray_first_hit(spark, sf):
    sh = shore(spark, sf)
    a = S.coastward_endpoints(lines(spark, sf), sh, "lid", "line", "station", 60.0)
    return S.first_shore_hit(a, sh, "lid", "station", 500.0, 120.0).withColumn("touch_distance", r(c("touch_distance"), 5))


@query(
    "shore_seed_edges",
    "G23 W10",
    f"""WITH {SHORE}, {PIECES}, {ENDS}, {RAYS}, nr AS (SELECT DISTINCT a.lid FROM ln a JOIN sh b ON {SEGDIST} <= 60),
    s AS (SELECT ry.lid, coalesce(hit, station) AS station, coalesce(touch, dist) AS touch, k FROM ry SEMI JOIN nr ON ry.lid = nr.lid LEFT JOIN fh ON ry.lid = fh.lid)
    SELECT lid, station, round(touch, 5) AS touch_distance, CASE k WHEN 0 THEN 'start' ELSE 'end' END AS terminal FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY touch, lid) AS rn FROM s) WHERE rn <= 3""",
)
def shore_seed_edges(spark, sf):
    s = S.seed_edges(lines(spark, sf), shore(spark, sf), "lid", "line", "station", 60.0, 500.0, 120.0)
    return s.select("lid", "station", r(c("touch_distance"), 5).alias("touch_distance"), "terminal")


@query(
    "shore_label_summary",
    "A31",
    f"""WITH {SHORE}, {PIECES}, {ENDS}, {RAYS}, le AS (SELECT lid, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS length_ft FROM ln GROUP BY 1)
    SELECT hit AS station, count(*) AS edges, round(sum(length_ft), 3) AS total_length_ft FROM le LEFT JOIN fh USING (lid) GROUP BY 1""",
)
def shore_label_summary(spark, sf):
    sh, l = shore(spark, sf), lines(spark, sf)
    hits = S.first_shore_hit(S.coastward_endpoints(l, sh, "lid", "line", "station", 60.0), sh, "lid", "station", 500.0, 120.0)
    return S.label_lengths(l.join(hits, "lid", "left"), "station", "length_ft").withColumn("total_length_ft", r(c("total_length_ft"), 3))


@query(
    "modal_label",
    "G24 A4",
    """SELECT l_suppkey, arg_min(l_linenumber, (-n, l_linenumber)) AS l_linenumber, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def modal_label(spark, sf):
    return S.modal_label(table(spark, sf, "lineitem"), "l_suppkey", "l_linenumber")


@query(
    "boundary_pieces",
    "G6",
    f"SELECT vec_id AS lid FROM embeddings WHERE {_s(17)} BETWEEN -150 AND 150 AND {_s(18)} BETWEEN -150 AND 150",
)
def boundary_pieces(spark, sf):
    box = F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((-150, -150), (150, -150), (150, 150), (-150, 150))])
    l = lines(spark, sf)
    return l.where(G.inside_ring(box, c("line")[0]["x"], c("line")[0]["y"])).select("lid")


# a city with a bay: the upper edge of the boundary is notched down to its middle
BOUNDARY = [(30, 30), (180, 30), (180, 180), (110, 180), (100, 60), (90, 180), (30, 180)]


def boundary(spark, sf):
    """The notched boundary as one row, taken from the smallest id so that it comes from the tables."""
    ring = F.array(*[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in BOUNDARY])
    return table(spark, sf, "embeddings").agg(F.min("vec_id").alias("bid")).select("bid", ring.alias("ring"))


_BEDGES = "be AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(BOUNDARY, BOUNDARY[1:] + BOUNDARY[:1])) + ") AS t(x1, y1, x2, y2))"


def _odd(edges, px, py):
    return f"(SELECT count(*) FROM {edges} e WHERE ((e.y1 > {py}) <> (e.y2 > {py})) AND {px} < (e.x2 - e.x1) * ({py} - e.y1) / (e.y2 - e.y1) + e.x1) % 2 = 1"


@query(
    "boundary_zones",
    "G17 G6",
    f"""WITH {QUAD}, {_BEDGES}, rg AS ({_RINGS}), cr AS (SELECT DISTINCT a.gid FROM rg a JOIN be b ON {_cross('a', 'b')}), vi AS (SELECT DISTINCT gid FROM rg WHERE {_odd('be', 'rg.x1', 'rg.y1')}),
    bi AS (SELECT DISTINCT gid FROM qd JOIN (SELECT x1 AS px, y1 AS py FROM be) ON {_inside('px', 'py')}) SELECT gid, zone FROM qd WHERE gid IN (FROM cr) OR gid IN (FROM vi) OR gid IN (FROM bi)""",
)
def boundary_zones(spark, sf):
    q = quads(spark, sf)
    return q.join(boundary_filter(q, boundary(spark, sf), "gid", 25.0), "gid", "left_semi").select("gid", "zone")


@query(
    "points_in_boundary",
    "G17 G6 P6",
    f"WITH {PTS}, {_BEDGES} SELECT vec_id, {_odd('be', 'pts.x', 'pts.y')} AS inside FROM pts",
)
def points_in_boundary(spark, sf):
    p = points(spark, sf)
    hit = points_in_cover(p, polygon_cover(boundary(spark, sf), "bid", 25.0), "vec_id", "bid", 25.0)
    return p.join(hit, "vec_id", "left").select("vec_id", c("bid").isNotNull().alias("inside"))
