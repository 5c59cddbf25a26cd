"""Scalar expressions and cleaning projections over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from eventloom.functions import labels as L
from eventloom.functions import temporal as T
from eventloom.functions import text as X
from eventloom.functions import units as U
from eventloom.plans.registry import query, table
from eventloom.sources.nested import CLEARANCE_KEYS, deep_find_number, station_catalog

c = F.col


def r(e, n=6):
    return F.round(e, n)


@query(
    "normalize_segment_ids",
    "F1 F2",
    """WITH t AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN ' 00' || o_orderkey || '.0 ' WHEN '2-HIGH' THEN 'A-' || o_orderkey WHEN '3-MEDIUM' THEN 'nan' WHEN '4-NOT SPECIFIED' THEN '000' ELSE o_custkey || '.0' END AS raw FROM orders),
    d AS (SELECT *, trim(raw) AS tr, regexp_replace(raw, '[^0-9]', '', 'g') AS alld FROM t),
    e AS (SELECT *, CASE WHEN regexp_full_match(tr, '[0-9]+\\.0+') THEN regexp_extract(tr, '^[0-9]+') ELSE alld END AS dg FROM d)
    SELECT o_orderkey, CASE WHEN dg = '' THEN NULL WHEN ltrim(dg, '0') = '' THEN '0' ELSE ltrim(dg, '0') END AS segment_id,
      CASE WHEN alld = '' THEN NULL WHEN ltrim(alld, '0') = '' THEN '0' ELSE ltrim(alld, '0') END AS segment_id_digits,
      CASE WHEN tr NOT IN ('', 'nan', 'None', '<NA>') THEN tr END AS text_value FROM e""",
)
def normalize_segment_ids(spark, sf):
    p, k = c("o_orderpriority"), c("o_orderkey").cast("string")
    raw = (
        F.when(p == "1-URGENT", F.concat(F.lit(" 00"), k, F.lit(".0 "))).when(p == "2-HIGH", F.concat(F.lit("A-"), k))
        .when(p == "3-MEDIUM", "nan").when(p == "4-NOT SPECIFIED", "000").otherwise(F.concat(c("o_custkey").cast("string"), F.lit(".0")))
    )
    t = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    return t.select(
        "o_orderkey", X.normalize_segment_id(c("raw")).alias("segment_id"),
        X.normalize_segment_id(c("raw"), decimal_rule=False).alias("segment_id_digits"), X.normalize_string(c("raw")).alias("text_value"),
    )


_BORO = "CASE " + " ".join(f"WHEN u = '{k}' THEN '{v}'" for k, v in X.BOROUGH_CODES.items()) + " ELSE u END"
_COUNTY = "CASE " + " ".join(f"WHEN k = '{k}' THEN '{v}'" for k, v in X.COUNTY_BOROUGHS.items()) + " ELSE k END"


@query(
    "normalize_boroughs",
    "F3 P11 P12",
    f"""WITH t AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Kings  county' WHEN 'BUILDING' THEN ' bx ' WHEN 'FURNITURE' THEN 'Richmond' WHEN 'HOUSEHOLD' THEN '  ' ELSE CAST(c_nationkey AS VARCHAR) || '.0' END AS l, CASE WHEN c_acctbal > 5000 THEN 'mn' ELSE ' Queens ' END AS rt FROM customer),
    n AS (SELECT *, upper(trim(l)) AS u, {X.clean_text_sql('l')} AS k FROM t),
    m AS (SELECT *, CASE WHEN u <> '' THEN {_BORO} END AS bl, {_COUNTY} AS county, upper(trim(rt)) AS ru FROM n)
    SELECT c_custkey, bl AS borough_left, coalesce(bl, CASE ru WHEN 'MN' THEN 'MANHATTAN' ELSE ru END) AS segment_borough, county AS county_borough, nullif(u, '') AS upper_borough,
      CASE WHEN trim(l) <> '' THEN l ELSE rt END AS first_text FROM m""",
)
def normalize_boroughs(spark, sf):
    m = c("c_mktsegment")
    left = (
        F.when(m == "AUTOMOBILE", "Kings  county").when(m == "BUILDING", " bx ").when(m == "FURNITURE", "Richmond").when(m == "HOUSEHOLD", "  ")
        .otherwise(F.concat(c("c_nationkey").cast("string"), F.lit(".0")))
    )
    right = F.when(c("c_acctbal") > 5000, "mn").otherwise(" Queens ")
    t = table(spark, sf, "customer").select("c_custkey", left.alias("l"), right.alias("rt"))
    return t.select(
        "c_custkey", X.normalize_borough(c("l")).alias("borough_left"),
        F.coalesce(X.normalize_borough(c("l")), X.normalize_borough(c("rt"))).alias("segment_borough"),
        X.county_borough(c("l")).alias("county_borough"), X.upper_borough(c("l")).alias("upper_borough"),
        X.first_nonempty(c("l"), c("rt")).alias("first_text"),
    )


@query(
    "clean_street_text",
    "F4",
    f"SELECT doc_id, md5({X.clean_text_sql('text')}) AS digest, CAST(length({X.clean_text_sql('text')}) AS BIGINT) AS n FROM documents",
)
def clean_street_text(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", X.clean_text(c("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query(
    "text_predicate",
    "P3 P11",
    """WITH t AS (SELECT page_id, CASE WHEN trim(regexp_replace(html, '<[^>]*>', ' ', 'g')) <> '' THEN html ELSE url END AS txt FROM pages),
    f AS (SELECT page_id, regexp_matches(txt, '(flood|street|water)', 'i') AS hit, regexp_matches(txt, 'no such phrase at all', 'i') AS none FROM t)
    SELECT page_id, hit FROM f WHERE (hit OR NOT (SELECT bool_or(hit) FROM f)) AND (none OR NOT (SELECT bool_or(none) FROM f))""",
)
def text_predicate(spark, sf):
    body = F.when(F.trim(F.regexp_replace("html", "<[^>]*>", " ")) != "", c("html"))
    t = table(spark, sf, "pages").select("page_id", F.coalesce(body, c("url")).alias("txt"))
    f = t.select("page_id", X.contains_any(c("txt"), "(flood|street|water)").alias("hit"), X.contains_any(c("txt"), "no such phrase at all").alias("none"))
    # when nothing matches anywhere, every row is kept
    some = f.agg(F.bool_or("hit").alias("hit"), F.bool_or("none").alias("none"))
    return f.where((c("hit") | ~some.select("hit").scalar()) & (c("none") | ~some.select("none").scalar())).select("page_id", "hit")


@query("descriptor_filter", "P4 P19", "SELECT p_partkey, p_name FROM part WHERE upper(coalesce(p_name, '')) IN ('SMALL RING', 'RED WIDGET', 'LARGE BOLT') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def descriptor_filter(spark, sf):
    keep = F.upper(F.coalesce("p_name", F.lit(""))).isin("SMALL RING", "RED WIDGET", "LARGE BOLT") & c("p_brand").isin("Brand#1", "Brand#2", "Brand#3")
    return table(spark, sf, "part").where(keep).select("p_partkey", "p_name")


@query(
    "local_times",
    "F5",
    """SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS from_utc, date_trunc('second', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS from_zoned,
    date_trunc('second', ts) AS from_naive FROM events""",
)
def local_times(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    zoned = F.when(c("event_type") == "click", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(stamp)
    e = table(spark, sf, "events").select("event_id", c("ts").cast("string").alias("a"), zoned.alias("b"), stamp.alias("n"))
    e = T.to_local_naive(e, "a", "from_utc", assume_utc=True)
    return T.to_local_naive(T.to_local_naive(e, "b", "from_zoned"), "n", "from_naive").select("event_id", "from_utc", "from_zoned", "from_naive")


@query(
    "number_parsing",
    "F6 F7 F8 F9 P14",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 's' WHEN 'N' THEN ' t' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5' END AS raw, l_linestatus, l_extendedprice FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, TRY_CAST(trim(raw) AS DOUBLE) AS number, round(CASE WHEN upper(trim(raw)) = 'T' THEN 0 ELSE TRY_CAST(regexp_replace(upper(trim(raw)), '[^0-9eE+.-]', '', 'g') AS DOUBLE) * 25.4 END, 6) AS depth_mm,
    CASE WHEN l_linestatus = 'O' THEN TRUE WHEN l_linestatus = 'F' THEN FALSE END AS flag, round(l_extendedprice * 0.3048, 6) AS metres, round(l_extendedprice / 1e6, 9) AS km2 FROM t""",
)
def number_parsing(spark, sf):
    q = c("l_quantity").cast("int").cast("string")
    raw = F.when(c("l_returnflag") == "A", F.concat(q, F.lit("s"))).when(c("l_returnflag") == "N", " t").otherwise(F.concat(q, F.lit(".5")))
    flag = F.when(c("l_linestatus") == "O", "true").when(c("l_linestatus") == "F", "0").otherwise("maybe")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", U.safe_numeric(raw).alias("number"), r(U.rain_text_to_mm(raw, "in")).alias("depth_mm"),
        U.safe_boolean(flag).alias("flag"), r(c("l_extendedprice") * U.FT_TO_M).alias("metres"), r(c("l_extendedprice") / 1e6, 9).alias("km2"),
    )


@query(
    "tide_levels",
    "F10 F11",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_tax > 0 THEN 'air_gap_to_tide' ELSE 'air_gap_raw' END WHEN l_returnflag = 'N' THEN 'observed_high_low' ELSE 'observed_hourly' END AS series_kind,
    CASE WHEN l_returnflag = 'A' THEN 'air_gap_m' WHEN l_returnflag = 'N' THEN 'high_low_m' WHEN l_linestatus = 'F' THEN 'water_level_m' ELSE 'level_m' END AS measurement_kind,
    round(CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_tax > 0 THEN l_tax * 1000 END - l_quantity ELSE l_quantity END, 6) AS tide_level_m,
    round(coalesce(CASE WHEN l_discount > 0.05 THEN l_quantity END, l_quantity * 0.3048), 6) AS ladder_m FROM lineitem""",
)
def tide_levels(spark, sf):
    product = F.when(c("l_returnflag") == "A", "air_gap").when(c("l_returnflag") == "N", "high_low").when(c("l_linestatus") == "F", "hourly_height").otherwise("other")
    clearance = F.when(c("l_tax") > 0, c("l_tax") * 1000)
    measured, kind = U.tide_labels(product, clearance)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", kind.alias("series_kind"), measured.alias("measurement_kind"), r(U.tide_level_m(c("l_quantity"), product, clearance)).alias("tide_level_m"),
        r(F.coalesce(F.when(c("l_discount") > 0.05, c("l_quantity")), c("l_quantity") * U.FT_TO_M)).alias("ladder_m"),
    )


@query(
    "street_attributes",
    "P2 P20 F12 F13 F14 F15 F16 F9 N2",
    """SELECT p_partkey, CASE WHEN p_size IN (12, 13) THEN 'highway' WHEN p_size IN (8, 9, 10) THEN 'arterial' WHEN p_size IN (5, 6, 7) THEN 'collector' ELSE 'local' END AS road_class,
    CASE WHEN p_type = 'ECONOMY' THEN 'T' WHEN p_type = 'PROMO' THEN 'W' ELSE 'B' END AS trafdir, p_type NOT IN ('ECONOMY', 'PROMO') AS fallback, coalesce(CASE WHEN p_size > 3 THEN CAST(p_size AS VARCHAR) END, 'missing') AS level,
    round(coalesce(CASE WHEN p_size > 40 THEN p_size * 0.44704 END, CASE WHEN p_size >= 6 THEN 15.0 WHEN p_size >= 3 THEN 10.0 ELSE 6.0 END)::DOUBLE, 6) AS speed,
    round(coalesce(CASE WHEN p_retailprice > 1000 THEN p_retailprice END, 1.0) * 0.3048 / coalesce(CASE WHEN p_size > 40 THEN p_size * 0.44704 END, CASE WHEN p_size >= 6 THEN 15.0 WHEN p_size >= 3 THEN 10.0 ELSE 6.0 END), 6) AS travel_time,
    CASE WHEN p_type = 'SMALL' THEN 'UNKNOWN' WHEN upper(p_type)[1] IN ('A', 'V') THEN 'SFHA' WHEN upper(p_type)[1] = 'X' THEN 'MINIMAL' ELSE 'OTHER' END AS zone_class, lower(p_type) AS road_group
    FROM part WHERE substr(p_name, 1, 1) IN ('s', 'r', 'l') AND p_type <> 'LARGE'""",
)
def street_attributes(spark, sf):
    feature = F.when(F.substring("p_name", 1, 1).isin("s", "r", "l"), "0")
    segment = F.when(c("p_type") != "LARGE", "U")
    p = table(spark, sf, "part").where(L.street_segment(feature, segment))
    size = c("p_size")
    speed = U.speed_ms(F.when(size > 40, size), size)
    length = F.coalesce(F.when(c("p_retailprice") > 1000, c("p_retailprice")), F.lit(1.0)) * U.FT_TO_M
    td = F.when(c("p_type") == "ECONOMY", " t").when(c("p_type") == "PROMO", "W")
    return p.select(
        "p_partkey", L.road_class(size).alias("road_class"), L.direction(td).alias("trafdir"), L.direction_is_fallback(td).alias("fallback"),
        L.level(F.when(size > 3, size)).alias("level"), r(speed).alias("speed"), r(length / speed).alias("travel_time"),
        L.flood_zone_class(F.when(c("p_type") != "SMALL", c("p_type"))).alias("zone_class"), L.road_group(c("p_type")).alias("road_group"),
    )


@query(
    "calendar_labels",
    "F17 F18 F19",
    """WITH o AS (SELECT o_orderkey, o_orderdate + INTERVAL 20 YEAR + INTERVAL 8 MONTH AS d FROM orders)
    SELECT o_orderkey, CAST(extract(year FROM d) AS INTEGER) AS event_year, CAST(extract(month FROM d) AS INTEGER) AS event_month, CAST(extract(hour FROM d) AS INTEGER) AS event_hour,
    CAST((extract(isodow FROM d) - 1) AS INTEGER) AS event_dow, strftime(d, '%Y-%m-%d') AS event_date,
    CASE WHEN extract(month FROM d) IN (12, 1, 2) THEN 'winter' WHEN extract(month FROM d) IN (3, 4, 5) THEN 'spring' WHEN extract(month FROM d) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season,
    CASE WHEN extract(month FROM d) IN (12, 1, 2) THEN 'DJF' WHEN extract(month FROM d) IN (3, 4, 5) THEN 'MAM' WHEN extract(month FROM d) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season_code,
    CASE WHEN d < TIMESTAMP '2014-01-01' THEN 'michael_bloomberg_2002_2013' WHEN d < TIMESTAMP '2022-01-01' THEN 'bill_de_blasio_2014_2021' WHEN d < TIMESTAMP '2026-01-01' THEN 'eric_adams_2022_2025' ELSE 'zohran_mamdani_2026_present' END AS administration FROM o""",
)
def calendar_labels(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (c("o_orderdate") + F.make_ym_interval(F.lit(20), F.lit(8))).alias("d"))
    parts = T.calendar_parts(c("d"))
    return o.select(
        "o_orderkey", *[e.alias(n) for n, e in parts.items()], T.season(F.month("d")).alias("season"),
        T.season(F.month("d"), codes=True).alias("season_code"), T.administration(c("d")).alias("administration"),
    )


@query(
    "census_rates",
    "F21 F22 P13 S17",
    """SELECT c_custkey, printf('%02d', c_nationkey) || printf('%09d', c_custkey) AS geoid,
    round(CASE WHEN round(c_acctbal) = 0 OR c_mktsegment = 'BUILDING' THEN NULL ELSE c_nationkey / (CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL ELSE c_acctbal END) END, 9) AS poverty_rate,
    round(coalesce(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END, CASE WHEN c_acctbal > 0 THEN c_acctbal * 2 END), 6) AS median_income FROM customer""",
)
def census_rates(spark, sf):
    cu = table(spark, sf, "customer")
    den = F.when(c("c_mktsegment") == "BUILDING", 0.0).when(c("c_mktsegment") == "FURNITURE", F.lit(None)).when(F.round("c_acctbal") == 0, 0.0).otherwise(c("c_acctbal"))
    wide = cu.select("c_custkey", c("c_nationkey").alias("B17001_002E"), den.alias("B17001_001E"), F.lit("x").alias("B17001_001EA"), "c_nationkey", "c_mktsegment", "c_acctbal")
    estimates = [n for n in wide.columns if n[-1] == "E" and not n.endswith(("EA", "MA"))]
    wide = wide.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", *[U.safe_numeric(c(n)).alias(n) for n in estimates])
    geoid = F.format_string("%02d%09d", "c_nationkey", "c_custkey")
    income = F.coalesce(F.when(c("c_mktsegment") == "MACHINERY", c("c_acctbal")), F.when(c("c_acctbal") > 0, c("c_acctbal") * 2))
    return wide.select("c_custkey", geoid.alias("geoid"), r(U.safe_ratio(c("B17001_002E"), c("B17001_001E")), 9).alias("poverty_rate"), r(income).alias("median_income"))


@query(
    "confidence_labels",
    "F23 F24 F25 P16",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS d, CASE WHEN l_tax > 0.01 THEN l_returnflag = 'A' END AS st, l_linestatus = 'O' AS sr, l_discount > 0.03 AS sb,
      CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN TRUE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN FALSE END AS occ, l_linenumber FROM lineitem),
    k AS (SELECT *, CASE WHEN d <= 20 AND coalesce(st, FALSE) AND sr THEN 'high' WHEN d <= 20 AND sb AND (coalesce(st, FALSE) OR sr) THEN 'medium' ELSE 'low' END AS lv FROM t)
    SELECT l_orderkey, l_linenumber, l_partkey, lv AS confidence, CASE WHEN l_linenumber > 1 THEN 'multiple' WHEN l_linenumber = 1 THEN 'single' ELSE 'none' END AS match_class,
    CASE WHEN occ IS NULL THEN 'weak_' || lv WHEN occ THEN 'observed_positive' ELSE 'matched_negative' END AS label_strength, occ IS NOT NULL AS include_in_training FROM k""",
)
def confidence_labels(spark, sf):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    occ = F.when(c("l_shipdate") < day("1997-01-01"), True).when(c("l_shipdate") < day("1999-01-01"), False)
    lv = L.confidence(c("l_quantity"), F.when(c("l_tax") > 0.01, c("l_returnflag") == "A"), c("l_linestatus") == "O", c("l_discount") > 0.03)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", lv.alias("confidence"), L.match_class(c("l_linenumber")).alias("match_class"),
        L.label_strength(occ, lv).alias("label_strength"), occ.isNotNull().alias("include_in_training"),
    )


@query(
    "composite_keys",
    "F27 F32 S18",
    """SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, ''), '__NA__') || '|' || coalesce(CASE WHEN o_totalprice > 100000 THEN o_orderpriority END, '__NA__') AS lookup_key,
    substr(sha1(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)), 1, 16) AS content_key,
    CASE o_orderpriority WHEN '1-URGENT' THEN printf('GHCND:%d,%d,COOP:%d,LCD:%d', o_custkey, o_custkey, o_custkey, o_custkey) WHEN '2-HIGH' THEN printf('COOP:%d,GHCND:%d,%d,LCD:%d', o_custkey, o_custkey, o_custkey, o_custkey)
      WHEN '3-MEDIUM' THEN printf('LCD:%d,COOP:%d,GHCND:%d,%d', o_custkey, o_custkey, o_custkey, o_custkey) WHEN '5-LOW' THEN printf('GHCND:%d,COOP:%d,%d,LCD:%d', o_custkey, o_custkey, o_custkey, o_custkey)
      ELSE printf('%d,COOP:%d,GHCND:%d,LCD:%d', o_custkey, o_custkey, o_custkey, o_custkey) END AS aliases FROM orders""",
)
def composite_keys(spark, sf):
    code, p = c("o_custkey").cast("string"), c("o_orderpriority")
    dataset = F.when(p == "1-URGENT", "GHCND").when(p == "2-HIGH", "PRECIP_HLY").when(p == "3-MEDIUM", "LCD").when(p == "5-LOW", "GLOBAL_HOURLY").otherwise("other")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        X.key_with_null_token(F.when(c("o_orderstatus") == "F", "").otherwise(c("o_orderstatus")), F.when(c("o_totalprice") > 100000, c("o_orderpriority"))).alias("lookup_key"),
        X.content_key(c("o_orderkey").cast("string"), c("o_orderstatus"), c("o_orderpriority")).alias("content_key"),
        F.array_join(X.station_aliases(code, dataset), ",").alias("aliases"),
    )


@query(
    "target_transforms",
    "F28 F31",
    """SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS log_target, round(exp(ln(1 + o_totalprice)) - 1, 2) AS back, round(1 / (1 + exp(-(o_totalprice - 200000) / 100000)), 9) AS score,
    round(coalesce(abs(o_totalprice - 150000), 1e9) + coalesce(abs(CASE WHEN o_orderstatus = 'F' THEN o_custkey END - 500), 1e9) / 10 + abs(o_custkey - 700) / 1000.0 + 3 * 10, 6) AS candidate_score FROM orders""",
)
def target_transforms(spark, sf):
    p = c("o_totalprice")
    far = F.lit(1e9)
    shore = F.when(c("o_orderstatus") == "F", c("o_custkey"))
    score = F.coalesce(F.abs(p - 150000), far) + F.coalesce(F.abs(shore - 500), far) / 10 + F.abs(c("o_custkey") - 700) / 1000.0 + 3 * 10
    return table(spark, sf, "orders").select(
        "o_orderkey", r(F.log1p(p), 9).alias("log_target"), r(F.expm1(F.log1p(p)), 2).alias("back"), r(U.sigmoid((p - 200000) / 100000), 9).alias("score"), r(score).alias("candidate_score")
    )


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
#: Payloads of several shapes made from the event rows: direct, nested, in lists, hidden behind a text, absent.
_PAYLOADS = f"""p AS (SELECT event_id, CASE event_id % 5
    WHEN 0 THEN '{{"clearance": "' || {_K} || '", "deep": {{"clearance_ft": 1}}}}'
    WHEN 1 THEN '{{"name": "' || event_type || '", "z": {{"list": [1, {{"a": {{"clearance": "n/a", "b": {{"air_gap_height": ' || {_K} || '}}}}}}, {{"clearance": 7}}]}}, "clearance": null, "b": {{"clearance": -1}}}}'
    WHEN 2 THEN '[{{"x": "{{\\"clearance\\": 5}}"}}, {{"vertical_clearance": ' || value || ', "bridge_clearance": ""}}]'
    WHEN 3 THEN '{{"station": {{"bridge": {{"clearance": {{"clearance": ' || {_K} || '}}}}}}}}'
    ELSE '{{"name": "' || event_type || '", "values": [1, 2, 3]}}' END AS payload FROM events)"""


def _payloads(spark, sf):
    e = table(spark, sf, "events")
    k, v = F.get_json_object("props", "$.k").cast("int").cast("string"), c("value").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shape = F.pmod("event_id", F.lit(5))
    body = (
        F.when(shape == 0, text('{"clearance": "', k, '", "deep": {"clearance_ft": 1}}'))
        .when(shape == 1, text('{"name": "', c("event_type"), '", "z": {"list": [1, {"a": {"clearance": "n/a", "b": {"air_gap_height": ', k, '}}}, {"clearance": 7}]}, "clearance": null, "b": {"clearance": -1}}'))
        .when(shape == 2, text('[{"x": "{\\"clearance\\": 5}"}, {"vertical_clearance": ', v, ', "bridge_clearance": ""}]'))
        .when(shape == 3, text('{"station": {"bridge": {"clearance": {"clearance": ', k, "}}}}"))
        .otherwise(text('{"name": "', c("event_type"), '", "values": [1, 2, 3]}'))
    )
    return e.select("event_id", "event_type", body.alias("payload"))


_PRIORITY = "CASE key " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(CLEARANCE_KEYS)) + " END"


@query(
    "nested_search",
    "F30",
    f"""WITH {_PAYLOADS}, t AS (SELECT event_id, j.parent AS owner, {_PRIORITY} AS rank, CASE WHEN j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN try_cast(json_extract_string(j.value, '$') AS DOUBLE) END AS v FROM p, json_tree(p.payload) j),
    h AS (SELECT event_id, arg_min(v, (owner, rank)) AS v FROM t WHERE rank IS NOT NULL AND v IS NOT NULL GROUP BY 1) SELECT event_id, v AS first_hit, round(v * 0.3048, 6) AS clearance_m FROM p LEFT JOIN h USING (event_id)""",
)
def nested_search(spark, sf):
    hit = deep_find_number(_payloads(spark, sf), "event_id", "payload", CLEARANCE_KEYS, "first_hit")
    return hit.select("event_id", "first_hit", r(c("first_hit") * U.FT_TO_M).alias("clearance_m"))


@query(
    "station_catalog",
    "S27 S8",
    """SELECT CASE WHEN s_suppkey % 3 = 2 THEN 'S' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS station_id, CASE WHEN s_suppkey % 3 = 2 THEN 'fallback' ELSE s_name END AS station_name, 'primary' AS role,
    CASE WHEN s_suppkey % 3 < 2 THEN 40.0::DOUBLE + s_nationkey END AS lat, CASE WHEN s_suppkey % 3 < 2 THEN -74.0::DOUBLE END AS lon, CASE WHEN s_suppkey % 3 = 1 THEN 'NY' END AS state, CASE WHEN s_suppkey % 3 = 0 THEN 'true' END AS tidal,
    CASE WHEN s_suppkey % 3 = 1 THEN 'bridge' END AS station_type, CASE WHEN s_suppkey % 3 < 2 THEN round(s_nationkey * 0.3048::DOUBLE, 6) END AS bridge_clearance_m FROM supplier""",
)
def station_catalog_rows(spark, sf):
    key, nation = c("s_suppkey").cast("string"), c("s_nationkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shape = F.pmod("s_suppkey", F.lit(3))
    name = text('"name": "', c("s_name"), '"')
    body = (
        F.when(shape == 0, text('{"id": "', key, '", ', name, ', "lat": ', (c("s_nationkey") + 40).cast("string"), ', "lng": -74, "tidal": true, "details": {"clearance": ', nation, "}}"))
        .when(shape == 1, text('{"count": 1, "stations": [{"id": "', key, '", ', name, ', "latitude": "', (c("s_nationkey") + 40).cast("string"), '", "longitude": "-74.0", "stateCode": "NY", "type": "bridge", "more": [[{"air_gap_height_ft": ', nation, "}]]}]}"))
        .otherwise(F.lit('{"units": "feet", "stations": []}'))
    )
    s = table(spark, sf, "supplier").select(F.concat(F.lit("S"), key).alias("given"), F.lit("fallback").alias("name"), F.lit("primary").alias("role"), body.alias("payload"))
    return station_catalog(s, "payload", "given", "name", "role").withColumn("bridge_clearance_m", r(c("bridge_clearance_m")))


@query(
    "clean_requests",
    "P1 P5 P6 F6 W1",
    """WITH t AS (SELECT l_orderkey AS unique_key, l_linenumber AS n, l_partkey AS p, l_extendedprice AS x, CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN NULL ELSE l_shipdate END AS created, l_shipdate + (CAST(l_quantity AS BIGINT) - 5) * INTERVAL 1 DAY AS closed,
      CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN NULL ELSE 40.4 + l_quantity / 80 END AS latitude, -74.3 + l_discount * 6.5 AS longitude FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY unique_key ORDER BY n, p, x) AS rn FROM t WHERE created IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL)
    SELECT unique_key, created, CASE WHEN n > 6 THEN NULL ELSE closed END AS closed, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
      coalesce(latitude BETWEEN 40.45 AND 40.95 AND longitude BETWEEN -74.3 AND -73.65, FALSE) AS in_city FROM k WHERE rn = 1 AND (CASE WHEN n > 6 THEN NULL ELSE closed END IS NULL OR created <= closed)""",
)
def clean_requests(spark, sf):
    from eventloom.sources.requests import clean_requests as clean

    l = table(spark, sf, "lineitem")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    raw = l.select(
        c("l_orderkey").alias("unique_key"), c("l_linenumber").alias("n"), c("l_partkey").alias("p"), c("l_extendedprice").alias("x"),
        F.when((c("l_linestatus") == "O") & (c("l_tax") == 0), "not a date").otherwise(stamp).alias("created_date"),
        F.when(c("l_linenumber") > 6, "").otherwise(T.plus_seconds(c("l_shipdate"), (c("l_quantity") - 5) * 86400).cast("string")).alias("closed_date"),
        F.when((c("l_returnflag") == "R") & (c("l_discount") == 0), "n/a").otherwise((40.4 + c("l_quantity") / 80).cast("string")).alias("latitude"),
        (-74.3 + c("l_discount") * 6.5).cast("string").alias("longitude"),
    )
    k = clean(raw, order=[c("n"), c("p"), c("x")]).where(c("closed_date").isNull() | (c("created_date") <= c("closed_date")))
    box = c("latitude").between(40.45, 40.95) & c("longitude").between(-74.3, -73.65)
    return k.select(
        "unique_key", c("created_date").alias("created"), c("closed_date").alias("closed"), r(c("latitude")).alias("latitude"), r(c("longitude")).alias("longitude"),
        F.coalesce(box, F.lit(False)).alias("in_city"),
    )


@query(
    "canonical_projection",
    "P9 P10 P17 P18",
    """SELECT p_partkey AS segment_id, p_name AS street_name, p_type AS street_feature_type, p_retailprice AS segment_length_ft, CAST(p_size AS DOUBLE) AS travel_time, CAST(NULL AS DOUBLE) AS pump_nearest_ft,
    CAST(NULL AS BIGINT) AS giant_component_size_loss, p_brand AS gov_borough FROM part""",
)
def canonical_projection(spark, sf):
    from eventloom.sources.columns import fill_columns, resolve_column

    p = table(spark, sf, "part")
    key = resolve_column(p, ["segment_id", "SegmentID", "P_PARTKEY"])
    view = p.withColumnsRenamed({key: "segment_id", "p_name": "street_name", "p_type": "street_feature_type", "p_retailprice": "segment_length_ft"})
    # canonical columns are filled only where the view lacks them
    view = fill_columns(view, {"travel_time": c("p_size").cast("double"), "street_name": F.lit("never used"), "gov_borough": c("p_brand"),
                               "pump_nearest_ft": F.lit(None).cast("double"), "giant_component_size_loss": F.lit(None).cast("bigint")})
    return view.select("segment_id", "street_name", "street_feature_type", "segment_length_ft", "travel_time", "pump_nearest_ft", "giant_component_size_loss", "gov_borough")


@query(
    "field_presence",
    "P15",
    """SELECT o_orderkey, o_orderstatus <> 'P' AS present_status, o_totalprice > 50000 AS present_price, o_orderstatus <> 'P' AND o_totalprice > 50000 AS has_all_selected_fields FROM orders WHERE o_orderstatus <> 'P' OR o_totalprice > 50000""",
)
def field_presence(spark, sf):
    from eventloom.sources.columns import presence

    o = table(spark, sf, "orders").select("o_orderkey", F.when(c("o_orderstatus") == "P", "  ").otherwise(c("o_orderstatus")).alias("status"), F.when(c("o_totalprice") > 50000, c("o_totalprice")).alias("price"))
    out = presence(o, {"status": True, "price": True})
    return out.where(reduce(lambda a, b: a | b, [c("present_status"), c("present_price")])).select("o_orderkey", "present_status", "present_price", "has_all_selected_fields")
