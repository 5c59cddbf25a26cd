"""Graph queries on networks derived from the whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from eventloom.functions import geometry as G
from eventloom.functions import labels as L
from eventloom.functions.units import speed_ms
from eventloom.operators import graph as N
from eventloom.operators.ordered import global_row_number
from eventloom.plans.registry import query, table
from eventloom.session import pin

c = F.col


def r(e, n=6):
    return F.round(e, n)


# A network with trees and cycles: customers and suppliers hang on nations, nations on regions, every part on
# the suppliers of its dearest and its cheapest line.
NET = """px AS (SELECT l_partkey, arg_max(l_suppkey, (l_extendedprice, l_suppkey)) AS hi, arg_min(l_suppkey, (l_extendedprice, l_suppkey)) AS lo FROM lineitem GROUP BY 1),
net AS (SELECT 'c' || c_custkey AS edge_id, 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey, 'n' || s_nationkey FROM supplier WHERE s_acctbal > 0
  UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'h' || l_partkey, 'p' || l_partkey, 's' || hi FROM px UNION ALL SELECT 'l' || l_partkey, 'p' || l_partkey, 's' || lo FROM px)"""


def network(spark, sf):
    cu, s, n, l = (table(spark, sf, t) for t in ("customer", "supplier", "nation", "lineitem"))
    tag = lambda p, k: F.concat(F.lit(p), c(k).cast("string"))
    edge = lambda d, i, a, b: d.select(i.alias("edge_id"), a.alias("src"), b.alias("dst"))
    price = F.struct("l_extendedprice", "l_suppkey")
    px = l.groupBy("l_partkey").agg(F.max_by("l_suppkey", price).alias("hi"), F.min_by("l_suppkey", price).alias("lo"))
    parts = [
        edge(cu, tag("c", "c_custkey"), tag("c", "c_custkey"), tag("n", "c_nationkey")),
        edge(s.where("s_acctbal > 0"), tag("s", "s_suppkey"), tag("s", "s_suppkey"), tag("n", "s_nationkey")),
        edge(n, tag("n", "n_nationkey"), tag("n", "n_nationkey"), tag("r", "n_regionkey")),
        edge(px, tag("h", "l_partkey"), tag("p", "l_partkey"), tag("s", "hi")),
        edge(px, tag("l", "l_partkey"), tag("p", "l_partkey"), tag("s", "lo")),
    ]
    return reduce(lambda a, b: a.union(b), parts)


CC = f"""WITH RECURSIVE {NET}, sy AS (SELECT src, dst FROM net UNION SELECT dst, src FROM net), nd AS (SELECT DISTINCT src AS node FROM sy),
cc(node, component) USING KEY (node) AS (SELECT node, node FROM nd UNION SELECT sy.dst, min(cc.component) FROM cc JOIN sy ON sy.src = cc.node JOIN recurring.cc AS o ON o.node = sy.dst WHERE cc.component < o.component GROUP BY sy.dst)"""


@query("degrees", "N4 N3", f"WITH {NET}, s AS (SELECT src AS node, 0 AS i, 1 AS o FROM net UNION ALL SELECT dst, 1, 0 FROM net) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS total_degree FROM s GROUP BY 1")
def degrees(spark, sf):
    return N.degrees(network(spark, sf))


@query(
    "directed_edges",
    "N3 F13",
    """WITH t AS (SELECT p_partkey AS id, 'b' || p_brand AS u, 't' || p_size AS v, CASE p_type WHEN 'ECONOMY' THEN 'W' WHEN 'PROMO' THEN 'A' WHEN 'LARGE' THEN 'T' ELSE 'B' END AS dir FROM part)
    SELECT id, u AS src, v AS dst FROM t WHERE dir <> 'A' UNION ALL SELECT id, v, u FROM t WHERE dir <> 'W'""",
)
def directed_edges(spark, sf):
    p = table(spark, sf, "part")
    code = F.when(c("p_type") == "ECONOMY", "W").when(c("p_type") == "PROMO", "A").when(c("p_type") == "LARGE", "t ")
    s = p.select(c("p_partkey").alias("id"), F.concat(F.lit("b"), c("p_brand")).alias("u"), F.concat(F.lit("t"), c("p_size").cast("string")).alias("v"), L.direction(code).alias("dir"))
    return N.directed_edges(s, "dir").drop("dir")


@query("components", "N6", f"{CC} SELECT node, component FROM cc")
def components(spark, sf):
    return N.components(network(spark, sf))


BFS = f"""WITH RECURSIVE {NET}, sy AS (SELECT src, dst FROM net UNION SELECT dst, src FROM net), seed AS (SELECT 's' || s_suppkey AS node, min(s_name) AS label FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000 GROUP BY 1),
bf(node, label, hops) USING KEY (node) AS (SELECT node, label, 0 FROM seed UNION SELECT sy.dst, min(bf.label), min(bf.hops) + 1 FROM bf JOIN sy ON sy.src = bf.node LEFT JOIN recurring.bf AS o ON o.node = sy.dst WHERE o.node IS NULL GROUP BY sy.dst)"""


def _seeds(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal BETWEEN 0 AND 5000")
    return s.select(F.concat(F.lit("s"), c("s_suppkey").cast("string")).alias("node"), c("s_name").alias("label"))


@query("bfs_labels", "N10", f"{BFS} SELECT node, label, hops FROM bf")
def bfs_labels(spark, sf):
    return N.bfs_labels(network(spark, sf), _seeds(spark, sf)).select("node", "label", "hops")


@query(
    "edge_label_propagation",
    "N10 N11",
    f"""{BFS} SELECT edge_id, coalesce(CASE WHEN a.node IS NULL OR (b.hops, b.label) < (a.hops, a.label) THEN b.label ELSE a.label END, 'nearest') AS label, CASE WHEN a.node IS NULL THEN b.hops WHEN b.node IS NULL THEN a.hops ELSE least(a.hops, b.hops) END AS hops, edge_id LIKE 's%' AND seed.node IS NOT NULL AS seed_edge
    FROM net LEFT JOIN bf a ON a.node = src LEFT JOIN bf b ON b.node = dst LEFT JOIN seed ON seed.node = edge_id""",
)
def edge_label_propagation(spark, sf):
    net, seeds = network(spark, sf), _seeds(spark, sf)
    nodes = N.bfs_labels(net, seeds)
    e = N.label_edges(net, nodes, seeds.select(c("node").alias("edge_id")), net.select("edge_id", F.lit("nearest").alias("label")))
    return e.select("edge_id", "label", "hops", "seed_edge")


# A leaf's edge is a bridge and its neighbour, if it has others, an articulation node.  For all else: walks from one end of an edge
# without that edge, and from a node's smallest neighbour without that node.
CUT = f"""{CC}, dg AS (SELECT src AS node, count(*) AS d FROM sy GROUP BY 1), lf AS MATERIALIZED (SELECT node FROM dg WHERE d = 1), core AS MATERIALIZED (SELECT edge_id, src, dst FROM net WHERE src NOT IN (FROM lf) AND dst NOT IN (FROM lf)),
dup AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM net GROUP BY ALL HAVING count(*) > 1),
cs AS MATERIALIZED (SELECT edge_id, src, dst FROM core UNION ALL SELECT edge_id, dst, src FROM core), walk(cut, node) AS (SELECT edge_id, src FROM core UNION SELECT cut, cs.dst FROM walk JOIN cs ON cs.src = node AND cs.edge_id <> cut),
br AS MATERIALIZED (SELECT edge_id FROM net WHERE (src IN (FROM lf) OR dst IN (FROM lf)) AND (least(src, dst), greatest(src, dst)) NOT IN (SELECT (a, b) FROM dup) UNION ALL SELECT edge_id FROM core ANTI JOIN walk ON walk.cut = core.edge_id AND walk.node = core.dst),
nb AS MATERIALIZED (SELECT DISTINCT src AS v, dst AS w FROM cs), go(cut, node) AS (SELECT v, min(w) FROM nb GROUP BY v UNION SELECT cut, nb.w FROM go JOIN nb ON nb.v = node AND nb.w <> cut),
ap AS MATERIALIZED (SELECT node FROM dg WHERE d > 1 AND node IN (SELECT sy.dst FROM sy JOIN lf ON sy.src = lf.node) UNION SELECT nb.v FROM nb ANTI JOIN go ON go.cut = nb.v AND go.node = nb.w)"""
TABLE = """dt AS (SELECT node, count(*) AS deg FROM (SELECT src AS node FROM net UNION ALL SELECT dst FROM net) GROUP BY 1), tn AS (SELECT component, count(*) AS n_nodes, count(ap.node) AS n_articulation, avg(deg) AS mean_degree FROM cc LEFT JOIN ap USING (node) JOIN dt USING (node) GROUP BY 1),
te AS (SELECT component, count(*) AS n_segments, count(br.edge_id) AS n_bridges FROM net JOIN cc ON cc.node = net.src LEFT JOIN br USING (edge_id) GROUP BY 1), tab AS (SELECT * FROM tn JOIN te USING (component))"""


@query("bridge_edges", "N7", f"{CUT} SELECT edge_id FROM br")
def bridge_edges(spark, sf):
    return N.cut_structure(network(spark, sf), articulation=False)["bridges"]


@query("articulation_nodes", "N8", f"{CUT} SELECT node FROM ap")
def articulation_nodes(spark, sf):
    return N.cut_structure(network(spark, sf))["articulation"]


def _component_table(spark, sf):
    net = pin(network(spark, sf))  # read by the cuts, the degrees and the counts
    cut = N.cut_structure(net)
    return N.component_table(cut["components"], net, cut["bridges"], cut["articulation"], N.degrees(net))


@query(
    "component_report",
    "N9 J5",
    f"{CUT}, {TABLE} SELECT component, n_nodes, n_articulation, round(mean_degree, 6) AS mean_degree, n_segments, n_bridges, round(n_nodes / sum(n_nodes) OVER (), 6) AS node_share, n_nodes = max(n_nodes) OVER () AS in_largest FROM tab",
)
def component_report(spark, sf):
    return _component_table(spark, sf).withColumns({k: r(c(k)) for k in ("mean_degree", "node_share")})


@query(
    "connectivity_summary",
    "N9",
    f"""{CUT}, {TABLE}, big AS (SELECT * FROM tab ORDER BY n_nodes DESC, n_segments DESC, component DESC LIMIT 1), tot AS (SELECT CAST(sum(n_segments) AS BIGINT) AS s, CAST(sum(n_nodes) AS BIGINT) AS n, count(*) AS c, CAST(sum(n_bridges) AS BIGINT) AS b, CAST(sum(n_articulation) AS BIGINT) AS a FROM tab)
    SELECT unnest(['segments_total', 'nodes_total', 'weak_components_total', 'largest_component_id', 'largest_component_segments', 'largest_component_share_pct', 'bridge_segments_total', 'bridge_segments_share_pct', 'articulation_nodes_total', 'articulation_nodes_share_pct']) AS metric,
    unnest([s::VARCHAR, n::VARCHAR, c::VARCHAR, component, n_segments::VARCHAR, round(100 * n_segments / s, 2)::VARCHAR, b::VARCHAR, round(100 * b / s, 2)::VARCHAR, a::VARCHAR, round(100 * a / n, 2)::VARCHAR]) AS value FROM tot, big""",
)
def connectivity_summary(spark, sf):
    return N.connectivity_summary(_component_table(spark, sf))


@query("weighted_betweenness", "N5")
def weighted_betweenness(spark, sf):
    l, o, cu, s = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = l.join(o, c("l_orderkey") == c("o_orderkey")).join(cu, c("o_custkey") == c("c_custkey")).join(s, c("l_suppkey") == c("s_suppkey"))
    flow = j.where("c_nationkey <> s_nationkey").groupBy(c("s_nationkey").alias("src"), c("c_nationkey").alias("dst")).agg(F.sum("l_quantity").alias("q"))
    # travel time falls with the flow; about a third of the pairs stay connected
    edges = flow.where(c("q") > flow.agg(F.avg("q")).scalar()).withColumn("weight", F.lit(1e6) / c("q"))
    b = N.betweenness(edges.withColumn("edge_id", F.concat_ws("-", "src", "dst")))
    return b["nodes"].select(c("node").cast("string").alias("id"), F.lit("node").alias("kind"), r(c("betweenness")).alias("value")).union(
        b["edges"].select("edge_id", F.lit("edge"), r(c("edge_betweenness")))
    )


@query(
    "snapped_network",
    "N1 N2 F12 F14 F15",
    """WITH RECURSIVE e AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE) * 1000, 6) AS x1, round(CAST(embedding[2] AS DOUBLE) * 1000, 6) AS y1, round(CAST(embedding[3] AS DOUBLE) * 1000, 6) AS x2, round(CAST(embedding[4] AS DOUBLE) * 1000, 6) AS y2 FROM embeddings),
    n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS edge_id FROM e), lv AS (SELECT *, CASE WHEN label < 5 THEN CASE WHEN label < 2 THEN 'missing' ELSE '1' END ELSE '2' END AS lev FROM n),
    p AS (SELECT 2 * edge_id AS idx, lev, x1 AS x, y1 AS y FROM lv UNION ALL SELECT 2 * edge_id + 1, lev, x2, y2 FROM lv),
    sy AS (SELECT a.idx AS src, b.idx AS dst FROM p a JOIN p b ON a.lev = b.lev AND a.idx <> b.idx AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 12),
    cc(node, component) USING KEY (node) AS (SELECT idx, idx FROM p UNION SELECT sy.dst, min(cc.component) FROM cc JOIN sy ON sy.src = cc.node JOIN recurring.cc AS o ON o.node = sy.dst WHERE cc.component < o.component GROUP BY sy.dst),
    nn AS (SELECT node, dense_rank() OVER (ORDER BY component) - 1 AS node_id FROM cc)
    SELECT edge_id, a.node_id AS u, b.node_id AS v, CASE WHEN label = 8 THEN 'arterial' WHEN label >= 5 AND label < 8 THEN 'collector' WHEN label = 9 THEN 'arterial' ELSE 'local' END AS road_class, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * 0.3048 / CASE WHEN label >= 6 THEN 15.0 WHEN label >= 3 THEN 10.0 ELSE 6.0 END, 6) AS travel_time
    FROM lv JOIN nn a ON a.node = 2 * edge_id JOIN nn b ON b.node = 2 * edge_id + 1""",
)
def snapped_network(spark, sf):
    d = lambda i: F.round(c("embedding")[i].cast("double") * 1000, 6)
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.array(G.point(d(0), d(1)), G.point(d(2), d(3))).alias("line"))
    n = global_row_number(e, ["vec_id"], "rn").withColumn("edge_id", c("rn") - 1)
    lev = L.level(F.when(c("label") < 2, F.lit(None)).when(c("label") < 5, 1).otherwise(2))
    a, b = G.endpoints(c("line"))
    ends = n.select("edge_id", lev.alias("level"), F.explode(F.array(F.struct(F.lit(0).alias("k"), a.alias("p")), F.struct(F.lit(1).alias("k"), b.alias("p")))).alias("e"))
    ends = ends.select("edge_id", c("e.k").alias("k"), (c("edge_id") * 2 + c("e.k")).alias("idx"), "level", c("e.p.x").alias("x"), c("e.p.y").alias("y"))
    nodes = ends.select("edge_id", "k", "idx").join(N.snap_endpoints(ends, 12.0), "idx")
    both = nodes.groupBy("edge_id").agg(F.min_by("node_id", "k").alias("u"), F.max_by("node_id", "k").alias("v"))
    out = n.join(both, "edge_id")
    time = G.line_length(c("line")) * 0.3048 / speed_ms(F.lit(None).cast("double"), c("label"))
    return out.select("edge_id", "u", "v", L.road_class(c("label")).alias("road_class"), r(time).alias("travel_time"))
