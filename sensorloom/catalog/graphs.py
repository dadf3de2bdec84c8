"""Visibility graphs and graph anomaly scores (inventory H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalog.base import EV, indexed_events, query, rounded
from sensorloom.kernels import IDX, attach
from sensorloom.operators import graph, paths, visibility
from sensorloom.session import settle

KEY = "event_type"

PAIR = """pr AS (SELECT a.event_type, a.idx AS src, b.idx AS dst, a.value AS ya, b.value AS yb, (b.value - a.value) / (b.idx - a.idx) AS slope
  FROM ev a JOIN ev b ON a.event_type = b.event_type AND a.idx < b.idx)"""
NVG = f"""{EV}, {PAIR}, nv AS (SELECT event_type, src, dst FROM (SELECT event_type, src, dst, slope,
  max(slope) OVER (PARTITION BY event_type, src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pr) WHERE before IS NULL OR slope > before)"""
HVG_CTE = """hv AS (SELECT event_type, src, dst FROM (SELECT event_type, src, dst, ya, yb,
  max(yb) OVER (PARTITION BY event_type, src ORDER BY dst ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM pr) WHERE top IS NULL OR top < least(ya, yb))"""
HVG = f"{EV}, {PAIR}, {HVG_CTE}"
WNV = """wn AS (SELECT n.*, sqrt((dst - src) ** 2 + (b.value - a.value) ** 2) AS w FROM nv n JOIN ev a ON a.event_type = n.event_type AND a.idx = src JOIN ev b ON b.event_type = n.event_type AND b.idx = dst)"""
ADJ = "adj AS (SELECT event_type, src AS node, dst AS other, w FROM wn UNION ALL SELECT event_type, dst, src, w FROM wn)"
# Egonets by counting: edges of the graph with both ends among a node and its neighbours.
EGO = f"""{NVG}, {WNV}, {ADJ}, dg AS (SELECT event_type, node, count(*) AS degree, sum(w) AS iw FROM adj GROUP BY 1, 2),
opp AS (SELECT x.event_type, x.node, count(*) AS tri, sum(e.w) AS ow FROM adj x JOIN wn e ON e.event_type = x.event_type AND e.src = x.other
  JOIN adj y ON y.event_type = x.event_type AND y.node = x.node AND y.other = e.dst GROUP BY 1, 2),
ego AS (SELECT d.event_type, d.node, degree, degree + 1 AS nodes, degree + coalesce(tri, 0) AS edges, coalesce(tri, 0) AS tri, iw + coalesce(ow, 0) AS weight
  FROM dg d LEFT JOIN opp o ON o.event_type = d.event_type AND o.node = d.node)"""
ODD = f"""{EGO}, ft AS (SELECT event_type, regr_slope(ln(1 + edges), ln(1 + nodes)) AS alpha, regr_intercept(ln(1 + edges), ln(1 + nodes)) AS c FROM ego GROUP BY 1),
od AS (SELECT e.*, alpha, ln(1 + edges) - c - alpha * ln(1 + nodes) AS residual, abs(ln(1 + edges) - c - alpha * ln(1 + nodes)) AS score FROM ego e JOIN ft ON ft.event_type = e.event_type)"""
HEAVY = """fh AS (SELECT event_type, regr_slope(ln(weight), ln(edges)) AS beta, regr_intercept(ln(weight), ln(edges)) AS c FROM ego WHERE weight > 0 AND edges > 0 GROUP BY 1),
hr0 AS (SELECT e.event_type, node, beta, c, ln(weight) - c - beta * ln(edges) AS residual FROM ego e JOIN fh ON fh.event_type = e.event_type),
hs AS (SELECT h.*, abs(residual) / stddev_samp(residual) OVER (PARTITION BY event_type) AS score FROM hr0 h)"""


# Breadth-first search over neighbours nb: distances, numbers of shortest paths and dependencies, level by level.
NEIGHBOURS = "nb AS MATERIALIZED (SELECT event_type, src AS node, dst AS other FROM {0} UNION ALL SELECT event_type, dst, src FROM {0})"
PIVOTS = """pv AS (SELECT event_type, node AS origin FROM (SELECT DISTINCT event_type, node FROM nb)
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('42|' || event_type || '|' || node) DESC, node) <= {0})"""
BFS = """{0}(event_type, origin, node, d) USING KEY (event_type, origin, node) AS (SELECT event_type, origin, {2}, 0 FROM {1} UNION
  SELECT b.event_type, b.origin, n.other, min(b.d + 1) FROM {0} b JOIN nb n ON n.event_type = b.event_type AND n.node = b.node
  LEFT JOIN recurring.{0} r ON r.event_type = b.event_type AND r.origin = b.origin AND r.node = n.other WHERE r.d IS NULL GROUP BY 1, 2, 3)"""
SIGMA = """sg(event_type, origin, node, d, sigma) AS (SELECT event_type, origin, origin, 0, 1.0::DOUBLE FROM pv UNION ALL
  SELECT s.event_type, s.origin, n.other, s.d + 1, sum(s.sigma) FROM sg s JOIN nb n ON n.event_type = s.event_type AND n.node = s.node
  JOIN bf b ON b.event_type = s.event_type AND b.origin = s.origin AND b.node = n.other AND b.d = s.d + 1 GROUP BY 1, 2, 3, 4)"""
DELTA = """de(event_type, origin, node, d, delta) AS (SELECT event_type, origin, node, d, 0.0::DOUBLE FROM sg QUALIFY d = max(d) OVER (PARTITION BY event_type, origin) UNION ALL
  SELECT s.event_type, s.origin, s.node, s.d, coalesce(sum(s.sigma / c.sigma * (1 + t.delta)), 0.0)
  FROM (SELECT DISTINCT event_type, origin, d FROM de) l JOIN sg s ON s.event_type = l.event_type AND s.origin = l.origin AND s.d = l.d - 1
  JOIN nb n ON n.event_type = s.event_type AND n.node = s.node
  LEFT JOIN sg c ON c.event_type = s.event_type AND c.origin = s.origin AND c.node = n.other AND c.d = s.d + 1
  LEFT JOIN de t ON t.event_type = c.event_type AND t.origin = c.origin AND t.node = c.node GROUP BY 1, 2, 3, 4)"""
ROUTES = f"""WITH RECURSIVE {HVG}, {NEIGHBOURS.format('hv')},
en AS (SELECT event_type, min(node) AS first, max(node) AS last FROM nb GROUP BY 1), sr AS (SELECT event_type, unnest([first, last]) AS origin FROM en),
{BFS.format('bf', 'sr', 'origin')}, ab AS (SELECT a.event_type, a.node, a.d + b.d AS d FROM en JOIN bf a ON a.event_type = en.event_type AND a.origin = first JOIN bf b ON b.event_type = en.event_type AND b.origin = last AND b.node = a.node),
hb AS (SELECT ab.event_type, 0 AS origin, node FROM ab JOIN en ON en.event_type = ab.event_type JOIN (SELECT event_type, min(d) AS d FROM ab GROUP BY 1) m ON m.event_type = ab.event_type AND m.d = ab.d),
{BFS.format('nr', 'hb', 'node')}, lb(event_type, node, d, hub) AS (SELECT event_type, node, 0, node FROM hb UNION ALL
  SELECT l.event_type, n.other, l.d + 1, min_by(l.hub, (abs(l.hub - n.other), l.hub)) FROM lb l JOIN nb n ON n.event_type = l.event_type AND n.node = l.node
  JOIN nr r ON r.event_type = l.event_type AND r.node = n.other AND r.d = l.d + 1 GROUP BY 1, 2, 3),
co AS (SELECT l.event_type, l.node, l.hub, h.community FROM lb l JOIN (SELECT event_type, node, row_number() OVER (PARTITION BY event_type ORDER BY node) - 1 AS community FROM hb) h ON h.event_type = l.event_type AND h.node = l.hub)"""


def natural(spark, sf):
    rows = indexed_events(spark, sf)
    return rows, settle(visibility.natural_visibility(rows, KEY, "value"))


def weighted(spark, sf):
    rows, edges = natural(spark, sf)
    return rows, settle(visibility.edge_weights(edges, rows, KEY, "value"))


@query("natural_visibility_edges", f"WITH {NVG} SELECT event_type, src, dst FROM nv")
def natural_visibility_edges(spark, sf):
    return visibility.natural_visibility(indexed_events(spark, sf), KEY, "value")


@query("horizontal_visibility_edges", f"WITH {HVG} SELECT event_type, src, dst FROM hv")
def horizontal_visibility_edges(spark, sf):
    return visibility.horizontal_visibility(indexed_events(spark, sf), KEY, "value")


@query("weighted_edge_summary", f"""
WITH {NVG}, {WNV} SELECT event_type, count(*) AS edges, round(min(w), 6) AS min, round(max(w), 4) AS max, round(avg(w), 6) AS mean, round(median(w), 6) AS median FROM wn GROUP BY 1
""")
def weighted_edge_summary(spark, sf):
    return rounded(rounded(graph.weight_summary(weighted(spark, sf)[1], KEY), 4, ["max"]), 6, ["min", "mean", "median"])


@query("node_degrees", f"WITH {NVG} SELECT event_type, node, count(*) AS degree FROM (SELECT event_type, src AS node FROM nv UNION ALL SELECT event_type, dst FROM nv) GROUP BY 1, 2")
def node_degrees(spark, sf):
    return graph.degrees(natural(spark, sf)[1], KEY)


@query("degree_distribution", f"""
WITH {HVG}, d AS (SELECT event_type, node, count(*) AS degree FROM (SELECT event_type, src AS node FROM hv UNION ALL SELECT event_type, dst FROM hv) GROUP BY 1, 2)
SELECT event_type, degree, count(*) AS nodes FROM d GROUP BY 1, 2
""")
def degree_distribution(spark, sf):
    edges = visibility.horizontal_visibility(indexed_events(spark, sf), KEY, "value")
    return graph.degree_distribution(graph.degrees(edges, KEY), KEY)


def two_kinds(spark, sf, write: bool = True):
    """Natural and horizontal edges; written when they are read more than once."""
    rows = indexed_events(spark, sf)
    edges = visibility.natural_visibility(rows, KEY, "value").withColumn("kind", F.lit("natural"))
    both = edges.unionByName(visibility.horizontal_visibility(rows, KEY, "value").withColumn("kind", F.lit("horizontal")))
    return settle(both) if write else both


KINDS = f"""{NVG}, {HVG_CTE}, al AS (SELECT 'natural' AS kind, * FROM nv UNION ALL SELECT 'horizontal', * FROM hv),
dk AS (SELECT kind, event_type, node, count(*) AS degree FROM (SELECT kind, event_type, src AS node FROM al UNION ALL SELECT kind, event_type, dst FROM al) GROUP BY 1, 2, 3),
mk AS (SELECT kind, event_type, avg(degree) AS mean_degree, min(degree) AS lo, max(degree) AS hi, count(DISTINCT degree) AS uq, count(*) AS nodes FROM dk GROUP BY 1, 2)"""


@query("degree_summary", f"WITH {KINDS} SELECT kind, event_type, lo AS min_degree, hi AS max_degree, uq AS unique_degrees, nodes, round(mean_degree, 6) AS mean_degree FROM mk")
def degree_summary(spark, sf):
    return rounded(graph.degree_summary(graph.degrees(two_kinds(spark, sf), ["kind", KEY]), ["kind", KEY]))


@query("degree_rollup", f"""
WITH {KINDS} SELECT 'kind' AS dimension, kind AS member, count(*) AS graphs, round(avg(mean_degree), 6) AS mean FROM mk GROUP BY kind
UNION ALL SELECT 'event_type', event_type, count(*), round(avg(mean_degree), 6) FROM mk GROUP BY event_type
""")
def degree_rollup(spark, sf):
    means = graph.degree_summary(graph.degrees(two_kinds(spark, sf), ["kind", KEY]), ["kind", KEY])
    return rounded(graph.degree_rollup(means, ["kind", KEY]))


@query("degree_reduction", f"""
WITH {KINDS} SELECT n.event_type, round(n.mean_degree, 6) AS natural, round(h.mean_degree, 6) AS horizontal, round((n.mean_degree - h.mean_degree) / n.mean_degree * 100, 6) AS reduction_pct
FROM mk n JOIN mk h ON n.event_type = h.event_type AND n.kind = 'natural' AND h.kind = 'horizontal'
""")
def degree_reduction(spark, sf):
    means = graph.degree_summary(graph.degrees(two_kinds(spark, sf), ["kind", KEY]), ["kind", KEY])
    return rounded(graph.reduction(means, KEY))


@query("local_clustering", f"WITH {EGO} SELECT event_type, node, round(CASE WHEN degree < 2 THEN 0 ELSE tri / (degree * (degree - 1) / 2) END, 6) AS local_clustering_coefficient FROM ego")
def local_clustering(spark, sf):
    return rounded(graph.clustering(natural(spark, sf)[1], KEY))


@query("sampled_betweenness", f"""
WITH RECURSIVE {NVG}, {NEIGHBOURS.format('nv')}, {PIVOTS.format(1500)}, {BFS.format('bf', 'pv', 'origin')}, {SIGMA}, {DELTA},
sz AS (SELECT event_type, count(DISTINCT node) AS n FROM nb GROUP BY 1), pc AS (SELECT event_type, count(*) AS p FROM pv GROUP BY 1)
SELECT de.event_type, node, round(sum(CASE WHEN node <> origin THEN delta ELSE 0 END) * any_value(n) / any_value(p) / ((any_value(n) - 1) * (any_value(n) - 2)), 9) + 0.0 AS betweenness_centrality
FROM de JOIN sz ON sz.event_type = de.event_type JOIN pc ON pc.event_type = de.event_type GROUP BY 1, 2
""")
def sampled_betweenness(spark, sf):
    return rounded(paths.betweenness(natural(spark, sf)[1], KEY), 9)


@query("sampled_closeness", f"""
WITH RECURSIVE {NVG}, {NEIGHBOURS.format('nv')}, {PIVOTS.format(2000)}, {BFS.format('bf', 'pv', 'origin')}
SELECT event_type, node, round(count(*) / sum(d), 9) AS closeness_centrality FROM bf WHERE d > 0 GROUP BY 1, 2
""")
def sampled_closeness(spark, sf):
    return rounded(paths.closeness(natural(spark, sf)[1], KEY), 9)


@query("horizontal_betweenness", f"""
WITH RECURSIVE {HVG}, {NEIGHBOURS.format('hv')}, pv AS (SELECT DISTINCT event_type, node AS origin FROM nb), {BFS.format('bf', 'pv', 'origin')}, {SIGMA}, {DELTA},
sz AS (SELECT event_type, count(DISTINCT node) AS n FROM nb GROUP BY 1), pc AS (SELECT event_type, count(*) AS p FROM pv GROUP BY 1)
SELECT de.event_type, node, round(sum(CASE WHEN node <> origin THEN delta ELSE 0 END) * any_value(n) / any_value(p) / ((any_value(n) - 1) * (any_value(n) - 2)), 9) + 0.0 AS betweenness_centrality
FROM de JOIN sz ON sz.event_type = de.event_type JOIN pc ON pc.event_type = de.event_type GROUP BY 1, 2
""")
def horizontal_betweenness(spark, sf):
    """Horizontal graphs, a third of whose nodes are inside chains; all nodes are pivots, so the result is exact."""
    return rounded(paths.betweenness(settle(visibility.horizontal_visibility(indexed_events(spark, sf), KEY, "value")), KEY, None), 9)


@query("egonet_features", f"WITH {EGO} SELECT event_type, node, degree, nodes AS egonet_nodes, edges AS egonet_edges, round(weight, 4) AS egonet_total_weight FROM ego")
def egonet_features(spark, sf):
    return rounded(graph.egonets(weighted(spark, sf)[1], KEY), 4)


@query("oddball_clique_star", f"""
WITH {ODD} SELECT event_type, node, round(alpha, 6) AS alpha, round(residual, 6) + 0.0 AS residual, round(score, 6) AS oddball_score,
  rank() OVER (PARTITION BY event_type ORDER BY score DESC) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2 AS oddball_rank FROM od
""")
def oddball_clique_star(spark, sf):
    out = graph.oddball(graph.egonets(natural(spark, sf)[1], KEY), KEY)
    return rounded(out.select(KEY, "node", "alpha", "residual", "oddball_score", "oddball_rank"))


@query("oddball_heavy_vicinity", f"WITH {EGO}, {HEAVY} SELECT event_type, node, round(beta, 6) AS beta, round(residual, 6) + 0.0 AS residual, round(score, 6) AS oddball_score FROM hs")
def oddball_heavy_vicinity(spark, sf):
    out = graph.heavy_vicinity(graph.egonets(weighted(spark, sf)[1], KEY), KEY)
    return rounded(out.select(KEY, "node", "beta", "residual", "oddball_score"))


@query("oddball_dominant_pair")
def oddball_dominant_pair(spark, sf):
    return graph.dominant_pair(weighted(spark, sf)[1], KEY).select(KEY, "node", "lambda", "residual", "oddball_score")


@query("rescored_without_top", f"""
WITH {ODD}, tp AS (SELECT event_type, node FROM od QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, node) <= 2),
n2 AS (SELECT nv.event_type, src, dst, 1.0 AS w FROM nv WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.event_type = nv.event_type AND (tp.node = src OR tp.node = dst))),
a2 AS (SELECT event_type, src AS node, dst AS other FROM n2 UNION ALL SELECT event_type, dst, src FROM n2),
t2 AS (SELECT x.event_type, x.node, count(*) AS tri FROM a2 x JOIN n2 e ON e.event_type = x.event_type AND e.src = x.other JOIN a2 y ON y.event_type = x.event_type AND y.node = x.node AND y.other = e.dst GROUP BY 1, 2),
d2 AS (SELECT event_type, node, count(*) AS d FROM a2 GROUP BY 1, 2),
e2 AS (SELECT d2.event_type, d2.node, d + 1 AS nodes, d + coalesce(tri, 0) AS edges FROM d2 LEFT JOIN t2 ON t2.event_type = d2.event_type AND t2.node = d2.node),
f2 AS (SELECT event_type, regr_slope(ln(1 + edges), ln(1 + nodes)) AS alpha, regr_intercept(ln(1 + edges), ln(1 + nodes)) AS c, count(*) AS n FROM e2 GROUP BY 1)
SELECT event_type, 'after' AS round, n, round(alpha, 6) AS alpha FROM f2 UNION ALL SELECT event_type, 'before', count(*), round(any_value(alpha), 6) FROM od GROUP BY 1
""")
def rescored_without_top(spark, sf):
    out = graph.rescore_without_top(natural(spark, sf)[1], KEY, 2)
    return rounded(out.groupBy(KEY, "round").agg(F.count(F.lit(1)).alias("n"), F.first("alpha").alias("alpha")))


@query("oddball_with_lof", f"""
WITH {ODD}, pd AS (SELECT a.event_type, a.node, b.node AS o, sqrt((a.nodes - b.nodes) ** 2 + (a.edges - b.edges) ** 2) AS d FROM ego a JOIN ego b ON a.event_type = b.event_type AND a.node <> b.node),
nn AS (SELECT *, row_number() OVER (PARTITION BY event_type, node ORDER BY d, o) AS rn FROM pd QUALIFY rn <= 20), kd AS (SELECT event_type, node, max(d) AS kd FROM nn GROUP BY 1, 2),
ld AS (SELECT nn.event_type, nn.node, 1 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.event_type = nn.event_type AND kd.node = nn.o GROUP BY 1, 2),
lf AS (SELECT nn.event_type, nn.node, avg(o.lrd) / any_value(m.lrd) AS lof FROM nn JOIN ld o ON o.event_type = nn.event_type AND o.node = nn.o JOIN ld m ON m.event_type = nn.event_type AND m.node = nn.node GROUP BY 1, 2),
mm AS (SELECT od.event_type, min(score) AS s0, max(score) AS s1, min(lof) AS l0, max(lof) AS l1 FROM od JOIN lf ON lf.event_type = od.event_type AND lf.node = od.node GROUP BY 1)
SELECT od.event_type, od.node, round(score, 6) AS oddball_score, round(ln(lof), 6) + 0.0 AS log_lof,
  round((coalesce((score - s0) / nullif(s1 - s0, 0), 0) + coalesce((lof - l0) / nullif(l1 - l0, 0), 0)) / 2, 6) AS combined
FROM od JOIN lf ON lf.event_type = od.event_type AND lf.node = od.node JOIN mm ON mm.event_type = od.event_type
""")
def oddball_with_lof(spark, sf):
    """Clique/star score and LOF of the egonets of each graph, both scaled and averaged; factors span many orders, so their logarithm is shown."""
    scores = graph.oddball(graph.egonets(natural(spark, sf)[1], KEY), KEY)
    return rounded(graph.oddball_with_lof(scores, 20, KEY).select(KEY, "node", "oddball_score", F.ln("lof").alias("log_lof"), "combined"))


@query("residual_branches")
def residual_branches(spark, sf):
    scored = graph.heavy_vicinity(graph.egonets(weighted(spark, sf)[1], KEY), KEY)
    return graph.branches(scored, KEY, log_edges_above=1.5, n_branches=3, min_points=200, min_cluster=10)


@query("top_overlap_zones", f"""
WITH {ODD}, {HEAVY}, ta AS (SELECT event_type, node FROM od QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, node) <= 100),
tb AS (SELECT event_type, node FROM hs QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, node) <= 100),
cm AS (SELECT * FROM ta INTERSECT SELECT * FROM tb),
z AS (SELECT *, sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY node) AS zone FROM (SELECT *, node - lag(node) OVER (PARTITION BY event_type ORDER BY node) AS gap FROM cm)),
zc AS (SELECT event_type, count(*) AS k FROM (SELECT event_type, zone FROM z GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
oc AS (SELECT event_type, count(*) AS c FROM cm GROUP BY 1), ca AS (SELECT event_type, count(*) AS n FROM ta GROUP BY 1)
SELECT ca.event_type, coalesce(c, 0) AS overlap_count, coalesce(c, 0)::DOUBLE AS overlap_pct, n - coalesce(c, 0) AS only_a, n - coalesce(c, 0) AS only_b, coalesce(k, 0) AS num_zones
FROM ca LEFT JOIN oc ON oc.event_type = ca.event_type LEFT JOIN zc ON zc.event_type = ca.event_type
""")
def top_overlap_zones(spark, sf):
    ego = settle(graph.egonets(weighted(spark, sf)[1], KEY))
    return graph.top_overlap(graph.oddball(ego, KEY), graph.heavy_vicinity(ego, KEY), KEY)


@query("score_vs_degree", f"""
WITH {ODD} SELECT event_type, count(*) AS nodes, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max, round(avg(score), 6) AS score_mean, min(degree) AS measure_min,
  max(degree) AS measure_max, round(avg(degree), 6) AS measure_mean, round(corr(score, degree), 6) AS r FROM od GROUP BY 1
""")
def score_vs_degree(spark, sf):
    edges = natural(spark, sf)[1]
    return rounded(graph.score_vs(graph.oddball(graph.egonets(edges, KEY), KEY), graph.degrees(edges, KEY), KEY, "oddball_score", "degree"))


@query("top_nodes_on_series", f"""
WITH {ODD}, t AS (SELECT event_type, node, score, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, node) AS position FROM od QUALIFY position <= 20)
SELECT t.event_type, node, round(score, 6) AS oddball_score, position, ev.idx, ev.value FROM t JOIN ev ON ev.event_type = t.event_type AND ev.idx = t.node
""")
def top_nodes_on_series(spark, sf):
    rows, edges = natural(spark, sf)
    scores = graph.oddball(graph.egonets(edges, KEY), KEY)
    out = graph.top_nodes_on_series(scores, rows, KEY, "value", k=20)
    return rounded(out.withColumn("position", F.col("position").cast("bigint")))


@query("average_edge_overlap", f"""
WITH {KINDS}, c AS (SELECT kind, src, dst, count(*) AS c FROM al GROUP BY 1, 2, 3), l AS (SELECT kind, count(DISTINCT event_type) AS m FROM al GROUP BY 1)
SELECT c.kind, count(*) AS distinct_edges, CAST(sum(c) AS BIGINT) AS total_edges, any_value(m) AS layers, round(sum(c) / (any_value(m) * count(*)), 6) AS average_edge_overlap FROM c JOIN l ON l.kind = c.kind GROUP BY 1
""")
def average_edge_overlap(spark, sf):
    return rounded(graph.edge_overlap(two_kinds(spark, sf, write=False), KEY, "kind"))


def horizontal_members(spark, sf):
    rows = indexed_events(spark, sf)
    return rows, settle(paths.communities(settle(visibility.horizontal_visibility(rows, KEY, "value")), KEY))


@query("path_communities", f"{ROUTES} SELECT event_type, node, hub, community FROM co")
def path_communities(spark, sf):
    return horizontal_members(spark, sf)[1]


@query("community_sizes_and_bands", f"""
{ROUTES} SELECT event_type, community, count(*) AS size, count(*) AS rows, min(node) AS first, max(node) AS last FROM co GROUP BY 1, 2
""")
def community_sizes_and_bands(spark, sf):
    rows, members = horizontal_members(spark, sf)
    bands = graph.community_bands(rows, members, KEY)
    sizes = graph.community_sizes(members, KEY)
    counted = bands.groupBy(KEY, "community").agg(F.count(F.lit(1)).alias("rows"), F.min(IDX).alias("first"), F.max(IDX).alias("last"))
    return attach(sizes, counted, [KEY, "community"])


@query("normalised_series", """
SELECT event_type, event_id, round((value - avg(value) OVER p) / stddev_samp(value) OVER p, 6) + 0.0 AS normalised FROM events WINDOW p AS (PARTITION BY event_type)
""")
def normalised_series(spark, sf):
    return rounded(graph.normalised_view(indexed_events(spark, sf), KEY, "value").select(KEY, "event_id", "normalised"))
