"""Graph measures and anomaly scores on edge tables ``(keys…, src, dst[, weight])``, src < dst."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sensorloom.kernels import IDX, attach, attach_stats, average_ranks, medians, names
from sensorloom.operators.neighbours import lof
from sensorloom.operators.scale import combine_scores
from sensorloom.session import settle


def both_ways(edges: DataFrame, keys) -> DataFrame:
    """Each edge once from either end: ``(keys…, node, other[, weight])``."""
    rest = [c for c in edges.columns if c not in (*names(keys), "src", "dst")]
    one = edges.select(*names(keys), F.col("src").alias("node"), F.col("dst").alias("other"), *rest)
    return one.unionByName(edges.select(*names(keys), F.col("dst").alias("node"), F.col("src").alias("other"), *rest))


def weight_summary(edges: DataFrame, keys) -> DataFrame:
    by = names(keys)
    base = edges.groupBy(*by).agg(
        F.count(F.lit(1)).alias("edges"), F.min("weight").alias("min"), F.max("weight").alias("max"), F.avg("weight").alias("mean"))
    return attach(base, medians(edges, by, "weight", "median"), by)


def degrees(edges: DataFrame, keys) -> DataFrame:
    return both_ways(edges, keys).groupBy(*names(keys), "node").agg(F.count(F.lit(1)).alias("degree"))


def degree_distribution(degree: DataFrame, keys) -> DataFrame:
    return degree.groupBy(*names(keys), "degree").agg(F.count(F.lit(1)).alias("nodes"))


def degree_summary(degree: DataFrame, keys) -> DataFrame:
    return degree_distribution(degree, keys).groupBy(*names(keys)).agg(
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.count(F.lit(1)).alias("unique_degrees"),
        F.sum("nodes").alias("nodes"), (F.sum(F.col("degree") * F.col("nodes")) / F.sum("nodes")).alias("mean_degree"))


def degree_rollup(means: DataFrame, dimensions: Sequence[str], value: str = "mean_degree") -> DataFrame:
    """Mean over graphs for each single dimension: ``(dimension, member, graphs, mean)``."""
    sets = means.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions])
    out = sets.agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("graphs"), F.avg(value).alias("mean"))
    full = (1 << len(dimensions)) - 1
    name, member = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        only = F.col("_g") == full - (1 << (len(dimensions) - 1 - i))
        name = F.when(only, d).otherwise(name)
        member = F.when(only, F.col(d).cast("string")).otherwise(member)
    return out.select(name.alias("dimension"), member.alias("member"), "graphs", "mean")


def reduction(means: DataFrame, keys, kind: str = "kind", value: str = "mean_degree") -> DataFrame:
    """How much lower (%) the horizontal graph's mean degree is than the natural one's."""
    wide = means.groupBy(*names(keys)).pivot(kind, ["natural", "horizontal"]).agg(F.max(value))
    return wide.withColumn("reduction_pct", (F.col("natural") - F.col("horizontal")) / F.col("natural") * 100)


def triangles(edges: DataFrame, keys) -> DataFrame:
    """Every triangle once: ``(keys…, a, b, c, w_ab, w_ac, w_bc)``.

    Edges point from the lower-degree end, which bounds every out-list by
    √(2·edges) even at hubs.  Two edges out of one node are a wedge, and an edge between their ends closes it: two
    equi-joins of plain edge rows.
    """
    by = names(keys)
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    deg = settle(degrees(edges, by))
    rows = edges.select(*by, "src", "dst", weight.alias("w"))
    rows = attach(rows, deg.select(*by, F.col("node").alias("src"), F.col("degree").alias("_ds")), [*by, "src"])
    rows = attach(rows, deg.select(*by, F.col("node").alias("dst"), F.col("degree").alias("_dd")), [*by, "dst"])
    ahead = F.struct("_ds", "src") < F.struct("_dd", "dst")
    low, high = (lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))), (lambda a, b: F.when(ahead, F.col(b)).otherwise(F.col(a)))
    out = settle(rows.select(*by, low("src", "dst").alias("a"), high("src", "dst").alias("b"), high("_ds", "_dd").alias("_db"), "w"))
    # joins compare plain node numbers; degrees only order the ends of a wedge
    other = out.select(*by, "a", F.col("b").alias("c"), F.col("_db").alias("_dc"), F.col("w").alias("w_ac"))
    wedges = attach(out.withColumnRenamed("w", "w_ab"), other, [*by, "a"]).where(F.struct("_db", "b") < F.struct("_dc", "c")).drop("_db", "_dc")
    closing = out.select(*by, F.col("a").alias("b"), F.col("b").alias("c"), F.col("w").alias("w_bc"))
    return attach(wedges, closing, [*by, "b", "c"]).select(*by, "a", "b", "c", "w_ab", "w_ac", "w_bc")


def triangles_at(edges: DataFrame, keys, found: DataFrame | None = None) -> DataFrame:
    """Triangles and the total weight of opposite edges at each node."""
    found = triangles(edges, keys) if found is None else found
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("w_bc").alias("w")), F.struct(F.col("b").alias("node"), F.col("w_ac").alias("w")),
        F.struct(F.col("c").alias("node"), F.col("w_ab").alias("w"))))
    long = found.select(*names(keys), ends.alias("e")).select(*names(keys), "e.*")
    return long.groupBy(*names(keys), "node").agg(F.count(F.lit(1)).alias("triangles"), F.sum("w").alias("opposite_weight"))


def clustering(edges: DataFrame, keys) -> DataFrame:
    """Local clustering coefficient; nodes with fewer than two neighbours get 0."""
    by = names(keys)
    rows = attach(degrees(edges, by), triangles_at(edges, by).select(*by, "node", "triangles"), [*by, "node"], "left")
    d = F.col("degree")
    value = F.when(d < 2, 0.0).otherwise(F.coalesce("triangles", F.lit(0)) / (d * (d - 1) / 2))
    return rows.select(*by, "node", value.alias("local_clustering_coefficient"))


def egonets(edges: DataFrame, keys, found: DataFrame | None = None) -> DataFrame:
    """Egonet of each node: members, edges and total weight (all weights 1 without a weight column)."""
    by = names(keys)
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    incident = both_ways(weighted, by).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("_w"))
    rows = attach(incident, triangles_at(weighted, by, found), [*by, "node"], "left")
    extra = F.coalesce("triangles", F.lit(0))
    return rows.select(
        *by, "node", "degree", (F.col("degree") + 1).alias("egonet_nodes"), (F.col("degree") + extra).alias("egonet_edges"),
        (F.col("_w") + F.coalesce("opposite_weight", F.lit(0.0))).alias("egonet_total_weight"))


def _fit_line(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    line = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return attach_stats(df, line, by)


def oddball(ego: DataFrame, keys) -> DataFrame:
    """Clique/star score: distance from the power law edges ~ nodes^alpha, with its average rank."""
    by = names(keys)
    rows = ego.withColumn("log_nodes", F.log1p("egonet_nodes")).withColumn("log_edges", F.log1p("egonet_edges"))
    rows = _fit_line(rows, by, "log_edges", "log_nodes").withColumnRenamed("slope", "alpha")
    rows = rows.withColumn("predicted_log_edges", F.col("intercept") + F.col("alpha") * F.col("log_nodes"))
    rows = rows.withColumn("residual", F.col("log_edges") - F.col("predicted_log_edges")).withColumn("oddball_score", F.abs("residual"))
    return average_ranks(rows, by, "oddball_score", "oddball_rank", ascending=False)


def oddball_scaled(df: DataFrame, keys, y: str, x: str, min_nodes: int = 10) -> DataFrame:
    """Residual of ln y ~ ln x in sample deviations; graphs with too few positive nodes and invalid nodes score 0."""
    by = names(keys)
    good = (F.col(x) > 0) & (F.col(y) > 0)
    rows = df.withColumn("log_x", F.when(good, F.ln(x))).withColumn("log_y", F.when(good, F.ln(y)))
    rows = _fit_line(rows, by, "log_y", "log_x").withColumnRenamed("slope", "beta")
    rows = rows.withColumn("predicted_log_y", F.col("intercept") + F.col("beta") * F.col("log_x"))
    rows = rows.withColumn("residual", F.col("log_y") - F.col("predicted_log_y"))
    spread = rows.groupBy(*by).agg(F.stddev_samp("residual").alias("_s"), F.count("residual").alias("_n"))
    rows = attach_stats(rows, spread, by)
    score = F.when(F.col("_n") >= min_nodes, F.try_divide(F.abs("residual"), F.col("_s")))
    return rows.withColumn("oddball_score", F.coalesce(score, F.lit(0.0))).drop("_s", "_n")


def heavy_vicinity(ego: DataFrame, keys, min_nodes: int = 10) -> DataFrame:
    """Total weight against edges of the egonet."""
    return oddball_scaled(ego, keys, "egonet_total_weight", "egonet_edges", min_nodes)


STEPS_LOCAL, STEPS_CLUSTER = 200_000, 1000
DENSE_NODES, DENSE_CELLS = 256, 4_000_000


def _largest_eigenvalue(rows: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> float:
    members, at = np.unique(np.r_[rows, cols], return_inverse=True)
    n, m = len(members), len(rows)
    i, j = at[:m], at[m:]
    x, value = np.full(n, 1 / np.sqrt(n)), 0.0
    shift = weights.max()
    for _ in range(STEPS_LOCAL):
        y = shift * x + np.bincount(i, weights * x[j], n) + np.bincount(j, weights * x[i], n)
        size = np.linalg.norm(y)
        x = y / size
        if abs(size - shift - value) <= 1e-13 * size:
            return float(size - shift)
        value = size - shift
    raise RuntimeError(f"the eigenvalue of an egonet with {m} edges did not settle in {STEPS_LOCAL} steps")


def _largest_eigenvalues(u, v, w) -> np.ndarray:
    """The largest eigenvalue of each egonet, given as lists of ends and weights.

    Egonets of up to ``DENSE_NODES`` nodes are matrices, those of one size solved together; the rest is iterated.
    """
    sizes = np.array([len(x) for x in u])
    out, row = np.empty(len(sizes)), np.repeat(np.arange(len(sizes)), sizes)
    ends, weights = [np.concatenate([np.asarray(x) for x in side]) for side in (u, v)], np.concatenate([np.asarray(x, float) for x in w])
    rows, ids = np.r_[row, row], np.r_[ends[0], ends[1]]
    order = np.lexsort((ids, rows))
    new = np.r_[True, (np.diff(rows[order]) != 0) | (np.diff(ids[order]) != 0)]
    members = np.bincount(rows[order][new], minlength=len(sizes))
    at = np.empty(len(rows), int)
    at[order] = np.cumsum(new) - 1
    at -= (np.cumsum(members) - members)[rows]
    i, j, starts = at[: len(row)], at[len(row) :], np.r_[0, np.cumsum(sizes)]
    dense = members <= DENSE_NODES
    for k in np.flatnonzero(~dense):
        part = slice(starts[k], starts[k + 1])
        out[k] = _largest_eigenvalue(ends[0][part], ends[1][part], weights[part])
    by_size = np.flatnonzero(dense)[np.argsort(members[dense], kind="stable")]
    for same in np.split(by_size, np.flatnonzero(np.diff(members[by_size])) + 1) if len(by_size) else []:
        n = int(members[same[0]])
        step = max(1, DENSE_CELLS // (n * n))
        for s in range(0, len(same), step):
            some = same[s : s + step]
            lengths = sizes[some]
            local = np.repeat(np.arange(len(some)), lengths)
            edge = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[some][local]
            cells = np.r_[(local * n + i[edge]) * n + j[edge], (local * n + j[edge]) * n + i[edge]]
            full = np.bincount(cells, np.r_[weights[edge], weights[edge]], len(some) * n * n).reshape(len(some), n, n)
            out[some] = np.linalg.eigvalsh(full)[:, -1]
    return out


def ego_edges(edges: DataFrame, keys, found: DataFrame | None = None) -> DataFrame:
    """Edges of every egonet: ``(keys…, ego, u, v, weight)``."""
    by = names(keys)
    found = triangles(edges, by) if found is None else found
    star = both_ways(edges, by).select(*by, F.col("node").alias("ego"), F.col("node").alias("u"), F.col("other").alias("v"), "weight")
    rims = F.explode(F.array(
        F.struct(F.col("a").alias("ego"), F.col("b").alias("u"), F.col("c").alias("v"), F.col("w_bc").alias("weight")),
        F.struct(F.col("b").alias("ego"), F.col("a").alias("u"), F.col("c").alias("v"), F.col("w_ac").alias("weight")),
        F.struct(F.col("c").alias("ego"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("w_ab").alias("weight"))))
    return star.unionByName(found.select(*by, rims.alias("e")).select(*by, "e.*"))


def ego_eigenvalues(edges: DataFrame, keys, max_edges: int = 50_000, tolerance: float = 1e-10, found: DataFrame | None = None) -> DataFrame:
    """Largest eigenvalue of each weighted egonet: ``(keys…, node, lambda)``.

    Egonets up to ``max_edges`` are solved one per group; larger hubs by power
    iteration spread over (hub, member) rows.
    """
    by = names(keys)
    listed = settle(ego_edges(edges, by, found))
    sizes = settle(listed.groupBy(*by, "ego").agg(F.count(F.lit(1)).alias("_n")))

    @F.pandas_udf(T.DoubleType())
    def solve(u: pd.Series, v: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series(_largest_eigenvalues(u, v, w) if len(u) else [], dtype="float64")

    small = attach(listed, sizes.where(F.col("_n") <= max_edges), [*by, "ego"]).drop("_n")
    packed = small.groupBy(*by, F.col("ego").alias("node")).agg(*[F.collect_list(c).alias(c) for c in ("u", "v", "weight")])
    out = packed.select(*by, "node", solve("u", "v", "weight").alias("lambda"))
    hubs = sizes.where(F.col("_n") > max_edges)
    if hubs.isEmpty():
        return out
    links = attach(listed, hubs, [*by, "ego"]).drop("_n")
    links = settle(links.select(*by, "ego", "u", "v", "weight").unionByName(
        links.select(*by, "ego", F.col("v").alias("u"), F.col("u").alias("v"), "weight")))
    members = links.select(*by, "ego", "u").distinct()
    shift = settle(links.groupBy(*by, "ego").agg(F.max("weight").alias("_shift")))
    x = settle(members.withColumn("x", F.lit(1.0)))
    last, values = None, None
    for _ in range(STEPS_CLUSTER):
        moved = attach(links, x.select(*by, "ego", F.col("u").alias("v"), F.col("x").alias("_x")), [*by, "ego", "v"])
        moved = moved.groupBy(*by, "ego", "u").agg(F.sum(F.col("weight") * F.col("_x")).alias("_ax"))
        stepped = attach(attach(x, moved, [*by, "ego", "u"]), shift, [*by, "ego"])
        stepped = settle(stepped.withColumn("y", F.col("_ax") + F.col("_shift") * F.col("x")))
        values = settle(stepped.groupBy(*by, "ego").agg(
            (F.sqrt(F.sum(F.col("y") * F.col("y")) / F.sum(F.col("x") * F.col("x"))) - F.first("_shift")).alias("lambda"),
            F.max(F.abs("y")).alias("_top")))
        x = settle(attach(stepped, values, [*by, "ego"]).select(*by, "ego", "u", (F.col("y") / F.col("_top")).alias("x")))
        if last is not None:
            drift = attach(values, last.select(*by, "ego", F.col("lambda").alias("_l")), [*by, "ego"])
            worst = drift.agg(F.max(F.abs(F.col("lambda") - F.col("_l")) / F.col("lambda"))).first()[0]
            if worst is None or worst <= tolerance:
                break
        last = values
    else:
        raise RuntimeError(f"the eigenvalues of the largest egonets did not settle in {STEPS_CLUSTER} steps")
    return out.unionByName(values.select(*by, F.col("ego").alias("node"), "lambda"))


def dominant_pair(edges: DataFrame, keys, min_nodes: int = 10) -> DataFrame:
    """Largest egonet eigenvalue against the egonet's total weight."""
    by = names(keys)
    found = settle(triangles(edges, by))
    rows = attach(egonets(edges, by, found), ego_eigenvalues(edges, by, found=found), [*by, "node"])
    return oddball_scaled(rows, by, "lambda", "egonet_total_weight", min_nodes)


def top_nodes(scores: DataFrame, keys, score: str, k: int) -> DataFrame:
    """The ``k`` highest scores per graph, lowest node first on ties.

    A per-task top k comes first, so a graph of any size sends at most k rows
    per task to the final ranking.
    """
    by = names(keys)
    order = [F.desc(score), "node"]
    local = scores.withColumn("_task", F.spark_partition_id())
    ranked = local.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_task").orderBy(*order)))
    ranked = ranked.where(F.col("_r") <= k).drop("_task", "_r")
    final = Window.partitionBy(*(by or [F.lit(1)])).orderBy(*order)
    return ranked.withColumn("position", F.row_number().over(final)).where(F.col("position") <= k)


def without_nodes(edges: DataFrame, keys, nodes: DataFrame) -> DataFrame:
    by = names(keys)
    gone = settle(nodes.select(*by, "node"))
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("node", end), [*by, end], "left_anti")
    return edges


def rescore_without_top(edges: DataFrame, keys, k: int = 2) -> DataFrame:
    """Clique/star scores before and after dropping the ``k`` highest nodes of each graph."""
    by = names(keys)
    before = oddball(egonets(edges, by), by)
    again = oddball(egonets(without_nodes(edges, by, top_nodes(before, by, "oddball_score", k)), by), by)
    return before.withColumn("round", F.lit("before")).unionByName(again.withColumn("round", F.lit("after")))


def oddball_with_lof(scores: DataFrame, k: int = 20, keys=()) -> DataFrame:
    """Each graph's clique/star score averaged with the LOF of (nodes, edges) among its own nodes, both scaled to 0…1."""
    by, scores = names(keys), settle(scores)
    points = scores.select(*by, F.col("node").alias("id"), F.array(F.col("egonet_nodes").cast("double"), F.col("egonet_edges").cast("double")).alias("vec"))
    rows = attach(scores, lof(points, k, by=by, unique_ids=True).withColumnRenamed("id", "node"), [*by, "node"])
    return combine_scores(rows, ["oddball_score", "lof"], by=by)


def branches(scored: DataFrame, keys, log_edges_above: float = 6.0, n_branches: int = 4, min_points: int = 1000, min_cluster: int = 100, seed: int = 42) -> DataFrame:
    """Residual clusters among big egonets, each with its own line, R² and mean residual (lowest first)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    big = settle(scored.where((F.col("log_x") > log_edges_above) & F.col("residual").isNotNull()))
    if big.count() < min_points:
        return big.groupBy(*names(keys), F.lit(0).alias("branch")).agg(
            F.count(F.lit(1)).alias("points"), F.avg("residual").alias("mean_residual"), F.lit(None).cast("double").alias("beta"),
            F.lit(None).cast("double").alias("intercept"), F.lit(None).cast("double").alias("r2")).limit(0)
    rows = VectorAssembler(inputCols=["residual"], outputCol="_v").transform(big)
    rows = KMeans(k=n_branches, seed=seed, featuresCol="_v", predictionCol="branch").fit(rows).transform(rows)
    out = rows.groupBy(*names(keys), "branch").agg(
        F.count(F.lit(1)).alias("points"), F.avg("residual").alias("mean_residual"), F.regr_slope("log_y", "log_x").alias("beta"),
        F.regr_intercept("log_y", "log_x").alias("intercept"), F.regr_r2("log_y", "log_x").alias("r2"))
    return out.where(F.col("points") >= min_cluster)


def top_overlap(a: DataFrame, b: DataFrame, keys, score: str = "oddball_score", k: int = 100, gap: int = 100, min_zone: int = 3) -> DataFrame:
    """Overlap of two scores' top-k sets per graph and how many zones the common nodes form."""
    by = names(keys)
    ta, tb = (settle(top_nodes(d, by, score, k).select(*by, "node")) for d in (a, b))
    common = ta.join(tb, [*by, "node"], "left_semi")
    found = zones(common, by, gap, min_zone).groupBy(*by).agg(F.count(F.lit(1)).alias("num_zones"))
    counts = ta.groupBy(*by).agg(F.count(F.lit(1)).alias("_a"))
    counts = attach(counts, tb.groupBy(*by).agg(F.count(F.lit(1)).alias("_b")), by)
    counts = attach(counts, common.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")), by, "left")
    counts = attach(counts, found, by, "left")
    both = F.coalesce("_c", F.lit(0))
    return counts.select(
        *by, both.alias("overlap_count"), (both / k * 100).alias("overlap_pct"), (F.col("_a") - both).alias("only_a"),
        (F.col("_b") - both).alias("only_b"), F.coalesce("num_zones", F.lit(0)).alias("num_zones"))


def zones(nodes: DataFrame, keys, gap: int = 100, min_nodes: int = 3) -> DataFrame:
    """Runs of (at most a few hundred) nodes with no larger step than ``gap``: ``(keys…, first, last, nodes)``."""
    by = names(keys)
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("node")
    rows = nodes.withColumn("_new", (F.col("node") - F.lag("node").over(w) > gap).cast("int"))
    rows = rows.withColumn("_zone", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*by, "_zone").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("nodes"))
    return out.where(F.col("nodes") >= min_nodes).drop("_zone")


def score_vs(scores: DataFrame, other: DataFrame, keys, score: str, measure: str) -> DataFrame:
    """How a score relates to another node measure: ranges, means and Pearson r on shared nodes."""
    by = names(keys)
    rows = attach(scores.select(*by, "node", score), other.select(*by, "node", measure), [*by, "node"])
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("nodes"), F.min(score).alias("score_min"), F.max(score).alias("score_max"), F.avg(score).alias("score_mean"),
        F.min(measure).alias("measure_min"), F.max(measure).alias("measure_max"), F.avg(measure).alias("measure_mean"), F.corr(score, measure).alias("r"))


def top_nodes_on_series(scores: DataFrame, df: DataFrame, keys, value: str, score: str = "oddball_score", k: int = 20, offset: int = 0) -> DataFrame:
    """Top nodes with the series value at their position; ``offset`` rows may have been skipped before the graph was built."""
    by = names(keys)
    top = settle(top_nodes(scores, by, score, k).select(*by, "node", score, "position"))
    top = top.withColumn(IDX, F.col("node") + offset)
    return attach(top, df.select(*by, IDX, value), [*by, IDX])


def edge_overlap(edges: DataFrame, layer: str, kind: Sequence[str] = ()) -> DataFrame:
    """Average edge overlap over the layers of each kind: Σ occurrences / (layers · distinct edges)."""
    by = names(kind)
    per = edges.groupBy(*by, F.least("src", "dst").alias("_u"), F.greatest("src", "dst").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.array_sort(F.collect_set(layer)).alias("_in"))
    # edges of the same layers are one row before the layers are put together
    alike = per.groupBy(*by, "_in").agg(F.count(F.lit(1)).alias("_n"), F.sum("_c").alias("_t"))
    out = alike.groupBy(*by).agg(
        F.sum("_n").alias("distinct_edges"), F.sum("_t").alias("total_edges"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_in")))).cast("bigint").alias("layers"))
    return out.withColumn("average_edge_overlap", F.col("total_edges") / (F.col("layers") * F.col("distinct_edges")))


def community_sizes(members: DataFrame, keys) -> DataFrame:
    return members.groupBy(*names(keys), "community").agg(F.count(F.lit(1)).alias("size"))


def community_bands(df: DataFrame, members: DataFrame, keys) -> DataFrame:
    """Community at every time index; rows outside the graph get -1."""
    by = names(keys)
    known = members.select(*by, F.col("node").alias(IDX), "community")
    rows = attach(df.select(*by, IDX), known, [*by, IDX], "left")
    return rows.withColumn("community", F.coalesce("community", F.lit(-1)))


def normalised_view(df: DataFrame, series, value: str, out: str = "normalised") -> DataFrame:
    """Each series in its own sample deviations around its mean."""
    by = names(series)
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return attach_stats(df, stats, by).withColumn(out, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")
