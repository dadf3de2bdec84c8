"""Graph operators against brute force on small fixtures."""

from collections import deque
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import graph, paths, visibility


def series_frame(spark, values):
    rows = [(s, i, float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["s", "idx", "y"])).repartition(4)


RNG = np.random.default_rng(3)
VALUES = {
    "noise": np.round(RNG.normal(size=90) * 4) / 4, "ties": RNG.integers(0, 4, 60), "up": np.arange(30) ** 1.5,
    "down": -np.arange(40.0), "flat": np.ones(25), "spike": np.r_[-np.arange(40.0), 99, np.arange(30)], "one": [1.0],
}


def brute(values, horizontal):
    out = set()
    for i, j in combinations(range(len(values)), 2):
        between = range(i + 1, j)
        if horizontal:
            seen = all(values[k] < min(values[i], values[j]) for k in between)
        else:
            a, b = Fraction(values[i]), Fraction(values[j])
            seen = all(Fraction(values[k]) < a + (b - a) * (k - i) / (j - i) for k in between)
        if seen:
            out.add((i, j))
    return out


def edges_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["s"], []).append((r["src"], r["dst"]))
    for s, e in out.items():
        assert len(e) == len(set(e)), s
    return {s: set(e) for s, e in out.items()}


@pytest.mark.parametrize("leaf,fan", [(2048, 32), (7, 3)])
def test_natural_visibility(spark, leaf, fan):
    got = edges_of(visibility.natural_visibility(series_frame(spark, VALUES), "s", "y", leaf, fan))
    for s, v in VALUES.items():
        assert got.get(s, set()) == brute(list(map(float, v)), False), s


def records(values):
    """Natural visibility as record slopes in exact arithmetic."""
    out = set()
    for i, a in enumerate(values):
        best = None
        for j in range(i + 1, len(values)):
            slope = (Fraction(values[j]) - Fraction(a)) / (j - i)
            if best is None or slope > best:
                best = slope
                out.add((i, j))
    return out


N = 300
AT = np.arange(float(N))
SHAPES = {
    "concave": -((AT - 150) ** 2), "convex": (AT[:90] - 40) ** 2, "arc": np.round(np.sqrt(np.maximum(0, 250**2 - (AT - 200) ** 2)) * 64) / 64, "ramp": AT * 3, "steps": np.floor(AT / 7) * 0.125,
    "constant": np.full(N, 2.5), "walk": np.cumsum(np.round(RNG.normal(size=N) * 16) / 16), "hills": np.round(np.sin(AT / 25) * 4096) / 16 - AT / 8, "peaks": np.where(AT % 60 == 7, 500 + AT, -(AT % 13)),
}


@pytest.mark.parametrize("leaf,fan", [(16, 4), (32, 3)])
def test_natural_visibility_of_shapes(spark, leaf, fan):
    """Long hulls (whole concave stretches) do not fit a sketch of ``leaf / fan`` points, and the edges are exact all the same."""
    got = edges_of(visibility.natural_visibility(series_frame(spark, SHAPES), "s", "y", leaf, fan))
    for s, v in SHAPES.items():
        assert got.get(s, set()) == records(list(map(float, v))), s


def test_sketches_are_bounded_and_enclose_the_hull(spark):
    values = {"concave": -((np.arange(3000.0) - 1000) ** 2), "flat": np.ones(3000), "ramp": np.arange(3000) * 0.1}
    for s, v in values.items():
        x = np.arange(3000.0)
        hull = visibility.upper_hull(x, v)
        assert len(hull[0]) == (3000 if s == "concave" else 2) or s == "ramp"
        assert s != "ramp" or len(hull[0]) < 64
        sketch = visibility._sketched((x, v), (x, v), 16)
        assert all(len(sketch[c]) <= 16 for c in sketch) and set(sketch["hx"]) <= set(x)
        assert (np.interp(x, sketch["ox"], sketch["oy"]) >= v - 1e-12 * np.abs(v)).all()
        left = np.linspace(-500, -1, 40)
        y = np.interp(left, [-500, -1], [v.min(), v.max()])
        true = visibility._steepest(left, y, x, v)
        assert (visibility._steepest(left, y, sketch["hx"], sketch["hy"]) <= true).all() and (visibility._steepest(left, y, sketch["ox"], sketch["oy"]) >= true).all()
    rows = visibility._ladder(
        spark.createDataFrame([("a", k, [float(k)] * 4, [1.0] * 4, [float(k)] * 4, [1.0] * 4) for k in range(40)], "s string, _leaf long, hx array<double>, hy array<double>, ox array<double>, oy array<double>"), ["s"], 4, 4)
    assert len(rows) == 3 and max(len(r.children) for t in rows for r in t.collect()) <= 4


@pytest.mark.parametrize("chunk", [100000, 8])
def test_horizontal_visibility(spark, chunk, monkeypatch):
    monkeypatch.setattr("sensorloom.nearest.FAN", 3)
    got = edges_of(visibility.horizontal_visibility(series_frame(spark, VALUES), "s", "y", chunk))
    for s, v in VALUES.items():
        want = brute(list(map(float, v)), True)
        assert got.get(s, set()) == want, s
        assert len(want) <= max(0, 2 * len(v) - 3)


@pytest.fixture(scope="module")
def small(spark):
    values = {"a": VALUES["noise"][:40], "b": VALUES["ties"][:30]}
    df = series_frame(spark, values)
    edges = visibility.edge_weights(visibility.natural_visibility(df, "s", "y"), df, "s", "y").toPandas()
    return spark.createDataFrame(edges), edges


def adjacency(edges, s):
    e = edges[edges["s"] == s]
    n = int(max(e["src"].max(), e["dst"].max())) + 1
    a = np.zeros((n, n))
    a[e["src"], e["dst"]] = a[e["dst"], e["src"]] = e["weight"]
    return a


def bfs(a, start):
    dist, sigma, queue = {start: 0}, {start: 1.0}, deque([start])
    while queue:
        u = queue.popleft()
        for v in np.flatnonzero(a[u]):
            if v not in dist:
                dist[v], sigma[v] = dist[u] + 1, 0.0
                queue.append(v)
            if dist[v] == dist[u] + 1:
                sigma[v] += sigma[u]
    return dist, sigma


def test_exact_centralities(spark, small):
    df, edges = small
    close = {(r["s"], r["node"]): r["closeness_centrality"] for r in paths.closeness(df, "s", None).collect()}
    between = {(r["s"], r["node"]): r["betweenness_centrality"] for r in paths.betweenness(df, "s", None).collect()}
    for s in ("a", "b"):
        a = adjacency(edges, s)
        n = len(a)
        found = [bfs(a, i) for i in range(n)]
        for v in range(n):
            assert close[s, v] == pytest.approx((n - 1) / sum(found[v][0].values()))
            share = 0.0
            for i in range(n):
                for j in range(n):
                    if len({i, j, v}) == 3 and found[i][0][v] + found[v][0][j] == found[i][0][j]:
                        share += found[i][1][v] * found[v][1][j] / found[i][1][j]
            assert between[s, v] == pytest.approx(share / ((n - 1) * (n - 2)))


@pytest.mark.parametrize("limit", [50_000, 25])
def test_egonets_and_eigenvalues(spark, small, limit):
    df, edges = small
    ego = {(r["s"], r["node"]): r for r in graph.egonets(df, "s").collect()}
    top = {(r["s"], r["node"]): r["lambda"] for r in graph.ego_eigenvalues(df, "s", limit).collect()}
    for s in ("a", "b"):
        a = adjacency(edges, s)
        for v in range(len(a)):
            members = np.r_[v, np.flatnonzero(a[v])]
            sub = a[np.ix_(members, members)]
            assert ego[s, v]["egonet_edges"] == (sub > 0).sum() / 2
            assert ego[s, v]["egonet_total_weight"] == pytest.approx(sub.sum() / 2)
            assert top[s, v] == pytest.approx(np.linalg.eigvalsh(sub)[-1], rel=1e-6)


def test_communities_cover_all_nodes(spark, small):
    df, edges = small
    rows = paths.communities(df, "s").toPandas()
    for s in ("a", "b"):
        a, part = adjacency(edges, s), rows[rows["s"] == s].set_index("node")
        n = len(a)
        found = [bfs(a, i)[0] for i in range(n)]
        hubs = [v for v in range(n) if found[0][v] + found[v][n - 1] == found[0][n - 1]]
        for v in range(n):
            want = min(hubs, key=lambda h: (found[v][h], abs(h - v), h))
            assert found[v][part.loc[v, "hub"]] == found[v][want]
            if v in hubs:
                assert part.loc[v, "hub"] == v
        assert part["community"].min() == 0 and part["community"].max() == len(hubs) - 1


def test_lof_of_each_graph_alone(spark, small):
    """What a graph gets does not depend on the graphs beside it."""
    odd = graph.oddball(graph.egonets(small[0], "s"), "s")
    got = sorted(map(repr, graph.oddball_with_lof(odd, 5, "s").select("s", "node", "lof", "combined").collect()))
    alone = [graph.oddball_with_lof(odd.where(F.col("s") == s), 5, "s").select("s", "node", "lof", "combined").collect() for s in ("a", "b")]
    assert got == sorted(map(repr, alone[0] + alone[1])) and len(alone[0]) > 0 < len(alone[1])
