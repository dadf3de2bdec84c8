"""Faster steps against the plain ones they replace, and bounds on what they hold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.kernels import IDX, attach, quantiles
from sensorloom.operators import arima, forecast, graph, neighbours, outliers, visibility


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 150])
def test_leaf_pairs_are_those_of_the_plain_scan(n):
    rng = np.random.default_rng(n)
    x = np.sort(rng.choice(3 * n, n, replace=False)).astype(float)
    shapes = [rng.normal(size=n), rng.integers(0, 3, n).astype(float), np.arange(n) ** 2.0, -np.arange(n) ** 2.0, np.zeros(n), np.where(rng.random(n) < 0.1, np.nan, x)]
    for y in shapes:
        plain, fast = visibility._inside_plain(x, y), visibility._inside(x, y, 8)
        assert sorted(zip(*plain[:2])) == sorted(zip(*fast[:2]))
        assert np.array_equal(plain[2], fast[2], equal_nan=True)


def test_joins_sort_by_numbers_first(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([("a", 1), (None, 1), ("a", None)], "k string, node bigint")
        joined = attach(rows, rows.withColumn("x", F.lit(1)), ["k", "node"])
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert joined.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = plan[plan.index("SortMergeJoin") :].split("\n")[0]
    assert keys.index("node#") < keys.index("k#")


def test_triangles_join_plain_numbers(spark):
    complete = spark.createDataFrame([("g", i, j) for i in range(6) for j in range(i + 1, 6)], "k string, src bigint, dst bigint")
    found = graph.triangles(complete, "k")
    assert {frozenset((r["a"], r["b"], r["c"])) for r in found.collect()} == {frozenset((a, b, c)) for a in range(6) for b in range(a) for c in range(b)}
    assert found.count() == 20
    assert "struct" not in [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line][0]


def test_eigenvalues_of_many_egonets_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    nets = []
    for n in (2, 3, 3, 9, 40, 300):
        ids = rng.choice(10**9, n, replace=False)
        rim = [(ids[a], ids[b]) for a, b in rng.integers(1, n, (n, 2)) if a < b]
        pairs = [(ids[0], x) for x in ids[1:]] + rim
        nets.append((np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), rng.exponential(size=len(pairs)) + 0.1))
    want = [graph._largest_eigenvalue(*net) for net in nets]
    steps = []
    plain = graph._largest_eigenvalue
    monkeypatch.setattr(graph, "_largest_eigenvalue", lambda *net: steps.append(1) or plain(*net))
    assert np.allclose(graph._largest_eigenvalues(*zip(*nets)), want, rtol=1e-9)
    assert len(steps) == 1  # only the one above DENSE_NODES is iterated


def test_closest_by_products_is_the_plain_search(monkeypatch):
    rng = np.random.default_rng(4)
    points = np.r_[rng.normal(size=(80, 16)), rng.integers(0, 2, (80, 16)).astype(float), np.full((30, 16), 1e6) + rng.normal(scale=1e-6, size=(30, 16)), np.full((2, 16), np.nan)]
    points[100:130] = points[80:110]
    for chosen in (points, points[:-2]):
        ids = rng.permutation(len(chosen))
        fast = neighbours._closest(ids, chosen, chosen, ids, 7, True)
        with monkeypatch.context() as m:
            m.setattr(neighbours, "_candidates", lambda *_: None)
            assert neighbours._closest(ids, chosen, chosen, ids, 7, True) == fast


def test_equal_points_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = [*rng.integers(0, 4, (120, 2)).tolist(), *rng.normal(size=(40, 2)).tolist(), *([[9.0, 9.0]] * 40)]
    rows = [("a" if i % 2 else None, i, [float(x) for x in v]) for i, v in enumerate(values)]
    points = spark.createDataFrame(rows, "g string, id bigint, vec array<double>")
    asked = []
    plain = neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda q, *a, **kw: asked.append(q.count()) or plain(q, *a, **kw))
    want = sorted((r["g"] or "", r["id"], r["lof"]) for r in neighbours.lof(points, 3, by="g").collect())
    got = sorted((r["g"] or "", r["id"], r["lof"]) for r in neighbours.lof(points, 3, by="g", unique_ids=True).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-12)
    assert asked[0] == len(rows) and asked[1] < len(rows)


def test_next_end_of_every_row(spark):
    rows = spark.createDataFrame([(k, i, float(i)) for k in ("a", None) for i in range(30)], f"k string, {IDX} bigint, v double")
    ends = spark.createDataFrame([("a", 5), ("a", 6), ("a", 17), (None, 29), (None, 40)], "k string, end bigint")
    got = {(r["k"], r[IDX]): (r["v"], r["end"]) for r in arima.next_ends(rows, "k", "v", ends, 4).collect()}
    marks = {"a": [5, 6, 17], None: [29, 40]}
    assert got == {(k, i): (float(i), min((e for e in marks[k] if e > i), default=None)) for k in marks for i in range(30)}


def test_histories_hold_no_list_of_ends(spark):
    rows = spark.createDataFrame([("a", i, float((i * 37) % 11)) for i in range(200)], f"k string, {IDX} bigint, v double")
    ends = spark.createDataFrame([("a", 80), ("a", 120)], "k string, end bigint")
    plan = arima.next_ends(rows, "k", "v", ends)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambda" not in plan


def test_gram_cells_flush(spark, monkeypatch):
    from sensorloom import kernels

    rows = spark.createDataFrame([(i % 7, [1.0, float(i), float(i * i % 5)]) for i in range(100)], "g int, x array<double>").coalesce(1)
    want = sorted(tuple(r) for r in kernels.gram_cells(rows, "x", "g").collect())
    monkeypatch.setattr(kernels, "GRAM_CELLS", 20)
    assert sorted(tuple(r) for r in kernels.gram_cells(rows, "x", "g").collect()) == want


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_many_quantiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 1)
    marks = [*np.linspace(0, 1, 101), 0.333, 0.9999, 0.5, 0.0001]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    plan = quantiles(frame, None, "v", marks)
    assert np.allclose(plan.first()["q"], np.quantile(values, marks), rtol=0, atol=1e-12)
    assert "slice" in plan._jdf.queryExecution().analyzed().toString()


def test_walkable_trees_give_the_scores_of_the_trees(spark):
    rng = np.random.default_rng(6)
    data = pd.DataFrame(np.round(rng.normal(size=(600, 3)), 1), columns=list("abc")).assign(id=range(600))
    data.loc[3, "a"] = None
    frame = spark.createDataFrame(data)
    model = outliers.IsolationForest(list("abc"), ["id"], trees=7, sample=64).fit(frame)
    got = {r["id"]: r["score"] for r in model.score(frame).collect()}

    def length(tree, row):
        at = 0
        while tree["feature"][at] >= 0:
            at = tree["left"][at] if row[tree["feature"][at]] <= tree["cut"][at] else tree["right"][at]
        return tree["length"][at]

    for i, row in enumerate(data[list("abc")].to_numpy()):
        assert got[i] == pytest.approx(2.0 ** (-sum(length(t, row) for t in model.forest) / 7 / model.norm), rel=1e-12)
    assert all(len(outliers._walkable(t)[2]) == 2 * len(t["feature"]) for t in model.forest)


def forest_rows(spark, n):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(n, 3)), 1)
    return spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=x @ [1.0, -2.0, 0.5], z=x[:, 0] ** 2, note="n")).coalesce(1)


def test_forest_with_remembered_nodes_is_the_same_forest(spark):
    rows = forest_rows(spark, 400)
    grown = [forecast.TargetTrees(list("abc"), ["y"], "random_forest", numTrees=5, **options).fit(rows).models["y"] for options in ({}, {"cacheNodeIds": False})]
    assert grown[0].getCacheNodeIds()
    trees = [model.toDebugString.split("\n", 1)[1] for model in grown]
    assert trees[0] == trees[1]


def test_forest_rows_are_dealt_evenly(spark, monkeypatch):
    rows = forest_rows(spark, 900)
    assert forecast.evenly(rows) is rows
    monkeypatch.setattr(forecast, "EVEN_ROWS", 100)
    monkeypatch.setattr(forecast, "TASK_ROWS", 40)
    for ordered in (True, False):
        dealt = forecast.evenly(rows, ordered)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) % spark.sparkContext.defaultParallelism == 0 and sum(sizes) == 900 and max(sizes) <= 45
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, rows.collect()))
    seen = []
    plain = forecast.TargetTrees._assembled
    monkeypatch.setattr(forecast.TargetTrees, "_assembled", lambda self, df: seen.append(df.rdd.getNumPartitions()) or plain(self, df))
    model = forecast.TargetTrees(list("abc"), ["y", "z"], "random_forest", numTrees=3, maxDepth=3).fit(rows)
    assert seen == [len(sizes)] and set(model.models) == {"y", "z"}
    again = forecast.TargetTrees(list("abc"), ["y", "z"], "random_forest", numTrees=3, maxDepth=3).fit(rows)
    shown = [[m.toDebugString.split("\n", 1)[1] for m in t.models.values()] for t in (model, again)]
    assert shown[0] == shown[1]
    assert model.predict(rows).count() == 900
