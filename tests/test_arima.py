"""ARIMA per series and history against regressions on each history by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import arima

RNG = np.random.default_rng(8)


def walk(n, phi, theta, d):
    e = RNG.normal(size=n + 1)
    x = np.zeros(n)
    for t in range(1, n):
        x[t] = 0.3 + phi * x[t - 1] + e[t] + theta * e[t - 1]
    for _ in range(d):
        x = np.cumsum(x)
    return x


VALUES = {"a": walk(300, 0.6, 0.0, 0), "b": walk(260, 0.2, 0.5, 1), "c": walk(90, -0.4, 0.3, 1), "short": np.arange(12.0)}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(s, i, float(v)) for s, x in VALUES.items() for i, v in enumerate(x)] + [(None, i, float(v)) for i, v in enumerate(VALUES["c"])]
    return spark.createDataFrame(rows, "s string, idx long, v double").repartition(5)


def direct(x, p, d, q, m, steps, depth):
    """The same two regressions on the history alone, by rows."""
    levels = [x]
    for _ in range(d):
        levels.append(np.diff(levels[-1]))
    y = levels[-1]
    at = np.arange(depth, len(y))
    one = np.column_stack([np.ones(len(at)), *[y[at - i] for i in range(1, m + 1)]])
    long = np.linalg.lstsq(one, y[at], rcond=None)[0]
    noise = np.full(len(y), np.nan)
    for t in range(m, len(y)):
        noise[t] = y[t] - long[0] - long[1:] @ y[t - m : t][::-1]
    two = np.column_stack([np.ones(len(at)), *[y[at - i] for i in range(1, p + 1)], *[noise[at - j] for j in range(1, q + 1)]])
    beta = np.linalg.lstsq(two, y[at], rcond=None)[0]
    y, e, start = list(y), list(noise), len(y)
    for _ in range(steps):
        y.append(beta @ np.r_[1.0, [y[-i] for i in range(1, p + 1)], [e[-j] for j in range(1, q + 1)]])
        e.append(0.0)
    out = np.array(y[start:])
    for level in levels[:-1][::-1]:
        out = level[-1] + np.cumsum(out)
    return out


@pytest.mark.parametrize("order", [(1, 0, 0), (2, 1, 0), (1, 1, 2), (0, 2, 1)])
def test_every_history_equals_its_own_regression(spark, frame, order, monkeypatch):
    p, d, q = order
    ends = [("a", 120), ("a", 121), ("a", 300), ("b", 200), ("c", 90), ("short", 12), (None, 80)]
    got = {}
    for r in arima.forecast_histories(frame, "s", "v", spark.createDataFrame(ends, "s string, end long"), 7, order, long_lags=6).collect():
        got.setdefault((r.s, r.end), {})[r.step] = r.y_pred
    assert set(got) >= {e for e in ends if e[0] != "short"}
    for s, end in ends[:-2] + [(None, 80)]:
        x = VALUES[s or "c"][:end]
        want = direct(x, p, d, q, 6, 7, 6 + max(p, q))
        assert [got[s, end][k] for k in range(1, 8)] == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_small_chunks_give_the_same(spark, frame, monkeypatch):
    ends = spark.createDataFrame([("a", 150), ("b", 222)], "s string, end long")
    want = sorted(map(tuple, arima.forecast_histories(frame, "s", "v", ends, 3, (2, 1, 1), 5).collect()))
    real = arima.framed
    monkeypatch.setattr(arima, "framed", lambda df, by, build, before: real(df, by, build, before, chunk_rows=16))
    got = sorted(map(tuple, arima.forecast_histories(frame, "s", "v", ends, 3, (2, 1, 1), 5).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_orders_per_series(spark, frame):
    orders = {r.s: (r.p, r.d, r.q) for r in arima.choose_orders(frame.where("s <> 'short'"), "s", "v", 2, 1, 1, long_lags=8).collect()}
    assert set(orders) == {"a", "b", "c"} and orders["a"][1] == 0 and orders["a"][0] >= 1
    table = spark.createDataFrame([(s, *o) for s, o in orders.items()], "s string, p int, d int, q int")
    ends = spark.createDataFrame([(s, len(VALUES[s])) for s in orders], "s string, end long")
    rows = arima.forecast_histories(frame, "s", "v", ends, 4, table, 8).collect()
    for s, (p, d, q) in orders.items():
        depth = 8 + max(max(o[0], o[2]) for o in orders.values() if o[1] == d)
        assert [r.y_pred for r in sorted((r for r in rows if r.s == s), key=lambda r: r.step)] == pytest.approx(direct(VALUES[s], p, d, q, 8, 4, depth), rel=1e-5, abs=1e-5)


def test_empty(spark, frame):
    none = frame.where("false").select("s", F.col("idx").alias("end"))
    assert arima.forecast_histories(frame, "s", "v", none, 3).collect() == []
    assert arima.choose_orders(frame.where("false"), "s", "v").collect() == []


def test_matrices_reach_workers_as_numbers(spark):
    """A model's Gram matrix is one list of numbers, in order of the places, not an object for each of its cells."""
    cells = spark.createDataFrame([("a", i, j, 10.0 * i + j) for i in (2, 0, 1) for j in (1, 2, 0)], "s string, i int, j int, v double").repartition(4)
    made = arima._matrices(cells, ["s"])
    assert dict(made.dtypes)["_g"] == "array<double>"
    assert arima._matrix(np.array(made.first()["_g"])).tolist() == [[0, 1, 2], [10, 11, 12], [20, 21, 22]]
