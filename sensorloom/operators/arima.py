"""ARIMA per series, refitted for every evaluated history, from running Gram matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.kernels import CHUNK_ROWS, IDX, attach, carry_fill, framed, gram_cells, names, solve_ridge
from sensorloom.session import settle

LONG_LAGS = 20


def lagged(df: DataFrame, series, value: str, d: int, depth: int, keep: Sequence[str] = ()) -> DataFrame:
    """``(series…, idx, base, levels, keep…)``: 1, the d-times differenced value and its ``depth`` lags; the last value of every lower difference."""
    by = names(series)
    rows = df.select(*by, IDX, *keep, F.col(value).cast("double").alias("_x0"))

    def build(w):
        steps = [{f"_x{k + 1}": F.col(f"_x{k}") - F.lag(f"_x{k}").over(w)} for k in range(d)]
        past = [F.lag(f"_x{d}", i).over(w) for i in range(1, depth + 1)]
        return [*steps, {"base": F.array(F.lit(1.0), F.col(f"_x{d}"), *past)}]

    made = framed(rows, by, build, depth + d).where((F.col(IDX) >= depth + d) & ~F.exists("base", lambda v: v.isNull()))
    levels = F.array(*[F.col(f"_x{k}") for k in range(d)]) if d else F.array().cast("array<double>")
    return made.select(*by, IDX, "base", levels.alias("levels"), *keep)


def two_stages(g: np.ndarray, p: int, q: int, long_lags: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Hannan–Rissanen from one Gram matrix of (1, x, lags): coefficients of the long autoregression, of ARMA(p, q), and the mean squared residual.

    Residuals of the long autoregression are linear in the lags, so the second regression's Gram matrix is a transform of the first one's.
    """
    long, _ = solve_ridge(g, [0, *range(2, 2 + long_lags)], [1])
    rows = np.zeros((2 + p + q, len(g)))
    rows[0, 0] = rows[-1, 1] = 1
    for i in range(1, p + 1):
        rows[i, 1 + i] = 1
    for j in range(1, q + 1):
        rows[p + j, 0] = -long[0, 0]
        rows[p + j, 1 + j] = 1
        rows[p + j, 2 + j : 2 + j + long_lags] -= long[1:, 0]
    beta, sse = solve_ridge(rows @ g @ rows.T, range(1 + p + q), [1 + p + q])
    return long[:, 0], beta[:, 0], float(sse[0, 0] / max(g[0, 0], 1))


def extended(base: np.ndarray, levels: np.ndarray, long: np.ndarray, beta: np.ndarray, p: int, q: int, steps: int) -> np.ndarray:
    """``steps`` values after the row that ``base`` and ``levels`` belong to."""
    m = len(long) - 1
    x = list(base[1:][::-1])
    e = [x[len(x) - 1 - j] - long[0] - float(np.dot(long[1:], x[len(x) - 1 - j - m : len(x) - 1 - j][::-1])) for j in range(q - 1, -1, -1)]
    start = len(x)
    for _ in range(steps):
        past = [1.0, *[x[-i] for i in range(1, p + 1)], *[e[-j] for j in range(1, q + 1)]]
        x.append(float(np.dot(beta, past)))
        e.append(0.0)
    out = np.array(x[start:])
    for last in levels[::-1]:
        out = last + np.cumsum(out)
    return out


def _matrices(cells: DataFrame, by: list[str]) -> DataFrame:
    """One row of plain numbers, ``_g``, for each matrix: its cells in the order of their places."""
    rows = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "j", "v"))).alias("_g"))
    return rows.withColumn("_g", F.transform("_g", lambda c: c["v"]))


def _matrix(cells: np.ndarray) -> np.ndarray:
    size = math.isqrt(len(cells))
    return np.asarray(cells, float).reshape(size, size)


def _rows(batch: pd.DataFrame) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for at in range(len(batch)):
        yield {c: batch[c].iat[at] for c in batch.columns}


def _keys(row: dict, by: list[str], n: int) -> dict[str, pd.Series]:
    return {c: pd.Series([None if pd.isna(row[c]) else row[c]] * n, dtype=object) for c in by}


def choose_orders(df: DataFrame, series, value: str, max_p: int = 5, max_d: int = 2, max_q: int = 2, long_lags: int = LONG_LAGS) -> DataFrame:
    """``(series…, p, d, q, aic)``: the order of least AIC for every series (ties: the smallest), all tried on one Gram matrix per difference."""
    by = names(series)
    fields = "".join(f"`{c}` {dict(df.dtypes)[c]}, " for c in by)

    def tried(d: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in _rows(batch):
                    g, out = _matrix(row["_g"]), []
                    for p in range(max_p + 1):
                        for q in range(max_q + 1):
                            error = two_stages(g, p, q, long_lags)[2]
                            out.append({"p": p, "d": d, "q": q, "aic": g[0, 0] * np.log(max(error, 1e-300)) + 2 * (p + q + 1)})
                    yield pd.DataFrame(out).assign(**_keys(row, by, len(out)))

        return run

    found = None
    for d in range(max_d + 1):
        rows = lagged(df, by, value, d, long_lags + max(max_p, max_q))
        one = _matrices(gram_cells(rows, "base", by), by).mapInPandas(tried(d), f"{fields}p int, d int, q int, aic double")
        found = one if found is None else found.unionByName(one)
    best = F.min_by(F.struct("p", "d", "q", "aic"), F.struct("aic", "d", "p", "q")).alias("_o")
    return found.groupBy(*by).agg(best).select(*by, "_o.*")


def next_ends(df: DataFrame, series, value: str, ends: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(series…, idx, value, end)``: every row with the first end after it, if any, met by a backward fill over rows and ends in one order."""
    by = names(series)
    rows = df.select(*by, IDX, value, F.lit(None).cast("bigint").alias("end"), (2 * F.col(IDX) + 1).alias("_at"))
    marks = ends.select(*by, F.lit(None).cast("bigint").alias(IDX), F.lit(None).cast(dict(df.dtypes)[value]).alias(value), "end", (2 * F.col("end")).alias("_at"))
    return carry_fill(rows.unionByName(marks), by, {"end": "end"}, backward=True, chunk_rows=2 * chunk_rows, idx="_at").where(F.col(IDX).isNotNull()).drop("_at")


def forecast_histories(df: DataFrame, series, value: str, ends: DataFrame, steps: int, orders: DataFrame | tuple[int, int, int] = (5, 1, 2), long_lags: int = LONG_LAGS) -> DataFrame:
    """``(series…, end, step, y_pred)``: for every ``end`` of ``ends (series…, end)`` a model fitted on the rows before it, and ``steps`` values from there on.

    ``orders`` is one (p, d, q) or a table ``(series…, p, d, q)``, as :func:`choose_orders` gives.  Every row gets the first end after it and rows are summed to one Gram matrix for each stretch between two ends;
    running sums over the stretches give that of every history, so the data are read once however many histories there are.  Models are
    solved and followed on the executors, each from its matrix and the last row before its end.
    """
    by = names(series)
    if isinstance(orders, tuple):
        p, d, q = orders
        orders = ends.select(*by).distinct().select("*", F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"))
    orders = settle(orders.select(*by, "p", "d", "q"))
    asked = settle(ends.select(*by, F.col("end").cast("bigint").alias("end")).distinct())
    fields = "".join(f"`{c}` {dict(df.dtypes)[c]}, " for c in by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in _rows(batch):
                p, q = int(row["p"]), int(row["q"])
                long, beta, _ = two_stages(_matrix(row["_g"]), p, q, long_lags)
                ahead = extended(np.array(row["base"], float), np.array(row["levels"], float), long, beta, p, q, steps)
                yield pd.DataFrame({**_keys(row, by, steps), "end": row["end"], "step": np.arange(1, steps + 1, dtype="int32"), "y_pred": ahead})

    out = None
    for r in orders.select("d").distinct().sort("d").collect():
        chosen = orders.where(F.col("d") == r["d"]).drop("d")
        depth = long_lags + (chosen.agg(F.max(F.greatest("p", "q"))).first()[0] or 0)
        mine = attach(asked, chosen.select(*by), by)
        rows = settle(lagged(next_ends(df, by, value, mine), by, value, r["d"], depth, ["end"]).where("end IS NOT NULL"))
        cells = gram_cells(rows.select(*by, "end", "base"), "base", [*by, "end"])
        upto = Window.partitionBy(*by, "i", "j").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.select(*by, "end", "i", "j", F.sum("v").over(upto).alias("v"))
        last = rows.where(F.col(IDX) == F.col("end") - 1).drop(IDX)
        work = attach(attach(_matrices(cells, [*by, "end"]), last, [*by, "end"]), chosen, by)
        one = work.mapInPandas(solve, f"{fields}end long, step int, y_pred double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return df.sparkSession.createDataFrame([], f"{fields}end long, step int, y_pred double")
    return out
