"""Forecasters on window tables.

A window table is long: ``(series, window_id, step, value)`` with ``step`` below
``n_in`` for the input and the rest as target (``windows.strided_windows``).
Predicting returns the target rows with ``y_true`` and ``y_pred``.
"""

from __future__ import annotations

import itertools
import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensorloom.kernels import IDX, attach, attach_stats, framed, gram, names, quantiles, solve_ridge
from sensorloom.operators.split import with_total
from sensorloom.operators.windows import sequences, strided_windows
from sensorloom.session import tuning

EVEN_ROWS = tuning("EVEN_ROWS", 250_000)  # up to here rows stay in the partitions they come in
TASK_ROWS = tuning("TASK_ROWS", 1_000_000)
KEY_HORIZONS = (1, 60, 120, 360, 720, 1440, 2160, 2880)


def forecast_windows(df: DataFrame, series, value: str, n_in: int, n_out: int, stride: int | None = None) -> DataFrame:
    """Strided input+target windows of indexed rows in long form."""
    by = names(series)
    rows = strided_windows(with_total(df.select(*by, IDX, F.col(value).alias("value")), by), by, n_in + n_out, stride or n_out)
    return rows.select(*by, "window_id", "step", "value")


class WindowForecaster(ABC):
    """``fit`` on window tables, ``predict`` target rows; window sizes are fixed at construction."""

    def __init__(self, series, n_in: int, n_out: int):
        self.series, self.n_in, self.n_out = names(series), n_in, n_out

    def fit(self, windows: DataFrame) -> WindowForecaster:
        return self

    @abstractmethod
    def line(self, inside: Column, step: Column, value: Column, over: Callable[[Column], Column]) -> tuple[Column, Column]:
        """Level at step 0 and slope per step, from the input rows."""

    def predict(self, windows: DataFrame) -> DataFrame:
        by = Window.partitionBy(*self.series, "window_id")
        level, slope = self.line(F.col("step") < self.n_in, F.col("step"), F.col("value"), lambda c: c.over(by))
        rows = windows.select("*", level.alias("_a"), slope.alias("_b")).where(F.col("step") >= self.n_in)
        return rows.select(
            *self.series, "window_id", (F.col("step") - self.n_in + 1).alias("step"), F.col("value").alias("y_true"),
            (F.col("_a") + F.col("_b") * F.col("step")).alias("y_pred"),
        )

    def first_line(self, df: DataFrame, value: str) -> DataFrame:
        """Level and slope of each series' first ``n_in`` rows."""
        first = df.where(F.col(IDX) < self.n_in)
        level, slope = self.line(F.lit(True), F.col(IDX), F.col(value), lambda c: c)
        return first.groupBy(*self.series).agg(level.alias("_a"), slope.alias("_b"))


class Persistence(WindowForecaster):
    def line(self, inside, step, value, over):
        return over(F.max_by(F.when(inside, value), F.when(inside, step))), F.lit(0.0)


class MovingAverage(WindowForecaster):
    """Mean of the last ``window`` inputs."""

    def __init__(self, series, n_in: int, n_out: int, window: int = 100):
        super().__init__(series, n_in, n_out)
        self.window = window

    def line(self, inside, step, value, over):
        return over(F.avg(F.when(inside & (step >= self.n_in - self.window), value))), F.lit(0.0)


class LinearTrend(WindowForecaster):
    """Least-squares line through the input."""

    def line(self, inside, step, value, over):
        y, x = F.when(inside, value), F.when(inside, step.cast("double"))
        return over(F.regr_intercept(y, x)), over(F.regr_slope(y, x))


FORECASTERS: dict[str, type[WindowForecaster]] = {
    "persistence": Persistence, "moving_average": MovingAverage, "linear_trend": LinearTrend,
}


def get_forecaster(name: str, series, n_in: int, n_out: int, **options) -> WindowForecaster:
    if name not in FORECASTERS:
        raise ValueError(f"unknown model {name!r}; available: {sorted(FORECASTERS)}")
    return FORECASTERS[name](series, n_in, n_out, **options)


def window_errors(predicted: DataFrame, threshold: float | None = None, by: Sequence[str] = ("window_id",)) -> DataFrame:
    """Mean squared error per window over steps and series, flagged above the threshold."""
    e = F.col("y_true") - F.col("y_pred")
    out = predicted.groupBy(*by).agg(F.avg(e * e).alias("error"))
    return out if threshold is None else out.withColumn("anomaly", F.col("error") > threshold)


def error_threshold(errors: DataFrame, q: float = 0.95) -> float:
    return float(quantiles(errors, None, "error", [q]).first()["q"][0])


def rolling_forecast(df: DataFrame, model: WindowForecaster, value: str) -> DataFrame:
    """Forecast from the first window only, each window fed with the one predicted before.

    For level and line models the chain has a closed form: the first window's
    line simply continues.
    """
    w, by = model.n_in, model.series
    rows = with_total(df.select(*by, IDX, F.col(value).alias("value")), by)
    rows = attach_stats(rows, model.first_line(rows, "value"), by)
    inside = (F.col(IDX) >= w) & (F.col(IDX) < (F.floor((F.col("n_rows") - w) / w) + 1) * w)
    return rows.where(inside).select(
        *by, F.floor(F.col(IDX) / w - 1).cast("bigint").alias("window_id"), (F.col(IDX) % w + 1).cast("int").alias("step"),
        F.col("value").alias("y_true"), (F.col("_a") + F.col("_b") * F.col(IDX)).alias("y_pred"),
    )


def rolling_forecast_with(df: DataFrame, series, value: str, n_in: int, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The same chain for any one-window ``predict``; only first windows travel to the tasks."""
    by = names(series)
    rows = with_total(df.select(*by, IDX, F.col(value).alias("value")), by)
    starts = rows.where(F.col(IDX) < n_in).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(IDX, "value"))).alias("_x"), F.first("n_rows").alias("_n")
    ).select(*by, F.transform("_x", lambda x: x["value"]).alias("_x"), "_n")
    fields = ", ".join(f"{s} {dict(df.dtypes)[s]}" for s in by)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x = np.array(row["_x"], dtype="float64")
                for window in range((row["_n"] - n_in) // n_in):
                    x = np.asarray(predict(x), dtype="float64")[:n_in]
                    at = (window + 1) * n_in + np.arange(n_in)
                    yield pd.DataFrame({**{s: row[s] for s in by}, "window_id": window, IDX: at, "y_pred": x})

    predicted = starts.mapInPandas(chain, f"{fields}, window_id bigint, {IDX} bigint, y_pred double")
    return attach(predicted, df.select(*by, IDX, F.col(value).alias("y_true")), [*by, IDX])


class DirectRidge:
    """One ridge regression per (step, feature) on the flattened last ``lag`` rows, all from one Gram matrix."""

    def __init__(self, columns: Sequence[str], n_in: int, n_out: int, lag: int = 50, alpha: float = 1.0):
        self.columns, self.n_in, self.n_out, self.lag, self.alpha = list(columns), n_in, n_out, min(lag, n_in), alpha

    def _rows(self, df: DataFrame) -> DataFrame:
        made = sequences(df, None, self.columns, self.n_in, self.n_out)
        recent = F.flatten(F.slice("x", -self.lag, self.lag))
        return made.select("start", F.concat(F.array(F.lit(1.0)), recent, F.flatten("y")).alias("row"))

    def fit(self, df: DataFrame) -> DirectRidge:
        g = gram(self._rows(df), "row")
        k = self.lag * len(self.columns)
        n, x = g[0, 0], slice(1, 1 + k)
        mean = g[0] / n
        cov = g / n - np.outer(mean, mean)
        self.mean, scale = mean[x], np.sqrt(np.maximum(np.diag(cov)[x], 0))
        self.scale = np.where(scale > 0, scale, 1.0)
        a = n * cov[x, x] / np.outer(self.scale, self.scale) + self.alpha * np.eye(k)
        self.beta = np.linalg.solve(a, n * cov[x, 1 + k :] / self.scale[:, None])
        self.offset = mean[1 + k :]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``(start, step, feature, y_true, y_pred)``."""
        k, columns, n_out = self.lag * len(self.columns), self.columns, self.n_out
        mean, scale, beta, offset = self.mean, self.scale, self.beta, self.offset

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                rows = np.stack(batch["row"].to_numpy())
                guess = (rows[:, 1 : 1 + k] - mean) / scale @ beta + offset
                width = n_out * len(columns)
                yield pd.DataFrame({
                    "start": np.repeat(batch["start"].to_numpy(), width),
                    "step": np.tile(np.repeat(np.arange(1, n_out + 1), len(columns)), len(batch)).astype("int32"),
                    "feature": np.tile(columns, len(batch) * n_out),
                    "y_true": rows[:, 1 + k :].ravel(), "y_pred": guess.ravel(),
                })

        return self._rows(df).mapInPandas(score, "start bigint, step int, feature string, y_true double, y_pred double")


def holt_lines(x: np.ndarray, alpha, beta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Holt's additive trend over the rows of ``x`` (windows × steps): level, trend and one-step SSE.  Weights are numbers or one per row."""
    level, trend = x[:, 0].copy(), x[:, 1] - x[:, 0]
    sse = np.zeros(len(x))
    for t in range(1, x.shape[1]):
        ahead = level + trend
        sse += (x[:, t] - ahead) ** 2
        new = alpha * x[:, t] + (1 - alpha) * ahead
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
    return level, trend, sse


def holt_weights(x: np.ndarray, grid: Sequence[float], beta: float | None = None, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level and trend weight of least one-step SSE for every row of ``x``, and that SSE, all rows at once.

    The best point of the grid (of its level weights alone with ``beta`` given) is where a search in ever smaller steps begins, so no grid point is better.
    """
    alpha, trend, best = np.full(len(x), grid[0]), np.full(len(x), grid[0] if beta is None else beta), np.full(len(x), np.inf)

    def take(a: np.ndarray, b: np.ndarray) -> None:
        sse = holt_lines(x, a, b)[2]
        better = sse < best
        alpha[better], trend[better], best[better] = a[better], b[better], sse[better]

    for a, b in itertools.product(grid, grid if beta is None else [beta]):
        take(np.full(len(x), a), np.full(len(x), b))
    step = float(grid[1] - grid[0]) / 2
    for _ in range(rounds):
        here = alpha.copy(), trend.copy()
        for da, db in itertools.product((-1, 0, 1), (-1, 0, 1) if beta is None else (0,)):
            take(np.clip(here[0] + da * step, 0.0, 1.0), np.clip(here[1] + db * step, 0.0, 1.0))
        step /= 2
    return alpha, trend, best


class ExponentialSmoothing:
    """Holt's linear trend per window; one level and one trend weight for all, averaged over ``fitted`` evenly spread windows (all with ``None``).

    ``beta`` fixes the trend weight.
    """

    GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))

    def __init__(self, series, n_in: int, n_out: int, beta: float | None = None, fallback: float = 0.3, fitted: int | None = 20):
        self.series, self.n_in, self.n_out, self.fixed, self.fitted = names(series), n_in, n_out, beta, fitted
        self.alpha, self.beta = fallback, 0.1 if beta is None else beta

    def _inputs(self, windows: DataFrame) -> DataFrame:
        first = windows.where(F.col("step") < self.n_in)
        packed = first.groupBy(*self.series, "window_id").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("x"))
        return packed.select(*self.series, "window_id", F.transform("x", lambda r: r["value"]).alias("x"))

    def fit(self, windows: DataFrame) -> ExponentialSmoothing:
        chosen = windows
        if self.fitted is not None:
            last = windows.agg(F.max("window_id")).first()[0] or 0
            chosen = windows.where(F.col("window_id").isin(sorted({int(v) for v in np.linspace(0, last, min(self.fitted, last + 1))})))
        grid, beta = self.GRID, self.fixed

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    alpha, trend, _ = holt_weights(np.stack(batch["x"].to_numpy()), grid, beta)
                    yield pd.DataFrame({"alpha": alpha, "beta": trend})

        found = self._inputs(chosen).mapInPandas(best, "alpha double, beta double").agg(F.avg("alpha"), F.avg("beta")).first()
        if found[0] is not None:
            self.alpha, self.beta = found
        return self

    def predict(self, windows: DataFrame) -> DataFrame:
        alpha, beta, n_in = self.alpha, self.beta, self.n_in

        @F.pandas_udf("level double, trend double")
        def smooth(x: pd.Series) -> pd.DataFrame:
            level, trend, _ = holt_lines(np.stack(x.to_numpy()), alpha, beta)
            return pd.DataFrame({"level": level, "trend": trend})

        lines = self._inputs(windows).select(*self.series, "window_id", smooth("x").alias("_l"))
        targets = attach(windows.where(F.col("step") >= n_in), lines, [*self.series, "window_id"])
        ahead = F.col("step") - n_in + 1
        return targets.select(
            *self.series, "window_id", ahead.alias("step"), F.col("value").alias("y_true"),
            (F.col("_l.level") + F.col("_l.trend") * ahead).alias("y_pred"),
        )


def lag_rows(df: DataFrame, columns: Sequence[str], lags: int, keep: Sequence[str] = ()) -> DataFrame:
    """``row`` = 1, lag 1…p of every column, then the columns themselves; incomplete rows dropped."""
    def build(w):
        past = [F.lag(c, i).over(w) for i in range(1, lags + 1) for c in columns]
        return {"row": F.array(F.lit(1.0), *past, *[F.col(c).cast("double") for c in columns])}

    rows = framed(df, None, build, lags)
    return rows.where((F.col(IDX) >= lags) & ~F.exists("row", lambda v: v.isNull())).select(IDX, *keep, "row")


class VectorAutoregression:
    """VAR(p), the order chosen by AIC on one common Gram matrix."""

    def __init__(self, columns: Sequence[str], max_lags: int = 15):
        self.columns, self.max_lags = list(columns), max_lags

    def fit(self, df: DataFrame) -> VectorAutoregression:
        k, p = len(self.columns), self.max_lags
        g = gram(lag_rows(df, self.columns, p), "row")
        targets = list(range(1 + p * k, 1 + p * k + k))
        scores = {}
        for order in range(1, p + 1):
            _, sse = solve_ridge(g, list(range(1 + order * k)), targets)
            scores[order] = np.linalg.slogdet(sse / g[0, 0])[1] + 2 * order * k * k / g[0, 0]
        self.order = min(scores, key=scores.get)
        own = gram(lag_rows(df, self.columns, self.order), "row")
        at = 1 + self.order * k
        self.coefficients, _ = solve_ridge(own, list(range(at)), list(range(at, at + k)))
        return self

    def forecast(self, df: DataFrame, starts: DataFrame, horizon: int) -> DataFrame:
        """``(start, step, feature, y_pred)`` from the rows before each start index."""
        k, p, columns, beta = len(self.columns), self.order, self.columns, self.coefficients
        rows = lag_rows(df, columns, p).join(starts.select(IDX), IDX, "left_semi")

        def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at, row in zip(batch[IDX], batch["row"]):
                    past = np.array(row[1 : 1 + p * k]).reshape(p, k)
                    out = []
                    for _ in range(horizon):
                        step = np.r_[1.0, past.ravel()] @ beta
                        past = np.vstack([step, past[:-1]])
                        out.append(step)
                    yield pd.DataFrame({
                        "start": at, "step": np.repeat(np.arange(1, horizon + 1), k).astype("int32"),
                        "feature": columns * horizon, "y_pred": np.array(out).ravel(),
                    })

        return rows.mapInPandas(roll, "start bigint, step int, feature string, y_pred double")


class ArimaTwoStep:
    """ARIMA(p, d, q) by Hannan–Rissanen: a long autoregression gives residuals, then least squares on both.

    ``fit`` tries every order up to the given ones and keeps the lowest AIC.
    """

    def __init__(self, value: str, max_p: int = 5, max_d: int = 2, max_q: int = 2, long_lags: int = 20):
        self.value, self.max_p, self.max_d, self.max_q, self.long_lags = value, max_p, max_d, max_q, long_lags

    def _differenced(self, df: DataFrame, d: int) -> DataFrame:
        rows = df.select(IDX, F.col(self.value).cast("double").alias("x"))
        for _ in range(d):
            rows = framed(rows, None, lambda w: {"_y": F.col("x") - F.lag("x").over(w)}, 1)
            rows = rows.where("_y IS NOT NULL").select((F.col(IDX) - 1).alias(IDX), F.col("_y").alias("x"))
        return rows

    def _with_noise(self, rows: DataFrame, beta: np.ndarray) -> DataFrame:
        m = self.long_lags

        def build(w):
            guess = F.lit(float(beta[0]))
            for i in range(1, m + 1):
                guess = guess + F.lit(float(beta[i])) * F.lag("x", i).over(w)
            return {"e": F.col("x") - guess}

        noisy = framed(rows, None, build, m)
        return noisy.where(F.col(IDX) >= m).select((F.col(IDX) - m).alias(IDX), "x", "e")

    def fit(self, df: DataFrame) -> ArimaTwoStep:
        best = (np.inf, None)
        for d in range(self.max_d + 1):
            rows = self._differenced(df, d)
            g = gram(lag_rows(rows, ["x"], self.long_lags), "row")
            m = self.long_lags
            long_beta, _ = solve_ridge(g, list(range(m + 1)), [m + 1])
            noisy = self._with_noise(rows, long_beta[:, 0])
            depth = max(self.max_p, self.max_q)
            g2 = gram(lag_rows(noisy, ["x", "e"], depth), "row")
            target = 1 + 2 * depth
            for p, q in itertools.product(range(self.max_p + 1), range(self.max_q + 1)):
                used = [0] + [1 + 2 * i for i in range(p)] + [2 + 2 * i for i in range(q)]
                beta, sse = solve_ridge(g2, used, [target])
                n = g2[0, 0]
                aic = n * np.log(max(sse[0, 0] / n, 1e-300)) + 2 * (p + q + 1)
                if aic < best[0]:
                    best = (aic, (p, d, q, beta[:, 0], long_beta[:, 0], float(sse[0, 0] / n)))
        self.p, self.d, self.q, self.beta, self.long_beta, self.variance = best[1]
        return self

    def forecast(self, df: DataFrame, steps: int) -> list[float]:
        """``steps`` values after the end of the series (only its last rows are read)."""
        need = self.long_lags + self.d + max(self.p, self.q) + 5
        last = df.agg(F.max(IDX)).first()[0]
        tail = [r[0] for r in df.where(F.col(IDX) > last - need - self.long_lags).orderBy(IDX).select(F.col(self.value).cast("double")).collect()]
        levels = [np.array(tail)]
        for _ in range(self.d):
            levels.append(np.diff(levels[-1]))
        x = list(levels[-1])
        m = self.long_lags
        e = [0.0] * m + [x[t] - self.long_beta[0] - float(np.dot(self.long_beta[1:], x[t - m : t][::-1])) for t in range(m, len(x))]
        out = []
        for _ in range(steps):
            past = [1.0] + [x[-i] for i in range(1, self.p + 1)] + [e[-i] for i in range(1, self.q + 1)]
            x.append(float(np.dot(self.beta, past)))
            e.append(0.0)
            out.append(x[-1])
        for level in reversed(levels[:-1]):
            out = list(level[-1] + np.cumsum(out))
        return [float(v) for v in out]


class TrendSeason:
    """Piecewise-linear trend with changepoints plus Fourier seasonality, ridge-penalised; predicts by time."""

    def __init__(self, period: float, order: int = 4, changepoints: int = 25, trend_penalty: float = 20.0, season_penalty: float = 0.01):
        self.period, self.order, self.changepoints = period, order, changepoints
        self.penalty = [0.0, 0.0] + [trend_penalty] * changepoints + [season_penalty] * (2 * order)

    def _design(self, t: Column) -> list[Column]:
        u = (t - F.lit(self.t0)) / F.lit(self.span)
        knots = np.linspace(0, 0.8, self.changepoints + 1)[1:]
        hinges = [F.greatest(F.lit(0.0), u - F.lit(float(k))) for k in knots]
        angle = t * F.lit(2 * np.pi / self.period)
        waves = [fn(angle * F.lit(float(i))) for i in range(1, self.order + 1) for fn in (F.sin, F.cos)]
        return [F.lit(1.0), u, *hinges, *waves]

    def fit(self, df: DataFrame, t: str, value: str) -> TrendSeason:
        low, high = df.where(F.col(value).isNotNull()).agg(F.min(t), F.max(t)).first()
        self.t0, self.span = float(low), float(high - low) or 1.0
        rows = df.where(F.col(value).isNotNull()).select(F.array(*self._design(F.col(t).cast("double")), F.col(value).cast("double")).alias("row"))
        g = gram(rows, "row")
        k = len(g) - 1
        self.beta = solve_ridge(g, list(range(k)), [k], self.penalty)[0][:, 0]
        return self

    def predict(self, df: DataFrame, t: str, out: str = "y_pred") -> DataFrame:
        total = F.lit(0.0)
        for b, c in zip(self.beta, self._design(F.col(t).cast("double"))):
            total = total + F.lit(float(b)) * c
        return df.withColumn(out, total)


def interpolate_horizons(predicted: DataFrame, keys: Sequence[str], horizon: int, step: str = "horizon", value: str = "y_pred") -> DataFrame:
    """Every step 1…horizon from predictions at a few key horizons, linear in between and flat outside."""
    known = predicted.where(F.col(step) <= horizon).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(step).alias("h"), F.col(value).alias("v")))).alias("_k")
    )
    rows = known.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    low = F.try_element_at(F.filter("_k", lambda x: x["h"] <= F.col("step")), F.lit(-1))
    high = F.try_element_at(F.filter("_k", lambda x: x["h"] >= F.col("step")), F.lit(1))
    rows = rows.withColumn("_l", F.coalesce(low, high)).withColumn("_h", F.coalesce(high, low))
    share = F.coalesce(F.try_divide(F.col("step") - F.col("_l.h"), F.col("_h.h") - F.col("_l.h")), F.lit(0.0))
    return rows.select(*keys, "step", ((1 - share) * F.col("_l.v") + share * F.col("_h.v")).alias(value))


def evenly(df: DataFrame, ordered: bool = True) -> DataFrame:
    """Rows dealt evenly to all cores, about ``TASK_ROWS`` a task at most, for steps with much work a row; a small table stays as it is.

    ``ordered`` sorts partitions by every column, so what is drawn by position does not depend on the order in which rows arrive.
    """
    rows = df.count()
    if rows <= EVEN_ROWS:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * math.ceil(rows / (cores * TASK_ROWS))
    dealt = df.repartition(tasks)
    return dealt.sortWithinPartitions(*[c for c, kind in df.dtypes if kind != "vector"]) if ordered else dealt


def tree_model(kind: str = "boosting", **options):
    """A Spark ML tree regressor by name; a forest remembers every row's node in each tree, so no level walks down from the roots again."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    if kind == "boosting":
        return GBTRegressor(**({"maxIter": 20, "maxDepth": 5, "stepSize": 0.05, "seed": 42} | options))
    if kind == "random_forest":
        return RandomForestRegressor(**({"numTrees": 50, "maxDepth": 10, "minInstancesPerNode": 5, "seed": 42, "cacheNodeIds": True} | options))
    raise ValueError(f"unknown tree model {kind!r}")


class TargetTrees:
    """One tree model per target column (feature × horizon)."""

    def __init__(self, inputs: Sequence[str], targets: Sequence[str], kind: str = "boosting", **options):
        self.inputs, self.targets, self.kind, self.options = list(inputs), list(targets), kind, options

    def _assembled(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return VectorAssembler(inputCols=self.inputs, outputCol="_features").transform(df)

    def fit(self, df: DataFrame) -> TargetTrees:
        """Forests pass over the rows once a level, so these are dealt evenly before, once for all targets."""
        dealt = df
        if self.kind == "random_forest":
            weight = [self.options["weightCol"]] if self.options.get("weightCol") else []
            wanted = df.select(*dict.fromkeys([*self.inputs, *self.targets, *weight]))
            even = evenly(wanted)
            dealt = df if even is wanted else even.persist(StorageLevel.DISK_ONLY)
        try:
            rows = self._assembled(dealt)
            self.models = {
                target: tree_model(self.kind, featuresCol="_features", labelCol=target, predictionCol=f"pred_{target}", **self.options).fit(rows)
                for target in self.targets
            }
        finally:
            if dealt is not df:
                dealt.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        rows = self._assembled(df)
        for model in self.models.values():
            rows = model.transform(rows)
        return rows.drop("_features")


def grid_search(
    train: DataFrame, test: DataFrame, inputs: Sequence[str], target: str, grid: dict[str, Sequence], kind: str = "boosting",
    max_configs: int | None = None, metric: str = "r2", seed: int = 42,
) -> list[dict]:
    """Fit every configuration (or a random ``max_configs`` of them) on an explicit time split, best first."""
    combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if max_configs is not None and len(combos) > max_configs:
        order = np.random.default_rng(seed).permutation(len(combos))[:max_configs]
        combos = [combos[i] for i in sorted(order)]
    from sensorloom.operators.metrics import forecast_metrics

    if train.isEmpty() or test.isEmpty():  # too few rows to tell configurations apart
        return [{**options, "r2": None, "rmse": None, "mae": None} for options in combos]
    results = []
    for options in combos:
        model = TargetTrees(inputs, [target], kind, **options).fit(train)
        row = forecast_metrics(model.predict(test), None, target, f"pred_{target}").first()
        results.append({**options, "r2": row["r2"], "rmse": row["rmse"], "mae": row["mae"]})
    return sorted(results, key=(lambda r: -r["r2"]) if metric == "r2" else (lambda r: r[metric]))


def score_windows(seqs: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], keys: Sequence[str]) -> DataFrame:
    """Predictions of any saved model on sequence rows; ``load`` runs once per task.

    The model maps ``[n, window, features]`` to ``[n, horizon, features]``.
    """
    types = dict(seqs.dtypes)
    fields = ", ".join(f"{k} {types[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            if len(batch):
                x = np.stack([np.stack(r) for r in batch["x"]])
                guess = np.asarray(predict(x), dtype="float64")
                out = batch[list(keys)].copy()
                out["y_pred"] = [[list(map(float, s)) for s in g] for g in guess]
                yield out

    return seqs.mapInPandas(run, f"{fields}, y_pred array<array<double>>")
