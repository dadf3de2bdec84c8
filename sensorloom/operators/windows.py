"""Rolling, lag and sequence features on indexed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sensorloom.kernels import CHUNK_ROWS, IDX, framed, names

_AGGS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


def rolling_exprs(
    window: WindowSpec, value: str, width: int, aggs: dict[str, str], min_periods: int | None = None, shift: int = 0
) -> dict[str, Column]:
    """Trailing aggregates ``{output: aggregate}``; null until ``min_periods`` values are in the frame."""
    need = width if min_periods is None else min_periods
    frame = window.rowsBetween(-(width - 1) - shift, -shift)
    enough = F.count(value).over(frame) >= need
    return {
        out: F.when(enough, _AGGS[agg](value).over(frame)) if need > 1 else _AGGS[agg](value).over(frame)
        for out, agg in aggs.items()
    }


def rolling(
    df: DataFrame, series: str | Sequence[str] | None, values: str | Sequence[str], width: int = 50,
    aggs: Sequence[str] = ("mean", "std", "min", "max"), min_periods: int | None = 1, shift: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``{value}_{agg}`` columns over the last ``width`` rows."""

    def build(w: WindowSpec) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for v in names(values):
            out |= rolling_exprs(w, v, width, {f"{v}_{a}": a for a in aggs}, min_periods, shift)
        return out

    return framed(df, series, build, width - 1 + shift, 0, chunk_rows)


def supervised(
    df: DataFrame, series: str | Sequence[str] | None, values: str | Sequence[str],
    lags: Sequence[int] = (1, 2, 3, 5, 10), rolls: Sequence[int] = (3, 5, 10), horizon: int = 1,
    include_current: bool = True, keep_raw: bool = False, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Lag and rolling features with targets 1…horizon ahead, incomplete rows dropped.

    ``include_current=True`` rolls over the current row with one value enough;
    otherwise the frame ends one row earlier and must be full.
    """
    values = names(values)
    made: list[str] = []

    def build(w: WindowSpec) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for v in values:
            for lag in lags:
                out[f"{v}_lag{lag}"] = F.lag(v, lag).over(w)
            for width in rolls:
                wanted = {f"{v}_r{a}{width}": a for a in ("mean", "std", "min", "max")}
                out |= (
                    rolling_exprs(w, v, width, wanted, 1)
                    if include_current
                    else rolling_exprs(w, v, width, wanted, None, 1)
                )
            for step in range(1, horizon + 1):
                out[f"{v}_t{step}"] = F.lead(v, step).over(w)
        made.extend(out)
        return out

    reach = max(max(lags, default=0), max(rolls, default=1) - (1 if include_current else 0))
    rows = framed(df, series, build, reach, horizon, chunk_rows)
    raw = values if keep_raw else []
    return rows.na.drop(subset=[*raw, *made]).select(*names(series), IDX, *raw, *made)


# Fixed lag budget of the long-horizon feature set, by how many rows are available.
RECENT_LAGS = (1, 2, 4, 8, 16, 32, 64)
LAG_TIERS = (
    # rows available, further lags, rolling windows
    (2880, (120, 240, 360, 480, 600, 720, 2880), (120, 720, 2880)),
    (720, (120, 240, 360, 480, 600, 720), (120, 720)),
    (360, (120, 240, 360), (120,)),
    (0, (120,), (60,)),
)


def lag_budget(available: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Lags and rolling windows for a series with ``available`` rows to look back on."""
    for floor, lags, windows in LAG_TIERS:
        if available >= floor:
            break
    return RECENT_LAGS + lags, windows


def long_lags(
    df: DataFrame, series: str | Sequence[str] | None, values: str | Sequence[str], n_rows: int, horizon: int = 2880,
    max_lag: int | None = None, steps: Sequence[int] | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Long-horizon features: lags up to a day, mean and population std over ``[t-w, t)``.

    ``steps`` picks the target steps to materialise (all 1…horizon by default).
    Row t itself feeds neither a lag nor a target.
    """
    values = names(values)
    lags, windows = lag_budget(max_lag if max_lag is not None else n_rows - horizon - 1)
    steps = list(range(1, horizon + 1)) if steps is None else list(steps)
    deepest = max(lags)

    def build(w: WindowSpec) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for v in values:
            for lag in lags:
                out[f"{v}_lag{lag}"] = F.lag(v, lag).over(w)
            for width in windows:
                out |= rolling_exprs(w, v, width, {f"{v}_mean{width}": "mean", f"{v}_std{width}": "std_pop"}, 1, 1)
            for step in steps:
                out[f"{v}_t{step}"] = F.lead(v, step).over(w)
        out["_last"] = F.lead(F.lit(1), horizon).over(w)
        return out

    rows = framed(df, series, build, max(deepest, max(windows)), horizon, chunk_rows)
    return rows.where((F.col(IDX) >= deepest) & F.col("_last").isNotNull()).drop("_last")


def sequences(
    df: DataFrame, series: str | Sequence[str] | None, values: str | Sequence[str], window: int, horizon: int = 1,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per start: ``x`` = ``window`` rows of features, ``y`` = the next ``horizon`` rows."""
    values = names(values)
    row = F.array(*[F.col(v).cast("double") for v in values])

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            "x": F.collect_list(row).over(w.rowsBetween(0, window - 1)),
            "y": F.collect_list(row).over(w.rowsBetween(window, window + horizon - 1)),
        }

    rows = framed(df.select(*names(series), IDX, *values), series, build, 0, window + horizon - 1, chunk_rows)
    full = (F.size("x") == window) & (F.size("y") == horizon)
    return rows.where(full).select(*names(series), F.col(IDX).alias("start"), "x", "y")


def strided_windows(
    df: DataFrame, series: str | Sequence[str] | None, length: int, stride: int, total: str = "n_rows", idx: str = IDX
) -> DataFrame:
    """Long form of strided windows: each row once per complete window that covers it.

    Needs the series length in column ``total`` (see ``split.with_total``).
    """
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((F.col(idx) - (length - 1)) / stride))
    last = F.least(F.floor(F.col(idx) / stride), F.floor((F.col(total) - length) / stride))
    rows = df.where((F.col(total) >= length) & (first <= last))
    rows = rows.withColumn("window_id", F.explode(F.sequence(first, last)))
    return rows.withColumn("step", (F.col(idx) - F.col("window_id") * stride).cast("int"))


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: non-null, null, mean, sample std, min, max — in one pass."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    return long.groupBy("feature").agg(
        F.count("value").alias("non_null"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def centred_mean(df: DataFrame, series: str | Sequence[str] | None, value: str, width: int, out: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean over a full window centred on the row (even widths lean to the past)."""
    back, ahead = width // 2, (width - 1) // 2

    def build(w: WindowSpec) -> dict[str, Column]:
        frame = w.rowsBetween(-back, ahead)
        return {out: F.when(F.count(value).over(frame) == width, F.avg(value).over(frame))}

    return framed(df, series, build, back, ahead, chunk_rows)


def moving_average(df: DataFrame, series: str | Sequence[str] | None, value: str, width: int, out: str) -> DataFrame:
    """Means of every full ``width``-row window, placed at its last row."""
    rows = framed(df, series, lambda w: rolling_exprs(w, value, width, {out: "mean"}), width - 1)
    return rows.where(F.col(IDX) >= width - 1)
