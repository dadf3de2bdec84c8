"""Forecast accuracy: everything is one aggregate over long rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.kernels import IDX, attach, framed, names, order_index, quantiles


def _ape(y: Column, e: Column, mode: str) -> Column:
    if mode == "skip":
        return F.when(F.abs(y) > 1e-10, F.abs(e / y))
    if mode == "epsilon":
        return F.abs(e) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))
    if mode == "shift":
        return F.abs(e / (y + 1e-8))
    raise ValueError(f"unknown MAPE mode {mode!r}")


def metric_columns(y: str = "y_true", p: str = "y_pred", mape_mode: str = "skip") -> list[Column]:
    e = F.col(y) - F.col(p)
    n = F.count(e)
    return [
        n.alias("n"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * n)).alias("r2"),
        (F.avg(_ape(F.col(y), e, mape_mode)) * 100).alias("mape"),
        (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
    ]


def forecast_metrics(df: DataFrame, by: str | Sequence[str] | None = None, y: str = "y_true", p: str = "y_pred", mape_mode: str = "skip") -> DataFrame:
    """RMSE, MAE, R², MAPE and explained variance per group."""
    return df.groupBy(*names(by)).agg(*metric_columns(y, p, mape_mode))


def metric_report(
    df: DataFrame, feature: str = "feature", step: str = "step", horizons: Sequence[int] = (1, 120, 720, 1440, 2880),
    y: str = "y_true", p: str = "y_pred", mape_mode: str = "skip",
) -> DataFrame:
    """Aggregate, per-horizon and per-feature metrics in one pass over grouping sets.

    ``horizons`` are 1-based steps; ``scope`` tells the three kinds apart.
    """
    marked = df.withColumn("horizon", F.when(F.col(step).isin(list(horizons)), F.col(step)))
    sets = marked.groupingSets([[], [F.col("horizon")], [F.col(feature)]], F.col("horizon"), F.col(feature))
    out = sets.agg(F.grouping_id().alias("_g"), *metric_columns(y, p, mape_mode))
    scope = F.when(F.col("_g") == 3, "aggregate").when(F.col("_g") == 1, "horizon").otherwise("feature")
    out = out.withColumn("scope", scope).drop("_g")
    return out.where((F.col("scope") != "horizon") | F.col("horizon").isNotNull())


def naive_error(train: DataFrame, by: str | Sequence[str] | None, order: str | Sequence[str], value: str) -> DataFrame:
    """Mean absolute lag-1 difference of a training series: the MASE denominator.

    With ``by=None`` and an order of (row, feature) this is the flattened
    variant that mixes features.
    """
    by = names(by)
    rows = order_index(train.select(*by, *names(order), value), by, order)
    rows = framed(rows, by, lambda w: {"_d": F.abs(F.col(value) - F.lag(value).over(w))}, 1)
    return rows.groupBy(*by).agg(F.avg("_d").alias("naive_mae"))


def with_mase(metrics: DataFrame, naive: DataFrame, by: str | Sequence[str] | None = None) -> DataFrame:
    """Add ``mase``; a zero denominator leaves it null."""
    rows = attach(metrics, naive, names(by))
    return rows.withColumn("mase", F.try_divide("mae", "naive_mae")).drop("naive_mae")


def regression_report(df: DataFrame, feature: str = "feature", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per feature and ``(all)``: R² and the errors of ``(all)`` average over features; RMSE comes from the mean MSE."""
    per = forecast_metrics(df, feature, y, p, "epsilon")
    total = per.agg(
        F.sum("n").alias("n"), F.avg("mse").alias("mse"), F.sqrt(F.avg("mse")).alias("rmse"), F.avg("mae").alias("mae"), F.avg("r2").alias("r2"),
        F.avg("mape").alias("mape"), F.avg("explained_variance").alias("explained_variance"),
    )
    return per.unionByName(total.select(F.lit("(all)").alias(feature), "*"))


def extended_report(df: DataFrame, feature: str = "feature", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Per feature, with the median absolute error and the shifted MAPE."""
    errors = df.select(feature, F.abs(F.col(y) - F.col(p)).alias("_e"))
    med = quantiles(errors, feature, "_e", [0.5]).select(feature, F.col("q")[0].alias("medae"))
    return attach(forecast_metrics(df, feature, y, p, "shift"), med, feature)


def error_bands(df: DataFrame, feature: str = "feature", step: str = "step", y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mean error ± 1 and 2 population deviations and RMSE per feature and step."""
    e = F.col(p) - F.col(y)
    mean, std = F.avg(e), F.stddev_pop(e)
    return df.groupBy(feature, step).agg(
        mean.alias("mean_error"), (mean - std).alias("low_1"), (mean + std).alias("high_1"),
        (mean - 2 * std).alias("low_2"), (mean + 2 * std).alias("high_2"), F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def rank_models(metrics: DataFrame, model: str = "model", metric: str = "r2") -> DataFrame:
    """Models by descending metric with their position (a handful of rows)."""
    ordered = order_index(metrics.withColumn("_o", -F.col(metric)), None, ["_o", model], "rank")
    return ordered.withColumn("rank", F.col("rank") + 1).drop("_o")


def best_model(metrics: DataFrame, model: str = "model", metric: str = "r2") -> str:
    return metrics.agg(F.max_by(model, metric)).first()[0]


def experiment_rollup(runs: DataFrame, keys: Sequence[str], status: str, runtime: str) -> DataFrame:
    """Runs, successes, failures and run times per experiment group."""
    s = F.col(status)
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(s == "success").alias("succeeded"), F.count_if(s != "success").alias("failed"),
        F.sum(runtime).alias("total_runtime"), F.avg(runtime).alias("mean_runtime"), F.max(runtime).alias("max_runtime"),
    )
