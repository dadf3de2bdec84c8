"""Calibrate residual thresholds, validate them, apply them, annotate and combine.

Residuals are long rows ``(feature, idx, residual)``; thresholds are one row per
feature, so they stay tiny next to the data they are joined to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.kernels import IDX, attach, attach_stats, framed, names, quantiles
from sensorloom.operators import detect
from sensorloom.operators.windows import rolling_exprs
from sensorloom.session import settle

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
COMBINED = (
    "mean", "std", "median", "mad", "iqr", "warning_lower", "warning_upper", "danger_lower", "danger_upper", "mu0", "h", "k",
)


def calibrate(
    df: DataFrame, feature: str = "feature", value: str = "residual", warning: float = 2.0, danger: float = 3.0, alpha: float = 0.1,
    combinations: Sequence[tuple[str, float, float]] = detect.CUSUM_COMBINATIONS,
) -> DataFrame:
    """Statistics, sigma limits and the best CUSUM combination per feature."""
    q = quantiles(df, feature, value, PERCENTILES).select(
        feature, *[F.col("q")[i].alias(n) for i, n in enumerate(("p1", "p5", "p25", "median", "p75", "p95", "p99"))]
    )
    spread = attach_stats(df.select(feature, value), q.select(feature, "median"), feature)
    spread = spread.withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = quantiles(spread, feature, "_d", [0.5]).select(feature, F.col("q")[0].alias("mad"))
    mean, std = F.avg(value), F.stddev_pop(value)
    base = df.groupBy(feature).agg(
        F.count(F.lit(1)).alias("n"), mean.alias("mean"), std.alias("std"),
        (mean - warning * std).alias("warning_lower"), (mean + warning * std).alias("warning_upper"),
        (mean - danger * std).alias("danger_lower"), (mean + danger * std).alias("danger_upper"),
    )
    best = detect.select_cusum(detect.cusum_grid(df, feature, value, alpha, None, combinations), feature)
    best = best.select(feature, F.col("combo").alias("best_combo"), "h_factor", "k_factor", "mu0", "sigma0", "h", "k", "n_alarms", "alarm_rate")
    out = attach(attach(attach(base, q, feature), mad, feature), best, feature)
    return out.withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("ewma_alpha", F.lit(alpha))


def apply_residual(
    df: DataFrame, thresholds: DataFrame, feature: str = "feature", value: str = "residual", alpha: float | None = None,
    legacy_h_zero: bool = False,
) -> DataFrame:
    """Sigma and CUSUM warning/danger flags per residual.

    The CUSUM runs on the raw residuals, as calibrated thresholds are meant to
    be applied; pass ``alpha`` to run it on their EWMA instead.
    ``legacy_h_zero`` treats every positive CUSUM as an alarm.
    """
    wanted = ["warning_lower", "warning_upper", "danger_lower", "danger_upper", "mu0", "h", "k"]
    limits = thresholds.select(feature, *[F.col(c).alias(f"_{c}") for c in wanted])
    h = F.lit(0.0) if legacy_h_zero else F.coalesce("_h", F.lit(0.0))
    rows = attach_stats(df, limits, feature)
    watched = value
    if alpha is not None:
        rows, watched = detect.ewma(rows, feature, value, alpha, "_ewma"), "_ewma"
    rows = detect.cusum(rows, feature, watched, F.coalesce("_mu0", F.lit(0.0)), h, F.coalesce("_k", F.lit(0.0))).drop("cusum_alarm")
    x = F.col(value)
    above = lambda limit: (F.col("cusum_pos") > limit) | (F.col("cusum_neg") > limit)
    rows = rows.select(
        "*",
        detect.flag((x < F.col("_warning_lower")) | (x > F.col("_warning_upper"))).alias("sigma_warning"),
        detect.flag((x < F.col("_danger_lower")) | (x > F.col("_danger_upper"))).alias("sigma_danger"),
        detect.flag(above(h * 0.75)).alias("cusum_warning"),
        detect.flag(above(h)).alias("cusum_danger"),
    )
    rows = rows.withColumn("warning", F.col("sigma_warning") | F.col("cusum_warning"))
    rows = rows.withColumn("danger", F.col("sigma_danger") | F.col("cusum_danger"))
    return rows.drop("_ewma", *[f"_{c}" for c in wanted])


FLAGS = ("sigma_warning", "sigma_danger", "cusum_warning", "cusum_danger")


def validate_thresholds(df: DataFrame, thresholds: DataFrame, feature: str = "feature", value: str = "residual", weight: float = 1.0) -> DataFrame:
    """Counts and percentages of every flag on test residuals."""
    flagged = apply_residual(df, thresholds, feature, value)
    n = F.count(F.lit(1))
    out = flagged.groupBy(feature).agg(
        n.alias("n_samples"),
        *[F.count_if(c).alias(f"{c}_count") for c in FLAGS],
        *[F.round(F.count_if(c) / n * 100, 4).alias(f"{c}_pct") for c in FLAGS],
    )
    out = attach(out, thresholds.select(feature, F.col("best_combo").alias("cusum_best_combo")), feature)
    return out.withColumn("weight", F.lit(float(weight)))


def row_flags(flagged: DataFrame, idx: str = IDX) -> DataFrame:
    """Any warning / any danger over the features of each row."""
    return flagged.groupBy(idx).agg(F.max("warning").alias("any_warning"), F.max("danger").alias("any_danger"))


def apply_summary(rows: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("total_samples"), F.count_if("any_warning").alias("warning_samples"), F.count_if("any_danger").alias("danger_samples"),
        F.round(F.count_if("any_warning") / n * 100, 4).alias("warning_pct"), F.round(F.count_if("any_danger") / n * 100, 4).alias("danger_pct"),
    )


def annotate(original: DataFrame, flagged: DataFrame, features: Sequence[str], feature: str = "feature", include_cusum: bool = True, idx: str = IDX) -> DataFrame:
    """The original rows with 0/1 flags per feature and a health status.

    ``original`` is indexed; when it is longer than the results, these belong to
    its last rows.
    """
    n_rows, n_results = (d.agg(F.max(idx)).first()[0] for d in (original, flagged))
    shift = (n_rows or 0) - (n_results or 0)
    flags = ["warning", "danger", *FLAGS]
    picks = [F.max(F.col(c).cast("int")).alias(c) for c in flags]
    picks += [F.max(c).alias(c) for c in ("cusum_pos", "cusum_neg")] if include_cusum else []
    wide = flagged.groupBy(idx).pivot(feature, list(features)).agg(*picks)
    any_of = lambda c: F.greatest(*[F.coalesce(F.col(f"{f}_{c}"), F.lit(0)) for f in features])
    wide = wide.withColumn("any_warning", any_of("warning")).withColumn("any_danger", any_of("danger"))
    status = F.when(F.col("any_danger") == 1, "RED").when(F.col("any_warning") == 1, "YELLOW").otherwise("GREEN")
    wide = wide.withColumn("health_status", status)
    tail = original.where(F.col(idx) >= shift).withColumn(idx, F.col(idx) - shift)
    return attach(tail, wide, [idx])


def combine_weighted(parts: Sequence[tuple[DataFrame, float]], feature: str = "feature", columns: Sequence[str] = COMBINED) -> DataFrame:
    """Weighted mean of several threshold tables; missing values do not count."""
    if not parts:
        raise ValueError("no thresholds to combine")
    stacked = None
    for table, weight in parts:
        have = [F.col(c) if c in table.columns else F.lit(None).cast("double").alias(c) for c in columns]
        one = table.select(feature, *have, F.lit(float(weight)).alias("_w"))
        stacked = one if stacked is None else stacked.unionByName(one)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col("_w"))
    return stacked.groupBy(feature).agg(*[(F.sum(F.col(c) * F.col("_w")) / F.sum(known(c))).alias(c) for c in columns])


def point_features(df: DataFrame, series, value: str, **config) -> DataFrame:
    """Rows with ``zscore``, ``roll_avg``, ``slope`` and ``ewma``: what point thresholds are learned from and applied to."""
    c, by = detect.DEFAULTS | config, names(series)
    z_window, trend_window = c["z_window"], c["trend_window"]
    rows = framed(
        df, by,
        lambda w: [
            rolling_exprs(w, value, z_window, {"_m": "mean", "_s": "std"}) | rolling_exprs(w, value, trend_window, {"roll_avg": "mean"}),
            {"slope": F.col("roll_avg") - F.lag("roll_avg").over(w)},
        ],
        max(z_window - 1, trend_window),
    )
    rows = rows.withColumn("zscore", F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")
    return detect.ewma(rows, by, value, c["ewma_alpha"])


def flag_points(rows: DataFrame, thresholds: DataFrame, series, value: str) -> DataFrame:
    """The five point flags and their union on rows with ``point_features``."""
    by = names(series)
    kept = [n for n in thresholds.columns if n not in by]
    if "slope_lower" not in kept:
        thresholds = thresholds.withColumn("slope_lower", F.lit(None).cast("double"))
        kept.append("slope_lower")
    thresholds = settle(thresholds)
    limits = thresholds.select(*by, *[F.col(n).alias(f"_th_{n}") for n in kept])
    tops = detect.peaks_above(rows.select(*by, IDX, value), by, value, thresholds.select(*by, "height_threshold", "prominence_threshold"))
    rows = attach(rows, tops.select(*by, IDX, "prominence"), [*by, IDX], "left").withColumn("peak", F.col("prominence").isNotNull())
    rows = attach(rows, limits, by)
    low, high = F.col("_th_slope_lower"), F.col("_th_slope_upper")
    rows = rows.withColumn("trend_anom", detect.flag((F.col("slope") > high) | (low.isNotNull() & (F.col("slope") < low))))
    rows = rows.withColumn("z_anom", detect.flag(F.abs("zscore") > F.col("_th_z_k")))
    rows = rows.withColumn("median", F.col("_th_median")).withColumn("mad", F.col("_th_mad"))
    rows = detect.mad_flags(rows, value, F.col("_th_mad_k")).drop("median", "mad")
    rows = detect.cusum(rows, by, "ewma", F.coalesce("_th_mu0", F.lit(0.0)), F.col("_th_h"), F.coalesce("_th_k", F.lit(0.0)))
    rows = rows.withColumn("cusum_alarm", F.col("cusum_alarm") & detect.flag(F.col("_th_sigma0") > 0))
    rows = rows.withColumn("any_anom", detect.any_flag())
    return rows.drop(*[f"_th_{n}" for n in kept])


def apply_point(df: DataFrame, thresholds: DataFrame, series, value: str, **config) -> DataFrame:
    """Stored point thresholds (see ``detect.point_thresholds``) on new data.

    Tables without ``slope_lower`` only bound the slope from above.
    """
    return flag_points(point_features(df, series, value, **config), thresholds, series, value)
