"""Point detectors on indexed series.

Every function takes rows with ``idx`` (see ``kernels.order_index``) and adds
columns.  Flags are booleans and never null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.kernels import (
    CHUNK_ROWS, IDX, attach, attach_stats, carry_fill, decayed_sums, framed, medians, names, reflected_walk,
)
from sensorloom.nearest import nearest_higher
from sensorloom.operators.windows import rolling_exprs
from sensorloom.session import settle

# Fixed (h, k) combinations tried by the CUSUM calibration, in order of preference.
CUSUM_COMBINATIONS = (
    ("h=4_k=0.5", 4.0, 0.5),
    ("h=5_k=0.5", 5.0, 0.5),
    ("h=8_k=0.25", 8.0, 0.25),
    ("h=2.5_k=1", 2.5, 1.0),
)
MAD_TO_SIGMA = 0.6745


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def zscore(df: DataFrame, series, value: str, window: int = 5000, threshold: float | Column = 3.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Distance from the rolling mean in rolling sample deviations; needs a full window."""
    rows = framed(df, series, lambda w: rolling_exprs(w, value, window, {"_m": "mean", "_s": "std"}), window - 1, 0, chunk_rows)
    z = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    rows = rows.withColumn("zscore", z).drop("_m", "_s")
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return rows.withColumn("z_anom", flag(F.abs("zscore") > limit))


def mad_params(df: DataFrame, series, value: str) -> DataFrame:
    """Median and median absolute deviation per series."""
    by = names(series)
    centre = medians(df, by, value, "median")
    spread = attach_stats(df, centre, by).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return attach(centre, medians(spread, by, "_d", "mad"), by)


def mad_flags(df: DataFrame, value: str, threshold: float | Column = 3.5) -> DataFrame:
    """Flags from ``median`` and ``mad`` columns; a zero MAD flags nothing."""
    score = F.when(F.col("mad") > 0, MAD_TO_SIGMA * F.abs(F.col(value) - F.col("median")) / F.col("mad")).otherwise(0.0)
    rows = df.withColumn("mad_score", score)
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return rows.withColumn("mad_anom", flag(F.col("mad_score") > limit))


def mad(df: DataFrame, series, value: str, threshold: float = 3.5) -> DataFrame:
    return mad_flags(attach_stats(df, mad_params(df, series, value), series), value, threshold).drop("median", "mad")


def local_maxima(df: DataFrame, series, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(series…, idx, height)`` of rises followed by falls; a plateau counts at its middle."""
    by = names(series)
    # neighbours are the nearest known values, however many nulls (and chunk borders) lie between
    rows = df.select(*by, IDX, value, F.col(value).alias("_prev"), F.col(value).alias("_next"))
    rows = carry_fill(rows, by, {"_prev": "_prev"}, chunk_rows=chunk_rows, exclusive=True)
    rows = carry_fill(rows, by, {"_next": "_next"}, backward=True, chunk_rows=chunk_rows, exclusive=True)
    rows = rows.where(F.col(value).isNotNull())
    begins = F.col("_prev").isNull() | (F.col("_prev") != F.col(value))
    rows = rows.withColumn("_run", F.when(begins, F.struct(F.col(IDX).alias("at"), F.col("_prev").alias("prev"))))
    rows = carry_fill(rows, by, {"_run": "_run"}, chunk_rows=chunk_rows)
    top = (F.col("_next") < F.col(value)) & (F.col("_run.prev") < F.col(value))
    return rows.where(top).select(
        *by, F.floor((F.col("_run.at") + F.col(IDX)) / 2).cast("bigint").alias(IDX), F.col(value).alias("height")
    )


def peak_params(df: DataFrame, series, value: str, height_sigma: float = 2.0, prominence_factor: float = 0.5) -> DataFrame:
    by = names(series)
    return df.groupBy(*by).agg(
        (F.avg(value) + height_sigma * F.stddev_pop(value)).alias("height_threshold"),
        (F.stddev_pop(value) * prominence_factor).alias("prominence_threshold"),
    )


def peaks_above(df: DataFrame, series, value: str, limits: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Peaks at least as high and prominent as the given limits: ``(series…, idx, height, prominence)``."""
    by = names(series)
    tops = attach_stats(local_maxima(df, by, value, chunk_rows), limits, by)
    tops = settle(tops.where(F.col("height") >= F.col("height_threshold")))
    asked = attach(df.where(F.col(value).isNotNull()).select(*by, IDX, value), tops.select(*by, IDX, F.lit(True).alias("_top")), [*by, IDX], "left")
    asked = settle(asked.withColumn("_top", F.col("_top").isNotNull()))
    sides = []
    for forward in (False, True):
        side = nearest_higher(asked, by, value, F.col("_top"), forward, True, chunk_rows)
        sides.append(side.select(*by, IDX, F.least("y", F.coalesce("low", "y")).alias("_base_r" if forward else "_base_l")))
    tops = attach(attach(tops, sides[0], [*by, IDX]), sides[1], [*by, IDX])
    tops = tops.withColumn("prominence", F.col("height") - F.greatest("_base_l", "_base_r"))
    return tops.where(F.col("prominence") >= F.col("prominence_threshold")).select(*by, IDX, "height", "prominence")


def peaks(df: DataFrame, series, value: str, height_sigma: float = 2.0, prominence_factor: float = 0.5, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``peak`` (flag) and ``prominence`` (null off the peaks)."""
    return with_peaks(df, series, value, peak_params(df, series, value, height_sigma, prominence_factor), chunk_rows)


def with_peaks(df: DataFrame, series, value: str, limits: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    by = names(series)
    found = peaks_above(df, by, value, limits, chunk_rows).select(*by, IDX, "prominence")
    rows = attach(df, found, [*by, IDX], "left")
    return rows.withColumn("peak", F.col("prominence").isNotNull())


def slopes(df: DataFrame, series, value: str, window: int = 20000, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``roll_avg`` and its step ``slope``."""
    return framed(
        df, series,
        lambda w: [rolling_exprs(w, value, window, {"roll_avg": "mean"}), {"slope": F.col("roll_avg") - F.lag("roll_avg").over(w)}],
        window, 0, chunk_rows,
    )


def slope_params(df: DataFrame, series, sigma: float = 3.0) -> DataFrame:
    by = names(series)
    mean, std = F.avg("slope"), F.stddev_samp("slope")
    return df.groupBy(*by).agg((mean + sigma * std).alias("slope_upper"), (mean - sigma * std).alias("slope_lower"))


def trend(df: DataFrame, series, value: str, window: int = 20000, sigma: float = 3.0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Flags slopes of the rolling mean outside their own mean ± sigma deviations."""
    rows = slopes(df, series, value, window, chunk_rows)
    rows = attach_stats(rows, slope_params(rows, series, sigma), series)
    outside = (F.col("slope") > F.col("slope_upper")) | (F.col("slope") < F.col("slope_lower"))
    return rows.withColumn("trend_anom", flag(outside)).drop("slope_upper", "slope_lower")


def cusum(df: DataFrame, series, value: str, mu0: Column, h: Column, k: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Two-sided CUSUM; row 0 starts both sums at 0 and is otherwise ignored."""
    first = F.col(IDX) == 0
    x = F.coalesce(F.col(value), mu0)
    steps = {
        "cusum_pos": F.when(first, 0.0).otherwise(x - mu0 - k),
        "cusum_neg": F.when(first, 0.0).otherwise(-(x - mu0 + k)),
    }
    rows = reflected_walk(df, series, steps, chunk_rows)
    return rows.withColumn("cusum_alarm", flag((F.col("cusum_pos") > h) | (F.col("cusum_neg") > h)))


def ewma(df: DataFrame, series, value: str, alpha: float, out: str = "ewma") -> DataFrame:
    """Exponentially weighted mean, weights normalised over the rows seen so far."""
    seen = F.when(F.col(value).isNotNull(), 1.0)
    rows = decayed_sums(df, series, {"_num": F.col(value), "_den": seen}, 1 - alpha)
    return rows.withColumn(out, F.try_divide("_num", "_den")).drop("_num", "_den")


def baseline(df: DataFrame, series, column: str, samples: int, h_factor: float = 4.0, k_factor: float = 0.5) -> DataFrame:
    """mu0, sigma0, h and k from the first ``samples`` rows of each series."""
    by = names(series)
    stats = df.where(F.col(IDX) < samples).groupBy(*by).agg(F.avg(column).alias("mu0"), F.stddev_samp(column).alias("sigma0"))
    return stats.select("*", (h_factor * F.col("sigma0")).alias("h"), (k_factor * F.col("sigma0")).alias("k"))


def ewma_cusum(
    df: DataFrame, series, value: str, alpha: float = 0.01, baseline_samples: int = 50000,
    h_factor: float = 4.0, k_factor: float = 0.5, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """CUSUM of the EWMA against its own first rows."""
    rows = ewma(df, series, value, alpha)
    rows = attach_stats(rows, baseline(rows, series, "ewma", baseline_samples, h_factor, k_factor), series)
    rows = cusum(rows, series, "ewma", F.col("mu0"), F.col("h"), F.col("k"), chunk_rows)
    return rows.drop("mu0", "sigma0", "h", "k")


def cusum_grid(
    df: DataFrame, series, value: str, alpha: float = 0.01, baseline_samples: int | None = 50000,
    combinations: Sequence[tuple[str, float, float]] = CUSUM_COMBINATIONS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Alarm count and rate (%) of every (h, k) combination, one row per series and combination."""
    by = names(series)
    rows = ewma(df.select(*by, IDX, value), by, value, alpha)
    stats = baseline(rows, by, "ewma", baseline_samples if baseline_samples is not None else 2**62)
    stats = stats.withColumn("sigma0", F.when(F.col("sigma0") == 0, 1e-10).otherwise(F.col("sigma0"))).drop("h", "k")
    rows = attach_stats(rows, stats, by)
    combos = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("combo"), F.lit(h).alias("h_factor"), F.lit(k).alias("k_factor"))
        for i, (n, h, k) in enumerate(combinations)
    ])
    rows = rows.withColumn("_c", F.explode(combos)).select("*", "_c.*").drop("_c")
    rows = rows.withColumn("h", F.col("h_factor") * F.col("sigma0")).withColumn("k", F.col("k_factor") * F.col("sigma0"))
    rows = cusum(rows, [*by, "combo"], "ewma", F.col("mu0"), F.col("h"), F.col("k"), chunk_rows)
    out = rows.groupBy(*by, "combo").agg(
        *[F.first(c).alias(c) for c in ("ord", "h_factor", "k_factor", "mu0", "sigma0", "h", "k")],
        F.count_if("cusum_alarm").alias("n_alarms"), F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("alarm_rate", F.col("n_alarms") / F.col("n") * 100).drop("n")


def select_cusum(calibration: DataFrame, series, test: DataFrame | None = None, strategy: str = "min_baseline_alarms") -> DataFrame:
    """Best combination per series; ties go to the earlier combination."""
    by = names(series)
    rate = F.col("alarm_rate")
    if strategy == "max_sensitivity":
        scored = calibration.withColumn("_score", -rate)
    elif strategy == "balanced" and test is not None:
        seen = test.select(*by, "combo", F.col("alarm_rate").alias("_test"))
        scored = attach(calibration, seen, [*by, "combo"]).withColumn("_score", rate - 0.1 * F.col("_test")).drop("_test")
    else:
        scored = calibration.withColumn("_score", rate)
    rest = [c for c in calibration.columns if c not in by]
    best = scored.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct("_score", "ord")).alias("_b"))
    return best.select(*by, "_b.*").drop("ord")


def ewma_chart(df: DataFrame, series, value: str, lam: float = 0.2, width: float = 3.0) -> DataFrame:
    """EWMA started at 0 against time-dependent limits around the series mean."""
    by = names(series)
    rows = decayed_sums(df, by, {"_num": F.col(value)}, 1 - lam).withColumn("ewma", F.lit(lam) * F.col("_num"))
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    rows = attach_stats(rows, stats, by)
    band = width * F.col("_sd") * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * (F.col(IDX) + 1))))
    rows = rows.withColumn("upper", F.col("_mu") + band).withColumn("lower", F.col("_mu") - band)
    outside = (F.col("ewma") > F.col("upper")) | (F.col("ewma") < F.col("lower"))
    return rows.withColumn("chart_anom", flag(outside)).drop("_num", "_mu", "_sd")


def sigma_flags(df: DataFrame, series, value: str, threshold: float = 3.0) -> DataFrame:
    """Flags values outside mean ± threshold population deviations."""
    by = names(series)
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    rows = attach_stats(df, stats, by)
    outside = (F.col(value) < F.col("_mu") - threshold * F.col("_sd")) | (F.col(value) > F.col("_mu") + threshold * F.col("_sd"))
    return rows.withColumn("sigma_anom", flag(outside)).drop("_mu", "_sd")


DEFAULTS = {
    "z_window": 5000, "z_threshold": 3.0, "mad_threshold": 3.5, "height_sigma": 2.0, "prominence_factor": 0.5,
    "trend_window": 20000, "trend_sigma": 3.0, "ewma_alpha": 0.01, "baseline_samples": 50000,
}
FLAGS = ("z_anom", "mad_anom", "peak", "trend_anom", "cusum_alarm")


def any_flag(columns: Sequence[str] = FLAGS) -> Column:
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out | F.col(c)
    return out


def analyze(df: DataFrame, series, value: str, **config) -> DataFrame:
    """All five point detectors and their union on every series.

    Features are computed and written once; thresholds are learned from them and applied to them.
    """
    from sensorloom.operators.thresholds import flag_points, point_features

    rows = settle(point_features(df, series, value, **config))
    return flag_points(rows, _learned(rows, series, value, **config), series, value)


def point_thresholds(df: DataFrame, series, value: str, **config) -> DataFrame:
    """What :func:`analyze` learned, one row per series, to apply to other data."""
    from sensorloom.operators.thresholds import point_features

    by = names(series)
    return _learned(point_features(df.select(*by, IDX, value), series, value, **config), series, value, **config)


def _learned(rows: DataFrame, series, value: str, **config) -> DataFrame:
    c, by = DEFAULTS | config, names(series)
    out = slope_params(rows, by, c["trend_sigma"])
    out = attach(out, peak_params(rows, by, value, c["height_sigma"], c["prominence_factor"]), by)
    out = attach(out, mad_params(rows, by, value), by)
    out = attach(out, baseline(rows, by, "ewma", c["baseline_samples"]), by)
    return out.withColumn("z_k", F.lit(c["z_threshold"])).withColumn("mad_k", F.lit(c["mad_threshold"]))


def summary(df: DataFrame, series, columns: Sequence[str] = (*FLAGS, "any_anom")) -> DataFrame:
    """Count and percentage of every flag per series."""
    by = names(series)
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).cast("boolean")).alias(c) for c in columns]
    )
    long = totals.unpivot([*by, "n"], list(columns), "detector", "n_anomalies")
    return long.withColumn("pct", F.col("n_anomalies") / F.col("n") * 100).drop("n")


def health_index(df: DataFrame, flags: Sequence[str], warning: int = 1, danger: int = 3) -> DataFrame:
    """Score = number of critical flags set; level 0/1/2 with its label."""
    score = F.lit(0)
    for c in flags:
        score = score + F.col(c).cast("int")
    rows = df.withColumn("health_score", score)
    level = F.when(F.col("health_score") >= danger, 2).when(F.col("health_score") >= warning, 1).otherwise(0)
    rows = rows.withColumn("health_level", level)
    label = F.when(F.col("health_level") == 2, "Danger").when(F.col("health_level") == 1, "Warning").otherwise("OK")
    return rows.withColumn("health_label", label)


def startup_class(current: Column, threshold: Column) -> Column:
    """Yellow (startup) when the current is below the threshold, otherwise red."""
    return F.when(flag(current < threshold), "yellow").otherwise("red")


def colour_class(cusum_warning: Column, current: Column, threshold: Column) -> Column:
    """Orange for a CUSUM warning, else yellow for a low current, else red."""
    return F.when(flag(cusum_warning.cast("boolean")), "orange").when(flag(current < threshold), "yellow").otherwise("red")


def residuals(actual: DataFrame, predicted: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    both = attach(actual, predicted.select(*keys, p), list(keys))
    return both.withColumn("residual", F.col(y) - F.col(p))


def evaluate_binary(df: DataFrame, flag_column: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates; an empty denominator gives 0."""
    p, t = F.col(flag_column).cast("boolean"), F.col(truth).cast("boolean")
    out = df.groupBy(*by).agg(
        F.count_if(p & t).alias("tp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"), F.count_if(p & ~t).alias("fp")
    )

    def rate(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fn, tn, fp = (F.col(c) for c in ("tp", "fn", "tn", "fp"))
    out = out.withColumn("recall", rate(tp, tp + fn)).withColumn("precision", rate(tp, tp + fp))
    out = out.withColumn("specificity", rate(tn, tn + fp)).withColumn("fpr", rate(fp, tn + fp))
    out = out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
