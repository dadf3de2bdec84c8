"""Descriptive statistics, stationarity tests and similarity between signals."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.normal import inverse_normal, kolmogorov_p, normal_cdf, pearson_p
from sensorloom.kernels import (
    CHUNK_ROWS, IDX, attach, attach_stats, cells_to_matrix, framed, gram_cells, names, prefix_sums, quantiles, running_counts, solve_ridge,
)
from sensorloom.operators.windows import centred_mean
from sensorloom.session import settle


def adjusted_skewness(value: str) -> Column:
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1.0)) / (n - 2))


def adjusted_kurtosis(value: str) -> Column:
    """Sample-adjusted excess kurtosis."""
    n = F.count(value)
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(value) + 6))


def describe(df: DataFrame, series, value: str) -> DataFrame:
    by = names(series)
    base = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
        adjusted_skewness(value).alias("skewness"), adjusted_kurtosis(value).alias("kurtosis"),
    )
    q = quantiles(df, by, value, [0.25, 0.5, 0.75])
    q = q.select(*by, F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
    return attach(base, q, by, "left")


def iqr_outliers(df: DataFrame, series, value: str, k: float = 1.5) -> DataFrame:
    by = names(series)
    q = quantiles(df, by, value, [0.25, 0.75]).select(*by, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q75"))
    spread = F.col("q75") - F.col("q25")
    q = q.select(*by, (F.col("q25") - k * spread).alias("lower"), (F.col("q75") + k * spread).alias("upper"))
    rows = attach_stats(df, q, by)
    out = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return rows.groupBy(*by).agg(
        F.first("lower").alias("lower"), F.first("upper").alias("upper"), F.count_if(out).alias("outliers"),
        (F.count_if(out) / F.count(value) * 100).alias("pct"),
    )


def correlations(df: DataFrame, columns: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Pearson r of every pair of columns in one pass, strongest first; optionally only |r| above a threshold."""
    pairs = list(combinations(columns, 2))
    row = df.agg(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs
    ]).alias("p"))
    out = row.select(F.explode("p").alias("p")).select("p.*")
    if threshold is not None:
        out = out.where(F.abs("r") > threshold)
    return out.orderBy(F.desc(F.abs("r")), "a", "b")


def histogram(df: DataFrame, by, value: str, bins: int = 50) -> DataFrame:
    """Equal bins over each group's own range (last bin closed): ``(by…, bin, n, density)``."""
    by = names(by)
    span = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    rows = attach_stats(df.where(F.col(value).isNotNull()), span, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return rows.groupBy(*by, slot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col("_n") * width).alias("_w")
    ).select(*by, "bin", "n", F.try_divide("n", "_w").alias("density"))


def qq_points(df: DataFrame, series, value: str, probabilities: Sequence[float]) -> DataFrame:
    """Sample quantiles against standard-normal quantiles at the same probabilities."""
    by = names(series)
    normal = inverse_normal(np.array(probabilities))
    points = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(float(z)).alias("normal")) for p, z in zip(probabilities, normal)])
    q = quantiles(df, by, value, probabilities)
    zipped = q.select(*by, F.explode(F.zip_with(points, F.col("q"), lambda a, v: F.struct(a["p"].alias("p"), a["normal"].alias("normal"), v.alias("sample")))).alias("x"))
    return zipped.select(*by, "x.*")


def qq_pair(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Quantiles of two columns against each other."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "_f", "_v")
    q = quantiles(long, "_f", "_v", probabilities).select("_f", F.posexplode("q").alias("i", "v"))
    wide = q.groupBy("i").pivot("_f", list(columns)).agg(F.max("v"))
    return wide.withColumn("p", F.element_at(F.array(*[F.lit(float(p)) for p in probabilities]), F.col("i") + 1)).drop("i")


def value_counts(df: DataFrame, by, value: str) -> DataFrame:
    """Distinct values in order with their running count ``upto`` — hot values are one row each."""
    by = names(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    return running_counts(counts, by, value, {"upto": "c"})


@F.pandas_udf(T.DoubleType())
def _phi(z: pd.Series) -> pd.Series:
    return pd.Series(normal_cdf(z.to_numpy()))


@F.pandas_udf(T.DoubleType())
def _ks_p(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([kolmogorov_p(a, b) for a, b in zip(d, n)])


@F.pandas_udf(T.DoubleType())
def _pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([pearson_p(a, int(b)) for a, b in zip(r, n)])


def ks_normal(df: DataFrame, series, value: str) -> DataFrame:
    """Kolmogorov–Smirnov distance of the standardised series to the normal, its p value and the verdict."""
    by = names(series)
    stats = settle(df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")))
    ranked = attach(value_counts(df, by, value), stats, by)
    ranked = ranked.withColumn("_p", _phi((F.col(value) - F.col("_m")) / F.col("_s")))
    gap = F.greatest(F.col("upto") / F.col("n") - F.col("_p"), F.col("_p") - (F.col("upto") - F.col("c")) / F.col("n"))
    out = ranked.groupBy(*by).agg(F.max(gap).alias("ks"), F.first("n").alias("n"))
    return out.withColumn("p_value", _ks_p("ks", F.col("n").cast("double"))).withColumn("normal", F.col("p_value") > 0.05)


def autocorrelations(df: DataFrame, series, value: str, lags: int = 50) -> DataFrame:
    """``(series…, n, acf array)`` for lags 0…lags, one aggregate over lag products."""
    by = names(series)
    mean = df.groupBy(*by).agg(F.avg(value).alias("_m"))
    rows = attach_stats(df.select(*by, IDX, value), mean, by).withColumn("_x", F.col(value) - F.col("_m"))
    rows = framed(rows, by, lambda w: {f"_l{k}": F.col("_x") * F.lag("_x", k).over(w) for k in range(1, lags + 1)}, lags)
    sums = rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.array(F.sum(F.col("_x") * F.col("_x")), *[F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) for k in range(1, lags + 1)]).alias("g")
    )
    return sums.select(*by, "n", F.transform("g", lambda v: v / F.col("g")[0]).alias("acf"), (F.col("g")[0] / F.col("n")).alias("variance"))


def acf(df: DataFrame, series, value: str, lags: int = 50) -> DataFrame:
    """One row per lag with the 95 % band and whether the lag exceeds it."""
    by = names(series)
    rows = autocorrelations(df, by, value, lags).withColumn("conf", 1.96 / F.sqrt("n"))
    rows = rows.select(*by, "conf", F.posexplode("acf").alias("lag", "acf"))
    return rows.withColumn("significant", F.abs("acf") > F.col("conf"))


def lagged_correlations(df: DataFrame, series, columns: Sequence[str], max_lag: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(series…, first, second, lag, r)``: how ``first`` goes with ``second`` ``lag`` rows later, for all ordered pairs of columns and lags 0 … ``max_lag``.

    r is the sum of products of standardised values over the number of rows; a null counts as the mean, a constant column has r 0.
    Chunks take the ``max_lag`` rows after their end along, so every product is made once and all pairs and lags come from one pass.
    """
    by, columns = names(series), list(columns)
    stats = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[f(c).alias(f"_{p}_{c}") for c in columns for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))])
    z = F.array(*[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns])
    size = max(chunk_rows, max_lag, 1)
    home = F.floor(F.col(IDX) / size).cast("bigint")
    rows = attach_stats(df.select(*by, IDX, *columns), stats, by).select(*by, IDX, "_n", z.alias("_z"), home.alias("_home"))
    before = F.when((F.col(IDX) - home * size < max_lag) & (home > 0), home - 1)
    rows = rows.withColumn("_chunk", F.explode(F.array_compact(F.array("_home", before))))
    fields = "".join(f"`{c}` {dict(df.dtypes)[c]}, " for c in by)

    def products(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(IDX)
        x, own = np.stack(chunk["_z"].to_numpy()), int((chunk["_home"] == chunk["_chunk"]).sum())
        lags = range(min(max_lag, len(x) - 1) + 1) if own else []
        made = [x[: min(own, len(x) - lag)].T @ x[lag : lag + min(own, len(x) - lag)] for lag in lags]
        out = pd.DataFrame({"lag": np.arange(len(made), dtype="int32"), "v": [m.ravel().tolist() for m in made]})
        return out.assign(**{c: pd.Series([chunk[c].iloc[0]] * len(made), dtype=object) for c in by})

    made = rows.groupBy(*by, "_chunk").applyInPandas(products, f"{fields}lag int, v array<double>")
    summed = made.select(*by, "lag", F.posexplode("v").alias("_k", "_v")).groupBy(*by, "lag", "_k").agg(F.sum("_v").alias("_v"))
    named = F.array(*[F.lit(c) for c in columns])
    out = attach_stats(summed, stats.select(*by, "_n"), by)
    return out.select(
        *by, F.get(named, F.floor(F.col("_k") / len(columns)).cast("int")).alias("first"), F.get(named, F.col("_k") % len(columns)).alias("second"), "lag",
        (F.col("_v") / F.col("_n")).alias("r"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _durbin(acfs: pd.Series) -> pd.Series:
    out = []
    for r in acfs:
        r = np.asarray(r)
        phi, partial, error = np.zeros(0), [1.0], 1.0
        for k in range(1, len(r)):
            a = (r[k] - phi @ r[k - 1 : 0 : -1]) / error if k > 1 else r[1]
            phi = np.r_[phi - a * phi[::-1], a]
            error *= 1 - a * a
            partial.append(a)
        out.append(partial)
    return pd.Series(out)


def pacf(df: DataFrame, series, value: str, lags: int = 50) -> DataFrame:
    """Partial autocorrelations by the Levinson–Durbin recursion on the ACF numbers."""
    by = names(series)
    rows = autocorrelations(df, by, value, lags).withColumn("conf", 1.96 / F.sqrt("n"))
    rows = rows.select(*by, "conf", F.posexplode(_durbin("acf")).alias("lag", "pacf"))
    return rows.withColumn("significant", F.abs("pacf") > F.col("conf"))


# MacKinnon's response surface for the constant-only unit-root p value.
_ADF_RANGE = (-18.83, -1.61, 2.74)
_ADF_SMALL = (2.1659, 1.4412, 0.038269)
_ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# KPSS critical values (level) and their p values.
_KPSS_CRITICAL = (0.347, 0.463, 0.574, 0.739)
_KPSS_P = (0.10, 0.05, 0.025, 0.01)


def adf_p(tau: float) -> float:
    low, star, high = _ADF_RANGE
    if tau < low:
        return 0.0
    if tau > high:
        return 1.0
    poly = np.polynomial.polynomial.polyval(tau, _ADF_SMALL if tau <= star else _ADF_LARGE)
    return float(normal_cdf(np.array([poly]))[0])


def adf(df: DataFrame, series, value: str, max_lag: int = 30) -> DataFrame:
    """Augmented Dickey–Fuller test with a constant, the lag chosen by AIC on a common sample."""
    by = names(series)
    rows = df.select(*by, IDX, F.col(value).cast("double").alias("x"))

    def build(w):
        step = lambda i: F.lag("x", i).over(w) - F.lag("x", i + 1).over(w)
        return {"row": F.array(F.lit(1.0), F.lag("x", 1).over(w), *[step(i) for i in range(1, max_lag + 1)], F.col("x") - F.lag("x", 1).over(w))}

    rows = framed(rows, by, build, max_lag + 1).select(*by, IDX, "row")
    fields = "".join(f"{c} {t}, " for c, t in rows.dtypes if c in by)
    last = max_lag + 2

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        g = cells_to_matrix(pdf)
        n, scores = g[0, 0], []
        for p in range(max_lag + 1):
            _, sse = solve_ridge(g, list(range(p + 2)), [last])
            scores.append(n * np.log(max(sse[0, 0], 1e-300) / n) + 2 * (p + 2))
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "lag": int(np.argmin(scores))}])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        p, g = int(pdf["lag"].iloc[0]), cells_to_matrix(pdf)
        used = list(range(p + 2))
        beta, sse = solve_ridge(g, used, [last])
        n = g[0, 0]
        error = math.sqrt(max(sse[0, 0], 0) / (n - len(used)) * np.linalg.pinv(g[np.ix_(used, used)])[1, 1])
        tau = float(beta[1, 0] / error)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, "lag": p, "statistic": tau, "p_value": adf_p(tau), "n": int(n)}])

    def grouped(cells: DataFrame) -> DataFrame:
        return cells.groupBy(*by) if by else cells.groupBy()

    common = gram_cells(rows.where(F.col(IDX) > max_lag), "row", by)
    chosen = settle(grouped(common).applyInPandas(choose, f"{fields}lag int"))
    own = attach(rows, chosen, by).where(F.col(IDX) > F.col("lag"))
    masked = F.transform("row", lambda v, i: F.when((i <= F.col("lag") + 1) | (i == last), v).otherwise(0.0))
    cells = attach(gram_cells(own.withColumn("row", masked), "row", by), chosen, by)
    out = grouped(cells).applyInPandas(test, f"{fields}lag int, statistic double, p_value double, n bigint")
    return out.withColumn("stationary", F.col("p_value") < 0.05)


@F.pandas_udf(T.DoubleType())
def _kpss_p(stat: pd.Series) -> pd.Series:
    return pd.Series(np.interp(stat.to_numpy(), _KPSS_CRITICAL, _KPSS_P))


def kpss(df: DataFrame, series, value: str, lags: int | None = None) -> DataFrame:
    """KPSS level-stationarity statistic; the lag is chosen from the data unless given."""
    by = names(series)
    rows = df.select(*by, IDX, F.col(value).cast("double").alias("x"))
    stats = settle(rows.groupBy(*by).agg(F.avg("x").alias("_m"), F.count("x").alias("n")))
    longest = stats.agg(F.max("n")).first()[0] or 0
    if lags is None:
        first = max(1, int(longest ** (2 / 9)))
        auto = autocorrelations(rows, by, "x", first)
        own = F.floor(F.pow(F.col("n").cast("double"), F.lit(2 / 9)))
        kept = F.filter(F.transform("acf", lambda r, i: F.struct(i.cast("double").alias("i"), r.alias("r"))), lambda s: (s["i"] >= 1) & (s["i"] <= own))
        s0 = F.lit(1.0) + F.aggregate(kept, F.lit(0.0), lambda a, s: a + 2 * s["r"])
        s1 = F.aggregate(kept, F.lit(0.0), lambda a, s: a + 2 * s["i"] * s["r"])
        gamma = 1.1447 * F.pow(F.pow(s1 / s0, 2), F.lit(1 / 3))
        chosen = settle(auto.select(*by, F.least(F.floor(gamma * F.pow(F.col("n").cast("double"), F.lit(1 / 3))), F.col("n") - 1).cast("int").alias("lags")))
    else:
        chosen = settle(stats.select(*by, F.lit(lags).alias("lags")))
    deepest = chosen.agg(F.max("lags")).first()[0] or 0
    centred = attach(rows, stats, by).withColumn("_e", F.col("x") - F.col("_m"))
    walked = prefix_sums(centred.select(*by, IDX, "_e", "n"), by, {"_s": F.col("_e")})
    eta = walked.groupBy(*by).agg((F.sum(F.col("_s") * F.col("_s")) / F.pow(F.first("n").cast("double"), F.lit(2))).alias("_eta"))
    spread = attach(autocorrelations(rows, by, "x", max(1, deepest)), chosen, by)
    terms = F.filter(F.transform("acf", lambda r, i: F.struct(i.cast("double").alias("i"), r.alias("r"))), lambda s: (s["i"] >= 1) & (s["i"] <= F.col("lags")))
    long_run = F.col("variance") * (1 + F.aggregate(terms, F.lit(0.0), lambda a, s: a + 2 * s["r"] * (1 - s["i"] / (F.col("lags") + 1))))
    out = attach(spread.select(*by, "n", "lags", long_run.alias("_v")), eta, by)
    out = out.select(*by, "n", "lags", (F.col("_eta") / F.col("_v")).alias("statistic"))
    return out.withColumn("p_value", _kpss_p("statistic")).withColumn("stationary", F.col("p_value") > 0.05)


def stationarity(adf_result: DataFrame, kpss_result: DataFrame, series) -> DataFrame:
    by = names(series)
    a = adf_result.select(*by, F.col("statistic").alias("adf"), F.col("p_value").alias("adf_p"), F.col("stationary").alias("_a"))
    k = kpss_result.select(*by, F.col("statistic").alias("kpss"), F.col("p_value").alias("kpss_p"), F.col("stationary").alias("_k"))
    label = F.when(F.col("_a") & F.col("_k"), "Stationary").when(~F.col("_a") & ~F.col("_k"), "Non-stationary").otherwise("Inconclusive")
    return attach(a, k, by).withColumn("label", label).drop("_a", "_k")


def decompose(df: DataFrame, series, value: str, period: int) -> DataFrame:
    """Additive trend (centred mean over a period), seasonal (mean per phase) and residual.

    Series shorter than three periods are left out.
    """
    by = names(series)
    lengths = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = attach_stats(df, lengths, by).where(F.col("_n") >= 3 * period).drop("_n")
    if period % 2:
        rows = centred_mean(rows, by, value, period, "trend")
    else:
        half = period // 2

        def build(w):
            inner = F.sum(value).over(w.rowsBetween(-half + 1, half - 1))
            ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
            return {"trend": (inner + ends / 2) / period}

        rows = framed(rows, by, build, half, half)
    rows = rows.withColumn("phase", (F.col(IDX) % period).cast("int"))
    detrended = rows.groupBy(*by, "phase").agg(F.avg(F.col(value) - F.col("trend")).alias("_p"))
    level = detrended.groupBy(*by).agg(F.avg("_p").alias("_l"))
    season = attach(detrended, level, by).select(*by, "phase", (F.col("_p") - F.col("_l")).alias("seasonal"))
    rows = attach_stats(rows, season, [*by, "phase"])
    return rows.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal"))


def explore(df: DataFrame, series, value: str, every: int = 10, max_lag: int = 30, lags: int = 50) -> DataFrame:
    """Summary row per series: statistics on all rows; normality, stationarity and ACF on every ``every``-th (null where these are too few)."""
    by = names(series)
    thin = df.where(F.col(IDX) % every == 0).withColumn(IDX, (F.col(IDX) / every).cast("bigint"))
    out = attach(describe(df, by, value), iqr_outliers(df, by, value).select(*by, "outliers"), by)
    out = attach(out, ks_normal(thin, by, value).select(*by, F.col("ks").alias("ks_normal"), "normal"), by, "left")
    labels = stationarity(adf(thin, by, value, max_lag), kpss(thin, by, value), by)
    out = attach(out, labels, by, "left")
    strong = acf(thin, by, value, lags).where("lag > 0").groupBy(*by).agg(F.count_if("significant").alias("significant_lags"))
    return attach(out, strong, by, "left")


# --------------------------------------------------------------------- similarity


def similarity(lab: DataFrame, field: DataFrame, pairs: Sequence[tuple[str, str]], bins: int = 50) -> DataFrame:
    """Five similarity measures and their weighted score for each (lab column, field column) pair.

    Both tables are indexed; columns are standardised on their own data and cut
    to the shorter table.  Both sides stand side by side in one wide table, written once; correlations and
    moments of all pairs come from one pass over it.  Ranks and cumulative shares come from the counts of distinct
    values, not from rows.  Only a few numbers per column and pair reach the driver.
    """
    spark = lab.sparkSession
    columns = {s: sorted({p[at] for p in pairs}) for at, s in enumerate("ab")}
    means = {
        s: df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in columns[s] for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        for s, df in (("a", lab), ("b", field))
    }
    n = min(m["n"] for m in means.values())

    def standardised(side: str, df: DataFrame) -> DataFrame:
        out = []
        for c in columns[side]:
            mean, spread = means[side][f"m_{c}"], means[side][f"s_{c}"]
            z = (F.col(c) - F.lit(mean)) / F.lit(spread) if spread else F.lit(0.0)
            out.append(F.when(F.col(c).isNotNull(), z).alias(f"{side}_{c}"))
        return df.where(F.col(IDX) < n).select(IDX, *out)

    wide = settle(attach(standardised("a", lab), standardised("b", field), IDX))
    every = [f"{s}_{c}" for s in "ab" for c in columns[s]]
    shape = {"m": F.avg, "sd": F.stddev_pop, "k3": F.skewness, "k4": F.kurtosis, "lo": F.min, "hi": F.max}
    # few aggregates at a time: Spark compiles no code for rows of more than a hundred numbers
    asked = [[f(c).alias(f"{k}|{c}") for k, f in shape.items()] for c in every]
    asked += [[F.corr(f"a_{a}", f"b_{b}").alias(f"r|{a}|{b}") for a, b in pairs[i : i + 4]] for i in range(0, len(pairs), 4)]
    row = {}
    for i in range(0, len(asked), 3):
        row |= wide.agg(*[c for some in asked[i : i + 3] for c in some]).first().asDict()

    long = wide.unpivot([IDX], every, "name", "z").where(F.col("z").isNotNull())
    counts = settle(long.groupBy("name", "z").agg(F.count(F.lit(1)).alias("c")))

    def slot(c: str) -> Column:
        width = ((row[f"hi|{c}"] or 0.0) - (row[f"lo|{c}"] or 0.0)) / bins
        # a value on a border, to nine digits, is in the bin above
        place = F.least(F.floor(F.round((F.col("z") - F.lit(row[f"lo|{c}"])) / F.lit(width), 9)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        return F.when(F.col("name") == c, place.cast("int"))

    bars: dict[str, dict[int, int]] = {c: {} for c in every}
    for r in counts.groupBy("name", F.coalesce(*map(slot, every)).alias("bin")).agg(F.sum("c").alias("c")).where("bin IS NOT NULL").collect():
        bars[r["name"]][r["bin"]] = r["c"]

    # a column's ranks are a table of its own, so that few values are few rows to join and no row is turned into one for each column
    ranked = settle(running_counts(counts, "name", "z", {"upto": "c"}).select("name", "z", (F.col("upto") - (F.col("c") - 1) / 2).alias("rank")))
    ranks = wide.drop(IDX)
    for c in every:
        own = settle(ranked.where(F.col("name") == c).select(F.col("z").alias(c), F.col("rank").alias(f"_rank_{c}")))
        ranks = ranks.join(own, c, "left").drop(c).withColumnRenamed(f"_rank_{c}", c)
    rho = ranks.agg(*[F.corr(f"a_{a}", f"b_{b}").alias(f"r|{a}|{b}") for a, b in pairs]).first()

    uses = {c: [] for c in every}
    for a, b in pairs:
        uses[f"a_{a}"].append((f"{a}|{b}", 1, 0))
        uses[f"b_{b}"].append((f"{a}|{b}", 0, 1))
    uses = F.create_map(*[x for c, us in uses.items() for x in (F.lit(c), F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(i).alias("i"), F.lit(j).alias("j")) for p, i, j in us]))])
    steps = counts.select(F.explode(F.element_at(uses, F.col("name"))).alias("u"), "z", "c")
    steps = steps.groupBy("u.pair", "z").agg(F.sum(F.col("u.i") * F.col("c")).alias("ca"), F.sum(F.col("u.j") * F.col("c")).alias("cb"))
    steps = running_counts(steps, "pair", "z", {"ua": "ca", "ub": "cb"})
    gaps = {r["pair"]: r["d"] for r in steps.groupBy("pair").agg((F.max(F.abs(F.col("ua") - F.col("ub"))) / n).alias("d")).collect()}

    out = []
    for a, b in pairs:
        left, right = bars[f"a_{a}"], bars[f"b_{b}"]
        size = math.sqrt(sum(v * v for v in left.values()) * sum(v * v for v in right.values()))
        cosine = sum(v * right.get(k, 0) for k, v in left.items()) / size if size else None
        differ = lambda k: None if None in (x := (row[f"{k}|a_{a}"], row[f"{k}|b_{b}"])) else abs(x[0] - x[1])  # noqa: B023, E731
        parts = [differ("m"), differ("sd"), differ("k3"), differ("k4")]
        moments = None if None in parts else 1 / (1 + parts[0] + parts[1] + parts[2] / 10 + parts[3] / 100)
        out.append((a, b, row[f"r|{a}|{b}"], rho[f"r|{a}|{b}"], gaps.get(f"{a}|{b}"), cosine, moments))
    table = spark.createDataFrame(out, "lab_feature string, field_feature string, r double, rho double, ks_statistic double, histogram_cosine double, moments_similarity double")
    table = table.select(
        "lab_feature", "field_feature", F.abs("r").alias("pearson_corr"), _pearson_p("r", F.lit(n)).alias("pearson_p"), F.abs("rho").alias("spearman_corr"),
        "ks_statistic", (1 - F.col("ks_statistic")).alias("ks_similarity"), "histogram_cosine", "moments_similarity",
    )
    score = (0.3 * F.col("pearson_corr") + 0.2 * F.col("spearman_corr") + 0.2 * F.col("ks_similarity")
             + 0.15 * F.col("histogram_cosine") + 0.15 * F.col("moments_similarity"))
    return table.withColumn("overall_score", score)


def best_mapping(scores: DataFrame) -> DataFrame:
    """Primary pair (highest score) and secondary pair (highest with another field column)."""
    scores = settle(scores.select("lab_feature", "field_feature", "overall_score"))
    first = scores.orderBy(F.desc("overall_score"), "lab_feature", "field_feature").limit(1)
    others = scores.join(first.select("field_feature"), "field_feature", "left_anti")
    second = others.orderBy(F.desc("overall_score"), "lab_feature", "field_feature").limit(1)
    tag = lambda df, role: df.select(F.lit(role).alias("role"), "lab_feature", "field_feature", "overall_score")
    return tag(first, "primary").unionByName(tag(second, "secondary"))
