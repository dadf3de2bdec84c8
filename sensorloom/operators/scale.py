"""Scalers and domain adapters: ``fit`` aggregates to a few numbers, ``transform`` is column arithmetic."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.normal import inverse_normal
from sensorloom.kernels import attach_stats, quantiles

PARAMS_SCHEMA = "feature string, centre double, scale double"


class DomainAdapter(ABC):
    """Learns from a source table and re-expresses a target table in its terms."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    @abstractmethod
    def fit(self, source: DataFrame) -> DomainAdapter: ...

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class Identity(DomainAdapter):
    def fit(self, source: DataFrame) -> DomainAdapter:
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df


class LinearScaler(DomainAdapter):
    """``(x - centre) / scale`` with one centre and scale per column."""

    centre: dict[str, float]
    scale: dict[str, float]

    def _replace(self, df: DataFrame, fn) -> DataFrame:
        return df.select(*[fn(c).alias(c) if c in self.columns else F.col(c) for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        return self._replace(df, lambda c: (F.col(c) - F.lit(self.centre[c])) / F.lit(self.scale[c]))

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._replace(df, lambda c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.centre[c]))

    def params(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c, self.centre[c], self.scale[c]) for c in self.columns], PARAMS_SCHEMA)

    def _set(self, centre: Sequence[float], scale: Sequence[float]) -> None:
        self.centre = {c: float(v) for c, v in zip(self.columns, centre)}
        self.scale = {c: float(v) if v else 1.0 for c, v in zip(self.columns, scale)}


class StandardScaler(LinearScaler):
    """Mean and population standard deviation; a constant column keeps scale 1."""

    def fit(self, source: DataFrame) -> StandardScaler:
        row = source.agg(*[F.avg(c) for c in self.columns], *[F.stddev_pop(c) for c in self.columns]).first()
        self._set(row[: len(self.columns)], row[len(self.columns) :])
        return self


class RobustScaler(LinearScaler):
    """Median and interquartile range."""

    def fit(self, source: DataFrame) -> RobustScaler:
        found = feature_quantiles(source, self.columns, [0.25, 0.5, 0.75])
        self._set([found[c][1] for c in self.columns], [found[c][2] - found[c][0] for c in self.columns])
        return self


class MinMaxScaler(LinearScaler):
    def fit(self, source: DataFrame) -> MinMaxScaler:
        row = source.agg(*[F.min(c) for c in self.columns], *[F.max(c) for c in self.columns]).first()
        low, high = row[: len(self.columns)], row[len(self.columns) :]
        self._set(low, [h - lo for lo, h in zip(low, high)])
        return self


def feature_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> dict[str, list[float]]:
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    return {r["feature"]: list(r["q"]) for r in quantiles(long, "feature", "value", qs).collect()}


class QuantileNormal(DomainAdapter):
    """Maps each column through its learned quantile grid to a standard normal."""

    def __init__(self, columns: Sequence[str], n_quantiles: int = 1000):
        super().__init__(columns)
        self.n_quantiles = n_quantiles

    def fit(self, source: DataFrame) -> QuantileNormal:
        size = max(2, min(self.n_quantiles, source.limit(self.n_quantiles).count()))
        self.grid = np.linspace(0, 1, size)
        self.marks = {c: np.array(q) for c, q in feature_quantiles(source, self.columns, self.grid.tolist()).items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        grid, marks = self.grid, self.marks
        edge = 1e-7

        def mapper(column: str):
            points = marks[column]

            @F.pandas_udf("double")
            def to_normal(x: pd.Series) -> pd.Series:
                v = x.to_numpy(dtype="float64")
                up = np.interp(v, points, grid)
                down = -np.interp(-v, -points[::-1], -grid[::-1])
                return pd.Series(inverse_normal(np.clip((up + down) / 2, edge, 1 - edge))).where(x.notna())

            return to_normal(F.col(column))

        return df.select(*[mapper(c).alias(c) if c in self.columns else F.col(c) for c in df.columns])


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariance in one aggregate (k × k numbers reach the driver)."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(
        *[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]
    ).first()
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[k:]):
        cov[i, j] = cov[j, i] = v
    return np.array(row[:k], dtype="float64"), cov


def _power(cov: np.ndarray, exponent: float, floor: float) -> np.ndarray:
    values, vectors = np.linalg.eigh(cov)
    return (vectors * np.maximum(values, floor) ** exponent) @ vectors.T


class Coral(DomainAdapter):
    """Whitens a target with its own covariance and colours it with the source's."""

    def __init__(self, columns: Sequence[str], regularization: float = 1e-6):
        super().__init__(columns)
        self.reg = regularization

    def fit(self, source: DataFrame) -> Coral:
        self.mean, cov = covariance(source, self.columns)
        self.colour = _power(cov + self.reg * np.eye(len(self.columns)), 0.5, self.reg)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        mean, cov = covariance(df, self.columns)
        whiten = _power(cov + self.reg * np.eye(len(self.columns)), -0.5, self.reg)
        mix = whiten @ self.colour
        moved = {}
        for j, name in enumerate(self.columns):
            expr = F.lit(float(self.mean[j]))
            for i, source in enumerate(self.columns):
                expr = expr + (F.col(source) - F.lit(float(mean[i]))) * F.lit(float(mix[i, j]))
            moved[name] = expr
        return df.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in df.columns])


ADAPTERS = {
    "none": Identity,
    "standard": StandardScaler,
    "robust": RobustScaler,
    "min_max": MinMaxScaler,
    "quantile": QuantileNormal,
    "coral": Coral,
}


def standardise_with(df: DataFrame, params: DataFrame, feature: str, value: str, out: str) -> DataFrame:
    """Long-form standardisation with a stored ``(feature, centre, scale)`` table; scale 0 gives 0."""
    named = params.select(F.col("feature").alias(feature), F.col("centre").alias("_c"), F.col("scale").alias("_s"))
    rows = attach_stats(df, named, feature)
    return rows.withColumn(
        out, F.when(F.col("_s") == 0, 0.0).otherwise((F.col(value) - F.col("_c")) / F.col("_s"))
    ).drop("_c", "_s")


def compare_params(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Largest differences between two fitted parameter tables and the verdict."""
    other = b.select("feature", F.col("centre").alias("_c"), F.col("scale").alias("_s"))
    both = a.join(other, "feature", "full")
    gap = lambda x, y: F.max(F.coalesce(F.abs(F.col(x) - F.col(y)), F.lit(float("inf"))))
    return both.agg(gap("centre", "_c").alias("max_centre_diff"), gap("scale", "_s").alias("max_scale_diff")).withColumn(
        "same", (F.col("max_centre_diff") <= tolerance) & (F.col("max_scale_diff") <= tolerance)
    )


def combine_scores(df: DataFrame, columns: Sequence[str], out: str = "combined", by: Sequence[str] = ()) -> DataFrame:
    """Mean of min-max normalised scores."""
    bounds = df.groupBy(*by).agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    rows = attach_stats(df, bounds, list(by))
    unit = [
        F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)) for c in columns
    ]
    total = unit[0]
    for u in unit[1:]:
        total = total + u
    return rows.withColumn(out, total / len(columns)).drop(*[f"_{p}_{c}" for c in columns for p in ("lo", "hi")])
