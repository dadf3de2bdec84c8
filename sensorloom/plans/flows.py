"""Composed flows: residual dispatch, calibrate–validate–apply, detector sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.kernels import IDX, attach
from sensorloom.operators import detect, outliers, scale, thresholds
from sensorloom.session import settle


def detect_residuals(
    df: DataFrame, method: str = "zscore", threshold: float = 3.0, feature: str = "feature", value: str = "residual",
    window: int = 100, contamination: float = 0.01, n_neighbors: int = 40,
) -> DataFrame:
    """Add ``anomaly`` to long residuals by one of five methods.

    ``isolation_forest`` and ``lof`` look at all features of a row together and
    flag the whole row.
    """
    if method == "zscore":
        return detect.zscore(df, feature, value, window, threshold).withColumnRenamed("z_anom", "anomaly")
    if method == "mad":
        return detect.mad(df, feature, value, threshold).withColumnRenamed("mad_anom", "anomaly")
    if method == "sigma":
        return detect.sigma_flags(df, feature, value, threshold).withColumnRenamed("sigma_anom", "anomaly")
    if method not in ("isolation_forest", "lof"):
        raise ValueError(f"unsupported method {method!r}")
    features = sorted(r[0] for r in df.select(feature).distinct().collect())
    wide = df.groupBy(IDX).pivot(feature, features).agg(F.max(value)).na.drop()
    if method == "isolation_forest":
        rows = outliers.IsolationForest(features, [IDX], contamination).fit(wide).predict(wide).select(IDX, "anomaly")
    else:
        points = wide.select(F.col(IDX).alias("id"), F.array(*features).alias("vec"))
        rows = outliers.lof_flags(points, n_neighbors, contamination).select(F.col("id").alias(IDX), "anomaly")
    return attach(df, rows, [IDX], "left").withColumn("anomaly", detect.flag(F.col("anomaly")))


def colour_counts(df: DataFrame, feature: str, anomalous: Column, cusum: Column, current: Column, cut: Column) -> DataFrame:
    """Anomalies per feature by cause: startup, cusum, other."""
    cause = detect.colour_class(cusum, current, cut)
    return df.groupBy(feature).agg(
        F.count_if(anomalous & (cause == "yellow")).alias("startup"),
        F.count_if(anomalous & (cause == "orange")).alias("cusum"),
        F.count_if(anomalous & (cause == "red")).alias("other"),
    )


def calibrate_validate_apply(
    lab: DataFrame, fatigue: DataFrame, field: DataFrame, lab_weight: float = 1.0, fatigue_weight: float = 1.0, feature: str = "feature", value: str = "residual",
) -> dict[str, DataFrame]:
    """Thresholds from lab residuals, checked on and combined with fatigue, applied to the field."""
    learned = settle(thresholds.calibrate(lab, feature, value))
    validation = thresholds.validate_thresholds(fatigue, learned, feature, value, fatigue_weight)
    again = thresholds.calibrate(fatigue, feature, value)
    combined = thresholds.combine_weighted([(learned, lab_weight), (again, fatigue_weight)], feature)
    flagged = thresholds.apply_residual(field, combined, feature, value)
    return {
        "thresholds": learned, "validation": validation, "combined": combined, "flagged": flagged,
        "summary": thresholds.apply_summary(thresholds.row_flags(flagged)),
    }


def make_detector(name: str, columns: Sequence[str], key: Sequence[str]) -> outliers.Detector:
    builders = {
        "mahalanobis": lambda: outliers.Mahalanobis(columns),
        "isolation_forest": lambda: outliers.IsolationForest(columns, key),
        "one_class": lambda: outliers.OneClassBoundary(columns),
        "lof": lambda: outliers.LocalOutlierFactor(columns),
        "elliptic": lambda: outliers.RobustEnvelope(columns),
    }
    return builders[name]()


MODELS = ("mahalanobis", "isolation_forest", "one_class", "lof", "elliptic")


def sweep(
    train: DataFrame, anomalous: DataFrame, normal: DataFrame, columns: Sequence[str], key: Sequence[str],
    models: Sequence[str] = MODELS, adapters: Sequence[str] = tuple(scale.ADAPTERS),
) -> DataFrame:
    """Every detector under every adapter, one row of confusion counts and rates each.

    A configuration that fails keeps its error instead of stopping the sweep.
    """
    spark, results = train.sparkSession, None
    kept = [*key, *columns]
    for adapter_name in adapters:
        for model_name in models:
            tag = [F.lit(model_name).alias("model"), F.lit(adapter_name).alias("adapter")]
            try:
                adapter = scale.ADAPTERS[adapter_name](columns).fit(train.select(*kept))
                fitted, bad, good = (adapter.transform(d.select(*kept)) for d in (train, anomalous, normal))
                model = make_detector(model_name, columns, key).fit(fitted)
                flagged = model.predict(bad.withColumn("truth", F.lit(True)).unionByName(good.withColumn("truth", F.lit(False))))
                row = detect.evaluate_binary(flagged, "anomaly", "truth").select(*tag, "*", F.lit(None).cast("string").alias("error"))
                row = settle(row)  # here, so that a failure while scoring is this configuration's too
            except Exception as error:  # noqa: BLE001 - one failing configuration must not stop the others
                message = f"{type(error).__name__}: {str(error)[:200]}"
                counts = [F.lit(None).cast("bigint").alias(c) for c in ("tp", "fn", "tn", "fp")]
                rates = [F.lit(None).cast("double").alias(c) for c in ("recall", "precision", "specificity", "fpr", "f1", "balanced_accuracy")]
                row = spark.range(1).select(*tag, *counts, *rates, F.lit(message).alias("error"))
            results = row if results is None else results.unionByName(row)
    return results


def top_configurations(results: DataFrame, n: int = 5) -> DataFrame:
    return results.where("error IS NULL").orderBy(F.desc("f1"), "model", "adapter").limit(n)


def score_matrix(results: DataFrame, metric: str, adapters: Sequence[str]) -> DataFrame:
    """One metric as model × adapter."""
    return results.groupBy("model").pivot("adapter", list(adapters)).agg(F.max(metric))
