"""Independent versus rolling forecasts under every adapter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.kernels import IDX, order_index
from sensorloom.operators import detect, forecast, scale


def _long(df: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    rows = order_index(df.select(*order, *columns), None, list(order))
    return rows.unpivot([IDX], list(columns), "feature", "value")


def compare_approaches(
    train: DataFrame, normal: DataFrame, anomalous: DataFrame, order: Sequence[str], columns: Sequence[str], window: int,
    models: Sequence[str] = tuple(forecast.FORECASTERS), adapters: Sequence[str] = ("none", "standard"), q: float = 0.95,
) -> DataFrame:
    """Confusion counts and rates per model × adapter × approach.

    The threshold is a quantile of the training errors.  Approach A predicts
    every window from real data, B feeds predictions back.
    """
    out = None
    for adapter_name in adapters:
        adapter = scale.ADAPTERS[adapter_name](columns).fit(train)
        long = {name: _long(adapter.transform(df), order, columns) for name, df in (("train", train), ("normal", normal), ("anomalous", anomalous))}
        for model_name in models:
            model = forecast.get_forecaster(model_name, "feature", window, window)
            cut = lambda df: forecast.forecast_windows(df, "feature", "value", window, window)
            windows = cut(long["train"])
            threshold = forecast.error_threshold(forecast.window_errors(model.fit(windows).predict(windows)))
            for approach in ("A", "B"):
                parts = []
                for name, truth in (("normal", False), ("anomalous", True)):
                    predicted = model.predict(cut(long[name])) if approach == "A" else forecast.rolling_forecast(long[name], model, "value")
                    parts.append(forecast.window_errors(predicted, threshold).select("anomaly", F.lit(truth).alias("truth")))
                row = detect.evaluate_binary(parts[0].unionByName(parts[1]), "anomaly", "truth").select(
                    F.lit(model_name).alias("model"), F.lit(adapter_name).alias("adapter"), F.lit(approach).alias("approach"), "*")
                out = row if out is None else out.unionByName(row)
    return out


def f1_table(results: DataFrame) -> DataFrame:
    """F1 as (model, adapter) × approach."""
    return results.groupBy("model", "adapter").pivot("approach", ["A", "B"]).agg(F.max("f1"))
