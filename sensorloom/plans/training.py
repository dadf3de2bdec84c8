"""From a raw table to labelled training sequences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.kernels import IDX, order_index
from sensorloom.operators import align, split, windows
from sensorloom.operators.scale import StandardScaler


def prepare(
    df: DataFrame, t: str, columns: Sequence[str], window: int, horizon: int, decimation: int = 1, test_size: float = 0.2
) -> DataFrame:
    """Fill, decimate, standardise, cut into sequences and label train/test by time.

    The scaler is fitted on the rows before the first test sequence alone.
    """
    columns = list(columns)
    rows = align.fill(order_index(df.select(t, *columns), None, t), None, columns)
    if decimation > 1:
        rows = align.decimate(rows, decimation).withColumn(IDX, (F.col(IDX) / decimation).cast("bigint"))
    total = (rows.agg(F.max(IDX)).first()[0] or 0) + 1
    cut = math.floor(max(0, total - window - horizon + 1) * (1 - test_size))
    rows = StandardScaler(columns).fit(rows.where(F.col(IDX) < max(1, cut))).transform(rows)
    made = windows.sequences(rows, None, columns, window, horizon)
    labelled = split.split_chronological(made, None, (1 - test_size, 0.0, test_size), "start")
    return labelled.withColumn("split", F.when(F.col("split") == "train", "train").otherwise("test"))
