"""Chronological splits, scenarios and deterministic samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.kernels import IDX, attach_stats, names


def with_total(df: DataFrame, series: str | Sequence[str] | None, out: str = "n_rows") -> DataFrame:
    series = names(series)
    return attach_stats(df, df.groupBy(*series).agg(F.count(F.lit(1)).alias(out)), series)


def _cut(total: Column, ratio: float) -> Column:
    return F.floor(total * F.lit(float(ratio)))


def split_chronological(
    df: DataFrame, series: str | Sequence[str] | None, ratios: Sequence[float] = (0.7, 0.1, 0.2), idx: str = IDX
) -> DataFrame:
    """Label indexed rows ``train`` / ``val`` / ``test``; ratios may also be percentages."""
    ratios = [r / 100 for r in ratios] if sum(ratios) > 1.5 else list(ratios)
    if abs(sum(ratios) - 1) > 0.01:
        raise ValueError("split ratios must sum to 1")
    rows = with_total(df, series, "_n")
    train, val = _cut(F.col("_n"), ratios[0]), _cut(F.col("_n"), ratios[1])
    label = F.when(F.col(idx) < train, "train").when(F.col(idx) < train + val, "val").otherwise("test")
    return rows.withColumn("split", label).drop("_n")


def split_shuffled(df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Random train/test label that depends only on the key and the seed."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *names(key)), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(draw < test_size, "test").otherwise("train"))


def scenario(df: DataFrame, domain: str, name: str, lab: str, fatigue: str, field: str, idx: str = IDX) -> DataFrame:
    """Train/val/test rows of scenario A, B or C from rows indexed per domain.

    A: the field data split 70/10/20.  B: train on lab, validate on as many
    fatigue rows as lab has, test on field.  C: lab 80/20, test on field.
    """
    d = F.col(domain)
    if name == "A":
        return split_chronological(df.where(d == field), domain, (0.7, 0.1, 0.2), idx)
    n_lab = df.where(d == lab).agg(F.count(F.lit(1))).first()[0]
    if name == "B":
        picked = df.where((d == lab) | (d == field) | ((d == fatigue) & (F.col(idx) < n_lab)))
        label = F.when(d == lab, "train").when(d == fatigue, "val").otherwise("test")
    elif name == "C":
        picked = df.where((d == lab) | (d == field))
        label = F.when(d == field, "test").when(F.col(idx) < math.floor(n_lab * 0.8), "train").otherwise("val")
    else:
        raise ValueError(f"unknown scenario {name!r}")
    return picked.withColumn("split", label)


def evaluation_positions(
    df: DataFrame, series: str | Sequence[str] | None, k: int = 100, mode: str = "linspace", idx: str = IDX
) -> DataFrame:
    """Evenly spaced rows to evaluate: ``linspace`` (k of them) or every ``max(1, n // k)``-th."""
    rows = with_total(df, series, "_n")
    n = F.col("_n")
    if mode == "step":
        step = F.greatest(F.lit(1), F.floor(n / k))
        return rows.where((F.col(idx) % step == 0) & (F.col(idx) / step < k)).drop("_n")
    count = F.least(F.lit(k), n)
    step = (n - 1) / (count - 1)
    guess = F.floor(F.col(idx) / step)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = guess + shift
        hit = hit | ((i >= 0) & (i < count) & (F.floor(i * step) == F.col(idx)))
    return rows.where(F.when(count == 1, F.col(idx) == 0).otherwise(hit)).drop("_n")


def hash_order(key: str | Sequence[str], seed: int = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in names(key)]))


def hash_sample(df: DataFrame, key: str | Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones for the same keys and seed.

    A 65 536-bucket histogram of the hash first finds where the n-th row lies, so
    only about ``n`` rows are ever sorted.
    """
    rows = df.withColumn("_h", hash_order(key, seed))
    buckets = rows.groupBy(F.substring("_h", 1, 4).alias("_b")).count().collect()
    taken, last = 0, "ffff"
    for bucket, count in sorted((r[0], r[1]) for r in buckets):
        taken += count
        if taken >= n:
            last = bucket
            break
    rows = rows.where(F.substring("_h", 1, 4) <= last)
    return rows.orderBy("_h").limit(n).drop("_h")


def index_slice(df: DataFrame, start: int = 0, stop: int | None = None, idx: str = IDX) -> DataFrame:
    """Rows ``start <= idx < stop`` (head, or skip a warm-up)."""
    kept = df.where(F.col(idx) >= start)
    return kept if stop is None else kept.where(F.col(idx) < stop)


def tail_fraction(df: DataFrame, series: str | Sequence[str] | None, fraction: float = 0.3, idx: str = IDX) -> DataFrame:
    rows = with_total(df, series, "_n")
    return rows.where(F.col(idx) >= F.col("_n") - _cut(F.col("_n"), fraction)).drop("_n")


def training_mix(
    lab: DataFrame, field: DataFrame, key: str | Sequence[str], strategy: str = "lab_only",
    n_train: int = 50_000, n_test: int = 50_000, seed: int = 42,
) -> DataFrame:
    """Rows labelled ``train`` / ``field_test`` for one of the training strategies."""
    train = hash_sample(lab, key, n_train, seed)
    if strategy == "lab_only":
        test = hash_sample(field, key, n_test, seed)
        return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("field_test")))
    n_field = field.count()
    if strategy == "lab_and_campo":
        take = min(n_train // 2, n_field // 2)
    elif strategy == "campo_only":
        take = min(n_train, n_field // 2)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    rest = min(n_test, n_field - take)
    from sensorloom.kernels import order_index

    drawn = hash_sample(field, key, take + rest, seed).withColumn("_h", hash_order(key, seed))
    drawn = order_index(drawn, None, ["_h", *names(key)], "_i").withColumn(
        "part", F.when(F.col("_i") < take, "train").otherwise("field_test")
    ).drop("_h", "_i")
    if strategy == "campo_only":
        return drawn
    return train.withColumn("part", F.lit("train")).unionByName(drawn)


def safe_divide(a: Column, b: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(fallback))


def min_max(df: DataFrame, series: str | Sequence[str] | None, value: str, out: str) -> DataFrame:
    """Value scaled to 0…1 by the series' own range; a constant series gives 0."""
    series = names(series)
    span = df.groupBy(*series).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = attach_stats(df, span, series)
    return rows.withColumn(
        out, safe_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    ).drop("_lo", "_hi")


def blocks_of(df: DataFrame, size: int, idx: str = IDX) -> DataFrame:
    """Number of the ``size``-row block each indexed row falls into."""
    return df.withColumn("block", F.floor(F.col(idx) / size).cast("bigint"))
