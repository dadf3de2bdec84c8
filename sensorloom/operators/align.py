"""Time alignment, gap filling and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.kernels import IDX, attach, attach_stats, carry_fill, framed, medians, names, order_index

SPINE_BLOCK = 100_000


def seconds(t: str | Column) -> Column:
    """A timestamp (with or without zone) as seconds since the epoch."""
    t = F.col(t) if isinstance(t, str) else t
    return F.unix_micros(t.cast("timestamp")) / F.lit(1e6)


def sparsest_series(df: DataFrame, series: str) -> str:
    """The series with the fewest samples; the first name wins a tie."""
    return df.groupBy(series).count().orderBy("count", series).first()[0]


def align_linear(df: DataFrame, series: str, t: str, value: str, clock: str | None = None) -> DataFrame:
    """All series at the clock's times, linearly interpolated, one column each.

    ``t`` is numeric.  Both ends are extrapolated from the two nearest samples.
    The clock is the series with the fewest samples unless named.
    """
    members = sorted(r[0] for r in df.select(series).distinct().collect())
    clock = clock or sparsest_series(df, series)
    samples = framed(
        order_index(df.select(series, t, value), series, t),
        series,
        lambda w: {
            "_before": F.lag(F.struct(t, value)).over(w),
            "_after": F.lead(F.struct(t, value)).over(w),
        },
        1, 1,
    ).select(
        series, F.col(t).alias("_t"), F.lit(0).alias("_kind"),
        F.struct(F.col(t).alias("t"), F.col(value).alias("v"), "_before", "_after").alias("_s"),
    )
    empty = F.lit(None).cast(samples.schema["_s"].dataType)
    ticks = df.where(F.col(series) == clock).select(
        F.explode(F.array(*[F.lit(m) for m in members])).alias(series),
        F.col(t).alias("_t"), F.lit(1).alias("_kind"), empty.alias("_s"),
    )
    merged = order_index(samples.unionByName(ticks), series, ["_t", "_kind"])
    merged = carry_fill(merged, series, {"_a": "_s"})
    merged = carry_fill(merged, series, {"_b": "_s"}, backward=True)
    ticks = merged.where("_kind = 1")
    left_t = F.when(F.col("_a").isNull(), F.col("_b.t")).when(F.col("_b").isNull(), F.col(f"_a._before.{t}")).otherwise(F.col("_a.t"))
    left_v = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col(f"_a._before.{value}")).otherwise(F.col("_a.v"))
    right_t = F.when(F.col("_a").isNull(), F.col(f"_b._after.{t}")).when(F.col("_b").isNull(), F.col("_a.t")).otherwise(F.col("_b.t"))
    right_v = F.when(F.col("_a").isNull(), F.col(f"_b._after.{value}")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(F.col("_b.v"))
    line = left_v + (F.col("_t") - left_t) * (right_v - left_v) / (right_t - left_t)
    exact = F.when(F.col("_a.t") == F.col("_t"), F.col("_a.v")).otherwise(line)
    return (
        ticks.select(series, F.col("_t").alias(t), exact.alias("_v"))
        .groupBy(t).pivot(series, members).agg(F.max("_v"))
    )


def fill(df: DataFrame, series: str | Sequence[str] | None, columns: Sequence[str], method: str = "ffill_bfill") -> DataFrame:
    """Fill gaps in indexed rows: ``ffill``, ``bfill``, ``ffill_bfill``, ``drop`` or ``mean``."""
    columns = list(columns)
    if method == "drop":
        return df.na.drop(subset=columns)
    if method == "mean":
        series = names(series)
        means = df.groupBy(*series).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
        rows = attach_stats(df, means, series)
        return rows.select(
            *[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns]
        )
    same = {c: c for c in columns}
    if method in ("ffill", "ffill_bfill"):
        df = carry_fill(df, series, same)
    if method in ("bfill", "ffill_bfill"):
        df = carry_fill(df, series, same, backward=True)
    return df


def decimate(df: DataFrame, every: int, idx: str = IDX) -> DataFrame:
    return df.where(F.col(idx) % every == 0)


def bins_between(bounds: DataFrame, series: Sequence[str], low: str, high: str, out: str) -> DataFrame:
    """Every integer from ``low`` to ``high`` per series, made block by block on many tasks."""
    blocks = bounds.select(
        *series, low, high,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(high) - F.col(low)) / SPINE_BLOCK))).alias("_block"),
    )
    blocks = blocks.repartition(*series, "_block") if series else blocks.repartition("_block")
    first = F.col(low) + F.col("_block") * SPINE_BLOCK
    return blocks.select(
        *series, F.explode(F.sequence(first, F.least(first + SPINE_BLOCK - 1, F.col(high)))).alias(out)
    )


def resample_calendar(
    df: DataFrame, series: str | Sequence[str] | None, t: str, columns: Sequence[str], every_seconds: int, fill_gaps: bool = True
) -> DataFrame:
    """Means on fixed calendar bins; empty bins are kept and, by default, filled."""
    series, columns = names(series), list(columns)
    width = F.lit(every_seconds)
    binned = df.withColumn("_bin", F.floor(seconds(t) / width).cast("bigint"))
    means = binned.groupBy(*series, "_bin").agg(*[F.avg(c).alias(c) for c in columns])
    bounds = binned.groupBy(*series).agg(F.min("_bin").alias("_low"), F.max("_bin").alias("_high"))
    spine = bins_between(bounds, series, "_low", "_high", "_bin")
    rows = attach(spine, means, [*series, "_bin"], "left")
    if fill_gaps:
        rows = fill(order_index(rows, series, "_bin"), series, columns).drop(IDX)
    stamp = F.timestamp_seconds(F.col("_bin") * width).cast("timestamp_ntz")
    return rows.select(*series, stamp.alias(t), *columns)


def resample_origin(df: DataFrame, series: str | Sequence[str] | None, t: str, columns: Sequence[str], every_seconds: float) -> DataFrame:
    """Means on bins counted from each series' first sample; empty bins do not appear."""
    series = names(series)
    origin = df.groupBy(*series).agg(F.min(seconds(t)).alias("_t0"))
    rows = attach_stats(df, origin, series)
    slot = F.floor((seconds(t) - F.col("_t0")) / F.lit(every_seconds)).cast("bigint")
    return rows.groupBy(*series, slot.alias("bin")).agg(*[F.avg(c).alias(c) for c in columns])


def median_gap(df: DataFrame, series: str | Sequence[str] | None, t: str, tie: Sequence[str] = ()) -> DataFrame:
    """Median sampling gap in seconds per series."""
    series = names(series)
    rows = order_index(df.select(*series, t, *tie), series, [t, *tie])
    gaps = framed(rows, series, lambda w: {"_gap": seconds(t) - seconds(F.lag(t).over(w))}, 1)
    return medians(gaps, series, "_gap", "median_gap")


def resample_if_needed(
    df: DataFrame, t: str, columns: Sequence[str], expected_seconds: float, tolerance: float = 0.1, tie: Sequence[str] = ()
) -> DataFrame:
    """Resample a table only when its median gap is off the expected one."""
    gap = median_gap(df, None, t, tie).first()[0]
    if gap is not None and abs(gap - expected_seconds) > tolerance:
        return resample_origin(df, None, t, columns, expected_seconds).drop("bin")
    return df.select(*columns)


def time_parts(df: DataFrame, t: str) -> DataFrame:
    """Hour of day and day of week (Monday = 0)."""
    return df.withColumn("hour", F.hour(t)).withColumn("day_of_week", F.weekday(t))
