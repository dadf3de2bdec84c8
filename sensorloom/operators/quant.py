"""Calibration samples, INT8 quantisation and device-output checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.kernels import IDX, attach, carry_fill, names, prefix_sums, quantiles
from sensorloom.operators.split import hash_sample, with_total
from sensorloom.session import settle

INT8_MIN, INT8_MAX = -128, 127


def window_scores(windows: DataFrame, keys: str | Sequence[str], value: str = "value") -> DataFrame:
    """Largest absolute value in each window."""
    return windows.groupBy(*names(keys)).agg(F.max(F.abs(F.col(value))).alias("score"))


def balanced_sample(scores: DataFrame, key: str, max_total: int, balance: float, seed: int = 42, q: float = 0.95) -> DataFrame:
    """Calibration windows: the top of the score tail plus hash-picked normal ones, at most ``max_total``.

    When there are too few normal windows, the next tail windows fill the gap.
    """
    cut = quantiles(scores, None, "score", [q]).first()
    if cut is None or cut["q"] is None:
        raise ValueError("no window to sample from")
    edge = cut["q"][0]
    n_tail = round(max_total * balance)
    n_normal = max_total - n_tail
    pool = scores.where(F.col("score") < edge)
    missing = max(0, n_normal - pool.limit(n_normal).count())
    tail = scores.where(F.col("score") >= edge).orderBy(F.desc("score"), F.desc(key)).limit(n_tail + missing)
    picked = tail.withColumn("part", F.lit("tail")).unionByName(
        hash_sample(pool, key, n_normal, seed).withColumn("part", F.lit("normal")))
    return picked.orderBy(key).limit(max_total)


def sweep_samples(scores: DataFrame, key: str, totals: Sequence[int], balances: Sequence[float], seed: int = 42) -> DataFrame:
    """One row per (max_total, balance): what the sample holds, or why it failed."""
    out = None
    for total in totals:
        for balance in balances:
            tag = [F.lit(total).alias("max_total"), F.lit(float(balance)).alias("balance")]
            try:
                row = balanced_sample(scores, key, total, balance, seed).agg(
                    F.count(F.lit(1)).alias("selected"), F.count_if(F.col("part") == "tail").alias("tail"), F.avg("score").alias("mean_score"))
                row = settle(row.select(*tag, "*", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("note")))  # computed here, where it may fail
            except Exception as error:  # noqa: BLE001 - a failing configuration is a result row
                row = scores.sparkSession.range(1).select(
                    *tag, F.lit(0).cast("bigint").alias("selected"), F.lit(0).cast("bigint").alias("tail"), F.lit(None).cast("double").alias("mean_score"),
                    F.lit("failed").alias("status"), F.lit(str(error)[:200]).alias("note"))
            out = row if out is None else out.unionByName(row)
    return out


def quantise(x: Column, scale: float, zero_point: int) -> Column:
    """Affine INT8: round half to even, clip, cast."""
    q = F.rint(x / F.lit(float(scale)) + F.lit(float(zero_point)))
    return F.greatest(F.lit(float(INT8_MIN)), F.least(F.lit(float(INT8_MAX)), q)).cast("tinyint")


def dequantise(q: Column, scale: float, zero_point: int) -> Column:
    return (q.cast("double") - F.lit(float(zero_point))) * F.lit(float(scale))


def compare_outputs(a: DataFrame, b: DataFrame, key: str | Sequence[str], value: str, tolerance: float = 1e-3, by: Sequence[str] = ()) -> DataFrame:
    """Error measures of two output tables on their shared indices, with the verdict band.

    ``max_diff_index`` is the first index of the largest difference.
    """
    keys = names(key)
    both = attach(a.select(*by, *keys, F.col(value).alias("_a")), b.select(*by, *keys, F.col(value).alias("_b")), [*by, *keys])
    both = both.withColumn("_d", F.abs(F.col("_a") - F.col("_b")))
    place = F.struct(*[F.col(k).alias(k) for k in keys])
    at = F.struct((-F.col("_d")).alias("_d"), place.alias("_k"))
    out = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.avg("_d").alias("mae"), F.avg(F.col("_d") * F.col("_d")).alias("mse"), F.max("_d").alias("max_diff"),
        F.min_by(F.struct(place.alias("k"), "_a", "_b"), at).alias("_w"), F.count_if(F.col("_d") <= tolerance).alias("within_tolerance"))
    verdict = F.when(F.col("max_diff") < 1e-4, "excellent").when(F.col("max_diff") < 1e-3, "good").when(F.col("max_diff") < 1e-2, "acceptable").otherwise("problem")
    return out.select(
        *by, "count", "mae", "mse", F.sqrt("mse").alias("rmse"), "max_diff", *[F.col(f"_w.k.{k}").alias(f"max_diff_{k}") for k in keys],
        F.col("_w._a").alias("max_diff_a"), F.col("_w._b").alias("max_diff_b"), "within_tolerance",
        (F.col("within_tolerance") / F.col("count") * 100).alias("percent_within_tolerance"), verdict.alias("verdict"))


def spaced_sample(df: DataFrame, series, n: int, idx: str = IDX) -> DataFrame:
    """Every ``max(1, len // n)``-th indexed row, at most ``n`` of them."""
    rows = with_total(df, series, "_n")
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    spaced = (F.col(idx) % stride == 0) & (F.col(idx) / stride < n)
    return rows.where((F.col("_n") <= n) | spaced).drop("_n")


# Fixed patterns of the device log.
FRAME_PATTERN = r"\[MODBUS\].*#(\d+)"
START_PATTERN = r"\[AI\].*INFERENZA|Inference done|Output"
VALUE_PATTERN = r"[-+]?\d*\.\d+|[-+]?\d+"
END_PATTERN = r"^(\[MODBUS\]|\[DBG\])"


def parse_device_log(lines: DataFrame, log: str | Sequence[str] | None, text: str = "text", idx: str = IDX) -> DataFrame:
    """Inference outputs in a captured log: ``(log…, inference, frame_count, idx, position, value)``.

    A start marker opens an inference; every number up to (and on) the first
    frame or debug line after some number belongs to it.  ``frame_count`` is the
    last frame number seen at the marker.  Lines are indexed per log.
    """
    by = names(log)
    rows = lines.select(*by, idx, F.trim(text).alias("_t")).where(F.col("_t") != "")
    starts = F.col("_t").rlike(START_PATTERN)
    frame = F.regexp_extract("_t", FRAME_PATTERN, 1)
    rows = rows.select(
        "*", starts.cast("int").alias("_start"), F.when(frame != "", frame.cast("bigint")).alias("_frame"),
        F.regexp_extract_all("_t", F.lit(VALUE_PATTERN), 0).alias("_values"), F.col("_t").rlike(END_PATTERN).alias("_end"))
    rows = carry_fill(rows, by, {"_frame": "_frame"}, idx=idx)
    rows = prefix_sums(rows, by, {"inference": F.col("_start"), "_seen": F.size("_values")}, idx=idx)
    opening = F.when(F.col("_start") == 1, F.struct((F.col("_seen") - F.size("_values")).alias("seen"), F.coalesce("_frame", F.lit(0)).alias("frame")))
    rows = carry_fill(rows.withColumn("_open", opening), by, {"_open": "_open"}, idx=idx)
    closes = (F.col("inference") > 0) & F.col("_end") & (F.col("_seen") > F.col("_open.seen"))
    rows = prefix_sums(rows.withColumn("_close", closes.cast("int")), by, {"_closed": F.col("_close")}, idx=idx)
    at_start = F.when(F.col("_start") == 1, F.col("_closed") - F.col("_close"))
    rows = carry_fill(rows.withColumn("_base", at_start), by, {"_base": "_base"}, idx=idx)
    inside = (F.col("inference") > 0) & (F.col("_closed") - F.col("_close") == F.col("_base"))
    kept = rows.where(inside).select(
        *by, "inference", F.col("_open.frame").alias("frame_count"), idx, F.posexplode("_values").alias("position", "value"))
    return kept.withColumn("value", F.col("value").cast("double"))
