"""Nearest higher neighbour on ordered series of any length.

Chunks are solved alone with a monotonic stack; what a chunk cannot answer is
looked up in per-chunk maxima (grouped in levels of bounded fan-out) and then in
the target chunk's record values.  No group ever exceeds one chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.kernels import CHUNK_ROWS, IDX, attach, chunk_of
from sensorloom.session import settle, tuning

FAN = tuning("SEEK_FAN", 1000)


def _stack_scan(pos: np.ndarray, y: np.ndarray, strict: bool) -> tuple[list, list]:
    """Next element at least as high (or higher) per position, and the lowest value before it."""
    n = len(y)
    target, low = [-1] * n, [np.inf] * n
    stack: list[tuple[int, float, float]] = []
    values = y.tolist()
    for i in range(n - 1, -1, -1):
        v, least = values[i], np.inf
        while stack and (stack[-1][1] < v or (strict and stack[-1][1] == v)):
            least = min(least, stack.pop()[2])
        if stack:
            target[i] = stack[-1][0]
        low[i] = least
        stack.append((int(pos[i]), v, min(v, least)))
    return target, low


def _chunk_rows(series: list[str], forward: bool, strict: bool):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX, ascending=forward)
        pos, y = pdf[IDX].to_numpy(), pdf["_y"].to_numpy()
        target, low = _stack_scan(pos, y, strict)
        asked = pdf["_ask"].to_numpy()
        peak = np.maximum.accumulate(y)
        record = np.r_[True, y[1:] > peak[:-1]]
        below = np.r_[np.inf, np.minimum.accumulate(y)[:-1]]
        row = {s: pdf[s].iloc[0] for s in series}
        row |= {
            "_chunk": pdf["_chunk"].iloc[0], "hi": y.max(), "lo": y.min(),
            "q_idx": pos[asked].tolist(), "q_y": y[asked].tolist(),
            "q_target": np.array(target)[asked].tolist(), "q_low": np.array(low)[asked].tolist(),
            "r_idx": pos[record].tolist(), "r_y": y[record].tolist(), "r_low": below[record].tolist(),
        }
        return pd.DataFrame([row])

    return solve


def _seek(queries: DataFrame, maxima: DataFrame, series: list[str], strict: bool, level: int = 0) -> DataFrame:
    """First position after ``pos`` whose ``hi`` reaches ``y``; adds ``hit`` and lowers ``low``."""

    def reaches(hi, y):
        return hi > y if strict else hi >= y

    def first_hit(items, y):
        return F.array_position(F.transform(items, lambda x: reaches(x["hi"], y)), F.lit(True))

    def lowest(low, items):
        return F.least(low, F.coalesce(F.array_min(F.transform(items, lambda x: x["lo"])), F.lit(float("inf"))))

    groups = settle(
        maxima.withColumn("_sup", F.floor(F.col("pos") / FAN).cast("bigint"))
        .groupBy(*series, "_sup")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "hi", "lo"))).alias("_items"),
            F.max("hi").alias("hi"), F.min("lo").alias("lo"),
        )
    )
    several = groups.groupBy(*series).count().where("count > 1").limit(1).count() > 0
    found = queries.withColumn("_sup", F.floor(F.col("pos") / FAN).cast("bigint"))
    found = attach(found, groups.select(*series, "_sup", "_items"), [*series, "_sup"])
    found = found.withColumn("_later", F.filter("_items", lambda x: x["pos"] > F.col("pos")))
    found = found.withColumn("_k", first_hit(F.col("_later"), F.col("y")).cast("int"))
    passed = F.when(F.col("_k") > 0, F.slice("_later", F.lit(1), F.greatest(F.col("_k") - 1, F.lit(0)))).otherwise(F.col("_later"))
    found = found.withColumn("low", lowest(F.col("low"), passed)).withColumn(
        "hit", F.when(F.col("_k") > 0, F.try_element_at("_later", F.col("_k"))["pos"])
    ).drop("_items", "_later", "_k")
    if not several:
        return found.drop("_sup")
    found = settle(found)
    done = found.where("hit IS NOT NULL").drop("_sup")
    below = f"_pos{level}"
    rest = found.where("hit IS NULL").drop("hit").withColumnRenamed("pos", below).withColumnRenamed("_sup", "pos")
    upper = groups.select(*series, F.col("_sup").alias("pos"), "hi", "lo")
    rest = _seek(rest, upper, series, strict, level + 1).withColumnRenamed("hit", "_sup").drop("pos").withColumnRenamed(below, "pos")
    rest = attach(rest, groups.select(*series, "_sup", "_items"), [*series, "_sup"], "left")
    rest = rest.withColumn("_k", first_hit(F.col("_items"), F.col("y")).cast("int"))
    before = F.slice("_items", F.lit(1), F.greatest(F.col("_k") - 1, F.lit(0)))
    rest = rest.withColumn("low", F.when(F.col("_k") > 0, lowest(F.col("low"), before)).otherwise(F.col("low"))).withColumn(
        "hit", F.when(F.col("_k") > 0, F.try_element_at("_items", F.col("_k"))["pos"])
    ).drop("_items", "_k", "_sup")
    return done.unionByName(rest)


def nearest_higher(
    df: DataFrame, series: list[str], y: str, ask=None, forward: bool = True, strict: bool = False, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``(series…, idx, y, target, low)`` for every asked row.

    ``target`` is the nearest later (earlier, when not ``forward``) row at least
    as high — strictly higher with ``strict`` — or null; ``low`` is the lowest
    value in between, null when there is none.
    """
    rows = df.where(F.col(y).isNotNull()).select(
        *series, IDX, F.col(y).cast("double").alias("_y"), (F.lit(True) if ask is None else ask).alias("_ask"),
        chunk_of(IDX, chunk_rows).alias("_chunk"),
    )
    key_fields = [rows.schema[s] for s in series]
    longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *key_fields, T.StructField("_chunk", T.LongType()), T.StructField("hi", T.DoubleType()), T.StructField("lo", T.DoubleType()),
        T.StructField("q_idx", longs), T.StructField("q_y", doubles), T.StructField("q_target", longs), T.StructField("q_low", doubles),
        T.StructField("r_idx", longs), T.StructField("r_y", doubles), T.StructField("r_low", doubles),
    ])
    chunks = settle(rows.groupBy(*series, "_chunk").applyInPandas(_chunk_rows(series, forward, strict), schema))
    asked = chunks.select(*series, "_chunk", F.explode(F.arrays_zip("q_idx", "q_y", "q_target", "q_low")).alias("q")).select(
        *series, "_chunk", F.col("q.q_idx").alias(IDX), F.col("q.q_y").alias("y"), F.col("q.q_target").alias("target"), F.col("q.q_low").alias("low"),
    )
    done = asked.where("target >= 0").drop("_chunk")
    if chunks.groupBy(*series).count().where("count > 1").limit(1).count() == 0:
        loose = asked.where("target < 0").drop("_chunk").withColumn("target", F.lit(None).cast("bigint"))
    else:
        last = chunks.agg(F.max("_chunk")).first()[0]
        turned = lambda c: F.col(c) if forward else F.lit(last) - F.col(c)  # noqa: E731 - later always means a larger position
        queries = asked.where("target < 0").drop("target").withColumn("pos", turned("_chunk"))
        maxima = chunks.select(*series, turned("_chunk").alias("pos"), "hi", "lo")
        sought = settle(_seek(queries, maxima, series, strict))
        open_ended = sought.where("hit IS NULL").select(*series, IDX, "y", F.lit(None).cast("bigint").alias("target"), "low")
        pairs = (
            sought.where("hit IS NOT NULL").groupBy(*series, "_chunk", turned("hit").alias("_to"))
            .agg(F.collect_list(F.struct(F.col(IDX), F.col("y"), F.col("low"))).alias("_q"))
        )
        records = chunks.select(*series, F.col("_chunk").alias("_to"), "r_idx", "r_y", "r_low")
        pairs = attach(pairs, records, [*series, "_to"])
        side = "right" if strict else "left"

        @F.pandas_udf(T.ArrayType(T.LongType()))
        def locate(ys: pd.Series, record_y: pd.Series) -> pd.Series:
            return pd.Series([np.searchsorted(r, q, side=side) for q, r in zip(ys, record_y)])

        pairs = pairs.withColumn("_at", locate(F.transform("_q", lambda x: x["y"]), F.col("r_y")))
        placed = F.zip_with(
            "_q", "_at",
            lambda q, k: F.struct(
                q[IDX].alias(IDX), q["y"].alias("y"), F.get("r_idx", k).alias("target"), F.least(q["low"], F.get("r_low", k)).alias("low")
            ),
        )
        crossed = pairs.select(*series, F.explode(placed).alias("p")).select(*series, "p.*")
        loose = open_ended.unionByName(crossed)
    out = done.unionByName(loose)
    return out.withColumn("low", F.when(F.col("low") < float("inf"), F.col("low")))
