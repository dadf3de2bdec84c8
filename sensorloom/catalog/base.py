"""Registry of named queries and the views of the test tables they start from."""

from __future__ import annotations

import os
import textwrap
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.kernels import order_index

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
FEATURES = ("quantity", "price", "discount", "tax")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with the SQL that states the same result."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = textwrap.dedent(sql).strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as five sensor series."""
    return table(spark, sf, "events").select("event_type", "ts", "event_id", "value")


def indexed_events(spark: SparkSession, sf: str) -> DataFrame:
    return order_index(events(spark, sf), "event_type", ["ts", "event_id"])


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means, one column per event type, with gaps; ``hour`` counts from the epoch."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("bigint")
    return (
        events(spark, sf).groupBy(hour.alias("hour")).pivot("event_type", list(EVENT_TYPES)).agg(F.avg("value"))
    )


def indexed_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return order_index(hourly(spark, sf), None, "hour")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals per day, indexed: one seasonal series."""
    orders = table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100
    return order_index(orders.groupBy(F.col("o_orderdate").alias("day")).agg(cents.alias("total")), None, "day")


LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as cross-domain features: N = lab, R = fatigue, A = field."""
    return table(spark, sf, "lineitem").select(
        *LINE_KEY,
        F.col("l_returnflag").alias("domain"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def indexed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return order_index(lines(spark, sf), "domain", list(LINE_KEY))


def rounded(df: DataFrame, digits: int = 6, columns: Sequence[str] | None = None) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0) so that results compare by value."""
    doubles = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    wanted = doubles if columns is None else set(columns)
    return df.select(
        *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if c in wanted else F.col(c) for c in df.columns]
    )


# SQL fragments shared by the stated results.
EV = """ev AS (SELECT event_type, ts, event_id, value,
       row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx FROM events)"""
HOUR_COLUMNS = ", ".join(f"avg(value) FILTER (WHERE event_type = '{e}') AS {e}" for e in EVENT_TYPES)
HR = f"""hr AS (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS idx, {', '.join(EVENT_TYPES)} FROM (
       SELECT CAST(floor(epoch_us(ts) / 3600000000.0) AS BIGINT) AS hour, {HOUR_COLUMNS} FROM events GROUP BY 1))"""
DAY = """dy AS (SELECT day, total, row_number() OVER (ORDER BY day) - 1 AS idx FROM (
       SELECT o_orderdate AS day, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT / 100.0 AS total FROM orders GROUP BY 1))"""
LI = """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS domain, l_quantity AS quantity,
       l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS idx
       FROM lineitem)"""
