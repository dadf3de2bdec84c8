"""Structured Streaming twins of the windowed operators.

Operators that go on from row to row run as steps over micro-batches: a step takes the batch and a small state table and uses the same chunked
scans as the batch operators, so a key that holds a third of a batch is spread over many tasks and never gathered.  State and output are written per batch number,
so a batch that is run again after a failure overwrites what it wrote and reads the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorloom.kernels import IDX, attach, order_index, reflected_walk
from sensorloom.operators.split import safe_divide
from sensorloom.session import settle

KEPT_STATES = 3


@dataclass
class Stepped:
    """A stream and what to do with each of its batches: ``step(rows, state)`` gives the output and the next state."""

    stream: DataFrame
    step: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]
    state_schema: T.StructType

    def start(self, path: str, **trigger) -> StreamingQuery:
        """Run into ``path``: Parquet output per batch below ``rows``, states below ``state``, of which the last few are kept."""

        def one(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            before = f"{path}/state/{number - 1}"
            state = spark.read.schema(self.state_schema).parquet(before) if number else spark.createDataFrame([], self.state_schema)
            out, after = self.step(batch, state)
            out.write.mode("overwrite").parquet(f"{path}/rows/{number}")
            after.select(*self.state_schema.names).write.mode("overwrite").parquet(f"{path}/state/{number}")
            if number >= KEPT_STATES:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/state/{number - KEPT_STATES}")
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

        return self.stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger).start()


def count_windows(stream: DataFrame, key: str, order: Sequence[str], value: str, n: int = 30, fire: str = "at_once") -> Stepped:
    """Windows of ``n`` rows per key, emptied when they fire: ``(key, window_id, values)``.

    ``at_once`` fires on the n-th row.  ``per_batch`` fires at most once per
    micro-batch; rows arriving while a full window waits push the oldest out.  Rows of a batch are taken in ``order``.
    The state holds fewer than ``n`` rows per key, and how often it fired.
    """
    order = list(order)
    fields = [stream.schema[key], *[stream.schema[c] for c in order], T.StructField(value, T.DoubleType())]
    state = T.StructType([*fields, T.StructField("fired", T.LongType()), T.StructField("place", T.LongType())])  # a key that holds no rows has one without a place

    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        fired = before.groupBy(key).agg(F.max("fired").alias("_fired"))
        held = before.where("place IS NOT NULL").select(key, *order, value, "place")
        fresh = rows.select(key, *order, F.col(value).cast("double").alias(value), F.lit(2**62).alias("place"))
        every = settle(order_index(held.unionByName(fresh), key, ["place", *order]))
        total = every.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        total = settle(attach(total.unionByName(fired.select(key, F.lit(0).cast("bigint").alias("_n"))).groupBy(key).agg(F.max("_n").alias("_n")), fired, key, "left").na.fill(0, ["_fired"]))
        placed = attach(every, total, key)
        if fire == "at_once":
            window = F.floor(F.col(IDX) / n).cast("bigint")
            full, made = window < F.floor(F.col("_n") / n), F.floor(F.col("_n") / n)
            rest = ~full
        else:
            window, made = F.lit(0).cast("bigint"), (F.col("_n") >= n).cast("bigint")
            full, rest = (F.col("_n") >= n) & (F.col(IDX) >= F.col("_n") - n), F.col("_n") < n
        out = placed.where(full).groupBy(key, (F.col("_fired") + window).alias("window_id")).agg(F.array_sort(F.collect_list(F.struct(IDX, F.col(value).alias("v")))).alias("_v"))
        counted = total.select(key, (F.col("_fired") + made).cast("bigint").alias("fired"))
        kept = attach(placed.where(rest).select(key, *order, value, F.col(IDX).alias("place")), counted, key)
        empty = attach(counted, kept.select(key, F.lit(True).alias("_some")).distinct(), key, "left").where("_some IS NULL").drop("_some")
        none = {c: F.lit(None).cast(stream.schema[c].dataType) for c in order} | {value: F.lit(None).cast("double"), "place": F.lit(None).cast("bigint")}
        return out.select(key, "window_id", F.transform("_v", lambda x: x["v"]).alias("values")), kept.unionByName(empty.withColumns(none))

    return Stepped(stream, step, state)


def standardise_stream(stream: DataFrame, params: DataFrame, key: str, value: str, out: str = "z") -> DataFrame:
    """Stream–static join with stored ``(key, centre, scale)``; scale 0 gives 0."""
    named = params.select(key, F.col("centre").alias("_c"), F.col("scale").alias("_s"))
    joined = stream.join(named, key)
    return joined.withColumn(out, F.when(F.col("_s") == 0, 0.0).otherwise((F.col(value) - F.col("_c")) / F.col("_s"))).drop("_c", "_s")


def gap_sessions(stream: DataFrame, key: str, ts: str, gap: str, watermark: str, min_rows: int = 5, max_rows: int = 256) -> DataFrame:
    """Runs of rows closed by a silence longer than ``gap``; too short or overflowing runs are dropped.

    A run is emitted once the watermark has passed its end; rows later than the
    watermark are dropped.
    """
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    sessions = stream.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    kept = sessions.where((F.col("n") >= min_rows) & (F.col("n") <= max_rows))
    return kept.select(key, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), "n")


def row_defect(address: Column, function: Column, values: Column, want_address: int, want_function: int, arity: int = 16) -> Column:
    """Why a decoded row is not usable, or null."""
    return (
        F.when(address.isNull() | (address != want_address), "address")
        .when(function.isNull() | (function != want_function), "function")
        .when(values.isNull() | (F.size(values) != arity), "arity")
    )


def valid_rows(df: DataFrame, defect: Column) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the others with their ``defect``; works on batches and streams."""
    marked = df.withColumn("defect", defect)
    return marked.where(F.col("defect").isNull()).drop("defect"), marked.where(F.col("defect").isNotNull())


def defect_rate(df: DataFrame, defect: Column, by: Sequence[str] = ()) -> DataFrame:
    bad = F.count_if(defect.isNotNull())
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(n.alias("rows"), bad.alias("bad_rows"), safe_divide(bad, n).alias("bad_rate"))


def cusum_stream(stream: DataFrame, key: str, order: Sequence[str], value: str, thresholds: DataFrame) -> Stepped:
    """Running two-sided CUSUM per key against stored ``(key, mu0, h, k)`` and sigma limits.

    The state is the two sums; the first row of a key only starts them, as in
    the batch operator.  Null values leave the sums as they are, less the slack.
    """
    order = list(order)
    limits = settle(thresholds.select(key, "mu0", "h", "k", "danger_lower", "danger_upper"))
    state = T.StructType([stream.schema[key], T.StructField("pos", T.DoubleType()), T.StructField("neg", T.DoubleType())])

    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        # row 0 of a key stands for what was before: a step up to the sums so far, or none, in which case its first row makes no step
        numbered = order_index(rows.join(limits.select(key), key, "left_semi").select(key, *order, value), key, order).withColumn(IDX, F.col(IDX) + 1)
        starts = attach(numbered.select(key).distinct(), before, key, "left").select(key, F.lit(0).cast("bigint").alias(IDX), "pos", "neg")
        starts = settle(starts)
        known = starts.select(key, F.col("pos").isNotNull().alias("_known"))
        walked = attach(attach(numbered.unionByName(starts.drop("pos", "neg"), allowMissingColumns=True), known, key), limits, key)
        walked = attach(walked, starts.select(key, F.col("pos").alias("_pos"), F.col("neg").alias("_neg")), key)
        off = F.coalesce(F.col(value) - F.col("mu0"), F.lit(0.0))

        def moves(first: str, up: Column) -> Column:
            return F.when(F.col(IDX) == 0, F.coalesce(first, F.lit(0.0))).when((F.col(IDX) == 1) & ~F.col("_known"), F.lit(0.0)).otherwise(up)

        steps = {"cusum_pos": moves("_pos", off - F.col("k")), "cusum_neg": moves("_neg", -off - F.col("k"))}
        done = settle(reflected_walk(walked, key, steps))
        last = done.groupBy(key).agg(F.max_by(F.struct(F.col("cusum_pos").alias("pos"), F.col("cusum_neg").alias("neg")), IDX).alias("_s")).select(key, "_s.*")
        same = attach(before, last.select(key, F.lit(True).alias("_new")), key, "left").where("_new IS NULL").drop("_new")
        alarm = (F.col("cusum_pos") > F.col("h")) | (F.col("cusum_neg") > F.col("h"))
        danger = F.coalesce((F.col(value) < F.col("danger_lower")) | (F.col(value) > F.col("danger_upper")), F.lit(False))
        out = done.where(F.col(IDX) > 0).select(key, *order, "cusum_pos", "cusum_neg", alarm.alias("cusum_alarm"), danger.alias("sigma_danger"))
        return out, last.unionByName(same)

    return Stepped(stream, step, state)


def marked_late(stream: DataFrame, ts: str, gap: str, watermark: str) -> Stepped:
    """The rows of a stream with ``late``: true where the run that the row alone would open ends before the watermark.

    :func:`gap_sessions` with the same arguments drops no other rows; it keeps a late one only where a row of the same batch continues its run.  Every row comes out
    once, so rows in are rows kept and rows late.

    The watermark of a batch is the latest time of all batches before it (in whole milliseconds), less ``watermark``; it is all the state there is.
    """
    state = T.StructType([T.StructField("latest", T.LongType())])
    millis = lambda c: F.unix_millis(c.cast("timestamp"))
    width = lambda text: F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00' + interval {text}) - unix_millis(timestamp'1970-01-01 00:00:00')")

    def step(rows: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        held = before.first()
        bar = F.lit(held["latest"] if held else None).cast("bigint") - width(watermark)
        late = F.coalesce(millis(F.col(ts)) + width(gap) <= bar, F.lit(False))
        seen = rows.agg(F.max(millis(F.col(ts))).alias("latest")).unionByName(before).agg(F.max("latest").alias("latest"))
        return rows.withColumn("late", late), seen

    return Stepped(stream, step, state)


def drain(stream: DataFrame | Stepped, path: str) -> DataFrame:
    """Run a streaming query over everything available into Parquet files and read them back."""
    if isinstance(stream, Stepped):
        stream.start(path, availableNow=True).awaitTermination()
        return stream.stream.sparkSession.read.option("recursiveFileLookup", True).parquet(f"{path}/rows")
    spark: SparkSession = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
