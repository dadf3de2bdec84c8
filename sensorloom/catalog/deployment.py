"""Quantisation, device checks and streaming operators (inventory I, J)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensorloom.catalog.base import EV, LI, events, indexed_events, lines, query, rounded, table
from sensorloom.kernels import IDX, order_index
from sensorloom.operators import graph, quant, split, windows
from sensorloom.session import folder, settle
from sensorloom.streaming import operators as streaming

# ------------------------------------------------------------------ I

WS = f"""{EV}, zn AS (SELECT event_type, idx, (value - avg(value) OVER p) / stddev_samp(value) OVER p AS z, count(*) OVER p AS n FROM ev WINDOW p AS (PARTITION BY event_type)),
nn AS (SELECT DISTINCT event_type, n FROM zn), st AS (SELECT event_type, unnest(range(0, n - 39, 10)) AS start FROM nn WHERE n >= 40),
ws AS (SELECT st.event_type, start // 10 AS window_id, max(abs(z)) AS score FROM st JOIN zn ON zn.event_type = st.event_type AND idx >= start AND idx < start + 30 GROUP BY 1, 2)"""


def window_scores(spark, sf):
    """30-row windows of the standardised events, each with 10 rows of forecast room."""
    rows = graph.normalised_view(indexed_events(spark, sf), "event_type", "value", "z")
    rows = split.with_total(rows.select("event_type", IDX, "z"), "event_type")
    long = windows.strided_windows(rows, "event_type", 40, 10).where("step < 30")
    return quant.window_scores(long, ["event_type", "window_id"], "z")


def keyed_scores(spark, sf):
    return settle(window_scores(spark, sf).select(F.concat_ws("#", "event_type", F.col("window_id").cast("string")).alias("id"), "score"))


@query("window_scores", f"WITH {WS} SELECT event_type, window_id, round(score, 6) AS score FROM ws")
def window_scores_query(spark, sf):
    return rounded(window_scores(spark, sf))


KS = """k AS (SELECT event_type || '#' || window_id AS id, score FROM ws), e AS (SELECT quantile_cont(score, 0.95) AS edge FROM k),
tl AS (SELECT id, score FROM k, e WHERE score >= edge ORDER BY score DESC, id DESC LIMIT {tail}),
nm AS (SELECT id, score FROM k, e WHERE score < edge ORDER BY md5('42|' || id) LIMIT {normal}),
pk AS (SELECT *, 'tail' AS part FROM tl UNION ALL SELECT *, 'normal' FROM nm)"""


@query("balanced_calibration_sample", f"WITH {WS}, {KS.format(tail=40, normal=60)} SELECT id, round(score, 6) AS score, part FROM pk")
def balanced_calibration_sample(spark, sf):
    return rounded(quant.balanced_sample(keyed_scores(spark, sf), "id", 100, 0.4))


def _sweep_sql() -> str:
    parts = []
    for total in (50, 100):
        for balance in (0.2, 0.4):
            tail = round(total * balance)
            body = KS.format(tail=tail, normal=total - tail)
            parts.append(f"""SELECT {total} AS max_total, {balance}::DOUBLE AS balance, selected, tail, mean_score, 'ok' AS status, NULL::VARCHAR AS note
              FROM (WITH {body} SELECT count(*) AS selected, count(*) FILTER (WHERE part = 'tail') AS tail, round(avg(score), 6) AS mean_score FROM pk)""")
    return f"WITH {WS} " + " UNION ALL ".join(parts)


@query("calibration_sweep", _sweep_sql())
def calibration_sweep(spark, sf):
    return rounded(quant.sweep_samples(keyed_scores(spark, sf), "id", (50, 100), (0.2, 0.4)))


@query("int8_round_trip", f"""
WITH {LI}, q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price, CAST(greatest(-128, least(127, round_even(price / 350.0::DOUBLE + -128, 0))) AS TINYINT) AS q FROM li)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, round((q + 128) * 350.0::DOUBLE, 4) AS back FROM q
""")
def int8_round_trip(spark, sf):
    rows = lines(spark, sf).withColumn("q", quant.quantise(F.col("price"), 350.0, -128))
    rows = rows.withColumn("back", quant.dequantise(F.col("q"), 350.0, -128))
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q", "back"), 4)


def embedding_cells(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("cell", "v")).withColumn("v", F.col("v").cast("double"))


@query("output_comparison", """
WITH c AS (SELECT label, vec_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS cell, unnest(embedding)::DOUBLE AS v FROM embeddings),
q AS (SELECT *, greatest(-128, least(127, round_even(v / 0.004::DOUBLE, 0))) * 0.004::DOUBLE AS w FROM c), d AS (SELECT *, abs(v - w) AS d FROM q),
m AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, vec_id, cell) AS rn FROM d)
SELECT label, count(*) AS count, round(avg(d), 6) AS mae, round(avg(d * d), 8) AS mse, round(sqrt(avg(d * d)), 6) AS rmse, round(max(d), 6) AS max_diff,
  max(vec_id) FILTER (WHERE rn = 1) AS max_diff_vec_id, max(cell) FILTER (WHERE rn = 1) AS max_diff_cell, round(max(v) FILTER (WHERE rn = 1), 6) AS max_diff_a, round(max(w) FILTER (WHERE rn = 1), 6) AS max_diff_b,
  count(*) FILTER (WHERE d <= 0.001) AS within_tolerance, round(count(*) FILTER (WHERE d <= 0.001) / count(*) * 100, 6) AS percent_within_tolerance,
  CASE WHEN max(d) < 1e-4 THEN 'excellent' WHEN max(d) < 1e-3 THEN 'good' WHEN max(d) < 1e-2 THEN 'acceptable' ELSE 'problem' END AS verdict FROM m GROUP BY 1
""")
def output_comparison(spark, sf):
    """Embeddings against their INT8 round trip, per label."""
    cells = embedding_cells(spark, sf)
    coded = cells.withColumn("v", quant.dequantise(quant.quantise(F.col("v"), 0.004, 0), 0.004, 0))
    out = quant.compare_outputs(cells, coded, ["vec_id", "cell"], "v", 1e-3, ["label"])
    return rounded(rounded(out, 8, ["mse"]), 6, ["mae", "rmse", "max_diff", "max_diff_a", "max_diff_b", "percent_within_tolerance"])


@query("spaced_sample", f"""
WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM ev)
SELECT event_type, idx, event_id FROM n WHERE n <= 256 OR (idx % greatest(1, n // 256) = 0 AND idx // greatest(1, n // 256) < 256)
""")
def spaced_sample(spark, sf):
    return quant.spaced_sample(indexed_events(spark, sf), "event_type", 256).select("event_type", IDX, "event_id")


def device_log(spark, sf):
    """The events told as device log lines: frames, markers, debug lines and outputs."""
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", F.lit("[AI] Inference done"))
        .when(kind == "view", F.concat(F.lit("[MODBUS] Frame OK #"), F.col("event_id").cast("string")))
        .when(kind == "error", F.lit("[DBG] state"))
        .otherwise(F.concat(F.lit("y = "), F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" z = -1")))
    )
    return order_index(table(spark, sf, "events").select("event_id", text.alias("text")), None, "event_id")


@query("device_log_inferences", r"""
WITH ln AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx, event_type, value FROM events),
g AS (SELECT *, count(*) FILTER (WHERE event_type = 'click') OVER (ORDER BY idx) AS inference,
  coalesce(max(CASE WHEN event_type = 'view' THEN event_id END) OVER (ORDER BY idx), 0) AS frame,
  CASE event_type WHEN 'view' THEN [event_id::DOUBLE] WHEN 'purchase' THEN [value, -1.0] WHEN 'signup' THEN [value, -1.0] ELSE [] END AS vals FROM ln),
c AS (SELECT *, sum(len(vals)) OVER (PARTITION BY inference ORDER BY idx) AS seen, event_type IN ('view', 'error') AS stop FROM g WHERE inference > 0),
k AS (SELECT *, coalesce(sum(CASE WHEN stop AND seen > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY inference ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed,
  first_value(frame) OVER (PARTITION BY inference ORDER BY idx) AS frame_count FROM c)
SELECT inference, frame_count, idx, CAST(unnest(range(0, len(vals))) AS INTEGER) AS position, unnest(vals) AS value FROM k WHERE closed = 0 AND len(vals) > 0
""")
def device_log_inferences(spark, sf):
    return quant.parse_device_log(device_log(spark, sf), None)


# ------------------------------------------------------------------ J

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark, sf):
    reader = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64)
    return reader.parquet(sf).select("event_type", "ts", "event_id", "user_id", "value")


def drained(spark, stream):
    return streaming.drain(stream, f"{folder(spark)}/stream-{uuid.uuid4().hex}")


@query("streamed_count_windows", f"""
WITH {EV}, w AS (SELECT event_type, idx // 30 AS window_id, count(*) AS n, sum(value) AS total, arg_min(value, idx) AS first_value, arg_max(value, idx) AS last_value FROM ev GROUP BY 1, 2)
SELECT event_type, window_id, round(total, 4) AS total, first_value, last_value FROM w WHERE n = 30
""")
def streamed_count_windows(spark, sf):
    out = drained(spark, streaming.count_windows(event_stream(spark, sf), "event_type", ["ts", "event_id"], "value", 30))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("event_type", "window_id", total.alias("total"), F.col("values")[0].alias("first_value"), F.col("values")[29].alias("last_value")), 4)


def batched_stream(spark, sf, n: int = 20):
    """Events as a stream of ``n`` batches, by the remainder of their number; each batch reaches over the whole time."""
    path = f"{folder(spark)}/batches-{uuid.uuid4().hex}"
    rows = settle(events(spark, sf))
    for k in range(n):
        rows.where(F.col("event_id") % n == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


BATCHES = f"""{EV}, bt AS (SELECT *, event_id % 20 AS batch FROM ev), qn AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY batch, ts, event_id) - 1 AS place FROM bt)"""


@query("streamed_windows_once_a_batch", f"""
WITH RECURSIVE {BATCHES}, ct AS (SELECT event_type, batch, count(*) AS n FROM bt GROUP BY 1, 2), gd AS (SELECT event_type, batch, coalesce(n, 0) AS n FROM (SELECT DISTINCT event_type FROM ev) CROSS JOIN range(20) r(batch) LEFT JOIN ct USING (event_type, batch)),
st(event_type, batch, held, fired, done) AS (SELECT DISTINCT event_type, -1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM ev UNION ALL
  SELECT s.event_type, s.batch + 1, CASE WHEN held + n >= 30 THEN 0 ELSE held + n END, CASE WHEN held + n >= 30 THEN fired + 1 ELSE fired END, s.done + n FROM st s JOIN gd ON gd.event_type = s.event_type AND gd.batch = s.batch + 1),
fi AS (SELECT event_type, fired - 1 AS window_id, done FROM (SELECT *, lag(fired) OVER (PARTITION BY event_type ORDER BY batch) AS f0 FROM st) WHERE fired > f0)
SELECT f.event_type, window_id, round(sum(value), 4) AS total, arg_min(value, place) AS first_value, arg_max(value, place) AS last_value FROM fi f JOIN qn ON qn.event_type = f.event_type AND place >= done - 30 AND place < done GROUP BY 1, 2
""")
def streamed_windows_once_a_batch(spark, sf):
    """Twenty batches; a full window waits for the end of its batch while newer rows push out the oldest."""
    out = drained(spark, streaming.count_windows(batched_stream(spark, sf), "event_type", ["ts", "event_id"], "value", 30, "per_batch"))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("event_type", "window_id", total.alias("total"), F.col("values")[0].alias("first_value"), F.col("values")[29].alias("last_value")), 4)


@query("late_rows", """
WITH b AS (SELECT event_type, event_id % 20 AS batch, epoch_ms(ts) AS t FROM events), m AS (SELECT batch, max(t) AS latest FROM b GROUP BY 1),
w AS (SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000 AS bar FROM m)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE t + 900000 <= bar) AS late, count(*) FILTER (WHERE bar IS NULL OR t + 900000 > bar) AS kept FROM b JOIN w USING (batch) GROUP BY 1
""")
def late_rows(spark, sf):
    """What gap sessions of twenty batches (a day's watermark) keep and drop; every row is one or the other."""
    marked = drained(spark, streaming.marked_late(batched_stream(spark, sf), "ts", "15 minutes", "1 day"))
    return marked.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"), F.count_if(~F.col("late")).alias("kept"))


@query("streamed_standardisation", """
WITH p AS (SELECT event_type, avg(value) AS c, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_id, round((value - c) / s, 6) + 0.0 AS z FROM events e JOIN p ON p.event_type = e.event_type
""")
def streamed_standardisation(spark, sf):
    params = settle(events(spark, sf).groupBy("event_type").agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("scale")))
    out = drained(spark, streaming.standardise_stream(event_stream(spark, sf), params, "event_type", "value"))
    return rounded(out.select("event_id", "z"))


@query("streamed_gap_sessions", """
WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 15 MINUTES THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT event_type, ts, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS k FROM g),
w AS (SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 15 MINUTES AS stop, count(*) AS n FROM s GROUP BY event_type, k)
SELECT event_type, epoch_us(start) AS start_us, epoch_us(stop) AS end_us, n FROM w
WHERE n BETWEEN 5 AND 256 AND stop <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTES FROM events)
""")
def streamed_gap_sessions(spark, sf):
    out = drained(spark, streaming.gap_sessions(event_stream(spark, sf), "event_type", "ts", "15 minutes", "10 minutes"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("event_type", us("start").alias("start_us"), us("end").alias("end_us"), "n")


def decoded(df):
    """Events as decoded device rows: address, function and 15 to 17 values."""
    count = F.lit(15) + (F.col("event_id") % 3).cast("int")
    return df.select(
        "event_id", F.when(F.col("event_type") == "error", 2).otherwise(1).alias("address"), F.when(F.col("event_type") == "view", 4).otherwise(3).alias("function"),
        F.array_repeat("value", count).alias("values"))




@query("row_defects", """
WITH d AS (SELECT CASE WHEN event_type = 'error' THEN 'address' WHEN event_type = 'view' THEN 'function' WHEN event_id % 3 <> 1 THEN 'arity' END AS defect FROM events)
SELECT coalesce(defect, 'none') AS defect, count(*) AS rows FROM d GROUP BY 1
""")
def row_defects(spark, sf):
    """Good rows and the rejected side output of the same stream, counted after draining."""
    defect = streaming.row_defect(F.col("address"), F.col("function"), F.col("values"), 1, 3)
    good, bad = streaming.valid_rows(decoded(event_stream(spark, sf)), defect)
    kept = drained(spark, good.select("event_id", F.lit("none").alias("defect")))
    lost = drained(spark, bad.select("event_id", "defect"))
    return kept.unionByName(lost).groupBy("defect").agg(F.count(F.lit(1)).alias("rows"))


@query("defect_rate", """
SELECT count(*) AS rows, count(*) FILTER (WHERE event_type IN ('error', 'view') OR event_id % 3 <> 1) AS bad_rows,
  round(count(*) FILTER (WHERE event_type IN ('error', 'view') OR event_id % 3 <> 1) / count(*), 6) AS bad_rate FROM events
""")
def defect_rate(spark, sf):
    defect = streaming.row_defect(F.col("address"), F.col("function"), F.col("values"), 1, 3)
    return rounded(streaming.defect_rate(decoded(table(spark, sf, "events")), defect))


@query("streamed_cusum", f"""
WITH RECURSIVE {EV}, src AS (SELECT ev.*, m AS mu, 0.5 * s AS k, m - 3 * s AS lo, m + 3 * s AS hi, 5 * s AS h FROM ev JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) t ON ev.event_type = t.event_type),
walk AS (SELECT event_type, idx, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS neg FROM src WHERE idx = 0 UNION ALL
  SELECT s.event_type, s.idx, greatest(0.0, p.pos + s.value - s.mu - s.k), greatest(0.0, p.neg - (s.value - s.mu + s.k)) FROM walk p JOIN src s ON s.event_type = p.event_type AND s.idx = p.idx + 1)
SELECT s.event_id, round(pos, 5) AS cusum_pos, round(neg, 5) AS cusum_neg, pos > h OR neg > h AS cusum_alarm, value < lo OR value > hi AS sigma_danger
FROM walk w JOIN src s ON s.event_type = w.event_type AND s.idx = w.idx
""")
def streamed_cusum(spark, sf):
    mean, std = F.avg("value"), F.stddev_pop("value")
    limits = settle(events(spark, sf).groupBy("event_type").agg(
        mean.alias("mu0"), (5 * std).alias("h"), (0.5 * std).alias("k"), (mean - 3 * std).alias("danger_lower"), (mean + 3 * std).alias("danger_upper")))
    out = drained(spark, streaming.cusum_stream(event_stream(spark, sf), "event_type", ["ts", "event_id"], "value", limits))
    return rounded(out.select("event_id", "cusum_pos", "cusum_neg", "cusum_alarm", "sigma_danger"), 5)
