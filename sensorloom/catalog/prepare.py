"""Sources, alignment, splitting and window features (inventory A, B, C)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from sensorloom.catalog.base import (
    DAY, EV, EVENT_TYPES, FEATURES, HR, LI, LINE_KEY, daily, events, hourly, indexed_events, indexed_hourly,
    indexed_lines, lines, query, rounded, table,
)
from sensorloom.kernels import order_index
from sensorloom.operators import align, split, windows
from sensorloom.session import folder
from sensorloom.sources import tables

# ------------------------------------------------------------------ A


@query("stitched_signals", """
WITH seg AS (SELECT event_type, value, event_id, epoch_us(ts) / 1000000.0 AS t,
       date_trunc('day', ts) AS d FROM events)
SELECT event_type, event_id, round(value, 6) AS value, round(t, 6) AS time,
       round(t - min(t) OVER (PARTITION BY event_type), 6) AS time_relative,
       epoch_us(min(d) OVER (PARTITION BY event_type)) +
       CAST(round((t - min(t) OVER (PARTITION BY event_type)) * 1000000) AS BIGINT) AS datetime_us FROM seg
""")
def stitched_signals(spark, sf):
    raw = events(spark, sf).select(
        "event_type", "value", "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("t"),
        F.concat(F.date_format("ts", "dd_MM_yyyy"), F.lit("__00_00_00")).alias("segment"),
    )
    keyed = raw.withColumn("reading", F.struct("value", "event_id"))
    out = tables.stitch_segments(keyed, "event_type", "segment", "t", "reading")
    return rounded(out.select(
        "event_type", F.col("value.event_id").alias("event_id"), F.col("value.value").alias("value"),
        "time", "time_relative", F.unix_micros(F.col("datetime").cast("timestamp")).alias("datetime_us"),
    ))


CATALOGUE = {
    "vibration": [
        {"name": "click", "group": "motor", "sensor": "acc", "subgroup": "rms", "description": "front bearing"},
        {"name": "view", "group": "gear", "sensor": "acc", "subgroup": "rms", "description": "rear bearing"},
    ],
    "temperature": [{"name": "error", "group": "motor", "sensor": "pt100", "subgroup": "case", "column": "oil"}],
}


@query("catalogued_signals", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events
WHERE event_type IN ('click', 'view', 'error') GROUP BY event_type
""")
def catalogued_signals(spark, sf):
    picked = tables.select_signals(events(spark, sf), tables.signal_catalogue(spark, CATALOGUE), "event_type")
    return rounded(picked.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4)


@query("files_with_lineage", """
SELECT domain, 'lineitem.parquet' AS source_file, 'lab' AS dataset_type, CAST(count(*) AS BIGINT) AS n
FROM (SELECT l_returnflag AS domain FROM lineitem) GROUP BY domain
""")
def files_with_lineage(spark, sf):
    df = tables.read_tables(
        spark, [os.path.join(sf, "lineitem.parquet"), os.path.join(sf, "no_such_file.parquet")], "parquet", dataset_type="lab"
    )
    return df.groupBy(F.col("l_returnflag").alias("domain"), "source_file", "dataset_type").agg(F.count(F.lit(1)).alias("n"))


@query("csv_round_trip", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total, min(event_id) AS first_id FROM events GROUP BY event_type
""")
def csv_round_trip(spark, sf):
    out = f"{folder(spark)}/csv-{uuid.uuid4().hex}"
    tables.write_table(events(spark, sf), out, "csv", by=["event_type"])
    back = tables.read_tables(spark, out, "csv", "ts TIMESTAMP_NTZ, event_id BIGINT, value DOUBLE, event_type STRING")
    return rounded(back.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("event_id").alias("first_id")), 4)


@query("globbed_files", """
SELECT 'orders.parquet' AS source_file, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders
""")
def globbed_files(spark, sf):
    df = tables.read_tables(spark, sf, "parquet", "o_orderkey BIGINT, o_totalprice DOUBLE", glob="ord*.parquet", on_error="skip")
    return rounded(df.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@query("thresholds_round_trip", """
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
       round(avg(value) + 2 * stddev_pop(value), 6) AS warning_upper FROM events GROUP BY event_type
""")
def thresholds_round_trip(spark, sf):
    stats = events(spark, sf).groupBy("event_type").agg(
        F.struct(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).alias("statistics"),
        F.struct((F.avg("value") + 2 * F.stddev_pop("value")).alias("warning_upper")).alias("sigma_thresholds"),
    )
    doc = tables.thresholds_to_json(stats, "event_type")
    back = tables.thresholds_from_json(doc, "event_type", stats.drop("event_type").schema)
    return rounded(back.select("event_type", "statistics.mean", "statistics.std", "sigma_thresholds.warning_upper"))


@query("coerced_columns", """
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 4) AS k,
       round(sum(value), 4) AS value_text FROM events
""")
def coerced_columns(spark, sf):
    raw = table(spark, sf, "events").select(
        "ts", "event_type", F.get_json_object("props", "$.k").alias("k"), F.col("value").cast("string").alias("value_text")
    )
    kept = tables.coerce_numeric(raw)
    return rounded(kept.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in kept.columns]), 4)


@query("discovered_columns", """
SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice,
       round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem
""")
def discovered_columns(spark, sf):
    df = tables.validate(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"])
    found = tables.numeric_columns(df, LINE_KEY)
    return rounded(df.agg(*[F.avg(c).alias(c) for c in found]))


@query("unified_features", """
SELECT l_returnflag AS domain, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 6) AS vib_1,
       round(avg(l_discount), 6) AS temp_1 FROM lineitem
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1
""")
def unified_features(spark, sf):
    df = tables.unify(table(spark, sf, "lineitem"), {"l_quantity": "vib_1", "l_discount": "temp_1"}, ["l_returnflag"])
    return rounded(df.groupBy(F.col("l_returnflag").alias("domain")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("vib_1").alias("vib_1"), F.avg("temp_1").alias("temp_1")))


@query("metrics_as_rows", """
SELECT event_type, 'mean' AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1
UNION ALL SELECT event_type, 'rows', CAST(count(*) AS DOUBLE) FROM events GROUP BY 1
""")
def metrics_as_rows(spark, sf):
    agg = events(spark, sf).groupBy("event_type").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("rows"))
    return rounded(tables.metrics_rows(agg, ["event_type"], ["mean", "rows"]))


# ------------------------------------------------------------------ B


def _wide_align_sql() -> str:
    """Bracket by window functions over the union of clock ticks and samples."""
    picks = ", ".join(f"max(v) FILTER (WHERE event_type = '{e}') AS {e}" for e in EVENT_TYPES)
    return f"""
    WITH smp AS (SELECT event_type, epoch_us(ts) / 1000000.0 - 1704067200.0 AS t, value AS v FROM events),
    s2 AS (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0, lead(t) OVER w AS t9, lead(v) OVER w AS v9
           FROM smp WINDOW w AS (PARTITION BY event_type ORDER BY t)),
    clock AS (SELECT t FROM smp WHERE event_type = (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)),
    kinds AS (SELECT DISTINCT event_type FROM smp),
    ticks AS (SELECT event_type, t FROM kinds, clock),
    low AS (SELECT k.event_type, k.t, s.t AS aat, s.v AS av, s.t0, s.v0 FROM ticks k ASOF LEFT JOIN s2 s
            ON k.event_type = s.event_type AND k.t >= s.t),
    both_ends AS (SELECT l.*, s.t AS bt, s.v AS bv, s.t9, s.v9 FROM low l ASOF LEFT JOIN s2 s
            ON l.event_type = s.event_type AND l.t < s.t),
    vals AS (SELECT event_type, t, round(CASE WHEN aat = t THEN av
        WHEN aat IS NULL THEN bv + (t - bt) * (v9 - bv) / (t9 - bt)
        WHEN bt IS NULL THEN v0 + (t - t0) * (av - v0) / (aat - t0)
        ELSE av + (t - aat) * (bv - av) / (bt - aat) END, 4) AS v FROM both_ends)
    SELECT round(t, 6) AS t, {picks} FROM vals GROUP BY t"""


@query("aligned_linear", _wide_align_sql())
def aligned_linear(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0 - 1704067200.0
    wide = align.align_linear(events(spark, sf).select("event_type", t.alias("t"), "value"), "event_type", "t", "value")
    return rounded(rounded(wide, 4, EVENT_TYPES), 6, ["t"])


@query("filled_gaps", f"""
WITH {HR} SELECT hour, {', '.join(f'''round(coalesce(last_value({e} IGNORE NULLS) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING),
  first_value({e} IGNORE NULLS) OVER (ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS {e}''' for e in EVENT_TYPES)} FROM hr
""")
def filled_gaps(spark, sf):
    return rounded(align.fill(indexed_hourly(spark, sf), None, EVENT_TYPES).drop("idx"))


@query("dropped_gaps", f"""
WITH {HR} SELECT hour, {', '.join(f'round({e}, 6) AS {e}' for e in EVENT_TYPES)} FROM hr
WHERE {' AND '.join(f'{e} IS NOT NULL' for e in EVENT_TYPES)}
""")
def dropped_gaps(spark, sf):
    return rounded(align.fill(hourly(spark, sf), None, EVENT_TYPES, "drop"))


@query("mean_filled", f"""
WITH {HR} SELECT hour, {', '.join(f'round(coalesce({e}, avg({e}) OVER ()), 6) AS {e}' for e in EVENT_TYPES)} FROM hr
""")
def mean_filled(spark, sf):
    return rounded(align.fill(hourly(spark, sf), None, EVENT_TYPES, "mean"))


@query("decimated", f"WITH {EV} SELECT event_type, event_id, idx, value FROM ev WHERE idx % 15 = 0")
def decimated(spark, sf):
    return align.decimate(indexed_events(spark, sf), 15).select("event_type", "event_id", "idx", "value")


@query("calendar_resampled", """
WITH b AS (SELECT event_type, CAST(floor(epoch_us(ts) / 1800000000.0) AS BIGINT) AS bin, avg(value) AS v FROM events GROUP BY 1, 2),
s AS (SELECT event_type, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY 1),
f AS (SELECT s.event_type, s.bin, b.v FROM s LEFT JOIN b ON s.event_type = b.event_type AND s.bin = b.bin)
SELECT event_type, make_timestamp(bin * 1800000000) AS ts, round(coalesce(
  last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING),
  first_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value FROM f
""")
def calendar_resampled(spark, sf):
    return rounded(align.resample_calendar(events(spark, sf), "event_type", "ts", ["value"], 1800))


@query("origin_resampled", """
WITH o AS (SELECT event_type, epoch_us(min(ts)) AS t0 FROM events GROUP BY 1)
SELECT e.event_type, CAST(floor((epoch_us(ts) / 1000000.0 - t0 / 1000000.0) / 7200.0) AS BIGINT) AS bin, round(avg(value), 6) AS value
FROM events e JOIN o ON e.event_type = o.event_type GROUP BY 1, 2
""")
def origin_resampled(spark, sf):
    return rounded(align.resample_origin(events(spark, sf), "event_type", "ts", ["value"], 7200.0))


@query("resampled_if_needed", """
WITH o AS (SELECT epoch_us(min(ts)) / 1000000.0 AS t0 FROM events)
SELECT round(avg(value), 6) AS value FROM events, o GROUP BY floor((epoch_us(ts) / 1000000.0 - t0) / 5400.0)
""")
def resampled_if_needed(spark, sf):
    return rounded(align.resample_if_needed(events(spark, sf), "ts", ["value"], 5400.0, tie=["event_id"]))


@query("sampling_gap", """
WITH g AS (SELECT event_type, epoch_us(ts) / 1000000.0 - lag(epoch_us(ts) / 1000000.0) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS d FROM events)
SELECT event_type, round(median(d), 4) AS median_gap FROM g GROUP BY 1
""")
def sampling_gap(spark, sf):
    return rounded(align.median_gap(events(spark, sf), "event_type", "ts", ["event_id"]), 4)


@query("time_parts", """
SELECT event_id, CAST(extract('hour' FROM ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week FROM events
""")
def time_parts(spark, sf):
    return align.time_parts(events(spark, sf), "ts").select("event_id", "hour", "day_of_week")


@query("chronological_split", f"""
WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM ev)
SELECT event_type, CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train' WHEN idx < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split,
  count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM n GROUP BY 1, 2
""")
def chronological_split(spark, sf):
    rows = split.split_chronological(indexed_events(spark, sf), "event_type", (70, 10, 20))
    return rows.groupBy("event_type", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def _scenario(name):
    def run(spark, sf):
        rows = split.scenario(indexed_events(spark, sf), "event_type", name, lab="click", fatigue="error", field="view")
        train = rows.where("split = 'train'").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
        scaled = rows.withColumn("z", (F.col("value") - train["m"]) / train["s"])
        return rounded(scaled.groupBy("event_type", "split").agg(
            F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z"), F.max("idx").alias("last_idx")))

    return run


_SCENARIO_LABEL = {
    "a": ("event_type = 'view'", "CASE WHEN idx < floor(n * 0.7::DOUBLE) THEN 'train' WHEN idx < floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END"),
    "b": ("event_type IN ('click', 'view') OR (event_type = 'error' AND idx < lab_n)",
          "CASE event_type WHEN 'click' THEN 'train' WHEN 'error' THEN 'val' ELSE 'test' END"),
    "c": ("event_type IN ('click', 'view')",
          "CASE WHEN event_type = 'view' THEN 'test' WHEN idx < floor(lab_n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END"),
}
for _key, (_where, _label) in _SCENARIO_LABEL.items():
    query(f"scenario_{_key}", f"""
WITH {EV}, n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n,
  (SELECT count(*) FROM events WHERE event_type = 'click') AS lab_n FROM ev),
l AS (SELECT *, {_label} AS split FROM n WHERE {_where}),
s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM l WHERE split = 'train')
SELECT event_type, split, count(*) AS n, round(avg((value - m) / sd), 6) + 0.0 AS mean_z, max(idx) AS last_idx FROM l, s GROUP BY 1, 2
""")(_scenario(_key.upper()))


@query("evaluation_positions", f"""
WITH {EV}, n AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1),
p AS (SELECT DISTINCT event_type, CAST(floor(i * ((n - 1) / (least(100, n) - 1.0::DOUBLE))) AS BIGINT) AS idx
      FROM n, range(100) r(i) WHERE i < n)
SELECT ev.event_type, ev.idx, ev.event_id FROM ev JOIN p ON ev.event_type = p.event_type AND ev.idx = p.idx
""")
def evaluation_positions(spark, sf):
    return split.evaluation_positions(indexed_events(spark, sf), "event_type").select("event_type", "idx", "event_id")


@query("evaluation_steps", f"""
WITH {EV}, n AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY event_type) // 100) AS step FROM ev)
SELECT event_type, idx, event_id FROM n WHERE idx % step = 0 AND idx // step < 100
""")
def evaluation_steps(spark, sf):
    return split.evaluation_positions(indexed_events(spark, sf), "event_type", mode="step").select("event_type", "idx", "event_id")


@query("hash_sample", f"""
WITH {LI} SELECT {', '.join(LINE_KEY)}, price FROM li
ORDER BY md5(concat_ws('|', '42', {', '.join(f'CAST({k} AS VARCHAR)' for k in LINE_KEY)})) LIMIT 5000
""")
def hash_sample(spark, sf):
    return split.hash_sample(lines(spark, sf), LINE_KEY, 5000).select(*LINE_KEY, "price")


_H = f"md5(concat_ws('|', '42', {', '.join(f'CAST({k} AS VARCHAR)' for k in LINE_KEY)}))"


@query("training_mix", f"""
WITH {LI}, lab AS (SELECT * FROM li WHERE domain = 'N' ORDER BY {_H} LIMIT 4000),
fld AS (SELECT *, row_number() OVER (ORDER BY {_H}) - 1 AS i FROM li WHERE domain = 'A'),
k AS (SELECT least(2000, count(*) // 2) AS take, least(3000, count(*) - least(2000, count(*) // 2)) AS rest FROM fld),
u AS (SELECT domain, price, 'train' AS part FROM lab UNION ALL
      SELECT domain, price, CASE WHEN i < take THEN 'train' ELSE 'field_test' END FROM fld, k WHERE i < take + rest)
SELECT domain, part, count(*) AS n, round(sum(price), 2) AS total FROM u GROUP BY 1, 2
""")
def training_mix(spark, sf):
    rows = lines(spark, sf)
    mix = split.training_mix(rows.where("domain = 'N'"), rows.where("domain = 'A'"), LINE_KEY, "lab_and_campo", 4000, 3000)
    return rounded(mix.groupBy("domain", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total")), 2)


@query("tail_fraction", f"""
WITH {LI}, n AS (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM li)
SELECT domain, count(*) AS n, min(idx) AS first_idx, round(sum(price), 2) AS total FROM n
WHERE idx >= n - floor(n * 0.3::DOUBLE) GROUP BY 1
""")
def tail_fraction(spark, sf):
    rows = split.tail_fraction(indexed_lines(spark, sf), "domain")
    return rounded(rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.sum("price").alias("total")), 2)


@query("warm_up_skipped", f"WITH {EV} SELECT event_type, idx, event_id FROM ev WHERE idx >= 50 AND idx < 1000")
def warm_up_skipped(spark, sf):
    return split.index_slice(indexed_events(spark, sf), 50, 1000).select("event_type", "idx", "event_id")


@query("scaled_and_smoothed", f"""
WITH {EV}, s AS (SELECT *, coalesce((value - min(value) OVER p) / nullif(max(value) OVER p - min(value) OVER p, 0), 0) AS scaled,
  avg(value) OVER (PARTITION BY event_type ORDER BY idx ROWS 9 PRECEDING) AS smooth FROM ev WINDOW p AS (PARTITION BY event_type))
SELECT event_type, idx, idx // 100 AS block, round(scaled, 6) AS scaled, round(smooth, 6) AS smooth FROM s WHERE idx >= 9
""")
def scaled_and_smoothed(spark, sf):
    rows = split.min_max(indexed_events(spark, sf), "event_type", "value", "scaled")
    rows = split.blocks_of(windows.moving_average(rows, "event_type", "value", 10, "smooth"), 100)
    return rounded(rows.select("event_type", "idx", "block", "scaled", "smooth"))


# ------------------------------------------------------------------ C


@query("rolling_features", f"""
WITH {EV} SELECT event_type, event_id, {', '.join(f'round({fn}(value) OVER w, 6) AS value_{n}' for fn, n in (('avg', 'mean'), ('stddev_samp', 'std'), ('min', 'min'), ('max', 'max')))}
FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS 29 PRECEDING)
""")
def rolling_features(spark, sf):
    rows = windows.rolling(indexed_events(spark, sf), "event_type", "value", 30)
    return rounded(rows.select("event_type", "event_id", *[f"value_{a}" for a in ("mean", "std", "min", "max")]))


def _supervised_sql(frames: str, need: bool) -> str:
    cols, keep = [], []
    for lag in (1, 2, 3, 5, 10):
        cols.append(f"lag(value, {lag}) OVER o AS value_lag{lag}")
        keep.append(f"value_lag{lag}")
    for w in (3, 5, 10):
        back, end = (w - 1, 0) if frames == "current" else (w, 1)
        frame = f"(PARTITION BY event_type ORDER BY idx ROWS BETWEEN {back} PRECEDING AND {end} PRECEDING)".replace("AND 0 PRECEDING", "AND CURRENT ROW")
        for fn, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")):
            expr = f"{fn}(value) OVER {frame}"
            if need:
                expr = f"CASE WHEN count(value) OVER {frame} = {w} THEN {expr} END"
            cols.append(f"{expr} AS value_r{n}{w}")
            keep.append(f"value_r{n}{w}")
    for h in (1, 2):
        cols.append(f"lead(value, {h}) OVER o AS value_t{h}")
        keep.append(f"value_t{h}")
    shown = ", ".join(f"round({k}, 6) AS {k}" for k in keep)
    raw = ", value" if need else ""
    return f"""WITH {EV}, f AS (SELECT event_type, idx, value, {', '.join(cols)} FROM ev WINDOW o AS (PARTITION BY event_type ORDER BY idx))
    SELECT event_type, idx{raw}, {shown} FROM f WHERE {' AND '.join(f'{k} IS NOT NULL' for k in keep)}"""


@query("supervised_current_row", _supervised_sql("current", False))
def supervised_current_row(spark, sf):
    return rounded(windows.supervised(indexed_events(spark, sf), "event_type", "value", horizon=2))


@query("supervised_shifted", _supervised_sql("shifted", True))
def supervised_shifted(spark, sf):
    return rounded(windows.supervised(
        indexed_events(spark, sf), "event_type", "value", horizon=2, include_current=False, keep_raw=True))


def _long_lags_sql() -> str:
    lags, rolls = windows.lag_budget(360)
    cols = [f"lag(value, {k}) OVER o AS value_lag{k}" for k in lags]
    keep = [f"value_lag{k}" for k in lags]
    for w in rolls:
        frame = f"(PARTITION BY event_type ORDER BY idx ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        cols += [f"avg(value) OVER {frame} AS value_mean{w}", f"stddev_pop(value) OVER {frame} AS value_std{w}"]
        keep += [f"value_mean{w}", f"value_std{w}"]
    for h in (1, 60):
        cols.append(f"lead(value, {h}) OVER o AS value_t{h}")
        keep.append(f"value_t{h}")
    return f"""WITH {EV}, f AS (SELECT event_type, idx, {', '.join(cols)} FROM ev WINDOW o AS (PARTITION BY event_type ORDER BY idx))
    SELECT event_type, idx, {', '.join(f'round({k}, 6) AS {k}' for k in keep)} FROM f WHERE idx >= {max(lags)} AND value_t60 IS NOT NULL"""


@query("long_lags", _long_lags_sql())
def long_lags(spark, sf):
    rows = indexed_events(spark, sf)
    made = windows.long_lags(rows, "event_type", "value", 0, 60, max_lag=360, steps=[1, 60])
    return rounded(made.drop("ts", "event_id", "value"))


@query("sliding_sequences", f"""
WITH {EV}, f AS (SELECT event_type, idx AS start, list(value) OVER x AS x, list(value) OVER y AS y FROM ev
  WINDOW x AS (PARTITION BY event_type ORDER BY idx ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING),
         y AS (PARTITION BY event_type ORDER BY idx ROWS BETWEEN 30 FOLLOWING AND 39 FOLLOWING))
SELECT event_type, start, x[1] AS x_first, x[30] AS x_last, round(list_sum(x), 4) AS x_sum, y[1] AS y_first, y[10] AS y_last
FROM f WHERE len(x) = 30 AND len(y) = 10
""")
def sliding_sequences(spark, sf):
    rows = windows.sequences(indexed_events(spark, sf), "event_type", "value", 30, 10)
    return rounded(rows.select(
        "event_type", "start", F.col("x")[0][0].alias("x_first"), F.col("x")[29][0].alias("x_last"),
        F.aggregate("x", F.lit(0.0), lambda a, r: a + r[0]).alias("x_sum"),
        F.col("y")[0][0].alias("y_first"), F.col("y")[9][0].alias("y_last")), 4)


@query("strided_windows", f"""
WITH {EV}, n AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1),
w AS (SELECT event_type, unnest(range(0, n - 40 + 1, 10)) AS start FROM n WHERE n >= 40)
SELECT w.event_type, w.start // 10 AS window_id, CAST(ev.idx - w.start AS INTEGER) AS step, ev.value FROM w
JOIN ev ON ev.event_type = w.event_type AND ev.idx >= w.start AND ev.idx < w.start + 40
""")
def strided_windows(spark, sf):
    rows = split.with_total(indexed_events(spark, sf), "event_type")
    return windows.strided_windows(rows, "event_type", 40, 10).select("event_type", "window_id", "step", "value")


@query("prepared_sequences", f"""
WITH {HR}, f AS (SELECT idx, {', '.join(f'''coalesce(last_value({e} IGNORE NULLS) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING),
  first_value({e} IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {e}''' for e in EVENT_TYPES if e != 'purchase')} FROM hr),
d AS (SELECT idx // 2 AS idx, {', '.join(e for e in EVENT_TYPES if e != 'purchase')} FROM f WHERE idx % 2 = 0),
tr AS (SELECT * FROM d WHERE idx < floor(((SELECT count(*) FROM d) - 24 - 4 + 1) * 0.8::DOUBLE)),
z AS (SELECT idx, {', '.join(f'({e} - (SELECT avg({e}) FROM tr)) / (SELECT stddev_pop({e}) FROM tr) AS {e}' for e in EVENT_TYPES if e != 'purchase')} FROM d),
q AS (SELECT idx AS start, {', '.join(f'avg({e}) OVER x AS x_{e}, lead({e}, 24) OVER (ORDER BY idx) AS y_{e}' for e in EVENT_TYPES if e != 'purchase')},
  count(*) OVER x AS nx, count(*) OVER () - 24 - 4 + 1 AS n FROM z WINDOW x AS (ORDER BY idx ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING))
SELECT start, CASE WHEN start < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split,
  {', '.join(f'round(x_{e}, 6) + 0.0 AS x_{e}, round(y_{e}, 6) + 0.0 AS y_{e}' for e in EVENT_TYPES if e != 'purchase')}
FROM q WHERE start < n
""")
def prepared_sequences(spark, sf):
    from sensorloom.plans.training import prepare

    made = prepare(hourly(spark, sf), "hour", ["click", "error", "signup", "view"], 24, 4, decimation=2, test_size=0.2)
    cols = []
    for i, e in enumerate(["click", "error", "signup", "view"]):
        column = F.transform("x", (lambda k: lambda r: r[k])(i))
        cols.append((F.aggregate(column, F.lit(0.0), lambda a, v: a + v) / 24).alias(f"x_{e}"))
        cols.append(F.col("y")[0][i].alias(f"y_{e}"))
    return rounded(made.select("start", "split", *cols))


@query("column_stats", f"""
WITH {HR} {' UNION ALL '.join(f"SELECT '{e}' AS feature, count({e}) AS non_null, count(*) - count({e}) AS nulls, round(avg({e}), 6) AS mean, round(stddev_samp({e}), 6) AS std, round(min({e}), 6) AS min, round(max({e}), 6) AS max FROM hr" for e in EVENT_TYPES)}
""")
def column_stats(spark, sf):
    return rounded(windows.column_stats(hourly(spark, sf), EVENT_TYPES))


@query("centred_mean", f"""
WITH {DAY}, m AS (SELECT idx, total, avg(total) OVER w AS smooth, count(*) OVER w AS n FROM dy WINDOW w AS (ORDER BY idx ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING))
SELECT idx, round(total, 2) AS total, round(CASE WHEN n = 14 THEN smooth END, 4) AS smooth FROM m
""")
def centred_mean(spark, sf):
    rows = windows.centred_mean(daily(spark, sf), None, "total", 14, "smooth")
    return rounded(rounded(rows.select("idx", "total", "smooth"), 2, ["total"]), 4, ["smooth"])
