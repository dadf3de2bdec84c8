"""Forecasters, their evaluation and model comparison (inventory G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalog.base import (
    DAY, EV, EVENT_TYPES, FEATURES, HR, LI, LINE_KEY, daily, indexed_events, indexed_hourly, indexed_lines, lines, query, rounded,
)
from sensorloom.kernels import IDX, attach, framed
from sensorloom.operators import align, arima, detect, forecast, metrics, split, windows
from sensorloom.plans import comparison, flows
from sensorloom.session import settle

N_IN, N_OUT = 30, 10

FW = f"""{EV}, n AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1),
w AS (SELECT event_type, unnest(range(0, n - 39, 10)) AS start FROM n WHERE n >= 40),
x AS (SELECT w.event_type, w.start // 10 AS window_id, avg(value) FILTER (WHERE idx >= start + 10) AS ma, arg_max(value, idx) AS lastv,
  regr_slope(value, idx - start) AS b, regr_intercept(value, idx - start) AS a, w.start FROM w JOIN ev ON ev.event_type = w.event_type AND idx >= start AND idx < start + 30 GROUP BY 1, 2, w.start),
f AS (SELECT x.event_type, window_id, CAST(idx - start - 29 AS INTEGER) AS step, value AS y, lastv, ma, a + b * (idx - start) AS lin
  FROM x JOIN ev ON ev.event_type = x.event_type AND idx >= start + 30 AND idx < start + 40)"""


def event_windows(spark, sf):
    return forecast.forecast_windows(indexed_events(spark, sf), "event_type", "value", N_IN, N_OUT)


def _baseline(name, **options):
    def run(spark, sf):
        model = forecast.get_forecaster(name, "event_type", N_IN, N_OUT, **options)
        made = event_windows(spark, sf)
        return rounded(model.fit(made).predict(made))

    return run


for _name, _column, _options in (("persistence", "lastv", {}), ("moving_average", "ma", {"window": 20}), ("linear_trend", "lin", {})):
    query(f"{_name}_forecast", f"WITH {FW} SELECT event_type, window_id, step, y AS y_true, round({_column}, 6) + 0.0 AS y_pred FROM f")(_baseline(_name, **_options))


def predictions(spark, sf):
    """Persistence forecasts in evaluation form."""
    made = event_windows(spark, sf)
    return forecast.Persistence("event_type", N_IN, N_OUT).predict(made).withColumnRenamed("event_type", "feature")


@query("direct_ridge_forecast")
def direct_ridge_forecast(spark, sf):
    """Fitted on the first 70 % of the hours, measured on the rest."""
    rows = split.split_chronological(align.fill(indexed_hourly(spark, sf), None, EVENT_TYPES), None, (0.7, 0.0, 0.3)).select(IDX, *EVENT_TYPES, "split")
    model = forecast.DirectRidge(EVENT_TYPES, 24, 4, lag=12).fit(rows.where("split = 'train'").drop("split"))
    return metrics.forecast_metrics(model.predict(rows.where("split = 'test'").drop("split")), "step")


@query("holt_forecast")
def holt_forecast(spark, sf):
    made = forecast.forecast_windows(daily(spark, sf).withColumn("series", F.lit("orders")), "series", "total", 60, 14)
    return metrics.forecast_metrics(forecast.ExponentialSmoothing("series", 60, 14).fit(made).predict(made), "step")


@query("independent_window_errors", f"""
WITH {FW}, e AS (SELECT event_type, window_id, avg((y - lin) ** 2) AS error FROM f GROUP BY 1, 2)
SELECT event_type, window_id, round(error, 4) AS error, round(error, 9) > (SELECT round(quantile_cont(error, 0.95), 9) FROM e) AS anomaly FROM e
""")
def independent_window_errors(spark, sf):
    made = event_windows(spark, sf)
    errors = forecast.window_errors(forecast.LinearTrend("event_type", N_IN, N_OUT).predict(made), by=("event_type", "window_id"))
    cut = round(forecast.error_threshold(errors), 9)  # equal to nine digits is not above
    return rounded(errors.withColumn("anomaly", F.round("error", 9) > cut), 4)


@query("training_error_threshold", f"""
WITH {FW}, e AS (SELECT event_type, window_id, avg((y - lastv) ** 2) AS error FROM f GROUP BY 1, 2) SELECT event_type, round(quantile_cont(error, 0.95), 4) AS threshold FROM e GROUP BY 1
""")
def training_error_threshold(spark, sf):
    from sensorloom.kernels import quantiles

    errors = forecast.window_errors(predictions(spark, sf), by=("feature", "window_id"))
    return rounded(quantiles(errors, "feature", "error", [0.95]).select(F.col("feature").alias("event_type"), F.col("q")[0].alias("threshold")), 4)


@query("rolling_forecast_errors", f"""
WITH {EV}, n AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1),
ln AS (SELECT event_type, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a, arg_max(value, idx) AS lastv, avg(value) AS ma FROM ev WHERE idx < 50 GROUP BY 1)
SELECT ev.event_type, idx // 50 - 1 AS window_id, round(avg((value - lastv) ** 2), 4) AS persistence, round(avg((value - ma) ** 2), 4) AS moving_average, round(avg((value - a - b * idx) ** 2), 3) AS linear_trend
FROM ev JOIN n ON n.event_type = ev.event_type JOIN ln ON ln.event_type = ev.event_type WHERE idx >= 50 AND idx < ((n - 50) // 50 + 1) * 50 GROUP BY 1, 2
""")
def rolling_forecast_errors(spark, sf):
    rows, out = indexed_events(spark, sf), None
    for name in ("persistence", "moving_average", "linear_trend"):
        model = forecast.get_forecaster(name, "event_type", 50, 50)
        errors = forecast.window_errors(forecast.rolling_forecast(rows, model, "value"), by=("event_type", "window_id")).withColumnRenamed("error", name)
        out = errors if out is None else attach(out, errors, ["event_type", "window_id"])
    return rounded(rounded(out, 4, ["persistence", "moving_average"]), 3, ["linear_trend"])


_APPROACH_LONG = " UNION ALL ".join(f"SELECT domain, idx, '{f}' AS feature, {f} AS v FROM z" for f in ("quantity", "price"))


@query("approaches_compared", f"""
WITH {LI}, z AS (SELECT domain, idx, (quantity - (SELECT avg(quantity) FROM li WHERE domain = 'N')) / (SELECT stddev_pop(quantity) FROM li WHERE domain = 'N') AS quantity,
  (price - (SELECT avg(price) FROM li WHERE domain = 'N')) / (SELECT stddev_pop(price) FROM li WHERE domain = 'N') AS price FROM li),
lg AS ({_APPROACH_LONG}), n AS (SELECT domain, count(*) AS n FROM li GROUP BY 1),
w AS (SELECT domain, unnest(range(0, n - 39, 20)) AS start FROM n),
pr AS (SELECT w.domain, feature, start, arg_max(v, idx) AS p FROM w JOIN lg ON lg.domain = w.domain AND idx = start + 19 GROUP BY 1, 2, 3),
ea AS (SELECT pr.domain, start, avg((v - p) ** 2) AS error FROM pr JOIN lg ON lg.domain = pr.domain AND lg.feature = pr.feature AND idx >= start + 20 AND idx < start + 40 GROUP BY 1, 2),
th AS (SELECT quantile_cont(error, 0.95) AS t FROM ea WHERE domain = 'N'),
f0 AS (SELECT domain, feature, v AS p FROM lg WHERE idx = 19),
eb AS (SELECT lg.domain, idx // 20 AS start, avg((v - p) ** 2) AS error FROM lg JOIN f0 ON f0.domain = lg.domain AND f0.feature = lg.feature JOIN n ON n.domain = lg.domain
  WHERE idx >= 20 AND idx < ((n - 20) // 20 + 1) * 20 GROUP BY 1, 2),
fl AS (SELECT 'A' AS approach, domain, error > t AS a FROM ea, th UNION ALL SELECT 'B', domain, error > t FROM eb, th)
SELECT 'persistence' AS model, 'standard' AS adapter, approach, count(*) FILTER (WHERE a AND domain = 'R') AS tp, count(*) FILTER (WHERE NOT a AND domain = 'R') AS fn,
  count(*) FILTER (WHERE NOT a AND domain = 'A') AS tn, count(*) FILTER (WHERE a AND domain = 'A') AS fp FROM fl GROUP BY approach
""")
def approaches_compared(spark, sf):
    rows = lines(spark, sf)
    out = comparison.compare_approaches(
        rows.where("domain = 'N'"), rows.where("domain = 'A'"), rows.where("domain = 'R'"), LINE_KEY, ["quantity", "price"], 20,
        models=("persistence",), adapters=("standard",))
    return out.select("model", "adapter", "approach", "tp", "fn", "tn", "fp")


@query("var_forecast")
def var_forecast(spark, sf):
    rows = align.fill(indexed_hourly(spark, sf), None, EVENT_TYPES).select(IDX, *EVENT_TYPES)
    model = forecast.VectorAutoregression(EVENT_TYPES).fit(rows)
    starts = split.evaluation_positions(rows, None, 50)
    return model.forecast(rows, starts, 12)


@query("arima_forecast")
def arima_forecast(spark, sf):
    rows = daily(spark, sf)
    model = forecast.ArimaTwoStep("total").fit(rows)
    values = model.forecast(rows, 30)
    last = rows.agg(F.max("day").alias("day"))
    ahead = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(v).alias("y_pred")) for i, v in enumerate(values)]))
    return last.select("day", ahead.alias("f")).select(F.date_add("day", F.col("f.step")).alias("day"), "f.y_pred")


@query("arima_histories", f"""
WITH RECURSIVE {EV}, df AS (SELECT event_type, idx, value, value - lag(value) OVER w AS x FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY idx)),
lg AS (SELECT *, lag(x) OVER (PARTITION BY event_type ORDER BY idx) AS p FROM df),
en AS (SELECT event_type, unnest(range(100, max(idx) - 10, 100)) AS stop FROM ev GROUP BY 1),
ar AS (SELECT e.event_type, stop, regr_slope(x, p) AS b, regr_intercept(x, p) AS a FROM en e JOIN lg ON lg.event_type = e.event_type AND idx >= 22 AND idx < stop GROUP BY 1, 2),
f(event_type, stop, step, x, level) AS (SELECT a.event_type, stop, 0, x, value FROM ar a JOIN lg ON lg.event_type = a.event_type AND idx = stop - 1 UNION ALL
  SELECT f.event_type, f.stop, step + 1, a + b * x, level + a + b * x FROM f JOIN ar ON ar.event_type = f.event_type AND ar.stop = f.stop WHERE step < 12)
SELECT f.event_type, f.stop AS "end", step, value AS y_true, round(level, 5) + 0.0 AS y_pred FROM f JOIN ev ON ev.event_type = f.event_type AND idx = f.stop + step - 1 WHERE step > 0
""")
def arima_histories(spark, sf):
    """ARIMA(1, 1, 0) of every series, refitted at every hundredth row, twelve steps ahead of each."""
    rows = indexed_events(spark, sf)
    ends = rows.groupBy("event_type").agg(F.max(IDX).alias("_n")).select("event_type", F.explode(F.expr("filter(sequence(100, greatest(_n, 100), 100), e -> e <= _n - 11)")).alias("end"))
    made = arima.forecast_histories(rows, "event_type", "value", ends, 12, (1, 1, 0))
    made = made.withColumn(IDX, F.col("end") + F.col("step") - 1)
    return rounded(attach(made, rows.select("event_type", IDX, F.col("value").alias("y_true")), ["event_type", IDX]).drop(IDX), 5, ["y_pred"])


@query("arima_scores")
def arima_scores(spark, sf):
    """Orders chosen for every series by AIC, and the errors of forecasts from every 250th row with models of those orders."""
    rows = indexed_events(spark, sf)
    orders = settle(arima.choose_orders(rows, "event_type", "value"))
    ends = rows.groupBy("event_type").agg(F.max(IDX).alias("_n")).select("event_type", F.explode(F.expr("filter(sequence(100, greatest(_n, 100), 250), e -> e <= _n - 11)")).alias("end"))
    made = arima.forecast_histories(rows, "event_type", "value", ends, 12, orders)
    made = made.withColumn(IDX, F.col("end") + F.col("step") - 1)
    scored = metrics.forecast_metrics(attach(made, rows.select("event_type", IDX, F.col("value").alias("y_true")), ["event_type", IDX]), "event_type")
    return attach(scored, orders, "event_type")


@query("trend_season_forecast")
def trend_season_forecast(spark, sf):
    rows = daily(spark, sf)
    model = forecast.TrendSeason(7.0).fit(rows, IDX, "total")
    return rounded(model.predict(rows, IDX).select("day", "total", "y_pred"), 4)


def _tree_rows(spark, sf):
    made = windows.long_lags(indexed_events(spark, sf), "event_type", "value", 0, 12, max_lag=120, steps=[1, 6, 12])
    inputs = [c for c in made.columns if c.startswith(("value_lag", "value_mean", "value_std"))]
    return settle(made), inputs


@query("key_horizon_trees")
def key_horizon_trees(spark, sf):
    """Random forests at horizons 1, 6 and 12, interpolated to every step."""
    rows, inputs = _tree_rows(spark, sf)
    model = forecast.TargetTrees(inputs, ["value_t1", "value_t6", "value_t12"], "random_forest").fit(rows)
    scored = model.predict(forecast.evenly(rows.select("event_type", IDX, *inputs), ordered=False))
    scored = scored.select("event_type", IDX, *[F.col(f"pred_value_t{h}").alias(str(h)) for h in (1, 6, 12)])
    long = scored.unpivot(["event_type", IDX], ["1", "6", "12"], "horizon", "y_pred").withColumn("horizon", F.col("horizon").cast("int"))
    every = forecast.interpolate_horizons(long, ["event_type", IDX], 12)
    return every.groupBy("event_type", "step").agg(F.avg("y_pred").alias("mean_pred"), F.count(F.lit(1)).alias("n"))


@query("interpolated_horizons", f"""
WITH {EV}, k AS (SELECT event_type, idx, value AS v1, value * 2 AS v6, value - 5 AS v12, unnest(range(1, 16)) AS step FROM ev)
SELECT event_type, idx, CAST(step AS INTEGER) AS step, round(CASE WHEN step <= 6 THEN v1 + (step - 1) * (v6 - v1) / 5
  WHEN step <= 12 THEN v6 + (step - 6) * (v12 - v6) / 6 ELSE v12 END, 4) AS y_pred FROM k
""")
def interpolated_horizons(spark, sf):
    rows = indexed_events(spark, sf)
    points = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), v.alias("y_pred")) for h, v in ((1, F.col("value")), (6, F.col("value") * 2), (12, F.col("value") - 5))
    ]))
    long = rows.select("event_type", IDX, points.alias("p")).select("event_type", IDX, "p.*")
    return rounded(forecast.interpolate_horizons(long, ["event_type", IDX], 15), 4)


@query("multi_output_boosting")
def multi_output_boosting(spark, sf):
    rows = settle(windows.supervised(indexed_events(spark, sf), "event_type", "value", horizon=2))
    rows = split.split_chronological(rows, "event_type", (0.8, 0.0, 0.2))
    inputs = [c for c in rows.columns if c.startswith(("value_lag", "value_r"))]
    model = forecast.TargetTrees(inputs, ["value_t1", "value_t2"]).fit(rows.where("split = 'train'"))
    scored = model.predict(rows.where("split <> 'train'"))
    parts = [metrics.forecast_metrics(scored, None, f"value_t{h}", f"pred_value_t{h}").withColumn("step", F.lit(h)) for h in (1, 2)]
    return parts[0].unionByName(parts[1])


@query("parameter_search")
def parameter_search(spark, sf):
    rows, inputs = _tree_rows(spark, sf)
    rows = split.split_chronological(rows, "event_type", (0.8, 0.0, 0.2))
    found = forecast.grid_search(
        rows.where("split = 'train'"), rows.where("split <> 'train'"), inputs, "value_t1",
        {"maxDepth": [2, 3], "numTrees": [3, 6]}, "random_forest")
    return spark.createDataFrame([(f["maxDepth"], f["numTrees"], f["r2"], f["rmse"], f["mae"]) for f in found], "maxDepth int, numTrees int, r2 double, rmse double, mae double")


@query("scored_windows", f"""
WITH {EV}, f AS (SELECT event_type, idx AS start, avg(value) OVER w AS m, count(*) OVER w AS n, count(*) OVER (PARTITION BY event_type) AS total FROM ev
  WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
SELECT event_type, start, round(m, 6) AS first_step, 5 AS steps FROM f WHERE start + 35 <= total
""")
def scored_windows(spark, sf):
    """A saved model that repeats the window mean, loaded once per task."""
    def load():
        return lambda x: x.mean(axis=1, keepdims=True).repeat(5, axis=1)

    seqs = windows.sequences(indexed_events(spark, sf), "event_type", "value", 30, 5)
    out = forecast.score_windows(seqs, load, ["event_type", "start"])
    return rounded(out.select("event_type", "start", F.col("y_pred")[0][0].alias("first_step"), F.size("y_pred").alias("steps")))


# ------------------------------------------------------------------ G15-G19, G22

_METRICS = """count(*) AS n, round(avg((y - lastv) ** 2), 4) AS mse, round(sqrt(avg((y - lastv) ** 2)), 6) AS rmse, round(avg(abs(y - lastv)), 6) AS mae,
  round(1 - sum((y - lastv) ** 2) / (var_pop(y) * count(*)), 6) AS r2, round(avg(CASE WHEN abs(y) > 1e-10 THEN abs((y - lastv) / y) END) * 100, 4) AS mape,
  round(1 - var_pop(y - lastv) / var_pop(y), 6) AS explained_variance"""


def _shown(df):
    return rounded(rounded(df, 4, ["mse", "mape"]), 6, ["rmse", "mae", "r2", "explained_variance"])


@query("forecast_metric_report", f"""
WITH {FW} SELECT 'aggregate' AS scope, NULL::INTEGER AS horizon, NULL AS feature, {_METRICS} FROM f
UNION ALL SELECT 'horizon', step, NULL, {_METRICS} FROM f WHERE step IN (1, 5, 10) GROUP BY step
UNION ALL SELECT 'feature', NULL, event_type, {_METRICS} FROM f GROUP BY event_type
""")
def forecast_metric_report(spark, sf):
    return _shown(metrics.metric_report(predictions(spark, sf), horizons=(1, 5, 10)))


@query("scaled_errors", f"""
WITH {FW}, m AS (SELECT event_type, avg(abs(y - lastv)) AS mae FROM f GROUP BY 1), d AS (SELECT event_type, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY idx)) AS d FROM ev),
fd AS (SELECT abs(value - lag(value) OVER (ORDER BY idx, event_type)) AS d FROM ev)
SELECT m.event_type AS feature, round(any_value(mae) / avg(d.d), 6) AS mase, round(any_value(mae) / (SELECT avg(d) FROM fd), 6) AS mase_flat FROM m JOIN d ON d.event_type = m.event_type GROUP BY 1
""")
def scaled_errors(spark, sf):
    """Per-feature MASE, and the one whose denominator mixes features row by row."""
    train = indexed_events(spark, sf).select(F.col("event_type").alias("feature"), IDX, "value")
    scores = settle(metrics.forecast_metrics(predictions(spark, sf), "feature").select("feature", "mae"))
    own = metrics.with_mase(scores, metrics.naive_error(train, "feature", IDX, "value"), "feature")
    flat = metrics.with_mase(scores, metrics.naive_error(train, None, [IDX, "feature"], "value")).withColumnRenamed("mase", "mase_flat")
    return rounded(attach(own, flat.select("feature", "mase_flat"), "feature").select("feature", "mase", "mase_flat"))


@query("regression_report", f"""
WITH {FW}, p AS (SELECT event_type AS feature, count(*) AS n, avg((y - lastv) ** 2) AS mse, avg(abs(y - lastv)) AS mae, 1 - sum((y - lastv) ** 2) / (var_pop(y) * count(*)) AS r2,
  avg(abs(y - lastv) / greatest(abs(y), 2.220446049250313e-16)) * 100 AS mape FROM f GROUP BY 1),
u AS (SELECT * FROM p UNION ALL SELECT '(all)', sum(n)::BIGINT, avg(mse), avg(mae), avg(r2), avg(mape) FROM p)
SELECT feature, n, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2, round(mape, 3) AS mape FROM u
""")
def regression_report(spark, sf):
    out = metrics.regression_report(predictions(spark, sf)).select("feature", "n", "rmse", "mae", "r2", "mape")
    return rounded(rounded(out, 3, ["mape"]), 4, ["rmse", "mae", "r2"])


@query("extended_report", f"""
WITH {FW} SELECT event_type AS feature, count(*) AS n, round(median(abs(y - lastv)), 6) AS medae, round(avg(abs((y - lastv) / (y + 1e-8))) * 100, 3) AS mape,
  round(1 - var_pop(y - lastv) / var_pop(y), 6) AS explained_variance FROM f GROUP BY 1
""")
def extended_report(spark, sf):
    out = metrics.extended_report(predictions(spark, sf)).select("feature", "n", "medae", "mape", "explained_variance")
    return rounded(rounded(out, 3, ["mape"]), 6, ["medae", "explained_variance"])


@query("error_bands", f"""
WITH {FW}, b AS (SELECT event_type AS feature, step, avg(lastv - y) AS m, stddev_pop(lastv - y) AS s, sqrt(avg((lastv - y) ** 2)) AS rmse FROM f GROUP BY 1, 2)
SELECT feature, step, round(m, 6) + 0.0 AS mean_error, round(m - s, 6) AS low_1, round(m + s, 6) AS high_1, round(m - 2 * s, 6) AS low_2, round(m + 2 * s, 6) AS high_2, round(rmse, 6) AS rmse FROM b
""")
def error_bands(spark, sf):
    return rounded(metrics.error_bands(predictions(spark, sf)))


def _all_models(spark, sf):
    made, out = event_windows(spark, sf), None
    for name in ("persistence", "moving_average", "linear_trend"):
        options = {"window": 20} if name == "moving_average" else {}
        one = forecast.get_forecaster(name, "event_type", N_IN, N_OUT, **options).predict(made).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_LONG_MODELS = "lm AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, event_type, window_id, step, y, {c} AS p FROM f" for m, c in (("persistence", "lastv"), ("moving_average", "ma"), ("linear_trend", "lin"))) + ")"


@query("ranked_models", f"""
WITH {FW}, {_LONG_MODELS}, s AS (SELECT model, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2 FROM lm GROUP BY 1)
SELECT model, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, row_number() OVER (ORDER BY r2 DESC, model) AS rank FROM s
""")
def ranked_models(spark, sf):
    scores = metrics.forecast_metrics(_all_models(spark, sf), "model").select("model", "rmse", "mae", "r2")
    return rounded(metrics.rank_models(scores))


@query("best_model_anomalies", f"""
WITH {FW}, {_LONG_MODELS}, s AS (SELECT model, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2 FROM lm GROUP BY 1),
r AS (SELECT lm.*, y - p AS residual FROM lm WHERE model = (SELECT arg_max(model, r2) FROM s)),
b AS (SELECT event_type, avg(residual) AS m, stddev_pop(residual) AS sd FROM r GROUP BY 1)
SELECT r.model, r.event_type AS feature, count(*) AS n, count(*) FILTER (WHERE residual < m - 3 * sd OR residual > m + 3 * sd) AS n_anomalies FROM r JOIN b ON b.event_type = r.event_type GROUP BY 1, 2
""")
def best_model_anomalies(spark, sf):
    made = settle(_all_models(spark, sf))
    best = metrics.best_model(metrics.forecast_metrics(made, "model"))
    rows = made.where(F.col("model") == best).withColumn("residual", F.col("y_true") - F.col("y_pred")).withColumnRenamed("event_type", "feature")
    return flows.detect_residuals(rows, "sigma", 3.0).groupBy("model", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("anomaly").alias("n_anomalies"))


@query("experiment_rollup", """
WITH r AS (SELECT event_type AS model, CASE WHEN value > 200 THEN 'timeout' ELSE 'success' END AS status, value AS runtime FROM events)
SELECT model, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status <> 'success') AS failed,
  round(sum(runtime), 4) AS total_runtime, round(avg(runtime), 4) AS mean_runtime, max(runtime) AS max_runtime FROM r GROUP BY 1
""")
def experiment_rollup(spark, sf):
    """Event rows as experiment runs: values above 200 stand for time-outs."""
    runs = indexed_events(spark, sf).select(
        F.col("event_type").alias("model"), F.when(F.col("value") > 200, "timeout").otherwise("success").alias("status"), F.col("value").alias("runtime"))
    return rounded(metrics.experiment_rollup(runs, ["model"], "status", "runtime"), 4)
