"""Point, residual and multivariate detectors with their thresholds (inventory D, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.catalog.base import (
    EV, EVENT_TYPES, FEATURES, HR, LI, events, indexed_events, indexed_hourly, lines, query, rounded, table,
)
from sensorloom.kernels import IDX, attach, framed, quantiles
from sensorloom.operators import detect, outliers, scale, thresholds
from sensorloom.operators.split import with_total
from sensorloom.plans import flows
from sensorloom.session import settle

EVENT_ROW = ("event_type", "event_id")


# ------------------------------------------------------------------ D


def _scaler_sql(centre: str, spread: str) -> str:
    cols = ", ".join(
        f"round(({f} - (SELECT {centre.format(f)} FROM src)) / (SELECT {spread.format(f)} FROM src), 6) + 0.0 AS {f}" for f in FEATURES
    )
    return f"""WITH {LI}, src AS (SELECT * FROM li WHERE domain = 'N')
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {cols} FROM li WHERE domain = 'A'"""


def _scaled(adapter):
    def run(spark, sf):
        rows = lines(spark, sf)
        out = adapter(FEATURES).fit(rows.where("domain = 'N'")).transform(rows.where("domain = 'A'"))
        return rounded(out.drop("domain"))

    return run


query("standard_scaled", _scaler_sql("avg({0})", "stddev_pop({0})"))(_scaled(scale.StandardScaler))
query("robust_scaled", _scaler_sql("median({0})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"))(_scaled(scale.RobustScaler))
query("min_max_scaled", _scaler_sql("min({0})", "max({0}) - min({0})"))(_scaled(scale.MinMaxScaler))
query("quantile_normal_scaled")(_scaled(scale.QuantileNormal))


@query("coral_covariance", f"""
WITH {LI} SELECT round(avg(price), 2) AS mean_price, round(avg(quantity), 4) AS mean_quantity, round(var_samp(quantity), 3) AS var_quantity,
  round(covar_samp(quantity, discount), 4) + 0.0 AS cov_qd, round(var_samp(discount), 5) AS var_discount FROM li WHERE domain = 'N'
""")
def coral_covariance(spark, sf):
    """After alignment the field data has the lab's means and covariance."""
    rows = lines(spark, sf)
    out = scale.Coral(["quantity", "price", "discount"], 1e-12).fit(rows.where("domain = 'N'")).transform(rows.where("domain = 'A'"))
    agg = out.agg(
        F.avg("price").alias("mean_price"), F.avg("quantity").alias("mean_quantity"), F.var_samp("quantity").alias("var_quantity"),
        F.covar_samp("quantity", "discount").alias("cov_qd"), F.var_samp("discount").alias("var_discount"))
    for c, d in (("mean_price", 2), ("mean_quantity", 4), ("var_quantity", 3), ("cov_qd", 4), ("var_discount", 5)):
        agg = rounded(agg, d, [c])
    return agg


@query("standardised_with_stored_params", f"""
WITH {EV}, n AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1),
p AS (SELECT ev.event_type, avg(value) AS c, stddev_pop(value) AS s FROM ev JOIN n ON ev.event_type = n.event_type WHERE idx < n // 2 GROUP BY 1)
SELECT ev.event_type, event_id, round((value - c) / s, 6) + 0.0 AS z FROM ev JOIN p ON ev.event_type = p.event_type
""")
def standardised_with_stored_params(spark, sf):
    rows = indexed_events(spark, sf)
    early = with_total(rows, "event_type", "_n").where(F.col(IDX) < F.floor(F.col("_n") / 2))  # the first half of every series
    params = early.groupBy(F.col("event_type").alias("feature")).agg(
        F.avg("value").alias("centre"), F.stddev_pop("value").alias("scale"))
    return rounded(scale.standardise_with(rows, params, "event_type", "value", "z").select(*EVENT_ROW, "z"))


@query("scalers_compared", f"""
WITH {LI}, s AS (SELECT {', '.join(f'avg({f}) FILTER (WHERE domain = {d!r}) AS m_{f}_{n}, stddev_pop({f}) FILTER (WHERE domain = {d!r}) AS s_{f}_{n}' for f in FEATURES for d, n in (('N', 'a'), ('A', 'b')))} FROM li)
SELECT round(greatest({', '.join(f'abs(m_{f}_a - m_{f}_b)' for f in FEATURES)}), 4) AS max_centre_diff,
  round(greatest({', '.join(f'abs(s_{f}_a - s_{f}_b)' for f in FEATURES)}), 4) AS max_scale_diff, false AS same FROM s
""")
def scalers_compared(spark, sf):
    rows = lines(spark, sf)
    fits = [scale.StandardScaler(FEATURES).fit(rows.where(f"domain = '{d}'")).params(spark) for d in "NA"]
    return rounded(scale.compare_params(*fits), 4)


# ------------------------------------------------------------------ F1-F10


@query("rolling_zscore", f"""
WITH {EV}, w AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n FROM ev
  WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS 99 PRECEDING))
SELECT event_type, event_id, round(CASE WHEN n = 100 THEN (value - m) / s END, 6) AS zscore,
  coalesce(n = 100 AND abs((value - m) / s) > 3, false) AS z_anom FROM w
""")
def rolling_zscore(spark, sf):
    return rounded(detect.zscore(indexed_events(spark, sf), "event_type", "value", 100).select(*EVENT_ROW, "zscore", "z_anom"))


MAD_CTE = """med AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1),
md AS (SELECT e.event_type, med, median(abs(value - med)) AS mad FROM events e JOIN med m ON e.event_type = m.event_type GROUP BY 1, 2)"""


@query("mad_flags", f"""
WITH {MAD_CTE} SELECT e.event_type, event_id, round(CASE WHEN mad > 0 THEN 0.6745 * abs(value - med) / mad ELSE 0 END, 6) AS mad_score,
  coalesce(mad > 0 AND 0.6745 * abs(value - med) / mad > 3.5, false) AS mad_anom FROM events e JOIN md ON e.event_type = md.event_type
""")
def mad_flags(spark, sf):
    return rounded(detect.mad(events(spark, sf), "event_type", "value").select(*EVENT_ROW, "mad_score", "mad_anom"))


PEAK_CTE = """cmp AS (SELECT *, lag(value) OVER o AS pv, lead(value) OVER o AS nv FROM ev WINDOW o AS (PARTITION BY event_type ORDER BY idx)),
runs AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv <> value THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY idx) AS run FROM cmp),
tops AS (SELECT event_type, mid AS idx, h FROM (SELECT event_type, (min(idx) + max(idx)) // 2 AS mid, any_value(value) AS h,
  arg_min(coalesce(pv, 'inf'::DOUBLE), idx) AS pv1, arg_max(coalesce(nv, 'inf'::DOUBLE), idx) AS nv1 FROM runs GROUP BY event_type, run) WHERE pv1 < h AND nv1 < h),
lim AS (SELECT event_type, avg(value) + 2 * stddev_pop(value) AS hmin, 0.5 * stddev_pop(value) AS pmin FROM events GROUP BY 1),
cand AS (SELECT t.*, pmin FROM tops t JOIN lim l ON t.event_type = l.event_type WHERE h >= hmin),
edge AS (SELECT c.event_type, c.idx, c.h, c.pmin,
  coalesce((SELECT max(e.idx) FROM ev e WHERE e.event_type = c.event_type AND e.idx < c.idx AND e.value > c.h), -1) AS lo,
  coalesce((SELECT min(e.idx) FROM ev e WHERE e.event_type = c.event_type AND e.idx > c.idx AND e.value > c.h), 9223372036854775807) AS hi FROM cand c),
prom AS (SELECT c.event_type, c.idx, c.h, c.pmin, c.h - greatest(
  min(e.value) FILTER (WHERE e.idx <= c.idx), min(e.value) FILTER (WHERE e.idx >= c.idx)) AS prominence
  FROM edge c JOIN ev e ON e.event_type = c.event_type AND e.idx > c.lo AND e.idx < c.hi GROUP BY c.event_type, c.idx, c.h, c.pmin)"""


@query("peaks", f"""
WITH {EV}, {PEAK_CTE} SELECT event_type, idx, h AS height, round(prominence, 6) AS prominence FROM prom WHERE prominence >= pmin
""")
def peaks(spark, sf):
    rows = indexed_events(spark, sf)
    return rounded(detect.peaks_above(rows, "event_type", "value", detect.peak_params(rows, "event_type", "value")))


TREND_CTE = """sl AS (SELECT event_type, event_id, idx, ra, ra - lag(ra) OVER (PARTITION BY event_type ORDER BY idx) AS slope FROM (
  SELECT *, CASE WHEN count(value) OVER w = 200 THEN avg(value) OVER w END AS ra FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS 199 PRECEDING))),
lim2 AS (SELECT event_type, avg(slope) + 3 * stddev_samp(slope) AS up, avg(slope) - 3 * stddev_samp(slope) AS dn FROM sl GROUP BY 1)"""


@query("trend_slopes", f"""
WITH {EV}, {TREND_CTE} SELECT s.event_type, event_id, round(slope, 6) + 0.0 AS slope, coalesce(slope > up OR slope < dn, false) AS trend_anom
FROM sl s JOIN lim2 l ON s.event_type = l.event_type
""")
def trend_slopes(spark, sf):
    return rounded(detect.trend(indexed_events(spark, sf), "event_type", "value", 200).select(*EVENT_ROW, "slope", "trend_anom"))


def _cusum_cte(source: str, value: str, mu: str, h: str, k: str, part: str, prefix: str, extra: str = "") -> str:
    """CUSUM by recursion over the rows, straight from its definition."""
    return f"""{prefix} AS (SELECT {part}, idx, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS neg{extra} FROM {source} WHERE idx = 0 UNION ALL
    SELECT s.{part}, s.idx, greatest(0.0, p.pos + (s.{value} - s.{mu} - s.{k})), greatest(0.0, p.neg - (s.{value} - s.{mu} + s.{k})){extra}
    FROM {prefix} p JOIN {source} s ON s.{part} = p.{part} AND s.idx = p.idx + 1)"""


@query("cusum", f"""
WITH RECURSIVE {EV}, src AS (SELECT ev.*, m AS mu, s AS k FROM ev JOIN (SELECT event_type, avg(value) AS m, 0.5 * stddev_pop(value) AS s FROM events GROUP BY 1) t ON ev.event_type = t.event_type),
{_cusum_cte('src', 'value', 'mu', 'h', 'k', 'event_type', 'walk')}
SELECT w.event_type, ev.event_id, round(pos, 6) AS cusum_pos, round(neg, 6) AS cusum_neg, pos > 200 OR neg > 200 AS cusum_alarm
FROM walk w JOIN ev ON ev.event_type = w.event_type AND ev.idx = w.idx
""")
def cusum(spark, sf):
    rows = indexed_events(spark, sf)
    rows = detect.attach_stats(rows, rows.groupBy("event_type").agg(F.avg("value").alias("mu"), (0.5 * F.stddev_pop("value")).alias("k")), "event_type")
    out = detect.cusum(rows, "event_type", "value", F.col("mu"), F.lit(200.0), F.col("k"))
    return rounded(out.select(*EVENT_ROW, "cusum_pos", "cusum_neg", "cusum_alarm"))


def _ewma_cte(alpha: float) -> str:
    return f"""e0 AS (SELECT event_type, idx, value AS num, 1.0::DOUBLE AS den FROM ev WHERE idx = 0 UNION ALL
    SELECT v.event_type, v.idx, v.value + {1 - alpha}::DOUBLE * p.num, 1.0 + {1 - alpha}::DOUBLE * p.den FROM e0 p JOIN ev v ON v.event_type = p.event_type AND v.idx = p.idx + 1),
    ew AS (SELECT event_type, idx, num / den AS ewma FROM e0)"""


@query("ewma", f"""
WITH RECURSIVE {EV}, {_ewma_cte(0.1)} SELECT ev.event_type, event_id, round(ewma, 6) AS ewma FROM ew JOIN ev ON ew.event_type = ev.event_type AND ew.idx = ev.idx
""")
def ewma(spark, sf):
    return rounded(detect.ewma(indexed_events(spark, sf), "event_type", "value", 0.1).select(*EVENT_ROW, "ewma"))


@query("ewma_cusum", f"""
WITH RECURSIVE {EV}, {_ewma_cte(0.01)}, bl AS (SELECT event_type, avg(ewma) AS mu, 4 * stddev_samp(ewma) AS h, 0.5 * stddev_samp(ewma) AS k FROM ew WHERE idx < 500 GROUP BY 1),
src AS (SELECT ew.*, mu, h, k FROM ew JOIN bl ON ew.event_type = bl.event_type), {_cusum_cte('src', 'ewma', 'mu', 'h', 'k', 'event_type', 'walk', ', h')
  .replace('greatest(0.0, p.neg - (s.ewma - s.mu + s.k)), h', 'greatest(0.0, p.neg - (s.ewma - s.mu + s.k)), s.h')}
SELECT w.event_type, ev.event_id, round(ewma, 6) AS ewma, round(pos, 5) AS cusum_pos, round(neg, 5) AS cusum_neg, pos > w.h OR neg > w.h AS cusum_alarm
FROM walk w JOIN ev ON ev.event_type = w.event_type AND ev.idx = w.idx JOIN ew ON ew.event_type = w.event_type AND ew.idx = w.idx
""")
def ewma_cusum(spark, sf):
    out = detect.ewma_cusum(indexed_events(spark, sf), "event_type", "value", 0.01, 500)
    return rounded(rounded(out.select(*EVENT_ROW, "ewma", "cusum_pos", "cusum_neg", "cusum_alarm"), 5, ["cusum_pos", "cusum_neg"]), 6, ["ewma"])


COMBOS = "(VALUES (0, 'h=4_k=0.5', 4.0::DOUBLE, 0.5::DOUBLE), (1, 'h=5_k=0.5', 5.0, 0.5), (2, 'h=8_k=0.25', 8.0, 0.25), (3, 'h=2.5_k=1', 2.5, 1.0)) c(ord, combo, hf, kf)"


def _grid_cte(samples: str, alpha: float = 0.1) -> str:
    return f"""{_ewma_cte(alpha)}, bl AS (SELECT event_type, avg(ewma) AS mu, stddev_samp(ewma) AS sg FROM ew WHERE idx < {samples} GROUP BY 1),
    src AS (SELECT ew.event_type || '|' || combo AS grp, ew.event_type, combo, ord, hf, kf, idx, ewma, mu, sg, hf * sg AS h, kf * sg AS k FROM ew JOIN bl ON ew.event_type = bl.event_type, {COMBOS}),
    {_cusum_cte('src', 'ewma', 'mu', 'h', 'k', 'grp', 'walk')},
    grid AS (SELECT s.event_type, s.combo, s.ord, any_value(hf) AS hf, any_value(kf) AS kf, any_value(mu) AS mu, any_value(sg) AS sg, any_value(h) AS h, any_value(k) AS k,
      count(*) FILTER (WHERE pos > h OR neg > h) AS n_alarms, count(*) FILTER (WHERE pos > h OR neg > h) / count(*) * 100 AS rate
      FROM walk w JOIN src s ON w.grp = s.grp AND w.idx = s.idx GROUP BY 1, 2, 3)"""


@query("cusum_grid", f"""
WITH RECURSIVE {EV}, {_grid_cte('500')} SELECT event_type, combo, round(h, 6) AS h, round(k, 6) AS k, round(mu, 6) AS mu0, n_alarms, round(rate, 6) AS alarm_rate FROM grid
""")
def cusum_grid(spark, sf):
    grid = detect.cusum_grid(indexed_events(spark, sf), "event_type", "value", 0.1, 500)
    return rounded(grid.select("event_type", "combo", "h", "k", "mu0", "n_alarms", "alarm_rate"))


@query("cusum_selection", f"""
WITH RECURSIVE {EV}, {_grid_cte('500')}, g2 AS (SELECT *, rate AS r2 FROM grid),
pick AS (SELECT event_type, 'min_baseline_alarms' AS strategy, combo, rate, row_number() OVER (PARTITION BY event_type ORDER BY rate, ord) AS rn FROM grid
 UNION ALL SELECT event_type, 'max_sensitivity', combo, rate, row_number() OVER (PARTITION BY event_type ORDER BY rate DESC, ord) FROM grid
 UNION ALL SELECT g.event_type, 'balanced', g.combo, g.rate, row_number() OVER (PARTITION BY g.event_type ORDER BY g.rate - 0.1::DOUBLE * t.rate, g.ord)
   FROM grid g JOIN grid t ON t.event_type = 'error' AND t.combo = g.combo)
SELECT event_type, strategy, combo, round(rate, 6) AS alarm_rate FROM pick WHERE rn = 1
""")
def cusum_selection(spark, sf):
    """The error series plays the stress test for the balanced strategy."""
    grid = settle(detect.cusum_grid(indexed_events(spark, sf), "event_type", "value", 0.1, 500))
    stress = grid.where("event_type = 'error'").select("combo", "alarm_rate")
    test = grid.select("event_type", "combo").join(stress, "combo")
    out = None
    for strategy in ("min_baseline_alarms", "max_sensitivity", "balanced"):
        best = detect.select_cusum(grid, "event_type", test, strategy).select("event_type", F.lit(strategy).alias("strategy"), "combo", "alarm_rate")
        out = best if out is None else out.unionByName(best)
    return rounded(out)


@query("ewma_control_chart", f"""
WITH RECURSIVE {EV}, c AS (SELECT event_type, idx, 0.2::DOUBLE * value AS e FROM ev WHERE idx = 0 UNION ALL
  SELECT v.event_type, v.idx, 0.2::DOUBLE * v.value + 0.8::DOUBLE * p.e FROM c p JOIN ev v ON v.event_type = p.event_type AND v.idx = p.idx + 1),
s AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sd FROM events GROUP BY 1),
b AS (SELECT ev.event_type, event_id, e, mu, 3 * sd * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - pow(0.8::DOUBLE, 2 * (ev.idx + 1)))) AS band
  FROM c JOIN ev ON ev.event_type = c.event_type AND ev.idx = c.idx JOIN s ON s.event_type = ev.event_type)
SELECT event_type, event_id, round(e, 6) AS ewma, round(mu + band, 6) AS upper, e > mu + band OR e < mu - band AS chart_anom FROM b
""")
def ewma_control_chart(spark, sf):
    return rounded(detect.ewma_chart(indexed_events(spark, sf), "event_type", "value").select(*EVENT_ROW, "ewma", "upper", "chart_anom"))


# ------------------------------------------------------------------ F11, F12, F27-F31


@query("isolation_forest")
def isolation_forest(spark, sf):
    rows = lines(spark, sf)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    model = outliers.IsolationForest(FEATURES, key, 0.01).fit(rows)
    return model.predict(rows).select(*key, "score", "anomaly")


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


@query("local_outlier_factor", """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.id, b.id AS o, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.id <> b.id),
nn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, o) AS rn FROM d QUALIFY rn <= 40),
kd AS (SELECT id, max(d) AS kd FROM nn GROUP BY 1),
lrd AS (SELECT nn.id, 1 / (avg(greatest(nn.d, kd.kd)) + 1e-10) AS lrd FROM nn JOIN kd ON nn.o = kd.id GROUP BY 1),
l AS (SELECT nn.id, avg(o.lrd) / any_value(m.lrd) AS lof FROM nn JOIN lrd o ON nn.o = o.id JOIN lrd m ON nn.id = m.id GROUP BY 1)
SELECT id, round(lof, 6) AS lof, lof > (SELECT quantile_cont(lof, 0.99) FROM l) AS anomaly FROM l
""")
def local_outlier_factor(spark, sf):
    return rounded(outliers.lof_flags(vectors(spark, sf), 40, 0.01))


@query("mahalanobis", f"""
WITH {LI}, s AS (SELECT avg(quantity) AS mq, avg(discount) AS md, var_samp(quantity) + 1e-6 AS a, covar_samp(quantity, discount) AS b, var_samp(discount) + 1e-6 AS c FROM li WHERE domain = 'N'),
d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, domain, sqrt((c * (quantity - mq) ** 2 - 2 * b * (quantity - mq) * (discount - md) + a * (discount - md) ** 2) / (a * c - b * b)) AS score FROM li, s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(score, 6) AS score, round(score, 9) > (SELECT round(quantile_cont(score, 0.95), 9) FROM d WHERE domain = 'N') AS anomaly FROM d
""")
def mahalanobis(spark, sf):
    rows = lines(spark, sf)
    model = outliers.Mahalanobis(["quantity", "discount"]).fit(rows.where("domain = 'N'"))
    return rounded(model.predict(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "score", "anomaly"))


@query("robust_envelope")
def robust_envelope(spark, sf):
    rows = lines(spark, sf)
    model = outliers.RobustEnvelope(FEATURES).fit(rows.where("domain = 'N'"))
    return model.predict(rows).groupBy("domain").agg(F.count_if("anomaly").alias("flagged"), F.count(F.lit(1)).alias("n"))


@query("one_class_boundary")
def one_class_boundary(spark, sf):
    rows = scale.StandardScaler(FEATURES).fit(lines(spark, sf)).transform(lines(spark, sf))
    model = outliers.OneClassBoundary(FEATURES).fit(rows.where("domain = 'N'"))
    return model.predict(rows).groupBy("domain").agg(F.count_if("anomaly").alias("flagged"), F.count(F.lit(1)).alias("n"))


@query("binary_evaluation", f"""
WITH {LI}, c AS (SELECT count(*) FILTER (WHERE price > 60000 AND domain = 'R') AS tp, count(*) FILTER (WHERE price <= 60000 AND domain = 'R') AS fn,
  count(*) FILTER (WHERE price <= 60000 AND domain <> 'R') AS tn, count(*) FILTER (WHERE price > 60000 AND domain <> 'R') AS fp FROM li)
SELECT tp, fn, tn, fp, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(tn / (tn + fp), 6) AS specificity,
  round(fp / (tn + fp), 6) AS fpr, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy FROM c
""")
def binary_evaluation(spark, sf):
    rows = lines(spark, sf).select((F.col("price") > 60000).alias("flagged"), (F.col("domain") == "R").alias("anomalous"))
    return rounded(detect.evaluate_binary(rows, "flagged", "anomalous"))


@query("detector_sweep")
def detector_sweep(spark, sf):
    """Every detector under every adapter; errors stay in their row."""
    rows = lines(spark, sf)
    return flows.sweep(
        rows.where("domain = 'N'"), rows.where("domain = 'R'"), rows.where("domain = 'A'"), FEATURES,
        ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    )


@query("mahalanobis_sweep", f"""
WITH {LI}, z AS (SELECT domain, (quantity - (SELECT avg(quantity) FROM li WHERE domain = 'N')) / (SELECT stddev_pop(quantity) FROM li WHERE domain = 'N') AS q,
  (discount - (SELECT avg(discount) FROM li WHERE domain = 'N')) / (SELECT stddev_pop(discount) FROM li WHERE domain = 'N') AS p FROM li),
s AS (SELECT avg(q) AS mq, avg(p) AS md, var_samp(q) + 1e-6 AS a, covar_samp(q, p) AS b, var_samp(p) + 1e-6 AS c FROM z WHERE domain = 'N'),
d AS (SELECT domain, sqrt((c * (q - mq) ** 2 - 2 * b * (q - mq) * (p - md) + a * (p - md) ** 2) / (a * c - b * b)) AS score FROM z, s),
f AS (SELECT domain, round(score, 9) > (SELECT round(quantile_cont(score, 0.95), 9) FROM d WHERE domain = 'N') AS anomaly FROM d),
c AS (SELECT count(*) FILTER (WHERE anomaly AND domain = 'R') AS tp, count(*) FILTER (WHERE NOT anomaly AND domain = 'R') AS fn,
  count(*) FILTER (WHERE NOT anomaly AND domain = 'A') AS tn, count(*) FILTER (WHERE anomaly AND domain = 'A') AS fp FROM f)
SELECT 'mahalanobis' AS model, 'standard' AS adapter, tp, fn, tn, fp FROM c
""")
def mahalanobis_sweep(spark, sf):
    rows = lines(spark, sf)
    out = flows.sweep(
        rows.where("domain = 'N'"), rows.where("domain = 'R'"), rows.where("domain = 'A'"), ("quantity", "discount"),
        ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), models=("mahalanobis",), adapters=("standard",),
    )
    return out.select("model", "adapter", "tp", "fn", "tn", "fp")


# ------------------------------------------------------------------ F13-F21


def seasonal_residuals(spark, sf):
    """Events against the previous value of their series: a forecast with residuals."""
    rows = indexed_events(spark, sf)
    rows = framed(rows, "event_type", lambda w: {"y_pred": F.lag("value").over(w)}, 1)
    rows = rows.where("y_pred IS NOT NULL").withColumn(IDX, F.col(IDX) - 1)
    return rows.select(F.col("event_type").alias("feature"), IDX, F.col("value").alias("y_true"), "y_pred", (F.col("value") - F.col("y_pred")).alias("residual"))


RES = """rs AS (SELECT event_type, idx - 1 AS idx, y_true, y_pred, y_true - y_pred AS value FROM (
  SELECT event_type, idx, value AS y_true, lag(value) OVER (PARTITION BY event_type ORDER BY idx) AS y_pred FROM ev) WHERE y_pred IS NOT NULL)"""


@query("forecast_residuals", f"WITH {EV}, {RES} SELECT event_type AS feature, idx, round(value, 6) + 0.0 AS residual FROM rs")
def forecast_residuals(spark, sf):
    both = seasonal_residuals(spark, sf)
    return rounded(detect.residuals(both.select("feature", IDX, "y_true"), both.select("feature", IDX, "y_pred"), ["feature", IDX]).select("feature", IDX, "residual"))


@query("residual_detection", f"""
WITH {EV}, {RES}, st AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s, median(value) AS med FROM rs GROUP BY 1),
ma AS (SELECT rs.event_type, median(abs(value - med)) AS mad FROM rs JOIN st ON rs.event_type = st.event_type GROUP BY 1),
z AS (SELECT rs.*, avg(value) OVER w AS rm, stddev_samp(value) OVER w AS rsd, count(*) OVER w AS n FROM rs WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS 99 PRECEDING))
SELECT z.event_type AS feature, idx, coalesce(n = 100 AND abs((value - rm) / rsd) > 3, false) AS z_anom,
  0.6745 * abs(value - med) / mad > 3 AS mad_anom, value < m - 3 * s OR value > m + 3 * s AS sigma_anom
FROM z JOIN st ON st.event_type = z.event_type JOIN ma ON ma.event_type = z.event_type
""")
def residual_detection(spark, sf):
    rows = seasonal_residuals(spark, sf).select("feature", IDX, "residual")
    out = None
    for method, column in (("zscore", "z_anom"), ("mad", "mad_anom"), ("sigma", "sigma_anom")):
        one = flows.detect_residuals(rows, method, threshold=3.0).select("feature", IDX, F.col("anomaly").alias(column))
        out = one if out is None else attach(out, one, ["feature", IDX])
    return out


CONFIG = {"z_window": 100, "trend_window": 200, "baseline_samples": 500}

ANALYSIS = f"""{EV}, {_ewma_cte(0.01)}, {MAD_CTE}, {PEAK_CTE}, {TREND_CTE},
zw AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s, count(value) OVER w AS n FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY idx ROWS 99 PRECEDING)),
bl AS (SELECT event_type, avg(ewma) AS mu, 4 * stddev_samp(ewma) AS h, 0.5 * stddev_samp(ewma) AS k, stddev_samp(ewma) AS sg FROM ew WHERE idx < 500 GROUP BY 1),
src AS (SELECT ew.*, mu, h, k FROM ew JOIN bl ON ew.event_type = bl.event_type), {_cusum_cte('src', 'ewma', 'mu', 'h', 'k', 'event_type', 'walk')},
flags AS (SELECT zw.event_type, zw.event_id, zw.idx, coalesce(n = 100 AND abs((value - m) / s) > 3, false) AS z_anom,
  coalesce(mad > 0 AND 0.6745 * abs(value - med) / mad > 3.5, false) AS mad_anom,
  EXISTS (SELECT 1 FROM prom p WHERE p.event_type = zw.event_type AND p.idx = zw.idx AND p.prominence >= p.pmin) AS peak,
  coalesce(slope > up OR slope < dn, false) AS trend_anom, pos > bl.h OR neg > bl.h AS cusum_alarm
  FROM zw JOIN md ON md.event_type = zw.event_type JOIN sl ON sl.event_type = zw.event_type AND sl.idx = zw.idx JOIN lim2 l ON l.event_type = zw.event_type
  JOIN walk w ON w.event_type = zw.event_type AND w.idx = zw.idx JOIN bl ON bl.event_type = zw.event_type),
al AS (SELECT *, z_anom OR mad_anom OR peak OR trend_anom OR cusum_alarm AS any_anom FROM flags)"""


def analysed(spark, sf):
    return detect.analyze(indexed_events(spark, sf), "event_type", "value", **CONFIG)


@query("signal_analysis", f"WITH RECURSIVE {ANALYSIS} SELECT event_type, event_id, z_anom, mad_anom, peak, trend_anom, cusum_alarm, any_anom FROM al")
def signal_analysis(spark, sf):
    return analysed(spark, sf).select(*EVENT_ROW, *detect.FLAGS, "any_anom")


@query("anomaly_summary", f"""
WITH RECURSIVE {ANALYSIS} {' UNION ALL '.join(f"SELECT event_type, '{c}' AS detector, count(*) FILTER (WHERE {c}) AS n_anomalies, round(count(*) FILTER (WHERE {c}) / count(*) * 100, 6) AS pct FROM al GROUP BY 1" for c in (*detect.FLAGS, 'any_anom'))}
""")
def anomaly_summary(spark, sf):
    return rounded(detect.summary(analysed(spark, sf), "event_type"))


@query("learned_point_thresholds", f"""
WITH RECURSIVE {ANALYSIS} SELECT bl.event_type, round(up, 6) AS slope_upper, round(dn, 6) AS slope_lower, round(hmin, 6) AS height_threshold,
  round(lim.pmin, 6) AS prominence_threshold, round(med, 6) AS median, round(mad, 6) AS mad, round(mu, 6) AS mu0, round(sg, 6) AS sigma0, round(h, 6) AS h, round(k, 6) AS k
FROM bl JOIN lim2 ON lim2.event_type = bl.event_type JOIN lim ON lim.event_type = bl.event_type JOIN md ON md.event_type = bl.event_type
""")
def learned_point_thresholds(spark, sf):
    return rounded(detect.point_thresholds(indexed_events(spark, sf), "event_type", "value", **CONFIG).drop("z_k", "mad_k"))


@query("applied_point_thresholds", f"""
WITH RECURSIVE {ANALYSIS} SELECT event_type, event_id, z_anom, mad_anom, peak, trend_anom, cusum_alarm, any_anom FROM al
""")
def applied_point_thresholds(spark, sf):
    """Thresholds learned on the data and applied to it again give the same flags."""
    rows = indexed_events(spark, sf)
    learned = detect.point_thresholds(rows, "event_type", "value", **CONFIG)
    return thresholds.apply_point(rows, learned, "event_type", "value", **CONFIG).select(*EVENT_ROW, *detect.FLAGS, "any_anom")


def hourly_flags(spark, sf):
    """Hours outside mean ± 1.5 deviations per event type, 0/1."""
    wide = indexed_hourly(spark, sf)
    long = wide.unpivot(["hour", IDX], list(EVENT_TYPES), "event_type", "value").where("value IS NOT NULL")
    flagged = detect.sigma_flags(long, "event_type", "value", 1.5)
    picks = flagged.groupBy("hour").pivot("event_type", list(EVENT_TYPES)).agg(F.max(F.col("sigma_anom").cast("int")))
    return attach(wide, picks.select("hour", *[F.coalesce(F.col(e), F.lit(0)).alias(f"{e}_any_anom") for e in EVENT_TYPES]), "hour")


HF = f"""{HR}, hf AS (SELECT hour, idx, purchase, {', '.join(f'coalesce(CAST({e} < avg({e}) OVER () - 1.5 * stddev_pop({e}) OVER () OR {e} > avg({e}) OVER () + 1.5 * stddev_pop({e}) OVER () AS INTEGER), 0) AS {e}_any_anom' for e in EVENT_TYPES)} FROM hr)"""


@query("health_index", f"""
WITH {HF}, s AS (SELECT hour, {' + '.join(f'{e}_any_anom' for e in EVENT_TYPES)} AS sc FROM hf)
SELECT hour, CAST(sc AS INTEGER) AS health_score, CAST(CASE WHEN sc >= 2 THEN 2 WHEN sc >= 1 THEN 1 ELSE 0 END AS INTEGER) AS health_level,
  CASE WHEN sc >= 2 THEN 'Danger' WHEN sc >= 1 THEN 'Warning' ELSE 'OK' END AS health_label FROM s
""")
def health_index(spark, sf):
    rows = detect.health_index(hourly_flags(spark, sf), [f"{e}_any_anom" for e in EVENT_TYPES], 1, 2)
    return rows.select("hour", "health_score", "health_level", "health_label")


def coloured(spark, sf):
    """Hourly flags with the purchase column as current; CUSUM warning stands for the view flag."""
    rows = hourly_flags(spark, sf)
    cut = quantiles(rows, None, "purchase", [0.05]).first()["q"][0]
    return rows.withColumn("cut", F.lit(cut))


@query("startup_classes", f"""
WITH {HF} SELECT hour, CASE WHEN purchase < (SELECT quantile_cont(purchase, 0.05) FROM hr) THEN 'yellow' ELSE 'red' END AS startup,
  CASE WHEN view_any_anom = 1 THEN 'orange' WHEN purchase < (SELECT quantile_cont(purchase, 0.05) FROM hr) THEN 'yellow' ELSE 'red' END AS colour FROM hf
""")
def startup_classes(spark, sf):
    return coloured(spark, sf).select(
        "hour", detect.startup_class(F.col("purchase"), F.col("cut")).alias("startup"),
        detect.colour_class(F.col("view_any_anom"), F.col("purchase"), F.col("cut")).alias("colour"))


@query("colour_counts", f"""
WITH {HF}, c AS (SELECT *, CASE WHEN view_any_anom = 1 THEN 'cusum' WHEN purchase < (SELECT quantile_cont(purchase, 0.05) FROM hr) THEN 'startup' ELSE 'other' END AS colour FROM hf)
{' UNION ALL '.join(f"SELECT '{e}' AS feature, count(*) FILTER (WHERE {e}_any_anom = 1 AND colour = 'startup') AS startup, count(*) FILTER (WHERE {e}_any_anom = 1 AND colour = 'cusum') AS cusum, count(*) FILTER (WHERE {e}_any_anom = 1 AND colour = 'other') AS other FROM c" for e in EVENT_TYPES)}
""")
def colour_counts(spark, sf):
    rows = coloured(spark, sf)
    flags = F.explode(F.array(*[F.struct(F.lit(e).alias("feature"), F.col(f"{e}_any_anom").alias("flag")) for e in EVENT_TYPES]))
    long = rows.select(flags.alias("f"), "purchase", "cut", "view_any_anom").select("f.*", "purchase", "cut", "view_any_anom")
    return flows.colour_counts(long, "feature", F.col("flag") == 1, F.col("view_any_anom") == 1, F.col("purchase"), F.col("cut"))


# ------------------------------------------------------------------ F22-F26

# The calibration grid runs over residuals: same recursion with the residual rows as source.
CAL = f"""{EV}, {RES},
e0 AS (SELECT event_type, idx, value AS num, 1.0::DOUBLE AS den FROM rs WHERE idx = 0 UNION ALL
  SELECT v.event_type, v.idx, v.value + 0.9::DOUBLE * p.num, 1.0 + 0.9::DOUBLE * p.den FROM e0 p JOIN rs v ON v.event_type = p.event_type AND v.idx = p.idx + 1),
ew AS (SELECT event_type, idx, num / den AS ewma FROM e0),
bl AS (SELECT event_type, avg(ewma) AS mu, stddev_samp(ewma) AS sg FROM ew GROUP BY 1),
src AS (SELECT ew.event_type || '|' || combo AS grp, ew.event_type, combo, ord, idx, ewma, mu, sg, hf * sg AS h, kf * sg AS k FROM ew JOIN bl ON ew.event_type = bl.event_type, {COMBOS}),
{_cusum_cte('src', 'ewma', 'mu', 'h', 'k', 'grp', 'walk')},
grid AS (SELECT s.event_type, s.combo, s.ord, any_value(mu) AS mu, any_value(h) AS h, any_value(k) AS k, count(*) FILTER (WHERE pos > h OR neg > h) AS n_alarms,
  count(*) FILTER (WHERE pos > h OR neg > h) / count(*) AS rate FROM walk w JOIN src s ON w.grp = s.grp AND w.idx = s.idx GROUP BY 1, 2, 3),
best AS (SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY rate, ord) = 1),
st AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
  quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.99) AS p99 FROM rs GROUP BY 1),
ma AS (SELECT rs.event_type, median(abs(value - med)) AS mad FROM rs JOIN st ON rs.event_type = st.event_type GROUP BY 1),
th AS (SELECT st.event_type, mean, std, med, mad, iqr, p1, p99, mean - 2 * std AS wl, mean + 2 * std AS wu, mean - 3 * std AS dl, mean + 3 * std AS du, combo, mu, h, k
  FROM st JOIN ma ON ma.event_type = st.event_type JOIN best b ON b.event_type = st.event_type)"""


@query("calibrated_thresholds", f"""
WITH RECURSIVE {CAL} SELECT event_type AS feature, round(mean, 6) + 0.0 AS mean, round(std, 6) AS std, round(med, 6) + 0.0 AS median, round(mad, 6) AS mad, round(iqr, 6) AS iqr,
  round(p1, 6) AS p1, round(p99, 6) AS p99, round(wl, 6) AS warning_lower, round(du, 6) AS danger_upper, combo AS best_combo, round(mu, 6) + 0.0 AS mu0, round(h, 6) AS h, round(k, 6) AS k FROM th
""")
def calibrated_thresholds(spark, sf):
    out = thresholds.calibrate(settle(seasonal_residuals(spark, sf).select("feature", IDX, "residual")))
    return rounded(out.select("feature", "mean", "std", "median", "mad", "iqr", "p1", "p99", "warning_lower", "danger_upper", "best_combo", "mu0", "h", "k"))


# Calibrate on clicks, then validate on and apply to every series with the click thresholds.
APP = f"""{CAL}, tc AS (SELECT * FROM th WHERE event_type = 'click'),
s2 AS (SELECT rs.event_type, rs.idx, rs.value, tc.mu, tc.h, tc.k, wl, wu, dl, du, combo FROM rs, tc),
{_cusum_cte('s2', 'value', 'mu', 'h', 'k', 'event_type', 'wk')},
ap AS (SELECT s.event_type, s.idx, value < wl OR value > wu AS sw, value < dl OR value > du AS sd, pos > 0.75 * h OR neg > 0.75 * h AS cw, pos > h OR neg > h AS cd, pos, neg, combo
  FROM s2 s JOIN wk ON wk.event_type = s.event_type AND wk.idx = s.idx)"""


def click_thresholds(spark, sf):
    rows = settle(seasonal_residuals(spark, sf).select("feature", IDX, "residual"))
    learned = settle(thresholds.calibrate(rows.where("feature = 'click'")))
    names = F.explode(F.array(*[F.lit(e) for e in EVENT_TYPES])).alias("feature")
    return rows, learned.drop("feature").select(names, "*")


@query("validated_thresholds", f"""
WITH RECURSIVE {APP} SELECT event_type AS feature, count(*) AS n_samples, count(*) FILTER (WHERE sw) AS sigma_warning_count, count(*) FILTER (WHERE sd) AS sigma_danger_count,
  count(*) FILTER (WHERE cw) AS cusum_warning_count, count(*) FILTER (WHERE cd) AS cusum_danger_count, round(count(*) FILTER (WHERE sw) / count(*) * 100, 4) AS sigma_warning_pct,
  round(count(*) FILTER (WHERE sd) / count(*) * 100, 4) AS sigma_danger_pct, round(count(*) FILTER (WHERE cw) / count(*) * 100, 4) AS cusum_warning_pct,
  round(count(*) FILTER (WHERE cd) / count(*) * 100, 4) AS cusum_danger_pct, any_value(combo) AS cusum_best_combo, 1.0::DOUBLE AS weight FROM ap GROUP BY 1
""")
def validated_thresholds(spark, sf):
    return thresholds.validate_thresholds(*click_thresholds(spark, sf))


@query("applied_thresholds", f"""
WITH RECURSIVE {APP} SELECT event_type AS feature, idx, sw AS sigma_warning, sd AS sigma_danger, cw AS cusum_warning, cd AS cusum_danger, round(pos, 5) AS cusum_pos, round(neg, 5) AS cusum_neg FROM ap
""")
def applied_thresholds(spark, sf):
    out = thresholds.apply_residual(*click_thresholds(spark, sf))
    return rounded(out.select("feature", IDX, *thresholds.FLAGS, "cusum_pos", "cusum_neg"), 5)


@query("alarm_totals", f"""
WITH RECURSIVE {APP}, r AS (SELECT idx, bool_or(sw OR cw) AS w, bool_or(sd OR cd) AS d FROM ap GROUP BY 1)
SELECT count(*) AS total_samples, count(*) FILTER (WHERE w) AS warning_samples, count(*) FILTER (WHERE d) AS danger_samples,
  round(count(*) FILTER (WHERE w) / count(*) * 100, 4) AS warning_pct, round(count(*) FILTER (WHERE d) / count(*) * 100, 4) AS danger_pct FROM r
""")
def alarm_totals(spark, sf):
    return thresholds.apply_summary(thresholds.row_flags(thresholds.apply_residual(*click_thresholds(spark, sf))))


@query("annotated_table", f"""
WITH RECURSIVE {APP}, o AS (SELECT event_id, idx FROM ev WHERE event_type = (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
sh AS (SELECT (SELECT max(idx) FROM o) - (SELECT max(idx) FROM ap) AS shift),
w AS (SELECT idx, {', '.join(f"max(CAST(sw OR cw AS INTEGER)) FILTER (WHERE event_type = '{e}') AS {e}_warning, max(CAST(sd OR cd AS INTEGER)) FILTER (WHERE event_type = '{e}') AS {e}_danger" for e in EVENT_TYPES)} FROM ap GROUP BY 1)
SELECT event_id, w.*, CASE WHEN greatest({', '.join(f'coalesce({e}_danger, 0)' for e in EVENT_TYPES)}) = 1 THEN 'RED'
  WHEN greatest({', '.join(f'coalesce({e}_warning, 0)' for e in EVENT_TYPES)}) = 1 THEN 'YELLOW' ELSE 'GREEN' END AS health_status
FROM w, sh JOIN o ON o.idx - shift = w.idx
""")
def annotated_table(spark, sf):
    """The longest series' rows with every feature's flags; results belong to its last rows."""
    rows = indexed_events(spark, sf)
    longest = rows.groupBy("event_type").count().orderBy(F.desc("count"), "event_type").first()[0]
    flagged = thresholds.apply_residual(*click_thresholds(spark, sf))
    out = thresholds.annotate(rows.where(F.col("event_type") == longest).select("event_id", IDX), flagged, EVENT_TYPES)
    return out.select("event_id", IDX, *[f"{e}_{c}" for e in EVENT_TYPES for c in ("warning", "danger")], "health_status")


@query("combined_thresholds", f"""
WITH {EV}, {RES}, n AS (SELECT event_type, count(*) AS n FROM rs GROUP BY 1),
h AS (SELECT rs.event_type, value, idx < n // 2 AS early FROM rs JOIN n ON rs.event_type = n.event_type),
a AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std FROM h WHERE early GROUP BY 1),
b AS (SELECT event_type, avg(value) AS mean, stddev_pop(value) AS std, avg(value) + 2 * stddev_pop(value) AS wu FROM h WHERE NOT early GROUP BY 1)
SELECT coalesce(a.event_type, b.event_type) AS feature, round((coalesce(1.4::DOUBLE * a.mean, 0) + coalesce(0.6::DOUBLE * b.mean, 0))
    / (CASE WHEN a.mean IS NULL THEN 0 ELSE 1.4::DOUBLE END + CASE WHEN b.mean IS NULL THEN 0 ELSE 0.6::DOUBLE END), 4) + 0.0 AS mean,
  round((coalesce(1.4::DOUBLE * a.std, 0) + coalesce(0.6::DOUBLE * b.std, 0))
    / (CASE WHEN a.std IS NULL THEN 0 ELSE 1.4::DOUBLE END + CASE WHEN b.std IS NULL THEN 0 ELSE 0.6::DOUBLE END), 4) AS std, round(wu, 4) AS warning_upper
FROM a FULL JOIN b ON a.event_type = b.event_type
""")
def combined_thresholds(spark, sf):
    """Limits of the first half of every series, combined with those of the second."""
    rows = with_total(seasonal_residuals(spark, sf), "feature", "_n")
    early = F.col(IDX) < F.floor(F.col("_n") / 2)
    stats = [F.avg("residual").alias("mean"), F.stddev_pop("residual").alias("std")]
    a = rows.where(early).groupBy("feature").agg(*stats)
    b = rows.where(~early).groupBy("feature").agg(*stats, (F.avg("residual") + 2 * F.stddev_pop("residual")).alias("warning_upper"))
    out = thresholds.combine_weighted([(a, 1.4), (b, 0.6)])
    return rounded(out.select("feature", "mean", "std", "warning_upper"), 4)
