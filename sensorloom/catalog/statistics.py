"""Descriptive statistics, tests and similarity (inventory E)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from sensorloom.catalog.base import DAY, EV, EVENT_TYPES, FEATURES, HR, LI, daily, events, indexed_events, indexed_hourly, indexed_lines, lines, query, rounded
from sensorloom.kernels import IDX
from sensorloom.operators import stats


@query("described_series", """
SELECT event_type, count(value) AS n, count(*) - count(value) AS missing, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max,
  round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75,
  round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis FROM events GROUP BY 1
""")
def described_series(spark, sf):
    return rounded(stats.describe(events(spark, sf), "event_type", "value"))


@query("iqr_outliers", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT e.event_type, round(any_value(a - 1.5 * (b - a)), 6) AS lower, round(any_value(b + 1.5 * (b - a)), 6) AS upper,
  count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers,
  round(count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*) * 100, 6) AS pct FROM events e JOIN q ON q.event_type = e.event_type GROUP BY 1
""")
def iqr_outliers(spark, sf):
    return rounded(stats.iqr_outliers(events(spark, sf), "event_type", "value"))


@query("correlations", f"""
WITH {LI} {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM li" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:])}
""")
def correlations(spark, sf):
    return rounded(stats.correlations(lines(spark, sf), FEATURES))


@query("strong_correlations", f"WITH {LI} SELECT 'price' AS a, 'charge' AS b, round(corr(price, price * (1 - discount)), 6) AS r FROM li")
def strong_correlations(spark, sf):
    rows = lines(spark, sf).withColumn("charge", F.col("price") * (1 - F.col("discount")))
    return rounded(stats.correlations(rows, ["quantity", "price", "charge", "tax"], 0.7))


PAIRS = [(a, b) for a in FEATURES for b in FEATURES]

SIM = f"""{LI}, k AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM li WHERE domain IN ('N', 'A') GROUP BY domain)),
zz AS (SELECT domain, idx, {', '.join(f'({c} - avg({c}) OVER d) / stddev_pop({c}) OVER d AS {c}' for c in FEATURES)}
  FROM li WHERE domain IN ('N', 'A') WINDOW d AS (PARTITION BY domain)),
z AS (SELECT zz.* FROM zz, k WHERE idx < n),
r AS (SELECT domain, idx, {', '.join(f'rank() OVER (PARTITION BY domain ORDER BY {c}) + (count(*) OVER (PARTITION BY domain, {c}) - 1) / 2.0 AS {c}' for c in FEATURES)} FROM z),
l AS ({' UNION ALL '.join(f"SELECT domain, '{c}' AS f, idx, {c} AS z FROM z" for c in FEATURES)}),
lr AS ({' UNION ALL '.join(f"SELECT domain, '{c}' AS f, idx, {c} AS z FROM r" for c in FEATURES)}),
pe AS (SELECT a.f AS lab_feature, b.f AS field_feature, abs(corr(a.z, b.z)) AS pearson_corr FROM l a JOIN l b ON a.idx = b.idx AND a.domain = 'N' AND b.domain = 'A' GROUP BY 1, 2),
sp AS (SELECT a.f AS lab_feature, b.f AS field_feature, abs(corr(a.z, b.z)) AS spearman_corr FROM lr a JOIN lr b ON a.idx = b.idx AND a.domain = 'N' AND b.domain = 'A' GROUP BY 1, 2),
pr AS (SELECT a.f AS lab_feature, b.f AS field_feature FROM (SELECT DISTINCT f FROM l) a, (SELECT DISTINCT f FROM l) b),
un AS (SELECT lab_feature, field_feature, z, 1 AS a, 0 AS b FROM pr JOIN l ON l.domain = 'N' AND l.f = lab_feature UNION ALL
  SELECT lab_feature, field_feature, z, 0, 1 FROM pr JOIN l ON l.domain = 'A' AND l.f = field_feature),
cu AS (SELECT lab_feature, field_feature, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb FROM un
  WINDOW w AS (PARTITION BY lab_feature, field_feature ORDER BY z RANGE UNBOUNDED PRECEDING), p AS (PARTITION BY lab_feature, field_feature)),
ks AS (SELECT lab_feature, field_feature, max(abs(fa - fb)) AS ks_statistic FROM cu GROUP BY 1, 2),
hb AS (SELECT domain, f, least(floor(round((z - lo) / ((hi - lo) / 50), 9)), 49) AS bin, count(*) AS c FROM (SELECT *, min(z) OVER (PARTITION BY domain, f) AS lo, max(z) OVER (PARTITION BY domain, f) AS hi FROM l) GROUP BY 1, 2, 3),
nm AS (SELECT domain, f, sqrt(sum(c * c)) AS s FROM hb GROUP BY 1, 2),
hc AS (SELECT pr.*, coalesce((SELECT sum(x.c * y.c) FROM hb x JOIN hb y ON x.bin = y.bin AND x.domain = 'N' AND y.domain = 'A' AND x.f = lab_feature AND y.f = field_feature), 0) /
  ((SELECT s FROM nm WHERE domain = 'N' AND f = lab_feature) * (SELECT s FROM nm WHERE domain = 'A' AND f = field_feature)) AS histogram_cosine FROM pr),
m0 AS (SELECT domain, f, avg(z) AS m FROM l GROUP BY 1, 2),
mo AS (SELECT l.domain, l.f, any_value(m) AS m, stddev_pop(z) AS s, avg((z - m) ** 3) / pow(var_pop(z), 1.5) AS k3, avg((z - m) ** 4) / pow(var_pop(z), 2) - 3 AS k4 FROM l JOIN m0 ON m0.domain = l.domain AND m0.f = l.f GROUP BY 1, 2),
ms AS (SELECT lab_feature, field_feature, 1 / (1 + abs(a.m - b.m) + abs(a.s - b.s) + abs(a.k3 - b.k3) / 10 + abs(a.k4 - b.k4) / 100) AS moments_similarity
  FROM pr JOIN mo a ON a.domain = 'N' AND a.f = lab_feature JOIN mo b ON b.domain = 'A' AND b.f = field_feature),
sc AS (SELECT *, 0.3 * pearson_corr + 0.2 * spearman_corr + 0.2 * (1 - ks_statistic) + 0.15 * histogram_cosine + 0.15 * moments_similarity AS overall_score
  FROM pe JOIN sp USING (lab_feature, field_feature) JOIN ks USING (lab_feature, field_feature) JOIN hc USING (lab_feature, field_feature) JOIN ms USING (lab_feature, field_feature))"""


def _similarity(spark, sf):
    rows = indexed_lines(spark, sf)
    return stats.similarity(rows.where("domain = 'N'"), rows.where("domain = 'A'"), PAIRS)


@query("signal_similarity", f"""
WITH {SIM} SELECT lab_feature, field_feature, round(pearson_corr, 6) AS pearson_corr, round(spearman_corr, 6) AS spearman_corr, round(ks_statistic, 6) AS ks_statistic,
  round(histogram_cosine, 6) AS histogram_cosine, round(moments_similarity, 6) AS moments_similarity, round(overall_score, 6) AS overall_score FROM sc
""")
def signal_similarity(spark, sf):
    return rounded(_similarity(spark, sf).drop("pearson_p", "ks_similarity"))


@query("best_mapping", f"""
WITH {SIM}, o AS (SELECT *, row_number() OVER (ORDER BY overall_score DESC, lab_feature, field_feature) AS rn FROM sc),
p AS (SELECT * FROM o WHERE rn = 1), s AS (SELECT * FROM o WHERE field_feature <> (SELECT field_feature FROM p) ORDER BY rn LIMIT 1)
SELECT 'primary' AS role, lab_feature, field_feature, round(overall_score, 6) AS overall_score FROM p UNION ALL SELECT 'secondary', lab_feature, field_feature, round(overall_score, 6) FROM s
""")
def best_mapping(spark, sf):
    return rounded(stats.best_mapping(_similarity(spark, sf)))


@query("normality_test")
def normality_test(spark, sf):
    return stats.ks_normal(indexed_events(spark, sf), "event_type", "value")


@query("autocorrelation", f"""
WITH {EV}, c AS (SELECT event_type, idx, value - avg(value) OVER (PARTITION BY event_type) AS x FROM ev),
g AS (SELECT event_type, sum(x * x) AS v, count(*) AS n FROM c GROUP BY 1),
p AS (SELECT a.event_type, b.idx - a.idx AS lag, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.event_type = b.event_type AND b.idx >= a.idx AND b.idx <= a.idx + 50 GROUP BY 1, 2)
SELECT p.event_type, CAST(lag AS INTEGER) AS lag, round(s / v, 6) + 0.0 AS acf, round(1.96 / sqrt(n), 6) AS conf, abs(s / v) > 1.96 / sqrt(n) AS significant FROM p JOIN g ON g.event_type = p.event_type
""")
def autocorrelation(spark, sf):
    return rounded(stats.acf(indexed_events(spark, sf), "event_type", "value"))


_STANDARD = ", ".join(f"coalesce(({e} - avg({e}) OVER ()) / nullif(stddev_pop({e}) OVER (), 0), 0) AS {e}" for e in EVENT_TYPES)
_STANDARD_LONG = " UNION ALL ".join(f"SELECT idx, '{e}' AS name, {e} AS z FROM sd" for e in EVENT_TYPES)


@query("lagged_cross_correlation", f"""
WITH {HR}, sd AS (SELECT idx, {_STANDARD} FROM hr), lo AS ({_STANDARD_LONG}), nr AS (SELECT count(*) AS n FROM hr)
SELECT a.name AS first, b.name AS second, CAST(b.idx - a.idx AS INTEGER) AS lag, round(sum(a.z * b.z) / any_value(n), 6) + 0.0 AS r
FROM lo a JOIN lo b ON b.idx >= a.idx AND b.idx <= a.idx + 48, nr GROUP BY 1, 2, 3
""")
def lagged_cross_correlation(spark, sf):
    return rounded(stats.lagged_correlations(indexed_hourly(spark, sf), None, EVENT_TYPES, 48))


@query("partial_autocorrelation", f"""
WITH RECURSIVE {EV}, c AS (SELECT event_type, idx, value - avg(value) OVER (PARTITION BY event_type) AS x FROM ev),
g AS (SELECT event_type, sum(x * x) AS v, count(*) AS n FROM c GROUP BY 1),
p AS (SELECT a.event_type, b.idx - a.idx AS lag, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.event_type = b.event_type AND b.idx > a.idx AND b.idx <= a.idx + 50 GROUP BY 1, 2),
r AS (SELECT p.event_type, any_value(n) AS n, list(s / v ORDER BY lag) AS r FROM p JOIN g ON g.event_type = p.event_type GROUP BY 1),
d AS (SELECT event_type, n, r, 1 AS k, [r[1]] AS phi, 1 - r[1] * r[1] AS err, r[1] AS a FROM r
 UNION ALL SELECT event_type, n, r, k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - b * phi[k + 1 - j]), b), err * (1 - b * b), b
 FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / err AS b FROM d WHERE k < len(r)))
SELECT event_type, k AS lag, round(a, 6) + 0.0 AS pacf, round(1.96 / sqrt(n), 6) AS conf, abs(a) > 1.96 / sqrt(n) AS significant FROM d
UNION ALL SELECT event_type, 0, 1.0, round(1.96 / sqrt(n), 6), 1.0 > 1.96 / sqrt(n) FROM r
""")
def partial_autocorrelation(spark, sf):
    return rounded(stats.pacf(indexed_events(spark, sf), "event_type", "value", 50))


@query("unit_root_test")
def unit_root_test(spark, sf):
    return stats.adf(daily(spark, sf).withColumn("series", F.lit("orders")), "series", "total")


@query("kpss_statistic", f"""
WITH {DAY}, e AS (SELECT idx, total - avg(total) OVER () AS e FROM dy), s AS (SELECT idx, e, sum(e) OVER (ORDER BY idx) AS s FROM e),
a AS (SELECT sum(s * s) / pow(count(*), 2) AS eta, sum(e * e) / count(*) AS v, count(*) AS n FROM s),
g AS (SELECT sum(x.e * y.e * (1 - (y.idx - x.idx) / 11.0)) AS c FROM e x JOIN e y ON y.idx > x.idx AND y.idx <= x.idx + 10)
SELECT n, 10 AS lags, round(eta / (v + 2 * c / n), 6) AS statistic FROM a, g
""")
def kpss_statistic(spark, sf):
    return rounded(stats.kpss(daily(spark, sf), None, "total", 10).select("n", "lags", "statistic"))


@query("stationarity_labels")
def stationarity_labels(spark, sf):
    rows = indexed_events(spark, sf)
    return stats.stationarity(stats.adf(rows, "event_type", "value"), stats.kpss(rows, "event_type", "value"), "event_type")


@query("seasonal_decomposition", f"""
WITH {DAY}, t AS (SELECT idx, idx % 7 AS phase, total, CASE WHEN count(*) OVER w = 7 THEN avg(total) OVER w END AS trend FROM dy WINDOW w AS (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
p AS (SELECT phase, avg(total - trend) AS p FROM t GROUP BY 1), s AS (SELECT phase, p - (SELECT avg(p) FROM p) AS seasonal FROM p)
SELECT idx, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(total - trend - seasonal, 4) AS residual FROM t JOIN s USING (phase)
""")
def seasonal_decomposition(spark, sf):
    return rounded(stats.decompose(daily(spark, sf), None, "total", 7).select(IDX, "trend", "seasonal", "residual"), 4)


@query("histogram", f"""
WITH {LI}, s AS (SELECT domain, price, min(price) OVER (PARTITION BY domain) AS lo, max(price) OVER (PARTITION BY domain) AS hi, count(*) OVER (PARTITION BY domain) AS n FROM li)
SELECT domain, CAST(least(floor((price - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n, round(count(*) / any_value(n * ((hi - lo) / 50)) * 1000000, 6) AS density FROM s GROUP BY 1, 2
""")
def histogram(spark, sf):
    out = stats.histogram(lines(spark, sf), "domain", "price")
    return rounded(out.withColumn("density", F.col("density") * 1000000))


@query("quantile_pairs", f"""
WITH {LI}, p AS (SELECT unnest([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS p)
SELECT CAST(p AS DOUBLE) AS p, {', '.join(f"round(list_extract((SELECT quantile_cont({f}, [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) FROM li), list_position([0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99], p)), 4) AS {f}" for f in ('quantity', 'price'))} FROM p
""")
def quantile_pairs(spark, sf):
    return rounded(stats.qq_pair(lines(spark, sf), ["quantity", "price"], [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]), 4)


PERCENTS = [i / 100 for i in range(1, 100)]


@query("normal_quantile_points", f"""
SELECT event_type, unnest([{', '.join(f'{p}::DOUBLE' for p in PERCENTS)}]) AS p, round(unnest([{', '.join(f'{NormalDist().inv_cdf(p)!r}::DOUBLE' for p in PERCENTS)}]), 6) + 0.0 AS normal,
  round(unnest(quantile_cont(value, [{', '.join(map(str, PERCENTS))}])), 6) AS sample FROM events GROUP BY event_type
""")
def normal_quantile_points(spark, sf):
    return rounded(stats.qq_points(events(spark, sf), "event_type", "value", PERCENTS))


@query("exploration")
def exploration(spark, sf):
    return stats.explore(indexed_events(spark, sf), "event_type", "value", 10, 30, 50)
