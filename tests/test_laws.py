"""Laws, edge cases and models checked on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.normal import inverse_normal, normal_cdf, pearson_p
from sensorloom.kernels import order_index
from sensorloom.operators import align, detect, forecast, metrics, neighbours, outliers, quant, scale, split, stats, thresholds, windows
from sensorloom.plans import flows


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_normal_functions():
    p = np.array([1e-7, 0.01, 0.3, 0.5, 0.9, 0.999999])
    assert np.allclose(normal_cdf(inverse_normal(p)), p, rtol=1e-9)
    assert pearson_p(0.5, 20) == pytest.approx(0.02475, abs=1e-4)


def test_injected_anomaly_is_found(spark):
    rng = np.random.default_rng(42)
    n = 10_000
    x = np.sin(np.linspace(0, 20 * np.pi, n)) + 0.1 * rng.normal(size=n)
    x[5000:5010] = 5
    df = frame(spark, s="x", idx=np.arange(n), v=x)
    out = detect.analyze(df, "s", "v", z_window=100, trend_window=500, baseline_samples=1000)
    got = out.where("idx BETWEEN 5000 AND 5009").agg(F.count_if("any_anom").alias("k"), F.count_if("z_anom").alias("z")).first()
    assert got["k"] == 10 and got["z"] > 0


def test_constant_single_and_empty_series(spark):
    df = frame(spark, s=["c"] * 5 + ["one"], idx=[0, 1, 2, 3, 4, 0], v=[2.0] * 5 + [1.0])
    out = detect.analyze(df, "s", "v", z_window=3, trend_window=3, baseline_samples=3).toPandas()
    assert len(out) == 6 and not out[["z_anom", "mad_anom", "peak", "trend_anom"]].any().any()
    none = detect.analyze(df.where("false"), "s", "v", z_window=3, trend_window=3, baseline_samples=3)
    assert none.count() == 0
    assert stats.describe(df, "s", "v").where("s = 'one'").first()["std"] is None


def test_peaks_on_plateaus_and_chunks(spark):
    v = [0, 3, 3, 3, 0, 1, 0, 5, 4, 6, 0, 2, 2, 1, 7]
    df = frame(spark, s="x", idx=np.arange(len(v)), v=np.array(v, dtype=float))
    for chunk in (3, 100):
        tops = {r["idx"]: r["height"] for r in detect.local_maxima(df, "s", "v", chunk).collect()}
        assert tops == {2: 3, 5: 1, 7: 5, 9: 6, 11: 2}
        limits = frame(spark, s=["x"], height_threshold=[0.0], prominence_threshold=[0.0])
        prom = {r["idx"]: r["prominence"] for r in detect.peaks_above(df, "s", "v", limits, chunk).collect()}
        assert prom == {2: 3, 5: 1, 7: 1, 9: 6, 11: 1}


@pytest.mark.parametrize("chunk", [2, 3, 4, 5, 100])
def test_peaks_with_nulls_at_chunk_borders(spark, chunk):
    values = [1.0, 2.0, 1.0, None, 5.0, 1.0, 3.0, 1.0, None, None, 4.0, None, 2.0]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(values)], "s string, idx long, v double")
    assert {r["idx"] for r in detect.local_maxima(df, "s", "v", chunk).collect()} == {1, 4, 6, 10}
    limits = frame(spark, s=["x"], height_threshold=[0.0], prominence_threshold=[0.0])
    prom = {r["idx"]: r["prominence"] for r in detect.peaks_above(df, "s", "v", limits, chunk).collect()}
    assert prom == {1: 1, 4: 4, 6: 2, 10: 2}


def test_scalers_round_trip(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, id=np.arange(200), a=rng.normal(5, 2, 200), b=rng.exponential(3, 200), c=np.ones(200))
    want = df.toPandas()
    for kind in (scale.StandardScaler, scale.RobustScaler, scale.MinMaxScaler):
        model = kind(["a", "b", "c"]).fit(df)
        back = model.inverse(model.transform(df)).toPandas().sort_values("id")
        assert np.allclose(back[["a", "b", "c"]], want[["a", "b", "c"]])
    z = scale.QuantileNormal(["a", "b"]).fit(df).transform(df).toPandas()
    assert abs(z["b"].median()) < 0.05 and 0.8 < z["a"].std() < 1.3
    assert set(scale.ADAPTERS) == {"none", "standard", "robust", "min_max", "quantile", "coral"}


def test_quantisation_error_is_bounded(spark):
    df = frame(spark, x=np.linspace(-1, 1, 101))
    row = df.select(F.max(F.abs(F.col("x") - quant.dequantise(quant.quantise(F.col("x"), 0.01, 3), 0.01, 3))).alias("e")).first()
    assert row["e"] <= 0.005 + 1e-12
    assert df.limit(1).select(quant.quantise(F.lit(9.9), 0.01, 0).alias("q")).first()["q"] == 127


def test_neighbours_are_exact_across_blocks(spark):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(c, 0.3, size=(60, 3)) for c in (0, 4, 9)] + [np.zeros((40, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    got = {r["id"]: [(n["d"], n["id"]) for n in r["near"]] for r in neighbours.nearest(df, df, 5, True, block_rows=16).collect()}
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(points)):
        order = np.lexsort((np.arange(len(points)), d[i]))[:5]
        assert [n for _, n in got[i]] == order.tolist()


@pytest.mark.parametrize(("block", "fan"), [(40, 4), (5000, 64)])
def test_neighbours_of_groups_in_one_search(spark, block, fan):
    """Trees of several levels, a group of equal points, one smaller than k, a null key, and queries that are no targets."""
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=(300, 2)), "b": np.repeat(rng.normal(size=(3, 2)), 50, axis=0), "c": rng.normal(size=(3, 2)), None: rng.normal(size=(70, 2)) * 5}
    rows = [(g, i, [float(v) for v in p]) for g, ps in groups.items() for i, p in enumerate(ps)]
    asked = [(g, 1000 + i, [float(v) for v in p]) for g, ps in groups.items() for i, p in enumerate(rng.normal(size=(20, 2)) * 2)]
    frame = lambda r: spark.createDataFrame(r, "g string, id long, vec array<double>").repartition(3)
    for queries, skip in ((rows, True), (asked, False)):
        got = {(r.g, r.id): [n["id"] for n in r.near] for r in neighbours.nearest(frame(queries), frame(rows), 6, skip, block, "g", fan).collect()}
        want = {}
        for g, i, v in queries:
            d = np.sqrt(((groups[g] - np.array(v)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((np.arange(len(d)), d)).tolist() if not skip or j != i]
            want[g, i] = order[:6]
        assert got == want


def test_compared_pairs_stay_below_all_pairs_in_two_dimensions(spark):
    points = np.random.default_rng(1).normal(size=(4000, 2))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    loads = []
    assert neighbours.nearest(df, df, 20, True, 256, fan=16, loads=loads).count() == 4000
    assert sum(loads) < 0.5 * 4000**2


def test_outlier_models_flag_an_outlier(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    x[7] = [9, -9]
    df = frame(spark, id=np.arange(500), a=x[:, 0], b=x[:, 1])
    for model in ("mahalanobis", "isolation_forest", "one_class", "lof", "elliptic"):
        out = flows.make_detector(model, ["a", "b"], ["id"]).fit(df).predict(df)
        assert out.where("anomaly").select("id").where("id = 7").count() == 1, model
        assert 10 <= out.where("anomaly").count() <= 60, model


def test_rolling_forecast_closed_form(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, s="x", idx=np.arange(57), v=rng.normal(size=57).cumsum())
    steps = {
        "persistence": lambda x: np.full(10, x[-1]), "moving_average": lambda x: np.full(10, x.mean()),
        "linear_trend": lambda x: np.polyval(np.polyfit(np.arange(10), x, 1), np.arange(10, 20)),
    }
    for name, one in steps.items():
        model = forecast.get_forecaster(name, "s", 10, 10)
        fast = forecast.rolling_forecast(df, model, "v").toPandas().sort_values(["window_id", "step"])
        slow = forecast.rolling_forecast_with(df, "s", "v", 10, one).toPandas().sort_values("idx")
        assert len(fast) == 40 and np.allclose(fast["y_pred"], slow["y_pred"])
    with pytest.raises(ValueError):
        forecast.get_forecaster("nope", "s", 1, 1)


def test_linear_models_recover_truth(spark):
    rng = np.random.default_rng(4)
    n, a = 1500, np.array([[0.5, 0.2], [-0.3, 0.4]])
    x = np.zeros((n, 2))
    for t in range(1, n):
        x[t] = a @ x[t - 1] + rng.normal(size=2)
    df = frame(spark, idx=np.arange(n), p=x[:, 0], q=x[:, 1])
    var = forecast.VectorAutoregression(["p", "q"], 4).fit(df)
    assert np.allclose(var.coefficients[1:3].T, a, atol=0.1)
    ar = forecast.ArimaTwoStep("p", max_p=2, max_d=1, max_q=1, long_lags=8).fit(df)
    assert ar.d == 0 and len(ar.forecast(df, 5)) == 5
    ridge = forecast.DirectRidge(["p", "q"], 4, 2, lag=2).fit(df)
    made = windows.sequences(df, None, ["p", "q"], 4, 2).toPandas()
    flat = np.array([np.array(list(map(list, r)))[-2:].ravel() for r in made["x"]])
    y = np.array([np.array(list(map(list, r))).ravel() for r in made["y"]])
    z = (flat - flat.mean(axis=0)) / flat.std(axis=0)
    beta = np.linalg.solve(z.T @ z + np.eye(4), z.T @ (y - y.mean(axis=0)))
    assert np.allclose(ridge.beta, beta, atol=1e-8)
    t = np.arange(400.0)
    season = frame(spark, t=t, v=3 + 0.1 * t + 2 * np.sin(2 * np.pi * t / 7))
    fit = forecast.TrendSeason(7.0).fit(season, "t", "v").predict(season, "t")
    assert fit.agg(F.max(F.abs(F.col("v") - F.col("y_pred")))).first()[0] < 0.3


def test_stationarity_tests(spark):
    rng = np.random.default_rng(6)
    noise = rng.normal(size=800)
    df = frame(spark, s=["white"] * 800 + ["walk"] * 800, idx=np.r_[np.arange(800), np.arange(800)], v=np.r_[noise, noise.cumsum()])
    labels = {r["s"]: r["label"] for r in stats.stationarity(stats.adf(df, "s", "v", 6), stats.kpss(df, "s", "v"), "s").collect()}
    assert labels == {"white": "Stationary", "walk": "Non-stationary"}
    part = stats.pacf(df, "s", "v", 3).where("s = 'walk'").orderBy("lag").toPandas()
    full = stats.acf(df, "s", "v", 3).where("s = 'walk'").orderBy("lag").toPandas()["acf"].to_numpy()
    for k in (1, 2, 3):
        m = np.array([[full[abs(i - j)] for j in range(k)] for i in range(k)])
        assert part["pacf"][k] == pytest.approx(np.linalg.solve(m, full[1 : k + 1])[-1])
    normal = {r["s"]: r["normal"] for r in stats.ks_normal(df, "s", "v").collect()}
    assert normal["white"]


def test_alignment_extrapolates(spark):
    df = frame(spark, s=["a"] * 3 + ["b"] * 4, t=[0.0, 5.0, 10.0, 1.0, 2.0, 4.0, 8.0], v=[0.0, 1.0, 2.0, 10.0, 20.0, 40.0, 80.0])
    got = {r["t"]: (r["a"], r["b"]) for r in align.align_linear(df, "s", "t", "v").collect()}
    assert got == {0.0: (0.0, 0.0), 5.0: (1.0, 50.0), 10.0: (2.0, 100.0)}


def test_threshold_flow_and_options(spark):
    rng = np.random.default_rng(9)
    def make(shift, n=400):
        return frame(spark, feature=["f"] * n + ["g"] * n, idx=np.r_[np.arange(n), np.arange(n)], residual=rng.normal(shift, 1, 2 * n))
    lab, fatigue, field = make(0), make(1.5), make(0)
    out = flows.calibrate_validate_apply(lab, fatigue, field, 1.0, 0.2)
    assert out["thresholds"].count() == 2
    assert out["summary"].first()["total_samples"] == 400
    assert out["validation"].first()["cusum_danger_pct"] > 50
    loose = thresholds.apply_residual(field, out["thresholds"], legacy_h_zero=True).where("cusum_danger").count()
    strict = thresholds.apply_residual(field, out["thresholds"], alpha=0.1).where("cusum_danger").count()
    assert loose > strict


def test_lag_budget_and_splits(spark):
    assert max(windows.lag_budget(3000)[0]) == 2880 and max(windows.lag_budget(100)[0]) == 120
    with pytest.raises(ValueError):
        split.split_chronological(frame(spark, idx=[0, 1]), None, (0.5, 0.1, 0.1))
    df = order_index(frame(spark, k=np.arange(50)), None, "k")
    one, two = (sorted(r["k"] for r in split.hash_sample(df, "k", 10).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 10


def test_metrics_modes(spark):
    df = frame(spark, y_true=[0.0, 1.0, 2.0, 4.0], y_pred=[0.5, 1.0, 1.0, 5.0])
    skip = metrics.forecast_metrics(df).first()
    assert skip["mape"] == pytest.approx((0 + 0.5 + 0.25) / 3 * 100) and skip["r2"] == pytest.approx(1 - 2.25 / 8.75)
    with pytest.raises(ValueError):
        metrics.forecast_metrics(df, mape_mode="other")


def test_lof_rows_with_one_key(spark):
    """Rows that share a key keep neighbours and scores of their own."""
    rng = np.random.default_rng(9)
    df = frame(spark, key=np.arange(60) // 3, a=rng.normal(size=60), b=rng.normal(size=60))
    points = df.select(F.monotonically_increasing_id().alias("id"), F.array("a", "b").alias("vec"))
    want = sorted(r["lof"] for r in neighbours.lof(points, 5, points).collect())
    model = outliers.LocalOutlierFactor(["a", "b"], k=5).fit(df)
    assert np.allclose(sorted(r["score"] for r in model.score(df).collect()), want)


def test_streams_over_many_small_batches(spark, tmp_path):
    """Windows and CUSUM with state equal plain loops, whatever the micro-batches are."""
    from sensorloom.streaming import operators as streaming

    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"k": np.where(np.arange(230) % 5 == 0, "b", "hot"), "t": np.arange(230), "v": rng.normal(size=230)})
    for i in range(6):  # files in order of time
        spark.createDataFrame(pdf[i * 40 : (i + 1) * 40]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    reader = spark.readStream.schema("k string, t long, v double").option("maxFilesPerTrigger", 1)
    got = streaming.drain(streaming.count_windows(reader.parquet(f"{tmp_path}/in"), "k", ["t"], "v", 30), f"{tmp_path}/w").toPandas()
    limits = spark.createDataFrame([(k, 0.1, 2.0, 0.3, -2.0, 2.0) for k in ("b", "hot")], "k string, mu0 double, h double, k_ double, danger_lower double, danger_upper double")
    walked = streaming.drain(
        streaming.cusum_stream(reader.parquet(f"{tmp_path}/in").withColumnRenamed("k", "s"), "s", ["t"], "v", limits.withColumnRenamed("k", "s").withColumnRenamed("k_", "k")), f"{tmp_path}/c"
    ).toPandas().sort_values("t")
    for key, rows in pdf.groupby("k"):
        values = rows["v"].tolist()
        windows = got[got["k"] == key].sort_values("window_id")
        assert [list(w) for w in windows["values"]] == [values[i : i + 30] for i in range(0, len(values) - 29, 30)]
        pos = neg = 0.0
        want = [(0.0, 0.0)]
        for v in values[1:]:
            pos, neg = max(0.0, pos + v - 0.1 - 0.3), max(0.0, neg - (v - 0.1 + 0.3))
            want.append((pos, neg))
        assert np.allclose(walked[walked["s"] == key][["cusum_pos", "cusum_neg"]], want)


def test_late_rows_and_sessions_cover_all_rows(spark, tmp_path):
    """The session window drops rows that are marked late and no others."""
    from sensorloom.streaming import operators as streaming

    rng = np.random.default_rng(2)
    seconds = np.concatenate([np.arange(0, 400, 4), rng.integers(0, 400, 60)])
    for i in range(8):
        part = pd.DataFrame({"k": "a", "ts": pd.to_datetime(seconds[i * 20 : (i + 1) * 20], unit="s")})
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame(pd.DataFrame({"k": ["end"], "ts": pd.to_datetime([9000], unit="s")})).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    reader = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1)
    marked = streaming.drain(streaming.marked_late(reader.parquet(f"{tmp_path}/in"), "ts", "5 seconds", "20 seconds"), f"{tmp_path}/m").where("k = 'a'")
    runs = streaming.drain(streaming.gap_sessions(reader.parquet(f"{tmp_path}/in"), "k", "ts", "5 seconds", "20 seconds", 1, 10**6), f"{tmp_path}/s").where("k = 'a'")
    late = marked.where("late").count()
    assert 0 < late < 60 and marked.count() == 160
    assert 160 - late <= runs.agg(F.sum("n")).first()[0] < 160


def test_holt_weights_are_no_worse_than_any_grid_point():
    from sensorloom.operators import forecast

    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=(25, 40)), axis=1) + rng.normal(size=(25, 40)) * np.linspace(0, 3, 25)[:, None]
    grid = forecast.ExponentialSmoothing.GRID
    alpha, beta, sse = forecast.holt_weights(x, grid)
    every = np.stack([forecast.holt_lines(x, a, b)[2] for a in grid for b in grid])
    assert (sse <= every.min(axis=0)).all() and np.allclose(forecast.holt_lines(x, alpha, beta)[2], sse)
    assert ((alpha >= 0) & (alpha <= 1) & (beta >= 0) & (beta <= 1)).all()
    one, fixed, held = forecast.holt_weights(x, grid, 0.1)
    assert (fixed == 0.1).all() and (held <= np.stack([forecast.holt_lines(x, a, 0.1)[2] for a in grid]).min(axis=0)).all() and (sse <= held + 1e-9).all()


def test_envelope_with_many_starts_resists_a_large_cluster(spark):
    """Two fifths of the rows lie in a tight cluster far away; coordinates alone (medians) are pulled between the two."""
    rng = np.random.default_rng(6)
    good = rng.normal(size=(240, 2)) @ np.array([[2.0, 1.6], [0.0, 0.7]])
    bad = rng.normal(size=(150, 2)) * 0.9 + np.array([1.5, 8.0])
    data = frame(spark, a=np.r_[good[:, 0], bad[:, 0]], b=np.r_[good[:, 1], bad[:, 1]])
    model = outliers.RobustEnvelope(["a", "b"], 0.38).fit(data)
    assert model.volume <= min(model.first_volumes) + 1e-2 and len(model.first_volumes) == 21
    assert np.linalg.norm(model.mean - good.mean(axis=0)) < 0.8
    rows = model.predict(data).collect()
    assert sum(r["anomaly"] for r in rows if r["b"] > 5 and r["a"] < 5) >= 0.9 * 150
    clean = sorted(r["score"] for r in rows if not (r["b"] > 4))
    assert 0.6 < clean[len(clean) // 2] < 1.9  # close to the median distance of normal data, 1.18
    flat = frame(spark, a=np.ones(30), b=np.arange(30.0))
    assert sum(r["anomaly"] for r in outliers.RobustEnvelope(["a", "b"]).fit(flat).predict(flat).collect()) <= 30
    assert outliers.RobustEnvelope(["a", "b"]).fit(flat.where("false")).threshold == float("inf")
