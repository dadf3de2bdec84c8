import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom import kernels as K


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 700
    pdf = pd.DataFrame({
        "s": np.where(np.arange(n) % 3 == 0, "hot", np.where(np.arange(n) % 7 == 0, "b", "hot2")),
        "t": np.arange(n), "x": np.round(rng.normal(size=n), 2),
    })
    pdf.loc[::11, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df.repartition(5)


def _expect(pdf, fn):
    return {s: fn(g.sort_values("t")) for s, g in pdf.groupby("s")}


def test_order_index(frame):
    pdf, df = frame
    got = K.order_index(df, "s", "t").toPandas()
    for s, g in got.groupby("s"):
        assert list(g.sort_values("t")["idx"]) == list(range(len(g)))
    whole = K.order_index(df, None, "t").toPandas()
    assert (whole["t"] == whole["idx"]).all()


@pytest.mark.parametrize(("chunk", "supers"), [(7, 3), (7, 10_000), (64, 1), (100000, 10_000)])
def test_scans_equal_loops(frame, chunk, supers, monkeypatch):
    monkeypatch.setattr(K, "SUPER_CHUNKS", supers)
    pdf, df = frame
    rows = K.order_index(df, "s", "t")
    out = K.prefix_sums(rows, "s", {"p": F.coalesce("x", F.lit(0.0))}, chunk)
    out = K.carry_fill(out, "s", {"f": "x"}, chunk_rows=chunk)
    out = K.carry_fill(out, "s", {"b": "x"}, backward=True, chunk_rows=chunk)
    out = K.reflected_walk(out, "s", {"w": F.coalesce("x", F.lit(0.0)) - 0.1}, chunk)
    out = K.decayed_sums(out, "s", {"num": F.col("x"), "den": F.when(F.col("x").isNotNull(), 1.0)}, 0.8)
    out = K.framed(out, "s", lambda w: {"m": F.avg("x").over(w.rowsBetween(-4, 0)), "ld": F.lead("x", 2).over(w)}, 4, 2, chunk)
    out = out.toPandas().sort_values(["s", "t"])
    for s, g in out.groupby("s"):
        x = g["x"]
        assert np.allclose(g["p"], x.fillna(0).cumsum())
        assert np.allclose(g["f"], x.ffill(), equal_nan=True)
        assert np.allclose(g["b"], x.bfill(), equal_nan=True)
        walk, w = [], 0.0
        for v in x.fillna(0) - 0.1:
            w = max(0.0, w + v)
            walk.append(w)
        assert np.allclose(g["w"], walk)
        expected = x.ewm(alpha=0.2).mean()
        got = (g["num"] / g["den"].where(g["den"] > 0))
        assert np.allclose(got, expected, equal_nan=True)
        assert np.allclose(g["m"], x.rolling(5, min_periods=1).mean(), equal_nan=True)
        assert np.allclose(g["ld"], x.shift(-2), equal_nan=True)


def test_quantiles_and_ranks(frame):
    pdf, df = frame
    got = {r["s"]: r["q"] for r in K.quantiles(df, "s", "x", [0, 0.05, 0.5, 0.77, 1]).collect()}
    for s, g in pdf.groupby("s"):
        assert np.allclose(got[s], np.percentile(g["x"].dropna(), [0, 5, 50, 77, 100]))
    ranks = K.average_ranks(df.where("x is not null"), "s", "x", "r").toPandas()
    for s, g in ranks.groupby("s"):
        assert np.allclose(g["r"], g["x"].rank())


def test_exclusive_fill(frame):
    pdf, df = frame
    rows = K.order_index(df, "s", "t").select("s", "t", "idx", "x", F.col("x").alias("before"), F.col("x").alias("behind"))
    rows = K.carry_fill(rows, "s", {"before": "before"}, chunk_rows=5, exclusive=True)
    rows = K.carry_fill(rows, "s", {"behind": "behind"}, backward=True, chunk_rows=5, exclusive=True)
    for _, g in rows.toPandas().sort_values(["s", "t"]).groupby("s"):
        assert np.allclose(g["before"], g["x"].ffill().shift(1), equal_nan=True)
        assert np.allclose(g["behind"], g["x"].bfill().shift(-1), equal_nan=True)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "s string, x double")
    assert K.quantiles(none, "s", "x", [0.5]).collect() == []
    assert K.medians(none, None, "x", "m").collect()[0]["m"] is None
