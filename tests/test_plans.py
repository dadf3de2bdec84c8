"""Plans keep their shape: bounded windows, no Cartesian products, pruned scans."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, queries
from sensorloom.catalog.base import events
from sensorloom.kernels import order_index
from sensorloom.operators import detect, windows

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture
def spread(spark):
    return order_index(events(spark, SF), "event_type", ["ts", "event_id"])


def test_long_series_windows_run_on_chunks(spread):
    for df in (
        windows.rolling(spread, "event_type", "value", 50),
        detect.zscore(spread, "event_type", "value", 100),
        detect.ewma(spread, "event_type", "value", 0.1),
    ):
        text = plan(df)
        for line in text.splitlines():
            if "windowspecdefinition" in line and "ROWS" in line.upper() and "value" in line:
                assert "_chunk" in line, line
        assert "CartesianProduct" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(detect.sigma_flags(events(spark, SF), "event_type", "value"))
    assert "props" not in text and "user_id" not in text


@pytest.mark.parametrize("name", ["cusum", "aligned_linear", "trend_slopes", "linear_trend_forecast", "node_degrees", "signal_similarity"])
def test_no_cartesian_products(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_entry_runs(spark):
    df = entry(spark)
    assert df.columns == ["event_type", "detector", "n_anomalies", "pct"] and df.count() == 30


def test_written_tables_can_be_forgotten(spark):
    import os

    from sensorloom.session import folder, forget, settle

    assert settle(spark.range(5)).count() == 5
    path = folder(spark).removeprefix("file:")
    assert os.listdir(path)
    forget(spark)
    assert not os.path.exists(path)


def test_text_package_is_optional(tmp_path):
    """Without the text operators' folder and the pipeline the other queries are all there."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 160 and not any(k.startswith('op') and k[2].isdigit() for k in q), len(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)


def test_sweep_runs_every_detector(spark, monkeypatch):
    """The named sweep fits all detectors under all adapters, and scores the rows of both truths in one pass."""
    from sensorloom.catalog import detection
    from sensorloom.operators import outliers, scale
    from sensorloom.plans import flows

    class Noted(outliers.Detector):
        made, scored = [], []

        def fit(self, df):
            return self

        def score(self, df, out="score"):
            self.scored.append(df)
            return df.withColumn(out, F.col("price"))

    def noted(name, columns, key):
        Noted.made.append(name)
        model = Noted(columns)
        model.threshold = 30.0
        return model

    rows = [(i, 1, 1, 1, "NRA"[i % 3], float(i), float(i), i / 7, i / 9) for i in range(60)]
    frame = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, domain string, quantity double, price double, discount double, tax double")
    monkeypatch.setattr(detection, "lines", lambda spark, sf: frame)
    monkeypatch.setattr(flows, "make_detector", noted)
    got = {(r.model, r.adapter): r for r in detection.detector_sweep(spark, "").collect()}
    assert set(got) == {(m, a) for m in flows.MODELS for a in scale.ADAPTERS} and Noted.made == [*flows.MODELS] * len(scale.ADAPTERS)
    assert len(Noted.scored) == len(got)
    plain = got["lof", "none"]
    assert (plain.tp, plain.fn, plain.tn, plain.fp) == (10, 10, 10, 10)


def test_lof_reads_its_reference_once(spark, monkeypatch):
    """A fitted model knows the densities of its rows: scoring searches the neighbours of the new rows only."""
    from sensorloom.operators import neighbours, outliers

    asked, real = [], neighbours.nearest
    monkeypatch.setattr(neighbours, "nearest", lambda *args, **more: asked.append(1) or real(*args, **more))
    df = spark.createDataFrame([(float(i * i % 17), float(i % 5)) for i in range(30)], "a double, b double")
    model = outliers.LocalOutlierFactor(["a", "b"], k=5).fit(df)
    assert model.score(df).count() == 30 and len(asked) == 2
