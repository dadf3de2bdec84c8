"""Similarity of columns against pandas, with ties, missing values and no table turned from rows to columns."""

import math

import pytest
from pyspark.sql import GroupedData

from sensorloom.operators import stats

LAB = [(i, None if i % 7 == 3 else float(i % 5), float((i * 37) % 41)) for i in range(90)]
FIELD = [(i, float((i * i) % 11), None if i % 13 == 5 else float(i // 4)) for i in range(80)]


def test_ranks_without_a_pivot(spark, monkeypatch):
    pd = pytest.importorskip("pandas")

    def refuse(*_):
        raise AssertionError("one row per position and column was turned into columns")

    monkeypatch.setattr(GroupedData, "pivot", refuse)
    pairs = [("p", "p"), ("p", "q"), ("q", "q")]
    made = stats.similarity(spark.createDataFrame(LAB, "idx long, p double, q double"), spark.createDataFrame(FIELD, "idx long, p double, q double"), pairs, bins=4)
    got = {(r.lab_feature, r.field_feature): r for r in made.collect()}
    lab, field = (pd.DataFrame(x, columns=["idx", "p", "q"]).set_index("idx")[:80] for x in (LAB, FIELD))
    for a, b in pairs:
        x, y = lab[a], field[b]
        assert got[a, b].pearson_corr == pytest.approx(abs(x.corr(y)))
        assert got[a, b].spearman_corr == pytest.approx(abs(x.rank().corr(y.rank())))

        def bars(v):
            width = (v.max() - v.min()) / 4
            place = ((v.dropna() - v.min()) / width).round(9).apply(math.floor).clip(upper=3)
            return place.value_counts().reindex(range(4), fill_value=0).astype(float)

        u, w = bars(x), bars(y)
        assert got[a, b].histogram_cosine == pytest.approx((u * w).sum() / math.sqrt((u * u).sum() * (w * w).sum()))
