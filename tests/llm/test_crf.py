import itertools
import zlib

import numpy as np

from sensorloom.llm import crf
from tests.llm.helpers import AWKWARD, SF, awkward


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    model = crf.LineCRF(rng.normal(size=crf.N_FEATURES), rng.normal(size=(2, 2)), np.zeros(crf.N_FEATURES), np.ones(crf.N_FEATURES))
    texts = [b"one", b"", b"a b\nB!! C!!\n\nfour five", b"x\n" * 6, b"Last\nline | | |"]
    features, _, n_lines = crf.line_features(texts)
    assert n_lines.tolist() == [1, 1, 4, 7, 2]
    good, pair = model.marginals(features, n_lines)
    at = pairs = 0
    for n in n_lines:
        logit = np.clip(features[at : at + n] @ model.weights, -30, 30)
        mass, both, total = np.zeros(n), np.zeros((max(n - 1, 0), 2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(logit[i] * y[i] for i in range(n)) + sum(model.transitions[y[i - 1], y[i]] for i in range(1, n)))
            total, mass = total + w, mass + w * np.array(y)
            for i in range(1, n):
                both[i - 1, y[i - 1], y[i]] += w
        assert np.allclose(good[at : at + n], mass / total, atol=1e-5)
        assert np.allclose(pair[pairs : pairs + n - 1], both / total, atol=1e-5)
        at, pairs = at + n, pairs + n - 1


def test_held_out_accuracy_and_no_other_inputs(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = crf.score_documents(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert rows and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.collect())
    moved = crf.score_documents(docs.selectExpr("doc_id", "text", "'zz' AS lang", "source"), labels)
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, got.collect()))


def test_awkward_documents(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 1), (6, 1, 1), (None, 1, 0), (9, None, 0), (11, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, known in ((awkward(spark), labels), (awkward(spark), labels.limit(0)), (awkward(spark, []), labels)):
        rows = crf.score_documents(docs, known).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    rows = crf.score_documents(awkward(spark), labels).collect()
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1  # null is the empty text
    assert len(rows) == len(AWKWARD) and all(not r.held_out for r in rows if r.doc_id is None)


def test_long_text_and_one_label():
    model = crf.LineCRF.fit([b"good line\nmore", b"A!! B!!\nC!!"] * 20, np.array([1, 0] * 20))
    long = model.scores([b"good line here\n" * 50_000, b"A!! B!!\n" * 50_000])
    assert long[0] > 0.5 > long[1] and np.isfinite(long).all()
    assert crf.LineCRF.fit([b"x"], np.array([1])).scores([b"y"])[0] > 0.5

