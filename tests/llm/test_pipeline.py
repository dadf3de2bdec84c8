import hashlib

import pytest

import corpus_pipeline
from check import compare, duck
from sensorloom.llm import catalog
from tests.llm.helpers import SF, awkward
from tests.llm.test_bpe import TRUTH
from tests.llm.test_chosen_path import brute as brute_classes
from tests.llm.test_lines import brute as brute_lines


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    message, _, ok = compare(spark, duck(SF), name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ok, message


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    labelled = [(d in {x for x, _ in rows}) == bool(y) for d, y in quality.items()]
    assert sum(labelled) >= 0.97 * len(labelled)
    cut = corpus_pipeline.line_dedup(spark, kept, SF)
    want = brute_lines(rows, 10)
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == sorted((d, t) for d, _, _, t in want)
    assert all(r.n_chars == len(r.text) for r in cut.collect()) and cut.columns == docs.columns
    rows = [(d, t) for d, _, _, t in want]
    one = corpus_pipeline.near_duplicates(spark, cut, SF)
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c, _ in brute_classes(rows)})
    clean = corpus_pipeline.decontamination(spark, one, SF)
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in one.collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, t in texts.items() if not any(b in " ".join(t.lower().split()) for b in bench)}
    final = corpus_pipeline.tokens(spark, clean, SF).collect()
    assert len(final) == clean.count()
    for r in final:
        assert list(r.ids) == TRUTH.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("rows", [None, []])
def test_awkward_documents_pass_every_stage(spark, rows):
    docs = awkward(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            out.count()
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert out.count() == docs.count()


def test_rows_without_an_id_are_told_apart(spark):
    """Near copies and leaks among rows without an id: only the rows concerned go, whatever other rows lack an id too."""
    words = [f"word{i}" for i in range(120)]
    near = [" ".join(words), " ".join([*words[:-1], "other"])]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    own = [f"text{k} " + " ".join(f"own{k}x{i}" for i in range(60)) for k in range(4)]
    leak = f"before {item} after " + " ".join(f"leak{i}" for i in range(50))
    rows = [(None, near[0], None), (None, near[1], None), (7, near[0], None), (7, near[0], None), (None, own[0], None), (None, own[0], None), (None, own[1], None), (3, own[2], None), (3, own[3], None), (None, leak, None)]
    one = corpus_pipeline.near_duplicates(spark, awkward(spark, rows), SF)
    assert sorted(((r.doc_id, r.text) for r in one.collect()), key=repr) == sorted([(7, near[0]), (None, own[0]), (None, own[1]), (3, own[2]), (3, own[3]), (None, leak)], key=repr)
    clean = corpus_pipeline.decontamination(spark, awkward(spark, rows), SF)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=repr) == sorted([r[:2] for r in rows[:-1]], key=repr)
