import zlib

import numpy as np

from sensorloom.llm import langid
from tests.llm.helpers import AWKWARD, awkward


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert out and sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)


def test_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = docs.selectExpr("doc_id", "text", "if(crc32(CAST(doc_id AS string)) % 4 = 2, 'zz', lang) AS lang")
    assert sorted(map(tuple, langid.identify_held_out(mixed).collect())) == sorted(map(tuple, langid.identify_held_out(docs).collect()))


def test_awkward_documents(spark):
    rows = langid.identify_held_out(awkward(spark)).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 9, 13) or r.doc_id is None and r.lang_pred == "und")
    assert langid.identify_held_out(awkward(spark, [])).collect() == []
    blind = langid.identify_held_out(awkward(spark, [(1, "text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in blind] == [("und", 0.0)]


def test_distance_equals_plain_loop():
    """Ranks, places out and ties as a plain loop over dictionaries has them."""
    rng = np.random.default_rng(2)
    words = {"aa": ["the", "of", "and"], "bb": ["der", "und", "ein"]}
    rows = []
    for lang, vocabulary in words.items():
        codes = langid.gram_codes([" ".join(rng.choice(vocabulary, 200))])[0]
        grams, n = np.unique(codes, return_counts=True)
        order = np.lexsort((grams, -n))[:30]
        rows += [(lang, int(grams[i]), k) for k, i in enumerate(order)]
    tool = langid.Profiles(rows, 30)
    for text in ("the end of it", "ein Haus und der Baum", "AND THE", "日本語 テキスト", "the 日本語"):
        names, scores = tool.predict([text])
        codes = langid.gram_codes([text])[0].tolist()
        ranked = sorted(set(codes), key=lambda g: (-codes.count(g), g))[:30]
        distance = {}
        for lang in words:
            rank = {g: k for name, g, k in rows if name == lang}
            distance[lang] = sum(abs(rank[g] - k) if g in rank else 30 for k, g in enumerate(ranked))
        best = min(sorted(distance), key=distance.get)
        assert names == [best] and np.isclose(scores[0], max(0, 1 - distance[best] / (30 * len(ranked))))


def test_a_language_that_was_not_learned_scores_low(spark):
    rows = [(k, "the cat and the dog ran to the old house of the king and slept there " * 3, "en") for k in range(40)] + [(1000, "日本語のテキストです、これは長い文章で the", None)]
    got = {r.doc_id: r.score for r in langid.identify_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1000] < 0.2 and min(v for k, v in got.items() if k < 1000) > 0.8
