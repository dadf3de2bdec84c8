"""Documents with every awkward case, and plain-Python pieces that the operators are held against."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
LONG = " ".join(random.Random(5).choice("alpha beta gamma delta of the and to in".split()) + str(i % 97) for i in range(20_000))

AWKWARD = [
    (1, "one line", "en"), (2, None, "en"), (3, "", None), (4, "\n\n", "fr"), (5, LONG, "en"), (6, "same text here " * 9, "de"), (6, "same text here " * 9, "de"),
    (7, "same text here " * 9, None), (8, "x", "en"), (9, "   \t ", "en"), (10, "ÉÀ ñ ß 日本語 テキスト\x00\x1c  ok", "es"), (11, "a" * 3000, "en"),
    (None, "no id\nat all", None), (None, None, None), (12, "tail\n", "en"), (13, "123 456 !!! ###", "en"),
]


def awkward(spark, rows=None):
    """The cases with extra columns whose names are also used for results or inside operators."""
    docs = spark.createDataFrame(AWKWARD if rows is None else rows, "doc_id long, text string, lang string")
    extra = {c: F.lit(7) for c in ("score", "n_words", "n_lines", "row", "_id", "_text", "_key", "kept", "class_id", "labels", "predicted", "path", "_block", "gram")}
    return docs.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint"), **extra})


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
