"""Licence statements: fixed phrases, and text blocks that contain most of a known template."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Templates whose words, as a set, are looked for in blocks of text.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": "this work is licensed under a creative commons attribution international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mpl": "subject to the terms of the mozilla public license",
    "reserved": "copyright all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WORDS = 64  # at least; twice as many as the longest template


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NO_WORD), "")


def _places(words: str, phrase: list[str], mark: str) -> Column:
    """Word positions at which ``phrase`` starts; only texts with its rarest word are searched."""
    def starts(i: Column) -> Column:
        hit = F.get(F.col(words), i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            hit = hit & (F.coalesce(F.get(F.col(words), i + k), F.lit("")) == word)
        return hit

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), starts)
    return F.when(F.array_contains(words, mark), found).otherwise(F.array().cast("array<int>"))


def _sorted_join(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def template_index(words: DataFrame, templates: dict[str, str], threshold: float) -> tuple[list[str], list[tuple]]:
    """Template words from rare to frequent in the corpus, and the prefix index ``(word, template, place, size, least overlap)``.

    What reaches the driver is one count per template word: it is bounded by the templates, not by the corpus.
    """
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    counted = words.select(F.explode(F.array_intersect("_words", F.array(*map(F.lit, vocabulary)))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counted.collect()}
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    index = []
    for label, text in sorted(templates.items()):
        terms = sorted(set(text.split()), key=order.index)
        least = math.ceil(threshold * len(terms) - 1e-9)
        index += [(w, label, place, len(terms), least) for place, w in enumerate(terms[: len(terms) - least + 1])]
    return order, index


def scan_licenses(docs: DataFrame, text: str = "text", doc: str = "doc_id", threshold: float = 0.8, templates: dict[str, str] | None = None, block_words: int | None = None) -> DataFrame:
    """One row per input row: phrase places, and labels of the templates contained in a block of the text.

    A block is ``block_words`` consecutive words (a new one every half of that), by default twice as many as the longest template has, so a copy of any template lies whole in some
    block wherever it stands; a template is contained if at least ``threshold`` of its distinct words
    are in the block.  The set-similarity join is exact: words are ordered by their frequency over all documents, a
    template is looked up by its rarest words only (prefix filter), blocks with too few words (length filter) or with
    too few words left after the first common one (positional filter) are dropped, and the rest is verified.

    Columns: ``doc, n_words, n_base, first_word, last_word, base_labels, labels, score`` (best containment; 1 with a phrase).
    Null and empty texts have no words, no labels ('') and score 0.  Copies of a row get the same result; an empty table gives an empty one.
    """
    templates = TEMPLATES if templates is None else templates
    block_words = block_words or max(BLOCK_WORDS, 2 * max((len(t.split()) for t in templates.values()), default=0))
    rows = docs.select(F.col(doc).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_t"), words_of(F.col(text)).alias("_words"))
    order, index = template_index(rows, templates, threshold)

    spots = [(_places("_words", p.split(), max(p.split(), key=len) if len(p.split()) > 2 else p.split()[0]), label) for p, label in PHRASES.items()]
    spots = [(F.when(F.array_contains("_words", p.split()[-1]), spot).otherwise(F.array().cast("array<int>")), label) for (spot, label), p in zip(spots, PHRASES, strict=True)]
    base = rows.select("_id", "_t", F.size("_words").cast("bigint").alias("n_words"), *[spot.alias(f"_p{k}") for k, (spot, _) in enumerate(spots)])
    base = base.withColumn("_all", F.concat(*[F.col(f"_p{k}") for k in range(len(spots))])).select(
        "_id", "_t", "n_words",
        F.size("_all").cast("bigint").alias("n_base"),
        F.array_min("_all").cast("bigint").alias("first_word"),
        F.array_max("_all").cast("bigint").alias("last_word"),
        F.filter(F.array(*[F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(spots)]), lambda x: x.isNotNull()).alias("_base"),
    )

    spark = docs.sparkSession
    sets = spark.createDataFrame(
        [(label, sorted(set(t.split()), key=order.index)) for label, t in sorted(templates.items())], "label string, _terms array<string>"
    )
    prefixes = spark.createDataFrame(index, "_word string, label string, _place int, _size int, _least int")
    entry = F.array(*[F.lit(w) for w in sorted({i[0] for i in index})])
    ranked = F.array(*[F.lit(w) for w in order])
    step = block_words // 2
    blocks = (
        rows.where(F.arrays_overlap("_words", entry))
        .select("_id", "_t", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_words") - 1 - step, F.lit(0)), F.lit(step)), lambda i: F.slice("_words", i + 1, block_words))).alias("_block"))
        .where(F.arrays_overlap("_block", entry))
        # template words of the block, from rare to frequent; other words cannot add to an overlap
        .select("_id", "_t", F.array_intersect(ranked, "_block").alias("_has"))
    )
    matches = (
        blocks.select("_id", "_t", "_has", F.posexplode("_has").alias("_at", "_word"))
        .join(prefixes, "_word")
        .where(F.size("_has") >= F.col("_least"))
        .where(F.least(F.col("_size") - F.col("_place"), F.size("_has") - F.col("_at")) + F.col("_place") >= F.col("_least"))
        .select("_id", "_t", "_has", "label", "_size", "_least")
        .join(sets, "label")
        .withColumn("_both", F.size(F.array_intersect("_has", "_terms")))
        .where(F.col("_both") >= F.col("_least"))
        .groupBy("_id", "_t")
        .agg(F.collect_set("label").alias("_labels"), F.max(F.col("_both") / F.col("_size")).alias("_score"))
    )
    none = F.array().cast("array<string>")
    return base.alias("a").join(
        matches.alias("b"), F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._t") == F.col("b._t")), "left"
    ).select(
        F.col("a._id").alias(doc), "n_words", "n_base", "first_word", "last_word",
        _sorted_join(F.col("_base")).alias("base_labels"),
        _sorted_join(F.concat("_base", F.coalesce("_labels", none))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
