import math
import re

from sensorloom.llm import licenses
from tests.llm.helpers import AWKWARD, SF, awkward

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, threshold=0.8):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    spots, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        spots += at
        labels |= {label} if at else set()
    size, base, score, found = licenses.BLOCK_WORDS, ",".join(sorted(labels)), 1.0 if spots else 0.0, set(labels)
    best = 0.0
    for i in range(0, max(len(words) - 1 - size // 2, 0) + 1, size // 2):
        block = set(words[i : i + size])
        for label, t in licenses.TEMPLATES.items():
            terms = set(t.split())
            both = len(terms & block)
            if both >= math.ceil(threshold * len(terms) - 1e-9):
                found.add(label)
                best = max(best, both / len(terms))
    return (len(words), len(spots), min(spots, default=None), max(spots, default=None), base, ",".join(sorted(found)), score or best)


CASES = [
    "CC BY cc-by 4.0 cc, by", "GNU General Public\nLicense", "general public", "All rights reserved. all RIGHTS-reserved", "Licensed under the Apache License, Version 2.0.",
    "licensed apache license version 2", "word " * 500 + "Released under the MIT License." + " word" * 100, "Permission: released under mit", "reserved rights all copyright",
]


def test_equals_brute_force(spark):
    texts = [t for _, t, _ in AWKWARD] + CASES + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = awkward(spark, [(i, t, None) for i, t in enumerate(texts)])
    got = {r[0]: tuple(r[1:]) for r in licenses.scan_licenses(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (t or "")[:80]


def test_repeats_and_empty_table(spark):
    assert licenses.scan_licenses(awkward(spark)).count() == len(AWKWARD)
    assert licenses.scan_licenses(awkward(spark, [])).collect() == []
    assert "Python" not in licenses.scan_licenses(awkward(spark))._jdf.queryExecution().toString()


def test_a_long_template_is_found_at_every_offset(spark):
    template = " ".join(f"w{i}" for i in range(150))
    docs = spark.createDataFrame([(k, "x " * k + template + " y" * (k % 7) * 50) for k in range(320)] + [(999, "x " * 400 + template[: len(template) // 2])], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs, templates={"long": template, "short": "q1 q2"}).collect()}
    assert {k for k, v in got.items() if v == "long"} == set(range(320))
