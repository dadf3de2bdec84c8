import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from sensorloom.llm import winnow
from tests.llm.helpers import AWKWARD, awkward

LOW = 1 << 37


def chained(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v.to_bytes(8, "little", signed=True), seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute(text, gram, window):
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", text) if w]
    own = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    own = [h - (1 << 64) if h >= 1 << 63 else h for h in own]
    grams = [chained(own[i : i + gram]) for i in range(len(own) - gram + 1)] or ([chained(own)] if own else [])
    kept = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        span = range(i, min(i + window, len(grams)))
        at = min(span, key=lambda j: (grams[j] % LOW, -j))
        if at not in kept:
            kept.append(at)
    return [grams[i] for i in kept], kept


@pytest.mark.parametrize(("gram", "window"), [(5, 8), (2, 4), (3, 1)])
def test_equals_brute_force(spark, gram, window):
    texts = [t or "" for _, t, _ in AWKWARD if (t or "") != AWKWARD[4][1]] + [AWKWARD[4][1][:4000], "a a a a a a a a a a a a a", "b c " * 40]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in winnow.with_fingerprint(frame, "text", "f", gram, window).collect():
        assert (r.f.hashes, r.f.places) == brute(texts[r.i], gram, window), texts[r.i][:60]


def test_shared_run_shares_a_hash(spark):
    run = " ".join(f"w{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1))
    frame = spark.createDataFrame([(f"x y z {run} q r",), (f"{run} other end of it",)], "text string")
    a, b = (set(r.f.hashes) for r in winnow.with_fingerprint(frame, "text", "f").collect())
    assert a & b


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_pairs(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = sorted(((d, t) for d, t, _ in AWKWARD if d is not None and d != 6), key=lambda r: r[0])
        got = {r.doc_id: r for r in winnow.fingerprint_pairs(awkward(spark, [(d, t, None) for d, t in rows])).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(rows):
        text, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, other = (set(brute(x, winnow.GRAM, winnow.WINDOW)[0]) for x in (text, edited, after))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[d].near_edited, got[d].near_next) == (pytest.approx(like(own, new)), pytest.approx(like(own, other)))
        assert got[d].fingerprint.count(":") == len(brute(text, winnow.GRAM, winnow.WINDOW)[0])


def test_nulls_repeats_and_empty_table(spark):
    got = winnow.fingerprint_pairs(awkward(spark))
    assert got.count() == len(AWKWARD)
    assert winnow.fingerprint_pairs(awkward(spark, [])).collect() == []
    same = got.where(F.col("doc_id").isin(6, 7)).select("fingerprint").distinct()
    assert same.count() == 1
    assert "Python" not in got._jdf.queryExecution().toString()
