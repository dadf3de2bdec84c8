import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import ranked
from tests.llm.helpers import AWKWARD, awkward

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(rows, items, top=50):
    counts = [(d, Counter(terms_of(t))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, -(2**63) if d is None else d))
        out += [(i, k + 1, None if d == -(2**63) else d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def corpus(seed=4, n=400):
    pick, rows = random.Random(seed), [(d, t) for d, t, _ in AWKWARD]
    for d in range(n):
        theme = pick.randrange(12)
        words = [f"t{theme}w{int(pick.paretovariate(0.7)) % 60}" if pick.random() < 0.5 else f"Common{int(pick.paretovariate(0.5)) % 40}" for _ in range(pick.choice([1, 4, 30, 200]))]
        rows.append((100 + d, pick.choice([" ", ", ", "_", "\n"]).join(words)))
    rows += [(2000 + k, rows[60][1]) for k in range(70)]  # ties beyond the top
    items = [(k, rows[pick.randrange(16, len(rows))][1][:300] + " Éà common1") for k in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (None, "alpha common1"), (93, "x"), (93, "beta")]
    return rows, items


def framed(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("rank", "score", "_i", "doc_id")})


def results(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(("entries", "block", "sample"), [(1 << 19, 32, 8), (900, 4, 2), (900, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, entries, block, sample):
    monkeypatch.setattr(ranked, "SHARD_ENTRIES", entries)
    rows, items = corpus()
    docs = awkward(spark, [(d, t, None) for d, t in rows]).repartition(3)
    got = results(ranked.ranked_search(docs, framed(spark, items), top=20, block_docs=block, sample_shards=sample))
    assert got == brute(rows, items, 20)


def test_items_in_parts(spark):
    rows, items = corpus(6, 60)
    got = results(ranked.ranked_search(awkward(spark, [(d, t, None) for d, t in rows]), framed(spark, items), query_bytes=500))
    assert got == brute(rows, items)


def test_empty_tables(spark):
    rows, items = corpus(6, 60)
    assert results(ranked.ranked_search(awkward(spark, []), framed(spark, items))) == []
    assert results(ranked.ranked_search(awkward(spark), framed(spark, []))) == []
    assert results(ranked.ranked_search(awkward(spark), framed(spark, [(1, None), (2, " .")]))) == []


def test_summaries_bound_scores_and_blocks_are_skipped():
    rng = np.random.default_rng(2)
    n, width = 600, 80
    theme = rng.integers(0, 10, n)
    sets = [np.unique(np.concatenate([theme[i] * 8 + rng.integers(0, 8, 5), rng.integers(0, width, 2)])) for i in range(n)]
    shard = ranked.Shard(ids=np.arange(n), n=np.full(n, 9), first=np.concatenate([[0], np.cumsum([len(s) for s in sets])]), term=np.concatenate(sets), value=rng.integers(1, 1000, sum(map(len, sets))))
    weight = rng.integers(1, 50, width)
    dense = np.zeros((n, width), np.int64)
    dense[shard.doc, shard.term] = shard.value
    lists = {t: np.arange(width) for t in range(width)}
    blocked = ranked.BlockedLists(shard, lists, weight, 16)
    for t in range(width):
        assert sorted(np.concatenate(blocked.members[t]).tolist()) == np.flatnonzero(dense[:, t]).tolist()
        for members, summary in zip(blocked.members[t], blocked.summary[t], strict=True):
            assert (dense[members].max(axis=0) == summary).all()
    back = ranked.BlockedLists.read(blocked.written(), lists)
    assert all((back.summary[t] == blocked.summary[t]).all() for t in lists)
    most = dense.max(axis=0) * weight
    skipped = 0
    for theme_at in range(10):
        query = np.arange(theme_at * 8, theme_at * 8 + 8)
        own = np.zeros(width, np.int64)
        own[query] = weight[query]
        score = dense @ own
        docs, found, _, passed = ranked.best_of_shard(shard, blocked, ranked.needed_lists(query, most, 0), query, lists, weight, 0, 10)
        want = np.lexsort((np.arange(n), -score))[:10]
        keep = np.lexsort((docs, -found))[:10]
        assert docs[keep].tolist() == want.tolist() and found[keep].tolist() == score[want].tolist()
        skipped += passed
    assert skipped > 0
