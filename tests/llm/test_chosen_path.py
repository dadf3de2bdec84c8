import random
from collections import defaultdict

import numpy as np
import pytest

from sensorloom.llm import chosen_path
from sensorloom.llm.components import components
from tests.llm.helpers import AWKWARD, awkward


def shingles(text, k=5):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, similarity=0.8):
    low = lambda d: -(2**63) if d is None else d
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(low(d))
    texts = list(by)
    sets, links, root = [shingles(t) for t in texts], [0] * len(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {r: min(min(by[t]) for t, q in zip(texts, root, strict=True) if q == r) for r in set(root)}
    place = {t: i for i, t in enumerate(texts)}
    up = lambda d: None if d == -(2**63) else d
    return sorted(((d, up(least[root[place[t or ""]]]), links[place[t or ""]]) for d, t in rows), key=repr)


def near_copies():
    pick, rows = random.Random(2), [(d, t) for d, t, _ in AWKWARD]
    for g in range(14):
        base = [f"g{g}w{pick.randrange(900)}" for _ in range(pick.choice([6, 30, 120, 300]))]
        for k in range(pick.choice([2, 3, 40])):
            words = list(base)
            for _ in range(pick.choice([0, 1, 1, 2, 3])):
                words[pick.randrange(len(words))] = f"edit{pick.randrange(10**6)}"
            rows.append((1000 * g + 100 + k, " ".join(words)))
    shared = " ".join(f"common{i}" for i in range(25))
    rows += [(50_000 + k, shared + " " + " ".join(f"u{k}x{i}" for i in range(120))) for k in range(120)]
    return rows


@pytest.mark.parametrize(("limit", "chunk", "depth"), [(1024, 256, 3), (8, 4, 3), (4, 3, 1)])
def test_equals_brute_force(spark, limit, chunk, depth):
    rows = near_copies()
    docs = awkward(spark, [(d, t, None) for d, t in rows])
    got = sorted((tuple(r) for r in chosen_path.similar_classes(docs, limit=limit, chunk=chunk, depth=depth).collect()), key=repr)
    want = brute(rows)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)
    assert len(got) == len(want)


def test_empty_table(spark):
    assert chosen_path.similar_classes(awkward(spark, [])).collect() == []


def test_runs_follow_from_recall():
    assert chosen_path.runs_needed(0.999, 1) < chosen_path.runs_needed(0.999, 3) < chosen_path.runs_needed(0.99999, 3)


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in (0, 5, 800, 6000, 6000)]
    assert (chosen_path.overlaps(sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()
    assert (chosen_path.overlaps(sets[3:]) == [[len(np.intersect1d(a, b)) for b in sets[3:]] for a in sets[3:]]).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
