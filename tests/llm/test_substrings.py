import hashlib
import random
import re

import pytest

from sensorloom.llm import substrings
from tests.llm.helpers import AWKWARD, awkward


def brute(rows, length):
    split = [(d if d is not None else -(2**63), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - length + 1):
            run = tuple(w[i : i + length])
            least[run] = min(d, least.get(run, d))
    out = []
    for (d, _), (key, w) in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < key:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "seed"), [(13, 5), (5, 5), (6, 2)])
def test_awkward_documents(spark, length, seed):
    pick = random.Random(8)
    base = [f"w{pick.randrange(60)}" for _ in range(400)]
    rows = [(d, t) for d, t, _ in AWKWARD]
    for k in range(60):  # passages cut from one text at any place, chained, reversed, repeated within a text
        a, b = sorted(pick.sample(range(400), 2))
        rows.append((100 + k, " ".join([f"own{k}", *base[a:b], f"\tmid{k}\n", *base[b : b + pick.randrange(20)], *base[a : a + 9] * pick.randrange(3)])))
    docs = awkward(spark, [(d, t, None) for d, t in rows])
    got = sorted((tuple(r) for r in substrings.dedup_substrings(docs, length=length, seed=seed).collect()), key=repr)
    assert got == brute(rows, length)


def test_hot_passage_and_empty_table(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(k, f"start{k} {passage} end{k}") for k in range(300)]
    docs = awkward(spark, [(d, t, None) for d, t in rows])
    got = {r.doc_id: r for r in substrings.dedup_substrings(docs).collect()}
    assert got[0].n_removed == 0 and all(got[k].kept == f"start{k} end{k}" for k in range(1, 300))
    assert substrings.dedup_substrings(awkward(spark, [])).collect() == []
