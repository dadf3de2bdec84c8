import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sensorloom.llm import spelling
from tests.llm.helpers import AWKWARD, awkward

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, least_chars=6, least_n=5, ratio=5, every=199):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_chars:
                count[w] += 1
    words = {w: n for w, n in count.items() if n >= least_n}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def variants(seed=1):
    pick, rows, d = random.Random(seed), [(d, t) for d, t, _ in AWKWARD], 100
    for g in range(40):
        base = "".join(pick.choice("abéÉz") for _ in range(pick.choice([6, 7, 7, 8, 12, 40])))
        held = {base}
        for _ in range(12):
            w = pick.choice(sorted(held))
            i = pick.randrange(len(w) + 1)
            held.add(pick.choice([w[:i] + pick.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + pick.choice("abz") + w[i + 1 :]]))
        for k, w in enumerate(sorted(held)):
            rows.append((d := d + 1, " ".join([w] * pick.choice([1, 4, 5, 6, 30, 160]))))
    long = "x" * 700
    return rows + [(5000, f"{long} " * 6 + f"{long}y " * 30 + f"q{long} " * 6 + "TheseWords×÷ " * 5 + "a1b2 " * 9)]


@pytest.mark.parametrize("bundle", [8192, 6])
def test_equals_brute_force(spark, bundle):
    rows = variants()
    docs = awkward(spark, [(d, t, None) for d, t in rows])
    got = sorted(tuple(r) for r in spelling.spelling_groups(docs, drop_every=199, bundle=bundle).collect())
    assert got == brute(rows)


def test_other_limits(spark):
    rows = variants(3)
    docs = awkward(spark, [(d, t, None) for d, t in rows])
    got = sorted(tuple(r) for r in spelling.spelling_groups(docs, least_chars=3, least_n=1, ratio=2, bundle=50).collect())
    assert got == brute(rows, 3, 1, 2, None)


def test_tied_forms_take_the_least_word_and_roots_chain(spark):
    text = "abcdef " * 5 + "abcdeg " * 25 + "abcdeh " * 25 + "abcdegg " * 125 + "zbcdegg " * 125 + "abcdeggg " * 700
    got = {r.word: (r.form, r.root) for r in spelling.spelling_groups(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got["abcdef"] == ("abcdeg", "abcdeggg") and got["abcdeh"] == (None, "abcdeh") and got["zbcdegg"] == (None, "zbcdegg")


def test_empty_table(spark):
    assert spelling.spelling_groups(awkward(spark, [])).collect() == []


def test_index_finds_all_and_only_near_entries():
    pick = random.Random(7)
    words = sorted({"".join(pick.choice("abÿ") for _ in range(pick.choice([6, 7]))) for _ in range(900)})
    letters = spelling._letters(words, 6)
    index = spelling.Index(letters, 6)
    got = set()
    for halves in (True, False):
        for q, e in index.pairs(letters, halves):
            new = set(zip(q.tolist(), e.tolist(), strict=True))
            assert not got & new
            got |= new
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b) and min(len(a), len(b)) == 6}
    assert got == want
    assert np.array_equal(index.bits(np.ones(len(words), bool)), index.all)
