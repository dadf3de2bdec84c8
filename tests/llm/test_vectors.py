import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import vectors
from sensorloom.llm.components import merged


def brute(rows, threshold=0.9):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        x = x / np.abs(x).max()
        return x / np.linalg.norm(x)

    low = lambda d: -(2**63) if d is None else d
    units, links, root = [unit(v) for _, v in rows], [0] * len(rows), list(range(len(rows)))
    for i, u in enumerate(units):
        for j in range(i):
            v = units[j]
            if u is not None and v is not None and len(u) == len(v) and u @ v >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {r: min(low(d) for (d, _), q in zip(rows, root, strict=True) if q == r) for r in set(root)}
    return sorted(((d, n, None if least[r] == -(2**63) else least[r], low(d) == least[r]) for (d, _), n, r in zip(rows, links, root, strict=True)), key=repr)


def clustered(n=60, width=16, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n):
        base = rng.standard_normal(width)
        for _ in range(rng.integers(1, 9)):
            noise = rng.standard_normal(width) * rng.choice([0, 0.05, 0.2, 0.35, 0.5])
            rows.append(((base + noise) * rng.choice([1e-3, 1, 50])).astype(np.float32).tolist())
    order = rng.permutation(len(rows))
    rows = [(int(k) + 10, rows[i]) for k, i in enumerate(order)]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[3][1]), (9000, None), (9001, [0.0] * width), (9002, [float("nan")] * width), (9003, [1.0, None, *[0.0] * (width - 2)])]
    rows += [(9004, []), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9007, [float("inf")] * width), (None, None), (9008, [-x for x in rows[0][1]])]
    return rows


def framed(spark, rows, kind="float"):
    extra = {c: F.lit(7) for c in ("label", "_id", "_key", "_raw", "_node", "kept", "n_links")}
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns(extra)


@pytest.mark.parametrize(("sample", "block", "kind"), [(16_384, 1024, "float"), (64, 20, "double")])
def test_equals_brute_force(spark, monkeypatch, sample, block, kind):
    monkeypatch.setattr(vectors, "HOT", 3)
    rows = clustered()
    got = sorted((tuple(r) for r in vectors.near_vectors(framed(spark, rows, kind), sample=sample, block_bytes=block * 64, least_block=block).collect()), key=repr)
    assert got == brute(rows)


def test_many_tiles_and_skips(monkeypatch):
    """Small tiles: every pair is found once, whatever is skipped."""
    import pandas as pd

    monkeypatch.setattr(vectors, "TILE", 8)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 8))
    x = np.concatenate([b + rng.standard_normal((k % 7 + 1, 8)) * 0.15 for k, b in enumerate(base)]).astype(np.float32)
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    run = vectors._compared(np.float32, 8, 0.9)
    frame = pd.DataFrame({"_node": np.arange(len(x)), "_n": 1, "_raw": [r.tobytes() for r in x], "_tile": np.repeat(np.arange(30), [k % 7 + 1 for k in range(30)]), "_unit": 0})
    got = run(frame).set_index("_node")["_links"]
    assert got.to_dict() == {i: int(s) for i, s in enumerate(link.sum(axis=1)) if s}
    frame["_unit"] = frame["_node"] % 2
    across = link & (frame["_unit"].to_numpy()[:, None] != frame["_unit"].to_numpy()[None, :])
    got = run(frame).set_index("_node")["_links"]
    assert got.to_dict() == {i: int(s) for i, s in enumerate(across.sum(axis=1)) if s}


def test_cells_that_are_far_apart_do_not_meet():
    centres = np.eye(3)
    near = vectors._cells({0: (10, 0.1), 1: (10, 0.1), 2: (25, 1.3)}, centres, 10, 0.45)
    met = {t: sorted(p) for t, _, _, p, _ in near}
    cell = {t: c for t, c, _, _, _ in near}
    assert cell[1] not in met[0] and cell[2] in met[0] and cell[2] in met[1] and cell[0] in met[0]
    assert {t: k for t, _, k, _, _ in near} == {0: 1, 1: 1, 2: 3}


@pytest.mark.parametrize("width", [3, 64, 3000])
def test_bounds_hold_and_pairs_are_exact(width):
    rng = np.random.default_rng(width)
    x = rng.standard_normal((80, width))
    x = np.concatenate([x, x[:40] + rng.standard_normal((40, width)) * 0.48, x[:2] * 3])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = vectors.Quantised(unit)
    every = np.arange(len(x))
    product = vectors.tile_products(q.code, q.code)
    assert (product == q.code.astype(np.int64) @ q.code.astype(np.int64).T).all()
    off = q.length[:, None] * q.error[None, :] + q.error[:, None]
    assert (np.abs(product * q.scale[:, None] * q.scale[None, :] - unit @ unit.T) <= off).all()
    first, second = vectors.near_pairs(q, every, every, 0.9)
    want = np.nonzero(np.einsum("ik,jk->ij", unit, unit) >= 0.9)
    assert set(zip(first.tolist(), second.tolist())) == set(zip(want[0].tolist(), want[1].tolist()))


def test_empty_and_only_unusable(spark):
    assert vectors.near_vectors(framed(spark, [])).collect() == []
    assert [tuple(r) for r in vectors.near_vectors(framed(spark, [(3, None)])).collect()] == [(3, 0, 3, True)]


def test_merged_labels():
    root = merged(np.arange(8), np.array([6, 5, 2]), np.array([5, 2, 7]))
    assert root.tolist() == [0, 1, 2, 3, 4, 2, 2, 2]
    assert merged(root, np.array([7, 0]), np.array([0, 3])).tolist() == [0, 1, 0, 0, 4, 0, 0, 0]
