"""Near-duplicate vectors: int8 tile products with rigorous error bounds, full precision only where they leave doubt."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.blocks import long_key, shuffle_partitions
from sensorloom.llm.components import components, merged
from sensorloom.session import settle

THRESHOLD = 0.9
TILE = 1024
CENTRES = 1024
SAMPLE = 16_384
SAMPLE_BYTES = 32 << 20
BLOCK_BYTES = 16 << 20
LEAST_BLOCK = 1024
PAIRS = 1 << 16
HOT = 10_000
_EXACT = 1024  # products of so many int8 pairs are whole numbers below 2^24, which float32 holds exactly
_SLACK = 1e-6  # more than float32 scaling of a product can round away


def _packed(kind: type):
    """Bytes of every usable vector and their digest; a null, zero or non-finite one has none."""

    def run(batches):
        for batch in batches:
            raw = []
            for x in batch["_vec"]:
                v = None if x is None else np.asarray(x, dtype=np.float64)
                ok = v is not None and len(v) and np.isfinite(v).all() and v.any()
                raw.append(v.astype(kind).tobytes() if ok else None)
            yield pd.DataFrame({"_id": batch["_id"], "_key": batch["_key"], "_raw": pd.Series(raw, dtype=object)})

    return run


def unit_rows(blobs, kind: type, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length in double precision, padded with zeros to ``width``; their lengths before, and their numbers of components."""
    size = np.array([len(b) for b in blobs]) // np.dtype(kind).itemsize
    out = np.zeros((len(blobs), width))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        out[at, :n] = np.frombuffer(b"".join(bytes(blobs[i]) for i in at), kind).reshape(len(at), n)
    top = np.abs(out).max(axis=1, keepdims=True)  # scaled first: squares of very large or small components stay in range
    out /= np.where(top > 0, top, 1)
    length = np.linalg.norm(out, axis=1)
    out /= np.where(length > 0, length, 1)[:, None]
    return out, length, size


class Quantised:
    """Int8 codes of unit rows: ``u = scale * code + error``, with the exact length of ``error`` and of ``scale * code``."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.scale = np.abs(unit).max(axis=1, initial=0) / 127
        self.code = np.rint(unit / np.where(self.scale > 0, self.scale, 1)[:, None]).astype(np.int8)
        back = self.code * self.scale[:, None]
        self.error = np.linalg.norm(unit - back, axis=1) * (1 + 1e-9) + 1e-12
        self.length = np.linalg.norm(back, axis=1) * (1 + 1e-9)


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of int8 rows, exactly."""
    if a.shape[1] <= _EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].astype(np.float32).T).astype(np.float64) for k in range(0, a.shape[1], _EXACT))


def near_pairs(q: Quantised, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows ``a`` and ``b`` whose cosine reaches the threshold.

    With u = s p + e and v = t r + f, u.v - s t p.r = s p.f + e.v, so the product of codes is off by at most |s p| |f| + |e|.  Pairs below the threshold by
    more than that are out, pairs above by more are in, and the rest is decided by the product of the double-precision rows.
    """
    product = tile_products(q.code[a], q.code[b])
    product *= q.scale[a].astype(product.dtype)[:, None]
    product *= q.scale[b].astype(product.dtype)[None, :]
    widest = q.length[a].max() * q.error[b].max() + q.error[a].max()
    first, second = np.nonzero(product >= threshold - widest - _SLACK)
    near = product[first, second].astype(np.float64)
    first, second = a[first], b[second]
    off = q.length[first] * q.error[second] + q.error[first] + _SLACK
    link = near - off >= threshold
    doubt = np.flatnonzero(~link & (near + off >= threshold))
    for k in range(0, len(doubt), PAIRS):
        i = doubt[k : k + PAIRS]
        link[i] = np.einsum("ij,ij->i", q.unit[first[i]], q.unit[second[i]]) >= threshold
    return first[link], second[link]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _centre(unit: np.ndarray) -> tuple[np.ndarray, float]:
    """Mean direction of some rows and the widest angle from it."""
    mean = unit.sum(axis=0)
    length = np.linalg.norm(mean)
    mean = mean / length if length > 1e-9 else unit[0]
    return mean, float(_angles(unit, mean[None, :]).max())


def _compared(kind: type, width: int, threshold: float):
    """Links between two blocks of vectors, or inside one: per vector their number and the least vector that they connect it to."""
    reach = math.acos(min(1.0, threshold)) + 1e-7

    def run(task: pd.DataFrame) -> pd.DataFrame:
        task = task.sort_values(["_unit", "_tile", "_node"])
        unit, _, size = unit_rows(task["_raw"].tolist(), kind, width)
        q, side, tile = Quantised(unit), task["_unit"].to_numpy(), task["_tile"].to_numpy()
        node, weight = task["_node"].to_numpy(), task["_n"].to_numpy()
        edges = np.flatnonzero(np.diff(side, prepend=-1) | np.diff(tile, prepend=-1) | np.diff(size, prepend=-1))
        tiles = [np.arange(k, min(k + TILE, end)) for start, end in zip(edges, [*edges[1:], len(side)], strict=True) for k in range(start, end, TILE)]
        centres = [_centre(unit[t]) for t in tiles]
        apart = _angles(np.array([c for c, _ in centres]), np.array([c for c, _ in centres]))
        one = side[0] == side[-1]
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for i, a in enumerate(tiles):
            for j in range(i, len(tiles)):
                b = tiles[j]
                if size[a[0]] != size[b[0]] or not one and side[a[0]] == side[b[0]]:
                    continue
                if i != j and apart[i, j] - centres[i][1] - centres[j][1] > reach:
                    continue
                first, second = near_pairs(q, a, b, threshold)
                if i == j:
                    first, second = first[first < second], second[first < second]
                if len(first):
                    links += np.bincount(first, weight[second], len(links)).astype(np.int64) + np.bincount(second, weight[first], len(links)).astype(np.int64)
                    root = merged(root, first, second)
        found = np.flatnonzero(links)
        return pd.DataFrame({"_node": node[found], "_links": links[found], "_root": node[root[found]]})

    return run


def _centres(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Directions that tiles gather around: two rounds of spherical k-means from evenly spread members of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, wanted).astype(int)]
    for _ in range(2):
        near = np.concatenate([(sample[k : k + 4096] @ centres.T).argmax(axis=1) for k in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        length = np.linalg.norm(total, axis=1)
        centres = np.where(length[:, None] > 1e-9, total / np.maximum(length, 1e-12)[:, None], centres)
    return centres


def _assigned(kind: type, width: int, centres: np.ndarray):
    def run(batches):
        for batch in batches:
            unit = unit_rows(batch["_raw"].tolist(), kind, width)[0]
            cosine = unit @ centres.T
            tile = cosine.argmax(axis=1) if len(unit) else np.zeros(0, int)
            yield batch.assign(_tile=tile, _angle=np.arccos(np.clip(cosine[np.arange(len(tile)), tile], -1, 1)))

    return run


def _cells(tiles: dict[int, tuple[int, float]], centres: np.ndarray, block: int, reach: float) -> list[tuple[int, int, int, list[int], list[int]]]:
    """``(tile, cell, parts, partner cells, parts of each)`` for every tile: cells hold neighbouring tiles up to ``block`` rows, a larger tile is cut into parts.

    Cells none of whose tiles come within reach of each other are no partners.
    """
    used = sorted(tiles)
    axis = np.linalg.svd(centres[used] - centres[used].mean(axis=0), full_matrices=False)[2][0]
    order = [used[i] for i in np.argsort(centres[used] @ axis, kind="stable")]
    cells, held = [[]], 0
    for t in order:
        if cells[-1] and held + tiles[t][0] > block:
            cells.append([])
            held = 0
        cells[-1].append(t)
        held += tiles[t][0]
    cell = {t: c for c, ts in enumerate(cells) for t in ts}
    parts = [max(1, -(-sum(tiles[t][0] for t in ts) // block)) for ts in cells]
    radius = np.array([tiles[t][1] for t in used])
    near = _angles(centres[used], centres[used]) - radius[:, None] - radius[None, :] <= reach
    near |= np.eye(len(used), dtype=bool)
    of = np.array([cell[t] for t in used])
    met = np.zeros((len(cells), len(cells)), bool)
    met[of[np.nonzero(near)[0]], of[np.nonzero(near)[1]]] = True
    return [(t, cell[t], parts[cell[t]], np.flatnonzero(met[cell[t]]).tolist(), [parts[p] for p in np.flatnonzero(met[cell[t]])]) for t in used]


def near_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES, least_block: int = LEAST_BLOCK) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row: other vectors of at least ``threshold`` cosine, and the least id reachable by such links.

    Equal vectors are compared once.  Vectors gather in tiles around directions fitted on at most ``sample`` of them (and ``SAMPLE_BYTES``); the sample only
    decides which vectors lie together.  Neighbouring tiles form blocks of about ``block_bytes``, and every two blocks meet in one task, but for those whose tiles are
    farther apart than the threshold's angle and their radii.  There, tiles that are too far apart are skipped in the same way, the others multiplied as int8 codes with an error bound for
    every vector; only pairs that the bound leaves open are multiplied in double precision (:func:`near_pairs`).  No pairs are listed: a task returns each
    vector's number of links and one vector it is connected to.  All skips are exact; where directions do not cluster, the work is the square of the number of different vectors.

    Null, zero, empty and non-finite vectors (or such with null components) link with nothing; vectors of different length never link.  Rows without an id have a null
    id and count as the lowest; repeated rows are vectors of their own; an empty table gives an empty one.  ``kept`` is true where the id is that of its component.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    id_type, vec_type = dict(vectors.dtypes)[key], dict(vectors.dtypes)[vector]
    kind = np.float32 if vec_type == "array<float>" else np.float64
    rows = vectors.select(F.col(key).alias("_id"), long_key(F.col(key)).alias("_key"), F.col(vector).cast("array<double>").alias("_vec"))
    rows = rows.mapInPandas(_packed(kind), f"_id {id_type}, _key long, _raw binary")
    every = settle(rows.withColumn("_same", F.unhex(F.sha2("_raw", 256))))
    classes = every.where("_raw IS NOT NULL").groupBy("_same").agg(F.min("_key").alias("_rep"), F.count(F.lit(1)).alias("_n"), F.first("_raw").alias("_raw"))
    classes = settle(classes.withColumn("_node", F.monotonically_increasing_id()))  # numbers are fixed once written
    n, total, widest = classes.agg(F.count(F.lit(1)), F.sum("_n"), F.max(F.octet_length("_raw"))).first()
    named = every.select(F.col("_id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return named

    width, reach = widest // np.dtype(kind).itemsize, math.acos(threshold) + 1e-7
    drawn = classes.orderBy(F.xxhash64("_same"), "_same").limit(max(1, min(sample, SAMPLE_BYTES // (8 * width)))).select("_raw").collect()
    drawn = unit_rows([r["_raw"] for r in drawn], kind, width)[0]
    centres = _centres(drawn, int(min(CENTRES, -(-n // (2 * TILE)), -(-len(drawn) // 8))))
    placed = settle(classes.select("_node", "_n", "_raw").mapInPandas(_assigned(kind, width, centres), "_node long, _n long, _raw binary, _tile int, _angle double"))
    tiles = {r["_tile"]: (r["n"], r["r"] + 1e-7) for r in placed.groupBy("_tile").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("r")).collect()}
    block = int(min(max(1, block_bytes // widest), max(least_block, n // 8)))
    cells = vectors.sparkSession.createDataFrame(_cells(tiles, centres, block, reach), "_tile int, _cell int, _parts int, _near array<int>, _near_parts array<int>")

    unit = lambda cell, part: cell.cast("bigint") * F.lit(1 << 32) + part
    met = placed.join(cells, "_tile").withColumn("_part", F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int"))
    met = met.select("_node", "_n", "_raw", "_tile", unit(F.col("_cell"), F.col("_part")).alias("_unit"), F.explode(F.arrays_zip("_near", "_near_parts")).alias("_with"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_with._near_parts") - 1)))
    other = unit(F.col("_with._near"), F.col("_other"))
    met = met.select("_node", "_n", "_raw", "_tile", "_unit", F.least("_unit", other).alias("_a"), F.greatest("_unit", other).alias("_b"))
    links = settle(met.groupBy("_a", "_b").applyInPandas(_compared(kind, width, threshold), "_node long, _links long, _root long"))

    roots = components(links.select(F.col("_node").alias("a"), F.col("_root").alias("b"))).withColumnRenamed("node", "_node")
    counted = links.groupBy("_node").agg(F.sum("_links").alias("_links"))
    grouped = classes.select("_node", "_same", "_rep", "_n").join(counted, "_node", "left").join(roots, "_node", "left").select(
        "_same", "_rep", "_n", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_links"), F.coalesce("root", "_node").alias("_root")
    )
    grouped = settle(grouped)
    least = grouped.groupBy("_root").agg(F.min("_rep").alias("_least"))
    grouped = grouped.join(least, "_root").select("_same", "_n", "_links", "_least")

    # a vector that very many rows repeat meets them in several tasks; so many are few, and all that is told about them are their digests
    hot = max(HOT, total // (4 * shuffle_partitions(vectors)))
    often = [r["_same"] for r in classes.where(F.col("_n") >= hot).select("_same").collect()]
    salts = 64 if often else 1
    is_hot = F.col("_same").isin(often) if often else F.lit(False)
    left = every.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64("_key"), F.lit(salts)).cast("int")).otherwise(0))
    right = grouped.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    found = left.join(right, ["_same", "_salt"], "left")
    low = F.lit(-(2**63))
    own = F.when(F.col("_same").isNull(), F.col("_key")).otherwise(F.col("_least"))
    return found.select(
        F.col("_id").alias(key), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(own != low, own).alias("component_id"), (F.col("_key") == own).alias("kept"),
    )
