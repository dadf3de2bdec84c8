"""Natural and horizontal visibility graphs of series of any length."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sensorloom.kernels import CHUNK_ROWS, IDX, attach, names
from sensorloom.nearest import nearest_higher
from sensorloom.session import settle, tuning

LEAF_ROWS = tuning("LEAF_ROWS", 2048)
FAN = tuning("LEAF_FAN", 32)

_LONGS, _DOUBLES = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
_SKETCH = ("hx", "hy", "ox", "oy")


def horizontal_visibility(df: DataFrame, series, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Edges ``(series…, src, dst)``, src < dst, between rows with only lower rows in between."""
    by = names(series)
    ahead = nearest_higher(df, by, value, chunk_rows=chunk_rows).where("target IS NOT NULL")
    back = nearest_higher(df, by, value, forward=False, chunk_rows=chunk_rows).where("target IS NOT NULL")
    edges = ahead.select(*by, F.col(IDX).alias("src"), F.col("target").alias("dst"))
    return edges.unionByName(back.select(*by, F.col("target").alias("src"), F.col(IDX).alias("dst"))).distinct()


def upper_hull(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the upper convex hull of points sorted by x.

    Every round drops all points on or below the chord of their neighbours (none of which is a corner) until none is left; where rounding could
    decide, the sign comes from exact fractions.
    """
    while len(x) > 2:
        a, b, c = (slice(None, -2), slice(1, -1), slice(2, None))
        left, right = (y[b] - y[a]) * (x[c] - x[a]), (y[c] - y[a]) * (x[b] - x[a])
        below = left < right
        unsure = np.flatnonzero(np.abs(left - right) <= 1e-14 * (np.abs(y[a]) + np.abs(y[b]) + np.abs(y[c])) * (x[c] - x[a]))
        level = (y[a] == y[b]) & (y[b] == y[c])
        below |= level
        for k in unsure[~level[unsure]].tolist():
            (xa, ya), (xb, yb), (xc, yc) = ((Fraction(x[k + j]), Fraction(y[k + j])) for j in range(3))
            below[k] = (yb - ya) * (xc - xa) <= (yc - ya) * (xb - xa)
        if not below.any():
            break
        # of a run of points exactly on one line all go at once, since the ends of the run stay
        keep = np.r_[True, ~below, True]
        x, y = x[keep], y[keep]
    return x, y


def thinned(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the points, both ends among them."""
    if len(x) <= most:
        return x, y
    at = np.unique(np.linspace(0, len(x) - 1, most).round().astype(int))
    return x[at], y[at]


def enclosed(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` points whose chain runs nowhere below a hull: its ends, and where the lines of some of its edges meet."""
    if len(x) <= most:
        return x, y
    edge = np.unique(np.linspace(0, len(x) - 2, most - 1).round().astype(int))
    slope = (y[edge + 1] - y[edge]) / (x[edge + 1] - x[edge])
    one, two = edge[:-1], edge[1:]
    drop = slope[:-1] - slope[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (y[two] - slope[1:] * x[two] - y[one] + slope[:-1] * x[one]) / drop
    at = np.clip(np.where(np.isfinite(at), at, x[two]), x[one + 1], x[two])
    height = np.maximum(y[one] + slope[:-1] * (at - x[one]), y[two] + slope[1:] * (at - x[two]))
    height += 4e-16 * (np.abs(y).max() + np.abs(slope[:-1]) * (at - x[one]))
    return np.r_[x[0], at, x[-1]], np.r_[y[0], height, y[-1]]


def _steepest(i: np.ndarray, y: np.ndarray, hx, hy) -> np.ndarray:
    """Steepest slope from each point to a chain on its right."""
    hx, hy = np.asarray(hx), np.asarray(hy)
    return np.concatenate([((hy[None, :] - y[k : k + 512, None]) / (hx[None, :] - i[k : k + 512, None])).max(axis=1) for k in range(0, len(i), 512)])


def _sketched(points: tuple, outline: tuple, most: int) -> dict[str, np.ndarray]:
    hull, outer = upper_hull(*points), upper_hull(*outline)
    return dict(zip(_SKETCH, (*thinned(*hull, most), *enclosed(*outer, most)), strict=True))


def _ladder(leaves: DataFrame, by: list[str], fan: int, most: int) -> list[DataFrame]:
    """Tables of parent nodes, level 1 upwards: children with their sketches, ``most`` points each, so a row never holds more than a leaf."""
    sketch = T.StructType([T.StructField(c, _DOUBLES) for c in _SKETCH])

    @F.pandas_udf(sketch)
    def merged(children: pd.Series) -> pd.DataFrame:
        both = [[np.concatenate([c[f] for c in row]) for f in _SKETCH] for row in children]
        return pd.DataFrame([_sketched(b[:2], b[2:], most) for b in both], columns=_SKETCH)

    levels, current = [], leaves.select(*by, F.col("_leaf").alias("node"), *_SKETCH)
    while True:
        grouped = current.groupBy(*by, F.floor(F.col("node") / fan).cast("bigint").alias("_up")).agg(
            F.array_sort(F.collect_list(F.struct("node", *_SKETCH))).alias("children"))
        table = settle(grouped.withColumn("_h", merged("children")).select(*by, F.col("_up").alias("node"), "children", "_h.*"))
        levels.append(table)
        if (table.agg(F.max("node")).first()[0] or 0) == 0:
            return levels
        current = table.select(*by, "node", *_SKETCH)


def _beyond(x: np.ndarray, y: np.ndarray, best: np.ndarray, children) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Children in order that some points may see, with those points and the steepest slope known before; ``best`` goes on rising."""
    for child in children:
        open_rows = np.flatnonzero(_steepest(x, y, child["ox"], child["oy"]) > best)
        if len(open_rows):
            yield int(child["node"]), open_rows, best[open_rows].copy()
        np.maximum(best, _steepest(x, y, child["hx"], child["hy"]), out=best)


def _inside_plain(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    best, src, dst = np.full(len(x), -np.inf), [], []
    for i in range(len(x) - 1):
        slope = (y[i + 1 :] - y[i]) / (x[i + 1 :] - x[i])
        before = np.r_[-np.inf, np.maximum.accumulate(slope)[:-1]]
        seen = np.flatnonzero(slope > before)
        src.append(np.full(len(seen), i))
        dst.append(seen + i + 1)
        best[i] = slope.max()
    none = np.zeros(0, int)
    return np.concatenate(src or [none]), np.concatenate(dst or [none]), best


def _inside(x: np.ndarray, y: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Visible pairs among the rows of one leaf, and every row's steepest slope to the rows after it.

    Rows of one block are compared at once.  A row enters a later block only where the slope to the block's highest value, seen at its
    nearer end (its farther one when it lies below), beats the steepest slope before; rounding keeps that order, so nothing is lost.
    """
    if not np.isfinite(y).all():
        return _inside_plain(x, y)
    n, count = len(x), -(-len(x) // block)
    xs = np.r_[x, x[-1:] + np.arange(1, count * block - n + 1)].reshape(count, block)
    ys = np.r_[y, np.full(count * block - n, -np.inf)].reshape(count, block)
    later = np.triu(np.ones((block, block), bool), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(later, (ys[:, None, :] - ys[:, :, None]) / (xs[:, None, :] - xs[:, :, None]), -np.inf)
    slope[np.isnan(slope)] = -np.inf  # only what filled up the last block
    most = np.maximum.accumulate(slope, axis=2)
    which, i, j = np.nonzero(slope[:, :, 1:] > most[:, :, :-1])
    src, dst, best = [which * block + i], [which * block + j + 1], most[:, :, -1].reshape(-1)[:n].copy()
    top = ys.max(axis=1)
    for k in range(1, count):
        start = k * block
        cx, cy = x[start : start + block], y[start : start + block]
        rise = top[k] - y[:start]
        at = np.flatnonzero(rise / (np.where(rise >= 0, cx[0], cx[-1]) - x[:start]) > best[:start])
        if len(at):
            slope = (cy[None, :] - y[at, None]) / (cx[None, :] - x[at, None])
            most = np.maximum.accumulate(np.c_[best[at], slope], axis=1)
            i, j = np.nonzero(slope > most[:, :-1])
            src.append(at[i])
            dst.append(start + j)
            best[at] = most[:, -1]
    return np.concatenate(src), np.concatenate(dst), best


def natural_visibility(df: DataFrame, series, value: str, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> DataFrame:
    """Edges ``(series…, src, dst)`` between rows whose chord clears every row in between.

    Row i sees j when the slope i→j beats every slope to rows in between.  Small leaves are solved directly.  Leaves form a tree; a node
    is known by a sketch of at most ``leaf_rows / fan`` points: some rows on its upper hull, which give a slope that is really
    reached, and a chain around the hull, which gives one that nobody exceeds.  Beyond its leaf a row goes through the siblings on its right, level by level,
    and enters those whose chain beats the steepest slope known before.  What it finds in leaves is compared once more in order, so
    the result is exact whatever the sketches leave open.  No row of any table holds more than one leaf and one level of siblings, each of at most ``leaf_rows`` points.
    """
    by = names(series)
    key_fields = [df.schema[s] for s in by]
    most = max(3, leaf_rows // fan)
    rows = df.where(F.col(value).isNotNull()).select(
        *by, F.floor(F.col(IDX) / leaf_rows).cast("bigint").alias("_leaf"), IDX, F.col(value).cast("double").alias("y"))
    packed = rows.groupBy(*by, "_leaf").agg(F.array_sort(F.collect_list(F.struct(IDX, "y"))).alias("_p"))
    packed = packed.select(*by, "_leaf", F.transform("_p", lambda p: p[IDX].cast("double")).alias("x"), F.transform("_p", lambda p: p["y"]).alias("y"))

    solved = T.StructType([
        *key_fields, T.StructField("_leaf", T.LongType()), *[T.StructField(c, _DOUBLES) for c in ("x", "y", "best", *_SKETCH)],
        T.StructField("src", _LONGS), T.StructField("dst", _LONGS)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x, y = np.asarray(row["x"]), np.asarray(row["y"])
                src, dst, best = _inside(x, y)
                found = {"best": best, **_sketched((x, y), (x, y), most), "src": x[src].astype("int64"), "dst": x[dst].astype("int64")}
                yield pd.DataFrame([{**row, **found}])

    leaves = settle(packed.mapInPandas(solve, solved))
    near = leaves.select(*by, F.explode(F.arrays_zip("src", "dst")).alias("_e")).select(*by, "_e.src", "_e.dst")
    levels = _ladder(leaves, by, fan, most)

    # rows of one leaf that look at a node: positions, values, and the steepest slope on the way to it; node null: the leaf's own rows
    look = T.StructType([*key_fields, T.StructField("_leaf", T.LongType()), T.StructField("node", T.LongType()), *[T.StructField(c, _DOUBLES) for c in ("x", "y", "best")]])

    def pick(frame: dict, node, x, y, best) -> pd.DataFrame:
        return pd.DataFrame([{**{k: frame[k] for k in (*by, "_leaf")}, "node": node, "x": x, "y": y, "best": best}]).astype({"node": "Int64"})

    def look_right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x, y, best = (np.array(row[c]) for c in ("x", "y", "best"))
                for node, at, before in _beyond(x, y, best, row["children"]):
                    yield pick(row, node, x[at], y[at], before)
                yield pick(row, None, x, y, best)

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                x, y, best = (np.array(row[c]) for c in ("x", "y", "best"))
                for node, at, before in _beyond(x, y, best, row["children"]):
                    yield pick(row, node, x[at], y[at], before)

    state, found = leaves.select(*by, "_leaf", "x", "y", "best"), []
    for depth, table in enumerate(levels):
        own = F.floor(F.col("_leaf") / F.lit(fan**depth)).cast("bigint")
        siblings = table.select(*by, F.col("node").alias("_up"), "children")
        work = attach(state.withColumn("_up", F.floor(F.col("_leaf") / F.lit(fan ** (depth + 1))).cast("bigint")), siblings, [*by, "_up"])
        work = work.withColumn("children", F.filter("children", lambda c: c["node"] > own)).drop("_up")
        met = settle(work.mapInPandas(look_right, look))
        state = met.where("node IS NULL").drop("node")
        found.append(met.where("node IS NOT NULL"))

    def land(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                tx, ty = np.asarray(row["tx"]), np.asarray(row["ty"])
                x, y, known = (np.asarray(row[c]) for c in ("x", "y", "best"))
                for k in range(0, len(x), 256):
                    part = slice(k, k + 256)
                    slope = (ty[None, :] - y[part, None]) / (tx[None, :] - x[part, None])
                    before = np.maximum.accumulate(slope, axis=1)[:, :-1]
                    before = np.maximum(np.c_[np.full(len(slope), -np.inf), before], known[part, None])
                    at, seen = np.nonzero(slope > before)
                    cuts = np.flatnonzero(np.diff(at, prepend=-1))
                    if len(at):
                        yield pd.DataFrame({
                            **{c: row[c] for c in by}, "src": x[part][at[cuts]].astype("int64"), "node": row["node"],
                            "dst": np.split(tx[seen].astype("int64"), cuts[1:]), "slope": np.split(slope[at, seen], cuts[1:])})

    pending = None
    for depth in range(len(levels) - 1, -1, -1):
        pending = found[depth] if pending is None else found[depth].unionByName(pending)
        if depth > 0:
            pending = settle(attach(pending, levels[depth - 1].select(*by, "node", "children"), [*by, "node"]).mapInPandas(descend, look))
    targets = leaves.select(*by, F.col("_leaf").alias("node"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    landed = T.StructType([*key_fields, T.StructField("src", T.LongType()), T.StructField("node", T.LongType()), T.StructField("dst", _LONGS), T.StructField("slope", _DOUBLES)])
    far = attach(pending, targets, [*by, "node"]).mapInPandas(land, landed)
    # one row per (row, leaf) that it reaches into: the steepest slopes of the leaves before settle what the sketches left open
    before = Window.partitionBy(*by, "src").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    far = far.withColumn("_known", F.max(F.array_max("slope")).over(before))
    far = far.select(*by, "src", F.explode(F.filter(F.arrays_zip("dst", "slope"), lambda e: F.col("_known").isNull() | (e["slope"] > F.col("_known")))).alias("_e"))
    return near.unionByName(far.select(*by, "src", F.col("_e.dst").alias("dst")))


def edge_weights(edges: DataFrame, df: DataFrame, series, value: str) -> DataFrame:
    """Adds ``weight``: Euclidean distance between the two points (index, value)."""
    by = names(series)
    points = df.select(*by, F.col(IDX).alias("src"), F.col(value).cast("double").alias("_a"))
    rows = attach(edges, points, [*by, "src"])
    rows = attach(rows, points.select(*by, F.col("src").alias("dst"), F.col("_a").alias("_b")), [*by, "dst"])
    gap, rise = F.col("dst") - F.col("src"), F.col("_b") - F.col("_a")
    return rows.withColumn("weight", F.sqrt(gap * gap + rise * rise)).drop("_a", "_b")
