"""Shared building blocks for ordered data.

Every ordered operator works on rows ``(series…, idx, …)`` where ``idx`` is the
dense 0-based position inside the series.  Windows never run over a whole
series: they run over *chunks* ``(series…, idx div C)`` of bounded size, with
either a halo (bounded frames) or a carry (prefix scans) taken from the chunks
before.  One series may therefore hold most of the data without any task having
to hold that series.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from sensorloom.session import settle, tuning

CHUNK_ROWS = tuning("CHUNK_ROWS", 100_000)
IDX = "idx"
NEVER_NULL = {IDX, "_chunk", "_part", "_super", "_one"}
_START = Window.unboundedPreceding


def names(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def attach(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches null keys and keeps one copy of them.

    Positions (``idx``, ``_chunk``, ``_part`` …) are never null and join by plain equality.
    Numbers come first among the join's keys: Spark sorts by them as they are, and by text only where they are equal.
    """
    keys = names(keys)
    if not keys:
        keys = ["_one"]
        left, right = left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1))
        return attach(left, right, keys, how).drop("_one")
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    kinds = dict(left.dtypes)
    condition = reduce(
        lambda a, b: a & b,
        [F.col(k) == F.col(f"_right_{k}") if k in NEVER_NULL else F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in sorted(keys, key=lambda k: kinds[k] not in ("bigint", "int"))],
    )
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def attach_stats(df: DataFrame, stats: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Give every row the statistics of its group.

    ``stats`` has one row per group; it is settled so that its true size decides
    between a broadcast and a shuffled join (where AQE splits a hot group).
    """
    return attach(df, settle(stats), keys, how)


# --------------------------------------------------------------------------- K1


def order_index(df: DataFrame, series: str | Sequence[str] | None, order: str | Sequence[str], out: str = IDX) -> DataFrame:
    """Dense 0-based position of every row inside its series, in ``order``.

    ``order`` must be unique inside a series (add tie-break columns).  The result
    is written once, since ordered operators scan their rows at least twice.
    They are range-partitioned on (series, order) and numbered from each
    partition's offset, so a series of any length is spread over many tasks.
    """
    series, order = names(series), names(order)
    keys = [*series, *order]
    placed = settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_mid", 33))
    runs = placed.groupBy(*series, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")
    )
    before = Window.partitionBy(*(series or [F.lit(1)])).orderBy("_part").rowsBetween(_START, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    runs = settle(runs.select(*series, "_part", "_base"))
    return (
        attach(placed, runs, [*series, "_part"])
        .withColumn(out, F.col("_mid") + F.col("_base"))
        .drop("_mid", "_part", "_base")
    )


def chunk_of(idx: str, rows: int) -> Column:
    return F.floor(F.col(idx) / F.lit(rows)).cast("bigint")


def chunk_window(series: Sequence[str], chunk: str = "_chunk", idx: str = IDX) -> WindowSpec:
    return Window.partitionBy(*series, chunk).orderBy(idx)


# --------------------------------------------------------------------------- K2


def framed(
    df: DataFrame,
    series: str | Sequence[str] | None,
    build: Callable[[WindowSpec], dict[str, Column] | Sequence[dict[str, Column]]],
    before: int = 0,
    after: int = 0,
    chunk_rows: int = CHUNK_ROWS,
    idx: str = IDX,
) -> DataFrame:
    """Window expressions whose frame reaches ``before`` rows back and ``after`` ahead.

    ``build`` receives the window (partition + order) and returns the new
    columns, or a list of such dicts to be added one after another.
    """
    series = names(series)
    size = max(chunk_rows, before, after, 1)
    home = chunk_of(idx, size)
    offset = F.col(idx) - home * size
    homes = [home]
    if before:
        homes.append(F.when(offset >= size - before, home + 1))
    if after:
        homes.append(F.when((offset < after) & (home > 0), home - 1))
    if len(homes) == 1:
        rows = df.withColumn("_chunk", home)
    else:
        rows = df.withColumn("_home", home).withColumn(
            "_chunk", F.explode(F.array_compact(F.array(*homes)))
        )
    steps = build(chunk_window(series, idx=idx))
    for step in [steps] if isinstance(steps, dict) else steps:
        rows = rows.select("*", *[c.alias(n) for n, c in step.items()])
    if len(homes) > 1:
        rows = rows.where(F.col("_chunk") == F.col("_home")).drop("_home")
    return rows.drop("_chunk")


# --------------------------------------------------------------------------- K3

SUPER_CHUNKS = tuning("SUPER_CHUNKS", 10_000)


def _running(totals: DataFrame, series: list[str], aggs: dict[str, Callable[[Column], Column]], backward: bool = False) -> DataFrame:
    """For every chunk the aggregate of each column over all chunks before it (after it, when ``backward``).

    ``aggs`` maps a column to its associative aggregate (sum, min, last non-null …).  Chunks are taken in groups of
    ``SUPER_CHUNKS``: a window inside each group, and one over the groups, so no window
    holds more than that many chunks of a series until there are 10^13 rows.  Output columns are ``_before_<column>``.
    """
    rows = totals.withColumn("_super", F.floor(F.col("_chunk") / SUPER_CHUNKS).cast("bigint"))
    turn = F.desc if backward else F.asc
    inside = Window.partitionBy(*series, "_super").orderBy(turn("_chunk"))
    whole = {c: f(F.col(c)).over(inside.rowsBetween(_START, Window.unboundedFollowing)) for c, f in aggs.items()}
    rows = rows.select(
        "*", *[f(F.col(c)).over(inside.rowsBetween(_START, -1)).alias(f"_in_{c}") for c, f in aggs.items()],
        *[w.alias(f"_all_{c}") for c, w in whole.items()], F.row_number().over(inside).alias("_k"),
    )
    over = Window.partitionBy(*(series or [F.lit(1)])).orderBy(turn("_super")).rowsBetween(_START, -1)
    groups = rows.where("_k = 1").select(*series, "_super", *[f(F.col(f"_all_{c}")).over(over).alias(f"_out_{c}") for c, f in aggs.items()])
    met = attach(rows, groups, [*series, "_super"])

    def both(c: str, f) -> Column:
        pair = F.array(F.col(f"_out_{c}"), F.col(f"_in_{c}"))
        kind = f.__name__
        if kind == "sum":
            return F.coalesce(F.col(f"_out_{c}") + F.col(f"_in_{c}"), f"_out_{c}", f"_in_{c}")
        return F.array_min(pair) if kind == "min" else F.coalesce(f"_in_{c}", f"_out_{c}")

    return met.select(*totals.columns, *[both(c, f).alias(f"_before_{c}") for c, f in aggs.items()])


def last_known(column: Column) -> Column:
    return F.last(column, ignorenulls=True)


def prefix_sums(
    df: DataFrame,
    series: str | Sequence[str] | None,
    sums: dict[str, Column],
    chunk_rows: int = CHUNK_ROWS,
    idx: str = IDX,
) -> DataFrame:
    """Inclusive running sums along the series: chunk totals, carry, in-chunk sum."""
    series = names(series)
    rows = df.withColumn("_chunk", chunk_of(idx, chunk_rows))
    for name, expr in sums.items():
        rows = rows.withColumn(f"_x_{name}", expr)
    totals = rows.groupBy(*series, "_chunk").agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    carry = _running(totals, series, {f"_t_{n}": F.sum for n in sums}).select(
        *series, "_chunk", *[F.coalesce(f"_before__t_{n}", F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    upto = chunk_window(series, idx=idx).rowsBetween(_START, 0)
    rows = attach(rows, carry, [*series, "_chunk"])
    rows = rows.select(
        "*",
        *[(F.col(f"_c_{n}") + F.coalesce(F.sum(f"_x_{n}").over(upto), F.lit(0))).alias(n) for n in sums],
    )
    return rows.drop("_chunk", *[f"_x_{n}" for n in sums], *[f"_c_{n}" for n in sums])


def carry_fill(
    df: DataFrame,
    series: str | Sequence[str] | None,
    fills: dict[str, str],
    backward: bool = False,
    chunk_rows: int = CHUNK_ROWS,
    idx: str = IDX,
    exclusive: bool = False,
) -> DataFrame:
    """Last (or, backward, next) non-null value at or before (after) each row, or strictly so if ``exclusive``.

    ``fills`` maps output column to input column.
    """
    series = names(series)
    rows = df.withColumn("_chunk", chunk_of(idx, chunk_rows))
    edge = F.min_by if backward else F.max_by
    ends = rows.groupBy(*series, "_chunk").agg(
        *[
            edge(F.col(src), F.when(F.col(src).isNotNull(), F.col(idx))).alias(f"_e_{out}")
            for out, src in fills.items()
        ]
    )
    carry = _running(ends, series, {f"_e_{o}": last_known for o in fills}, backward).select(
        *series, "_chunk", *[F.col(f"_before__e_{o}").alias(f"_c_{o}") for o in fills]
    )
    inside = Window.partitionBy(*series, "_chunk")
    inside = (inside.orderBy(F.desc(idx)) if backward else inside.orderBy(idx)).rowsBetween(_START, -1 if exclusive else 0)
    rows = attach(rows, carry, [*series, "_chunk"])
    rows = rows.select(
        "*",
        *[
            F.coalesce(F.last(src, ignorenulls=True).over(inside), F.col(f"_c_{out}")).alias(f"_f_{out}")
            for out, src in fills.items()
        ],
    )
    keep = [c for c in df.columns if c not in fills]
    return rows.select(*keep, *[F.col(f"_f_{o}").alias(o) for o in fills])


def reflected_walk(
    df: DataFrame,
    series: str | Sequence[str] | None,
    steps: dict[str, Column],
    chunk_rows: int = CHUNK_ROWS,
    idx: str = IDX,
) -> DataFrame:
    """``W = max(0, W_before + step)`` along the series, without a loop.

    Inside a chunk ``W = L - min(-W_in, running min L)`` with ``L`` the local
    prefix sum; ``W_in`` follows from the chunk totals and chunk minima alone.
    """
    series = names(series)
    rows = df.withColumn("_chunk", chunk_of(idx, chunk_rows))
    upto = chunk_window(series, idx=idx).rowsBetween(_START, 0)
    rows = rows.select("*", *[s.alias(f"_s_{n}") for n, s in steps.items()])
    rows = rows.select("*", *[F.sum(f"_s_{n}").over(upto).alias(f"_l_{n}") for n in steps])
    ends = rows.groupBy(*series, "_chunk").agg(
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in steps],
        *[F.min(f"_l_{n}").alias(f"_m_{n}") for n in steps],
    )
    carry = _running(ends, series, {f"_t_{n}": F.sum for n in steps}).select(
        *series, "_chunk", *[F.coalesce(f"_before__t_{n}", F.lit(0.0)).alias(f"_b_{n}") for n in steps],
        *[(F.coalesce(f"_before__t_{n}", F.lit(0.0)) + F.col(f"_m_{n}")).alias(f"_low_{n}") for n in steps],
    )
    carry = _running(carry, series, {f"_low_{n}": F.min for n in steps}).select(
        *series, "_chunk",
        *[(F.col(f"_b_{n}") - F.least(F.lit(0.0), F.coalesce(f"_before__low_{n}", F.lit(0.0)))).alias(f"_w_{n}") for n in steps],
    )
    rows = attach(rows, carry, [*series, "_chunk"])
    rows = rows.select(
        "*",
        *[
            (F.col(f"_l_{n}") - F.least(-F.col(f"_w_{n}"), F.min(f"_l_{n}").over(upto))).alias(n)
            for n in steps
        ],
    )
    return rows.drop("_chunk", *[f"_{p}_{n}" for n in steps for p in "slw"])


def decayed_sums(
    df: DataFrame,
    series: str | Sequence[str] | None,
    terms: dict[str, Column],
    decay: float,
    idx: str = IDX,
) -> DataFrame:
    """``Σ_j decay^(i-j) · term_j`` over all rows up to ``i``.

    Blocks are long enough for one block to fade the past by 1e-9, so three
    earlier block totals carry everything a double can hold; no sequential pass
    over blocks is needed.
    """
    series = names(series)
    if not 0.0 < decay < 1.0:
        raise ValueError("decay must lie strictly between 0 and 1")
    size = max(2, math.ceil(9 * math.log(10) / -math.log(decay)))
    block = chunk_of(idx, size)
    d = F.lit(decay)
    rows = df.withColumn("_chunk", block).withColumn("_pos", F.col(idx) - F.col("_chunk") * size)
    rows = rows.select("*", *[F.coalesce(e, F.lit(0.0)).alias(f"_x_{n}") for n, e in terms.items()])
    totals = rows.groupBy(*series, "_chunk").agg(
        *[F.sum(F.col(f"_x_{n}") * F.pow(d, F.lit(size - 1) - F.col("_pos"))).alias(f"_t_{n}") for n in terms]
    )
    reach = F.explode(F.array(*[F.struct(F.lit(m).alias("ahead"), F.lit(decay ** ((m - 1) * size)).alias("w")) for m in (1, 2, 3)]))
    carry = totals.withColumn("_reach", reach)
    carry = carry.groupBy(*series, (F.col("_chunk") + F.col("_reach.ahead")).alias("_chunk")).agg(
        *[F.sum(F.col(f"_t_{n}") * F.col("_reach.w")).alias(f"_c_{n}") for n in terms]
    )
    upto = chunk_window(series, idx=idx).rowsBetween(_START, 0)
    rows = attach(rows, carry, [*series, "_chunk"], "left")
    rows = rows.select(
        "*",
        *[
            (
                F.pow(d, F.col("_pos")) * F.sum(F.col(f"_x_{n}") * F.pow(d, -F.col("_pos"))).over(upto)
                + F.pow(d, F.col("_pos") + 1) * F.coalesce(F.col(f"_c_{n}"), F.lit(0.0))
            ).alias(n)
            for n in terms
        ],
    )
    return rows.drop("_chunk", "_pos", *[f"_{p}_{n}" for n in terms for p in "xc"])


# --------------------------------------------------------------------------- K4


def running_counts(counts: DataFrame, by: str | Sequence[str] | None, value: str, sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """Running sums of count columns over the distinct values of each group, in order, and the groups' totals.

    ``sums`` maps output to count column, ``totals`` likewise.  The values are range-partitioned and written once; a running sum is the
    sum inside the value's partition plus that of the partitions before it, of which there are as many as shuffle partitions.
    """
    by = names(by)
    keys = [*by, value]
    placed = settle(counts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    used = sorted({*sums.values(), *(totals or {}).values()})
    parts = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in used])
    group = Window.partitionBy(*(by or [F.lit(1)]))
    before = group.orderBy("_part").rowsBetween(_START, -1)
    parts = parts.select(
        *by, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sorted(set(sums.values()))],
        *[F.sum(f"_t_{c}").over(group).alias(out) for out, c in (totals or {}).items()],
    )
    upto = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(_START, 0)
    rows = attach(placed, parts, [*by, "_part"])
    rows = rows.select("*", *[(F.col(f"_b_{c}") + F.sum(c).over(upto)).alias(out) for out, c in sums.items()])
    return rows.drop("_part", *[f"_b_{c}" for c in sums.values()])


def quantiles(df: DataFrame, by: str | Sequence[str] | None, value: str, qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group: ``(by…, q array<double>)``.

    Rows are counted per value first (a hot value is one row), the values ranked by
    the distributed index and the wanted ranks picked by running counts.  A group
    without values has no row; ungrouped, an empty input gives an empty ``q``.
    """
    by, qs = names(by), [float(q) for q in qs]
    data = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = data.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_counts(counts, by, "_v", {"_upto": "_c"}, {"_n": "_c"})
    ordered, cells = sorted(enumerate(qs), key=lambda s: s[1]), len(qs)
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("p")) for i, q in ordered])
    if cells > 8:
        # of many quantiles only those in the cells of a grid that a value's ranks reach into, and one cell on either side, are looked at
        marks = [q for _, q in ordered]
        below, upto = (F.array(*[F.lit(side(marks, g / cells)) for g in range(cells + 1)]) for side in (bisect_left, bisect_right))
        span = F.greatest(F.col("_n") - 1, F.lit(1))
        first = F.greatest(F.floor((F.col("_upto") - F.col("_c") - 1) / span * cells) - 1, F.lit(0)).cast("int")
        last = F.least(F.ceil(F.col("_upto") / span * cells) + 1, F.lit(cells)).cast("int")
        start = F.when(first == 0, 0).otherwise(F.get(below, first))
        spots = F.slice(spots, start + 1, F.when(last == cells, cells).otherwise(F.get(upto, last)) - start)

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))

    def wanted(spot: Column) -> Column:
        return holds(F.floor(spot["p"] * (F.col("_n") - 1))) | holds(F.ceil(spot["p"] * (F.col("_n") - 1)))

    # few values hold a wanted rank; the others go before anything is multiplied
    ranked = ranked.withColumn("_spot", F.explode(F.filter(spots, wanted))).withColumn("_at", F.col("_spot.p") * (F.col("_n") - 1))
    low, high = F.floor("_at"), F.ceil("_at")
    picked = (
        ranked
        .groupBy(*by, F.col("_spot.i").alias("_i"))
        .agg(
            F.max(F.when(holds(low), F.col("_v"))).alias("_lo"),
            F.max(F.when(holds(high), F.col("_v"))).alias("_hi"),
            F.max(F.col("_at") - low).alias("_w"),
        )
    )
    picked = picked.withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w"))
    return picked.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias("q")
    )


def medians(df: DataFrame, by: str | Sequence[str] | None, value: str, out: str) -> DataFrame:
    by = names(by)
    return quantiles(df, by, value, [0.5]).select(*by, F.get("q", F.lit(0)).alias(out))


def average_ranks(df: DataFrame, by: str | Sequence[str] | None, value: str, out: str, ascending: bool = True) -> DataFrame:
    """1-based rank of each row's value in its group, ties sharing the mean rank."""
    by = names(by)
    counts = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_o", F.col("_v") if ascending else -F.col("_v"))
    ranked = running_counts(counts, by, "_o", {"_upto": "_c"}).select(
        *by, F.col("_v").alias(value), (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out)
    )
    return attach(df, ranked, [*by, value])


# --------------------------------------------------------------------------- K5


GRAM_CELLS = 4_000_000


def gram_cells(df: DataFrame, row: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Cells ``(by…, i, j, v)`` of ``Xᵀ X`` of the array column ``row``, per group.

    Each task adds up its own rows, at most ``GRAM_CELLS`` cells at a time; only partial sums, k² per group, are shuffled.
    """
    import numpy as np
    import pandas as pd

    by = names(by)
    types = dict(df.dtypes)

    def listed(totals):
        for key, total in totals.items():
            keys = {c: pd.Series([None if pd.isna(k) else k] * len(total), dtype=object) for c, k in zip(by, key, strict=True)}
            yield pd.DataFrame({**keys, "i": range(len(total)), "v": [*total]})

    def partial(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(by, dropna=False) if by else [((), batch)]
            for key, part in groups:
                key = key if isinstance(key, tuple) else (key,)
                x = np.stack(part[row].to_numpy())
                totals[key] = totals[key] + x.T @ x if key in totals else x.T @ x
                if len(totals) * totals[key].size > GRAM_CELLS:
                    yield from listed(totals)
                    totals = {}
        yield from listed(totals)

    fields = "".join(f"{c} {types[c]}, " for c in by)
    parts = df.select(*by, row).mapInPandas(partial, f"{fields}i int, v array<double>")
    return parts.select(*by, "i", F.posexplode("v").alias("j", "v")).groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def cells_to_matrix(cells):
    """A pandas frame of ``i, j, v`` as a square numpy matrix."""
    import numpy as np

    size = int(cells["i"].max()) + 1 if len(cells) else 0
    out = np.zeros((size, size))
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return out


def gram(df: DataFrame, row: str):
    """``Xᵀ X`` of one group as a k × k numpy matrix on the driver."""
    return cells_to_matrix(gram_cells(df, row).toPandas())


def solve_ridge(g, inputs: Sequence[int], targets: Sequence[int], penalty=0.0):
    """Coefficients (inputs × targets) and residual sums of products from a Gram matrix."""
    import numpy as np

    a, b = g[np.ix_(inputs, inputs)], g[np.ix_(inputs, targets)]
    ridge = np.diag(np.broadcast_to(np.asarray(penalty, dtype="float64"), (len(inputs),)))
    beta = np.linalg.lstsq(a + ridge, b, rcond=None)[0]
    sse = g[np.ix_(targets, targets)] - b.T @ beta - beta.T @ b + beta.T @ a @ beta
    return beta, sse
