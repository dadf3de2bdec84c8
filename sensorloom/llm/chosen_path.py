"""Set-similarity self-join over word shingles by chosen paths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.blocks import bucket_count, long_key, shuffle_partitions
from sensorloom.llm.components import components
from sensorloom.llm.text import CHUNK_BYTES, Words, encoded, mix, pieces, shingles
from sensorloom.session import settle

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
TOKENS = 64
DEPTH = 3
LIMIT = 1024
CHUNK = 256
CHUNK_SET_BYTES = 4 << 20
PAIRS = 1 << 20
_SEED = 20_011


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs_needed(recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold met in a leaf with probability ``recall``.

    A node samples each token with probability 1 / (similarity * tokens), so a pair at the threshold has one shared
    child on average; the chance that one lives to depth d follows s(d+1) = 1 - exp(-s(d)).
    """
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def signatures(docs: DataFrame, shingle: int = SHINGLE, tokens: int = TOKENS) -> DataFrame:
    """``(id, key, same, n_shingles, tokens)`` for rows ``(_id, _key, _text)``: the set of a text as ``tokens`` min-hash tokens."""
    factors = _multipliers(tokens)
    id_type = dict(docs.dtypes)["_id"]

    def run(batches):
        for batch in batches:
            texts = encoded(batch["_text"])
            for part in pieces([len(t) for t in texts], CHUNK_BYTES):
                words = Words(texts[part])
                value, doc = shingles(words, shingle)
                count = np.bincount(doc, minlength=len(words.first) - 1)
                table = np.full((len(count), tokens), 0xFFFFFFFF, np.uint32)
                full = np.flatnonzero(count)
                if len(full):
                    start = (np.cumsum(count) - count)[full]
                    for j, factor in enumerate(factors):
                        table[full, j] = np.minimum.reduceat(((value * factor) >> np.uint64(32)).astype(np.uint32), start)
                yield pd.DataFrame({
                    "_id": batch["_id"].iloc[part].to_numpy(), "_key": batch["_key"].iloc[part].to_numpy(), "_same": batch["_same"].iloc[part].to_numpy(),
                    "_size": count, "_tokens": [row.tobytes() for row in table],
                })

    rows = docs.select("_id", "_key", F.unhex(F.md5("_text")).alias("_same"), "_text")
    return rows.mapInPandas(run, f"_id {id_type}, _key long, _same binary, _size long, _tokens binary")


def _table(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(b) for b in blobs), np.uint32).reshape(len(blobs), -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of ``n`` nodes over the pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _first_paths(runs: int, similarity: float, tokens: int):
    """Level 1: every run samples tokens for the root, which holds all sets."""
    rng = np.random.default_rng(_SEED)
    sampled = [(r, i) for r in range(runs) for i in np.flatnonzero(rng.random(tokens) < 1 / (similarity * tokens))]
    salts = mix(np.array([r * 4096 + i + 1 for r, i in sampled], np.uint64))
    places = np.array([i for _, i in sampled])

    def run(batches):
        for batch in batches:
            path = mix(_table(batch["_tokens"])[:, places].astype(np.uint64) + salts[None, :])
            yield pd.DataFrame({"_path": path.ravel().view(np.int64), "_node": np.repeat(batch["_node"].to_numpy(), len(places))})

    return run


def _next_paths(similarity: float, tokens: int):
    """A crowded node samples tokens anew, by a hash of its path, and its sets go on by the value of each."""
    salts = _multipliers(tokens)
    bar = np.uint64(int(2**64 / (similarity * tokens)))

    def run(batches):
        for batch in batches:
            path = batch["_path"].to_numpy().view(np.uint64)
            row, place = np.nonzero(mix(path[:, None] ^ salts[None, :]) < bar)
            value = _table(batch["_tokens"])[row, place].astype(np.uint64)
            new = mix(mix(path[row] + salts[place]) + value)
            yield pd.DataFrame({"_path": new.view(np.int64), "_node": batch["_node"].to_numpy()[row]})

    return run


def _compared(least: float):
    """Brute force in the leaves of one bundle: sets whose tokens agree often enough, linked to the least of their cluster."""

    def run(bundle: pd.DataFrame) -> pd.DataFrame:
        bundle = bundle.sort_values(["_leaf", "_node"])
        leaf, node, table = bundle["_leaf"].to_numpy(), bundle["_node"].to_numpy(), _table(bundle["_tokens"])
        first, second, held, step, at = [], [], 0, 1, np.arange(len(bundle))
        while True:
            at = at[at + step < len(leaf)]
            at = at[leaf[at] == leaf[at + step]]
            if not len(at):
                break
            for k in range(0, len(at), 1 << 15):
                part = at[k : k + (1 << 15)]
                near = part[(table[part] == table[part + step]).mean(axis=1) >= least]
                first.append(near)
                second.append(near + step)
                held += len(near)
                if held > PAIRS:  # only what they connect is kept
                    root = _roots(len(leaf), np.concatenate(first), np.concatenate(second))
                    linked = np.flatnonzero(root != np.arange(len(root)))
                    first, second, held = [linked], [root[linked]], len(linked)
            step += 1
        if not first:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        a, b = np.concatenate(first), np.concatenate(second)
        root = _roots(len(leaf), a, b)
        linked = np.flatnonzero(node[root] != node)
        return pd.DataFrame({"a": node[linked], "b": node[root[linked]]}).drop_duplicates()

    return run


def candidate_edges(sets: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH, limit: int = LIMIT) -> DataFrame:
    """Edges ``(a, b)`` that connect all candidate pairs among ``sets (_node, _tokens)``.

    Sets go down sampled paths of shared tokens.  A node with at most ``limit`` sets is a leaf and is compared by brute force; larger ones
    go on, and what is still larger at ``depth`` is compared in blocks, all with all.  Only a spanning forest of each leaf is kept.
    """
    tokens = TOKENS
    least = similarity - 4 * math.sqrt(similarity * (1 - similarity) / tokens)
    level = sets.mapInPandas(_first_paths(runs_needed(recall, depth), similarity, tokens), "_path long, _node long")
    leaves = []
    for d in range(1, depth + 1):
        counts = settle(level.groupBy("_path").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
        crowded = counts.where(F.col("_n") > limit)
        more = d < depth and not crowded.isEmpty()
        held = level.join(counts if not more else counts.where(F.col("_n") <= limit), "_path")
        # a crowded leaf at the last depth is cut into parts, every two of which meet
        parts = F.ceil(F.col("_n") / limit).cast("int")
        held = held.withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int"))
        held = held.select("_node", "_path", "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
        leaves.append(held.select("_node", F.xxhash64("_path", F.least("_part", "_other"), F.greatest("_part", "_other")).alias("_leaf")))
        if not more:
            break
        level = level.join(crowded.select("_path"), "_path").join(sets, "_node").select("_path", "_node", "_tokens").mapInPandas(_next_paths(similarity, tokens), "_path long, _node long")
    rows = leaves[0]
    for other in leaves[1:]:
        rows = rows.union(other)
    rows = settle(rows)
    bundles = bucket_count(sets, rows.count() * (tokens * 4 + 24), 8 << 20)
    met = rows.join(sets.hint("merge"), "_node").select("_node", "_leaf", "_tokens", F.pmod(F.xxhash64("_leaf"), F.lit(bundles)).cast("int").alias("_bundle"))
    return met.groupBy("_bundle").applyInPandas(_compared(least), "a long, b long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted distinct arrays, by blocks of the shared values' incidence matrix."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    use = np.flatnonzero(count[place] > 1)
    use = use[np.argsort(column[place[use]], kind="stable")]
    owner, col = owner[use], column[place[use]]
    out = np.zeros((n, n), np.float64)
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i = slice(*np.searchsorted(col, [low, low + 4096]))
        block = np.zeros((n, 4096), np.float32)
        block[owner[i], col[i] - low] = 1
        out += block @ block.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return np.rint(out).astype(np.int64)


def _verified(similarity: float):
    def run(bundle: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, task in bundle.groupby("_task", sort=False):
            task = task.drop_duplicates("_node").sort_values("_node")
            node, part = task["_node"].to_numpy(), task["_part"].to_numpy()
            if len(node) < 2:
                continue
            sets = [np.frombuffer(bytes(b), np.uint64) for b in task["_set"]]
            size = np.array([len(s) for s in sets])
            both = overlaps(sets)
            link = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(link, False)
            if part.min() != part.max():  # two parts: pairs inside one are another task's
                link &= part[:, None] != part[None, :]
            root = _roots(len(node), *np.nonzero(np.triu(link)))
            n = link.sum(axis=1)
            for i in np.flatnonzero(n):
                rows.append((node[i], n[i], node[root[i]]))
        return pd.DataFrame(rows, columns=["_node", "_links", "_root"])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            texts = encoded(batch["_text"])
            for part in pieces([len(t) for t in texts], CHUNK_BYTES):
                words = Words(texts[part])
                value, doc = shingles(words, shingle)
                cuts = np.searchsorted(doc, np.arange(len(words.first)))
                rest = batch.iloc[part][["_node", "_comp", "_part", "_parts"]].reset_index(drop=True)
                yield rest.assign(_set=[np.unique(value[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])

    return run


def similar_classes(docs: DataFrame, text: str = "text", doc: str = "doc_id", similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL, limit: int = LIMIT, chunk: int = CHUNK, depth: int = DEPTH) -> DataFrame:
    """``(doc, class_id, n_links)`` for every row: near-duplicate class and number of other texts at least ``similarity`` alike.

    Likeness is the Jaccard similarity of the sets of ``shingle`` consecutive words (runs without white space; a shorter text is one shingle).  Equal
    texts count once.  Chosen paths over min-hash tokens find candidates; within what they connect, every two different texts are
    compared exactly, in blocks of ``chunk`` texts, and counted without listing the pairs.  A class is a connected component of links; its id
    is the least document id in it.  Null texts are empty; empty texts are like each other only.  Rows without an id have a null id
    and count as the lowest; repeated rows get the same result; an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc).alias("_id"), long_key(F.col(doc)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    every = settle(signatures(rows, shingle))
    classes = every.groupBy("_same").agg(F.min("_key").alias("_rep"), F.first("_size").alias("_size"), F.first("_tokens").alias("_tokens"))
    classes = settle(classes.withColumn("_node", F.monotonically_increasing_id()))  # numbers are fixed once written
    sets = classes.where("_size > 0").select("_node", "_tokens")

    found = components(candidate_edges(sets, similarity, recall, depth, limit))
    members = found.select(F.col("node").alias("_node"), F.col("root").alias("_comp")).union(found.select("root", "root").distinct())
    members = members.join(classes.drop("_tokens"), "_node")
    by_count, by_size = F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("_size") * 8 / CHUNK_SET_BYTES)
    sizes = members.groupBy("_comp").agg(F.greatest(by_count, by_size, F.lit(1)).cast("int").alias("_parts"))
    members = settle(
        members.join(sizes, "_comp")
        .select("_node", "_comp", "_parts", F.pmod(F.xxhash64("_node"), F.col("_parts")).cast("int").alias("_part"), "_same", "_rep", "_size")
    )
    load = members.agg(F.sum(F.col("_size") * 8.0 * F.col("_parts"))).first()[0] or 0
    bundles = bucket_count(docs, load, 8 << 20)
    texts = rows.select(F.col("_key").alias("_k"), F.unhex(F.md5("_text")).alias("_s"), "_text")
    # members grow with the documents: the same shuffled join at every size
    met = texts.join(members.hint("merge"), (F.col("_k") == F.col("_rep")) & (F.col("_s") == F.col("_same"))).select("_node", "_comp", "_part", "_parts", "_text")
    held = met.mapInPandas(_sets(shingle), "_node long, _comp long, _part int, _parts int, _set binary")
    tasks = held.select("_node", "_comp", "_part", "_set", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other")).select(
        "_node", "_part", "_set", F.xxhash64("_comp", F.least("_part", "_other"), F.greatest("_part", "_other")).alias("_task")
    ).withColumn("_bundle", F.pmod(F.xxhash64("_task"), F.lit(bundles)).cast("int"))
    links = settle(tasks.groupBy("_bundle").applyInPandas(_verified(similarity), "_node long, _links long, _root long"))

    roots = components(links.select(F.col("_node").alias("a"), F.col("_root").alias("b")))
    counted = links.groupBy("_node").agg(F.sum("_links").alias("_links"))
    named = classes.select("_node", "_same", "_rep").join(counted, "_node", "left").join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    named = named.select("_same", "_rep", F.coalesce("_links", F.lit(0)).alias("_links"), F.coalesce("root", "_node").alias("_root"))
    least = named.where("_links > 0").groupBy("_root").agg(F.min("_rep").alias("_least"))
    named = named.join(least, "_root", "left").select("_same", F.coalesce("_least", "_rep").alias("_class"), "_links")
    null_low = F.when(F.col("_class") != -(2**63), F.col("_class"))
    return every.select("_id", "_same").join(named, "_same").select(
        F.col("_id").alias(doc), null_low.alias("class_id"), F.col("_links").alias("n_links")
    )
