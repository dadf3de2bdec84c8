"""Ranked lexical search, exact, over posting lists cut into blocks of similar documents with maximum summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.blocks import found_in, long_key
from sensorloom.llm.text import CHUNK_BYTES, Words, encoded, pieces
from sensorloom.session import settle

TOP = 50
BLOCK_DOCS = 32
SHARD_ENTRIES = 1 << 19
SHARD_DOCS = 1 << 14
SAMPLE_SHARDS = 8
QUERY_BYTES = 16 << 20
SKETCH = 16
_NO_ID = -(2**63)
_SEED = 1109

# A-Z are lower-cased, every other ASCII character but digits and letters ends a term; all else belongs to terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Queries:
    """Query terms as columns 0, 1, 2 ... and the columns of every query."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        held: dict[int | None, set] = {}
        for item, text in items:
            held.setdefault(item, set()).update(Words(encoded([text], FOLD)).hash.tolist())
        self.ids = list(held)
        self.table = np.unique(np.array(sorted(set().union(*held.values())), np.uint64))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.table >> np.uint64(44)] = True
        self.terms = [np.sort(found_in(self.table, np.array(sorted(h), np.uint64))) for h in held.values()]

    def columns(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that are query terms, and their columns."""
        at = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
        place = found_in(self.table, hashes[at])
        return at[place >= 0], place[place >= 0]


class Shard:
    """Some documents: ids, numbers of terms, and per document its query terms with a value each (``first[i]`` to ``first[i+1]``)."""

    FIELDS = {"ids": np.int64, "n": np.int64, "first": np.int64, "term": np.int32, "value": np.int32}

    def __init__(self, **arrays: np.ndarray):
        for name, kind in self.FIELDS.items():
            setattr(self, name, np.asarray(arrays[name], kind))

    @classmethod
    def read(cls, row) -> Shard:
        return cls(**{name: np.frombuffer(bytes(row[name]), kind) for name, kind in cls.FIELDS.items()})

    def written(self) -> dict[str, bytes]:
        return {name: getattr(self, name).tobytes() for name in self.FIELDS}

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of some documents for a query given by the weights of its terms (0 for all others)."""
        count = self.first[docs + 1] - self.first[docs]
        start = np.cumsum(count) - count
        index = np.repeat(self.first[docs] - start, count) + np.arange(count.sum())
        return np.add.reduceat(np.append(weight[self.term[index]] * self.value[index], 0), start) * (count > 0)


SHARD_SCHEMA = ", ".join(f"{name} binary" for name in Shard.FIELDS)


def _shards(queries: Queries):
    """Term frequencies of the query terms, in shards of a bounded number of entries; all documents count in ``n_docs`` and ``n_terms``."""

    def run(batches) -> Iterator[pd.DataFrame]:
        held, entries, docs, total = [], 0, 0, 0

        def made() -> pd.DataFrame:
            ids, n, counts, term, value = (np.concatenate(x) if held else np.zeros(0, np.int64) for x in (zip(*held, strict=True) if held else [()] * 5))
            shard = Shard(ids=ids, n=n, first=np.concatenate([[0], np.cumsum(counts)]), term=term, value=value)
            return pd.DataFrame([{**shard.written(), "n_docs": docs, "n_terms": total}])

        for batch in batches:
            texts, ids = encoded(batch["_text"], FOLD), batch["_key"].to_numpy()
            for part in pieces([len(t) for t in texts], CHUNK_BYTES):
                words = Words(texts[part])
                n = np.diff(words.first)
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
                at, column = queries.columns(words.hash)
                key, tf = np.unique(words.doc[at] * np.int64(len(queries.table) or 1) + column, return_counts=True)
                counts = np.bincount(key // (len(queries.table) or 1), minlength=len(n))
                some = np.flatnonzero(counts)
                if len(some):
                    held.append((ids[part][some], n[some], counts[some], key % len(queries.table), tf))
                    entries += len(key)
                if entries >= SHARD_ENTRIES or sum(len(h[0]) for h in held) >= SHARD_DOCS:
                    yield made()
                    held, entries, docs, total = [], 0, 0, 0
        if held or docs:
            yield made()

    return run


def _term_totals(width: int, value):
    """Per task and term: a count and a maximum of ``value(shard)`` over entries."""

    def run(batches):
        count, most = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            for _, row in batch.iterrows():
                shard = Shard.read(row)
                count += np.bincount(shard.term, minlength=width)
                np.maximum.at(most, shard.term, value(shard))
        used = np.flatnonzero(count)
        yield pd.DataFrame({"term": used, "count": count[used], "most": most[used]})

    return run


class Model:
    """What a score is made of: weights of terms, and the part of a score that one entry gives before its weight."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, max(1, n_terms)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def parts(self, shard: Shard) -> np.ndarray:
        tf = shard.value.astype(np.int64)
        long = 100 - 50 + np.array([50 * n * self.n_docs // self.n_terms for n in shard.n.tolist()], np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(long, np.diff(shard.first)))


def needed_lists(terms: np.ndarray, most: np.ndarray, bar: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a query, most valuable first, with the best that each and all after it can give together; without those that
    a document can hold all of and still stay below ``bar``."""
    order = terms[np.argsort(-most[terms], kind="stable")]
    rest = np.cumsum(most[order][::-1])[::-1]
    needed = rest >= max(1, bar)
    return order[needed], rest[needed]


class BlockedLists:
    """Posting lists of one shard, each cut into blocks of similar documents; a block keeps, per term of interest, the largest value among its documents."""

    def __init__(self, shard: Shard, lists: dict[int, np.ndarray], weight: np.ndarray, block_docs: int = BLOCK_DOCS):
        self.members: dict[int, list[np.ndarray]] = {}
        self.summary: dict[int, np.ndarray] = {}
        doc, width = shard.doc, len(weight)
        sketch = _sketches(shard, weight)
        order = np.argsort(shard.term, kind="stable")
        first = np.searchsorted(shard.term[order], np.arange(width + 1))
        column = np.full(width, -1)
        for term, coordinates in lists.items():
            posting = doc[order[first[term] : first[term + 1]]]
            if not len(posting):
                continue
            block = _clustered(sketch[posting], -(-len(posting) // block_docs))
            _, block = np.unique(block, return_inverse=True)
            by = np.argsort(block, kind="stable")
            self.members[term] = np.split(posting[by], np.flatnonzero(np.diff(block[by])) + 1)
            column[coordinates] = np.arange(len(coordinates))
            count = np.diff(shard.first)[posting]
            index = np.repeat(shard.first[posting] - np.cumsum(count) + count, count) + np.arange(count.sum())
            place = column[shard.term[index]]
            top = np.zeros((len(self.members[term]), len(coordinates)), np.int32)
            np.maximum.at(top, (np.repeat(block, count)[place >= 0], place[place >= 0]), shard.value[index][place >= 0])
            column[coordinates] = -1
            self.summary[term] = top

    def written(self) -> dict[str, bytes]:
        terms = list(self.members)
        flat = [m for t in terms for m in self.members[t]]
        return {
            "lists": np.array(terms, np.int32).tobytes(), "blocks": np.array([len(self.members[t]) for t in terms], np.int32).tobytes(),
            "sizes": np.array([len(m) for m in flat], np.int32).tobytes(), "members": (np.concatenate(flat) if flat else np.zeros(0)).astype(np.int32).tobytes(),
            "summaries": b"".join(self.summary[t].tobytes() for t in terms),
        }

    @classmethod
    def read(cls, row, lists: dict[int, np.ndarray]) -> BlockedLists:
        out = cls.__new__(cls)
        out.members, out.summary = {}, {}
        terms, blocks, sizes, members, summaries = (np.frombuffer(bytes(row[c]), np.int32) for c in ("lists", "blocks", "sizes", "members", "summaries"))
        split = np.split(members.astype(np.int64), np.cumsum(sizes)[:-1]) if len(sizes) else []
        at = used = 0
        for term, n in zip(terms.tolist(), blocks.tolist(), strict=True):
            wide = len(lists[term])
            out.members[term] = split[at : at + n]
            out.summary[term] = summaries[used : used + n * wide].reshape(n, wide)
            at, used = at + n, used + n * wide
        return out


LISTS_SCHEMA = "lists binary, blocks binary, sizes binary, members binary, summaries binary"


def _sketches(shard: Shard, weight: np.ndarray) -> np.ndarray:
    """Documents as unit vectors of their weighted values in a few random directions."""
    directions = np.random.default_rng(_SEED).standard_normal((len(weight), SKETCH)).astype(np.float32)
    out = np.zeros((len(shard.ids), SKETCH), np.float32)
    for low in range(0, len(shard.ids), 512):
        docs = np.arange(low, min(low + 512, len(shard.ids)))
        a, b = shard.first[docs[0]], shard.first[docs[-1] + 1]
        value = (weight[shard.term[a:b]] * shard.value[a:b]).astype(np.float32)
        out[docs] = np.add.reduceat(directions[shard.term[a:b]] * value[:, None], shard.first[docs] - a, axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _clustered(points: np.ndarray, wanted: int) -> np.ndarray:
    """Cluster of every point: that of the most similar of ``wanted`` evenly spread members."""
    if wanted < 2:
        return np.zeros(len(points), np.int64)
    centres = points[np.linspace(0, len(points) - 1, wanted).astype(int)]
    return np.concatenate([(points[k : k + 4096] @ centres.T).argmax(axis=1) for k in range(0, len(points), 4096)])


def best_of_shard(shard: Shard, blocked: BlockedLists, needed: tuple[np.ndarray, np.ndarray], query: np.ndarray, lists: dict[int, np.ndarray], weight: np.ndarray, bar: int, top: int):
    """``(document, score)`` of all that can be among the ``top`` best of the shard and reach ``bar``; also how many blocks were met and skipped.

    A block's summary gives no less than any of its documents scores, so a block below the bar holds nobody; lists come in the order of
    their worth, and once the rest of them cannot reach the bar together, no unseen document does.
    """
    own = np.zeros(len(weight), np.int64)
    own[query] = weight[query]
    seen = np.zeros(len(shard.ids), bool)
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    met = skipped = 0
    for term, left in zip(*(x.tolist() for x in needed), strict=True):
        if left < max(1, bar):
            break
        if term not in blocked.members:
            continue
        place = np.searchsorted(lists[term], query)
        place = np.minimum(place, len(lists[term]) - 1)
        held = lists[term][place] == query
        bound = blocked.summary[term][:, place[held]].astype(np.int64) @ own[query[held]]
        live = np.flatnonzero(bound >= max(1, bar))
        met, skipped = met + len(bound), skipped + len(bound) - len(live)
        if not len(live):
            continue
        new = np.concatenate([blocked.members[term][b] for b in live])
        new = new[~seen[new]]
        if not len(new):
            continue
        seen[new] = True
        found = shard.scores(new, own)
        good = found >= max(1, bar)
        docs, scores = np.concatenate([docs, new[good]]), np.concatenate([scores, found[good]])
        if len(docs) > top:
            keep = np.lexsort((shard.ids[docs], -scores))[:top]
            docs, scores = docs[keep], scores[keep]
            bar = max(bar, int(scores[-1]))
    return docs, scores, met, skipped


def _sampled(queries: Queries, model: Model, top: int):
    """The best scores of some shards, all documents of which are scored."""

    def run(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                shard = Shard.read(row)
                shard.value = model.parts(shard)
                for q, terms in enumerate(queries.terms):
                    own = np.zeros(len(model.weight), np.int64)
                    own[terms] = model.weight[terms]
                    scores = shard.scores(np.arange(len(shard.ids)), own)
                    best = np.sort(scores[scores > 0])[::-1][:top]
                    yield pd.DataFrame({"query": q, "score": best})

    return run


def _built(model: Model, lists: dict[int, np.ndarray], block_docs: int):
    def run(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                shard = Shard.read(row)
                shard.value = model.parts(shard).astype(np.int32)
                yield pd.DataFrame([{**shard.written(), **BlockedLists(shard, lists, model.weight, block_docs).written()}])

    return run


def _searched(queries: Queries, model: Model, lists: dict[int, np.ndarray], needed: list[tuple[np.ndarray, np.ndarray]], bars: np.ndarray, top: int):
    def run(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                shard, blocked = Shard.read(row), BlockedLists.read(row, lists)
                rows = []
                for q, terms in enumerate(queries.terms):
                    docs, scores, *_ = best_of_shard(shard, blocked, needed[q], terms, lists, model.weight, int(bars[q]), top)
                    rows.append((np.full(len(docs), q), shard.ids[docs], scores))
                query, ids, scores = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pd.DataFrame({"query": query, "_key": ids, "score": scores})

    return run


def _search(docs: DataFrame, queries: Queries, top: int, sample_shards: int, block_docs: int) -> DataFrame:
    spark, width = docs.sparkSession, len(queries.table)
    shards = settle(docs.mapInPandas(_shards(queries), f"{SHARD_SCHEMA}, n_docs long, n_terms long"))
    n_docs, n_terms, n_shards = (x or 0 for x in shards.agg(F.sum("n_docs"), F.sum("n_terms"), F.count(F.lit(1))).first())
    shards = shards.drop("n_docs", "n_terms")
    summed = lambda value: shards.mapInPandas(_term_totals(width, value), "term int, count long, most long").groupBy("term").agg(F.sum("count").alias("n"), F.max("most").alias("most")).collect()
    df = np.zeros(width, np.int64)
    for r in summed(lambda shard: shard.value):
        df[r["term"]] = r["n"]
    model = Model(n_docs, n_terms, df)
    most = np.zeros(width, np.int64)
    for r in summed(model.parts):
        most[r["term"]] = r["most"]
    most *= model.weight

    # scores that so many documents of a sample reach are bars which the best of all documents cannot miss
    sample = shards.where(F.pmod(F.xxhash64("ids"), F.lit(max(1, n_shards))) < sample_shards)
    reached = sample.mapInPandas(_sampled(queries, model, top), "query int, score long").groupBy("query").agg(F.slice(F.sort_array(F.collect_list("score"), False), top, 1).alias("bar")).collect()
    bars = np.zeros(len(queries.ids), np.int64)
    for r in reached:
        bars[r["query"]] = r["bar"][0] if r["bar"] else 0

    needed = [needed_lists(t, most, int(b)) for t, b in zip(queries.terms, bars, strict=True)]
    near: dict[int, set] = {}
    for terms, (order, _) in zip(queries.terms, needed, strict=True):
        for t in order.tolist():
            near.setdefault(t, set()).update(terms.tolist())
    lists = {t: np.array(sorted(c)) for t, c in sorted(near.items())}
    index = settle(shards.mapInPandas(_built(model, lists, block_docs), f"{SHARD_SCHEMA}, {LISTS_SCHEMA}"))
    found = index.mapInPandas(_searched(queries, model, lists, needed, bars, top), "query int, _key long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "_key"))).where(F.col("rank") <= top)
    ids = spark.createDataFrame(list(enumerate(queries.ids)), "query int, _item long")
    return best.join(ids, "query").select("_item", "rank", "_key", "score")


def ranked_search(docs: DataFrame, items: DataFrame, text: str = "text", doc: str = "doc_id", item: str = "item_id", item_text: str = "text", top: int = TOP, sample_shards: int = SAMPLE_SHARDS, block_docs: int = BLOCK_DOCS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(item, rank, doc, score)``: the ``top`` best documents of every item with a score above 0, equal scores by ascending id.

    Terms are runs of ASCII letters and digits (A-Z lower-cased) and of any other characters.  With N documents that hold a term, L terms in all, n in one document, df documents with a term, its
    weight w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 50 + 50 n N div L, a document's score is the sum of w (10^9 tf div (1000 tf + 20 m)) over the item's distinct terms.

    Documents go to shards of a bounded number of entries, whole and in place; nothing but counts and shard-wise best ones is shuffled.  About ``sample_shards`` of them, by hash, are scored
    in full and give each item a bar that its best documents reach for certain.  In each shard every posting list that a document above the bar must be in is cut into blocks of about ``block_docs`` documents that
    resemble each other, with the largest value per term as a summary; the summary's score bounds those of its documents, so only blocks that reach the
    bar (which rises with what is found) are scored, exactly.  The result is that of scoring everything.

    Items above ``query_bytes`` of text are searched in several parts.  Null and empty texts hold no terms, and an item without terms finds nothing; ids are whole numbers, and documents
    without one have a null id and come first among equals; repeated rows are documents of their own; rows that share an item id are one item; empty tables give an empty result.
    """
    spark, doc_type, item_type = docs.sparkSession, dict(docs.dtypes)[doc], dict(items.dtypes)[item]
    rows = docs.select(long_key(F.col(doc)).alias("_key"), F.col(text).alias("_text"))
    asked = items.select(F.col(item).cast("bigint").alias("_i"), F.col(item_text).alias("_t")).where("_t IS NOT NULL").distinct()
    parts = max(1, -(-(asked.agg(F.sum(F.octet_length("_t"))).first()[0] or 0) // query_bytes))
    found = None
    for k in range(parts):
        held = asked.where(F.pmod(F.xxhash64(F.coalesce("_i", F.lit(_NO_ID))), F.lit(parts)) == k).collect()
        queries = Queries(sorted(((r["_i"], r["_t"]) for r in held), key=repr))
        if len(queries.table):
            some = _search(rows, queries, top, sample_shards, block_docs)
            found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], f"`{item}` {item_type}, rank int, `{doc}` {doc_type}, score long")
    return found.select(F.col("_item").cast(item_type).alias(item), "rank", F.when(F.col("_key") != _NO_ID, F.col("_key")).cast(doc_type).alias(doc), "score")
