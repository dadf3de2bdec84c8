"""Substring dedup by seed and extend: winnowed anchors find repeated places, extension finds how far they reach."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.blocks import bucket_count, dealt, found_in, in_blocks, long_key, text_bytes, unpack
from sensorloom.llm.text import CHUNK_BYTES, Words, encoded, grams, pieces

WORDS = 13
SEED = 5


def anchors(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of the winnowed ``seed``-grams: the least of any ``length - seed + 1`` consecutive ones (all of them on ties).

    Equal runs of ``length`` words hold the same anchors, so any repeat of that length has one.
    """
    value, at = grams(words.hash, words.doc, seed)
    width = length - seed + 1
    if len(value) < width:
        return value[:0], at[:0]
    least = np.lib.stride_tricks.sliding_window_view(value, width)
    low = least[:, 0].copy()
    for j in range(1, width):
        np.minimum(low, least[:, j], out=low)
    doc = words.doc[at]
    low[doc[: len(low)] != doc[width - 1 :]] = 0  # a window lies in one text
    high = np.zeros(len(value), np.uint64)
    for j in range(width):
        np.maximum(high[j : j + len(low)], low, out=high[j : j + len(low)])
    chosen = np.flatnonzero(value == high)
    return value[chosen], at[chosen]


def _extended(words: Words, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """First words of all runs of ``length`` words around the seeds at ``at``, within their text."""
    n = len(words)
    low = np.maximum(at - (length - seed), words.first[words.doc[at]])
    high = np.minimum(at, words.first[words.doc[at] + 1] - length)
    ok = high >= low
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, low[ok], 1)
    np.add.at(edge, high[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:n]) > 0)


def _runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes (64 and 32 bits) and the first word of every run of ``length`` words."""
    first, at = grams(words.hash, words.doc, length)
    return first, (grams(words.hash, words.doc, length, seed=1)[0] >> np.uint64(32)).astype(np.uint32), at


def _sorted_unique(key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, check) with their least document, and whether a larger one has it too."""
    if not len(key):
        return key, check, doc, np.zeros(0, bool)
    order = np.lexsort((doc, check, key))
    key, check, doc = key[order], check[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(key)) - 1
    return key[start], check[start], doc[start], doc[last] > doc[start]


def _texts(block: pd.DataFrame):
    """Words of a block's texts, a bounded number of bytes at a time, with the documents' keys."""
    keys = block["_key"].to_numpy(np.int64)
    texts = encoded(block["_text"])
    for part in pieces([len(t) for t in texts], CHUNK_BYTES):
        yield keys[part], texts[part], Words(texts[part]), part


def _seed_requests(n_buckets: int, length: int, seed: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        found, docs = [], []
        for keys, _, words, _ in _texts(block):
            value, at = anchors(words, length, seed)
            found.append(value)
            docs.append(keys[words.doc[at]])
        value = np.concatenate(found)
        key, _, _, many = _sorted_unique(value, np.zeros(len(value), np.uint8), np.concatenate(docs))
        name = int(block["_block"].iloc[0])
        rows = [(bucket, name, key[i].tobytes(), key[i][many[i]].tobytes()) for bucket, i in dealt(key, n_buckets)]
        return pd.DataFrame(rows, columns=["_bucket", "_block", "_once", "_many"])

    return run


def _seed_answers(bucket: pd.DataFrame) -> pd.DataFrame:
    """For each block the seeds it asked about that stand in another document as well."""
    value, count = np.unique(unpack(bucket["_once"], np.uint64), return_counts=True)
    shared = np.union1d(value[count > 1], unpack(bucket["_many"], np.uint64))
    rows = []
    for name, once in zip(bucket["_block"], bucket["_once"], strict=True):
        own = np.frombuffer(bytes(once), np.uint64)
        own = own[found_in(shared, own) >= 0]
        if len(own):
            rows.append((name, own.tobytes()))
    return pd.DataFrame(rows, columns=["_block", "_shared"])


def _run_requests(n_buckets: int, length: int, seed: int):
    def run(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["_bucket", "_block", "_runs", "_checks", "_docs", "_more"]
        if block.empty or answers.empty:
            return pd.DataFrame([], columns=columns)
        shared = np.sort(unpack(answers["_shared"], np.uint64))
        parts = []
        for keys, _, words, _ in _texts(block):
            value, at = anchors(words, length, seed)
            start = _extended(words, at[found_in(shared, value) >= 0], length, seed)
            if len(start):
                key, check, first = _runs(words, length)
                pick = np.searchsorted(first, start)
                parts.append((key[pick], check[pick], keys[words.doc[start]]))
        if not parts:
            return pd.DataFrame([], columns=columns)
        key, check, doc, many = _sorted_unique(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        name = int(block["_block"].iloc[0])
        rows = [(b, name, key[i].tobytes(), check[i].tobytes(), doc[i].tobytes(), many[i].tobytes()) for b, i in dealt(key, n_buckets)]
        return pd.DataFrame(rows, columns=columns)

    return run


def _run_answers(bucket: pd.DataFrame) -> pd.DataFrame:
    """For each block its runs that stand in two documents at least, with the least of these."""
    sizes = [len(bytes(r)) // 8 for r in bucket["_runs"]]
    key, check, doc = unpack(bucket["_runs"], np.uint64), unpack(bucket["_checks"], np.uint32), unpack(bucket["_docs"], np.int64)
    many = unpack(bucket["_more"], bool)
    order = np.lexsort((doc, check, key))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
    group = np.cumsum(new) - 1
    least = np.empty(len(key), np.int64)
    least[order] = doc[order][np.flatnonzero(new)][group]
    useful = (least < doc) | many
    rows, start = [], 0
    for name, size in zip(bucket["_block"], sizes, strict=True):
        i = start + np.flatnonzero(useful[start : start + size])
        start += size
        if len(i):
            rows.append((name, key[i].tobytes(), check[i].tobytes(), least[i].tobytes()))
    return pd.DataFrame(rows, columns=["_block", "_runs", "_checks", "_least"])


def repeated_words(words: Words, keys: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray], length: int) -> np.ndarray:
    """Which words lie in a run that also starts in a document with a smaller key; ``table``: runs (sorted), checks, least documents."""
    runs, checks, least = table
    key, check, at = _runs(words, length)
    cover = np.zeros(len(words) + 1, np.int64)
    where = np.searchsorted(runs, key)
    for step in range(int(np.unique(runs, return_counts=True)[1].max(initial=0))):  # runs of equal key and other check are next to each other
        i = np.minimum(where + step, max(len(runs) - 1, 0))
        hit = np.flatnonzero((runs[i] == key) & (checks[i] == check) & (least[i] < keys[words.doc[at]]) & (where + step < len(runs)))
        np.add.at(cover, at[hit], 1)
        np.add.at(cover, at[hit] + length, -1)
    return np.cumsum(cover[:-1]) > 0


def kept_texts(words: Words, removed: np.ndarray) -> list[bytes]:
    """The words that stay, joined by one space, for every text."""
    keep = ~removed
    raw = np.frombuffer(words.buffer, np.uint8).copy()
    raw[words.end] = 0x20  # there is a byte after every word
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[words.start[keep]] += 1
    edge[words.end[keep] + 1] -= 1
    out = raw[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
    sizes = np.bincount(words.doc[keep], (words.end - words.start + 1)[keep], len(words.first) - 1).astype(np.int64)
    ends = np.cumsum(sizes)
    return [out[e - s : e - 1] if s else b"" for s, e in zip(sizes, ends, strict=True)]


def dedup_substrings(docs: DataFrame, text: str = "text", doc: str = "doc_id", length: int = WORDS, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """Remove every word inside a run of ``length`` words that also stands in a document with a smaller id.

    Seed: winnowed ``seed``-grams that two documents share.  Extend: all runs of ``length`` words around a seed, hashed to 96 bits;
    overlapping repeated runs join to the maximal repeat.  The least document of every run is found over all documents, so the result does not depend on
    which pair of documents is looked at.  Words are separated by space and 0x09-0x0D and compared as they are.

    Columns ``doc, n_words, n_removed, kept_sha256`` and, with ``with_text``, ``kept``.  Null texts have no words.  Rows of
    one id are one document, so repeated rows don't remove each other; rows without an id come first.  An empty table gives an empty one.
    """
    n_bytes = text_bytes(docs, text)
    rows = docs.select(F.col(doc).alias("_id"), long_key(F.col(doc)).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    blocks, _ = in_blocks(rows, "_key", n_bytes)
    n_seed, n_run = bucket_count(docs, 0.3 * n_bytes), bucket_count(docs, 1.5 * n_bytes)
    asked = blocks.groupBy("_block").applyInPandas(_seed_requests(n_seed, length, seed), "_bucket int, _block int, _once binary, _many binary")
    shared = asked.groupBy("_bucket").applyInPandas(_seed_answers, "_block int, _shared binary")
    runs = blocks.groupBy("_block").cogroup(shared.groupBy("_block")).applyInPandas(
        _run_requests(n_run, length, seed), "_bucket int, _block int, _runs binary, _checks binary, _docs binary, _more binary"
    )
    answers = runs.groupBy("_bucket").applyInPandas(_run_answers, "_block int, _runs binary, _checks binary, _least binary")
    id_type = dict(docs.dtypes)[doc]
    columns = [doc, "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]

    def cut(block: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        key, check, least = unpack(told["_runs"], np.uint64), unpack(told["_checks"], np.uint32), unpack(told["_least"], np.int64)
        order = np.argsort(key)
        table, out = (key[order], check[order], least[order]), []
        for keys, _, words, part in _texts(block):
            removed = repeated_words(words, keys, table, length)
            kept = kept_texts(words, removed)
            frame = pd.DataFrame({
                doc: block["_id"].iloc[part].to_numpy(), "n_words": np.diff(words.first), "n_removed": np.bincount(words.doc[removed], minlength=len(kept)),
                "kept_sha256": [hashlib.sha256(t).hexdigest() for t in kept],
            })
            out.append(frame.assign(kept=[t.decode() for t in kept]) if with_text else frame)
        return pd.concat(out) if out else pd.DataFrame([], columns=columns)

    schema = f"`{doc}` {id_type}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return blocks.groupBy("_block").cogroup(answers.groupBy("_block")).applyInPandas(cut, schema)
