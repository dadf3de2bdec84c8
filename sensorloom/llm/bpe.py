"""Byte-level BPE in padded numpy matrices, and its inverse."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from sensorloom.llm.text import pieces

_NONE = np.int32(2**31 - 1)
BATCH_CHARS = 2 << 20
CACHE_PIECES = 200_000
CELLS = 1 << 20
LONG_BYTES = 512
_CODECS: dict[str, Codec] = {}


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id of their concatenation."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, n_ids: int):
        self.n_ids = n_ids
        self.bits = max(4, int(np.ceil(np.log2(max(len(left), 1) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        key = left.astype(np.int64) * n_ids + right
        slot, self.probes = self._slot(key), 0
        while len(key):
            self.probes += 1
            free = np.flatnonzero(self.keys[slot] == -1)
            _, one = np.unique(slot[free], return_index=True)  # one new key to a free slot
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = key[put], merged[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, merged, slot = key[rest], merged[rest], (slot[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the concatenation of each pair, ``_NONE`` where it is no token (also beside padding, which is negative)."""
        key = left.astype(np.int64) * self.n_ids + right
        out = np.full(key.shape, _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key, slot = key.ravel()[todo], None
        slot = self._slot(key)
        flat = out.reshape(-1)
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key
            flat[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            if not go.any():
                break
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out


class Codec:
    """Token ids of texts and back, for the ranks of a vocabulary file (``base64 rank`` per line; the rank is the id)."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.pattern = regex.compile(pattern)
        n = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * n
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.digits_of = [b"%d" % i for i in range(n)]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        triples = [
            (self.ranks[token[:cut]], self.ranks[token[cut:]], rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        ]
        self.pair = PairTable(*np.array(triples, np.int32).reshape(-1, 3).T, n)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _rounds(self, ids: np.ndarray) -> list[tuple[int, ...]]:
        """Merge the leftmost least-rank pair of every row, round by round; rows that are done leave the matrix."""
        out: list[tuple[int, ...]] = [()] * len(ids)
        rows = np.arange(len(ids))
        rank = self.pair(ids[:, :-1], ids[:, 1:])
        columns = np.arange(ids.shape[1])
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                for r, row in zip(rows[done], ids[done], strict=True):
                    out[r] = tuple(row[row >= 0].tolist())
                rows, ids, rank, at, best = rows[~done], ids[~done], rank[~done], at[~done], best[~done]
                if not len(rows):
                    break
                width = max(2, int((ids >= 0).sum(axis=1).max()))
                ids, rank, columns = ids[:, :width], rank[:, : width - 1], columns[:width]
            each = np.arange(len(rows))
            step = columns[None, :] + (columns[None, :] > at[:, None])  # close the gap to the right of the merge
            ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], axis=1)
            ids[each, at] = best
            ids = np.take_along_axis(ids, step, axis=1)
            rank = np.concatenate([rank, np.full((len(rows), 1), _NONE, np.int32)], axis=1)
            rank = np.take_along_axis(rank, np.minimum(step[:, :-1], rank.shape[1] - 1), axis=1)
            after = np.minimum(at + 1, ids.shape[1] - 1)
            right = self.pair(best, np.where(at + 1 < ids.shape[1], ids[each, after], -1))
            inside = at < rank.shape[1]
            rank[each[inside], at[inside]] = right[inside]
            left = at > 0
            rank[each[left], at[left] - 1] = self.pair(ids[each[left], at[left] - 1], best[left])
        return out

    def _long(self, ids: np.ndarray) -> tuple[int, ...]:
        """One long row: a round merges the least-rank pair wherever it stands, from the left up to the first place
        whose merge makes a pair of lower rank (that pair is then next, as it is when merging one at a time)."""
        while len(ids) > 1:
            rank = self.pair(ids[:-1], ids[1:])
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            run = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1])
            in_run = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[in_run % 2 == 0]
            before = np.where(at > 0, ids[at - 1], -1)
            before[1:][np.diff(at) == 2] = best
            behind = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            merged = np.full(len(at), best, np.int32)
            lower = np.flatnonzero((self.pair(before.astype(np.int32), merged) < best) | (self.pair(merged, behind.astype(np.int32)) < best))
            if len(lower):
                at = at[: lower[0] + 1]
            ids = ids.copy()
            ids[at] = best
            ids = np.delete(ids, at + 1)
        return tuple(ids.tolist())

    def learn(self, new: list[str]) -> None:
        """Put the ids of pieces into the cache, piece lengths of one power of two at a time."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            raw = piece.encode()
            if raw in self.ranks:
                self.cache[piece] = (self.ranks[raw],)
            elif len(raw) > LONG_BYTES:
                self.cache[piece] = self._long(self.byte_ids[np.frombuffer(raw, np.uint8)])
            else:
                buckets.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, found in buckets.items():
            for k in range(0, len(found), max(1, CELLS // width)):
                part = found[k : k + max(1, CELLS // width)]
                lengths = np.array([len(raw) for _, raw in part])
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width)[None, :] < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                self.cache.update(zip((piece for piece, _ in part), self._rounds(ids), strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        split = [self.pattern.findall(t) for t in texts]
        new = set().union(*split) - self.cache.keys()
        if len(self.cache) + len(new) > CACHE_PIECES:
            self.cache.clear()
            new = set().union(*split)
        self.learn(list(new))
        known = self.cache.__getitem__
        for found in split:
            yield list(chain.from_iterable(map(known, found)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary, built once per worker process."""
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary, pattern)
    return _CODECS[key]


def _mapped(docs: DataFrame, vocabulary_path: str, pattern: str, text: str, doc: str, schema: str, row) -> DataFrame:
    """``row(codec, ids)`` gives the columns of each document beside its id."""
    with open(vocabulary_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # one vocabulary file
    id_type = dict(docs.dtypes)[doc]

    def run(batches):
        tool = codec(sent.value, pattern)
        for batch in batches:
            texts = batch["_text"].fillna("").tolist()
            for part in pieces([len(t) for t in texts], BATCH_CHARS):
                out = [row(tool, ids) for ids in tool.encode_batch(texts[part])]
                yield pd.DataFrame({doc: batch["_id"].iloc[part].to_numpy(), **{k: [r[k] for r in out] for k in out[0]}})

    chosen = docs.selectExpr(f"`{doc}` AS _id", f"`{text}` AS _text")
    return chosen.mapInPandas(run, f"`{doc}` {id_type}, {schema}")


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """``(doc, n_tokens, ids)`` of every whole text.

    The text is split by ``pattern`` and each match is encoded by itself: a match that is a token is that token, any other starts as
    bytes and merges its leftmost least-rank pair until no pair is a token.  Null texts are empty and have no
    ids; copies of a row stay rows; an empty table gives an empty one.  Rows never meet, so nothing is shuffled.
    """
    return _mapped(docs, vocabulary_path, pattern, text, doc, "n_tokens long, ids array<int>", lambda tool, ids: {"n_tokens": len(ids), "ids": ids})


def digests(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", doc: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``(doc, n_tokens, ids_sha256, decoded_sha256)``: digests of what ``encode`` gives and of its decoded bytes, without moving either (or with the ids)."""

    def row(tool: Codec, ids: list[int]) -> dict:
        joined = b",".join(map(tool.digits_of.__getitem__, ids))
        out = {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(joined).hexdigest(), "decoded_sha256": hashlib.sha256(tool.decode(ids)).hexdigest()}
        return out | {"ids": np.array(ids, np.int32)} if with_ids else out

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return _mapped(docs, vocabulary_path, pattern, text, doc, schema, row)


def decode(tokens: DataFrame, vocabulary_path: str, ids: str = "ids", doc: str = "doc_id") -> DataFrame:
    """``(doc, content)``: the bytes of every list of ids (null: none).  An id outside the vocabulary fails the task."""
    with open(vocabulary_path, "rb") as file:
        sent = tokens.sparkSession.sparkContext.broadcast(file.read())
    id_type = dict(tokens.dtypes)[doc]

    def run(batches):
        tool = codec(sent.value, ".")
        for batch in batches:
            yield pd.DataFrame({doc: batch["_id"], "content": [tool.decode(x if x is not None else ()) for x in batch["_ids"]]})

    return tokens.selectExpr(f"`{doc}` AS _id", f"`{ids}` AS _ids").mapInPandas(run, f"`{doc}` {id_type}, content binary")
