"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.text import _SPACE, CHUNK_BYTES, Words, encoded, pieces

SAMPLE_DOCS = 4_000
STEPS = 120
_UPPER, _LOWER, _DIGIT, _MARK, _STOP, _HIGH = range(6)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[0x80:] = _HIGH
for _kind, _range in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58))):
    _CLASS[list(_range)] = _kind
_CLASS[list(b".,;:'\"?()-")] = _STOP
_CLASS[_SPACE] = 6
OWN = 11


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with those of its neighbours, code points per line (at least 1), and lines per text.

    Own features: shares of capitals, digits, marks, full stops and non-ASCII letters, length, words, mean word length, the share of words
    that repeat the word before, of words new to the line and of words new to the text.
    """
    buffer = b"\n".join([*texts, b""]) if texts else b""
    raw = np.frombuffer(buffer, np.uint8)
    ends = np.flatnonzero(raw == 10)  # every text ends with one of its own
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    n_lines = np.diff(np.concatenate([[-1], np.searchsorted(ends, text_ends)]))
    text_of = np.repeat(np.arange(len(texts)), n_lines)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return (sums[ends] - sums[starts]).astype(np.float32)

    kind = _CLASS[raw]
    chars = total((raw & 0xC0) != 0x80)
    by_kind = [total(kind == k) for k in range(6)]
    visible = np.maximum(sum(by_kind), 1)
    words = Words([buffer[:-1]]) if buffer else Words([])
    line = np.searchsorted(ends, words.start)
    n = len(starts)
    count = np.bincount(line, minlength=n).astype(np.float32)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(line[mask], minlength=n) / np.maximum(count, 1)

    again = np.zeros(len(words), bool)
    if len(words):
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
    fresh = []
    for group in (line, text_of[line] if len(line) else line):
        order = np.lexsort((words.hash, group))  # stable: the first place of a word stays first
        new = np.ones(len(words), bool)
        if len(words):
            g, h = group[order], words.hash[order]
            new[order[1:]] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
        fresh.append(share(new))
    own = np.stack([
        by_kind[_UPPER] / visible, by_kind[_DIGIT] / visible, by_kind[_MARK] / visible, by_kind[_STOP] / visible, by_kind[_HIGH] / visible,
        np.log1p(chars), np.log1p(count), np.log1p(chars / np.maximum(count, 1)), share(again), *fresh,
    ], axis=1) if n else np.zeros((0, OWN))
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n > 1:
        same = text_of[1:] == text_of[:-1]
        before[1:][same] = own[:-1][same]
        after[:-1][same] = own[1:][same]
    edges = np.ones((n, 3))
    if n:
        edges[1:, 0] = text_of[1:] != text_of[:-1]
        edges[:-1, 1] = text_of[1:] != text_of[:-1]
    return np.concatenate([own, before, after, edges], axis=1).astype(np.float32), np.maximum(chars, 1), n_lines


N_FEATURES = 3 * OWN + 3


def _scan(steps: np.ndarray) -> np.ndarray:
    """Running products of 2 x 2 matrices (each scaled, so nothing under- or overflows) by doubling: log2(n) vector steps."""
    p, q, r, s = (steps[:, i, j].copy() for i in (0, 1) for j in (0, 1))
    width = 1
    while width < len(p):
        late, early = slice(width, None), slice(None, -width)
        made = [
            p[late] * p[early] + q[late] * r[early], p[late] * q[early] + q[late] * s[early],
            r[late] * p[early] + s[late] * r[early], r[late] * q[early] + s[late] * s[early],
        ]
        most = 1 / (made[0] + made[1] + made[2] + made[3])
        for old, new in zip((p, q, r, s), made, strict=True):
            old[late] = new * most
        width *= 2
    return np.stack([p, q, r, s], axis=1).reshape(-1, 2, 2)


class LineCRF:
    """Two labels (0 bad, 1 good) per line; the chain of a text has unary weights on line features and a table of transitions."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.transitions, self.mean, self.scale = weights, transitions, mean, scale

    def potentials(self, features: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unary factors and the matrices that carry forward messages; a text's first line forgets what was before it."""
        logit = np.clip(((features - self.mean) / self.scale) @ self.weights, -30, 30)
        unary = np.stack([np.exp(-np.maximum(logit, 0)), np.exp(np.minimum(logit, 0))], axis=1)
        table = np.exp(self.transitions)
        step = unary[:, :, None] * table.T[None]
        step[first] = unary[first][:, :, None] * np.ones((2, 2))
        return unary, step

    def marginals(self, features: np.ndarray, n_lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: P(line is good), and P(label before, label) for every line but the first of a text."""
        n = len(features)
        first = np.zeros(n, bool)
        first[np.cumsum(n_lines) - n_lines] = True
        unary, step = self.potentials(features, first)
        ahead = _scan(step).sum(axis=2)
        ahead /= ahead.sum(axis=1, keepdims=True)
        last = np.roll(first, -1)
        table = np.exp(self.transitions)
        back = np.empty((n, 2, 2))
        back[:-1] = table[None] * unary[1:, None, :]
        back[last] = 1.0
        behind = _scan(back[::-1])[::-1].sum(axis=2)
        behind /= behind.sum(axis=1, keepdims=True)
        both = ahead * behind
        good = both[:, 1] / both.sum(axis=1)
        at = np.flatnonzero(~first)
        pair = ahead[at - 1][:, :, None] * table[None] * (unary[at] * behind[at])[:, None, :]
        return good, pair / pair.sum(axis=(1, 2), keepdims=True)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Mean marginal of a text's lines, weighted by their length."""
        features, chars, n_lines = line_features(texts)
        good, _ = self.marginals(features, n_lines)
        owner = np.repeat(np.arange(len(texts)), n_lines)
        return np.bincount(owner, good * chars, len(texts)) / np.bincount(owner, chars, len(texts))

    @classmethod
    def fit(cls, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> LineCRF:
        """Maximum likelihood with a ridge by Adam; every line has the label of its text, texts weigh alike and so do both labels."""
        parts = [line_features(texts[s]) for s in pieces([len(t) for t in texts], CHUNK_BYTES)]
        features = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, N_FEATURES), np.float32)
        n_lines = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        mean, scale = (features.mean(axis=0), features.std(axis=0) + 1e-3) if len(features) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
        mean[-1], scale[-1] = 0.0, 1.0  # the constant
        model = cls(np.zeros(N_FEATURES), np.zeros((2, 2)), mean, scale)
        if len(np.unique(labels)) < 2:  # nothing to tell apart: the prior
            model.weights[-1] = 0.0 if not len(labels) else 4.0 if labels[0] else -4.0
            return model
        truth = np.repeat(labels.astype(np.float64), n_lines)
        weight = np.repeat(1.0 / n_lines / np.where(labels == 1, (labels == 1).sum(), (labels == 0).sum()), n_lines)
        first = np.zeros(len(truth), bool)
        first[np.cumsum(n_lines) - n_lines] = True
        inner = ~first
        scaled = (features - mean) / scale
        seen = np.zeros((2, 2))
        for a in (0, 1):
            seen[a, a] = weight[inner & (truth == a)].sum()
        momentum, second = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
        for t in range(1, steps + 1):
            good, pair = model.marginals(features, n_lines)
            slope = np.concatenate([scaled.T @ ((good - truth) * weight) + ridge * model.weights, ((pair * weight[inner][:, None, None]).sum(axis=0) - seen + ridge * model.transitions).ravel()])
            momentum = 0.9 * momentum + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            move = 0.15 * (momentum / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
            model.weights = model.weights - move[:N_FEATURES]
            model.transitions = model.transitions - move[N_FEATURES:].reshape(2, 2)
        return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "quality", folds: int = 5, fold: int = 0, sample_docs: int = SAMPLE_DOCS) -> LineCRF:
    """Fit on a bounded sample of labelled documents outside the held-out fold (crc32 of the id as text, modulo ``folds``).

    The sample are the ``sample_docs`` rows of least id hash, at most half of them of each label; only those texts reach the driver.
    Rows with a null id, text or label don't teach; without labels every score is one half, with one label near that label.
    """
    ids = labels.select(F.col(doc).alias("_id"), F.col(label).cast("int").alias("_y")).where(
        (F.crc32(F.col("_id").cast("string")) % folds != fold) & F.col("_y").isin(0, 1)
    ).dropDuplicates(["_id"])
    chosen = [ids.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs // 2) for y in (0, 1)]
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    sample = rows.join(chosen[0].union(chosen[1]), "_id").select("_text", "_y").toPandas().sort_values(["_y", "_text"])
    return LineCRF.fit(encoded(sample["_text"]), sample["_y"].to_numpy())


def score_column(model: LineCRF):
    """Column function text -> quality score (null: the empty text, which is one empty line)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = encoded(texts)
        parts = [model.scores(values[s]) for s in pieces([len(t) for t in values], CHUNK_BYTES)]
        return pd.Series(np.clip(np.concatenate(parts), 0.0, 1.0) if parts else [])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "quality", threshold: float = 0.3, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``(doc, held_out, score, predicted)`` of every whole text.  Copies of a row stay rows; a row without an id is scored and not held out."""
    model = train(docs, labels, text, doc, label, sample_docs=sample_docs)
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text"))
    held = F.coalesce(F.crc32(F.col("_id").cast("string")) % 5 == 0, F.lit(False))
    return rows.select("_id", held.alias("held_out"), score_column(model)(F.col("_text")).alias("score")).select(
        F.col("_id").alias(doc), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
