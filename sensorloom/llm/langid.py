"""Language by rank-order profiles of letter n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.text import pieces

GRAM_BITS = 20
PROFILE = 400
CHUNK_CHARS = 1 << 20
_TABLES: dict[str, np.ndarray] = {}


def fold_table() -> np.ndarray:
    """For every code point: its lower case if it is a letter, else 0 (built once per worker)."""
    if "fold" not in _TABLES:
        fold = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                low = chr(cp).lower()
                fold[cp] = ord(low) if len(low) == 1 else cp
        _TABLES["fold"] = fold
    return _TABLES["fold"]


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of letters and word edges, the text each is from, and which texts hold a letter.

    Letters are lower-cased, every run of other characters is one edge (0); grams of edges alone don't count.
    """
    joined = "\x00".join([*texts, ""]) if texts else ""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    letters = fold_table()[points]
    keep = (letters > 0) | (np.concatenate([[1], letters[:-1]]) > 0)  # of a run of edges the first
    letters, owner = letters[keep].astype(np.uint64), owner[keep]
    lettered = np.bincount(owner[letters > 0], minlength=len(texts)) > 0
    prev = np.concatenate([[0], letters[:-1]]).astype(np.uint64)
    prev2 = np.concatenate([[0], prev[:-1]]).astype(np.uint64)
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    prev[first] = 0
    second = np.concatenate([[False], first[:-1]])
    prev2[first | second] = 0
    shift = np.uint64(64 - GRAM_BITS)

    def code(a, b, c, size):
        h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9) + np.uint64(size * 0x27D4EB2F165667C5 % (1 << 64))
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> shift).astype(np.int32)

    zero = np.zeros(1, np.uint64)
    real, real2 = letters > 0, (letters > 0) | (prev > 0)
    real3 = real2 & ((letters > 0) | (prev2 > 0)) & (prev > 0)
    codes = np.concatenate([code(letters[real], zero, zero, 1), code(letters[real2], prev[real2], zero, 2), code(letters[real3], prev[real3], prev2[real3], 3)])
    return codes, np.concatenate([owner[real], owner[real2], owner[real3]]), lettered


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """``(lang, gram, rank)``: the ``size`` most frequent grams of every language, over all given texts.

    Each task sums its grams before the shuffle; rows with a null language or text are left out.  Equal counts rank by the gram's code.
    """

    def counted(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for value, rows in batch.groupby("_lang", sort=False):
                total = sums.setdefault(value, np.zeros(1 << GRAM_BITS, np.int64))
                texts = rows["_text"].tolist()
                for part in pieces([len(t) for t in texts], CHUNK_CHARS):
                    total += np.bincount(gram_codes(texts[part])[0], minlength=1 << GRAM_BITS)
                if len(sums) > 16:  # many languages: hand over what there is
                    yield from _sparse(sums)
                    sums = {}
        yield from _sparse(sums)

    def _sparse(sums):
        for value, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": value, "gram": at.astype(np.int32), "n": total[at]})

    rows = docs.select(F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text")).where("_lang IS NOT NULL AND _text IS NOT NULL")
    counts = rows.mapInPandas(counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # at most 2^20 grams a language
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """Profiles as a matrix (language x known gram) of ranks; a gram that a profile lacks is ``size`` places out."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.langs = sorted({r[0] for r in rows})
        grams = sorted({r[1] for r in rows})
        place = {g: i for i, g in enumerate(grams)}
        self.size = size
        self.index = np.full(1 << GRAM_BITS, -1, np.int32)
        self.index[grams] = np.arange(len(grams))
        self.ranks = np.full((len(self.langs), len(grams)), -1, np.int32)
        for lang, gram, rank in rows:
            self.ranks[self.langs.index(lang), place[gram]] = rank

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language with the least out-of-place distance (the first by name on ties) and 1 - distance / worst distance.

        All grams of a text are ranked (equal counts by code) and its ``size`` most frequent compared; one that no profile holds is ``size`` places out like one
        that a profile lacks, so a text of a language that was not learned scores low.
        """
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return names, scores
        codes, owner, lettered = gram_codes(texts)
        key = np.sort((owner.astype(np.int64) << GRAM_BITS) | codes)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count, key = np.diff(np.append(first, len(key))), key[first]
        text, gram = key >> GRAM_BITS, key & ((1 << GRAM_BITS) - 1)
        order = np.lexsort((gram, -count, text))
        text, gram = text[order], gram[order]
        start = np.searchsorted(text, np.arange(len(texts) + 1))
        place = np.arange(len(text)) - start[text]
        used = place < self.size
        text, place, known = text[used], place[used], self.index[gram[used]]
        rank = self.ranks[:, known]
        out = np.where((known >= 0) & (rank >= 0), np.abs(rank - place[None, :]), self.size)
        distance = np.stack([np.bincount(text, weights=row, minlength=len(texts)) for row in out])
        best = distance.argmin(axis=0)
        worst = np.bincount(text, minlength=len(texts)) * self.size
        for i in np.flatnonzero(lettered):
            names[i] = self.langs[best[i]]
        scores = np.where(lettered & (worst > 0), 1 - distance[best, np.arange(len(texts))] / np.maximum(worst, 1), 0.0)
        return names, np.clip(scores, 0.0, 1.0)


def identify(docs: DataFrame, profiles: DataFrame, size: int = PROFILE):
    """Column function text -> struct(lang_pred, score) from learned profiles (``size`` rows per language reach the driver)."""
    sent = docs.sparkSession.sparkContext.broadcast(Profiles([(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()], size))

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def guess(texts: pd.Series) -> pd.DataFrame:
        tool = sent.value
        values = texts.fillna("").tolist()
        names, scores = [], []
        for part in pieces([len(t) for t in values], max(1, CHUNK_CHARS // max(1, len(tool.langs) // 8))):
            got = tool.predict(values[part])
            names += got[0]
            scores += got[1].tolist()
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return guess


def identify_held_out(docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", folds: int = 4, fold: int = 2) -> DataFrame:
    """``(doc, held_out, lang_pred, score)`` of every whole text; profiles come from the other folds alone.

    The fold is crc32 of the id as text, modulo ``folds`` (a null id counts as an empty text).  A text that is null or has no letter is ``und``
    with score 0; without any labelled text all are ``und``.  Copies of a row stay rows.
    """
    remainder = F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit(""))) % folds
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), (remainder == fold).alias("_out"))
    guess = identify(docs, learn_profiles(rows.where(~F.col("_out")), "_text", "_lang"))
    found: Column = guess(F.col("_text"))
    return rows.select("_id", "_out", found.alias("_found")).select(
        F.col("_id").alias(doc), F.col("_out").alias("held_out"), "_found.lang_pred", "_found.score"
    )
