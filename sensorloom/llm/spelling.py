"""Spelling variants: words one edit apart, found with bit-sliced position indexes, and the form each is taken for."""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.session import settle

RUN = r"[A-Za-zÀ-ÿ]"
LEAST_CHARS = 6
LEAST_N = 5
RATIO = 5
BUNDLE = 8192
BATCH_BYTES = 1 << 20
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def occurrences(docs: DataFrame, text: str, doc: str, least_chars: int, drop_every: int | None) -> DataFrame:
    """``(word)``: every run of letters of at least ``least_chars`` code points, A-Z lower-cased.

    Of one run in ``drop_every`` (by the crc32 of ``<doc>:<run>``) the code point at the hash's remainder by the length is deleted.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({RUN}{{{least_chars},}})"), F.lit(1))
    words = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("_d"), F.explode(runs).alias("_r"))
    words = words.select("_d", F.translate("_r", string.ascii_uppercase, string.ascii_lowercase).alias("_w"))
    if drop_every is None:
        return words.select(F.col("_w").alias("word"))
    hashed = F.crc32(F.concat("_d", F.lit(":"), "_w").cast("binary"))
    at = (F.col("_h") % F.length("_w")).cast("int")
    cut = F.concat(F.substring("_w", F.lit(1), at), F.substring("_w", at + 2, F.length("_w")))
    words = words.withColumn("_h", hashed).select(F.when(F.col("_h") % drop_every == 0, cut).otherwise(F.col("_w")).alias("word"))
    return words.where(F.length("word") >= least_chars)


class Index:
    """Bitsets over entries of ``m`` or ``m + 1`` letters: one per (position, letter), 64 entries a word."""

    def __init__(self, letters: np.ndarray, m: int):
        self.m, self.k, self.n = m, m // 2, len(letters)
        self.width = -(-len(letters) // 64)
        self.codes = np.zeros(256, np.intp)
        used = np.unique(letters)
        used = used[used > 0]
        self.codes[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((m + 1, len(used) + 1, self.width), np.uint64)
        for at in range(m + 1):
            held = np.unique(letters[:, at])
            for letter in held[held > 0]:
                self.table[at, self.codes[letter]] = self.bits(letters[:, at] == letter)
        self.short = self.bits(letters[:, m] == 0)
        self.all = self.bits(np.ones(len(letters), bool))

    def bits(self, member: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.width * 8, np.uint8)
        held = np.packbits(member, bitorder="little")
        packed[: len(held)] = held
        return packed.view("<u8")

    def near_short(self, queries: np.ndarray, halves: bool) -> np.ndarray:
        """For queries of ``m`` letters: entries of ``m`` letters with one other letter, entries of ``m + 1`` with one more letter.

        ``zero`` holds the entries that agree so far; ``other`` those with one replaced letter, read at the same position; ``more`` those with
        one letter more, read one position on.  ``halves``: only entries that agree in the first half, or only others.
        """
        zero = np.broadcast_to(self.all, (len(queries), self.width)).copy()
        other, more, half = np.zeros_like(zero), np.zeros_like(zero), zero
        for i in range(self.m):
            here = self.table[i][queries[:, i]]
            more = (more | zero) & self.table[i + 1][queries[:, i]]
            other = (other & here) | (zero & ~here)
            zero = zero & here
            if i + 1 == self.k:
                half = zero
        found = (other & self.short) | ((more | zero) & ~self.short)
        return found & half if halves else found & ~half

    def near_long(self, queries: np.ndarray, halves: bool) -> np.ndarray:
        """For queries of ``m + 1`` letters: entries of ``m`` letters with one letter less, read one position back."""
        zero = np.broadcast_to(self.all, (len(queries), self.width)).copy()
        less, half = zero, zero
        for i in range(self.m + 1):
            less = (less & self.table[i - 1][queries[:, i]]) | zero if i else zero
            zero = zero & self.table[i][queries[:, i]]
            if i + 1 == self.k:
                half = zero
        found = less & self.short
        return found & half if halves else found & ~half

    def pairs(self, queries: np.ndarray, halves: bool, seen: np.ndarray | None = None):
        """Yield ``(query, entry)`` indices for near ones, a bounded number of queries at a time; ``seen[i]`` picks query i's row of allowed entries."""
        coded = self.codes[queries]
        long = queries[:, self.m] > 0
        step = max(1, BATCH_BYTES // (8 * self.width))
        for rows, search in ((np.flatnonzero(~long), self.near_short), (np.flatnonzero(long), self.near_long)):
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                found = search(coded[part], halves)
                if seen is not None:
                    found &= seen[part]
                at, word = np.nonzero(found)
                hit, bit = np.nonzero(found[at, word][:, None] & _BITS[None, :])
                yield part[at[hit]], word[hit] * 64 + bit


def _letters(words: list[str], m: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.encode("latin-1").ljust(m + 1, b"\0") for w in words), np.uint8).reshape(len(words), m + 1)


def _searched(task: pd.DataFrame) -> pd.DataFrame:
    """Near words inside one bundle of words that share a half: their number and the most frequent one."""
    task = task.sort_values("word", key=lambda s: s.str.encode("latin-1")).reset_index(drop=True)
    m, halves = int(task["m"].iloc[0]), bool(task["side"].iloc[0])
    words, n, part = task["word"].tolist(), task["n"].to_numpy(), task["_part"].to_numpy()
    letters = _letters(words, m)
    index = Index(letters, m)
    seen = None
    if part.min() != part.max():  # two parts of a large group: only pairs across
        masks = {p: index.bits(part != p) for p in np.unique(part)}
        seen = np.stack([masks[p] for p in part])
    count, best_n, best = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), -1)
    for query, entry in index.pairs(letters, halves, seen):
        count += np.bincount(query, minlength=len(words))
        order = np.lexsort((entry, -n[entry], query))
        first = order[np.flatnonzero(np.diff(query[order], prepend=-1))]
        best[query[first]], best_n[query[first]] = entry[first], n[entry[first]]
    found = np.flatnonzero(count)
    text = [pd.Series([words[i] for i in at], dtype=object) for at in (found, best[found])]
    return pd.DataFrame({"word": text[0], "n_near": count[found], "near_n": best_n[found], "near": text[1]})


def near_words(vocabulary: DataFrame, least_chars: int = LEAST_CHARS, bundle: int = BUNDLE) -> DataFrame:
    """``(word, n_near, near_n, near)`` for every word of ``vocabulary (word, n)`` with near words: their number, and the most frequent one with its count.

    Two words one edit apart, the shorter of m letters, agree in their first ``m // 2`` letters or in the last ``m - m // 2`` of the shorter.  So words meet
    by (m, half): those of m letters and those of m + 1, in bundles of at most about ``bundle`` words by the hash of the half; a half
    shared by more words is cut into parts, every two of which meet.  Each bundle is a bit-sliced index searched by all its words.  Pairs that agree in the
    first half are counted there only, so none counts twice, and no pairs are listed.
    """
    length = F.length("word")
    roles = vocabulary.select("word", "n", F.explode(F.when(length > least_chars, F.array(length, length - 1)).otherwise(F.array(length))).alias("m"))
    roles = roles.select("word", "n", "m", F.explode(F.array(F.lit(True), F.lit(False))).alias("side"))
    roles = roles.withColumn("_half", F.xxhash64(F.when(F.col("side"), F.expr("left(word, floor(m / 2))")).otherwise(F.expr("right(word, m - floor(m / 2))"))))
    groups = roles.groupBy("side", "m", "_half").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    groups = settle(groups.withColumn("_parts", F.when(F.col("_size") <= bundle, 1).otherwise(F.ceil(F.col("_size") * 2 / bundle).cast("int"))))
    lengths = groups.where("_parts = 1").groupBy("side", "m").agg(F.ceil(F.sum("_size") / bundle).cast("int").alias("_bundles"))
    dealt = groups.join(lengths, ["side", "m"], "left")
    met = roles.join(dealt.drop("_size"), ["side", "m", "_half"]).withColumn("_part", F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    task = F.when(F.col("_parts") == 1, F.xxhash64(F.pmod("_half", F.col("_bundles")), F.lit(1))).otherwise(
        F.xxhash64("_half", F.least("_part", "_other"), F.greatest("_part", "_other"))
    )
    met = met.select("word", "n", "m", "side", "_part", task.alias("_task"))
    found = met.groupBy("side", "m", "_task").applyInPandas(_searched, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("_best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("_best.n")).alias("near_n"), F.col("_best.w").alias("near"))


def _with_roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: forms followed to the last; every round doubles the step, and forms only grow, so there are no circles."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        if now.join(on, F.col("root") == F.col("_w"), "left_semi").isEmpty():
            return now
        now = settle(now.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")))


def spelling_groups(docs: DataFrame, text: str = "text", doc: str = "doc_id", least_chars: int = LEAST_CHARS, least_n: int = LEAST_N, ratio: int = RATIO, drop_every: int | None = None, bundle: int = BUNDLE) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of at least ``least_chars`` letters that occurs at least ``least_n`` times.

    A word is a run of letters with A-Z lower-cased; ``drop_every`` deletes a letter of a fixed share of them (see :func:`occurrences`).  Two words are near if one inserted, deleted or
    replaced letter tells them apart.  A word's form is its near word of largest count (ties: the least in code-point order), if that occurs at least ``ratio``
    times as often, else null; its root is the last form that forms lead to, or the word itself.

    Occurrences are summed before they are shuffled, so a very frequent word is one row a task.  Null and empty texts hold no words; rows without an id hash with an empty one;
    repeated rows count again; words of any length are compared whole; an empty table gives an empty one.
    """
    if least_chars < 2:
        raise ValueError("words need two letters at least")
    words = occurrences(docs, text, doc, least_chars, drop_every)
    vocabulary = settle(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n))
    near = near_words(vocabulary, least_chars, bundle)
    is_form: Column = F.col("near_n") >= ratio * F.col("n")
    named = settle(
        vocabulary.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
        )
    )
    roots = _with_roots(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
