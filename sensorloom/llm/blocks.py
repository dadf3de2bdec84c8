"""Exchange of packed arrays between blocks of documents and hash buckets.

A block holds whole documents of a bounded number of bytes, a bucket a share of the hash values.  Blocks ask buckets about
their distinct values and get back an answer for the block, so a value that stands in very many documents crosses the
network once per block and meets at most as many equals as there are blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def in_blocks(docs: DataFrame, key: str, n_bytes: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with ``_block``: documents dealt by the hash of their key into blocks of about ``block_bytes``."""
    n = max(2 * shuffle_partitions(docs), -(-n_bytes // block_bytes))
    return docs.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def dealt(values: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the indices of their values."""
    if not len(values):
        return
    bucket = (values % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for start, end in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield int(bucket[order[start]]), order[start:end]


def unpack(blobs, kind) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(b) for b in blobs), kind)


def found_in(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted table, -1 where it is not there."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


def bucket_count(df: DataFrame, n_bytes: float, bucket_bytes: int = 16 << 20) -> int:
    return max(shuffle_partitions(df), int(-(-n_bytes // bucket_bytes)))


def long_key(column: Column) -> Column:
    """An id as a long; null ids sort lowest."""
    return F.coalesce(column.cast("bigint"), F.lit(-(2**63)))
