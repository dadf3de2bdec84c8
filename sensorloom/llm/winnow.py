"""Winnowed document fingerprints from built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 5
WINDOW = 8
_PLACE_BITS = 26
_PLACES = (1 << _PLACE_BITS) - 1
_LONGS = "array<bigint>"


def _get(array: str, i: Column) -> Column:
    return F.get(F.col(array), i)


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``out`` = struct(hashes, places): the winnowed fingerprint of column ``text``; null texts give null.

    Words are runs without white space.  Every run of ``gram`` words is hashed to 64 bits (a shorter text is one
    run), and of each ``window`` consecutive hashes the least is kept, the rightmost one on ties, with its word position.  Two texts that share
    ``gram + window - 1`` consecutive words share a fingerprint hash.  ``window`` is a power of two: minima
    are taken over 2, 4, 8 ... neighbours, so that the cost per word does not depend on it.
    The rank of a hash is its low 37 bits; with the place in the other bits, one integer minimum settles the ties.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    t, h, g, m = (f"_{out}_{c}" for c in "thgm")
    df = df.withColumn(t, F.array_remove(F.split(F.col(text), r"\s+"), ""))
    df = df.withColumn(h, F.transform(t, lambda w: F.xxhash64(w))).drop(t)
    runs = F.transform(
        F.slice(h, 1, F.size(h) - (gram - 1)), lambda x, i: F.xxhash64(x, *[_get(h, i + j) for j in range(1, gram)])
    )
    df = df.withColumn(
        g, F.when(F.size(h) >= gram, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).when(F.size(h) == 0, F.array().cast(_LONGS))
    ).drop(h)
    rank = F.transform(g, lambda x, i: F.shiftleft(x.bitwiseAND(F.lit((1 << 37) - 1)), _PLACE_BITS).bitwiseOR(F.lit(_PLACES) - i.cast("bigint").bitwiseAND(F.lit(_PLACES))))
    df = df.withColumn(m, rank)
    width = 1
    while width < window:
        step = f"{m}{width}"
        df = df.withColumn(step, F.zip_with(m, F.slice(m, width + 1, F.greatest(F.size(m), F.lit(0))), lambda a, b: F.least(a, b))).drop(m)
        df = df.withColumnRenamed(step, m)
        width *= 2
    kept = F.array_distinct(F.slice(m, 1, F.greatest(F.size(m) - (window - 1), F.lit(1))))
    df = df.withColumn(f"{m}_kept", F.transform(kept, lambda x: F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES)))).drop(m)
    hashes = F.transform(f"{m}_kept", lambda i: _get(g, i.cast("int")))
    return df.withColumn(out, F.struct(hashes.alias("hashes"), F.col(f"{m}_kept").alias("places"))).drop(g, f"{m}_kept")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def printed(fingerprint: str) -> Column:
    """``hash:place`` pairs in order, comma-joined."""
    pair = F.zip_with(f"{fingerprint}.hashes", f"{fingerprint}.places", lambda h, p: F.concat(F.lower(F.hex(h)), F.lit(":"), p.cast("string")))
    return F.array_join(pair, ",")


def with_next(docs: DataFrame, key: str, tie: str, text: str) -> DataFrame:
    """Add ``_bucket`` and ``next_text``: the text of the next row by ``(key, tie)``; after the last comes the first.

    Rows are cut into ranges of the key at its approximate quantiles (as many as four per shuffle partition, that is
    all that reaches the driver) and texts move once, to their range; the first text of each range closes the one before it.
    """
    spark = docs.sparkSession
    wanted = max(1, min(4096, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = docs.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)] or [0.5], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast(_LONGS)
    rows = docs.withColumn("_bucket", F.size(F.filter(edges, lambda x: x <= F.col(key))))
    order = Window.partitionBy("_bucket").orderBy(key, tie)
    # one row per range: the text at its start, handed to the range before it
    starts = rows.groupBy("_bucket").agg(F.min(key).alias("_least")).withColumnRenamed("_bucket", "_range")
    first = (
        rows.join(starts, (F.col("_bucket") == F.col("_range")) & (F.col(key) == F.col("_least")))
        .groupBy("_bucket").agg(F.min_by(text, tie).alias("_first"))
    )
    ranges = Window.orderBy("_bucket")
    before = first.select(
        F.coalesce(F.lag("_bucket").over(ranges), F.max("_bucket").over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_range"), "_first"
    )
    led = rows.withColumn("_next", F.lead(text).over(order))
    return led.join(before, F.col("_bucket") == F.col("_range"), "left").select(
        *docs.columns, "_bucket", F.coalesce("_next", "_first").alias("next_text"), F.when(F.col("_next").isNull(), F.col("_first")).alias("_edge_text")
    )


def fingerprint_pairs(docs: DataFrame, text: str = "text", doc: str = "doc_id", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text, of its edited form and how alike they and the next text are.

    The edited form has its last half (rounded down) replaced by as many first code points of the next text (or all it has).
    Null texts are empty; rows without an id come first, ties are ordered by the text's hash; copies of a row stay rows; an empty table gives an empty one.
    Columns: ``doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    rows = docs.select(
        F.col(doc).alias("_id"), F.coalesce(F.col(doc).cast("bigint"), F.lit(-(2**63))).alias("_key"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).withColumn("_tie", F.xxhash64("_text"))
    half = F.floor(F.length("_text") / 2).cast("int")
    met = with_next(rows, "_key", "_tie", "_text").withColumn(
        "_edited", F.concat(F.substring("_text", F.lit(1), F.length("_text") - half), F.substring("next_text", F.lit(1), half))
    )
    met = met.select("_id", "_key", "_tie", "_bucket", "_edge_text", "_text", "_edited", F.length("_text").cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"))
    for source, out in (("_text", "_own"), ("_edited", "_new"), ("_edge_text", "_edge")):
        met = with_fingerprint(met, source, out, gram, window)
    order = Window.partitionBy("_bucket").orderBy("_key", "_tie")
    return met.select(
        "_id", "n_chars", "edited_sha256", "_own", "_new",
        F.coalesce(F.lead("_own.hashes").over(order), F.col("_edge.hashes")).alias("_after"),
    ).select(
        F.col("_id").alias(doc), "n_chars", "edited_sha256",
        printed("_own").alias("fingerprint"), printed("_new").alias("edited_fingerprint"),
        likeness(F.col("_own.hashes"), F.col("_new.hashes")).alias("near_edited"),
        likeness(F.col("_own.hashes"), F.col("_after")).alias("near_next"),
    )
