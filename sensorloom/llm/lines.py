"""Lines that many documents share are dropped everywhere."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def dedup_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Rows ``(row, n_lines, n_dropped, kept)``: the input row as a struct, and its text without the shared lines.

    Lines are exploded, and the 96-bit hashes of their keys counted over distinct documents (summed on the map side,
    so a line of every document is one row per task).  Lines whose key has at least ``min_chars`` code points and
    stands in at least ``min_docs`` documents go; their positions meet the document again, and the other lines are
    put together in order.  Copies of a row count as one document and all get the same result.  A null text is an empty one (one empty line);
    rows without an id are together one document; an empty table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(doc).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    key = line_key(F.col("_line"))
    lines = (
        rows.select("_id", F.xxhash64("_text").alias("_t"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .where(F.length(key) >= min_chars)
        .select("_id", "_t", "_pos", F.xxhash64(key).alias("_h"), F.hash(key).alias("_g"))
    )
    shared = lines.groupBy("_h", "_g").agg(F.count_distinct(F.struct("_id")).alias("_n")).where(F.col("_n") >= min_docs).select("_h", "_g")
    dropped = lines.join(shared, ["_h", "_g"], "left_semi").groupBy("_id", "_t").agg(F.collect_set("_pos").alias("_drop"))
    met = rows.withColumn("_t", F.xxhash64("_text")).alias("a").join(
        dropped.alias("b"), F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._t") == F.col("b._t")), "left"
    ).select("a.row", "a._text", F.coalesce("b._drop", F.array().cast("array<int>")).alias("_drop"))

    def without(split: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_drop"))
        return F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")

    return met.select(
        "row",
        (F.length(F.regexp_replace("_text", "[^\n]+", "")) + 1).cast("bigint").alias("n_lines"),
        F.size("_drop").cast("bigint").alias("n_dropped"),
        # the outer array binds the split text, so that it is split once and not once per line
        F.when(F.size("_drop") == 0, F.col("_text")).otherwise(F.transform(F.array(F.split("_text", "\n")), without)[0]).alias("kept"),
    )
