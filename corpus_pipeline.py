"""From raw documents to tokens: quality, shared lines, near duplicates, benchmark leaks, byte-level BPE.

Each stage works on all that the one before kept; its result is written to the shared folder as Parquet and read again, so a lost
executor costs a re-read and no stage is computed twice.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.catalog.base import table
from sensorloom.llm import bpe, catalog, chosen_path, crf, decontaminate, lines
from sensorloom.session import folder, settle

LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``LEAST_QUALITY``; the field of lines is fitted on the labelled ones.

    Null and empty texts are scored like any other; repeated rows get one score, so they stay or go together; an empty table stays empty.
    """
    score = crf.score_column(crf.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) >= LEAST_QUALITY)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents share; ``n_chars`` follows the text.

    Null texts become empty; repeated rows count as one document, rows without an id together as one; no row is lost.
    """
    cut = lines.dedup_lines(docs, min_docs=10, min_chars=1)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id (rows without an id last), once.

    Rows are told apart by a number of their own, so repeated ids and missing ones do no harm: of repeated rows and of equal texts (null ones are
    empty) one row stays, and rows without an id are compared like any other.
    """
    rows = settle(docs.withColumn("_row", F.monotonically_increasing_id()))  # numbers are fixed once written
    classes = chosen_path.similar_classes(rows.select("_row", "text"), doc="_row").select("_row", "class_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = rows.select("_row", "doc_id").join(classes, "_row").groupBy("class_id").agg(F.min_by("_row", order).alias("_row"))
    return rows.join(first.select("_row"), "_row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A leak is a matter of the text alone, so texts are searched under their digests: repeated rows and rows without an id go only if their own text
    leaks.  Null and empty texts stay.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("_digest")
    leaks = decontaminate.contaminated(docs.select(digest, "text"), table(spark, sf_dir, "benchmark"), doc="_digest").select("_digest").distinct()
    return docs.withColumn("_digest", digest).join(leaks, "_digest", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with digests of the ids and of the decoded bytes; null texts are empty and have no ids."""
    return bpe.digests(docs, *catalog.BPE, with_ids=True)


STAGES = [
    ("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination), ("byte-level BPE", tokens),
]
#: The conditional random field and the latent space have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs


QUERIES = catalog.QUERIES | {"pipeline": run}
ORACLES = catalog.ORACLES | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
