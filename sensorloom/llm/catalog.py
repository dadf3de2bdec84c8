"""Queries of the text operators, each over its whole table, with SQL where SQL can state the result."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.catalog.base import table
from sensorloom.llm import bpe, chosen_path, crf, decontaminate, langid, licenses, lines, ranked, spelling, substrings, vectors, warc, winnow
from sensorloom.session import folder

BPE = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf, "pages"), path, min_bytes=0)
    records = warc.read_archives(spark, path, with_payload=False).where("reason IS NULL")
    return records.select(
        F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.expr("try_cast(refers_to AS bigint)").alias("refers_to"),
    )


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(table(spark, sf, "documents"), *BPE)


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, min_docs=10, min_chars=1).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_quality_crf(spark: SparkSession, sf: str) -> DataFrame:
    return crf.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"), threshold=0.3)


def op5_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return winnow.fingerprint_pairs(table(spark, sf, "documents"))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf, "documents"), length=13, with_text=False)


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return langid.identify_held_out(table(spark, sf, "documents"))


def op9_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"))


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return chosen_path.similar_classes(table(spark, sf, "documents"))


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), top=50)


def op12_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf, "embeddings"), threshold=0.9)


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf, "documents"), least_chars=6, least_n=5, ratio=5, drop_every=199)


QUERIES = {f.__name__: f for f in (op1_warc, op2_bpe, op3_line_dedup, op4_quality_crf, op5_fingerprints, op6_decontamination, op7_substring_dedup, op8_language_id, op9_license_scan, op10_jaccard_join, op11_ranked_search, op12_near_vectors, op13_spelling_variants)}

ORACLES = {
    "op7_substring_dedup": r"""
        WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             r AS (SELECT doc_id, unnest(range(greatest(len(w) - 12, 0))) AS i, w FROM t),
             g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 13], ' ') AS run FROM r),
             m AS (SELECT run, min(doc_id) AS least FROM g GROUP BY run),
             c AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN m USING (run), (SELECT unnest(range(13)) AS j) WHERE least < doc_id),
             s AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id),
             k AS (SELECT doc_id, w, list_filter(range(len(w)), lambda p: NOT list_contains(coalesce(gone, []), p)) AS stay FROM t LEFT JOIN s USING (doc_id))
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(stay))::BIGINT AS n_removed,
               sha256(array_to_string(list_transform(stay, lambda p: w[p + 1]), ' ')) AS kept_sha256 FROM k
    """,
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
             k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
             s AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE s.key IS NOT NULL)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN s USING (key) GROUP BY doc_id
    """,
    "op11_ranked_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
             n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
             a AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
             w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term, docs),
             s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score
                   FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (doc_id), a GROUP BY item_id, doc_id),
             r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
    """,
    "op12_near_vectors": r"""
        WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)),
             v AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS l FROM u WHERE isfinite(list_inner_product(e, e)) AND list_inner_product(e, e) > 0),
             k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.9),
             c(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT k.b, c.root FROM c JOIN k ON c.vec_id = k.a)
        SELECT vec_id, (SELECT count(*) FROM k WHERE k.a = c.vec_id)::BIGINT AS n_links, min(root)::BIGINT AS component_id, vec_id = min(root) AS kept FROM c GROUP BY vec_id
    """,
    "op13_spelling_variants": r"""
        WITH RECURSIVE bits(b, c, k) AS (
               SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL
               SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
             crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
             r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents),
             l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM r),
             o AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS s, w, count(*) AS times FROM l GROUP BY ALL),
             h AS (SELECT w, times, xor(4294967295, list_reduce(list_transform(range(1, strlen(hex(s)) // 2 + 1), lambda i: ('0x' || substr(hex(s), 2 * i - 1, 2))::BIGINT),
                          lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295)) AS h FROM o, crc),
             d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, times FROM h),
             v AS (SELECT word, sum(times)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
             c AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
             e AS (SELECT a.word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                   UNION SELECT c.word, v.word, v.n FROM c JOIN v ON c.rest = v.word
                   UNION SELECT v.word, c.word, c.n FROM c JOIN v ON c.rest = v.word),
             q AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
                          row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM e),
             f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
                   FROM v LEFT JOIN q ON v.word = q.word AND place = 1),
             w(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT w.word, f.form, step + 1 FROM w JOIN f ON w.root = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(root, step) AS root FROM w GROUP BY word) USING (word)
    """,
}
