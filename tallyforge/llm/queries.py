"""The queries of the operators in this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, langid, line_dedup, mixing, ngram_join, pii, suffix_dedup, warc
from .common import load


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(load(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM a),
l AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id) AS n
      FROM e WHERE length(trim(line)) > 0),
w AS (SELECT doc_id, i, k, n, line, lead(line) OVER d AS line2, lead(line, 2) OVER d AS line3, lead(i, 2) OVER d AS i3,
             max(i) OVER (PARTITION BY doc_id) AS i_max
      FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
v AS (SELECT doc_id, i AS first, k, least(n, 3) AS width, CASE WHEN n < 3 THEN i_max ELSE i3 END AS last, line, line2, line3
      FROM w WHERE k <= greatest(n - 2, 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY width, line, line2, line3 ORDER BY doc_id, k) AS occurrence FROM v),
g AS (SELECT doc_id, unnest(generate_series(first, last)) AS i FROM o WHERE occurrence > 1),
r AS (SELECT DISTINCT doc_id, i FROM g),
f AS (SELECT e.doc_id, e.i, e.line, r.i IS NOT NULL AS gone, length(trim(e.line)) > 0 AS filled,
             lag(r.i IS NOT NULL, 1, false) OVER (PARTITION BY e.doc_id ORDER BY e.i) AS gone_before
      FROM e LEFT JOIN r ON e.doc_id = r.doc_id AND e.i = r.i),
s AS (SELECT doc_id, CAST(count(*) FILTER (filled) AS BIGINT) AS n_lines, CAST(count(*) FILTER (filled AND gone) AS BIGINT) AS n_removed,
             CAST(count(*) FILTER (gone AND NOT gone_before) AS BIGINT) AS n_runs,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       sha256(CASE WHEN d.text IS NOT NULL THEN kept END) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""


def op4_pii(spark: SparkSession, sf_dir: str, key: str = "tallyforge") -> DataFrame:
    return pii.pseudonyms(load(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(load(spark, sf_dir, "pages")))
    return read.where("record_type IS NOT NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM r
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(docs.where(~F.col("held_out")))
    found = langid.identify(docs.select("doc_id", "text", "held_out"), model)
    return found.select("doc_id", "held_out", F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"), F.col("lang_id.ambiguous").alias("ambiguous"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight,
             CAST(source_size * 3 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM w),
f AS (SELECT *, cap < here * weight AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
             (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0.0)) / sum(CASE WHEN NOT is_full THEN weight END) OVER () * weight END AS target FROM f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS want,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS rounds FROM r)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(size, want - rounds * source_size - before)) AS BIGINT) AS taken
FROM k
"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(load(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(load(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ann, op2_ngram_join, op3_line_dedup, op4_pii, op5_warc, op6_language_id, op7_mixing, op8_suffix_dedup, op9_fingerprints, op10_bpe)
}
SQL: dict[str, str] = {"op3_line_dedup": OP3_SQL, "op5_warc": OP5_SQL, "op7_mixing": OP7_SQL}
