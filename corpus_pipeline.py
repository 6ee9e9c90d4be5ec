"""A corpus pipeline of five stages; each takes the documents that its predecessor kept.

run(spark, sf_dir) applies them to the documents table. Between stages the documents are written as Parquet to the
shared folder and read again.

All stages: rows are told apart even where doc_ids are null or shared (by text, then as copies of the first); very long
texts are read whole; no rows give no rows; all but the last hand on extra columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, langid, line_dedup, mixing, ngram_join
from tallyforge.llm.common import load, packed, stage, unpacked
from tallyforge.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, or no letter in it. lang becomes the language found, unless that is ambiguous."""
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(packed(docs, "text", "lang"), model).where(F.col("lang_id.lang") != "und")
    lang = F.when(F.col("lang_id.ambiguous") & F.col("lang").isNotNull(), F.col("lang")).otherwise(F.col("lang_id.lang"))
    return unpacked(found, docs.columns, lang=lang)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut out of the texts; documents of which nothing but blanks is left go. A null text stays."""
    cut = line_dedup.dedup(packed(docs, "doc_id", "text", without=("text",)))  # a text moves once
    cut = cut.where((F.col("n_runs") == 0) | (F.col("n_removed") < F.col("n_lines")))
    n_chars = F.when(F.col("n_runs") > 0, F.length("text")).otherwise(F.col("rest.n_chars"))
    return unpacked(cut, docs.columns, text=F.col("text"), n_chars=n_chars.cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (Jaccard similarity of 0.8 or more, closed over links) the first document stays."""
    return ngram_join.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; documents appear as often as the mix takes them. Documents without words go, as they add nothing to a mix of words."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; a null text has none."""
    out = bpe.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_path())
    return out.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("ngram_join", near_duplicates),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: The first stage learns a classifier and the last one needs a tokenizer file, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
