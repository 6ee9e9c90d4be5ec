"""Exact and representation-level dedup, overlap and decontamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def keep_first(df: DataFrame, digest: Column, order: str) -> DataFrame:
    """U4: first row of each digest, with copies, the number of rows that share it. Digests are counted before rows move."""
    d = df.select(digest.alias("digest"), order)
    return d.groupBy("digest").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def ordered_distinct(df: DataFrame, group: list[str], key: str, pos: str) -> DataFrame:
    """First row of each key in a group."""
    w = Window.partitionBy(*group, key).orderBy(pos)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def version_counts(df: DataFrame, text: Column) -> DataFrame:
    """Digest, length and count of each distinct text."""
    return df.groupBy(F.sha2(text, 256).alias("digest"), F.length(text).cast("long").alias("length")).agg(F.count("*").alias("n"))


def shingles(text: Column, n: int) -> Column:
    """Distinct hashes of n words in a row; none for shorter texts."""
    # the words are a variable of the function, so that a text is cut once and not once a shingle
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<long>"))
    return F.array_distinct(tx.let(tx.words(text), runs))


def contaminated(docs: DataFrame, bench: DataFrame, n: int = 8) -> DataFrame:
    """doc_ids that share n words in a row with a benchmark text. The benchmark's shingles are broadcast only while the optimizer sees that they are small."""
    marks = bench.select(F.explode(shingles(F.col("text"), n)).alias("s")).distinct()
    return docs.select("doc_id", F.explode(shingles(F.col("text"), n)).alias("s")).join(marks, "s", "left_semi").select("doc_id").distinct()


def overlap_rates(a: DataFrame, b: DataFrame, levels: dict[str, Column]) -> DataFrame:
    """For each representation: signatures of a, those that b has too, rows of a that match, and their rate."""
    out = None
    for name, c in levels.items():
        x = a.select(F.sha2(c, 256).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
        y = b.select(F.sha2(c, 256).alias("t")).distinct()
        j = x.join(y, F.col("s") == F.col("t"), "left")
        hit = F.col("t").isNotNull()
        row = j.agg(F.count("*").alias("signatures"), F.count_if(hit).alias("shared"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("long").alias("matched_rows"), F.sum("n").cast("long").alias("all_rows"))
        row = row.select(F.lit(name).alias("level"), "signatures", "shared", "matched_rows", F.try_divide(F.col("matched_rows").cast("double"), F.col("all_rows").cast("double")).alias("matched_rate"))
        out = row if out is None else out.unionByName(row)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Of two bags without repeats; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union.cast("double")))


def nearest_bags(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, bag: str, k: int = 5) -> DataFrame:
    """The k rows most like each query by Jaccard similarity of their bags, smaller ids first on ties.

    Shared items are counted through an equi-join on the items that the queries hold; rows without any shared item
    have similarity 0 and are not listed.
    """
    q = queries.select(query_id, F.size(bag).alias("qn"), F.explode(bag).alias("item"))
    r = rows.select(row_id, F.size(bag).alias("rn"), F.explode(bag).alias("item"))
    both = q.join(r, "item").groupBy(query_id, row_id, "qn", "rn").agg(F.count("*").alias("common"))
    both = both.withColumn("similarity", F.col("common").cast("double") / (F.col("qn") + F.col("rn") - F.col("common")))
    w = Window.partitionBy(query_id).orderBy(F.desc("similarity"), row_id)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "rank", row_id, "similarity")


def append_new(base: DataFrame, more: DataFrame, digest: Column, order: list[str]) -> DataFrame:
    """Base and the rows of more whose digest base lacks, of each the first in `order`."""
    have = base.select(digest.alias("_d")).distinct()
    new = more.withColumn("_d", digest).join(have, "_d", "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in more.columns])
    new = new.groupBy("_d").agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")
    return base.unionByName(new, allowMissingColumns=True)
