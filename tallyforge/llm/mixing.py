"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources in code point order, null last, weigh 1, 2, 3, repeating (or as given) and share the words of the whole
corpus. No source gives more than max_epochs times its words; the excess is shared again by weight until none is
above. The level is found in closed form: sorted by cap / weight, a source is at its cap when the level that the
rest of the words would give to it and all later ones lies above its cap.

Repetitions: a source's target is so many whole rounds over its documents plus a rest. The rest takes documents in
the order of a seeded digest of doc_id until it is used up; the document at the border gives the words still
missing. So the words taken equal the target to the word, whatever the sizes, and reruns agree.

Skew: the running sum within a source is taken in 4096 digest buckets, whose sums are added up first. No task sees
more than its buckets, though one source may hold a third of all rows.

Cases: very long texts are read whole. Extra columns stay in `mixed`, whatever their names. Null or empty text counts 0 words and is taken 0 times. A null source is a source of its own, the last. Null
doc_ids share one digest and are ordered by size. Repeated rows are each a document. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, packed, stage, unpacked


def _digest(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}")))


def targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds weight and target. One row per source is sorted."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum(F.col("source_size")).over(whole).cast("double"))
    s = s.withColumn("level_here", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("full", F.col("cap") < F.col("level_here") * F.col("weight"))
    full_caps = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - full_caps) / open_weight * F.col("weight")))
    return s.select("source", "source_size", "weight", "target")


def mix_plan(docs: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1, 2, 3), seed: str = "mix", text: str = "text", key: str | None = None) -> DataFrame:
    """Return key (if one is named: a column that tells rows apart), doc_id, source, size, source_size, target, taken, repeats (whole rounds) and rest (words of the last, partial round)."""
    own = [key] if key else []
    rows = docs.select(*own, "doc_id", "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _digest("doc_id", seed).alias("digest"))
    rows = stage(rows.withColumn("bucket", F.substring("digest", 1, 3)), "mix")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    aim = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), max_epochs, weights)
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0))).drop("bucket_size")
    buckets = buckets.join(aim.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    b = buckets.withColumnsRenamed({"source": "b_source", "bucket": "b_bucket"})
    rows = rows.join(b, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")))
    here = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(here), F.lit(0)))
    want = F.floor("target").cast("long")
    rows = rows.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), want - F.col("repeats") * F.col("source_size") - F.col("before"))).cast("long"))
    return rows.select(*own, "doc_id", "source", "size", "source_size", "target", (F.col("repeats") * F.col("size") + F.col("rest")).alias("taken"), "repeats", "rest")


def mixed(docs: DataFrame, max_epochs: int = 3, weights: tuple[float, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    Whole documents only: a partial round counts as a whole one if it takes at least half of the document's words.
    Rows are told apart by common.keyed, so that null and shared doc_ids are mixed row by row. Documents without words are left out.
    """
    d, _ = keyed(packed(docs, "doc_id", "source", "text"))
    plan = mix_plan(d, max_epochs, weights, seed, key="_key")
    times = (F.col("repeats") + (F.col("rest") * 2 >= F.col("size")).cast("long")).cast("int")
    plan = plan.where("size > 0").select(F.col("_key").alias("_mix_id"), times.alias("_mix_times")).where("_mix_times > 0")
    repeated = d.join(plan, d["_key"] == plan["_mix_id"]).withColumn("_mix_round", F.explode(F.sequence(F.lit(1), F.col("_mix_times"))))
    return unpacked(repeated, docs.columns)
