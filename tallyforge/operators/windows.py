"""Selections and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(df: DataFrame, bucket: list[str], distance: str, order: str, limit: int, group: list[str] | None = None) -> DataFrame:
    """One row per bucket and pass, nearest first; buckets in the order of their first row; `limit` rows of each group.

    A row of a later pass than `limit` cannot be chosen, and no more than `limit` buckets can, so each bucket is cut
    to `limit` rows before the group is sorted.
    """
    group = group or []
    w = Window.partitionBy(*group, *bucket).orderBy(distance, order)
    d = df.withColumn("pass", F.row_number().over(w)).where(F.col("pass") <= limit)
    first = df.groupBy(*group, *bucket).agg(F.min(order).alias("bucket_order"))
    d = d.join(first, [*group, *bucket])
    place = Window.partitionBy(*group).orderBy("pass", "bucket_order")
    return d.withColumn("place", F.row_number().over(place)).where(F.col("place") <= limit).drop("bucket_order")


def shape_cap(df: DataFrame, shape: list[str], full_shape: list[str], order: list[Column], cap: int) -> DataFrame:
    """At most `cap` rows of each shape, taken in turns from its full shapes (larger ones first), the best of each first."""
    sizes = df.groupBy(*full_shape).agg(F.count("*").alias("_size"))
    within = Window.partitionBy(*full_shape).orderBy(*order)
    d = df.withColumn("_turn", F.row_number().over(within)).where(F.col("_turn") <= cap).join(sizes, full_shape)
    across = Window.partitionBy(*shape).orderBy("_turn", F.desc("_size"), *full_shape)
    return d.withColumn("shape_rank", F.row_number().over(across)).where(F.col("shape_rank") <= cap).drop("_turn", "_size")


def cap_curve(df: DataFrame, shape: list[str], caps: list[int]) -> DataFrame:
    """Rows that would stay under each cap. Shapes are counted by size first."""
    sizes = df.groupBy(*shape).count().groupBy("count").agg(F.count("*").alias("shapes"))
    sizes = sizes.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    return sizes.groupBy("cap").agg(F.sum(F.least("count", "cap") * F.col("shapes")).alias("kept"))


def sessions(df: DataFrame, start: str, end: str, gap: float, by: list[str]) -> DataFrame:
    """Intervals joined unless a start lies more than `gap` after the latest end so far. session counts from 1."""
    w = Window.partitionBy(*by).orderBy(start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_new", (latest.isNull() | (F.col(start) - latest > gap)).cast("int"))
    d = d.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "session").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def trailing_mean(df: DataFrame, by: list[str], order: str, value: str, rows: int = 15, out: str = "trailing_mean") -> DataFrame:
    """Mean of this row and the rows - 1 before it."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(1 - rows, 0)))


def ends(df: DataFrame, by: list[str], order: str, value: str, rows: int = 20) -> DataFrame:
    """Means of the first and the last rows."""
    up, down = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by).orderBy(F.desc(order))
    d = df.withColumns({"_a": F.row_number().over(up), "_z": F.row_number().over(down)})
    return d.groupBy(*by).agg(F.avg(F.when(F.col("_a") <= rows, F.col(value))).alias("first_mean"), F.avg(F.when(F.col("_z") <= rows, F.col(value))).alias("last_mean"))


def prefixes(df: DataFrame, pos: str, ks: list[int]) -> DataFrame:
    """Each row once for every k whose first k rows hold it (pos counts from 1)."""
    return df.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col(pos))))


def cumulative_decision(df: DataFrame, task: str, step: str, verdict: str, budgets: list[int]) -> DataFrame:
    """Solved (with the first step that did), unresolved or failed within each budget; verdict may be null."""
    d = prefixes(df, step, budgets)
    out = d.groupBy(task, "k").agg(F.min(F.when(F.col(verdict), F.col(step))).alias("witness"), F.count_if(F.col(verdict).isNull()).alias("unknown"), F.count("*").alias("seen"))
    return out.select(task, "k", F.when(F.col("witness").isNotNull(), "solved").when((F.col("unknown") > 0) | (F.col("seen") < F.col("k")), "unresolved").otherwise("failed").alias("decision"), "witness")


def argmax_first(df: DataFrame, by: list[str], value: str, pos: str) -> DataFrame:
    """The row with the largest value, the earliest on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), pos)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """N rows of each stratum, by a seeded digest of the key."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    w = Window.partitionBy(stratum).orderBy(digest, key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def print_throttle(df: DataFrame, by: list[str], it: str, head: int = 128, every: int = 4093, burst: int = 4, most: int = 2048) -> DataFrame:
    """The first rows, then bursts; no more than `most` of each group."""
    d = df.where((F.col(it) <= head) | (F.col(it) % every < burst))
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(it))).where(F.col("_r") <= most).drop("_r")


def every_nth(df: DataFrame, order: str, most: int) -> DataFrame:
    """`most` rows at most, every n // most-th in order, n the number of rows. Rows are numbered from their ranges' counts, so that they are not sorted in one task."""
    n = df.count()
    step = max(1, n // most)
    cuts = sorted(set(df.approxQuantile(order, [i / 64 for i in range(1, 64)], 0.01)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    d = df.withColumn("_part", part)
    before = d.groupBy("_part").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")  # 64 rows
    d = d.join(F.broadcast(before), "_part").withColumn("_pos", F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    return d.where((F.col("_pos") % step == 0) & (F.col("_pos") < step * most)).select(*df.columns)


def suite_order(suite: Column, case_id: Column, suites: list[str]) -> list[Column]:
    """L4: what to sort by: the suite's place in the list, numbered cases by number, then the others by name."""
    number = F.when(case_id.rlike("^[0-9]+$"), case_id.cast("long"))
    return [F.array_position(F.array(*[F.lit(s) for s in suites]), suite), number.asc_nulls_last(), case_id]
