"""Evaluation statistics as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import correlation, pass_at_k, ratio, wilson


def average_ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Rank of each row's value, ties sharing their average. Counts of each value are summed, so only distinct values are sorted together."""
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count("*").cast("double").alias("_c"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(out, F.coalesce(F.sum("_c").over(before), F.lit(0.0)) + (F.col("_c") + 1) / 2).drop("_c")
    counts = counts.withColumnsRenamed({c: f"_{c}" for c in [*by, value]})
    same = F.lit(True)
    for c in [*by, value]:
        same = same & df[c].eqNullSafe(counts[f"_{c}"])
    return df.join(counts, same).drop(*[f"_{c}" for c in [*by, value]])


def _score_counts(df: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    positive = F.col(label).cast("boolean")
    return df.groupBy(*by, score).agg(F.count_if(positive).cast("double").alias("p"), F.count_if(~positive).cast("double").alias("n"))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """A10: positives, negatives and auc per group; null with one class only. Rows are counted by score first."""
    by = by or []
    counts = _score_counts(df, label, score, by)
    before = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("won", F.col("p") * (F.coalesce(F.sum("n").over(before), F.lit(0.0)) + F.col("n") / 2))
    out = counts.groupBy(*by).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("won").alias("won"))
    out = out.withColumn("auc", ratio(F.col("won"), F.col("positives") * F.col("negatives")))
    return out.select(*by, F.col("positives").cast("long").alias("positives"), F.col("negatives").cast("long").alias("negatives"), "auc")


def within_task_auc(df: DataFrame, label: str, score: str, task: str) -> DataFrame:
    """Over tasks with both classes: their number, macro mean, and mean weighted by pairs."""
    per = roc_auc(df, label, score, [task]).where("auc IS NOT NULL").withColumn("pairs", F.col("positives").cast("double") * F.col("negatives"))
    return per.agg(F.count("*").alias("tasks"), F.avg("auc").alias("macro_auc"), ratio(F.sum(F.col("auc") * F.col("pairs")), F.sum("pairs")).alias("weighted_auc"))


def average_precision(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Precision at each score, weighted by the recall it adds; ties together."""
    by = by or []
    upto = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    c = _score_counts(df, label, score, by).withColumns({"tp": F.sum("p").over(upto), "seen": F.sum(F.col("p") + F.col("n")).over(upto)})
    return c.groupBy(*by).agg(ratio(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p")).alias("average_precision"))


def pearson(x: Column, y: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    s = lambda v: F.coalesce(F.sum(F.when(both, v)), F.lit(0.0))
    return correlation(F.count_if(both).cast("double"), s(x), s(y), s(x * x), s(y * y), s(x * y))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r of the average ranks."""
    ranked = average_ranks(average_ranks(df, x, "rank_x"), y, "rank_y")
    return ranked.agg(pearson(F.col("rank_x"), F.col("rank_y")).alias("spearman"))


def pass_at_k_table(df: DataFrame, ks: list[int], by: list[str]) -> DataFrame:
    """Df has n and c of each task. Mean estimate per group and k."""
    t = df.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("n >= k")
    return t.groupBy(*by, "k").agg(F.count("*").alias("tasks"), F.avg(pass_at_k(F.col("n"), F.col("c"), F.col("k"))).alias("pass_at_k"))


def coverage_bands(df: DataFrame, score: str, label: str, edges: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """Rows, positives, rate and Wilson bounds for score 0, each band up to an edge, and 1 itself."""
    s, band = F.col(score), F.when(F.col(score) <= 0, 0)
    for i, e in enumerate(edges, 1):
        band = band.when((s <= e) if e < 1 else (s < e), i)
    out = df.where(s.isNotNull()).withColumn("band", band.otherwise(len(edges) + 1)).groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col(label).cast("boolean")).alias("positives"))
    return out.withColumns({"rate": ratio(F.col("positives"), F.col("n")), "low": wilson(F.col("positives"), F.col("n"), False), "high": wilson(F.col("positives"), F.col("n"), True)})


def threshold_sweep(df: DataFrame, score: str, label: str, task: str, steps: int = 10) -> DataFrame:
    """Selected rows, precision, recall and tasks at each threshold 0, 1/steps, ..., 1. Rows are explanded only to the thresholds they reach."""
    reach = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(F.col(score) * steps + 1e-9).cast("int")))
    d = df.where(F.col(score).isNotNull() & (F.col(score) >= 0))
    total = d.agg(F.count_if(F.col(label).cast("boolean")).alias("all_positives"))
    d = d.withColumn("step", F.explode(F.sequence(F.lit(0), reach)))
    out = d.groupBy("step").agg(F.count("*").alias("selected"), F.count_if(F.col(label).cast("boolean")).alias("hits"), F.countDistinct(task).alias("tasks"))
    out = out.crossJoin(F.broadcast(total))  # one row
    return out.select((F.col("step") / steps).alias("threshold"), "selected", ratio(F.col("hits"), F.col("selected")).alias("precision"), ratio(F.col("hits"), F.col("all_positives")).alias("recall"), "tasks")


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, extremes, quantiles (linear), mean, and how many reach 0.8 and 0.9."""
    v = F.col(value)
    q = {"q05": 0.05, "q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75}
    return df.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.min(v).alias("low"), *[F.percentile(v, F.lit(p)).alias(k) for k, p in q.items()], F.avg(v).alias("mean"), F.max(v).alias("high"),
        F.count_if(v >= 0.8).alias("at_least_08"), F.count_if(v >= 0.9).alias("at_least_09"),
    )


def total_variation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Half the summed differences of the shares of key."""
    share = lambda d, c: d.groupBy(key).count().withColumn(c, ratio(F.col("count"), F.sum("count").over(Window.partitionBy()))).select(F.col(key).alias(f"{c}_key"), c)
    x, y = share(a, "a"), share(b, "b")
    j = x.join(y, F.col("a_key").eqNullSafe(F.col("b_key")), "full_outer")
    return j.agg((F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))) / 2).alias("total_variation"))


def family_concentration(df: DataFrame, key: str, top: int = 10) -> DataFrame:
    """Rows, families, effective families n^2 / sum of squares, share of the largest `top`, largest."""
    c = df.groupBy(key).count()
    c = c.withColumn("r", F.row_number().over(Window.orderBy(F.desc("count"), key)))
    return c.agg(
        F.sum("count").alias("n"), F.count("*").alias("families"), ratio(F.sum("count") * F.sum("count"), F.sum(F.col("count") * F.col("count"))).alias("effective"),
        ratio(F.sum(F.when(F.col("r") <= top, F.col("count"))), F.sum("count")).alias("top_share"), F.max("count").alias("largest"),
    )


def order_inversions(df: DataFrame, task: str, label: str, score: str) -> DataFrame:
    """Tasks with both labels: how many have a failed row above (or level with) a passed one."""
    ok = F.col(label).cast("boolean")
    t = df.groupBy(task).agg(F.max(F.when(~ok, F.col(score))).alias("failed"), F.min(F.when(ok, F.col(score))).alias("passed"))
    t = t.where("failed IS NOT NULL AND passed IS NOT NULL")
    return t.agg(F.count("*").alias("tasks"), F.count_if(F.col("failed") > F.col("passed")).alias("strict"), F.count_if(F.col("failed") == F.col("passed")).alias("tied"))


def top1(df: DataFrame, task: str, label: str, score: str) -> DataFrame:
    """L3: of each task the best-scored rows: expected, optimistic and pessimistic success, and whether any row succeeds."""
    ok, best = F.col(label).cast("int"), Window.partitionBy(task).orderBy(F.desc(score))
    d = df.withColumn("_r", F.rank().over(best))
    first = F.col("_r") == 1
    return d.groupBy(task).agg(F.count_if(first).alias("tied"), F.avg(F.when(first, ok)).alias("expected"), F.max(F.when(first, ok)).alias("optimistic"), F.min(F.when(first, ok)).alias("pessimistic"), F.max(ok).alias("oracle"))


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same in any engine, and in any order of rows."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_weight(u: Column, most: int = 14) -> Column:
    """Poisson(1) count of a uniform number of 32 bits: how often a bootstrap replicate draws a cluster. More than 13 is rarer than the numbers' last bit."""
    total, term, out = 0.0, 0.36787944117144233, F.lit(0)
    for i in range(most):
        total += term
        out = out + (u >= total).cast("int")
        term /= i + 1
    return out


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, replicates: int, seed: str = "boot") -> DataFrame:
    """Mean of value in each replicate; clusters are drawn whole. Clusters are summed up before they are multiplied."""
    c = df.groupBy(cluster).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n"))
    c = c.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    c = c.withColumn("w", poisson_weight(hash_uniform(F.lit(seed), F.col("replicate"), F.col(cluster))))
    return c.groupBy("replicate").agg(ratio(F.sum(F.col("s") * F.col("w")), F.sum(F.col("n") * F.col("w"))).alias("estimate"))


def permutation_test(df: DataFrame, task: str, item: str, label: str, score: str, replicates: int, seed: str = "perm") -> DataFrame:
    """Within tasks, how often do shuffled labels give the positives as high a sum of scores; p = (exceed + 1) / (replicates + 1)."""
    ok = F.col(label).cast("boolean")
    n_pos = F.count_if(ok).over(Window.partitionBy(task))
    d = df.select(task, item, ok.alias("ok"), F.col(score).cast("double").alias("s"), n_pos.alias("k"))
    seen = d.agg(F.sum(F.when(F.col("ok"), F.col("s"))).alias("observed"))
    r = d.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    r = r.withColumn("u", hash_uniform(F.lit(seed), F.col("replicate"), F.col(item)))
    r = r.withColumn("r", F.row_number().over(Window.partitionBy("replicate", task).orderBy("u", item)))
    r = r.groupBy("replicate").agg(F.sum(F.when(F.col("r") <= F.col("k"), F.col("s"))).alias("drawn"))
    out = r.crossJoin(F.broadcast(seen)).agg(F.count_if(F.col("drawn") >= F.col("observed")).alias("exceed"), F.count("*").alias("replicates"))  # one row
    return out.withColumn("p_value", (F.col("exceed") + 1) / (F.col("replicates") + 1))


def resampled(clusters: DataFrame, key: list[str], stratum: list[str], replicates: int, seed: str) -> DataFrame:
    """How often (w) each replicate draws each cluster: as many draws from a stratum, with replacement, as it has clusters. The draws are digests of (seed, replicate, stratum, number of the draw)."""
    order = Window.partitionBy(*stratum).orderBy(*key)
    c = clusters.select(*stratum, *key).withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(*stratum))})
    draws = c.select(*stratum, "_i", "_n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = hash_uniform(F.lit(seed), F.col("replicate"), *[F.col(s) for s in stratum], F.col("_i"))
    drawn = draws.select(*stratum, "replicate", F.floor(u * F.col("_n")).cast("int").alias("_i")).groupBy(*stratum, "replicate", "_i").agg(F.count("*").alias("w"))
    return drawn.join(c.drop("_n"), [*stratum, "_i"]).drop("_i")


def bootstrap_auc(df: DataFrame, stratum: str, cluster: str, label: str, score: str, replicates: int, seed: str = "auc") -> DataFrame:
    """AUROC and average precision of each replicate of a bootstrap of whole clusters, stratified. Rows are counted by cluster and score before they are multiplied."""
    c = _score_counts(df, label, score, [stratum, cluster])
    w = resampled(df.select(stratum, cluster).distinct(), [cluster], [stratum], replicates, seed)
    c = c.join(w, [stratum, cluster]).groupBy("replicate", score).agg(F.sum(F.col("p") * F.col("w")).alias("p"), F.sum(F.col("n") * F.col("w")).alias("n"))
    up, down = Window.partitionBy("replicate").orderBy(score).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("replicate").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"won": F.col("p") * (F.coalesce(F.sum("n").over(up), F.lit(0.0)) + F.col("n") / 2), "tp": F.sum("p").over(down), "seen": F.sum(F.col("p") + F.col("n")).over(down)})
    out = c.groupBy("replicate").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("won").alias("won"), F.sum(F.col("p") * ratio(F.col("tp"), F.col("seen"))).alias("ap"))
    return out.select("replicate", ratio(F.col("won"), F.col("p") * F.col("n")).alias("auc"), ratio(F.col("ap"), F.col("p")).alias("average_precision"))


def paired_bootstrap(tasks: DataFrame, task: str, x: str, y: str, replicates: int, seed: str = "pair") -> DataFrame:
    """Of each replicate the means of x and y over the tasks drawn, and of their difference. tasks: a row a task."""
    t = tasks.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.lit(0).alias("_all"), task, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    d = t.join(resampled(t, [task], ["_all"], replicates, seed), ["_all", task]).groupBy("replicate").agg(F.sum(F.col("x") * F.col("w")).alias("x"), F.sum(F.col("y") * F.col("w")).alias("y"), F.sum("w").alias("n"))
    mean = lambda c: c / F.col("n")
    return d.select("replicate", mean(F.col("x")).alias("mean_x"), mean(F.col("y")).alias("mean_y"), mean(F.col("x") - F.col("y")).alias("difference"))


def interval(replicates: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """The middle `level` of the replicates' values, by linear quantiles."""
    tail = (1 - level) / 2
    return replicates.agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))
