"""Queries of the reward and evaluation statistics on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import reward, stats, windows
from ..session import table
from .registry import query, rounded

_FACTS = """
WITH f AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS grp, l_suppkey % 8 AS rollout, l_partkey % 60 AS trace FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT grp, trace, count(*) AS f FROM f GROUP BY 1, 2),
r AS (SELECT grp, rollout, count(*) AS rejected, sum(1.0 / o.f) AS credit, count(*) FILTER (o.f = 1) AS alone FROM f JOIN o USING (grp, trace) GROUP BY 1, 2)
"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """A rollout (supplier class) rejects a trace (part class) in a month if a line says so. Pairs are made distinct before months are joined in."""
    l = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 8).alias("rollout"), (F.col("l_partkey") % 60).alias("trace"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM").alias("grp"))
    return l.join(o, "l_orderkey").select("grp", "rollout", "trace").distinct()


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    totals = f.select("grp").distinct().withColumn("n_traces", F.lit(60))
    return rounded(reward.coverage(f, totals, f, ["grp"], "rollout", "trace"))


@query(_FACTS + "SELECT grp, rollout, CAST(rejected AS BIGINT) AS rejected, round(rejected / 60.0::DOUBLE, 6) AS base, round(rejected / 60.0::DOUBLE + 0.3::DOUBLE * (credit::DOUBLE / 60.0::DOUBLE), 6) AS reward FROM r")
def coverage_reward(spark: SparkSession, sf: str) -> DataFrame:
    """W10-W14."""
    return _coverage(spark, sf).select("grp", "rollout", "rejected", "base", "reward")


@query(_FACTS + "SELECT grp, rollout, round(credit::DOUBLE / 60.0::DOUBLE, 6) AS shapley_credit FROM r")
def shapley_credit(spark: SparkSession, sf: str) -> DataFrame:
    """W13."""
    return _coverage(spark, sf).select("grp", "rollout", "shapley_credit")


@query(_FACTS + "SELECT grp, rollout, round(alone / 60.0::DOUBLE, 6) AS loo_utility FROM r")
def loo_utility(spark: SparkSession, sf: str) -> DataFrame:
    """W18."""
    return _coverage(spark, sf).select("grp", "rollout", "loo_utility")


@query(_FACTS + "SELECT grp, CAST(60 AS INTEGER) AS n_traces, CAST(count(DISTINCT trace) AS BIGINT) AS covered, round(count(DISTINCT trace) / 60.0::DOUBLE, 6) AS batch_score, true AS scorable, 'coverage' AS reward_mode FROM f GROUP BY grp")
def batch_scores(spark: SparkSession, sf: str) -> DataFrame:
    """W15, W16."""
    f = _facts(spark, sf)
    return rounded(reward.batch_scores(f, f.select("grp").distinct().withColumn("n_traces", F.lit(60)), ["grp"], "trace"))


_ORDERED = """
WITH p AS (SELECT l_orderkey AS task, o_orderpriority AS suite, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos, l_returnflag = 'R' AS ok
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    l = table(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(w).alias("pos"), (F.col("l_returnflag") == "R").alias("ok"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("suite"))
    return l.join(o, "l_orderkey").withColumnRenamed("l_orderkey", "task")


@query(_ORDERED + """
, t AS (SELECT task, suite, count(*) AS n, count(*) FILTER (ok) AS c FROM p GROUP BY 1, 2),
e AS (SELECT suite, k, CASE WHEN c = 0 THEN 0.0 WHEN n - c < k THEN 1.0 ELSE 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - k / i::DOUBLE)) END AS v FROM t, (VALUES (1), (2), (4)) b(k) WHERE n >= k)
SELECT suite, CAST(k AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS tasks, round(avg(v), 6) AS pass_at_k FROM e GROUP BY 1, 2
""")
def pass_at_k_unbiased(spark: SparkSession, sf: str) -> DataFrame:
    """A7."""
    t = _samples(spark, sf).groupBy("suite", "task").agg(F.count("*").cast("int").alias("n"), F.count_if("ok").cast("int").alias("c"))
    return rounded(stats.pass_at_k_table(t, [1, 2, 4], ["suite"]))


@query(_ORDERED + """
, e AS (SELECT suite, task, k, bool_or(ok) AS v FROM p, (VALUES (1), (2), (4), (8)) b(k) WHERE pos <= k GROUP BY 1, 2, 3)
SELECT CASE WHEN grouping(suite) = 1 THEN 'all' ELSE suite END AS suite, CAST(k AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS tasks, CAST(count(*) FILTER (v) AS BIGINT) AS solved FROM e GROUP BY GROUPING SETS ((k, suite), (k))
""")
def pass_at_k_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Solved by one of the first k, per suite and in all."""
    from ..operators.ledger import with_totals

    e = windows.prefixes(_samples(spark, sf), "pos", [1, 2, 4, 8]).groupBy("suite", "task", "k").agg(F.bool_or("ok").alias("v"))
    return with_totals(e, ["k"], "suite", [F.count("*").alias("tasks"), F.count_if("v").alias("solved")])


@query(_ORDERED + """
, u AS (SELECT p.suite, p.task, k, l.l_partkey % 7 AS clause FROM p JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos FROM lineitem) l ON l.l_orderkey = p.task AND l.pos = p.pos, (VALUES (1), (4), (8)) b(k) WHERE p.pos <= k),
d AS (SELECT suite, task, k, count(DISTINCT clause) AS n FROM u GROUP BY 1, 2, 3)
SELECT suite, CAST(k AS INTEGER) AS k, CAST(sum(n) AS BIGINT) AS clauses, CAST(count(*) FILTER (n >= 3) AS BIGINT) AS composed FROM d GROUP BY 1, 2
""")
def compose_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct clauses of the first k responses, and tasks that have three at least."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    l = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 7).alias("clause"), F.row_number().over(w).alias("pos"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("suite"))
    d = windows.prefixes(l.join(o, "l_orderkey"), "pos", [1, 4, 8]).groupBy("suite", "l_orderkey", "k").agg(F.countDistinct("clause").alias("n"))
    return d.groupBy("suite", "k").agg(F.sum("n").alias("clauses"), F.count_if(F.col("n") >= 3).alias("composed"))


_SCORED = "WITH s AS (SELECT d.doc_id, d.lang, d.n_chars AS score, l.quality = 1 AS ok FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").alias("score")).join(l, "doc_id")


_AUC = "(sum(CASE WHEN ok THEN r END) - count(*) FILTER (ok) * (count(*) FILTER (ok) + 1) / 2.0) / nullif(count(*) FILTER (ok) * count(*) FILTER (NOT ok), 0)::DOUBLE"


@query(_SCORED + f"""
, r AS (SELECT ok, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0)::DOUBLE AS r FROM s)
SELECT CAST(count(*) FILTER (ok) AS BIGINT) AS positives, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS negatives, round({_AUC}, 6) AS auc FROM r
""")
def auc_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    return rounded(stats.roc_auc(_scored(spark, sf), "ok", "score"))


@query(_SCORED + f"""
, r AS (SELECT lang, ok, (rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0)::DOUBLE AS r FROM s),
a AS (SELECT lang, {_AUC} AS auc, (count(*) FILTER (ok) * count(*) FILTER (NOT ok))::DOUBLE AS pairs FROM r GROUP BY lang)
SELECT CAST(count(*) AS BIGINT) AS tasks, round(avg(auc), 6) AS macro_auc, round(sum(auc * pairs) / sum(pairs), 6) AS weighted_auc FROM a WHERE auc IS NOT NULL
""")
def auc_within(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    return rounded(stats.within_task_auc(_scored(spark, sf), "ok", "score", "lang"))


@query(_SCORED + """
, c AS (SELECT lang, score, count(*) FILTER (ok) AS p, count(*) AS n FROM s GROUP BY 1, 2),
w AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS seen FROM c)
SELECT lang, round(sum(p * tp / seen::DOUBLE) / nullif(sum(p), 0), 6) AS average_precision FROM w GROUP BY lang
""")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    """A11."""
    return rounded(stats.average_precision(_scored(spark, sf), "ok", "score", ["lang"]))


_COUNTS = "WITH d AS (SELECT o_totalprice AS x, n AS y FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("y"))
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x")).join(n, "o_orderkey")


@query(_COUNTS + """
, r AS (SELECT (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0)::DOUBLE AS a, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0)::DOUBLE AS b FROM d)
SELECT round(corr(a, b), 5) AS spearman FROM r
""")
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    """A13, N3."""
    return rounded(stats.spearman(_counts(spark, sf), "x", "y"), 5)


@query(_COUNTS + "SELECT round(corr(x, y), 5) AS pearson FROM d")
def pearson(spark: SparkSession, sf: str) -> DataFrame:
    """A13."""
    return rounded(_counts(spark, sf).agg(stats.pearson(F.col("x"), F.col("y")).alias("pearson")), 5)


_FRACTIONS = "WITH s AS (SELECT o_custkey AS task, (o_orderkey % 21) / 20.0::DOUBLE AS score, o_orderstatus = 'F' AS ok FROM orders)"


def _fractions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), ((F.col("o_orderkey") % 21) / 20.0).alias("score"), (F.col("o_orderstatus") == "F").alias("ok"))


@query(_FRACTIONS + """
, b AS (SELECT ok, CASE WHEN score <= 0 THEN 0 WHEN score <= 0.25 THEN 1 WHEN score <= 0.5 THEN 2 WHEN score <= 0.75 THEN 3 WHEN score <= 0.9 THEN 4 WHEN score < 1 THEN 5 ELSE 6 END AS band FROM s),
c AS (SELECT band, count(*)::DOUBLE AS n, count(*) FILTER (ok)::DOUBLE AS k, 1.959963984540054::DOUBLE AS z FROM b GROUP BY band)
SELECT CAST(band AS INTEGER) AS band, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS positives, round(k / n, 6) AS rate,
       round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low,
       round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM c
""")
def wilson_bands(spark: SparkSession, sf: str) -> DataFrame:
    """A14, A15."""
    return rounded(stats.coverage_bands(_fractions(spark, sf), "score", "ok"))


@query(_FRACTIONS + """
SELECT round(t / 10.0::DOUBLE, 6) AS threshold, CAST(count(*) AS BIGINT) AS selected, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS precision, round(count(*) FILTER (ok) / (SELECT count(*) FROM s WHERE ok)::DOUBLE, 6) AS recall, CAST(count(DISTINCT task) AS BIGINT) AS tasks
FROM s, range(0, 11) r(t) WHERE score + 1e-10 >= t / 10.0::DOUBLE GROUP BY t
""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """A16."""
    return rounded(stats.threshold_sweep(_fractions(spark, sf), "score", "ok", "task"))


@query("""
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.05), 6) AS q05, round(quantile_cont(l_extendedprice, 0.1), 6) AS q10, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, round(avg(l_extendedprice), 6) AS mean, max(l_extendedprice) AS high,
       CAST(count(*) FILTER (l_extendedprice >= 0.8) AS BIGINT) AS at_least_08, CAST(count(*) FILTER (l_extendedprice >= 0.9) AS BIGINT) AS at_least_09 FROM lineitem GROUP BY 1
""")
def quantiles_linear(spark: SparkSession, sf: str) -> DataFrame:
    """A17, A18."""
    return rounded(stats.distribution(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query("""
WITH a AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS v FROM orders GROUP BY 1)
SELECT o_custkey, v[least(len(v), floor(0.5 * len(v))::BIGINT + 1)] AS median, v[least(len(v), floor(0.9 * len(v))::BIGINT + 1)] AS p90 FROM a
""")
def quantile_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """By index; a group is one customer's orders."""
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_list("o_totalprice").alias("v"))
    return a.select("o_custkey", nm.nearest_rank(F.col("v"), 0.5).alias("median"), nm.nearest_rank(F.col("v"), 0.9).alias("p90"))


@query("""
WITH a AS (SELECT lang AS k, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS s FROM documents GROUP BY 1),
b AS (SELECT lang AS k, count(*) / (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))::DOUBLE AS s FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT round(sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2, 6) AS total_variation FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k
""")
def tv_distance(spark: SparkSession, sf: str) -> DataFrame:
    """A24."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return rounded(stats.total_variation(d, d.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), "lang"))


@query("""
WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS r FROM c)
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS families, round(sum(n)::DOUBLE * sum(n) / sum(n * n), 6) AS effective, round(sum(n) FILTER (r <= 10) / sum(n)::DOUBLE, 6) AS top_share, CAST(max(n) AS BIGINT) AS largest FROM r
""")
def family_concentration(spark: SparkSession, sf: str) -> DataFrame:
    """A25, L2."""
    return rounded(stats.family_concentration(table(spark, sf, "part"), "p_type"))


@query("""
WITH a AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS x, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS y, max(o_orderstatus) AS label FROM orders GROUP BY 1)
SELECT label, CAST(count(*) AS BIGINT) AS n, round(avg(y - x), 4) AS mean_shift, round(quantile_cont(y - x, 0.5), 4) AS median_shift, CAST(count(*) FILTER (y > x) AS BIGINT) AS increased, CAST(count(*) FILTER (y = x) AS BIGINT) AS unchanged, CAST(count(*) FILTER (y < x) AS BIGINT) AS decreased
FROM a WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY label
""")
def score_shift(spark: SparkSession, sf: str) -> DataFrame:
    """A26."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg(F.when(k % 2 == 0, p)).alias("x"), F.avg(F.when(k % 2 == 1, p)).alias("y"), F.max("o_orderstatus").alias("label"))
    d = F.col("y") - F.col("x")
    out = a.where("x IS NOT NULL AND y IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"), F.avg(d).alias("mean_shift"), F.percentile(d, F.lit(0.5)).alias("median_shift"), F.count_if(d > 0).alias("increased"), F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("decreased"))
    return rounded(out, 4)


@query(_FRACTIONS + """
, t AS (SELECT task, max(score) FILTER (NOT ok) AS f, min(score) FILTER (ok) AS p FROM s GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS tasks, CAST(count(*) FILTER (f > p) AS BIGINT) AS strict, CAST(count(*) FILTER (f = p) AS BIGINT) AS tied FROM t WHERE f IS NOT NULL AND p IS NOT NULL
""")
def order_inversions(spark: SparkSession, sf: str) -> DataFrame:
    """A27, J10."""
    return stats.order_inversions(_fractions(spark, sf), "task", "ok", "score")


@query(_FRACTIONS + """
, r AS (SELECT task, ok::INTEGER AS ok, rank() OVER (PARTITION BY task ORDER BY score DESC) = 1 AS top FROM s)
SELECT task, CAST(count(*) FILTER (top) AS BIGINT) AS tied, round(avg(ok) FILTER (top), 6) AS expected, max(ok) FILTER (top) AS optimistic, min(ok) FILTER (top) AS pessimistic, max(ok) AS oracle FROM r GROUP BY task
""")
def top1_ties(spark: SparkSession, sf: str) -> DataFrame:
    """L3."""
    return rounded(stats.top1(_fractions(spark, sf), "task", "ok", "score"))


_U = "('0x' || substr(md5({0}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"


@query(_FRACTIONS + f"""
, c AS (SELECT task, sum(score) AS s, count(*) AS n FROM s GROUP BY 1),
u AS (SELECT r AS replicate, s, n, {_U.format("'boot:' || r || ':' || task")} AS u FROM c, range(1, 51) t(r)),
w AS (SELECT *, (u >= 0.0)::INTEGER * 0 + (u >= 0.36787944117144233::DOUBLE)::INTEGER + (u >= 0.7357588823428847::DOUBLE)::INTEGER + (u >= 0.9196986029286058::DOUBLE)::INTEGER + (u >= 0.9810118431238463::DOUBLE)::INTEGER + (u >= 0.9963401531726563::DOUBLE)::INTEGER + (u >= 0.9994058151824183::DOUBLE)::INTEGER + (u >= 0.999916758850712::DOUBLE)::INTEGER + (u >= 0.9999897508033253::DOUBLE)::INTEGER + (u >= 0.999998874797402::DOUBLE)::INTEGER + (u >= 0.9999998885745216::DOUBLE)::INTEGER + (u >= 0.9999999899522336::DOUBLE)::INTEGER + (u >= 0.9999999991683892::DOUBLE)::INTEGER + (u >= 0.9999999999364022::DOUBLE)::INTEGER AS w FROM u)
SELECT CAST(replicate AS INTEGER) AS replicate, round(sum(s * w) / sum(n * w), 6) AS estimate FROM w GROUP BY 1
""")
def bootstrap_replicates(spark: SparkSession, sf: str) -> DataFrame:
    """Replicates of a cluster bootstrap with Poisson weights from a digest."""
    return rounded(stats.cluster_bootstrap(_fractions(spark, sf), "task", "score", 50))


@query(_SCORED + f"""
, k AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY lang) AS k FROM s),
u AS (SELECT r AS replicate, lang, doc_id, score, k, {_U.format("'perm:' || r || ':' || doc_id")} AS u FROM k, range(1, 101) t(r)),
o AS (SELECT *, row_number() OVER (PARTITION BY replicate, lang ORDER BY u, doc_id) AS n FROM u),
d AS (SELECT replicate, sum(score) FILTER (n <= k) AS drawn FROM o GROUP BY 1)
SELECT CAST(count(*) FILTER (drawn >= (SELECT sum(score) FROM s WHERE ok)) AS BIGINT) AS exceed, CAST(count(*) AS BIGINT) AS replicates, round((count(*) FILTER (drawn >= (SELECT sum(score) FROM s WHERE ok)) + 1) / (count(*) + 1)::DOUBLE, 6) AS p_value FROM d
""")
def permutation(spark: SparkSession, sf: str) -> DataFrame:
    """A23."""
    return rounded(stats.permutation_test(_scored(spark, sf), "lang", "doc_id", "ok", "score", 100))
