"""Queries of bootstraps, family scores, ledgers, selections and program rules, on the test tables or, where those lack the input, on rows given here."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import program, text as tx
from ..operators import curation, dedup, greedy, ledger, reward, sampling, stats, windows
from ..session import checkpoints, table
from .registry import query, rounded

_U = "('0x' || substr(md5({0}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE"
_SCORED = "WITH s AS (SELECT coalesce(d.lang, '-') AS lang, d.source AS task, d.n_chars AS score, l.quality = 1 AS ok FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.source IS NOT NULL AND l.quality IS NOT NULL)"


@query(_SCORED + f"""
, c AS (SELECT lang, task, row_number() OVER (PARTITION BY lang ORDER BY task) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, task FROM s)),
d AS (SELECT r AS replicate, lang, CAST(floor({_U.format("'auc:' || r || ':' || lang || ':' || i")} * n) AS INTEGER) AS i FROM c, range(1, 21) t(r)),
w AS (SELECT replicate, lang, i, count(*) AS w FROM d GROUP BY 1, 2, 3),
k AS (SELECT replicate, score, sum(w) FILTER (ok)::DOUBLE AS p, sum(w) FILTER (NOT ok)::DOUBLE AS n FROM s JOIN c USING (lang, task) JOIN w ON w.lang = c.lang AND w.i = c.i GROUP BY 1, 2),
z AS (SELECT replicate, score, coalesce(p, 0) AS p, coalesce(n, 0) AS n FROM k),
v AS (SELECT *, p * (coalesce(sum(n) OVER (PARTITION BY replicate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) AS won,
             sum(p) OVER (PARTITION BY replicate ORDER BY score DESC) AS tp, sum(p + n) OVER (PARTITION BY replicate ORDER BY score DESC) AS seen FROM z)
SELECT CAST(replicate AS INTEGER) AS replicate, round(sum(won) / (sum(p) * sum(n)), 6) AS auc, round(sum(p * tp / seen) / sum(p), 6) AS average_precision FROM v GROUP BY 1
""")
def bootstrap_auc(spark: SparkSession, sf: str) -> DataFrame:
    """Stratified by language; a source's documents move together."""
    l = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    d = table(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", F.coalesce("lang", F.lit("-")).alias("lang"), F.col("source").alias("task"), F.col("n_chars").alias("score"))
    return rounded(stats.bootstrap_auc(d.join(l, "doc_id").where("ok IS NOT NULL"), "lang", "task", "ok", "score", 20))


@query(f"""
WITH t AS (SELECT o_custkey AS task, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS x, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS y FROM orders GROUP BY 1),
c AS (SELECT *, row_number() OVER (ORDER BY task) - 1 AS i, count(*) OVER () AS n FROM t WHERE x IS NOT NULL AND y IS NOT NULL),
d AS (SELECT r AS replicate, CAST(floor({_U.format("'pair:' || r || ':0:' || i")} * n) AS INTEGER) AS i FROM c, range(1, 31) q(r))
SELECT CAST(replicate AS INTEGER) AS replicate, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(avg(x - y), 4) AS difference FROM d JOIN c USING (i) GROUP BY 1
""")
def bootstrap_paired(spark: SparkSession, sf: str) -> DataFrame:
    """A21, A22."""
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    t = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("task")).agg(F.avg(F.when(s == "F", p)).alias("x"), F.avg(F.when(s == "O", p)).alias("y"))
    return rounded(stats.paired_bootstrap(t, "task", "x", "y", 30), 4)


_REJECTS = """
WITH f AS (SELECT l_suppkey % 40 AS task, l_partkey % 6 AS cand, l_linenumber * 10 + l_quantity::INTEGER % 10 AS trace, bool_or(l_returnflag = 'R') AS rejected FROM lineitem GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT task, trace FROM f), b AS (SELECT DISTINCT task, cand FROM f),
r AS (SELECT a.task, a.trace, b.cand, a.trace % 3 AS family, coalesce(f.rejected, false)::INTEGER AS r FROM a JOIN b USING (task) LEFT JOIN f ON f.task = a.task AND f.trace = a.trace AND f.cand = b.cand),
"""


@query(_REJECTS + """
t AS (SELECT task, family, trace, sum(r) AS n, count(*) AS k, string_agg(cand, ',' ORDER BY cand) FILTER (r = 1) AS who FROM r GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY task, family, who ORDER BY trace) = 1 AS own, n > 0 AND n < k AS tells, 4 * (n / k::DOUBLE) * (1 - n / k::DOUBLE) AS weight FROM t)
SELECT r.task, r.cand, r.family, round(avg(r), 6) AS score, round(avg(r) FILTER (own), 6) AS signature_score, round(avg(r) FILTER (own AND tells), 6) AS informative_score,
       round(CASE WHEN sum(weight) > 0 THEN sum(r * weight) / sum(weight) END + 1e-9, 6) AS entropy_score, CAST(count(*) AS BIGINT) AS traces
FROM r JOIN o USING (task, family, trace) GROUP BY 1, 2, 3
""")
def family_scores(spark: SparkSession, sf: str) -> DataFrame:
    """W21."""
    k = (F.col("l_suppkey") % 40).alias("task"), (F.col("l_partkey") % 6).alias("cand"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 10).alias("trace")
    f = table(spark, sf, "lineitem").groupBy(*k).agg(F.bool_or(F.col("l_returnflag") == "R").alias("rejected"))
    whole = f.select("task", "trace").distinct().join(f.select("task", "cand").distinct(), "task")
    r = whole.join(f, ["task", "trace", "cand"], "left").select("task", "trace", "cand", (F.col("trace") % 3).alias("family"), F.coalesce("rejected", F.lit(False)).alias("rejected"))
    # sums of doubles: a little is added, so that rounding does not hang on their last digits
    return rounded(reward.family_scores(r, ["task"], "cand", "trace", "family").withColumn("entropy_score", F.col("entropy_score") + 1e-9))


@query("""
SELECT * FROM (VALUES ('fine', []::VARCHAR[]), ('junk', ['trivial_too_close', 'post_copy_too_close']), ('weak', ['gold_base_too_low', 'gold_filtered', 'loose_beats_gold']), ('copied', ['post_copy_beats_gold'])) t(program, faults)
""")
def score_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """W22."""
    fine = [("gold", 1.2, 0.95, 3, 3), ("loose", 0.7, 0.6, 2, 2), ("trivial", 0.0, 0.0, 1, 1), ("unsound", 0.0, 0.0, 0, 2), ("post_copy", 0.1, 0.1, 1, 1)]
    of = lambda name, quality=False, **new: [(name, f, *new.get(f, x), quality) for f, *x in fine]
    rows = [*of("fine"), *of("junk", trivial=(1.1, 0.9, 1, 1), post_copy=(1.06, 0.9, 1, 1)), *of("weak", gold=(0.6, 0.5, 2, 3)), *of("copied", True, post_copy=(1.23, 1.0, 1, 1))]
    return reward.ladder_faults(spark.createDataFrame(rows, "program string, family string, reward double, base double, survivors int, given int, post_is_invariant boolean"))


@query("""
WITH v AS (SELECT l_suppkey AS grp, l_linenumber AS trace, bool_or(l_returnflag = 'R') AS hit FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2), n AS (SELECT grp, count(*) AS n, count(*) FILTER (hit) AS k FROM v GROUP BY 1)
SELECT s_suppkey AS grp, CASE WHEN n > 0 THEN 'negative_coverage_raw_no_houdini' ELSE 'binary_frama_c_validation' END AS reward_mode, CAST(coalesce(n, 0) AS BIGINT) AS negative_trace_count, CAST(k AS BIGINT) AS rejected_negative_count,
       round(k / n::DOUBLE, 6) AS negative_rejection_score, CASE WHEN n IS NULL THEN CASE WHEN s_acctbal > 0 THEN 1.0::DOUBLE ELSE 0.0 END END AS binary_frama_c_validation FROM supplier LEFT JOIN n ON grp = s_suppkey
""")
def raw_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers stand for tasks, line numbers for traces; every seventh task has none."""
    v = table(spark, sf, "lineitem").where("l_suppkey % 7 <> 0").select(F.col("l_suppkey").alias("grp"), F.col("l_linenumber").alias("trace"), (F.col("l_returnflag") != "R").alias("verdict"))
    n = v.select("grp", "trace").distinct().groupBy("grp").agg(F.count("*").alias("n_traces"))
    g = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("grp"), (F.col("s_acctbal") > 0).alias("ok")).join(n, "grp", "left")
    return rounded(reward.raw_coverage(v, g, ["grp"], "trace", F.col("ok")))


@query("""
WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, greatest(1, count(*) OVER () // 100) AS step FROM orders)
SELECT o_orderkey, o_totalprice FROM n WHERE pos % step = 0 AND pos < step * 100
""")
def every_nth(spark: SparkSession, sf: str) -> DataFrame:
    """The limit is the feature."""
    return windows.every_nth(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


@query("""
WITH r AS (SELECT event_type, CASE WHEN user_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, user_id % 3 = 0 AS ok, CASE WHEN event_id % 4 > 0 THEN event_id % 1000 END AS tokens, CASE WHEN event_id % 2 = 0 THEN 'exact' ELSE 'estimate' END AS how, CASE WHEN event_id % 6 > 0 THEN value END AS sec FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS completed, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (ok) AS BIGINT) AS verified,
       round(avg(tokens), 6) AS mean_total_tokens, CAST(count(tokens) AS BIGINT) AS token_rows, round(avg(tokens) FILTER (how = 'exact'), 6) AS mean_exact_total_tokens, CAST(count(tokens) FILTER (how = 'exact') AS BIGINT) AS exact_token_rows,
       round(avg(sec), 6) AS mean_generation_seconds, CAST(count(sec) AS BIGINT) AS time_rows FROM r GROUP BY 1
""")
def tool_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Q7, A2."""
    e, u, i = table(spark, sf, "events"), F.col("user_id"), F.col("event_id")
    r = e.select("event_type", F.when(u % 5 == 0, "failed").otherwise("completed").alias("generation_status"), (u % 3 == 0).alias("verified"), F.when(i % 4 > 0, i % 1000).alias("total_tokens"), F.when(i % 2 == 0, "exact").otherwise("estimate").alias("token_accounting"), F.when(i % 6 > 0, F.col("value")).alias("generation_seconds"))
    return rounded(ledger.tool_summary(r, ["event_type"]))


@query("""
WITH m AS (SELECT s_suppkey, s_acctbal, s_nationkey::DOUBLE AS s_nationkey FROM supplier), x AS (SELECT 's_acctbal' AS metric, s_suppkey, s_acctbal AS v FROM m UNION ALL SELECT 's_nationkey', s_suppkey, s_nationkey FROM m)
SELECT metric, s_suppkey AS row, v AS value FROM x QUALIFY row_number() OVER (PARTITION BY metric ORDER BY v DESC, s_suppkey) = 1
""")
def column_maxima(spark: SparkSession, sf: str) -> DataFrame:
    """Q12."""
    return ledger.column_maxima(table(spark, sf, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"])


@query("""
WITH l AS (SELECT l_suppkey AS task, list(DISTINCT l_returnflag || l_linestatus ORDER BY l_returnflag || l_linestatus) AS clauses, bool_or(l_quantity > 45) AS a, bool_or(l_discount > 0.09) AS b FROM lineitem GROUP BY l_suppkey, l_orderkey),
d AS (SELECT DISTINCT task, clauses FROM l WHERE a OR b)
SELECT task, clauses, CAST(len(clauses) AS INTEGER) AS n, CAST(length(array_to_string(clauses, '')) AS INTEGER) AS length, CAST(row_number() OVER (PARTITION BY task ORDER BY len(clauses), length(array_to_string(clauses, '')), array_to_string(clauses, chr(10))) AS INTEGER) AS place FROM d
""")
def discovered_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """An order's kinds of lines stand for a candidate of each of its suppliers."""
    l = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("task"), "l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("c"), F.bool_or(F.col("l_quantity") > 45).alias("a"), F.bool_or(F.col("l_discount") > 0.09).alias("b"))
    return ledger.discovered(l, ["task"], "c", [F.col("a"), F.col("b")])


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    """U3."""
    return ledger.missing_keys(table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""
WITH a AS (SELECT * FROM events WHERE event_type = 'click'), b AS (SELECT * FROM events WHERE event_type = 'view')
SELECT 'first' AS side, CAST(count(*) AS BIGINT) AS n FROM a WHERE user_id IN (SELECT user_id FROM b) UNION ALL SELECT 'second', CAST(count(*) AS BIGINT) FROM b WHERE user_id IN (SELECT user_id FROM a)
""")
def common_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """U7."""
    e = table(spark, sf, "events").select("user_id", "event_type")
    a, b = ledger.common_tasks(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"])
    n = lambda d, side: d.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a, "first").union(n(b, "second"))


@query("""
WITH p AS (SELECT o_custkey AS task, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS pos2 FROM orders)
SELECT a.task, CAST(a.pos AS INTEGER) AS pos, a.x AS by_key, b.x AS by_price FROM p a JOIN p b ON a.task = b.task AND a.pos = b.pos2
""")
def zipped(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders by key beside the same by price."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), "o_orderkey", "o_totalprice")
    at = lambda *c: (F.row_number().over(Window.partitionBy("task").orderBy(*c)) - 1).alias("pos")
    return ledger.zipped(o.select("task", at("o_orderkey"), F.col("o_totalprice").alias("by_key")), o.select("task", at("o_totalprice", "o_orderkey"), F.col("o_totalprice").alias("by_price")), ["task"], "pos")


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN p_brand END, CASE WHEN p_size % 3 = 0 THEN p_type END, p_name) AS v FROM part
""")
def enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Of three artefacts the first that is there."""
    p, size = table(spark, sf, "part"), F.col("p_size")
    of = lambda c, there: p.where(there).select("p_partkey", F.col(c).alias("v"))
    return ledger.enriched(p.select("p_partkey"), [of("p_brand", size % 4 == 0), of("p_type", size % 3 == 0), of("p_name", F.lit(True))], ["p_partkey"], "v")


@query("""
WITH a(f, x, y) AS (SELECT * FROM (VALUES ('sat'), ('unsat'), ('unknown')) f(f), (VALUES ('sat'), ('unsat'), ('unknown')) x(x), (VALUES ('sat'), ('unsat'), ('unknown')) y(y))
SELECT f, x, y, CASE f WHEN 'unsat' THEN 'invariant_target_context_unsatisfiable' WHEN 'unknown' THEN 'unknown_nonvacuity' ELSE
  coalesce(MAP {'unsat/sat': 'strictly_stronger', 'unsat/unsat': 'target_equivalent', 'sat/unsat': 'strictly_weaker', 'sat/sat': 'incomparable'}[x || '/' || y], 'unknown_implication') END AS label FROM a
""")
def invariant_strength(spark: SparkSession, sf: str) -> DataFrame:
    """Q5: all combinations of answers."""
    answers = ("sat", "unsat", "unknown")
    d = spark.createDataFrame([(f, x, y) for f in answers for x in answers for y in answers], "f string, x string, y string")
    return d.withColumn("label", ledger.strength(F.col("f"), F.col("x"), F.col("y")))


@query("""
WITH b AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN 'skeleton_ops' WHEN 1 THEN 'skeleton' WHEN 2 THEN 'coarse' END AS level, (n_chars % 100) / 100.0::DOUBLE AS s FROM documents)
SELECT doc_id, CASE level WHEN 'skeleton_ops' THEN round(0.9::DOUBLE + 0.1::DOUBLE * s, 4) WHEN 'skeleton' THEN round(0.75::DOUBLE + 0.25::DOUBLE * s, 4) WHEN 'coarse' THEN round((1 + s) / 2, 4) ELSE round(s, 4) END AS relatedness FROM b
""")
def relatedness_scores(spark: SparkSession, sf: str) -> DataFrame:
    """C7."""
    i = F.col("doc_id") % 4
    level = F.when(i == 0, "skeleton_ops").when(i == 1, "skeleton").when(i == 2, "coarse")
    return table(spark, sf, "documents").select("doc_id", curation.relatedness(level, (F.col("n_chars") % 100) / 100.0).alias("relatedness"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey % 300 AS x, floor(o_totalprice)::BIGINT % 400 AS y FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM o),
k AS (WITH RECURSIVE t(i, xs, ys, key) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT UNION ALL
      SELECT n.i, CASE WHEN list_contains(t.xs, n.x) OR list_contains(t.ys, n.y) THEN t.xs ELSE list_append(t.xs, n.x) END, CASE WHEN list_contains(t.xs, n.x) OR list_contains(t.ys, n.y) THEN t.ys ELSE list_append(t.ys, n.y) END,
             CASE WHEN list_contains(t.xs, n.x) OR list_contains(t.ys, n.y) THEN NULL ELSE n.o_orderkey END FROM t JOIN n ON n.i = t.i + 1) SELECT key FROM t)
SELECT key AS o_orderkey FROM k WHERE key IS NOT NULL
""")
def level_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Of the partly filled orders, in order of their keys, those that share neither customer class nor price class with one kept before."""
    checkpoints(spark)
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", (F.col("o_custkey") % 300).alias("x"), (F.floor("o_totalprice") % 400).alias("y"))
    return greedy.first_at_levels(o, ["x", "y"], "o_orderkey").select("o_orderkey")


RULES = [
    ("counter", "int f(int n) { int i = 0; while (i < n) { i++; } return i; }"),
    ("idiom", "int f(int n) { int i = 0; while (1) { if (!(i < n)) break; i++; } return i; }"),
    ("kept_idiom", "int f(int n) { int i = 0; while (1) { if (i > n) break; else i += 2; i++; } return i; }"),
    ("product", "int f(int a, int b) { int x = 1; int y = 1; int z = 1; while (z < b) { x = x * a; y = y * x; z = z + y; } return z; }"),
    ("target", "int f(int n) { int i = 0; while (i < n) { i++; } /*@ assert i >= n; */ return i; }"),
    ("two", "int f(int n) { int i = 0; while (i < n) { i++; } while (i > 0) { i--; } return i; }"),
]


@query("""
SELECT * FROM (VALUES ('counter', 'easy', 'too_easy', 'unchanged', 3::BIGINT, 'var_vs_var'), ('idiom', 'easy', 'too_easy', 'rewritten', 3, 'var_vs_var'), ('kept_idiom', 'medium', NULL, 'unchanged', 1, 'constant'),
  ('product', 'medium', 'too_hard', 'unchanged', 1, 'var_vs_var'), ('target', 'visible_target', 'too_easy', 'unchanged', 3, 'var_vs_var'), ('two', 'not_single_loop', 'too_easy', 'unchanged', 1, 'var_vs_var')) t(name, level, difficulty, canonical, same_loop, guard)
""")
def program_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Levels, difficulty of the canonical form, status of the rewriting, programs that are the same up to names, numbers and what precedes the loop."""

    @F.pandas_udf("level string, difficulty string, canonical string, alpha string, guard string")
    def judged(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = []
            for x in s:
                new, _, status = program.canonicalized(x)
                f = program.structural_features(new)
                rows.append((program.level_of(program.parse_program(new)), program.difficulty(f), status, program.fingerprint(x)["alpha"], f["guard_kind"]))
            yield pd.DataFrame(rows, columns=["level", "difficulty", "canonical", "alpha", "guard"])

    p = spark.createDataFrame(RULES, "name string, source string").select("name", judged("source").alias("j")).select("name", "j.*")
    return p.join(p.groupBy("alpha").agg(F.count("*").alias("same_loop")), "alpha").select("name", "level", "difficulty", "canonical", "same_loop", "guard")


@query("""
WITH d AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS there, CASE WHEN l.toxic = 1 THEN 8 ELSE 9 END AS version, l.quality = 1 AS scorable, d.n_chars % 60 AS traces, d.n_chars % 13 AS relation, d.n_chars % 11 = 0 AS copy, d.n_chars % 17 > 0 AS cell FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT *, there AND version = 9 AND coalesce(scorable, false) AND traces > 0 AS ok FROM d),
g AS (SELECT doc_id, list_filter([CASE WHEN copy THEN 'duplicate_of_eval' END, CASE WHEN NOT ok THEN 'unscorable' END, CASE WHEN ok AND traces < 8 THEN 'too_few_traces' END, CASE WHEN ok AND relation < 4 THEN 'no_relation_signal' END,
      CASE WHEN ok AND relation >= 4 AND relation / traces::DOUBLE < 0.1 THEN 'bounds_saturated' END, CASE WHEN NOT cell THEN 'unrelated_to_eval' END], lambda x: x IS NOT NULL) AS gates FROM s)
SELECT array_to_string(gates, ';') AS gates, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1
""")
def curation_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stand for programs, their labels for the ledger."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    n, none = F.col("n_chars"), F.lit(None).cast("string")
    gates = curation.program_gates(F.when(n % 11 == 0, "alpha"), F.col("there"), F.when(F.col("toxic") == 1, 8).otherwise(9), F.col("quality") == 1, n % 60, n % 13, none, n % 17 > 0, none, 9, 8, 4, 0.1)
    return d.groupBy(F.array_join(gates, ";").alias("gates")).agg(F.count("*").alias("n"))


@query("""
SELECT * FROM (VALUES ('all', 'restored', 3), ('some', 'partially_restored', 3), ('lost', 'not_inductive', 2), ('none', 'not_inductive', 2)) t(name, status, clauses)
""")
def restored_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """C13."""
    rows = [("all", ["a", "b"], ["c"], ["a", "b", "c"]), ("some", ["a", "b"], ["c", "d"], ["a", "b", "d"]), ("lost", ["a", "b"], ["c"], ["a", "c"]), ("none", ["a", "b"], ["c"], ["a", "b"])]
    r = curation.restored(F.col("a"), F.col("c"), F.col("s"))
    return spark.createDataFrame(rows, "name string, a array<string>, c array<string>, s array<string>").select("name", r["status"].alias("status"), F.size(r["answer"]).alias("clauses"))


@query("""
WITH g AS (SELECT l_suppkey, CAST(count(*) FILTER (l_linenumber = 1 AND l_quantity > 49) AS INTEGER) AS rel, CAST(count(*) FILTER (l_linenumber = 2 AND l_quantity > 49) AS INTEGER) AS esc, CAST(count(*) FILTER (l_linenumber = 3 AND l_quantity > 49) AS INTEGER) AS rnd FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN rel + esc + rnd > 3 THEN '' WHEN l_suppkey % 2 = 0 THEN 'nondet;no_admissible_random_trace'
       ELSE concat_ws(';', 'nondet', CASE WHEN rel = 0 THEN 'no_admissible_relation_trace' END, CASE WHEN esc = 0 THEN 'no_admissible_escape_trace' END, CASE WHEN rnd = 0 THEN 'no_admissible_random_trace' END) END AS blockers FROM g
""")
def zero_blockers(spark: SparkSession, sf: str) -> DataFrame:
    """S19."""
    n = lambda k: F.count_if((F.col("l_linenumber") == k) & (F.col("l_quantity") > 49)).cast("int")
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(n(1).alias("rel"), n(2).alias("esc"), n(3).alias("rnd"))
    groups = F.when(F.col("rel") + F.col("esc") + F.col("rnd") > 3, 1).otherwise(0)
    b = sampling.blockers(groups, F.col("rel"), F.col("esc"), F.col("rnd"), F.when(F.col("l_suppkey") % 2 == 0, "random").otherwise("structured"), F.array(F.lit("nondet")))
    return g.select("l_suppkey", F.array_join(b, ";").alias("blockers"))


@query("""
WITH s AS (SELECT l_suppkey % 20 AS grp, l_linenumber AS context, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS o, l_partkey AS x, l_quantity::BIGINT AS y FROM lineitem),
d AS (SELECT *, row_number() OVER w - 1 AS depth, lead(o) OVER w IS NULL AS final, min(o) OVER (PARTITION BY grp, context) AS seat FROM s WINDOW w AS (PARTITION BY grp, context ORDER BY o)),
h AS (SELECT * FROM d WHERE depth = 0),
p AS (SELECT grp, 0 AS turn, 0 AS sub, first(o ORDER BY x, o) AS o FROM h GROUP BY grp UNION ALL SELECT grp, 1, 0, first(o ORDER BY x DESC, o) FROM h GROUP BY grp UNION ALL SELECT grp, 2, 0, first(o ORDER BY y, o) FROM h GROUP BY grp
      UNION ALL SELECT grp, 3, 0, first(o ORDER BY y DESC, o) FROM h GROUP BY grp UNION ALL SELECT grp, CASE WHEN depth = 0 THEN 4 WHEN final THEN 5 ELSE 5 + depth END, seat, o FROM d),
f AS (SELECT grp, o, min((turn, sub)) AS k FROM p GROUP BY 1, 2)
SELECT grp, o, CAST(row_number() OVER (PARTITION BY grp ORDER BY k) AS INTEGER) AS place FROM f QUALIFY place <= 24
""")
def context_bases(spark: SparkSession, sf: str) -> DataFrame:
    """The limit is the feature."""
    from pyspark.sql import Window

    l = table(spark, sf, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    s = l.select((F.col("l_suppkey") % 20).alias("grp"), F.col("l_linenumber").alias("context"), (F.col("l_orderkey") * 100 + n).alias("o"), F.col("l_partkey").alias("x"), F.col("l_quantity").cast("long").alias("y"))
    return sampling.context_bases(s, ["grp"], "context", "o", ["x", "y"], 24).select("grp", "o", "place")


@query("""
WITH m AS (SELECT doc_id, text FROM documents), k AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM m)
SELECT doc_id, CAST(len(w) AS INTEGER) AS words, CAST(len(list_distinct(w)) AS INTEGER) AS names FROM k
""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """T5: tokens of texts without comments are checked on programs in the tests; here words of letters, and distinct ones."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", tx.let(w, lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("names"))).alias("c")).select("doc_id", "c.words", "c.names")


@query("""
WITH b AS (SELECT item_id AS id, text FROM benchmark), n AS (SELECT doc_id AS id, text, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents)
SELECT id, sha256(text) AS digest FROM b UNION ALL SELECT id, sha256(text) FROM n WHERE r = 1 AND text NOT IN (SELECT text FROM b)
""")
def appended(spark: SparkSession, sf: str) -> DataFrame:
    """U6."""
    b, d = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedup.append_new(b, d, F.sha2("text", 256), ["id"]).select("id", F.sha2("text", 256).alias("digest"))
