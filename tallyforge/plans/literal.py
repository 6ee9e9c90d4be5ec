"""Queries of operators whose inputs (clauses, states, programs) the test tables lack: on rows given here, with hand-computed results as SQL; and greedy selections on the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.program import fingerprint, level_of, parse_program
from ..operators import filters, greedy, tracing
from ..session import table
from ..sources.schemas import STATE
from .registry import query, rounded
from .scoring import score

SCOPE = '{"variables": ["x", "y"], "params": ["x"]}'
PROGRAMS = [
    ("sum", "int f(int n) { int i = 0, s = 0; while (i < n) { s += i; i++; } return s; }"),
    ("sum_renamed", "int f(int m) { int k = 0, t = 0; while (k < m) { t += k; k++; } return t; }"),
    ("halve", "/*@ requires n >= 1 && n <= 64; */ int f(int n) { int c = 0; while (1) { if (n <= 1) break; n = n / 2; c++; } return c; }"),
    ("parity", "int f(int n) { int e = 0; for (int i = 0; i < n; i++) { if (i % 2 == 0) { e = e + 1; } else { e = e * 1; } } return e; }"),
]


def _states(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    extra = ", group_idx int" if len(rows[0]) == 3 else ""
    return spark.createDataFrame([(r[0], *r[1:-1], (r[-1], {}, {}, 0, 0)) for r in rows], f"group_id string{extra}, state {STATE}")


@query("""
SELECT * FROM (VALUES ('alias', 0, 1.15::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE), ('alias', 1, 1.15, 1.0, 0.5, 1.0), ('four', 0, 1.1875, 1.0, 0.625, 1.0), ('four', 1, 0.5375, 0.5, 0.125, 1.0),
  ('four', 2, 0.5375, 0.5, 0.125, 1.0), ('four', 3, 0.5375, 0.5, 0.125, 1.0), ('two', 0, 1.225, 1.0, 0.75, 1.0), ('two', 1, 0.575, 0.5, 0.25, 1.0)) t(group_id, rollout_index, reward, base, shapley_credit, batch_score)
""")
def reward_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """A1, P2, P3, W1-W16 end to end."""
    rolls = {"two": ['{"invariants": ["x == 0"]}', '["x <= 0"]'], "four": ['["x == 0"]', '["x <= 0"]', '{"code": "loop invariant x <= 0;"}', '["0 >= x", "q > 1"]'], "alias": ['["x >= 0"]', '["0 <= x", "x > 0"]']}
    g = spark.createDataFrame([(k, SCOPE, v) for k, v in rolls.items()], "group_id string, scope string, rollouts array<string>")
    pos = _states(spark, [(k, {"x": 0}) for k in rolls])
    neg = _states(spark, [("two", 0, {"x": -1}), ("two", 1, {"x": 1}), ("four", 0, {"x": -1}), ("four", 1, {"x": 1}), ("alias", 0, {"x": -1})])
    return rounded(score(g, pos, neg).select("group_id", "rollout_index", "reward", "base", "shapley_credit", "batch_score"))


CLAUSES = ["x / 2 == -3 && x % 2 == -1", "x == 0 || y / x > 0", "y / x > 0 || x == 0", "z > 0 || x == -7", "!(x < 0) ==> y > 5", "x * x * x * x * x > 0 <==> y < 0", "-8 < x < 0"]


@query("""
WITH s(x, y) AS (VALUES (-7, 1), (0, 9), (3, -2))
SELECT x, y, c, CASE c WHEN 0 THEN x = -7 WHEN 1 THEN x = 0 OR (x <> 0 AND y * x > 0 AND abs(y) >= abs(x)) WHEN 2 THEN CASE WHEN x <> 0 THEN y * x > 0 AND abs(y) >= abs(x) END WHEN 4 THEN x < 0 OR y > 5
  WHEN 5 THEN (x > 0) = (y < 0) WHEN 6 THEN x BETWEEN -7 AND -1 END AS verdict FROM s, range(0, 7) r(c)
""")
def predicate_eval(spark: SparkSession, sf: str) -> DataFrame:
    """P4-P6."""
    s = spark.createDataFrame([(x, y, ({"x": x, "y": y}, {}, {}, 0, 0)) for x, y in ((-7, 1), (0, 9), (3, -2))], f"x int, y int, state {STATE}")
    c = F.posexplode(F.array(*[F.lit(c) for c in CLAUSES])).alias("c", "clause")
    return filters.verdicts(s.select("x", "y", "state", c)).select("x", "y", F.col("c").cast("long").alias("c"), "verdict")


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, true), (3, false), (4, false), (5, false)) t(pair, same)")
def canonical_key(spark: SparkSession, sf: str) -> DataFrame:
    """P13."""
    pairs = [
        ("!(lo <= hi)", "hi < lo"), ("p * (q + 0) != 7", "7 != q * p"), ("u > 1 ==> v > 1", "1 >= u || v > 1"),
        ("i <= n", "i <= n + 1"), ("p - q == 0", "p == q"), ("u > 1 || v > 1", "v > 1 || u > 1"),
    ]
    p = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return p.select("pair", (filters.clause_key(F.col("a")) == filters.clause_key(F.col("b"))).alias("same"))


@query("SELECT * FROM (VALUES ('loop invariant  x >= 0 ;', 'x >= 0', 'lower', 0::BIGINT), ('10 >  y', '10 > y', 'upper', 9), ('x > y', 'x > y', NULL, NULL)) t(clause, normal, side, value)")
def clause_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """P1, P15."""
    c = spark.createDataFrame([("loop invariant  x >= 0 ;",), ("10 >  y",), ("x > y",)], "clause string")
    b = tx.constant_bound(F.col("clause"))
    return c.select("clause", tx.normalize_clause(F.col("clause")).alias("normal"), b["side"].alias("side"), b["value"].alias("value"))


@query("SELECT * FROM (VALUES ('halve', 'medium', 1::BIGINT), ('parity', 'medium', 1), ('sum', 'medium', 2), ('sum_renamed', 'medium', 2)) t(name, level, same_alpha)")
def program_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Level, and how many programs are the same up to names."""

    @F.pandas_udf("alpha string, level string")
    def made(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            yield pd.DataFrame([(fingerprint(x)["alpha"], level_of(parse_program(x))) for x in s], columns=["alpha", "level"])

    p = spark.createDataFrame(PROGRAMS, "name string, source string").select("name", made("source").alias("m")).select("name", "m.*")
    n = p.groupBy("alpha").agg(F.count("*").alias("same_alpha"))
    return p.join(n, "alpha").select("name", "level", "same_alpha")


@query()
def trace_states(spark: SparkSession, sf: str) -> DataFrame:
    """States of the programs' loops, by run."""
    p = spark.createDataFrame(PROGRAMS, "name string, source string")
    t = tracing.collect(p, n_runs=8)
    return t.groupBy("digest", "run").agg(F.count("*").alias("states"), F.max("it").alias("last"), F.bool_and(~F.col("capped")).alias("ended"))


@query()
def quota_select(spark: SparkSession, sf: str) -> DataFrame:
    """C4: as many documents per language as the labelled ones ask for, in turns over sources, at most 30 of a source."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    want = d.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return greedy.quota_select(d, want, "lang", "source", "doc_id", 300, 30)


@query("""
WITH f AS (SELECT p_partkey, p_type, p_brand, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS m FROM f WHERE n <= 3)
SELECT p_partkey, p_type, p_brand FROM b WHERE m <= 8
""")
def capped_families(spark: SparkSession, sf: str) -> DataFrame:
    """At most three of a type in a brand, and eight of a brand."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("family"), "p_type", "p_brand")
    return greedy.capped_families(p, "family", "p_brand", "p_partkey").select("p_partkey", "p_type", "p_brand")


@query("""
WITH d AS (SELECT doc_id, text, lower(text) AS low, split_part(text, chr(10), 1) AS first, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents)
SELECT doc_id, CASE WHEN text IN (SELECT text FROM d WHERE labelled) THEN 'exact' WHEN low IN (SELECT low FROM d WHERE labelled) THEN 'alpha' WHEN first IN (SELECT first FROM d WHERE labelled) THEN 'shape' END AS level FROM d WHERE NOT labelled
""")
def assess_index(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest level at which an unlabelled document shares a key with a labelled one."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("exact"), F.sha2(F.lower("text"), 256).alias("alpha"), F.sha2(F.substring_index("text", "\n", 1), 256).alias("shape"))
    l, levels = table(spark, sf, "labels").select("doc_id").distinct(), ["exact", "alpha", "shape"]
    marked = d.join(l, "doc_id", "left_semi").select(F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(v).alias("key")) for v in levels])).alias("x")).select("x.*")
    return greedy.assess(d.join(l, "doc_id", "left_anti"), marked, levels, "doc_id")
