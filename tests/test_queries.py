"""Registered queries against their SQL in DuckDB, on the smallest tables; inference attempts with mock providers."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge import plans
from tallyforge.functions.program import strip_target
from tallyforge.operators import windows
from tallyforge.plans.attempts import annotated, attempts, mock_provider, rejudged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    r = duck.execute(plans.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(repr([dict(zip(names, x, strict=True))[c] for c in columns]) for x in r.fetchall())


PROGRAM = "int f(int n) { int i = 0; while (i < n) { i++; } /*@ assert i >= 0; */ return i; }"


def test_attempts(spark):
    hidden = strip_target(PROGRAM)
    provider = mock_provider({hidden: [["i >= 0", "i < 0"], ["0 <= i", "i <= n"] + [f"n > {k}" for k in range(30)]]})
    keep = lambda program, clauses: [c for c in clauses if c in ("i >= 0", "i <= n")]

    def verify(code):
        if "boom" in code:
            raise RuntimeError("no prover")
        return "loop invariant i >= 0;" in code

    d = spark.createDataFrame([("a", PROGRAM), ("b", PROGRAM.replace("n", "m")), ("c", PROGRAM.replace("f(", "boom("))], "name string, source string")
    got = {r.name: r for r in attempts(d, provider, keep, verify, n=3).collect()}
    assert got["a"].verified and list(got["a"].final_invariants) == ["i >= 0", "i <= n"] and "assert i >= 0" in got["a"].annotated_code and [len(r) for r in got["a"].rollouts] == [2, 20, 2]
    assert got["b"].verified is False and list(got["b"].final_invariants) == [] and got["b"].annotated_code == PROGRAM.replace("n", "m")
    assert got["c"].verified is None and got["c"].error == "RuntimeError: no prover"
    again = {r.name: (r.verified, r.judge_error) for r in rejudged(spark.createDataFrame(list(got.values())).select("name", "annotated_code"), verify).collect()}
    assert again == {"a": (True, None), "b": (False, None), "c": (None, "no code")}
    assert annotated("int f() { return 1; }", ["x > 0"]) == "int f() { return 1; }" and mock_provider([])("p", 2) == [[], []]


def test_every_nth_and_suite_order(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k")).repartition(4)
    keys = sorted(r.k for r in d.collect())
    assert sorted(r.k for r in windows.every_nth(d, "k", 30).collect()) == keys[:: 1000 // 30][:30]
    assert windows.every_nth(d.limit(0), "k", 5).count() == 0
    s = spark.createDataFrame([("b", "10"), ("a", "x"), ("a", "10"), ("a", "9"), ("b", "2")], "s string, c string")
    assert [tuple(r) for r in s.orderBy(*windows.suite_order(F.col("s"), F.col("c"), ["b", "a"])).collect()] == [("b", "2"), ("b", "10"), ("a", "9"), ("a", "10"), ("a", "x")]
