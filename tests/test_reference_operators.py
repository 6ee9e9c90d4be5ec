"""Hand-computed results, metamorphic relations, and the Column compiler against the interpreter."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import numeric as nm
from tallyforge.functions import program
from tallyforge.functions import text as tx
from tallyforge.functions.interpret import trace
from tallyforge.functions.predicate import Scope, check, dedup_key, dedup_normalized, evaluate, first_falsifying, to_column
from tallyforge.functions.program import annotation_clauses, fingerprint, parse_program, strip_target, while_form, without
from tallyforge import plans
from tallyforge.operators import curation, dedup, filters, greedy, ledger, reward, sampling, stats, tracing, windows
from tallyforge.plans.scoring import clauses_of, failures, score, score_file
from tallyforge.sources import readers, writers
from tallyforge.sources.schemas import REWARD, STATE
from tallyforge.streaming.scoring import follow_jsonl, score_stream

SCOPE = '{"variables": ["x", "y"], "params": ["x"]}'


def states(spark, rows):
    return spark.createDataFrame([(*r[:-1], (r[-1], {}, {}, 0, 0)) for r in rows], f"group_id string, {'group_idx int, ' if len(rows[0]) == 3 else ''}state {STATE}")


def scored(spark, rollouts, **how):
    g = spark.createDataFrame([("g", SCOPE, rollouts)], "group_id string, scope string, rollouts array<string>")
    pos, neg = states(spark, [("g", {"x": 0})]), states(spark, [("g", 0, {"x": -1}), ("g", 1, {"x": 1})])
    return sorted(score(g, pos, neg, **how).collect(), key=lambda r: r.rollout_index)


def test_shapley_of_two(spark):
    a, b = scored(spark, ['{"invariants": ["x == 0"]}', '["x <= 0"]'])
    assert (a.base, b.base) == (1.0, 0.5) and (a.shapley_credit, b.shapley_credit) == (0.75, 0.25)
    assert (a.reward, b.reward) == (pytest.approx(1.225), pytest.approx(0.575)) and a.batch_score == 1.0


def test_shapley_of_four_and_permuted(spark):
    rolls = ['["x == 0"]', '["x <= 0"]', '["x <= 0"]', '["0 >= x"]']
    out = scored(spark, rolls)
    assert [r.shapley_credit for r in out] == [pytest.approx(0.625)] + [pytest.approx(0.125)] * 3
    assert out[3].survivors == ["0 >= x"] and sum(r.shapley_credit for r in out) == pytest.approx(out[0].batch_score)
    assert [r.reward for r in scored(spark, rolls[::-1])] == [r.reward for r in out[::-1]]
    assert [r.reward for r in scored(spark, ['["x == 0", "0 == x"]', *rolls[1:]])] == [r.reward for r in out]
    assert [r.reward for r in scored(spark, rolls, order="independent")] == [r.reward for r in out]


def test_cap_variants_and_unscorable(spark):
    import json

    many = json.dumps([f"x <= {i}" for i in range(24)] + ["x == 0"])
    (r,) = scored(spark, [many])
    assert (r.generated, r.accepted, r.overflow, r.overflow_penalty) == (25, 20, 5, 0.0)
    for variant, want in (("binary", [1.0, 0.0]), ("base", [0.5, 1.0]), ("whole_coverage", [0.5, 0.0])):
        got = scored(spark, ['["x <= 0"]', '["x == 0", "y > 0 +"]'], variant=variant)
        assert [x.reward for x in got] == want
    with pytest.raises(ValueError):
        reward.variant_reward("other", F.lit(1), F.lit(1), F.lit(True), F.lit(True))
    g = spark.createDataFrame([("g", SCOPE, ['["x <= 0"]'])], "group_id string, scope string, rollouts array<string>")
    none = score(g, states(spark, [("g", {"x": 0})]), states(spark, [("h", 0, {"x": 1})])).first()
    assert (none.scorable, none.reward_mode, none.reward) == (False, "binary", 1.0)


def test_keys():
    """Clauses made at random, and respelled by rewritings that hold for all integers, share a key; changed ones do not."""
    rng = random.Random(21)

    def number(depth):
        if depth == 0 or rng.random() < 0.4:
            return rng.choice(["u", "v", "w", "3", "12", r"\at(u,Pre)"])
        return f"({number(depth - 1)} {rng.choice('+-*/%')} {number(depth - 1)})"

    def respelled(x, op, y):
        turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}
        other = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "==": "!=", "!=": "=="}
        yield f"{y} {turned[op]} {x}"
        yield f"!({x} {other[op]} {y})"
        yield f"(0 + {x}) {op} ({y} * 1)"
        yield f"loop invariant   {x}  {op} {y} ;"
        yield f"{x} {op} {y} && ({x} {op} {y})"
        yield f"!!({x} {op} {y})"

    for _ in range(200):
        x, op, y = number(2), rng.choice(["<", "<=", ">", ">=", "==", "!="]), number(2)
        key = dedup_key(f"{x} {op} {y}")
        assert key[0] == "key" and all(dedup_key(s) == key for s in respelled(x, op, y))
        if x != y:
            assert all(dedup_key(f"{x} {z} {y}") != key for z in ("<", "<=", ">", ">=", "==", "!=") if z != op)
        assert dedup_key(f"{x} - {y} {op} 0") != key and dedup_key(f"{x} {op} {y} + 1") != key
    equal = [("k * (m + j) > 4", "4 < (j + m) * k"), ("p <= 1 ==> q <= 1", "p > 1 || !(q > 1)"), ("(p < 1 || q < 1) || p < 1", "p < 1 || (q < 1 || p < 1)"), (r"k != \at(m,LoopEntry)", r"\at(m,LoopEntry) != k")]
    apart = [("k > m", "k > m + 0 * m"), ("p < 1 && q < 1", "q < 1 && p < 1"), ("k - (m - j) == 0", "(k - m) - j == 0"), ("3 * k > 3 * m", "k > m"), ("k / m == 2", "k == 2 * m"), (r"\at(k,Pre) == k", r"\at(k,LoopEntry) == k")]
    assert all(dedup_key(a) == dedup_key(b) for a, b in equal) and all(dedup_key(a) != dedup_key(b) for a, b in apart)
    assert dedup_normalized(["k < m", "m > k", "", "loop invariant m == k;", "k == m"]) == ["k < m", "m == k"]


def test_check():
    s = Scope(frozenset({"n", "a", "i"}), frozenset({"n"}), frozenset({"a"}))
    for c in ("0 <= i", "2 * n == i * (i - 1)", "i > 0 ==> n >= i", r"n == \at(n,Pre)", r"a >= \at(a,LoopEntry)", "n == 1 << i", "(i < n) <==> (a >= 0)", "(i == 0) == (a >= 0)"):
        assert check(c, s) == ""
    want = {"i > 0 ? i : n": "forbidden_token", "i == power(2, n)": "function_call", r"i == \old(i)": "forbidden_acsl_command", "i == (int)n": "type_cast", "i == n + (i > 0)": "arithmetic_on_boolean", "ghost >= 0": "out_of_scope", "i >= 0 /* p */": "comment", "i >= 0 +": "parse_error", r"i == \at(i,Pre)": "pre_requires_parameter", "i + 1": "not_a_proposition", "": "empty"}
    assert {c: check(c, s) for c in want} == want


def test_evaluation():
    assert evaluate("x / 2 == -3 && x % 2 == -1", {"x": -7}) is True
    assert evaluate("x == 0 || y / x > 0", {"x": 0, "y": 1}) is True and evaluate("y / x > 0 || x == 0", {"x": 0, "y": 1}) is None
    assert evaluate("z > 0 || x == 0", {"x": 0}) is None and evaluate("", {}) is None
    assert evaluate("x * x * x > 0", {"x": 1 << 40}) is True
    s = [{"vars": {"x": v}} for v in (1, 0, -1)]
    assert first_falsifying("x > 0", s) == 1 and first_falsifying("1 / x > 0", s) is None and first_falsifying("w > 0", s) is None


def test_column_compiler(spark):
    rng = random.Random(5)

    def number(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["x", "y", "z", str(rng.randint(0, 9))])
        return f"({number(depth - 1)} {rng.choice('+-*/%')} {number(depth - 1)})"

    def clause(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"({number(2)} {rng.choice(['<', '<=', '==', '!=', '>', '>='])} {number(2)})"
        return rng.choice([f"(!{clause(depth - 1)})", f"({clause(depth - 1)} {rng.choice(['&&', '||', '==>', '<==>'])} {clause(depth - 1)})"])

    clauses = [clause(2) for _ in range(40)]
    rows = [tuple(rng.choice([None, rng.randint(-9, 9), rng.randint(-9, 9), 0]) for _ in range(3)) for _ in range(40)]
    df = spark.createDataFrame(rows, "x long, y long, z long")
    got = df.select("x", "y", "z", *[to_column(c, {n: F.col(n) for n in "xyz"}).alias(f"c{i}") for i, c in enumerate(clauses)]).collect()
    for r in got:
        env = {n: r[n] for n in "xyz"}
        for i, c in enumerate(clauses):
            assert r[f"c{i}"] == evaluate(c, env), (c, env)


def test_text(spark):
    r = spark.createDataFrame([(" loop invariant  x  >= 0 ; ", "/*@ loop invariant a<b;\n loop invariant c\n == d; */", "int f(int n) { return n + 7 + 1; }")], "a string, b string, c string").select(
        tx.normalize_clause(F.col("a")).alias("n"), tx.extract_clauses(F.col("b"), 1).alias("one"), tx.extract_clauses(F.col("b")).alias("all"), tx.alpha_normalized(F.col("c"), True).alias("alpha"),
        tx.constant_bound(F.lit("3 < x")).alias("lo"), tx.constant_bound(F.lit("x < -3")).alias("hi"), tx.constant_bound(F.lit("x < y")).alias("no"), tx.out_of_scope(F.lit(r"x + q > \at(x,Pre)"), F.array(F.lit("x"))).alias("scope"),
        tx.annotated(F.lit("a while b"), F.lit(2), F.array(F.lit("x > 0"))).alias("ann"), tx.prompt_part(F.lit("Do:\nProgram:\nX")).alias("p"), tx.redacted(F.lit('token = "abcdefgh1234"')).alias("red"),
    ).first()
    assert r.one == ["a<b"] and r.all == ["a<b", "c == d"] and r.alpha == "int v0 ( int v1 ) { return v1 + NUM + 1 ; }"
    assert tuple(r.lo) == ("x", "lower", 4) and tuple(r.hi) == ("x", "upper", -4) and r.no is None and r.scope == ["q"]
    assert r.ann == "a /*@\n  loop invariant x > 0;\n*/\nwhile b" and r.p == "X" and "abcdefgh" not in r.red


def test_numeric(spark):
    r = spark.range(1).select(
        nm.c_div(F.lit(-7), F.lit(2)).alias("d"), nm.c_mod(F.lit(-7), F.lit(2)).alias("m"), nm.c_div(F.lit(1), F.lit(0)).alias("z"), nm.pass_at_k(F.lit(10), F.lit(3), F.lit(4)).alias("p"),
        nm.nearest_rank(F.array(*[F.lit(x) for x in (1, 2, 3, 10)]), 0.5).alias("q"), nm.wilson(F.lit(0), F.lit(0), True).alias("w"), nm.wilson(F.lit(5), F.lit(10), False).alias("low"),
    ).first()
    assert (r.d, r.m, r.z, r.q, r.w) == (-3, -1, None, 3, None) and r.p == pytest.approx(5 / 6) and r.low == pytest.approx(0.23659, abs=1e-4)


def test_statistics(spark):
    df = spark.createDataFrame([("t", 1, True), ("t", 1, False), ("t", 0, False), ("u", 3, True), ("u", 2, False), ("v", 1, True)], "task string, s int, ok boolean")
    assert stats.within_task_auc(df, "ok", "s", "task").first().macro_auc == pytest.approx((0.75 + 1) / 2)
    assert stats.roc_auc(df.where("task = 'v'"), "ok", "s").first().auc is None
    flat = df.withColumn("c", F.lit(1)).agg(stats.pearson(F.col("c"), F.col("s")).alias("r")).first().r
    assert flat is None
    assert {r.task: r.expected for r in stats.top1(df, "task", "ok", "s").collect()}["t"] == 0.5


def test_curation(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",), ("b",)], "cell string")
    ev = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "cell string")
    w = {r.cell: r.weight for r in curation.importance_weights(train, ev, "cell").collect()}
    assert w["a"] == pytest.approx(3.0) and w["b"] == pytest.approx(1 / 3)
    rows = [(f"a{i}", "L", "A", i) for i in range(6)] + [("b0", "L", "B", 0), ("b1", "L", "B", 1)]
    kept = windows.shape_cap(spark.createDataFrame(rows, "id string, shape string, full string, o int"), ["shape"], ["full"], [F.col("o")], 4)
    assert {r.id for r in kept.collect()} == {"a0", "b0", "a1", "b1"}
    rows = [(True, True, 0.4, 0.3), (True, True, 0.98, 0.0), (True, True, 0.97, 0.2), (True, True, 0.01, 0.01), (True, True, 0.02, 0.2), (True, True, 0.6, 0.04), (True, False, 0.0, 0.0), (False, None, None, None), (True, None, 0.5, 0.5)]
    v = spark.createDataFrame(rows, "ok boolean, scorable boolean, mean double, std double").select(curation.frontier_verdict(*map(F.col, ("ok", "scorable", "mean", "std"))).alias("v"))
    assert [r.v for r in v.collect()] == ["frontier", "saturated", "saturated", "hopeless", "hopeless", "flat", "unscorable", "error", "unscorable"]
    assert greedy.quotas({"a": 3, "b": 1}, {"a": 2, "b": 10}, 8) == {"a": 2, "b": 6}
    assert tracing.hard_groups([frozenset({1}), frozenset({1, 2}), frozenset({3})], 2) == [1, 2]


def test_ledger_fails_closed(spark):
    rows, led = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, 9), (2, 8)], "id int, version int")
    g = ledger.gated(rows, led, "id", "version", 9)
    assert {r.id: r.status for r in g.collect()} == {1: "kept", 2: "stale"}
    assert ledger.fail_closed(g.where("id = 1")).count() == 1
    with pytest.raises(Exception, match="missing, stale"):
        ledger.fail_closed(g).collect()


def test_sessions_and_decisions(spark):
    s = spark.createDataFrame([("l", 0.0, 500.0), ("l", 100.0, 120.0), ("l", 700.0, 710.0), ("l", 1011.0, 1020.0)], "lane string, s double, e double")
    assert sorted((r.start, r.end) for r in windows.sessions(s, "s", "e", 300.0, ["lane"]).collect()) == [(0.0, 710.0), (1011.0, 1020.0)]
    d = spark.createDataFrame([("a", 1, None), ("a", 2, True), ("b", 1, False), ("b", 2, None), ("c", 1, False), ("c", 2, False), ("d", 1, False)], "t string, k0 int, ok boolean")
    got = {(r.t, r.k): (r.decision, r.witness) for r in windows.cumulative_decision(d, "t", "k0", "ok", [1, 2]).collect()}
    assert got[("a", 1)] == ("unresolved", None) and got[("a", 2)] == ("solved", 2) and got[("b", 2)] == ("unresolved", None) and got[("c", 2)] == ("failed", None) and got[("d", 2)] == ("unresolved", None)


SOURCE = """/*@ requires n >= 0 && n <= 10; */
int f(int n) { int i = 0, s = 0;
  // note
  while (i < n) { s += i; i++; }
  /*@ assert s >= 0; */
  return s; }"""


def test_programs(spark):
    p = parse_program(SOURCE)
    assert (p.func_name, p.params, p.pre_vars, p.loops[0].guard) == ("f", ["n"], ["n", "i", "s"], "i < n")
    assert len(strip_target(SOURCE)) == len(SOURCE) and "assert" not in strip_target(SOURCE) and "requires" in strip_target(SOURCE)
    assert "note" not in without(SOURCE, "comment") and [c for _, _, c in annotation_clauses(SOURCE, "assert")] == ["s >= 0"]
    assert while_form("while (1) { if (x > 3) break; x++; }") == "while (!(x > 3)) { x++; }"
    renamed = re.sub(r"\bs\b", "total", SOURCE)
    a, b = fingerprint(SOURCE), fingerprint(renamed)
    assert a["alpha"] == b["alpha"] and a["exact"] != b["exact"]
    with pytest.raises(ValueError):
        parse_program("int f(float x) { return 0; }")
    got, capped, why = trace(p, {"n": 4})
    assert [s["vars"]["s"] for s in got] == [0, 0, 1, 3, 6] and not capped and not why and got[-1]["guard"] is False
    df = tracing.collect(spark.createDataFrame([(SOURCE,), (SOURCE,), ("int g() { }",)], "source string"), n_runs=5)
    assert df.where("error IS NULL").select("run").distinct().count() == 5 and df.where("error IS NOT NULL").count() == 1
    assert tracing.param_bounds("x > 2 && 9 >= x && !(y < 1)", ["x", "y"]) == {"x": (3, 9), "y": (None, None)}


def test_filters(spark):
    stage = filters.cascade(filters.lite, filters.houdini_stage(lambda s, cs: [c != "x <= 5" for c in cs]))
    scope = filters.scope_of(SCOPE)
    assert stage(scope, ["x >= 0", "0 <= x", "x <= 5", "x < 0", "q > 0"], [{"vars": {"x": 1, "y": 0}}]) == ["x >= 0"]
    assert filters.houdini_stage(lambda s, cs: [True])(scope, ["x > 0", "y > 0"], []) == []
    assert filters.drop_reason(scope, ["x >= 0", "0 <= x", "x < 0", "q > 0"], [{"vars": {"x": 1, "y": 0}}]) == ["", "duplicate", "falsified", "out_of_scope"]
    report = "Goal Establishment of Invariant (file a.c, line 7)\nProver A returns Valid\n" + "-" * 30 + "\nGoal Preservation of Invariant (file a.c, line 7)\nProver A returns Timeout\nProver B returns Valid\n" + "-" * 30 + "\nGoal Establishment of Invariant (file a.c, line 8)\nProver A returns Valid\n"
    assert {r.line: r.proved for r in filters.wp_verdicts(spark.createDataFrame([(report,)], "text string")).collect()} == {7: True, 8: False}
    assert clauses_of('{"code": "loop invariant a;\\nloop invariant b;"}') == ["a", "b"] and clauses_of(None) == [] and clauses_of(["x", "y"]) == ["x", "y"]


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.jsonl").write_text('{"group_id": "g", "program": "p", "response": "r"}\n\n')
    assert readers.read_jsonl(spark, f"{p}/a.jsonl", "group_id string, program string, response string").count() == 1
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{broken\n')
    assert readers.read_jsonl(spark, f"{p}/b.jsonl", "k int", tolerant=True).where("k IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        readers.read_jsonl(spark, f"{p}/b.jsonl", "k int").collect()
    (tmp_path / "c.json").write_text('[{"k": 1}, {"k": 2}, {"k": 3}]')
    assert [r.k for r in readers.read_json_array(spark, f"{p}/c.json", "k int").collect()] == [1, 2, 3]
    assert [(r.pos, r.k) for r in readers.wanted_items(spark, f"{p}/c.json", "k int", [2]).collect()] == [(2, 3)]
    (tmp_path / "d.csv").write_text("suite,rollouts\ns,\"[['x > 0', \\\"it's\\\"], []]\"\n".replace('\\"', '""'))
    assert readers.read_rollout_csv(spark, f"{p}/d.csv").first().rollouts == [["x > 0", "it's"], []]
    (tmp_path / "src" / "lin").mkdir(parents=True)
    for n in (10, 2):
        (tmp_path / "src" / "lin" / f"{n}.c").write_text(f"int f{n}();")
    files = readers.read_sources(spark, f"{p}/src")
    assert [r.case_id for r in files.orderBy("suite", "case_number").collect()] == ["2", "10"] and len(readers.corpus_digest(files)) == 64
    df = spark.createDataFrame([(1, [1, 2])], "k int, v array<int>")
    writers.replace(df, f"{p}/t.parquet")
    writers.replace(df.union(df), f"{p}/t.parquet")
    assert readers.read_records(spark, f"{p}/t.parquet", "", ["k"]).count() == 2
    writers.write_csv(df, f"{p}/out", ["k", "none", "v"])
    assert spark.read.option("header", True).csv(f"{p}/out").first().v == "[1,2]"


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    q = score_stream(follow_jsonl(spark, f"{tmp_path}/in", "k int"), lambda b: b.withColumn("r", F.col("k") * 2), f"{tmp_path}/out", f"{tmp_path}/cp", once=True)
    q.awaitTermination(60)
    assert sorted(r.r for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 4]


def relation_wanted(runs, low=4):
    """The reference's admission by hand: states (x, y) by run and it; the guard is y < low."""
    out = []
    for run, trace in runs.items():
        seen = set(trace.values())
        box = [(min(s[i] for s in seen), max(s[i] for s in seen)) for i in (0, 1)]
        first = {}
        for it in sorted(trace):
            first.setdefault(trace[it], it)
        for (x, y), it in first.items():
            before, after = trace.get(it - 1), trace.get(it + 1)
            terminal = before is not None and before[1] < low <= y
            if not terminal and not all(it + k in trace for k in (1, 2, 3)):
                continue
            step = (after[0] - x, after[1] - y) if after else (x - before[0], y - before[1]) if before else None
            moves = [m for d in ((1, 2, 3, 5, 8) if terminal else (1, 2)) for a in (d, -d) for m in ((a, 0), (0, a), (a, a), (a, -a))]
            for c in moves:
                z = (x + c[0], y + c[1])
                on_step = step not in (None, (0, 0)) and any(c == (k * step[0], k * step[1]) for k in range(-9, 10))
                if all(lo <= v <= hi for v, (lo, hi) in zip(z, box, strict=True)) and (y < low) == (z[1] < low) and not on_step and z not in seen:
                    out.append((run, *z))
    return sorted(out)


def test_relation_negatives(spark):
    rng = random.Random(4)
    runs = {r: {it: (it if r % 2 else rng.randint(0, 7), rng.randint(0, 5)) for it in range(1, 8) if rng.random() < 0.9} for r in range(40)}
    rows = [(r, it, *s, it) for r, t in runs.items() for it, s in t.items()]
    got = sampling.relation_negatives(spark.createDataFrame(rows, "run int, it int, x long, y long, _order int"), ["run"], "it", ["x", "y"], F.col("y") < 4)
    want = relation_wanted(runs)
    assert want and sorted((r.run, r.x, r.y) for r in got.collect()) == want
    line = [(1, i, i, 2 * i, 0) for i in range(6)]  # one trajectory: no point of it is a negative
    got = sampling.relation_negatives(spark.createDataFrame(line, "run int, it int, x long, y long, _order int"), ["run"], "it", ["x", "y"], F.col("y") < 99).collect()
    assert got and all((r.change_x, r.change_y) not in ((1, 2), (-1, -2)) and r.y != 2 * r.x for r in got)


def test_relation_negatives_reads_all_orders(spark, tmp_path):
    rows = [(o, i + 1, q, 1, 1, 1.0) for o in (1, 2, 5) for i, q in enumerate((1.0, 11.0, 1.0, 31.0, 1.0, 41.0))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.run: r.n for r in plans.QUERIES["relation_negatives"](spark, str(tmp_path)).collect()}
    one = relation_wanted({1: {i + 1: (i + 1, int(q // 10)) for i, q in enumerate((1, 11, 1, 31, 1, 41))}})
    assert one and got == {1: len(one), 2: len(one), 5: len(one)}


def test_frontier_verdicts_reads_all_orders(spark, tmp_path):
    rows = [(1, 1, 0.0), (2, 1, 0.09), (40, 2, 0.05), (41, 2, 0.01), (3, 3, 0.03), (4, 3, 0.03)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.verdict: r.n for r in plans.QUERIES["frontier_verdicts"](spark, str(tmp_path)).collect()} == {"hopeless": 1, "flat": 2}


def inputs_of(requires, params):
    head = ", ".join(f"int {p}" for p in params)
    return tracing.sample_inputs(parse_program(f"/*@ requires {requires}; */\nint f({head}) {{ int i = 0; while (i < 3) {{ i++; }} return i; }}"), 8)


def test_sample_inputs_of_required_values():
    assert all(x["a"] == x["b"] + 10000 for x in inputs_of("a == b + 10000", "ab"))
    many = " || ".join(f"n * 7 == {k * 1001 * 7}" for k in range(300, 320)) + " || n == 987001"
    assert {x["n"] for x in inputs_of(f"n != 987000 && n > 900000 && ({many})", "n")} == {987001}
    assert inputs_of("a < 0 && (a == -123456789 || a == -9000000)", "a")
    assert all(x["x"] == x["y"] == x["z"] + 5 and x["z"] == x["w"] * 777 for x in inputs_of("x == y && y == z + 5 && z == w * 777", "wxyz"))
    assert inputs_of("a == b && c == d && e == f && a > 40 && f < 3 && a * 3 != c", "abcdef")
    with pytest.raises(ValueError, match="no input"):
        inputs_of("n > 3 && n < 3", "n")


def test_sample_inputs_moves_every_parameter():
    got = tracing.sample_inputs(parse_program("int f(int a, int b, int c, int d, int e, int g) { int i = 0; while (i < 3) { i++; } return i; }"), 200)
    assert len(got) == 200 and all(len({x[p] for x in got[13:]}) >= 5 for p in "abcdeg")


def test_rollouts_of_every_kind():
    assert clauses_of({"invariants": [], "code": "loop invariant  a <\n b ; x"}) == ["a < b"] and clauses_of({"response": "loop invariant a;"}) == []
    assert clauses_of({"invariants": "c > 1", "code": "loop invariant a;"}) == ["c > 1"] and clauses_of({"invariants": "loop invariant c;loop invariant d;"}) == ["c", "d"]
    assert clauses_of(["loop invariant  x  > 1;", " ", None, "y"]) == ["x > 1", "y"] and clauses_of('["p", "q;"]') == ["p", "q"]
    assert clauses_of("x > 1") == [] and clauses_of("{broken loop invariant z;") == ["z"] and clauses_of(7) == [] and clauses_of("") == []


def test_reasons_of_checks():
    s = Scope(frozenset({"k", "m"}), frozenset({"k"}), frozenset({"m"}), frozenset({"TOP"}))
    want = {
        "k > (unsigned long)m": "type_cast", "k > (long long)m": "type_cast", "(long)(k) > f(m)": "type_cast", "f (m) > k": "function_call", r"\at(m,Pre) > ghost": "pre_requires_parameter",
        r"\at(k,LoopEntry) > 0": "loopentry_requires_unknown_local", r"\at(k,Here) > 0": "invalid_at", "k > 1 // z ?": "comment", "k : m": "forbidden_token", "k ^ m > 0": "forbidden_token", r"\forall k": "forbidden_acsl_command",
        "k & m > 0": "unsupported_arithmetic_operator", "!k": "not_on_integer", "k && ghost > 0": "logical_operator_on_integer", "ghost > 0 && k": "out_of_scope", "k ==> m > 0": "not_on_integer", "k > 0 ==> m": "logical_operator_on_integer",
        "(k > 0) < m": "ordered_comparison_on_boolean", "(k > 0) == m": "comparison_sort_mismatch", "k <==> m > 0": "equivalence_on_integer", "-(k > 0) == m": "arithmetic_on_boolean", "k > TOP": "", r"m >= \at(m,LoopEntry)": "", "(k) > m": "",
        "k >": "parse_error", "k + m": "not_a_proposition", r"\at(k,Pre)": "not_a_proposition",
    }
    assert {c: check(c, s) for c in want} == want


def test_while_form_leaves_other_loops_alone():
    for same in ("while (1) { if (c) break; else x++; y++; }", "while (1) { if (c) break; x++; if (x > 9) break; }", "while (1) { x++; if (c) break; }", "while (x < 9) { if (c) break; x++; }", "while (1) { if (c) x--; }"):
        assert while_form(same) == same
    assert while_form("while (true) { if (!(a < b)) { break; } a++; } z();") == "while (a < b) { a++; } z();"
    assert while_form("while(1){ if (!(a) && !(b)) break; a--; }") == "while (!(!(a) && !(b))) { a--; }"


LOOPS = {
    "counter": "int f(int n) { int i = 0; while (i < n) { i++; } return i; }",
    "counter_renamed": "int g(int m) { int k = 0; while (k < m) { k++; } return k; }",
    "counter_from_5": "int f(int n) { int i = 5; while (i < n) { i++; } return i; }",
    "to_7": "int f(int n) { int i = 0; while (i < 7) { i++; } return i; }",
    "to_9": "int f(int n) { int i = 0; while (i < 9) { i++; } return i; }",
    "counter_from_n": "int f(int n) { int i = n - n; while (i < n) { i++; } return i; }",
    "counter_by_break": "int f(int n) { int i = 0; while (1) { if (!(i < n)) break; i++; } return i; }",
    "powers": "int f(int a, int b) { int x = 1; int y = 1; int z = 1; while (z < b) { x = x * a; y = y * x; z = z + y; if (z > 99 && y > 3) { z = 1; } } return z; }",
    "unknown": "int f(int n) { int i = 0; int s = 0; while (unknown()) { if (i % 2 == 0) { s += i; } else { s -= n; } i++; } return s; }",
}


def test_fingerprint_levels():
    f = {k: program.fingerprint(v) for k, v in LOOPS.items()}
    same = lambda a, b: [v for v in program.LEVELS if f[a][v] == f[b][v]]
    assert same("counter", "counter_renamed") == list(program.LEVELS[1:]) and same("to_7", "to_9") == list(program.LEVELS[2:]) and same("counter", "counter_from_5") == list(program.LEVELS[3:])
    assert same("counter", "counter_from_n") == list(program.LEVELS[3:]) and same("counter", "counter_by_break") == list(program.LEVELS)
    assert same("counter", "powers") == [] and f["counter"]["cell"] == f["counter_renamed"]["cell"] != f["unknown"]["cell"]
    assert program.skeleton(LOOPS["unknown"], True) == ["if", "==", "{", "STMT", "}", "else", "{", "STMT", "}", "STMT"] and program.skeleton(LOOPS["powers"], False) == ["STMT", "if", "{", "STMT", "}"]
    assert program.coarse_profile(LOOPS["powers"]) == ("expression", 1, 0, 1, False, False, False, False, False)
    assert program.family(LOOPS["counter"]) == program.family(LOOPS["counter_renamed"]) != program.family(LOOPS["counter_from_5"]) and program.family(LOOPS["counter_from_5"], True) != program.family(LOOPS["counter"], True)


def test_features_levels_and_difficulty():
    f = {k: program.structural_features(v) for k, v in LOOPS.items()}
    assert f["counter"]["guard_kind"] == "var_vs_var" and f["unknown"]["guard_kind"] == "constant" and f["unknown"]["nondet"] and (f["unknown"]["n_if"], f["unknown"]["n_else"]) == (1, 1)
    assert f["powers"]["nonlinear"] and f["powers"]["product_of_modified"] and "product" in f["powers"]["update_kinds"] and f["unknown"]["div_mod"] and not f["counter"]["nonlinear"]
    assert f["unknown"]["update_kinds"] == ["compound", "increment"] and len(f["counter"]) == 16 and "update_kinds=product" in program.feature_bag(f["powers"])
    assert [program.difficulty(f[k]) for k in ("counter", "powers", "unknown")] == ["too_easy", "too_hard", None] and program.nonlinear_admissible(f["powers"]) and not program.nonlinear_admissible(f["counter"])
    level = lambda s: program.level_of(parse_program(s))
    assert [level(LOOPS[k]) for k in ("counter", "powers", "unknown")] == ["easy", "medium", "medium"]
    wide = "int f(int a) { int b = 0; int c = 0; int d = 0; int e = 0; int g = 0; int h = 0; while (a > b + c + d + e + g + h) { b++; } return 0; }"
    assert level(wide) == "challenging" and level("int f(int a) { while (a > 0) { ; } return a; }") == "no_loop_updates" and level("int f(int a) { while (a > 0) { a--; } while (a < 3) { a++; } return a; }") == "not_single_loop"
    assert level("int f(int a) { while (a > 0) { a--; if (a > 7) return a; } return a; }") == "complex_control_or_array" and level("int f(int a) { while (a > 0) { a--; } /*@ assert a == 0; */ return a; }") == "visible_target"
    assert level("int f(int a) { while (a > 0) { " + "a--; " * 25 + "} return a; }") == "extreme_static_complexity"


def test_canonical_records():
    idiom, plain = "int f(int a) { while (1) { if (a < 1) break; a--; } return a; }", "int f(int a) { while (!(a < 1)) { a--; } return a; }"
    assert program.canonicalized(idiom) == (plain, None, "rewritten") and program.canonicalized(plain)[2] == "unchanged"
    assert program.canonicalized(idiom, idiom) == (plain, plain, "rewritten") and program.canonicalized(idiom, plain)[2] == "raw_code_mismatch"
    assert program.canonicalized(idiom.replace("int f", "float f"))[2] == "rewrite_unparsable" and program.canonicalized(idiom.replace("return a;", "while (a < 3) { a++; } return a;"))[2] == "rewrite_loop_count"


def test_text_columns_agree_with_programs(spark):
    rows = [(k, v, *program.first_loop(v)) for k, v in LOOPS.items()] + [("c", "/* note */ /*@ requires n > 0x1F; requires\n a; ensures b; */ int f(int n) { return unknown3() + 0x1 + 77; } // z", "", "")]
    d = spark.createDataFrame([(*r, program.conditions(r[3], "if")) for r in rows], "k string, s string, guard string, body string, conditions array<string>")
    for r in d.select("*", tx.tokens(F.col("s")).alias("t"), tx.alpha_normalized(F.col("s"), True).alias("a"), tx.control_profile(F.col("guard"), F.col("body"), F.col("conditions")).alias("p")).collect():
        assert list(r.t) == program.tokens(r.s) and r.a.split(" ") == program.alpha(program.tokens(r.s), True)
        assert r.k == "c" or tuple(r.p) == program.coarse_profile(r.s)
    last = " ".join(program.alpha(program.tokens(rows[-1][1]), True))
    assert last == "requires v0 > NUM ; requires v1 ; int v2 ( int v0 ) { return NONDET ( ) + 0x1 + NUM ; }"


def test_bounds_in_brackets(spark):
    cases = {"((k >= -4))": ("k", "lower", -4), "(7 > k)": ("k", "upper", 6), "k < +3;": ("k", "upper", 2), "(k) >= 3": None, "(k >= 3": None, "k >= 3)": None, "k == 3": None, "k > m": None, "3 < 4": None, "(k > 2) ": ("k", "lower", 3), "k > 2 && k": None, "": None}
    d = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.b and tuple(r.b) for r in d.select("c", tx.constant_bound(F.col("c")).alias("b")).collect()} == cases


def chosen_by_hand(items, demand, total, cap):
    """Quota selection, item by item: items are (id, cell, shape, priority)."""
    cells, used, picked = list(dict.fromkeys(i[1] for i in items)), {}, {}
    pools = {c: {} for c in cells}
    for i in sorted(items, key=lambda i: (-i[3], i[0])):
        pools[i[1]].setdefault(i[2], []).append(i)
    order = {c: sorted(p, key=lambda s: (-p[s][0][3], s)) for c, p in pools.items()}
    live, left = [c for c in cells if demand.get(c)], total
    for _ in range(8):
        if not live or left <= 0:
            break
        all_ = sum(demand[c] for c in live)
        want, got = {c: max(1, round(left * demand[c] / all_)) for c in live}, {}
        for c in want:
            got[c], moved = 0, True
            while got[c] < want[c] and moved:
                moved = False
                for s in order[c]:
                    if got[c] < want[c] and pools[c][s] and used.get(s, 0) < cap:
                        picked.setdefault(c, []).append(pools[c][s].pop(0)[0])
                        used[s], got[c], moved = used.get(s, 0) + 1, got[c] + 1, True
        left -= sum(got.values())
        live = [c for c in live if got[c] >= want[c]]
        if not sum(got.values()):
            break
    return sorted([i for c in cells for i in picked.get(c, [])][:total])


def test_quota_select_item_by_item(spark):
    rng = random.Random(9)
    for trial in range(4):
        items = [(i, rng.choice("abc"), rng.choice(["s", "t", "u", "v"]), float(rng.randint(0, 3))) for i in range(60)]
        demand = {"a": 5, "b": rng.randint(1, 9), "z": 3} | ({"c": 1} if trial % 2 else {})
        pool = spark.createDataFrame(items, "id int, cell string, shape string, p double").repartition(3)
        want = spark.createDataFrame([(c,) for c, n in demand.items() for _ in range(n)], "cell string")
        total, cap = rng.choice([7, 20, 40]), rng.choice([3, 8, 30])
        got = greedy.quota_select(pool, want, "cell", "shape", "id", total, cap, F.col("p"))
        assert sorted(r.id for r in got.collect()) == chosen_by_hand(items, demand, total, cap)


def test_levels_with_feedback(spark):
    rng = random.Random(3)
    items = [{"id": i, "x": rng.choice("abcdefgh"), "y": rng.choice("klmnopqr")} for i in range(40)] + [{"id": 50, "x": "n1", "y": "n2"}]
    got = greedy.first_at_levels(spark.createDataFrame(items), ["x", "y"], "id")
    assert sorted(r.id for r in got.collect()) == [i["id"] for i in greedy.levels_first(items, ["x", "y"])]


def test_append_keeps_the_first(spark):
    base, more = spark.createDataFrame([("a", 1)], "k string, n int"), spark.createDataFrame([("b", 9), ("b", 2), ("a", 0), ("c", 5)], "k string, n int")
    assert sorted(map(tuple, dedup.append_new(base, more.repartition(3), F.col("k"), ["n"]).collect())) == [("a", 1), ("b", 2), ("c", 5)]


def test_gates_and_tags_of_programs(spark):
    schema = "name string, duplicate string, there boolean, version int, scorable boolean, error string, traces int, relation int, capped boolean, related string, cell boolean, difficulty string, nonlinear boolean, n_pre_vars int"
    ok = ("ok", None, True, 9, True, None, 50, 20, False, "skeleton", True, None, False, 3)
    of = lambda name, **new: tuple(new.get(c, v) if c != "name" else name for c, v in zip([x.split()[0] for x in schema.split(", ")], ok, strict=True))
    rows = [
        ok, of("copy", duplicate="alpha"), of("none", there=None, version=None, scorable=None, traces=None, relation=None), of("few", traces=5, relation=4), of("no_signal", relation=0), of("bounds", traces=100, relation=5), of("easy", difficulty="too_easy"),
        of("hard", difficulty="too_hard", nonlinear=True, n_pre_vars=5), of("stale", version=8), of("memory", scorable=False, error="MemoryError: ", traces=0), of("broken", scorable=False, error="x"), of("zero", traces=0, relation=0), of("far", cell=False, related=None), of("capped", capped=True),
    ]
    c = {x.split()[0]: F.col(x.split()[0]) for x in schema.split(", ")}
    gates = curation.program_gates(c["duplicate"], c["there"], c["version"], c["scorable"], c["traces"], c["relation"], c["related"], c["cell"], c["difficulty"], 9, 8, 4, 0.1)
    tags = curation.program_tags(c["there"], c["version"], c["scorable"], c["error"], c["traces"], c["capped"], c["nonlinear"], c["n_pre_vars"], 9)
    got = {r.name: (list(r.g), list(r.t)) for r in spark.createDataFrame(rows, schema).select("name", gates.alias("g"), tags.alias("t")).collect()}
    assert got == {
        "ok": ([], []), "copy": (["duplicate_of_eval"], []), "none": (["unscorable"], ["ledger_missing"]), "few": (["too_few_traces"], []), "no_signal": (["no_relation_signal"], []), "bounds": (["bounds_saturated"], []),
        "easy": (["too_easy"], []), "hard": (["too_hard"], ["hard_structure"]), "stale": (["unscorable"], ["ledger_stale"]), "memory": (["unscorable"], ["sampler_memory"]), "broken": (["unscorable"], ["sampler_error"]),
        "zero": (["unscorable"], ["zero_negatives"]), "far": (["unrelated_to_eval"], []), "capped": ([], ["capped"]),
    }


def test_relatedness_strength_and_retries(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [one(curation.relatedness(F.lit(v).cast("string"), F.lit(s))) for v, s in (("skeleton_ops", 0.5), ("skeleton", 0.0), ("coarse", 1.0), (None, 0.25), ("coarse", 0.33333))] == [0.95, 0.75, 1.0, 0.25, 0.6667]
    rows = [("sat", "unsat", "sat"), ("sat", "unsat", "unsat"), ("sat", "sat", "unsat"), ("sat", "sat", "sat"), ("unsat", "sat", "sat"), ("unknown", "sat", "sat"), ("sat", "timeout", "unsat"), (None, None, None)]
    got = [r.v for r in spark.createDataFrame(rows, "a string, b string, c string").select(ledger.strength(F.col("a"), F.col("b"), F.col("c")).alias("v")).collect()]
    assert got == ["strictly_stronger", "target_equivalent", "strictly_weaker", "incomparable", "invariant_target_context_unsatisfiable", "unknown_nonvacuity", "unknown_implication", "unknown_nonvacuity"]
    logs = [("failed", "x HTTP/1.1 503 y", True), ("failed", "apitimeouterror", True), ("ok", "RateLimitError", False), ("failed", "HTTP/1.1 404", False), ("failed", None, False)]
    assert [r.v for r in spark.createDataFrame(logs, "s string, l string, w boolean").select(ledger.retryable(F.col("s"), F.col("l")).alias("v")).collect()] == [x[2] for x in logs]


def test_joins_of_ledgers(spark):
    a, b = spark.createDataFrame([("t", 0, 5), ("t", 1, 6), ("u", 0, 7), ("u", 0, 7)], "k string, pos int, a int"), spark.createDataFrame([("t", 0, 1), ("t", 1, 2)], "k string, pos int, b int")
    assert [r.k for r in ledger.missing_keys(a, b, ["k"]).collect()] == ["u"] and [d.count() for d in ledger.common_tasks(a, b, ["k"])] == [2, 2]
    assert sorted(map(tuple, ledger.zipped(a.where("k = 't'"), b, ["k"], "pos").collect())) == [("t", 0, 5, 1), ("t", 1, 6, 2)]
    with pytest.raises(Exception, match="lengths differ"):
        ledger.zipped(a, b, ["k"], "pos").collect()
    one, two = spark.createDataFrame([("t", None), ("u", "x")], "k string, v string"), spark.createDataFrame([("t", "y"), ("u", "z")], "k string, v string")
    assert {r.k: r.v for r in ledger.enriched(a.select("k").distinct(), [one, two], ["k"], "v").collect()} == {"t": "y", "u": "x"}
    l = spark.createDataFrame([("t", ["p", "q"], True, None), ("t", ["r"], None, True), ("t", ["r"], True, True), ("t", ["s"], False, None), ("t", [], True, True)], "k string, c array<string>, x boolean, y boolean")
    assert [(r.place, list(r.clauses)) for r in ledger.discovered(l, ["k"], "c", [F.col("x"), F.col("y")]).orderBy("place").collect()] == [(1, ["r"]), (2, ["p", "q"])]
    t = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 9.0), (3, 2.0, 9.0)], "row int, m double, n double")
    assert {r.metric: (r.row, r.value) for r in ledger.column_maxima(t, "row", ["m", "n"]).collect()} == {"m": (1, 3.0), "n": (2, 9.0)}


def test_a_failing_group_is_left_out_and_counted(spark, tmp_path):
    def broken(scope, clauses, states):
        if "boom" in clauses:
            raise RuntimeError("no prover")
        return clauses

    g = spark.createDataFrame([("a", SCOPE, ['["x == 0"]']), ("b", SCOPE, ['["boom"]']), ("c", "{", ['["x > 0"]'])], "group_id string, scope string, rollouts array<string>")
    pos, neg = states(spark, [("a", {"x": 0})]), states(spark, [("a", 0, {"x": 1}), ("b", 0, {"x": 1})])
    got = score_file(g, pos, neg, f"{tmp_path}/rows.parquet", stage=broken)
    assert got == {"batches": 3, "failed": 2, "rows": 1}
    rows = spark.read.parquet(f"{tmp_path}/rows.parquet")
    assert sorted(rows.columns) == sorted(f.split(" ")[0] for f in REWARD.split(", ")) and (rows.first().group_id, rows.first().n_positives, rows.first().negative_sampler) == ("a", 1, "structured")
    assert {r.group_id: r.error.split(":")[0] for r in failures(g, pos, stage=broken).collect()} == {"b": "RuntimeError", "c": "JSONDecodeError"}


def test_scrubbing_by_line():
    complain = lambda scope, cs: next((f"x.c:{10 + i}: bad" for i, c in enumerate(cs) if "bad" in c), None)
    assert filters.scrub_stage(complain, 10)(None, ["a", "bad1", "b", "bad2"], []) == ["a", "b"]
    vague = lambda scope, cs: "unknown fault" if any("bad" in c for c in cs) else None
    assert filters.scrub_stage(vague)(None, ["a", "bad1", "b"], []) == ["a", "b"] and filters.error_lines("a.c:7: x\nline 9, a.c:7:") == [7, 9]
