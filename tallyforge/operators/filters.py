"""Clause filters (W1-W9): what a stage is, the stages that run here, the cascade, and how survivors are credited."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import Scope, check, dedup_key, dedup_normalized, evaluate, first_falsifying, key_text, normalize

#: A stage takes (scope, clauses, positive states) and gives the clauses that stay.
Stage = Callable[[Scope, list[str], list[dict]], list[str]]
MAX_ROUNDS = 500


def syntax_stage(scope: Scope, clauses: list[str], states: list[dict]) -> list[str]:
    return [normalize(c) for c in clauses if not check(c, scope)]


def dedup_stage(scope: Scope, clauses: list[str], states: list[dict]) -> list[str]:
    return dedup_normalized(clauses)


def positive_stage(scope: Scope, clauses: list[str], states: list[dict]) -> list[str]:
    """Clauses that no positive state falsifies."""
    return [c for c in clauses if first_falsifying(c, states) is None]


def houdini_stage(prove: Callable[[Scope, list[str]], list[bool]]) -> Stage:
    """Drop what fails until all that is left is proved together; nothing if the prover's answer does not fit."""

    def run(scope: Scope, clauses: list[str], states: list[dict]) -> list[str]:
        for _ in range(MAX_ROUNDS):
            if not clauses:
                return []
            verdicts = prove(scope, clauses)
            if len(verdicts) != len(clauses):
                return []
            if all(verdicts):
                return clauses
            clauses = [c for c, ok in zip(clauses, verdicts, strict=True) if ok]
        return []

    return run


def cascade(*stages: Stage) -> Stage:
    """Cheap stages first; none runs once nothing is left."""

    def run(scope: Scope, clauses: list[str], states: list[dict]) -> list[str]:
        for stage in stages:
            if not clauses:
                break
            clauses = stage(scope, clauses, states)
        return clauses

    return run


#: W2.
lite = cascade(syntax_stage, dedup_stage, positive_stage)


def auto_filter(prove: Callable[[Scope, list[str]], list[bool]] | None = None) -> Stage:
    """With a prover if there is one."""
    return lite if prove is None else cascade(lite, houdini_stage(prove))


def drop_reason(scope: Scope, clauses: list[str], states: list[dict]) -> list[str]:
    """For each clause why the lite cascade drops it; empty for those that stay."""
    seen, out = set(), []
    for c in clauses:
        reason = check(c, scope)
        key = dedup_key(c)
        if not reason and key in seen:
            reason = "duplicate"
        elif not reason:
            seen.add(key)
            reason = "falsified" if first_falsifying(normalize(c), states) is not None else ""
        out.append(reason)
    return out


@functools.lru_cache(maxsize=256)
def scope_of(text: str) -> Scope:
    """A Scope from its JSON."""
    return Scope(**{k: frozenset(v) for k, v in json.loads(text or "{}").items()})


def _plain(states) -> list[dict]:
    as_dict = lambda m: dict(m) if m is not None else {}
    return [{k: as_dict(s[k]) for k in ("vars", "pre", "loop_entry")} for s in (states if states is not None else [])]


def _per_group(groups: DataFrame, judge: Callable[[Scope, list[list[str]], list[dict]], list[list[str]]]) -> DataFrame:
    """Adds survivors, an array a rollout, and filter_error: a group that cannot be judged has no survivors and says why."""

    @F.pandas_udf("survivors array<array<string>>, error string")
    def run(scope: pd.Series, rollouts: pd.Series, states: pd.Series) -> pd.DataFrame:
        out = []
        for sc, rs, st in zip(scope, rollouts, states, strict=True):
            try:
                out.append((judge(scope_of(sc), [list(r) for r in rs], _plain(st)), None))
            except Exception as e:  # noqa: BLE001  whatever a stage raises concerns its group alone
                out.append((None, f"{type(e).__name__}: {e}"[:300]))
        return pd.DataFrame(out, columns=["survivors", "error"])

    judged = groups.withColumn("_judged", run.asNondeterministic()("scope", "clauses", "positives"))
    return judged.select(*groups.columns, "_judged.survivors", F.col("_judged.error").alias("filter_error"))


def pooled(groups: DataFrame, stage: Stage = lite) -> DataFrame:
    """Groups: group_id, scope (JSON), clauses (one array a rollout), positives. Adds survivors and filter_error.

    The distinct clauses of a group are filtered once; each rollout keeps its own spelling of what survives (J5).
    """

    def judge(scope: Scope, rollouts: list[list[str]], states: list[dict]) -> list[list[str]]:
        kept = {dedup_key(c) for c in stage(scope, dedup_normalized([c for r in rollouts for c in r]), states)}
        return [[c for c in dedup_normalized(r) if dedup_key(c) in kept] for r in rollouts]

    return _per_group(groups, judge)


def independent(groups: DataFrame, stage: Stage = lite) -> DataFrame:
    """Each rollout filtered by itself; equal ones once. Adds survivors and filter_error."""

    def judge(scope: Scope, rollouts: list[list[str]], states: list[dict]) -> list[list[str]]:
        known = {r: stage(scope, dedup_normalized(list(r)), states) for r in set(map(tuple, rollouts))}
        return [known[tuple(r)] for r in rollouts]

    return _per_group(groups, judge)


def error_lines(log: str, file: str | None = None) -> list[int]:
    """The lines that a checker's log complains about, each once: `name.c:12: ...` and `line 12`."""
    found = re.findall(r"([\w./-]+\.c):(\d+):|\bline (\d+)\b", log)
    lines = [int(a or b) for name, a, b in found if not name or file is None or name.endswith(file)]
    return list(dict.fromkeys(lines))


def scrub_stage(complain: Callable[[Scope, list[str]], str | None], first_line: int = 1) -> Stage:
    """Drop the clause at the first line that a checker complains about, one a line from first_line on, until it is content; if a complaint names no clause, each clause is tried alone.

    complain takes a scope and clauses and gives a log, or null if all is well.
    """

    def run(scope: Scope, clauses: list[str], states: list[dict]) -> list[str]:
        clauses = list(clauses)
        while clauses and (log := complain(scope, clauses)):
            at = next((n - first_line for n in error_lines(log) if 0 <= n - first_line < len(clauses)), None)
            if at is None:
                return [c for c in clauses if not complain(scope, [c])]
            del clauses[at]
        return clauses

    return run


def verdicts(pairs: DataFrame, clause: str = "clause", state: str = "state", out: str = "verdict") -> DataFrame:
    """P6 on rows that hold a clause and a state; null where it has no value."""

    @F.pandas_udf("boolean")
    def run(it: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for clauses, states in it:
            rows = zip(clauses, states["vars"], states["pre"], states["loop_entry"], strict=True)
            yield pd.Series([evaluate(c, dict(v or {}), dict(p or {}), dict(e or {})) for c, v, p, e in rows], dtype="object")

    return pairs.withColumn(out, run(clause, F.struct(f"{state}.vars", f"{state}.pre", f"{state}.loop_entry")))


def clause_key(c):
    """P13 as a Column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: key_text(x or ""))

    return run(c)


WP_GOAL = r"Goal\s+(Establishment|Preservation) of Invariant[^\n]*?line\s+(\d+)"


def wp_verdicts(reports: DataFrame, text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """(keys, line, proved) from a prover's report: a line is proved if any prover says so for its establishment and for its preservation."""
    keys = keys or []
    block = F.explode(F.split(text, r"\n-{20,}\n")).alias("b")
    b = reports.select(*keys, block).select(*keys, F.regexp_extract("b", WP_GOAL, 1).alias("goal"), F.regexp_extract("b", WP_GOAL, 2).try_cast("int").alias("line"), F.col("b").rlike(r"(?i)returns\s+Valid").alias("valid")).where("goal <> ''")
    g = b.groupBy(*keys, "line", "goal").agg(F.bool_or("valid").alias("valid"))
    both = (F.count("*") == 2) & F.bool_and("valid")
    return g.groupBy(*keys, "line").agg(both.alias("proved"))
