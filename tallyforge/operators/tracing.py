"""Sampling of states from programs (S1-S4, S7, S17-S19, S23): one program is one row, worked on in one Arrow function."""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import interpret
from ..functions.predicate import evaluate
from ..functions.predicate.evaluate import number
from ..functions.program import Program, determinized, parse_program, strip_target
from .sampling import TOTAL

SALT = 0x4C4F4F50
STATES = "digest string, run int, it int, guard boolean, vars map<string,bigint>, pre map<string,bigint>, loop_entry map<string,bigint>, capped boolean, error string"


def param_bounds(requires: str, params: list[str]) -> dict[str, tuple[int | None, int | None]]:
    """Literal bounds of parameters in the conjuncts of requires; negated and disjoined parts bound nothing."""
    from ..functions.predicate.syntax import ParseError, parse

    low: dict[str, int] = {}
    high: dict[str, int] = {}

    def bound(name: str, op: str, n: int) -> None:
        if op in (">", ">=", "=="):
            low[name] = max(low.get(name, n), n + (op == ">"))
        if op in ("<", "<=", "=="):
            high[name] = min(high.get(name, 1 << 31), n - (op == "<"))

    def walk(t: tuple) -> None:
        if t[0] == "and":
            for x in t[1]:
                walk(x)
        if t[0] == "cmp":
            side = t[1]
            for op, other in t[2]:
                value = lambda x: x[1] if x[0] == "num" else -x[1][1] if x[0] == "neg" and x[1][0] == "num" else None
                if side[0] == "var" and value(other) is not None:
                    bound(side[1], op, value(other))
                if other[0] == "var" and value(side) is not None:
                    bound(other[1], op.translate(str.maketrans("<>", "><")), value(side))
                side = other

    try:
        walk(parse(requires))
    except ParseError:
        pass
    return {p: (low.get(p), high.get(p)) for p in params}


def equalities(requires: str, params: list[str]) -> list[tuple[str, tuple]]:
    """(parameter, the term it equals) of the conjuncts of requires."""
    from ..functions.predicate.syntax import ParseError, parse

    out: list[tuple[str, tuple]] = []

    def walk(t: tuple) -> None:
        if t[0] == "and":
            for x in t[1]:
                walk(x)
        if t[0] == "cmp" and len(t[2]) == 1 and t[2][0][0] == "==":
            left, right = t[1], t[2][0][1]
            if left[0] == "var" and left[1] in params:
                out.append((left[1], right))
            elif right[0] == "var" and right[1] in params:
                out.append((right[1], left))

    try:
        walk(parse(requires))
    except ParseError:
        pass
    return out


def propagated(equal: list[tuple[str, tuple]], start: dict[str, int], bounds: dict[str, tuple[int | None, int | None]]) -> dict[str, int]:
    """Start with values carried along equalities, last ones first, until nothing changes or the rounds are used up."""
    values = dict(start)
    for _ in range(max(2, 2 * len(equal))):
        before = dict(values)
        for name, term in reversed(equal):
            value, (low, high) = number(term, values), bounds[name]
            if value is not None and (low is None or value >= low) and (high is None or value <= high):
                values[name] = value
        if values == before:
            break
    return values


def sample_inputs(program: Program, n_runs: int, seed: int = 0) -> list[dict[str, int]]:
    """Inputs in a fixed order: far probes, a stripe of tiers, a grid whose fastest digit rotates over the parameters, neighbours of
    literals, literals of requires with offsets on parameters and ordered pairs, values carried along equalities, seeded draws; each holds the whole of requires, once.
    None at all is an error."""
    bounds = param_bounds(program.requires, program.params)
    rng = random.Random(seed)
    tiers = (0, 1, 2, 3, 5, 8, 10, 16, 32, 64, 100)

    def fit(p: str, n: int) -> int:
        low, high = bounds[p]
        n = n if low is None else max(n, low)
        return n if high is None else min(n, high)

    def near(p: str) -> list[int]:
        low, high = bounds[p]
        at = low if low is not None else (high if high is not None else 0)
        return [at, at + 1, at + 2, at + 7, -1 if low is None else at + 13]

    literals = sorted({int(x) for x in re.findall(r"\b\d{1,6}\b", program.source)})
    required = sorted({int(x) for x in re.findall(r"(?<![A-Za-z_])-?\d+", program.requires)})
    digits = {p: [*near(p), *(fit(p, t) for t in tiers)] for p in program.params}

    def grid(r: int, rotation: int) -> dict[str, int]:
        ps, n = program.params, len(tiers) + 5
        return {p: digits[p][r // n ** ((j - rotation) % len(ps)) % n] for j, p in enumerate(ps)}

    equal = equalities(program.requires, program.params)

    def proposals() -> Iterator[tuple[int, ...]]:
        ps = program.params
        for n in (1 << 10, 1 << 16):
            yield tuple(fit(p, n) for p in ps)
        for t in tiers:
            yield tuple(fit(p, t) for p in ps)
        for i in range(max(400 * n_runs, 4000) if ps else 0):
            yield tuple(grid(i // len(ps), i % len(ps)).values())
        for n in literals:
            for d in (-1, 0, 1):
                for p in ps:
                    yield tuple(fit(q, n + d if q == p else tiers[2]) for q in ps)
        for n in required:
            for i, d in enumerate(tiers):
                base = {p: fit(p, tiers[(i + j) % len(tiers)]) for j, p in enumerate(ps)}
                for p in ps:
                    yield tuple({**base, p: fit(p, n + d)}.values())
                for p, q in itertools.permutations(ps, 2):
                    yield tuple({**base, p: fit(p, n + d), q: fit(q, d)}.values())
        for i in range(max(24, 8 * len(ps)) if equal else 0):
            yield tuple(propagated(equal, grid(i, i % len(ps)), bounds).values())
        for _ in range(20 * n_runs):
            yield tuple(fit(p, rng.randint(-50, 200)) for p in ps)

    out: dict[tuple[int, ...], dict[str, int]] = {}
    for values in proposals():
        inputs = dict(zip(program.params, values, strict=True))
        if values not in out and (not program.requires or evaluate(program.requires, inputs, inputs) is True):
            out[values] = inputs
            if len(out) >= n_runs or not program.params:
                break
    if not out:
        raise ValueError(f"no input satisfies requires: {program.requires}")
    return list(out.values())


def collect(programs: DataFrame, n_runs: int = 16, seed: int = 0, source: str = "source") -> DataFrame:
    """Rows of STATES for each distinct source. The target is stripped and unknown calls become inputs first. A failing source gives one row with its error."""
    from pyspark.sql import functions as F

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for digest, text in zip(pdf["digest"], pdf["source"], strict=True):
                try:
                    p = parse_program(determinized(strip_target(text))[0])
                    if not p.loops:
                        raise ValueError("no loop")
                    for k, inputs in enumerate(sample_inputs(p, n_runs, seed)):
                        states, capped, why = interpret.trace(p, inputs)
                        if not why or capped:
                            rows += [(digest, k, s["it"], s["guard"], s["vars"], s["pre"], s["loop_entry"], capped, None) for s in states]
                except (ValueError, KeyError, RecursionError) as e:
                    rows.append((digest, None, None, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["digest", "run", "it", "guard", "vars", "pre", "loop_entry", "capped", "error"]).astype({"run": "Int32", "it": "Int32"})

    d = programs.select(F.sha2(source, 256).alias("digest"), F.col(source).alias("source")).dropDuplicates(["digest"])
    return d.mapInPandas(run, STATES)


def base_positions(sizes: list[int], most: int = 96) -> list[list[int]]:
    """Positions taken from each stratum: quotas by turns, then half a dense start, the last, and an even spread between."""
    quota, left = [0] * len(sizes), most
    while left and any(q < s for q, s in zip(quota, sizes, strict=True)):
        for i, s in enumerate(sizes):
            if left and quota[i] < s:
                quota[i] += 1
                left -= 1
    out = []
    for q, n in zip(quota, sizes, strict=True):
        if q >= n or q < 3:
            out.append(list(range(min(q, n))))
            continue
        dense = q // 2
        rest = [dense + (i + 1) * (n - 1 - dense) // (q - dense) for i in range(q - dense)]
        out.append(sorted({*range(dense), *rest, n - 1})[:q] if n - 1 in rest else [*range(dense), *rest[:-1], n - 1])
    return out


def random_fill(bases: list[dict[str, int]], taken: set[tuple], limit: int, seed: int) -> list[dict[str, int]]:
    """Seeded changes of base states, small ones first, that are no state yet; at most max(1024, 100 * limit) tries."""
    rng, out, seen = random.Random(seed ^ SALT), [], set(taken)
    tries = max(1024, 100 * limit)
    if not bases:
        return out
    for i in range(tries):
        if len(out) >= limit:
            break
        low, high = (1, 34) if i < tries // 2 else (35, 128)
        s = dict(rng.choice(bases))
        if not s:
            continue
        v = rng.choice(sorted(s))
        s[v] += rng.choice((-1, 1)) * rng.randint(low, high)
        key = tuple(sorted(s.items()))
        if key not in seen:
            seen.add(key)
            out.append(s)
    return out


def budget(relation: int, escape: int, total: int = TOTAL) -> int:
    """What is left for the random family."""
    return max(0, total - relation - escape)


def hard_groups(rejects: list[frozenset[int]], most: int) -> list[int]:
    """Groups chosen one by one: most clauses newly exposed, then a signature not seen yet, then an even split, then few rejecting clauses, then the first."""
    exposed: set[int] = set()
    signatures: set[frozenset[int]] = set()
    chosen: list[int] = []
    n = len(frozenset().union(*rejects)) if rejects else 0
    while len(chosen) < min(most, len(rejects)):
        best = max((i for i in range(len(rejects)) if i not in chosen), key=lambda i: (len(rejects[i] - exposed), rejects[i] not in signatures, -abs(2 * len(rejects[i]) - n), -len(rejects[i]), -i))
        chosen.append(best)
        exposed |= rejects[best]
        signatures.add(rejects[best])
    return chosen
