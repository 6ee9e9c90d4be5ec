"""Values of clauses at states (P5-P7), for clauses that are data (Python integers, exact) and for known ones (Columns).

A clause is null as a whole if it cannot be read, if a name anywhere in it has no value, or if the part that is
evaluated divides by zero; `&&`, `||` and `==>` evaluate no more than they need, left to right.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .syntax import ParseError, names, parse

_SHIFT_LIMIT = 4096


def c_div(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def _binary(op: str, a: int, b: int) -> int:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return c_div(a, b)
    if op == "%":
        return a - c_div(a, b) * b
    if op in ("<<", ">>"):
        if not 0 <= b <= _SHIFT_LIMIT:
            raise ValueError("shift")
        return a << b if op == "<<" else a >> b
    return {"&": a & b, "|": a | b, "^": a ^ b}[op]


def _compare(op: str, a: int, b: int) -> bool:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]


def _value(t: tuple, env: dict[tuple[str, str], int]):
    kind = t[0]
    if kind in ("num", "bool"):
        return t[1]
    if kind in ("var", "pre", "entry"):
        return env[t]
    if kind == "bin":
        return _binary(t[1], _value(t[2], env), _value(t[3], env))
    if kind == "neg":
        return -_value(t[1], env)
    if kind == "cmp":
        a = _value(t[1], env)
        for op, x in t[2]:
            b = _value(x, env)
            if not _compare(op, a, b):
                return False
            a = b
        return True
    if kind == "not":
        return not _value(t[1], env)
    if kind == "and":
        return all(_value(x, env) for x in t[1])
    if kind == "or":
        return any(_value(x, env) for x in t[1])
    if kind == "imp":
        return not _value(t[1], env) or bool(_value(t[2], env))
    if kind == "iff":
        return bool(_value(t[1], env)) == bool(_value(t[2], env))
    if kind == "call" and t[1] == "abs" and len(t[2]) == 1:
        return abs(_value(t[2][0], env))
    raise ValueError(kind)


def evaluate(clause: str | None, variables: dict[str, int], pre: dict[str, int] | None = None, entry: dict[str, int] | None = None) -> bool | None:
    """P6."""
    if clause is None or not clause.strip():
        return None
    try:
        tree = parse(clause)
    except ParseError:
        return None
    known = {"var": variables or {}, "pre": pre or {}, "entry": entry or {}}
    env = {}
    for kind, name in names(tree):
        value = known[kind].get(name)
        if value is None:
            return None
        env[kind, name] = int(value)
    try:
        return bool(_value(tree, env))
    except (ArithmeticError, ValueError, KeyError, RecursionError):
        return None


def number(term: tuple, variables: dict[str, int]) -> int | None:
    """The number that a term gives, or null."""
    try:
        value = _value(term, {("var", k): v for k, v in variables.items()})
    except (ArithmeticError, ValueError, KeyError, RecursionError):
        return None
    return None if isinstance(value, bool) else value


def first_falsifying(clause: str, states: Iterable[dict]) -> int | None:
    """Position of the first state (vars, pre, loop_entry) that falsifies the clause; none if one before it has no value.

    A name that any state lacks leaves the clause standing, whatever the others say.
    """
    states = list(states)
    try:
        needed = names(parse(clause))
    except ParseError:
        return None
    maps = {"var": "vars", "pre": "pre", "entry": "loop_entry"}
    if any((s.get(maps[k]) or {}).get(n) is None for s in states for k, n in needed):
        return None
    for i, s in enumerate(states):
        value = evaluate(clause, s.get("vars"), s.get("pre"), s.get("loop_entry"))
        if value is None:
            return None
        if not value:
            return i
    return None


_WIDE = "decimal(38,0)"


def to_column(clause: str, variables: dict[str, Column], pre: dict[str, Column] | None = None, entry: dict[str, Column] | None = None) -> Column:
    """P6 as a Column, for a clause that is known when the plan is made. Arithmetic is in decimals of 38 digits; beyond, null."""
    try:
        tree = parse(clause)
    except ParseError:
        return F.lit(None).cast("boolean")
    known = {"var": variables, "pre": pre or {}, "entry": entry or {}}
    needed = names(tree)
    if any(n not in known[k] for k, n in needed):
        return F.lit(None).cast("boolean")
    bound = F.lit(True)
    for k, n in sorted(needed):
        bound = bound & known[k][n].isNotNull()
    return F.when(bound, _truth(tree, known))


def _number(t: tuple, known: dict) -> Column:
    kind = t[0]
    if kind == "num":
        return F.lit(str(t[1])).cast(_WIDE)
    if kind in ("var", "pre", "entry"):
        return known[kind][t[1]].cast(_WIDE)
    if kind == "neg":
        return F.try_subtract(F.lit(0).cast(_WIDE), _number(t[1], known))
    if kind == "call" and t[1] == "abs" and len(t[2]) == 1:
        return F.abs(_number(t[2][0], known))
    if kind == "bin":
        a, b = _number(t[2], known), _number(t[3], known)
        if t[1] in "+-*":
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[t[1]](a, b).cast(_WIDE)
        rest = F.try_mod(a, b).cast(_WIDE)  # has the sign of a, as in C
        if t[1] == "%":
            return rest
        if t[1] == "/":
            return F.try_divide(F.try_subtract(a, rest), b).cast(_WIDE)
        n = b.cast("int")
        power = F.when((n >= 0) & (n <= 62), F.shiftleft(F.lit(1).cast("long"), n)).cast(_WIDE)
        if t[1] == "<<":
            return F.try_multiply(a, power).cast(_WIDE)
        if t[1] == ">>":
            return F.floor(F.try_divide(a, power)).cast(_WIDE)
    if kind in ("cmp", "and", "or", "not", "imp", "iff", "bool"):
        return _truth(t, known).cast("int").cast(_WIDE)
    return F.lit(None).cast(_WIDE)


def _truth(t: tuple, known: dict) -> Column:
    """Null stands for an error; logic passes it on unless an earlier part decides."""
    kind = t[0]
    if kind == "bool":
        return F.lit(t[1])
    if kind == "not":
        return ~_truth(t[1], known)
    if kind in ("and", "or"):
        stop = kind == "or"
        out = _truth(t[1][-1], known)
        for x in reversed(t[1][:-1]):
            v = _truth(x, known)
            out = F.when(v.isNull(), F.lit(None).cast("boolean")).when(v == stop, F.lit(stop)).otherwise(out)
        return out
    if kind == "imp":
        return _truth(("or", (("not", t[1]), t[2])), known)
    if kind == "iff":
        return _truth(t[1], known) == _truth(t[2], known)
    if kind == "cmp":
        ops = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__", "==": "__eq__", "!=": "__ne__"}
        side = [_number(t[1], known), *(_number(x, known) for _, x in t[2])]
        parts = [getattr(side[i], ops[op])(side[i + 1]) for i, (op, _) in enumerate(t[2])]
        out = parts[-1]
        for p in reversed(parts[:-1]):
            out = F.when(p.isNull(), F.lit(None).cast("boolean")).when(~p, F.lit(False)).otherwise(out)
        return out
    return _number(t, known) != 0
