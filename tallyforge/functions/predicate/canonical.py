"""Canonical keys of clauses (P13, P14): rewrites that hold for all integers, nothing algebraic."""

from __future__ import annotations

from .syntax import ParseError, normalize, parse


class _Beyond(ValueError):
    """The clause is outside of what keys cover; its text is its key then."""


_FLIP = {"lt": ("le", True), "le": ("lt", True), "eq": ("ne", False), "ne": ("eq", False)}
_NAMES = {"/": "div", "%": "mod", "<<": "lshift", ">>": "rshift"}


def _sorted(x: tuple, y: tuple) -> tuple[tuple, tuple]:
    return (y, x) if repr(y) < repr(x) else (x, y)


def _compare(op: str, x: tuple, y: tuple) -> tuple:
    if op in (">", ">="):
        op, x, y = "<" + op[1:], y, x
    if op in ("==", "!="):
        x, y = _sorted(x, y)
    return ("cmp", {"<": "lt", "<=": "le", "==": "eq", "!=": "ne"}[op], x, y)


def _negate(key: tuple) -> tuple:
    if key[0] == "not":
        return key[1]
    if key[0] == "cmp":
        op, swap = _FLIP[key[1]]
        return ("cmp", op, key[3], key[2]) if swap else ("cmp", op, key[2], key[3])
    return ("not", key)


def _join(kind: str, keys: list[tuple]) -> tuple:
    """Nested ones of the same kind flattened, repeats dropped, order kept."""
    flat: list[tuple] = []
    for k in keys:
        for x in k[1] if k[0] == kind else (k,):
            if x not in flat:
                flat.append(x)
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _key(t: tuple) -> tuple:
    kind = t[0]
    if kind in ("num", "bool", "var", "pre", "entry"):
        return t
    if kind == "not":
        return _negate(_key(t[1]))
    if kind == "neg":
        return ("neg", _key(t[1]))
    if kind in ("and", "or"):
        return _join(kind, [_key(x) for x in t[1]])
    if kind == "imp":
        return _join("or", [_negate(_key(t[1])), _key(t[2])])
    if kind == "iff":
        return _compare("==", _key(t[1]), _key(t[2]))
    if kind == "cmp":
        out, x = [], _key(t[1])
        for op, y in t[2]:
            y = _key(y)
            out.append(_compare(op, x, y))
            x = y
        return out[0] if len(out) == 1 else ("and", tuple(out))
    if kind == "bin":
        op, x, y = t[1], _key(t[2]), _key(t[3])
        neutral = {"+": ("num", 0), "*": ("num", 1)}.get(op)
        if neutral is not None:
            if neutral in (x, y):
                return y if x == neutral else x
            return ("add" if op == "+" else "mul", *_sorted(x, y))
        if op == "-":
            return x if y == ("num", 0) else ("sub", x, y)
        if op in _NAMES:
            return (_NAMES[op], x, y)
    raise _Beyond(kind)


def dedup_key(clause: str) -> tuple:
    """Equal keys mean equal clauses; what cannot be read is its own text."""
    s = normalize(clause)
    if not s:
        return ("raw", "")
    try:
        return ("key", _key(parse(s)))
    except (ParseError, _Beyond, RecursionError):
        return ("raw", s)


def key_text(clause: str) -> str:
    return repr(dedup_key(clause))


def dedup_normalized(clauses: list[str]) -> list[str]:
    """The first spelling of each key, normalized; empty clauses go."""
    seen: dict[tuple, str] = {}
    for c in clauses:
        if s := normalize(c):
            seen.setdefault(dedup_key(s), s)
    return list(seen.values())
