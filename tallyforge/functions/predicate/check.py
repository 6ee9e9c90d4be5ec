"""Syntax, types and scope of clauses.

A clause is read as lexemes, which show what clauses must not hold, and then as a tree, whose nodes each have a sort
(int or bool) by their kind and demand sorts of their operands. Of several faults the one of the earliest kind in
FAULTS counts. The reasons are fixed values that ledgers store.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from .syntax import ParseError, children, normalize, parse

#: What lexemes show, most severe first.
FAULTS = ("comment", "forbidden_token", "forbidden_acsl_command", "type_cast", "pre_requires_parameter", "loopentry_requires_unknown_local", "invalid_at", "function_call")
LEXEME = re.compile(r"(?P<comment>/\*|\*/|//)|(?P<label>\\at\s*\(\s*(?P<name>[A-Za-z_]\w*)\s*,\s*(?P<where>Pre|LoopEntry)\s*\))|(?P<command>\\[A-Za-z_]*)|(?P<word>[A-Za-z_]\w*)|(?P<other>\S)")
FORBIDDEN = frozenset("?:^;")
CAST_WORDS = frozenset(("char", "short", "int", "long", "long long", "integer", "real"))
BOOLEAN = frozenset(("bool", "not", "and", "or", "imp", "iff", "cmp"))
#: Node -> the sort it demands of its operands, and the reason if one is of the other; an implication negates its first.
DEMANDS = {
    "neg": ("int", "arithmetic_on_boolean"), "bin": ("int", "arithmetic_on_boolean"), "not": ("bool", "not_on_integer"), "and": ("bool", "logical_operator_on_integer"),
    "or": ("bool", "logical_operator_on_integer"), "imp": ("bool", "logical_operator_on_integer"), "iff": ("bool", "equivalence_on_integer"),
}


@dataclass(frozen=True)
class Scope:
    """What a clause may name: variables, parameters (\\at Pre), locals set by an unknown call (\\at LoopEntry), constants."""

    variables: frozenset[str] = field(default_factory=frozenset)
    params: frozenset[str] = field(default_factory=frozenset)
    unknown_locals: frozenset[str] = field(default_factory=frozenset)
    constants: frozenset[str] = field(default_factory=frozenset)


def lexical_faults(text: str, scope: Scope) -> Iterator[str]:
    found = list(LEXEME.finditer(text))
    for k, m in enumerate(found):
        after = found[k + 1][0] if k + 1 < len(found) else ""
        if m["comment"]:
            yield "comment"
        elif m["label"] and m["where"] == "Pre" and m["name"] not in scope.params:
            yield "pre_requires_parameter"
        elif m["label"] and m["where"] == "LoopEntry" and m["name"] not in scope.unknown_locals:
            yield "loopentry_requires_unknown_local"
        elif m["command"]:
            yield "invalid_at" if m[0] in ("\\", "\\at") else "forbidden_acsl_command"
        elif m["word"] and after == "(":
            yield "function_call"
        elif m[0] in FORBIDDEN:
            yield "forbidden_token"
        elif m[0] == "(" and _is_cast(found, k + 1):
            yield "type_cast"


def _is_cast(found: list[re.Match], at: int) -> bool:
    """Do the lexemes from `at` on name a type and end in a bracket?"""
    end = next((k for k in range(at, len(found)) if not found[k]["word"]), len(found))
    words = [m[0] for m in found[at:end]]
    if words and words[0] in ("unsigned", "signed"):
        words = words[1:]
    return end < len(found) and found[end][0] == ")" and " ".join(words) in CAST_WORDS


def sort_of(tree: tuple) -> str:
    return "bool" if tree[0] in BOOLEAN else "int"


def sort_faults(tree: tuple, scope: Scope) -> Iterator[str]:
    """Faults of a tree in the order of reading."""
    kind = tree[0]
    if kind == "call":
        yield "function_call"
    elif kind == "var" and tree[1] not in scope.variables | scope.constants:
        yield "out_of_scope"
    elif kind == "bin" and tree[1] in "&|^":
        yield "unsupported_arithmetic_operator"
    operands = children(tree)
    for n, x in enumerate(operands):
        yield from sort_faults(x, scope)
        if kind == "cmp" and n:
            sorts = {sort_of(operands[n - 1]), sort_of(x)}
            if tree[2][n - 1][0] in ("==", "!="):
                if len(sorts) > 1:
                    yield "comparison_sort_mismatch"
            elif "bool" in sorts:
                yield "ordered_comparison_on_boolean"
        elif kind in DEMANDS and sort_of(x) != DEMANDS[kind][0]:
            yield DEMANDS["not" if kind == "imp" and n == 0 else kind][1]


def check(clause: str, scope: Scope) -> str:
    """The reason why a clause is rejected, or the empty string."""
    text = normalize(clause)
    if not text:
        return "empty"
    if faults := set(lexical_faults(text, scope)):
        return min(faults, key=FAULTS.index)
    try:
        tree = parse(text)
    except ParseError:
        return "parse_error"
    return next(sort_faults(tree, scope), "" if sort_of(tree) == "bool" else "not_a_proposition")


def syntax_filter(clauses: list[str], scope: Scope) -> tuple[list[str], list[tuple[str, str]]]:
    """Clauses that pass, normalized, and those dropped, with the reason."""
    judged = [(s, check(s, scope)) for s in map(normalize, clauses)]
    return [s for s, reason in judged if not reason], [(s, reason) for s, reason in judged if reason]
