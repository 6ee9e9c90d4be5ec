"""Text functions as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import program

#: Fixed value. What marks a clause in an annotated text: everything up to the next semicolon is the clause.
CLAUSE = r"loop\s+invariant\s+([^;]+);"
TOKEN, IDENTIFIER = program.TOKEN.pattern, r"[A-Za-z_]\w*"
#: Names of unknown calls, and how numbers are written.
NONDET, NUMBER = program.NONDET.pattern, program.NUMBER.pattern
COMMENT = r"(?s)/\*.*?\*/|//[^\n]*"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda's variable is not replaced by what it stands for."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def normalize_clause(c: Column) -> Column:
    """Without the prefix `loop invariant` and a final `;`, white space collapsed."""
    c = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^loop\s+invariant\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r";$", ""), r"\s+", " "))


def extract_clauses(c: Column, most: int | None = None) -> Column:
    """The clauses of an annotated text, in order; the first `most`, if given."""
    if most is not None and most < 0:
        raise ValueError(f"most is {most}, below 0")
    clauses = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CLAUSE), F.lit(1)), collapse_space)
    return clauses if most is None else F.slice(clauses, 1, most)


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalized(c: Column) -> Column:
    """T5: lower case, white space collapsed."""
    return F.lower(collapse_space(c))


def uncommented(c: Column) -> Column:
    """T5: a program without comments; of an annotation block its requires clauses stay."""

    def shown(x: Column) -> Column:
        clauses = F.transform(F.regexp_extract_all(x, F.lit(r"\brequires\b\s*([^;]*);"), F.lit(1)), lambda r: F.concat(F.lit("requires "), r, F.lit(";")))
        return F.when(x.startswith("/*@") & x.rlike(r"\brequires\b"), F.array_join(clauses, " ")).otherwise(" ")

    comments = F.array_append(F.transform(F.regexp_extract_all(c, F.lit(COMMENT), F.lit(0)), shown), F.lit(""))
    return F.array_join(F.flatten(F.zip_with(F.split(c, COMMENT, -1), comments, lambda a, b: F.array(a, b))), "")


def tokens(c: Column) -> Column:
    """T5: operators, identifiers, numbers and single marks of a program without its comments."""
    return F.regexp_extract_all(uncommented(c), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """Words of the normalized text; none for an empty one."""
    n = normalized(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def identifiers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0))


def alpha_normalized(c: Column, constants: bool = False) -> Column:
    """Identifiers other than keywords become v0, v1, ... by first appearance, unknown calls NONDET; with `constants`, numbers but 0 and 1 become NUM."""
    unknown = lambda x: x.rlike(f"^(?:{NONDET})$")
    named = lambda x: x.rlike(f"^{IDENTIFIER}$") & ~x.isin(*sorted(program.KEYWORDS)) & ~unknown(x)
    number = lambda x: x.rlike(f"^(?:{NUMBER})$") & ~x.rlike("^(?:0[xX])?0*[01]$")

    def renamed(t: Column) -> Column:
        def one(x: Column, names: Column) -> Column:
            out = F.when(unknown(x), "NONDET").when(named(x), F.concat(F.lit("v"), (F.array_position(names, x) - 1).cast("string")))
            return (out.when(number(x), F.lit("NUM")) if constants else out).otherwise(x)

        return let(F.array_distinct(F.filter(t, named)), lambda names: F.array_join(F.transform(t, lambda x: one(x, names)), " "))

    # tokens and names are computed once a text, not once a token
    return let(tokens(c), renamed)


def out_of_scope(c: Column, allowed: Column) -> Column:
    """Identifiers of a clause that are not allowed; labels and names bound by a quantifier are."""
    bare = F.regexp_replace(c, r"\\\w+|,\s*(?:Pre|LoopEntry)\b", " ")
    bound = F.regexp_extract_all(c, F.lit(r"\\(?:forall|exists)\s+\w+\s+(\w+)"), F.lit(1))
    kinds = F.array(*[F.lit(x) for x in ("int", "integer", "true", "false")])
    return F.array_distinct(F.array_except(F.array_except(F.array_except(identifiers(bare), allowed), bound), kinds))


def constant_bound(c: Column) -> Column:
    """Struct variable, side (lower or upper), value of a variable compared with a number on either side; null for other clauses.

    The clause is read as lexemes. Brackets may stand around the whole of it, as many at its end as at its start; three
    parts are then left: what stands left of the sign, the sign, and what stands right of it.
    """
    lexemes = F.regexp_extract_all(normalize_clause(c), F.lit(r"[<>]=?|[A-Za-z_]\w*|[+-]?\d+|\S"), F.lit(0))

    def inner(t: Column) -> Column:
        around = F.size(t) - F.size(F.filter(t, lambda x: x != "("))
        closed = F.forall(F.slice(t, 1, around), lambda x: x == "(") & (F.size(t) == 2 * around + 3) & F.forall(F.slice(t, around + 4, around), lambda x: x == ")")
        return F.when(closed, F.slice(t, around + 1, 3))

    def read(p: Column) -> Column:
        part = lambda k: F.get(p, F.lit(k))
        name, number, turned = rf"^{IDENTIFIER}$", r"^[+-]?\d+$", part(0).rlike(r"^[+-]?\d")
        variable, value = F.when(turned, part(2)).otherwise(part(0)), F.when(turned, part(0)).otherwise(part(2))
        sign = F.when(turned, F.translate(part(1), "<>", "><")).otherwise(part(1))
        strict, lower = F.when(F.length(sign) == 1, 1).otherwise(0), sign.startswith(">")
        bound = value.try_cast("long") + F.when(lower, strict).otherwise(-strict)
        out = F.struct(variable.alias("variable"), F.when(lower, "lower").otherwise("upper").alias("side"), bound.alias("value"))
        return F.when(sign.isin("<", "<=", ">", ">=") & variable.rlike(name) & value.rlike(number), out)

    return let(lexemes, lambda t: let(inner(t), read))


def clause_features(c: Column, modified: Column) -> Column:
    """What a clause is about; modified: names the loop changes."""
    labelled = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\\at\(\s*(\w+)\s*,"), F.lit(1)))
    current = F.array_distinct(identifiers(F.regexp_replace(F.regexp_replace(c, r"\\at\([^)]*\)", " "), r"\\\w+", " ")))
    touched = F.array_intersect(current, modified)
    equality = c.rlike(r"(?<![<>=!])==(?!>)")
    frame = equality & (F.size(touched) == 0)
    return F.struct(
        F.array_sort(current).alias("current"),
        F.array_sort(labelled).alias("labelled"),
        F.array_sort(touched).alias("modified"),
        equality.alias("equality"),
        c.rlike(r"\w\s*\*\s*[A-Za-z_(]").alias("polynomial"),
        c.contains("%").alias("modular"),
        c.contains("==>").alias("implication"),
        frame.alias("frame_only"),
        (equality & (F.size(touched) >= 2)).alias("transition_law"),
        ((F.size(touched) > 0) & ~frame).alias("informative_progress"),
    )


def control_profile(guard: Column, body: Column, conditions: Column, cap: int = 3) -> Column:
    """Of a loop's guard, its body and the conditions of the body's ifs (program.first_loop, program.conditions): kind of guard; counts, capped, of ifs, elses and compound conditions; which jumps and inner loops there are."""
    count = lambda word: F.least(F.regexp_count(body, F.lit(rf"\b{word}\b")), F.lit(cap))
    has = lambda words: body.rlike(rf"\b(?:{words})\b")
    compound = F.size(F.filter(F.array_append(conditions, guard), lambda x: x.rlike(r"&&|\|\|")))
    return F.struct(
        F.when(guard.rlike(r"^\s*[01]\s*$"), "constant").otherwise("expression").alias("guard"), count("if").alias("ifs"), count("else").alias("elses"), F.least(compound, F.lit(cap)).alias("compound"),
        *[has(w).alias(f"has_{w}") for w in ("break", "continue", "return", "goto")], has("while|for").alias("has_loop"),
    )


def annotated(source: Column, at: Column, clauses: Column) -> Column:
    """The source with an annotation block before character `at` (from 0)."""
    block = F.concat(F.lit("/*@\n"), F.array_join(F.transform(clauses, lambda x: F.concat(F.lit("  loop invariant "), x, F.lit(";"))), "\n"), F.lit("\n*/\n"))
    return F.when(F.size(clauses) == 0, source).otherwise(F.concat(F.substring(source, F.lit(1), at), block, F.substring(source, at + 1, F.length(source))))


def prompt_part(prompt: Column, marker: str = "Program:\n") -> Column:
    """What follows the marker; the whole where it is missing."""
    place = F.instr(prompt, marker)
    return F.when(place > 0, F.substring(prompt, place + len(marker), F.length(prompt))).otherwise(prompt)


def redacted(c: Column) -> Column:
    """Values assigned to keys and tokens hidden."""
    return F.regexp_replace(c, r"(?i)\b((?:api[_-]?key|token|secret|password)\s*[=:]\s*[\"']?)[A-Za-z0-9+/_-]{8,}", "$1[REDACTED]")


def fenced_blocks(c: Column) -> Column:
    """Bodies of fenced code blocks."""
    return F.regexp_extract_all(c, F.lit(r"(?s)```[A-Za-z]*\n(.*?)```"), F.lit(1))


def same_vocabulary(a: Column, b: Column) -> Column:
    """Do two texts use the same identifiers?"""
    v = lambda c: F.array_sort(F.array_distinct(identifiers(c)))
    return v(a) == v(b)
