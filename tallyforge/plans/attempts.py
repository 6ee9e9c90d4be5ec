"""Inference attempts with pluggable providers and provers (Q1, Q2, R18): partitioned by program, any callables that can be pickled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.predicate import dedup_normalized
from ..functions.program import strip_target
from ..operators.reward import RESPONSE_CAP

#: Gives n responses, each a list of clauses, to a program without its target.
Provider = Callable[[str, int], list[list[str]]]
#: Gives the clauses that stay of a program's, and whether an annotated program is right (null if that cannot be said).
Filter = Callable[[str, list[str]], list[str]]
Verifier = Callable[[str], bool | None]


def mock_provider(responses: dict[str, list[list[str]]] | list[list[str]]) -> Provider:
    """Canned responses, in turn; by program, or the same for all."""

    def give(program: str, n: int) -> list[list[str]]:
        own = responses.get(program, []) if isinstance(responses, dict) else responses
        return [own[i % len(own)] for i in range(n)] if own else [[] for _ in range(n)]

    return give


def annotated(source: str, clauses: list[str]) -> str:
    """The source with the clauses before its first while or for loop."""
    from ..functions.program import code_only, find_loops

    loops = find_loops(code_only(source))
    if not loops or not clauses:
        return source
    at = loops[0].kw_start
    return source[:at] + "/*@\n" + "".join(f"  loop invariant {c};\n" for c in clauses) + "*/\n" + source[at:]


def attempts(programs: DataFrame, provider: Provider, keep: Filter, verify: Verifier, n: int = 8, key: str = "name", source: str = "source") -> DataFrame:
    """Q2: key, rollouts, final_invariants, annotated_code, verified, error. The union of the responses (each cut to the response cap) is filtered once; a failing program has its error."""
    schema = f"{key} {dict(programs.dtypes)[key]}, rollouts array<array<string>>, final_invariants array<string>, annotated_code string, verified boolean, error string"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for k, text in zip(pdf[key], pdf[source], strict=True):
                try:
                    hidden = strip_target(text)
                    rollouts = [list(r)[:RESPONSE_CAP] for r in provider(hidden, n)]
                    final = keep(hidden, dedup_normalized([c for r in rollouts for c in r]))
                    code = annotated(text, final)
                    rows.append((k, rollouts, final, code, verify(code), None))
                except Exception as e:  # noqa: BLE001  whatever a provider or prover raises concerns its program alone
                    rows.append((k, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=[key, "rollouts", "final_invariants", "annotated_code", "verified", "error"])

    return programs.select(key, source).mapInPandas(run, schema)


def rejudged(results: DataFrame, verify: Verifier, code: str = "annotated_code") -> DataFrame:
    """Q1: results with a verdict of their code (verified, judge_error). Order plays no part: rows are judged where they are, and appended to a ledger as they come."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            verdicts = [_verdict(verify, c) for c in pdf[code]]
            yield pdf.assign(verified=pd.Series([v for v, _ in verdicts], dtype="object", index=pdf.index), judge_error=pd.Series([e for _, e in verdicts], dtype="object", index=pdf.index))

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in results.schema if f.name not in ("verified", "judge_error")]
    return results.drop("verified", "judge_error").mapInPandas(run, ", ".join([*kept, "verified boolean, judge_error string"]))


def _verdict(verify: Verifier, code: str | None) -> tuple[bool | None, str | None]:
    try:
        return (None, "no code") if code is None else (verify(code), None)
    except Exception as e:  # noqa: BLE001  the same
        return None, f"{type(e).__name__}: {e}"[:300]
