"""Curation of a pool: gates, quotas, weights, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio


def gates(**failed: Column) -> Column:
    """Names of the gates that a row fails, in the order given."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in failed.items()]))


def first_gate(df: DataFrame, gates_column: str = "gates") -> DataFrame:
    """Rows by the first gate they fail; `kept` for none."""
    return df.groupBy(F.coalesce(F.get(gates_column, F.lit(0)), F.lit("kept")).alias("gate")).agg(F.count("*").alias("n"))


def importance_weights(train: DataFrame, evaluation: DataFrame, cell: str, floor: float = 0.25, ceiling: float = 4.0) -> DataFrame:
    """For each cell of train, evaluation share over training share, kept within floor and ceiling."""
    t = train.groupBy(F.col(cell).alias("cell")).agg(F.count("*").alias("train_n"))
    e = evaluation.groupBy(F.col(cell).alias("e_cell")).agg(F.count("*").alias("eval_n"))
    total = t.agg(F.sum("train_n").alias("train_all")).crossJoin(e.agg(F.sum("eval_n").alias("eval_all")))  # a row each
    j = t.join(e, F.col("cell").eqNullSafe(F.col("e_cell")), "left").crossJoin(F.broadcast(total))
    want = ratio(F.coalesce("eval_n", F.lit(0)), F.col("eval_all")) / ratio(F.col("train_n"), F.col("train_all"))
    return j.select("cell", "train_n", F.coalesce("eval_n", F.lit(0)).alias("eval_n"), F.least(F.lit(ceiling), F.greatest(F.lit(floor), F.coalesce(want, F.lit(floor)))).alias("weight"))


def frontier_verdict(ok: Column, scorable: Column, mean: Column, std: Column, min_std: float = 0.05, min_mean: float = 0.05, max_mean: float = 0.95) -> Column:
    """What a policy's rewards on a program say: error, unscorable, saturated, hopeless, flat (little spread about a middling mean) or frontier."""
    end = F.when(mean > max_mean, "saturated").when(mean < min_mean, "hopeless")
    known = end.otherwise(F.when(std < min_std, "flat").otherwise("frontier"))
    return F.when(~F.coalesce(ok, F.lit(False)), "error").when(~F.coalesce(scorable, F.lit(False)), "unscorable").otherwise(known)


#: C7. What sharing a level is worth, before similarity.
RELATED = {"skeleton_ops": 0.9, "skeleton": 0.75, "coarse": 0.5}


def relatedness(level: Column, similarity: Column) -> Column:
    """The worth of the strongest shared level, the rest to 1 filled by the share that similarity says."""
    worth = F.coalesce(*[F.when(level == k, v) for k, v in RELATED.items()], F.lit(0.0))
    return F.round(worth + (1 - worth) * F.coalesce(similarity, F.lit(0.0)), 4)


def program_gates(
    duplicate: Column, in_ledger: Column, version: Column, scorable: Column, traces: Column, relation: Column, related: Column, cell_in_evaluation: Column, difficulty: Column,
    current: int, min_traces: int, min_relation: int, min_relation_share: float,
) -> Column:
    """Names of the gates that a program fails, in order. All arguments are Columns of one row a program, its ledger's joined (in_ledger: is there one?)."""
    held = lambda c: F.coalesce(c, F.lit(False))
    n, r = F.coalesce(traces, F.lit(0)), F.coalesce(relation, F.lit(0))
    readable = held(in_ledger) & version.eqNullSafe(F.lit(current)) & held(scorable)
    scored = readable & (n > 0)
    return gates(
        duplicate_of_eval=duplicate.isNotNull(), unscorable=~scored, too_few_traces=scored & (n < min_traces), no_relation_signal=scored & (r < min_relation),
        bounds_saturated=scored & (r >= min_relation) & (F.try_divide(r, n) < min_relation_share), unrelated_to_eval=~held(cell_in_evaluation) & related.isNull(),
        too_easy=difficulty == "too_easy", too_hard=difficulty == "too_hard",
    )


def program_tags(in_ledger: Column, version: Column, scorable: Column, error: Column, traces: Column, capped: Column, nonlinear: Column, n_pre_vars: Column, current: int) -> Column:
    """Why a program cannot be scored, if so, and what else is to be known of it."""
    held = lambda c: F.coalesce(c, F.lit(False))
    there, now = held(in_ledger), version.eqNullSafe(F.lit(current))
    readable, broken = there & now & held(scorable), there & now & ~held(scorable)
    memory = held(error.contains("MemoryError"))
    return gates(
        ledger_missing=~there, ledger_stale=there & ~now, sampler_memory=broken & memory, sampler_error=broken & ~memory, zero_negatives=readable & (F.coalesce(traces, F.lit(0)) == 0),
        hard_structure=held(nonlinear) & (n_pre_vars >= 5), capped=readable & held(capped),
    )


def gaps(demand: DataFrame, supply: DataFrame, cell: str, cap: int) -> DataFrame:
    """C14: cells whose demand exceeds supply, by how much, up to cap, largest first by order of the result's columns."""
    j = demand.join(supply, cell, "left")
    want = F.col("demand") - F.coalesce("supply", F.lit(0))
    return j.select(cell, "demand", F.coalesce("supply", F.lit(0)).alias("supply"), F.least(F.lit(cap), want).alias("missing")).where("missing > 0")


def restored(answer: Column, candidates: Column, survivors: Column) -> Column:
    """Struct status and answer, once a prover has said what survives of an answer's clauses and the candidates together: restored (all do), partially_restored (the whole answer and some candidate do) or not_inductive (the answer stays)."""
    known = F.array_distinct(F.concat(answer, candidates))
    lost = lambda part: F.size(F.array_except(part, survivors))
    kept = F.filter(survivors, lambda c: F.array_contains(known, c))
    more = (lost(answer) == 0) & (F.size(kept) > F.size(answer))
    whole = (lost(known) == 0) & (F.size(F.array_except(survivors, known)) == 0)
    status = F.when(whole, "restored").when(more, "partially_restored").otherwise("not_inductive")
    return F.struct(status.alias("status"), F.when(whole, survivors).when(more, kept).otherwise(answer).alias("answer"))


def to_restore(made: Column, answer_features: Column, candidate_features: Column) -> Column:
    """Why a row is left alone, null for those to be tried: not made by synthesis, its answer has a clause of informative progress, or no candidate has. Features: arrays of booleans."""
    some = lambda c: F.coalesce(F.exists(c, lambda x: x), F.lit(False))
    return F.when(~F.coalesce(made, F.lit(False)), "archival_untouched").when(some(answer_features), "already_has_progress").when(~some(candidate_features), "no_candidate")
