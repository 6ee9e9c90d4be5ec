"""Group rewards from rejected traces.

Facts: one row (group, rollout, trace) for each trace that a rollout rejects; totals: traces of each group. Credit
is exact: a trace that f rollouts of a group reject gives each of them 1 / f of a trace, so that credits add up to
the group's union coverage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANTS = ("binary", "whole_coverage", "base", "full")
SHAPLEY_WEIGHT = 0.3
RESPONSE_CAP = 20


def capped(clauses: Column, cap: int = RESPONSE_CAP) -> Column:
    """Struct of the clauses that count, and how many were generated, accepted and over the cap."""
    n = F.size(clauses)
    return F.struct(F.slice(clauses, 1, cap).alias("clauses"), n.alias("generated"), F.least(n, F.lit(cap)).alias("accepted"), F.greatest(n - cap, F.lit(0)).alias("overflow"))


def trace_rejections(states: DataFrame, keys: list[str]) -> DataFrame:
    """States has a verdict for each clause and state; a trace is rejected if any verdict is false (null is none)."""
    hit = F.coalesce(~F.col("verdict"), F.lit(False))
    return states.groupBy(*keys).agg(F.bool_or(hit).alias("rejected")).where("rejected").drop("rejected")


def coverage(facts: DataFrame, totals: DataFrame, rollouts: DataFrame, group: list[str], rollout: str, trace: str, weight: float = SHAPLEY_WEIGHT) -> DataFrame:
    """Base, shapley_credit, loo_utility and reward of every rollout; totals: group, n_traces."""
    facts = facts.select(*group, rollout, trace).distinct()
    owners = facts.groupBy(*group, trace).agg(F.count("*").alias("f"))
    per = facts.join(owners, [*group, trace]).groupBy(*group, rollout).agg(F.count("*").alias("rejected"), F.sum(1.0 / F.col("f")).alias("credit"), F.count_if(F.col("f") == 1).alias("alone"))
    out = rollouts.select(*group, rollout).distinct().join(totals, group, "left").join(per, [*group, rollout], "left")
    n = F.coalesce("n_traces", F.lit(0)).cast("double")
    share = lambda c: F.coalesce(F.try_divide(F.coalesce(F.col(c), F.lit(0)).cast("double"), n), F.lit(0.0))
    out = out.select(*group, rollout, F.coalesce("rejected", F.lit(0)).alias("rejected"), share("rejected").alias("base"), share("credit").alias("shapley_credit"), share("alone").alias("loo_utility"))
    return out.withColumn("reward", F.col("base") + weight * F.col("shapley_credit"))


def batch_scores(facts: DataFrame, totals: DataFrame, group: list[str], trace: str) -> DataFrame:
    """Share of a group's traces that any rollout rejects; W16: whether it can be scored, and how."""
    union = facts.select(*group, trace).distinct().groupBy(*group).agg(F.count("*").alias("covered"))
    out = totals.join(union, group, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    scorable = F.coalesce("n_traces", F.lit(0)) > 0
    return out.select(*group, "n_traces", "covered", F.when(scorable, F.col("covered") / F.col("n_traces")).otherwise(0.0).alias("batch_score"), scorable.alias("scorable"), F.when(scorable, "coverage").otherwise("binary").alias("reward_mode"))


def variant_reward(variant: str, base: Column, credit: Column, verified: Column, scorable: Column, weight: float = SHAPLEY_WEIGHT) -> Column:
    """The reward of a rollout; groups without traces, and the binary variant, pay whole rollouts only."""
    if variant not in VARIANTS:
        raise ValueError(f"variant is one of {', '.join(VARIANTS)}")
    whole = F.when(verified, 1.0).otherwise(0.0)
    scored = {"binary": whole, "whole_coverage": F.when(verified, base).otherwise(0.0), "base": base, "full": base + weight * credit}[variant]
    return F.when(scorable, scored).otherwise(whole)


def fully_verified(candidates: Column, survivors: Column) -> Column:
    """Not empty, and the same set of texts."""
    same = F.array_sort(F.array_distinct(candidates)) == F.array_sort(F.array_distinct(survivors))
    return (F.size(survivors) > 0) & same


def mixed_score(base: Column, credit: Column, q: float) -> Column:
    """(1 - q) of base and q of credit."""
    return (1 - q) * base + q * credit


def raw_coverage(verdicts: DataFrame, groups: DataFrame, group: list[str], trace: str, verified: Column) -> DataFrame:
    """What a tool's final clauses reject without any filter. verdicts: group, trace, verdict of each clause at each state; groups: a row a group, with n_traces. Groups without traces pay 1 if verified."""
    hit = verdicts.groupBy(*group, trace).agg(F.bool_or(F.coalesce(~F.col("verdict"), F.lit(False))).alias("hit"))
    n = hit.groupBy(*group).agg(F.count_if("hit").alias("rejected"))
    j = groups.join(n, group, "left")
    there = F.coalesce("n_traces", F.lit(0)) > 0
    rejected = F.when(there, F.coalesce("rejected", F.lit(0)))
    return j.select(*group, F.when(there, "negative_coverage_raw_no_houdini").otherwise("binary_frama_c_validation").alias("reward_mode"), F.coalesce("n_traces", F.lit(0)).alias("negative_trace_count"),
                    rejected.alias("rejected_negative_count"), F.try_divide(rejected.cast("double"), F.col("n_traces").cast("double")).alias("negative_rejection_score"),
                    F.when(~there, F.when(verified, 1.0).otherwise(0.0)).alias("binary_frama_c_validation"))


def family_scores(rejections: DataFrame, task: list[str], candidate: str, trace: str, family: str) -> DataFrame:
    """For each candidate and family of traces: share rejected (score), the same with one vote for each behaviour (signature_score), for each behaviour that tells candidates apart (informative_score), and weighted by how evenly a trace splits the candidates, 4p(1 - p) (entropy_score).

    rejections: a row for each task, candidate and trace, with rejected (boolean). A trace's behaviour is the set of the
    candidates that reject it; its digest is an order-free sum, so that no set is gathered.
    """
    r = rejections.withColumn("r", F.col("rejected").cast("int"))
    mark = F.when(F.col("rejected"), F.xxhash64(candidate).cast("decimal(38,0)")).otherwise(0)
    t = r.groupBy(*task, family, trace).agg(F.sum("r").alias("n"), F.count("*").alias("all"), F.sum(mark).alias("_sum"), F.bit_xor(F.when(F.col("rejected"), F.xxhash64(candidate, F.lit(1))).otherwise(0)).alias("_xor"))
    first = t.groupBy(*task, family, "n", "_sum", "_xor").agg(F.min(trace).alias("_first"))
    p = F.col("n") / F.col("all")
    t = t.join(first, [*task, family, "n", "_sum", "_xor"]).select(*task, family, trace, (4 * p * (1 - p)).alias("weight"), (F.col(trace) == F.col("_first")).alias("own"), ((F.col("n") > 0) & (F.col("n") < F.col("all"))).alias("tells"))
    x = F.col("r").cast("double")
    return r.join(t, [*task, family, trace]).groupBy(*task, candidate, family).agg(
        F.avg(x).alias("score"), F.avg(F.when(F.col("own"), x)).alias("signature_score"), F.avg(F.when(F.col("own") & F.col("tells"), x)).alias("informative_score"),
        F.try_divide(F.sum(x * F.col("weight")), F.sum("weight")).alias("entropy_score"), F.count("*").alias("traces"),
    )


def weighted_family_score(scores: DataFrame, by: list[str], family: str, score: str, weights: dict[str, float]) -> DataFrame:
    """Mean of the family scores that are there, by weight; null if none counts."""
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(family))
    w = F.when(F.col(score).isNotNull() & (w > 0), w)
    return scores.groupBy(*by).agg(F.try_divide(F.sum(w * F.col(score)), F.sum(w)).alias("weighted_score"))


def ladder_faults(program: DataFrame, margin: float = 0.15, eps: float = 0.02, least: float = 0.8) -> DataFrame:
    """Program and the rules that its score ladder breaks. program: program, family (gold, loose, trivial, guard_copy, post_copy, unsound), reward, base, survivors, given (clauses), post_is_invariant."""
    of = lambda f, c: F.max(F.when(F.col("family") == f, F.col(c)))
    names = ("gold", "loose", "trivial", "guard_copy", "post_copy", "unsound")
    g = program.groupBy("program").agg(*[of(n, "reward").alias(n) for n in names], of("gold", "base").alias("base"), of("gold", "survivors").alias("kept"), of("gold", "given").alias("given"), F.bool_or(F.coalesce("post_is_invariant", F.lit(False))).alias("quality"))
    above = lambda f: F.col(f) > F.col("gold") + eps
    close = lambda f: F.col(f) > F.col("gold") - margin
    rules = {
        "gold_base_too_low": F.col("base") < least, "gold_filtered": F.col("kept") < F.col("given"), "loose_beats_gold": above("loose"), "post_copy_beats_gold": F.col("quality") & above("post_copy"),
        "trivial_too_close": close("trivial"), "guard_copy_too_close": close("guard_copy"), "unsound_too_close": close("unsound"), "post_copy_too_close": ~F.col("quality") & close("post_copy"),
    }
    return g.select("program", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()])).alias("faults"))
