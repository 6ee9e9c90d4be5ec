"""Windows over traces of states (S6, S8-S16, S19, S22, A35, W23): rows (program, run, it, var columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RELATION, ESCAPE, TOTAL = 48, 12, 60
SMALL_DELTAS, TERMINAL_DELTAS = (1, 2), (1, 2, 3, 5, 8)


def distinct_states(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each state."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def envelopes(df: DataFrame, context: list[str], variables: list[str]) -> DataFrame:
    """Least and greatest value of each variable in a context, long form."""
    v = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).cast("double").alias("value")) for n in variables]))
    return df.select(*context, v.alias("v")).groupBy(*context, "v.variable").agg(F.min("v.value").alias("low"), F.max("v.value").alias("high"))


def neighbours(df: DataFrame, by: list[str], it: str, variables: list[str], guard: str | None = None) -> DataFrame:
    """Of each (run, it), the last row counting: is it terminal (guard true just before, false here), dense (the next three exist), and its step."""
    last = Window.partitionBy(*by, it).orderBy(F.desc("_order"))
    d = df.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_order")
    w = Window.partitionBy(*by).orderBy(it)
    ahead = F.count("*").over(w.rangeBetween(1, 3))
    before, after = F.lag(it).over(w) == F.col(it) - 1, F.lead(it).over(w) == F.col(it) + 1
    step = lambda v: F.when(after, F.lead(v).over(w) - F.col(v)).when(before, F.col(v) - F.lag(v).over(w))
    out = d.withColumns({"dense": ahead == 3, **{f"step_{v}": step(v) for v in variables}})
    if guard is not None:
        out = out.withColumn("terminal", F.coalesce(before & F.lag(guard).over(w) & ~F.col(guard), F.lit(False)))
    return out


def relation_candidates(df: DataFrame, variables: list[str], deltas: tuple[int, ...] = SMALL_DELTAS) -> DataFrame:
    """Each state moved along one axis by each delta, and along two axes alike and opposed. Columns axis, distance, change_<variable>, and the moved values."""
    moves = [{v: s * d} for v in variables for d in deltas for s in (1, -1)]
    moves += [{a: s * d, b: t * s * d} for i, a in enumerate(variables) for b in variables[i + 1 :] for d in deltas for s in (1, -1) for t in (1, -1)]
    rows = F.explode(F.array(*[F.struct(F.lit("+".join(sorted(m))).alias("axis"), F.lit(sum(abs(x) for x in m.values())).alias("distance"), *[F.lit(m.get(v, 0)).alias(f"_{v}") for v in variables]) for m in moves]))
    d = df.withColumn("_m", rows)
    d = d.withColumns({f"change_{v}": F.col(f"_m._{v}") for v in variables})
    return d.withColumns({"axis": F.col("_m.axis"), "distance": F.col("_m.distance"), **{v: F.col(v) + F.col(f"_m._{v}") for v in variables}}).drop("_m")


def admitted(candidates: DataFrame, positives: DataFrame, context: list[str], variables: list[str], guard: str, moved_guard: Column) -> DataFrame:
    """Candidates of dense or terminal bases (columns of neighbours and relation_candidates) that are inside their context's
    envelope, keep the base's guard (its column guard; moved_guard at the moved values), do not lie on the base's own step, and are no positive state."""
    bounds = positives.groupBy(*context).agg(*[f(v).alias(f"_{n}_{v}") for v in variables for n, f in (("low", F.min), ("high", F.max))])
    inside = (F.col("dense") | F.col("terminal")) & (F.col(guard) == moved_guard)
    inside = inside & ~tangent([F.col(f"step_{v}") for v in variables], [F.col(f"change_{v}") for v in variables])
    for v in variables:
        inside = inside & F.col(v).between(F.col(f"_low_{v}"), F.col(f"_high_{v}"))
    d = candidates.join(bounds, context).where(inside).select(*candidates.columns)
    return d.join(positives.select(*context, *variables).distinct(), [*context, *variables], "left_anti")


def relation_negatives(states: DataFrame, by: list[str], it: str, variables: list[str], guard: Column) -> DataFrame:
    """Negatives around the states of traces (by, it, variables, _order); guard is a condition on the variables. Terminal bases are moved further."""
    near = neighbours(states.withColumn("guard", guard), by, it, variables, "guard")
    near = distinct_states(near, [*by, *variables], [it])
    moved = relation_candidates(near.where("NOT terminal"), variables).unionByName(relation_candidates(near.where("terminal"), variables, TERMINAL_DELTAS))
    return admitted(moved, states, by, variables, "guard", guard)


def tangent(steps: list, changes: list):
    """Is a change an integer multiple of the step, the same for all variables? Columns in, Column out."""
    ok, rate = F.lit(True), None
    for s, c in zip(steps, changes, strict=True):
        k = F.when(F.coalesce(s, F.lit(0)) != 0, F.try_divide(c, s))
        ok = ok & F.when(F.coalesce(s, F.lit(0)) == 0, c == 0).otherwise((c % s == 0) & (F.lit(True) if rate is None else F.coalesce(k == rate, rate.isNull())))
        rate = k if rate is None else F.coalesce(rate, k)
    return ok


def escape_groups(df: DataFrame, by: list[str], run: str, state: str, order: str, most: int = ESCAPE) -> DataFrame:
    """States past the exit, each with the first run that saw it, runs atomic, at most `most` runs of each group."""
    first = Window.partitionBy(*by, state).orderBy(run, order)
    d = df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    rank = F.dense_rank().over(Window.partitionBy(*by).orderBy(run))
    return d.withColumn("group_idx", rank - 1).where(F.col("group_idx") < most)


def family_local_index(df: DataFrame, by: list[str], family: str, order: str) -> DataFrame:
    """Index of each group within its family, from 0."""
    w = Window.partitionBy(*by, family).orderBy(order)
    return df.withColumn("family_index", F.row_number().over(w) - 1)


def mislabelled(negatives: DataFrame, positives: DataFrame, hard: list[str], soft: list[str]) -> DataFrame:
    """Negatives whose full key, or whose soft key, is a positive's."""
    h = positives.select(*[F.col(c).alias(f"h_{c}") for c in hard]).distinct().withColumn("_h", F.lit(1))
    s = positives.select(*[F.col(c).alias(f"s_{c}") for c in soft]).distinct().withColumn("_s", F.lit(1))
    on = lambda p, cs: [F.col(c).eqNullSafe(F.col(f"{p}_{c}")) for c in cs]
    j = negatives.join(h, on("h", hard), "left").join(s, on("s", soft), "left")
    return j.agg(F.count("*").alias("negatives"), F.count("_h").alias("hard"), F.count("_s").alias("soft"))


def blockers(groups: Column, relation: Column, escape: Column, random: Column, sampler: Column, relation_blockers: Column) -> Column:
    """Why a program has no negative traces; empty if it has some. Counts by family, and what stood in the way of relation traces."""
    absent = lambda n, kind: F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(f"no_admissible_{kind}_trace"))
    structured = F.array_compact(F.array(absent(relation, "relation"), absent(escape, "escape"), absent(random, "random")))
    why = F.concat(F.coalesce(relation_blockers, F.array().cast("array<string>")), F.when(sampler == "random", F.array(F.lit("no_admissible_random_trace"))).otherwise(structured))
    return F.when(groups > 0, F.array().cast("array<string>")).otherwise(why)


def sample_stats(groups: Column, witnesses: Column, relation: Column, escape: Column, random: Column, sampler: Column, capped: Column) -> Column:
    """The record of what a sample holds."""
    fill = F.when(sampler == "structured", F.greatest(F.lit(0), F.lit(TOTAL) - relation - escape)).otherwise(TOTAL)
    return F.struct(
        groups.alias("n_traces"), witnesses.alias("n_witness_states"), relation.alias("relation"), escape.alias("escape"), random.alias("random"), sampler.alias("negative_sampler"), F.lit(TOTAL).alias("negative_budget"),
        F.lit(RELATION).alias("relation_budget"), F.lit(ESCAPE).alias("escape_budget"), fill.alias("random_fill_budget"), capped.alias("capped"),
    )


def context_bases(states: DataFrame, by: list[str], context: str, order: str, variables: list[str], limit: int) -> DataFrame:
    """Bases for a solver, `limit` of each group: for each variable the least and the greatest among the contexts' first states, then each context's first and its last state, then deeper ones in turn. The contexts count in the order of their first state."""
    w = Window.partitionBy(*by, context).orderBy(order)
    d = states.withColumns({"_depth": F.row_number().over(w) - 1, "_last": F.lead(order).over(w).isNull(), "_at": F.min(order).over(Window.partitionBy(*by, context))})
    heads = d.where("_depth = 0")
    picks = [F.struct(F.lit(2 * i + k).alias("turn"), F.lit(0).cast("long").alias("sub"), (F.min_by(order, F.struct(v, order)) if k == 0 else F.max_by(order, F.struct(F.col(v), -F.col(order)))).alias("o")) for i, v in enumerate(variables) for k in (0, 1)]
    ends = heads.groupBy(*by).agg(F.array(*picks).alias("x")).select(*by, F.explode("x").alias("x")).select(*by, "x.*")
    n = 2 * len(variables)
    turn = F.when(F.col("_depth") == 0, n).when(F.col("_last"), n + 1).otherwise(n + 1 + F.col("_depth"))
    rest = d.select(*by, turn.alias("turn"), F.col("_at").cast("long").alias("sub"), F.col(order).alias("o"))
    first = ends.unionByName(rest).groupBy(*by, "o").agg(F.min(F.struct("turn", "sub")).alias("p"))
    chosen = first.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("p.turn", "p.sub"))).where(F.col("place") <= limit).select(*by, F.col("o").alias(order), "place")
    return states.join(chosen, [*by, order])
