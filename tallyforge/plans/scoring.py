"""Reward scoring of a batch of groups, end to end.

Input: groups (group_id, scope JSON, rollouts array<string>), positives (group_id, state) and negatives (group_id,
group_idx, state). A state is the struct of sources.schemas.STATE. Groups and rollouts are independent, so all steps
are partitioned by group; the states of a group are sent to its clauses once.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import normalize
from ..functions.text import CLAUSE, extract_clauses
from ..operators import filters, reward
from ..sources.readers import read_records
from ..sources.schemas import REWARD
from ..sources.writers import write_rows


def clauses_of(value: object) -> list[str]:
    """Normalized clauses of a rollout given as a record, a list, JSON of either, or text that marks them.

    A record gives its invariants, or else those marked in its code. Text that is no JSON record or list gives what it
    marks, nothing otherwise; a record's invariants that are one text may be a bare clause.
    """
    if isinstance(value, str):
        opened = _json(value.strip()) if value.strip()[:1] in ("{", "[") else None
        return _marked(value) if opened is None else clauses_of(opened)
    if isinstance(value, dict):
        given = value.get("invariants") or _marked(value.get("code") or "")
    else:
        given = value if isinstance(value, (list, tuple)) else []
    if isinstance(given, str):
        given = _marked(given) or [given]
    return [c for c in (normalize(str(x)) for x in given if x is not None) if c]


def _json(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return None


def _marked(text: str) -> list[str]:
    return [" ".join(x.split()) for x in re.findall(CLAUSE, text)]


def coerced(rollouts: str = "rollouts"):
    """P3 as a Column: array<string> of raw rollouts -> array<array<string>>."""

    @F.pandas_udf("array<array<string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda rs: [clauses_of(r) for r in (rs if rs is not None else [])])

    return run(rollouts)


def grouped(flat: DataFrame, group: str = "group_id", response: str = "response", order: str = "ord") -> DataFrame:
    """A1: flat rows (group_id, program, response) as one row a group, rollouts in order."""
    rs = F.array_sort(F.collect_list(F.struct(order, response)))
    return flat.groupBy(group).agg(F.min_by("program", order).alias("program"), rs.alias("r")).select(group, "program", F.col(f"r.{response}").alias("rollouts"))


def judged(groups: DataFrame, positives: DataFrame, order: str, cap: int, stage: filters.Stage) -> DataFrame:
    """Groups with their clauses (capped), the number of their positive states, survivors and filter_error."""
    p = positives.groupBy("group_id").agg(F.collect_list("state").alias("positives"))
    g = groups.withColumn("raw", coerced()).select("group_id", "scope", F.transform("raw", lambda r: reward.capped(r, cap)).alias("capped"))
    g = g.select("group_id", "scope", "capped", F.col("capped.clauses").alias("clauses")).join(p, "group_id", "left")
    g = (filters.pooled if order == "pooled" else filters.independent)(g, stage)
    return g.select("group_id", "capped", "survivors", "filter_error", F.coalesce(F.size("positives"), F.lit(0)).alias("n_positives"))


def failures(groups: DataFrame, positives: DataFrame, order: str = "pooled", cap: int = reward.RESPONSE_CAP, stage: filters.Stage = filters.lite) -> DataFrame:
    """group_id and error of the groups that cannot be scored; score leaves them out."""
    return judged(groups, positives, order, cap, stage).where("filter_error IS NOT NULL").select("group_id", F.col("filter_error").alias("error"))


def score(
    groups: DataFrame, positives: DataFrame, negatives: DataFrame, variant: str = "full", order: str = "pooled", cap: int = reward.RESPONSE_CAP, stage: filters.Stage = filters.lite,
    filter_mode: str = "lite", negative_sampler: str = "structured",
) -> DataFrame:
    """One row a rollout, with the columns of sources.schemas.REWARD. Groups that fail are left out (see failures). filter_mode and negative_sampler say how stage and negatives were made."""
    g = judged(groups, positives, order, cap, stage).where("filter_error IS NULL")
    r = g.select("group_id", "n_positives", F.posexplode(F.arrays_zip("capped", "survivors")).alias("rollout_index", "z"))
    r = r.select("group_id", "n_positives", "rollout_index", F.col("z.capped.clauses").alias("invariants"), "z.survivors", *[F.col(f"z.capped.{c}").alias(c) for c in ("generated", "accepted", "overflow")])
    # distinct surviving clauses of a group meet its negative states once
    owners = r.select("group_id", "rollout_index", F.explode("survivors").alias("clause"))
    clauses = owners.select("group_id", "clause").distinct()
    tested = filters.verdicts(clauses.join(negatives, "group_id"))
    rejects = reward.trace_rejections(tested, ["group_id", "clause", "group_idx"])
    facts = owners.join(rejects, ["group_id", "clause"]).select("group_id", "rollout_index", "group_idx").distinct()
    totals = groups.select("group_id").join(negatives.groupBy("group_id").agg(F.countDistinct("group_idx").alias("n_traces")), "group_id", "left").fillna(0, ["n_traces"])
    credit = reward.coverage(facts, totals, r, ["group_id"], "rollout_index", "group_idx")
    batch = reward.batch_scores(facts, totals, ["group_id"], "group_idx").select("group_id", "n_traces", "batch_score", "scorable", "reward_mode")
    out = r.join(credit.drop("reward"), ["group_id", "rollout_index"]).join(batch, "group_id")
    verified = reward.fully_verified(F.col("invariants"), F.col("survivors"))
    out = out.withColumn("reward", reward.variant_reward(variant, F.col("base"), F.col("shapley_credit"), verified, F.col("scorable")))
    return out.select(
        "group_id", "rollout_index", "reward", "base", "shapley_credit", F.lit(0.0).alias("overflow_penalty"), "generated", "accepted", "overflow", F.col("rejected").cast("int").alias("rejected"),
        "invariants", "survivors", "batch_score", F.lit(filter_mode).alias("filter_mode"), F.lit(variant).alias("reward_variant"), F.lit(order).alias("credit_filter_order"),
        F.lit(negative_sampler).alias("negative_sampler"), "reward_mode", "scorable", "n_positives", F.col("n_traces").cast("int").alias("n_negatives"),
    )


def score_file(groups: DataFrame, positives: DataFrame, negatives: DataFrame, output: str, **how) -> dict[str, int]:
    """Write the rows of all groups that can be scored, by the output's extension; how many groups there were, failed, rows written. A caller exits with 1 if any failed."""
    write_rows(score(groups, positives, negatives, **how), output)
    failed = failures(groups, positives, **{k: v for k, v in how.items() if k in ("order", "cap", "stage")})
    written = read_records(groups.sparkSession, output, REWARD).count()
    return {"batches": groups.count(), "failed": failed.count(), "rows": written}


__all__ = ["clauses_of", "coerced", "extract_clauses", "failures", "grouped", "score", "score_file"]
