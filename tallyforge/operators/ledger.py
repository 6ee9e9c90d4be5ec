"""Append-only ledgers: latest rows, pending work, fail-closed joins, pairing, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. max_by keeps one row for each key and task, so a hot key does not gather."""
    row = F.struct(*[c for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("_row")).select(*key, "_row.*")


def pending(jobs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Jobs that have no row in done."""
    return jobs.join(done.select(*key).distinct(), key, "left_anti")


def gated(rows: DataFrame, ledger: DataFrame, key: str, version: str | None = None, current: int | None = None, scorable: Column | None = None) -> DataFrame:
    """Rows with status: missing, stale, unscorable or kept."""
    j = rows.join(ledger.withColumn("_there", F.lit(True)), key, "left")
    status = F.when(F.col("_there").isNull(), "missing")
    if version is not None:
        status = status.when(~F.col(version).eqNullSafe(F.lit(current)), "stale")
    if scorable is not None:
        status = status.when(~F.coalesce(scorable, F.lit(False)), "unscorable")
    return j.withColumn("status", status.otherwise("kept")).drop("_there")


def fail_closed(gated_rows: DataFrame) -> DataFrame:
    """The rows, unless any is not kept: then reading them raises."""
    bad = gated_rows.agg(F.count_if(F.col("status") != "kept").alias("bad"))
    held = F.when(F.col("bad") == 0, True).otherwise(F.raise_error("rows are missing, stale or unscorable").cast("boolean"))
    return gated_rows.crossJoin(F.broadcast(bad)).where(held).drop("bad", "status")  # one row; a filter, as unused columns are not computed


def paired_outcomes(a: DataFrame, b: DataFrame, key: str, ok: str) -> DataFrame:
    """Of the keys both have, how many succeed in both, gain, regress, or fail in both."""
    x, y = a.select(key, F.col(ok).alias("_a")), b.select(key, F.col(ok).alias("_b"))
    j = x.join(y, key).where("_a IS NOT NULL AND _b IS NOT NULL")
    p, q = F.col("_a").cast("boolean"), F.col("_b").cast("boolean")
    return j.agg(F.count_if(p & q).alias("both"), F.count_if(~p & q).alias("gain"), F.count_if(p & ~q).alias("regression"), F.count_if(~p & ~q).alias("neither"))


def consistent_labels(a: DataFrame, b: DataFrame, key: list[str], label: str) -> DataFrame:
    """Keys in one version only, or with other labels, by kind."""
    x, y = a.select(*key, F.col(label).alias("_a"), F.lit(1).alias("_x")), b.select(*key, F.col(label).alias("_b"), F.lit(1).alias("_y"))
    j = x.join(y, key, "full_outer")
    kind = F.when(F.col("_x").isNull(), "only_second").when(F.col("_y").isNull(), "only_first").when(~F.col("_a").eqNullSafe(F.col("_b")), "label_differs").otherwise("same")
    return j.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def with_totals(df: DataFrame, by: list[str], over: str, aggregates: list[Column]) -> DataFrame:
    """A2: aggregates by (by, over) and by `by` alone, where `over` reads all."""
    g = df.groupingSets([[*by, over], by], *by, over).agg(F.grouping(over).alias("_all"), *aggregates)
    return g.withColumn(over, F.when(F.col("_all") == 1, "all").otherwise(F.col(over).cast("string"))).drop("_all")


def once_per_batch(df: DataFrame, batch: str, value: str, order: str, by: list[str]) -> DataFrame:
    """A5: sum of a value that repeats in every row of its batch; the last one counts."""
    b = df.groupBy(*by, batch).agg(F.max_by(value, order).alias("_v"))
    return b.groupBy(*by).agg(F.sum("_v").alias("total"), F.count("*").alias("batches"))


def shared_cost(df: DataFrame, task: list[str], cost: str, out: str = "share") -> DataFrame:
    """A task's cost in equal shares to its rows. Tasks are counted first, so that a large one does not gather."""
    n = df.groupBy(*task).agg(F.count("*").alias("_n"))
    return df.join(n, task).withColumn(out, F.col(cost) / F.col("_n")).drop("_n")


def failure_kinds(**flags: Column) -> Column:
    """The names of the flags that hold, joined by `;`."""
    return F.concat_ws(";", *[F.when(c, F.lit(k)) for k, c in flags.items()])


def strength(feasible: Column, forward: Column, backward: Column) -> Column:
    """Q5: how an invariant compares with a target, from a solver's answers (sat, unsat or other): can the invariant hold at all, can it hold without the target, can the target hold without it."""
    refuted = lambda c: F.coalesce(c, F.lit("")) == "unsat"
    found = lambda c: F.coalesce(c, F.lit("")) == "sat"
    compared = (
        F.when(refuted(forward) & found(backward), "strictly_stronger").when(refuted(forward) & refuted(backward), "target_equivalent")
        .when(found(forward) & refuted(backward), "strictly_weaker").when(found(forward) & found(backward), "incomparable").otherwise("unknown_implication")
    )
    return F.when(refuted(feasible), "invariant_target_context_unsatisfiable").when(found(feasible), compared).otherwise("unknown_nonvacuity")


#: Fixed values. Marks in a log that a failure was one of the infrastructure.
INFRASTRUCTURE = (
    "RateLimitError", "APIConnectionError", "APITimeoutError", "InternalServerError", "ConnectError", "RemoteProtocolError", "Server disconnected", "TLS/SSL connection has been closed",
    r"Connection error\.", r"Request timed out\.", r"HTTP/1\.1 (?:429|5\d\d)",
)


def retryable(status: Column, log: Column) -> Column:
    """Q10: did a generation fail for reasons of the infrastructure, by its log?"""
    return F.coalesce((status == "failed") & log.rlike("(?i)" + "|".join(INFRASTRUCTURE)), F.lit(False))


def renamed(c: Column, names: dict[str, str]) -> Column:
    """Q11: method names brought to their present form."""
    if not names:
        return c
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


def rates(success: Column, unresolved: Column, total: Column) -> Column:
    """Lower and upper rate while some rows are unresolved."""
    n = total.cast("double")
    return F.struct(F.try_divide(success.cast("double"), n).alias("low"), F.try_divide((success + unresolved).cast("double"), n).alias("high"))


def missing_keys(rows: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Keys of rows that other lacks, each once."""
    return rows.select(*key).distinct().join(other.select(*key).distinct(), key, "left_anti")


def common_tasks(a: DataFrame, b: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both ledgers, cut to the tasks that both have."""
    return a.join(b.select(*key).distinct(), key, "left_semi"), b.join(a.select(*key).distinct(), key, "left_semi")


def zipped(a: DataFrame, b: DataFrame, task: list[str], pos: str) -> DataFrame:
    """Rows of a and b at the same place of the same task; reading fails if a place is in one of them only."""
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), [*task, pos], "full_outer")
    held = F.when(F.col("_a") & F.col("_b"), True).otherwise(F.raise_error("lengths differ").cast("boolean"))
    return j.where(held).drop("_a", "_b")


def enriched(rows: DataFrame, artefacts: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """Rows with the value of the first artefact table (one row a key) that has one."""
    out = rows
    for i, a in enumerate(artefacts):
        out = out.join(a.select(*key, F.col(value).alias(f"_{i}")), key, "left")
    return out.withColumn(value, F.coalesce(*[f"_{i}" for i in range(len(artefacts))])).drop(*[f"_{i}" for i in range(len(artefacts))])


def discovered(ledgers: DataFrame, key: list[str], clauses: str, success: list[Column]) -> DataFrame:
    """Of all ledgers' rows, the distinct clause lists of each task that succeed by any rule, fewer clauses first, then the shorter, then by text."""
    ok = F.lit(False)
    for s in success:
        ok = ok | F.coalesce(s, F.lit(False))
    d = ledgers.where(ok & (F.size(clauses) > 0)).select(*key, F.col(clauses).alias("clauses")).distinct()
    d = d.withColumns({"n": F.size("clauses"), "length": F.length(F.array_join("clauses", ""))})
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("n", "length", F.array_join("clauses", "\n"))))


def column_maxima(table: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """Q12: for each metric the row (by order) of its largest value, the first on ties. An aggregate, so nothing is sorted."""
    best = [F.max_by(F.struct(F.col(order).alias("row"), F.col(m).cast("double").alias("value")), F.struct(F.col(m), F.negative(F.col(order)))).alias(m) for m in metrics]
    one = table.agg(*best)
    return one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.row").alias("row"), F.col(f"{m}.value").alias("value")) for m in metrics])).alias("x")).select("x.*")


def replay_gate(done: Column, expected: Column, success: Column) -> Column:
    """Q8: a rate that stays null until all expected rows are there."""
    return F.when(done == expected, F.try_divide(success.cast("double"), expected.cast("double")))


def verified(syntax: Column, invariants: Column, target: Column) -> Column:
    """Q3: right if the syntax is, every invariant is proved, and the target is, where there is one."""
    return F.coalesce(syntax, F.lit(False)) & F.coalesce(F.forall(invariants, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)) & F.coalesce(target, F.lit(True))


def tool_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Q7: rows, completed and failed ones, verified, and means of tokens (all, and exactly counted ones) and seconds over the rows that have them. rows: generation_status, verified, total_tokens, token_accounting, generation_seconds."""
    exact = F.when(F.col("token_accounting") == "exact", F.col("total_tokens"))
    status = lambda v: F.count_if(F.col("generation_status") == v).alias(v)
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), status("completed"), status("failed"), F.count_if("verified").alias("verified"), F.avg("total_tokens").alias("mean_total_tokens"), F.count("total_tokens").alias("token_rows"),
        F.avg(exact).alias("mean_exact_total_tokens"), F.count(exact).alias("exact_token_rows"), F.avg("generation_seconds").alias("mean_generation_seconds"), F.count("generation_seconds").alias("time_rows"),
    )
