"""Selections whose steps depend on earlier ones (C4, C12/N13, U5), and the evaluation index.

The sequential part works on counts or on one row an item with its short keys, never on texts: quotas on a table of
cells and shapes, caps on (family, broad family) keys in order. Items join the outcome back by id.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ROUNDS = 8


class Shelf:
    """What a cell still has of each shape, the shapes in the order of their best item; no shape gives more than `cap` over all cells."""

    def __init__(self, supply: dict[str, int], used: Counter, cap: int | None):
        self.left, self.used, self.cap = dict(supply), used, cap

    def draw(self, want: int) -> list[str]:
        """Shapes of the items drawn: in turns, one of each shape that has any, until there are enough or none is left."""
        out: list[str] = []
        while len(out) < want:
            ready = [s for s, n in self.left.items() if n and (self.cap is None or self.used[s] < self.cap)][: want - len(out)]
            if not ready:
                break
            for s in ready:
                self.left[s] -= 1
                self.used[s] += 1
            out += ready
        return out


def drawn(demand: dict[str, int], supply: dict[str, dict[str, int]], total: int, cap: int | None = None) -> dict[str, list[str]]:
    """C4: for each cell the shapes of the items it gives, in order; supply: cell -> shape -> items, both in order.

    A round plans what is left of total by the demand of the cells that still had enough, one for each at least; cells
    that cannot give it are out. Items chosen count against their shape's cap, others do not.
    """
    used: Counter = Counter()
    shelves = {c: Shelf(shapes, used, cap) for c, shapes in supply.items() if demand.get(c, 0) > 0}
    out: dict[str, list[str]] = {c: [] for c in shelves}
    open_, left = list(shelves), total
    for _ in range(ROUNDS):
        weight = sum(demand[c] for c in open_)
        plan = {c: max(1, round(left * demand[c] / weight)) for c in open_} if left > 0 else {}
        got = {c: shelves[c].draw(n) for c, n in plan.items()}
        for c, shapes in got.items():
            out[c] += shapes
        left -= sum(map(len, got.values()))
        open_ = [c for c in open_ if len(got.get(c, ())) >= plan.get(c, 0)]
        if not any(got.values()):
            break
    for c in out:  # one for each cell at least may have come to more than total
        out[c], total = out[c][:total], max(0, total - len(out[c]))
    return out


def quotas(demand: dict[str, int], supply: dict[str, int], total: int) -> dict[str, int]:
    """C4 without shapes: how many items each cell gives."""
    got = drawn(demand, {c: {"": n} for c, n in supply.items()}, total)
    return {c: len(got.get(c, ())) for c in demand}


def quota_select(pool: DataFrame, demand: DataFrame, cell: str, shape: str, order: str, total: int, shape_cap: int, priority: Column | None = None) -> DataFrame:
    """C4: rows of pool chosen by cell quota, in turns over a cell's shapes, no shape chosen more than shape_cap times in all.

    Items of a (cell, shape) are taken by priority, larger first, then order. Only the counts of those pairs (cut to
    what a pair can give) are worked through in sequence, in one task; items are ranked and joined with the outcome.
    """
    best = F.lit(0.0) if priority is None else priority.cast("double")
    items = pool.withColumn("_best", best)
    rank = Window.partitionBy(cell, shape).orderBy(F.desc("_best"), order)
    items = items.withColumn("_turn", F.row_number().over(rank)).where(F.col("_turn") <= min(shape_cap, total))
    want = demand.groupBy(F.col(cell).alias("_cell")).agg(F.count("*").alias("_want"))
    first = pool.groupBy(F.col(cell).alias("_cell")).agg(F.min(order).alias("_first"))
    pairs = items.groupBy(F.col(cell).alias("_cell"), F.col(shape).alias("_shape")).agg(F.count("*").alias("n"), F.max("_best").alias("best"))
    pairs = pairs.join(want, "_cell").join(first, "_cell")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(it)
        if parts:
            t = pd.concat(parts)
            t = t.assign(turned=-t["best"]).sort_values(["_first", "_cell", "turned", "_shape"])
            supply: dict[str, dict[str, int]] = {}
            for c, s, n in zip(t["_cell"], t["_shape"], t["n"], strict=True):
                supply.setdefault(c, {})[s] = n
            got = drawn(dict(zip(t["_cell"], t["_want"], strict=True)), supply, total, shape_cap)
            rows = [(c, s, n) for c, shapes in got.items() for s, n in Counter(shapes).items()]
            yield pd.DataFrame(rows, columns=["_cell", "_shape", "_taken"])

    kinds = dict(pool.dtypes)
    taken = pairs.coalesce(1).mapInPandas(run, f"_cell {kinds[cell]}, _shape {kinds[shape]}, _taken int")
    chosen = items.join(taken, items[cell].eqNullSafe(taken["_cell"]) & items[shape].eqNullSafe(taken["_shape"]))
    return chosen.where("_turn <= _taken").select(*pool.columns)


def capped_families(items: DataFrame, family: str, broad: str, order: str, cap: int = 3, broad_cap: int = 8, multiple: int = 1) -> DataFrame:
    """In order, items whose family and broad family have room; then floored to a multiple.

    A broad family decides alone, so broad families are worked on apart from each other, each as a stream of keys.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, n = None, Counter(), 0
        for pdf in it:
            keep = []
            for b, f in zip(pdf[broad], pdf[family], strict=True):
                if b != now:
                    now, used, n = b, Counter(), 0
                ok = n < broad_cap and used[f] < cap
                keep.append(ok)
                if ok:
                    n += 1
                    used[f] += 1
            yield pdf[keep]

    d = items.repartition(broad).sortWithinPartitions(broad, order).mapInPandas(run, items.schema)
    if multiple == 1:
        return d
    n = d.count() // multiple * multiple
    return d.orderBy(order).limit(n)


def levels_first(items: list[dict], levels: list[str]) -> list[dict]:
    """In order, items that share no level's key with one kept before. For one batch of generated programs; first_at_levels is the same for a table."""
    seen: dict[str, set] = defaultdict(set)
    out = []
    for i in items:
        if not any(i[v] in seen[v] for v in levels):
            out.append(i)
            for v in levels:
                seen[v].add(i[v])
    return out


def first_at_levels(items: DataFrame, levels: list[str], order: str) -> DataFrame:
    """Items, in order, that share no level's key with an item kept before; order is unique.

    In rounds: an item that comes first among the undecided ones at every level is kept, as all that came before it are
    out; those that share a key with it are out then. Each round is written to the folder of spark.checkpoint.dir.
    """
    key = items.select(F.col(order).alias("o"), *[F.col(v).alias(f"k{i}") for i, v in enumerate(levels)])
    names = [f"k{i}" for i in range(len(levels))]
    kept, left = None, key.checkpoint()
    while left.limit(1).count():
        now = left
        for k in names:
            now = now.withColumn(f"f{k}", F.min("o").over(Window.partitionBy(k)))
        first = F.lit(True)
        for k in names:
            first = first & (F.col(f"f{k}") == F.col("o"))
        new = now.where(first).select("o", *names).checkpoint()
        kept = new.select("o") if kept is None else kept.union(new.select("o"))
        for k in names:
            left = left.join(new.select(k), left[k].eqNullSafe(new[k]), "left_anti")
        left = left.checkpoint()
    return items.limit(0) if kept is None else items.join(kept, items[order] == kept["o"], "left_semi")


def assess(items: DataFrame, index: DataFrame, levels: list[str], key: str = "id") -> DataFrame:
    """The strongest level (first of `levels`) at which an item shares a key with the index; index: level, key."""
    rank = F.create_map(*[F.lit(x) for i, v in enumerate(levels) for x in (v, i)])
    long = items.select(key, F.explode(F.array(*[F.struct(F.lit(v).alias("level"), F.col(v).alias("k")) for v in levels])).alias("x")).select(key, "x.level", "x.k")
    hit = long.join(index.select("level", F.col("key").alias("k")).distinct(), ["level", "k"], "left_semi")
    best = hit.groupBy(key).agg(F.min_by("level", F.element_at(rank, F.col("level"))).alias("level"))
    return items.select(key).join(best, key, "left")


def vote(neighbours: DataFrame, strata: DataFrame, key: str = "id") -> DataFrame:
    """The stratum that an item's neighbours (id, stratum, similarity) speak for, each weighing similarity over its stratum's size."""
    v = neighbours.join(strata.withColumnRenamed("n", "_n"), "stratum").groupBy(key, "stratum").agg(F.sum(F.col("similarity") / F.col("_n")).alias("w"))
    w = Window.partitionBy(key).orderBy(F.desc("w"), "stratum")
    return v.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, "stratum", F.col("w").alias("weight"))
