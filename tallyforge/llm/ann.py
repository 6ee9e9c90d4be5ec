"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors on a few random orthogonal directions, squeezes and shifts the coordinates, and orders
the vectors by their place on a Hilbert curve through those. All curves are range-partitioned by (curve, place) in one
go, which numbers the vectors along each curve. A curve is cut into slices of BLOCK vectors; a query meets the vectors
of its own and both neighbouring slices of every curve. What the curves find is merged and ranked by the exact
distance in double precision.

Reading outward: where the curves do not agree, a query's slices grow GROWTH-fold and it reads again. The stopping rule
takes the curves as independent looks at the same neighbours, as in capture and recapture: if each neighbour is met by
a curve with chance p, those that are met at all are met c * p / (1 - (1 - p)^c) times in the mean. A query stops when
the mean over its k nearest so far reaches the number that belongs to a share of FOUND met at all, or when its slices
cover the curves. Vectors in clusters stop in the first round, so that the work for a query does not grow with the
rows. Vectors without clusters, as in the test tables, have neighbours that are hardly nearer than the rest; there
the slices grow with the rows, and so does the work for a query. `compared` says how many vectors a query met.

Equal vectors are one point of the index, kept with its k + 1 smallest ids (enough for any answer, as a query leaves
out its own id only), so copies, however many, make no large group.

Fitted: centre and spread of the projections, on the SAMPLE points with the smallest hash of their id. All rows are
indexed.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id and
vectors whose length is not the most common one (of equally common ones, the largest). Vectors of any length are
taken whole. Ties go to the smaller id. Repeated rows (same id and vector) count once. Fewer candidates than k: all of
them. No rows: no rows. Columns other than vec_id and embedding are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import releasing, stage

CURVES, BLOCK, DIMS, BITS, SAMPLE = 16, 256, 8, 4, 10_000
#: How much larger slices become from round to round: each round sends every vector once a curve, so few rounds are worth some overshoot.
GROWTH = 4
#: Share of the neighbours that the curves together shall have met.
FOUND = 0.95


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integers below 2**bits (dims * bits at most 63)."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(on, below, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip[(x[-1] >> level & 1) != 0] ^= (1 << level) - 1
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | (x[i] >> level & 1)
    return place


class Curves:
    """Random projections with their centre and spread, and each curve's shift."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.bits, self.dims = bits, min(dims, width)
        self.axes = [np.linalg.qr(rng.normal(size=(width, self.dims)))[0] for _ in range(curves)]
        self.shift = rng.uniform(0, 0.5, (curves, self.dims))
        seen = [sample @ a for a in self.axes]
        self.centre = [s.mean(0) for s in seen]
        self.spread = [np.maximum(s.std(0), 1e-12) for s in seen]

    def place(self, curve: int, x: np.ndarray) -> np.ndarray:
        z = np.tanh(0.8 * (x @ self.axes[curve] - self.centre[curve]) / self.spread[curve])
        cell = (((z + 1) / 4 + self.shift[curve]) * (1 << self.bits)).astype(np.int64)
        return hilbert(np.clip(cell, 0, (1 << self.bits) - 1), self.bits)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _along(curves) -> object:
    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = curves.value
        for batch in it:
            if len(batch):
                x = _matrix(batch.column("vec"))
                for i in range(len(c.axes)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(c.place(i, x)), batch.column("uid")], names=["curve", "place", "uid"])

    return run


def _numbered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in it:
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), part, np.int32)), pa.array(np.arange(n, n + len(batch))), batch.column("uid")], names=["part", "at", "uid"])
        n += len(batch)


def _nearest(k: int):
    """Rows (curve, slice, query, uid, vec), sorted, a slice's queries first -> the k nearest to each query in the slice."""

    class Search:
        def __init__(self) -> None:
            self.ids, self.x, self.sealed = [], [], False
            self.found = tuple(np.empty(0, t) for t in (np.int64, np.float64, np.int64))

        def query(self, uid: int, x: np.ndarray) -> None:
            self.ids.append(uid), self.x.append(x)

        def candidates(self, uids: np.ndarray, y: np.ndarray) -> None:
            if len(self.ids) == 0:
                return
            if not self.sealed:
                self.ids, self.x, self.sealed = np.array(self.ids), np.array(self.x), True
                self.norms, self.reach = (self.x**2).sum(1), np.full(len(self.x), np.inf)
            for at in range(0, len(self.ids), 1024):
                x, part = self.x[at : at + 1024], slice(at, at + 1024)
                norms = (y**2).sum(1)
                rough = self.norms[part, None] + norms[None] - 2 * x @ y.T
                slack = 1e-9 * (self.norms[part].max() + norms.max())
                limit = np.minimum(self.reach[part], np.partition(rough, k - 1, 1)[:, k - 1] if rough.shape[1] > k else np.inf)
                q, c = np.nonzero(rough <= limit[:, None] + slack)
                exact = np.sqrt(((x[q] - y[c]) ** 2).sum(1))
                self._merge(q + at, exact, uids[c])
            return

        def _merge(self, q: np.ndarray, d: np.ndarray, uid: np.ndarray) -> None:
            q, d, uid = (np.concatenate(z) for z in zip(self.found, (q, d, uid), strict=True))
            order = np.lexsort((uid, d, q))
            q, d, uid = q[order], d[order], uid[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = rank < k
            self.found = q[keep], d[keep], uid[keep]
            full = rank == k - 1
            self.reach[q[full]] = d[full] ** 2

        def result(self) -> pa.RecordBatch:
            q, d, uid = self.found
            ids = np.asarray(self.ids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[q] if len(q) else q), pa.array(uid), pa.array(d)], names=["query", "uid", "d"])

    @releasing
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, search = None, Search()
        for batch in it:
            if not len(batch):
                continue
            x, uid, query = _matrix(batch.column("vec")), batch.column("uid").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            key = batch.column("curve").to_numpy() * np.int64(1 << 48) + batch.column("slice").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (query[1:] != query[:-1]))))
            for a, b in zip(cut, [*cut[1:], len(key)], strict=True):
                if key[a] != here:
                    if len(search.found[0]):
                        yield search.result()
                    here, search = key[a], Search()
                if query[a]:
                    for i in range(a, b):
                        search.query(uid[i], x[i])
                else:
                    for at in range(a, b, 4096):
                        search.candidates(uid[at : min(b, at + 4096)], x[at : min(b, at + 4096)])
        if len(search.found[0]):
            yield search.result()

    return run


def enough_looks(curves: int, found: float) -> float:
    """How often a neighbour that was met at all is met in the mean by `curves` looks that together meet the share `found`."""
    return curves * (1 - (1 - found) ** (1 / curves)) / found


def search(vectors: DataFrame, queries: Column, k: int = 10, curves: int = CURVES, block: int = BLOCK, dims: int = DIMS, bits: int = BITS, found: float = FOUND) -> DataFrame:
    """vectors: vec_id, embedding. Returns query_id, rank, vec_id, score, compared for the rows for which `queries` holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"), queries.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vec")))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("compared"))
    rows = rows.where(F.size("vec") == common["n"])
    order = Window.partitionBy("vec").orderBy("vec_id")
    least = rows.select("vec", "vec_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    points = stage(least.groupBy("vec").agg(F.min("vec_id").alias("uid"), F.collect_set("vec_id").alias("ids")).select("uid", "ids", "vec"), "points")
    n = points.count()
    asked = stage(rows.where("asks").select("vec_id", "vec").distinct().join(points.select("uid", "vec"), "vec").select(F.col("vec_id").alias("query_id"), F.col("uid").alias("query")), "asked")

    sample = points.select("vec", "uid").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).toArrow()
    sent = spark.sparkContext.broadcast(Curves(_matrix(sample.column("vec")), curves, dims, bits))
    along = points.select("uid", "vec").mapInArrow(_along(sent), "curve int, place long, uid long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    along = along.repartitionByRange(parts, "curve", "place", "uid").sortWithinPartitions("curve", "place", "uid")
    along = stage(along.mapInArrow(_numbered, "part int, at long, uid long"), "along")
    sizes = along.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    offsets = dict(zip([r["part"] for r in sizes], np.cumsum([0, *(r["n"] for r in sizes)]).tolist(), strict=False))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("part"))
    number = offset + F.col("at")
    placed = along.select("uid", F.floor(number / n).cast("int").alias("curve"), (number % n).alias("at"))
    homes = stage(placed.join(asked.select(F.col("query").alias("uid")).distinct(), "uid", "left_semi"), "homes")

    looks, size, active, results = enough_looks(curves, found), block, None, []
    while True:
        last = (n - 1) // size
        here = homes if active is None else homes.join(active, homes["uid"] == active["query"], "left_semi")
        met = _met(points, placed, here, size, last, n, k, whole=active is None)
        met = stage(met, "met")
        if last <= 1:  # the slices cover the curves
            results.append(met)
            break
        agreed = met.where("uid <> query").groupBy("query").agg(F.avg("curves").alias("looks")).where(F.col("looks") >= looks).select("query")
        agreed = stage(agreed, "agreed")
        results.append(met.join(agreed, "query", "left_semi"))
        active = stage((asked.select("query").distinct() if active is None else active).join(agreed, "query", "left_anti"), "active")
        if not active.limit(1).count():
            break
        size *= GROWTH
    best = results[0]
    for more in results[1:]:
        best = best.union(more)
    best = best.join(points.select("uid", "ids"), "uid").select("query", "d", "compared", F.explode("ids").alias("vec_id"))
    best = asked.join(best, "query").where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return best.select("query_id", F.row_number().over(final).alias("rank"), "vec_id", F.col("d").alias("score"), "compared").where(F.col("rank") <= k)


def _met(points: DataFrame, placed: DataFrame, homes: DataFrame, size: int, last: int, n: int, k: int, whole: bool) -> DataFrame:
    """query, uid, d, curves (how many met it), compared: the k + 1 nearest of what each query meets in slices of `size` vectors, numbered 0 to last. whole: most slices are asked for, so none is looked up first."""
    cut = F.floor(F.col("at") / size).cast("long")
    near = F.explode(F.sequence(F.greatest(F.col("slice") - 1, F.lit(0)), F.least(F.col("slice") + 1, F.lit(last))))
    ask = homes.select("uid", "curve", cut.alias("slice")).select("uid", "curve", near.alias("slice"))
    held = placed.select("uid", "curve", cut.alias("slice"))
    if not whole:
        held = held.join(ask.select("curve", "slice").distinct(), ["curve", "slice"], "left_semi")
    both = held.select("uid", "curve", "slice", F.lit(False).alias("query")).union(ask.select("uid", "curve", "slice", F.lit(True).alias("query"))).join(points.select("uid", "vec"), "uid")
    both = both.repartition("curve", "slice").sortWithinPartitions("curve", "slice", F.col("query").desc(), "uid").select("curve", "slice", "query", "uid", "vec")
    hits = both.mapInArrow(_nearest(k + 1), "query long, uid long, d double").groupBy("query", "uid").agg(F.min("d").alias("d"), F.count("*").alias("curves"))
    order = Window.partitionBy("query").orderBy("d", "uid")
    hits = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    length = F.least(F.lit(size), F.lit(n) - F.col("slice") * size)
    compared = ask.groupBy(F.col("uid").alias("query")).agg(F.sum(length).cast("long").alias("compared"))
    return hits.join(compared, "query").select("query", "uid", "d", "curves", "compared")
