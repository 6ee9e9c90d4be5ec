"""What the operators share: table loading, staged tables in the shared folder, words and shingles."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
SHINGLE_WORDS = 5
#: One odd multiplier per word of a shingle, and one seed for sequences shorter than a shingle.
_WEIGHTS = [np.uint64(x * 2 + 1) for x in (0x4F1BBCDCBFA53E0B, 0x1D8E4E27C47D124F, 0x62A9D9ED799705F5, 0x23EB4C1F3A9D5B67, 0x5851F42D4C957F2D)]
_SHORT = np.uint64(0x9E3779B97F4A7C15)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_staged: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes at most, which bounds what a Python worker holds at a time. Smaller settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where a session names none, a temporary one if all runs in this process, else an error: hosts do not share such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tallyforge-')}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors. The shuffle files of the writing go as it ends."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete all staged tables. Call it only when no result that was built on them is still to be computed."""
    while _staged:
        spark, path = _staged.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(release)


class _WordHashes(dict):
    """word -> 64-bit hash; some 40 MB at most, cleared when a task ends."""

    LIMIT = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


@contextlib.contextmanager
def freed() -> Iterator[None]:
    """Around a task's loop in a Python worker, which outlives the task: what it has cached goes back to the system at the end."""
    try:
        yield
    finally:
        _hashes.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A worker's function, with `freed` around it."""

    def released(it: Iterator) -> Iterator:
        with freed():
            yield from run(it)

    return released


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at the six ASCII white-space characters (bytes.split and bytes.lower mean exactly those)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words: the whole sequence as one; none: empty."""
    w = words(text)
    n = len(w)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, n)
    if n < size:
        one = int(_SHORT) * n + sum(int(h[i]) * int(_WEIGHTS[i % 5]) for i in range(n))
        return mix(np.array([one & 0xFFFFFFFFFFFFFFFF], np.uint64))
    total = h[: n - size + 1] * _WEIGHTS[0]
    for i in range(1, size):
        total += h[i : n - size + 1 + i] * (_WEIGHTS[i % 5] + np.uint64(2 * (i // 5)))
    total = mix(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links (a, b): rows (node, comp), comp the smallest node of the component.

    Large-star and small-star steps, each written to the shared folder; only a count reaches the driver.
    Nodes without links are not in the result. Empty links give an empty result.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # each node also keeps a link to its least neighbour
        large = large.union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        moved = new.exceptAll(edges).limit(1).count()
        edges = new
        if not moved:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp"))).groupBy("node").agg(F.min("comp").alias("comp"))


def batches(it: Iterator, text: str) -> Iterator:
    """Cut Arrow batches so that one piece holds at most some 16 MB of text."""
    for pdf in it:
        if not len(pdf):
            continue
        ends = pdf[text].str.len().fillna(0).astype("int64").cumsum().to_numpy() // (16 << 20)
        for _, part in pdf.groupby(ends, sort=False):
            yield part


def keyed(docs: DataFrame, text: str = "text") -> tuple[DataFrame, bool]:
    """docs with _key, a long that is unique and in doc_id order (null last, equal ones by text); whether it is doc_id itself."""
    small_batches(docs.sparkSession)
    repeats = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if not repeats:
        return docs.withColumn("_key", F.col("doc_id").cast("long")), True
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), text)
    return stage(ordered.withColumn("_key", F.monotonically_increasing_id()), "keyed"), False


def packed(docs: DataFrame, *used: str, without: tuple[str, ...] = ()) -> DataFrame:
    """docs as one struct column `rest` (without some), and the columns used: none of docs' names can clash with those that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("rest"), *[F.col(f"`{c}`") for c in used])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of `rest`, some of them changed."""
    return df.select(*[changed.get(c, F.col("rest").getField(c)).alias(c) for c in columns])
