"""Writers (R3, R9, R12-R14, Q9)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet or JSON lines, by extension; a folder of part files."""
    w = df.write.mode(mode)
    w.parquet(path) if path.rstrip("/").endswith(".parquet") else w.json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    """Rows added to a ledger; readers take the latest of each key."""
    write_rows(df, path, "append")


def replace(df: DataFrame, path: str) -> None:
    """Written beside the target, which is then swapped by renames; readers see the old table or the new one."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tag = uuid.uuid4().hex
    new, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    (df.write.parquet if ".parquet" in path.rsplit("/", 1)[-1] else df.write.json)(new)
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(conf)
    had = fs.exists(p(path))
    if had and not fs.rename(p(path), p(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(p(new), p(path)):
        if had:
            fs.rename(p(old), p(path))
        raise OSError(f"cannot move {new}")
    if had:
        fs.delete(p(old), True)


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "error") -> None:
    """The fields in order, missing ones empty, others left out; nested values as JSON."""
    kinds = dict(df.dtypes)
    nested = lambda t: t.startswith(("array", "map", "struct"))
    cols = [F.lit(None).cast("string").alias(f) if f not in kinds else F.to_json(f).alias(f) if nested(kinds[f]) else F.col(f) for f in fields]
    df.select(*cols).write.mode(mode).option("header", True).csv(path)


def write_by_method(df: DataFrame, path: str, method: str = "method") -> None:
    """Q9: a folder for each method."""
    df.write.partitionBy(method).parquet(path)


def with_content_digest(df: DataFrame, columns: list[str], out: str = "content_sha256") -> DataFrame:
    """A digest of a row's content."""
    return df.withColumn(out, F.sha2(F.to_json(F.struct(*columns)), 256))
