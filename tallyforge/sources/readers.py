"""Readers (R1, R2, R4-R11, R15, R16)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, tolerant: bool = False) -> DataFrame:
    """Blank lines are skipped, a malformed one fails the read; R2 (tolerant): malformed lines are skipped. .gz is read as it is."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def wanted_items(spark: SparkSession, path: str, schema: str, wanted: list[int]) -> DataFrame:
    """The items of a JSON array file at the positions wanted (from 0), with `pos`. Only they leave the reader's task."""
    items = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{_fields(schema)}>>")).alias("pos", "item"))
    return items.where(F.col("pos").isin(wanted)).select("pos", "item.*")


def _fields(schema: str) -> str:
    from pyspark.sql import types as T

    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


def read_records(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """R1, R4 by extension; columns prunes the scan."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_jsonl(spark, path, schema)
    return df.select(*columns) if columns else df


def read_rollout_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rollouts are Python literals of lists, which only Python reads right."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)

    @F.pandas_udf("array<array<string>>")
    def parsed(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield x.map(lambda v: None if v is None else [[str(c) for c in r] for r in ast.literal_eval(v)])

    return df.withColumn("rollouts", parsed("rollouts"))


def read_sources(spark: SparkSession, path: str | list[str], pattern: str = "*.c", recursive: bool = True) -> DataFrame:
    """One row a file: suite (its folder), case_id, source, digest; each path once. Order by (suite, case_number, case_id)."""
    df = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    stem = F.regexp_extract(file, r"([^/]+)\.[^./]+$", 1)
    out = df.select(file.alias("path"), F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("suite"), stem.alias("case_id"), stem.try_cast("int").alias("case_number"), F.col("value").alias("source"))
    return out.dropDuplicates(["path"]).withColumn("source_sha256", F.sha2("source", 256))


def checked_count(df: DataFrame, expected: int) -> DataFrame:
    """Df, whose read fails unless it has `expected` rows."""
    n = df.agg(F.count("*").alias("_n"))
    held = F.when(F.col("_n") == expected, True).otherwise(F.raise_error(f"expected {expected} rows").cast("boolean"))
    return df.crossJoin(F.broadcast(n)).where(held).drop("_n")  # one row


def corpus_digest(files: DataFrame, path: str = "path", digest: str = "source_sha256") -> str:
    """One digest of (path, digest) in path order. The list of files (not their texts) comes to the driver in parts."""
    import hashlib

    h = hashlib.sha256()
    for p, d in files.select(path, digest).orderBy(path).toLocalIterator():
        h.update(p.encode() + b"\0" + d.encode())
    return h.hexdigest()


def manifest_faults(manifest: DataFrame, samples: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys that one side lacks, and those whose digests differ."""
    m, s = manifest.select(*key, F.col(digest).alias("_m")), samples.select(*key, F.col(digest).alias("_s"))
    j = m.withColumn("_a", F.lit(1)).join(s.withColumn("_b", F.lit(1)), key, "full_outer")
    fault = F.when(F.col("_a").isNull(), "not_in_manifest").when(F.col("_b").isNull(), "no_sample").when(~F.col("_m").eqNullSafe(F.col("_s")), "digest_differs")
    return j.withColumn("fault", fault).where("fault IS NOT NULL").select(*key, "fault")


def latest_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Of each (suite, case) folder pair the summary.json written last."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").json(path)
    f = F.col("_metadata.file_path")
    part = lambda i: F.element_at(F.split(f, "/"), -i)
    d = df.select("*", part(3).alias("suite"), part(2).alias("case_id"), F.col("_metadata.file_modification_time").alias("_at"), f.alias("_path"))
    row = F.struct(*df.columns)
    return d.groupBy("suite", "case_id").agg(F.max_by(row, F.struct("_at", "_path")).alias("row")).select("suite", "case_id", "row.*")


def adapted(layouts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Foreign layouts brought to one: for each, the columns by name; what one lacks is null."""
    out = None
    for df, columns in layouts:
        d = df.select(*[c.alias(n) for n, c in columns.items()])
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
