"""Session settings that the operators assume."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", partitions: int = 8, **more: str) -> SparkSession:
    """A session for tests and scripts; on a cluster the submit command sets master and partitions."""
    b = SparkSession.builder.master(master).appName("tallyforge").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    for k, v in (SETTINGS | more).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoints(spark: SparkSession) -> None:
    """Have checkpoint() write to the folder of spark.checkpoint.dir; to one of this machine only where none is named and all runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='tallyforge-')}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
