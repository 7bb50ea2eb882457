"""Cutting the lineage of frames that loops refine."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

#: Bytes: what the rows of a table may take where their file would be broadcast; the file that Spark broadcasts; the file whose rows aren't counted.
MOST, LIMIT, SMALL = 32 << 20, 10 << 20, 256 << 10


def crowded(table: DataFrame, path: str) -> bool:
    """Whether the file of a table is small enough to be broadcast, were two of its columns read, and its rows are not: sorted keys and repeated values take next to nothing in a file and their full width in memory."""
    spark, width = table.sparkSession, 8 * (1 + len(table.columns))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return SMALL < size <= LIMIT * max(width / 24, 1) and table.count() * width > MOST


def cut(df: DataFrame) -> DataFrame:
    """df written to a new table in the shared folder that spark.checkpoint.dir names, and read again; unset, on a local master (as in tests), in a temporary one.

    A table tells the planner its size. A checkpoint would keep the estimates of its plan, which multiply from one
    round of a loop to the next. A file that says too little (crowded) is written once
    more without compression, lest the planner broadcast what the driver can't hold.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    df.write.parquet(path := f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}")
    table = spark.read.schema(df.schema).parquet(path)
    if crowded(table, path):
        table.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path := f"{path}-plain")
        table = spark.read.schema(df.schema).parquet(path)
    return table
