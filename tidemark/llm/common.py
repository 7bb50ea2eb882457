"""What the operators of this subpackage share: the scratch folder, staged tables, words, label folds."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word in every operator here: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; unset, on a local master (as in tests), below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and its row ids stay as they are."""
    spark = df.sparkSession
    df.write.parquet(path := scratch(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Deletes the folders of staged frames that nothing needs any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer referred to; it does so when the JVM collects garbage, a second time for what the first one has let go."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, and the number's column (a name that docs doesn't have). It is staged, so that a row read again has the same number, however the files are split by then."""
    row = "row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, skip: int, at_most: int) -> DataFrame:
    """(doc_id, text, y) of up to at_most labelled documents whose fold of n is not skip: those with the smallest md5 of their id.

    Of labels that conflict the largest counts, of rows that repeat an id the one with the least text.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.where(fold(F.col("doc_id"), n) != skip).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(at_most)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).select("doc_id", "text", "y")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and where each row begins (one more at the end); nulls are empty."""
    column = pc.fill_null(column, "") if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, ends


class HashOf(dict):
    """hash_of[word]: kept for words seen before, until there are too many."""

    def __init__(self, make, at_most: int = 400_000):
        super().__init__()
        self.make, self.at_most = make, at_most

    def __missing__(self, word):
        if len(self) >= self.at_most:
            self.clear()
        self[word] = out = self.make(word)
        return out
