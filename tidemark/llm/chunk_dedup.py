"""Exact deduplication by content-defined chunk recipes.

Each task cuts its texts into chunks where a rolling hash of the last 32 bytes says so, and sends on only a
recipe: two digests and the length of every chunk. The chunks are deduplicated over the whole corpus to
identifiers (a 64-bit digest and a number that tells apart chunks of equal digest but different SHA-256 or
length), and two texts are equal if their ordered identifier lists are. No text is moved.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat, numbered, staged

LEAST, MASK, MOST, WINDOW = 512, 0x3FF, 8192, 32
_GEAR = np.random.default_rng(20240531).integers(0, 2**32, 256, dtype=np.uint32)


def cut_candidates(raw: np.ndarray, begin: int, end: int, step: int = 1 << 20) -> np.ndarray:
    """The positions in raw[begin:end] after which the rolling hash allows a cut; works in windows of step bytes."""
    found = []
    for lo in range(begin, end, step):
        at, hi = max(begin, lo - WINDOW + 1), min(end, lo + step)
        h, width = _GEAR[raw[at:hi]], 1
        while width < WINDOW:
            wider = h.copy()
            wider[width:] += h[:-width] << np.uint32(width)
            h, width = wider, 2 * width
        found.append(np.flatnonzero((h[lo - at :] >> np.uint32(16)) & np.uint32(MASK) == 0) + lo + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(begin: int, end: int, candidates: list[int]) -> list[int]:
    """Where the chunks of one text end; depends on its bytes alone."""
    ends, at, k = [], begin, 0
    while at < end:
        k = bisect_left(candidates, at + LEAST, k)
        at = min(candidates[k] if k < len(candidates) else end, at + MOST, end)
        ends.append(at)
    return ends


_RECIPE = "row_id long, doc_id {id}, text_sha256 string, chunks array<struct<fp:long,len:int,sha:binary>>"
_CHUNKS = pa.list_(pa.struct([("fp", pa.int64()), ("len", pa.int32()), ("sha", pa.binary())]))


def _recipes(batches):
    for batch in batches:
        raw, ends = flat(batch.column(2))
        candidates = cut_candidates(raw, int(ends[0]), int(ends[-1])) if len(ends) > 1 else np.zeros(0, np.int64)
        splits = np.searchsorted(candidates, ends)
        data, shas, fps, lens, which, offsets = memoryview(raw), [], [], [], [], [0]
        for i in range(len(ends) - 1):
            begin, end = int(ends[i]), int(ends[i + 1])
            shas.append(hashlib.sha256(data[begin:end]).hexdigest())
            for stop in chunk_ends(begin, end, candidates[splits[i] : splits[i + 1]].tolist()):
                part = data[begin:stop]
                fps.append(xxhash.xxh64_intdigest(part))
                lens.append(stop - begin)
                which.append(hashlib.sha256(part).digest())
                begin = stop
            offsets.append(len(fps))
        parts = pa.StructArray.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(lens, pa.int32()), pa.array(which, pa.binary())], ["fp", "len", "sha"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts, type=_CHUNKS)], ["row_id", "doc_id", "text_sha256", "chunks"])


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row_id, doc_id, text_sha256, chunks) of every row, staged. row_id tells repeated rows apart; it is the column row if there is one."""
    slim = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return staged(slim.mapInArrow(_recipes, _RECIPE.format(id=slim.schema["doc_id"].dataType.simpleString())), "recipes")


def chunk_store(made: DataFrame) -> DataFrame:
    """(fp, nth, len, sha, uses): one row per distinct chunk of the recipes; (fp, nth) is its verified identifier."""
    used = made.select(F.explode("chunks").alias("c")).groupBy("c.fp", "c.len", "c.sha").agg(F.count("*").alias("uses"))
    alike = used.groupBy("fp").agg(F.sort_array(F.collect_list(F.struct("len", "sha", "uses"))).alias("same"))
    return alike.select("fp", F.posexplode("same").alias("nth", "c")).select("fp", "nth", "c.len", "c.sha", "c.uses")


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Per row of docs: row_id, doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the largest doc_id is kept (a null id is the smallest; of rows that repeat
    an id with the same text, the first read). A null text counts as empty, and empty texts are equal.
    An empty table gives no rows. Other columns of docs are not read. row: a column that numbers the rows.
    """
    made = recipes(docs, doc_id, text, row)
    uses = made.select("row_id", F.posexplode("chunks").alias("seq", "c")).select("row_id", "seq", "c.fp", "c.len", "c.sha")
    known = uses.hint("merge").join(chunk_store(made).drop("uses"), ["fp", "len", "sha"])
    lists = known.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("seq", "fp", "nth"))).alias("l"))
    lists = lists.select("row_id", F.transform("l", lambda x: F.struct(x["fp"].alias("fp"), x["nth"].alias("nth"))).alias("recipe"))
    none = F.array().cast("array<struct<fp:bigint,nth:int>>")
    rows = made.select("row_id", "doc_id", "text_sha256", F.size("chunks").alias("n_chunks")).join(lists, "row_id", "left")
    rows = staged(rows.withColumn("recipe", F.coalesce("recipe", none)).withColumn("digest", F.xxhash64("recipe")), "lists")
    groups = rows.groupBy("digest", "recipe").agg(F.max(F.struct("doc_id", (-F.col("row_id")).alias("back"))).alias("top"), F.count("*").alias("group_size"))
    out = rows.hint("merge").join(groups, ["digest", "recipe"])
    return out.select("row_id", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == -F.col("top.back")).alias("kept"), "text_sha256", "n_chunks")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that find_copies keeps, with their columns, whatever their names.

    Null texts count as empty, and of all empty ones one row stays; an empty table gives no rows.
    """
    rows, row = numbered(docs)
    kept = find_copies(rows, doc_id, text, row).where("kept").select(F.col("row_id").alias(row))
    return rows.hint("merge").join(kept, row, "left_semi").drop(row)


def op2(spark, sf_dir):
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id", "n_chunks")


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
