"""A corpus of documents filtered, deduplicated, mixed and packed: five stages, each read from the last one's Parquet.

Every stage takes the rows that the one before it kept, with all their columns, whatever their names; the last
returns pieces instead. Null texts count as empty in each, and an empty table stays empty.
"""

from __future__ import annotations

from tidemark.llm import chunk_dedup, mixing, near_dedup, packing, quality_cnn
from tidemark.llm.common import scratch, table


def quality(spark, docs, sf_dir):
    """Documents that the classifier, trained on the labelled ones outside its held-out fold, accepts.

    Rows are judged each for itself, so repeated ones share their verdict. Without labels all rows stay.
    """
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def exact(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id, a null id being the smallest; of rows that repeat it, one. All empty texts are equal."""
    return chunk_dedup.dedup(docs)


def near(spark, docs, sf_dir):
    """Of near-duplicates the row with the smallest doc_id, a null id being the largest; of rows that repeat it, one. Texts without words all stay."""
    return near_dedup.dedup(docs)


def mixture(spark, docs, sf_dir):
    """Each row as often as its source's target takes it; a null source is one of its own, the last. Rows that repeat an id are taken each for itself."""
    return mixing.mixed(docs)


def packed(spark, docs, sf_dir):
    """The pieces of every row, repeats too, in sequences of at most 1024 tokens; an empty text is its end alone."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packed)]

#: The first stage scores with a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pieces that the last stage makes of the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(path := scratch(spark, f"pipeline-{name}"))
            docs = spark.read.parquet(path)
    return docs
