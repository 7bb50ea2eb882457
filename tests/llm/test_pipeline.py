"""The stages of the pipeline on a small corpus with nulls, ties, repeated rows and clashing names, against plain loops."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, source string, row int, component_id string, row_times array<int>"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of documents without labels, and its rows: copies, near copies, an empty, a null and a repeated one."""
    rnd = random.Random(3)
    make = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    texts = [make(60) for _ in range(30)] + [make(2500)]
    texts += [texts[0], texts[1], texts[2] + " one more", "zero " + texts[3], None, "", " \t ", texts[4]]
    rows = [(i, t, ("a", "b", None)[i % 3], i, "x", [i]) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[6], "a", 0, None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def plain(rows):
    """What exact and near dedup keep: the rows' (doc_id, text), and those after both."""
    best = {}
    for r in rows:
        key = r[1] or ""
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] > best[key][0])):
            best[key] = r
    exact = list(best.values())
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(r[1])) else set() for r in exact]
    group = list(range(len(exact)))
    for i in range(len(exact)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    near = {}
    for r, g in sorted(zip(exact, group), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        near.setdefault(g, r)
    ids = lambda some: Counter((r[0], r[1]) for r in some)
    return ids(exact), ids(near.values())


def test_stages_against_loops(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder)
        if name != "packing":
            assert docs.schema.names == before.schema.names
            docs.write.parquet(path := f"{folder}/{name}.parquet")
            docs = spark.read.parquet(path)
            seen[name] = docs.collect()
    ids = lambda some: Counter((r.doc_id, r.text) for r in some)
    exact, near = plain(rows)
    assert len(seen["quality"]) == len(rows)
    assert ids(seen["exact_dedup"]) == exact and ids(seen["near_dedup"]) == near
    assert set(ids(seen["mixing"])) <= set(near) and max(ids(seen["mixing"]).values()) <= 2
    assert all(r.row is not None and r.row_times == [r.row] for r in seen["mixing"] if r.doc_id is not None)
    pieces = docs.collect()
    assert Counter(r.doc_id for r in pieces if r.piece == 0) == Counter(r.doc_id for r in seen["mixing"])
    room = Counter()
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == room[r.sequence_id]
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 1024


def test_empty_documents(spark, corpus, tmp_path):
    folder, _ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
