"""Near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A signature has 64 slots of 16 bits; the distance of two is the number of slots in which they differ. It is
split into 16 chunks of 4 slots. By pigeonhole, signatures at most 31 slots apart have a chunk with at most
one error, and enumerating that error (leaving out one slot of the chunk) turns the search into equality of
16 * 4 keys, so every pair within that distance shares a key. At a similarity of 0.75 a slot differs with
probability 0.25, and more than 31 of 64 do for about one pair in 100,000.

Texts with equal shingle sets are one node. First each node is compared with one other only, the least that
shares a key with it. Then the nodes of a key that this leaves in different components are compared by their
signatures, in blocks of a key, but those of its largest component only with the others; those with a close partner get their full shingle sets, each once for
each block, and are compared on them. Only links leave a task, not pairs, and none inside a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HashOf, flat, numbered, release, staged
from tidemark.llm.graph import components, with_least

SLOTS, SLOTS_IN_CHUNK, ERRORS = 64, 4, 1
CHUNKS = SLOTS // SLOTS_IN_CHUNK
#: The largest distance at which some chunk has at most ERRORS errors.
RADIUS = CHUNKS * (ERRORS + 1) - 1
WORDS, SIMILARITY = 5, 75
BLOCK = 2048
_RANDOM = np.random.default_rng(7919)
_TIMES = _RANDOM.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, SLOTS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, hash_of: HashOf, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles; of fewer words, one for all of them; of none, none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hash_of.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _BASE + h[k : len(h) - width + 1 + k]
    return np.unique(mixed_bits(out))


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, SLOTS) uint16 of non-empty texts whose hashes begin at starts."""
    out = np.empty((len(starts), SLOTS), np.uint16)
    for k in range(SLOTS):
        least = np.minimum.reduceat(hashes * _TIMES[k] + _PLUS[k], starts)
        out[:, k] = mixed_bits(least).astype(np.uint16)
    return out


def _sets_of(batch: pa.RecordBatch, column: int):
    """(row of the batch, its shingle hashes), one after another."""
    raw, ends = flat(batch.column(column))
    data, hash_of = memoryview(raw), HashOf(xxhash.xxh64_intdigest)
    for i in range(len(ends) - 1):
        yield i, shingles(bytes(data[ends[i] : ends[i + 1]]), hash_of)


def _describe(batches):
    for batch in batches:
        keys, sizes, sigs, held, held_at = [], [], [None] * len(batch), [], []

        def sign(held=held, held_at=held_at, sigs=sigs):
            if held:
                starts = np.cumsum([0, *map(len, held[:-1])])
                for i, row in zip(held_at, signatures(np.concatenate(held), starts)):
                    sigs[i] = row.tobytes()
                held.clear(), held_at.clear()

        waiting = 0
        for i, found in _sets_of(batch, 2):
            keys.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            if len(found):
                held.append(found), held_at.append(i)
                waiting += len(found)
            if waiting > 500_000:
                sign()
                waiting = 0
        sign()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["row_id", "doc_id", "set_key", "n_shingles", "sig"])


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, CHUNKS * SLOTS_IN_CHUNK) int64: chunk, slot left out, and the chunk's other slots."""
    parts = sig.reshape(len(sig), CHUNKS, SLOTS_IN_CHUNK).astype(np.int64)
    out = np.empty((len(sig), CHUNKS, SLOTS_IN_CHUNK), np.int64)
    for left in range(SLOTS_IN_CHUNK):
        key = np.arange(CHUNKS, dtype=np.int64) * SLOTS_IN_CHUNK + left
        key = np.broadcast_to(key, (len(sig), CHUNKS))
        for k in range(SLOTS_IN_CHUNK):
            if k != left:
                key = (key << 16) | parts[:, :, k]
        out[:, :, left] = key
    return out.reshape(len(sig), -1)


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def _keys(batches):
    for batch in batches:
        nodes, sig = batch.column(0).to_numpy(), _signs(batch.column(1))
        keys = chunk_keys(sig)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(nodes, keys.shape[1]))], ["key", "node"])


def _close(batches):
    """Pairs (a, b, sig_a, sig_b) whose signatures are at most RADIUS apart."""
    for batch in batches:
        apart = (_signs(batch.column(2)) != _signs(batch.column(3))).sum(1) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(apart <= RADIUS))


def close_in_group(first: np.ndarray, second: np.ndarray, key: int) -> np.ndarray:
    """Of signatures that share key: are they at most RADIUS apart, and is key the first that they share?"""
    same = first == second
    near = (~same).sum(1) <= RADIUS
    good = np.flatnonzero(near)
    wrong = SLOTS_IN_CHUNK - same[good].reshape(len(good), CHUNKS, SLOTS_IN_CHUNK).sum(2)
    chunk, left = (key >> 48) // SLOTS_IN_CHUNK, (key >> 48) % SLOTS_IN_CHUNK
    at = np.argmax(wrong <= ERRORS, 1)
    gap = np.where(wrong[np.arange(len(good)), at] == 0, 0, np.argmin(same[good].reshape(len(good), CHUNKS, SLOTS_IN_CHUNK)[np.arange(len(good)), at], 1))
    near[good] = (at == chunk) & (gap == left)
    return near


def _groups(batches):
    """Tables of the rows of one or more whole (key, i, j), which the batches are sorted by, and where each begins."""
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
        if held is None or not held.num_rows:
            continue
        groups = np.stack([held.column(c).to_numpy() for c in ("key", "i", "j")])
        starts = np.flatnonzero(np.r_[True, (groups[:, 1:] != groups[:, :-1]).any(0)])
        done = held.num_rows if batch is None else int(starts[-1])
        if done:
            starts = starts[starts < done]
            yield held.slice(0, done), groups[:, starts].T.tolist(), np.r_[starts, done]
            held = held.slice(done)


def _within(batches):
    """Of rows (key, i, j, block, node, comp, sig): those with a close signature in another component of the same key."""
    for rows, groups, starts in _groups(batches):
        block, comp = (rows.column(c).to_numpy() for c in ("block", "comp"))
        sig, wanted = _signs(rows.column("sig")), np.zeros(rows.num_rows, bool)
        for (key, i, j), begin, end in zip(groups, starts, starts[1:]):
            for k in range(begin, end - 1):
                rest = np.arange(k + 1, end)
                rest = rest[(comp[rest] != comp[k]) & ((i == j) | (block[rest] != block[k]))]
                rest = rest[close_in_group(np.broadcast_to(sig[k], (len(rest), SLOTS)), sig[rest], key)]
                wanted[rest] = True
                wanted[k] |= len(rest) > 0
        yield from rows.drop_columns(["sig"]).filter(pa.array(wanted)).to_batches()


def _links(batches):
    """Of rows (key, i, j, block, node, comp, hashes): links (a, b) that join all components which similar sets join."""
    for rows, groups, starts in _groups(batches):
        block, node, comp = (rows.column(c).to_numpy() for c in ("block", "node", "comp"))
        sets, a, b = rows.column("hashes").combine_chunks(), [], []
        for (_, i, j), begin, end in zip(groups, starts, starts[1:]):
            part = sets.slice(begin, end - begin)
            at = part.offsets.to_numpy()
            ids = np.unique(part.values.to_numpy()[at[0] : at[-1]], return_inverse=True)[1]
            at = at - at[0]
            size, root, mark = np.diff(at), comp[begin:end].copy(), np.zeros(len(ids), np.int64)
            for k in range(end - begin - 1):
                open_ = (root[k + 1 :] != root[k]) & ((i == j) | (block[begin + k + 1 : end] != block[begin + k]))
                if not open_.any():
                    continue
                mark[ids[at[k] : at[k + 1]]] = 1
                both = np.add.reduceat(mark[ids[at[k + 1] :]], at[k + 1 : -1] - at[k + 1])
                mark[ids[at[k] : at[k + 1]]] = 0
                for r in np.flatnonzero(open_ & (100 * both >= SIMILARITY * (size[k] + size[k + 1 :] - both))) + k + 1:
                    if root[r] != root[k]:
                        root[root == root[r]] = root[k]
                        a.append(node[begin + k]), b.append(node[begin + r])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _then_none(batches):
    yield from batches
    yield None


def _sets(batches):
    for batch in batches:
        parts = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["node", "text"])
        for lo in range(0, len(parts), 500):
            part = parts.slice(lo, 500)
            found = [x for _, x in _sets_of(part, 1)]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64()))], ["node", "hashes"])


def sets_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes, staged. rows: (row_id, text); a node is the row_id of one of its texts."""
    wanted = nodes.select(F.col("node").alias("row_id")).distinct()
    return staged(rows.hint("merge").join(wanted, "row_id", "left_semi").mapInArrow(_sets, "node long, hashes array<long>"), "sets")


def confirm(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    sets = sets_of(rows, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    side = lambda k: sets.select(F.col("node").alias(k), F.col("hashes").alias(f"h{k}"))
    both = pairs.hint("merge").join(side("b"), "b").hint("merge").join(side("a"), "a")
    shared = F.size(F.array_intersect("ha", "hb"))
    return both.where(100 * shared >= SIMILARITY * (F.size("ha") + F.size("hb") - shared)).select("a", "b")


def one_each(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """At most one pair (a, b) for each node b: with the least node a that shares a key with it, if their signatures are close."""
    pairs = members.where("lead != node").groupBy(F.col("node").alias("b")).agg(F.min("lead").alias("a"))
    side = lambda k: sigs.select(F.col("node").alias(k), F.col("sig").alias(f"sig_{k}"))
    pairs = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")
    return staged(pairs.mapInArrow(_close, "a long, b long"), "pairs")


def unsettled(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of the keys whose members are in more than one component, with theirs (comp) and the key's largest (most)."""
    named = members.hint("merge").join(groups, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    several = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    named = staged(named.join(several, "key", "left_semi"), "unsettled")
    most = named.groupBy("key", "comp").agg(F.count("*").alias("n_comp")).groupBy("key").agg(F.max(F.struct("n_comp", "comp")).alias("most"))
    return named.hint("merge").join(most, "key")


def dealt_out(left: DataFrame) -> DataFrame:
    """(key, i, j, block, node, comp, sig): copies of a key's members, so that any two of different components meet in one (i, j).

    Members of the key's largest component aren't compared with each other: they are dealt into blocks of their
    own, each of which meets only the blocks of the other members, so their copies grow with the number of those.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    left = left.withColumn("inside", F.col("comp") == F.col("most.comp"))
    left = left.withColumns({"n_out": blocks(F.col("n") - F.col("most.n_comp")), "n_in": blocks(F.col("most.n_comp"))})
    left = left.withColumn("block", F.when(F.col("inside"), F.col("n_out") + part(F.col("n_in"))).otherwise(part(F.col("n_out"))))
    others = F.when(F.col("inside"), F.col("n_out")).otherwise(F.col("n_out") + F.col("n_in"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return left.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "sig")


def find_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Per row of docs: row_id, doc_id, n_shingles, component_id, first_row.

    component_id is the smallest doc_id that links reach, first_row the row_id of one row that has it. Texts
    without words (null, empty, white space) are linked with nothing, not even each other. Rows that repeat an
    id share its component_id only if their texts are linked; null ids count as the largest. An empty table
    gives no rows; other columns are not read. row: a column that numbers the rows of a staged table; without
    it the texts are staged with their numbers first, as they are read more than once.
    """
    spark = docs.sparkSession
    if row is None:
        docs, row = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
        doc_id, text = "doc_id", "text"
    texts = docs.select(F.col(row).alias("row_id"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    made = f"row_id long, doc_id {texts.schema['doc_id'].dataType.simpleString()}, set_key binary, n_shingles long, sig binary"
    rows = staged(texts.mapInArrow(_describe, made), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")
    nodes = rows.where("n_shingles > 0").groupBy("set_key").agg(F.min("row_id").alias("node"), F.min(order).alias("low"), F.first("sig").alias("sig"))
    nodes = staged(nodes, "nodes")
    sigs = nodes.select("node", "sig")

    keys = sigs.mapInArrow(_keys, "key long, node long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lead")).where("n > 1")
    members = staged(keys.join(shared, "key"), "members")
    del keys, shared
    release(spark)
    texts = texts.select("row_id", "text")
    links = staged(confirm(texts, one_each(members, sigs)), "links")
    release(spark)
    left = dealt_out(unsettled(members, components(links)).hint("merge").join(sigs, "node"))
    dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    left = staged(dealt(left).mapInArrow(_within, "key long, i int, j int, block int, node long, comp long"), "left")
    left = left.hint("merge").join(sets_of(texts, left), "node").select("key", "i", "j", "block", "node", "comp", "hashes")
    groups = components(links.union(dealt(left).mapInArrow(_links, "a long, b long")))
    release(spark)

    named = nodes.join(groups, "node", "left").withColumn("comp", F.coalesce("component", "node")).select("set_key", "comp", "low")
    named = with_least(named, "comp", "low").select("set_key", F.col("least.doc_id").alias("component_id"), F.col("least.row_id").alias("first_row"))
    some = rows.where("n_shingles > 0").drop("sig").hint("merge").join(named, "set_key").select("row_id", "doc_id", "n_shingles", "component_id", "first_row")
    return some.union(rows.where("n_shingles = 0").select("row_id", "doc_id", "n_shingles", "doc_id", "row_id"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, the one with the smallest doc_id, with its columns, whatever their names.

    Texts without words (null, empty) all stay, as they are linked with nothing; an empty table gives no rows.
    """
    rows, row = numbered(docs)
    kept = find_near(rows, doc_id, text, row).where("row_id = first_row").select(F.col("row_id").alias(row))
    return rows.hint("merge").join(kept, row, "left_semi").drop(row)


def op6(spark, sf_dir):
    found = find_near(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
