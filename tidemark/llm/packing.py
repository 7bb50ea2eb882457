"""Best-fit-decreasing packing of tokenised texts into sequences.

Texts are tokenised where they are read. Only lengths travel: full pieces are sequences of their own, and the
shorter ones are dealt at random to shards of bounded size. Each shard is packed by best fit decreasing, its
open sequences held in a segment tree over the remaining capacities.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Bytes of text encoded in one go: a word that they repeat is looked up once.
AT_ONCE = 12 << 20
#: Two adjoining characters of white space, as RE2 writes them.
_PAIR = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]{2}"


class Encoder:
    """Token ids, as bytes of little-endian uint32, of texts by a byte-level tokenizers file.

    Its pre-tokenizer never joins what a single space between other characters parts. So a text without
    adjoining white space is encoded word by word, each with the space before it and each distinct one once,
    many in one call: the bytes that each token stands for tell where a word's tokens end. Other texts are
    encoded as a whole. known holds words seen before, at_most of them.
    """

    def __init__(self, path: str, at_most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.at_most = Tokenizer.from_file(path), {}, at_most
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def each(self, texts: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(texts), 500):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 500], add_special_tokens=False)]
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Of " " + word, for words without white space at either end."""
        out = []
        for lo in range(0, len(words), 1000):
            some = words[lo : lo + 1000]
            joined = " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            upto = np.cumsum(self.n_bytes[ids])
            ends = np.cumsum([1 + len(w.encode()) for w in some])
            cuts = np.searchsorted(upto, ends)
            if cuts[-1] + 1 != len(ids) or (upto[cuts] != ends).any():
                out += self.each([f" {w}" for w in some])
                continue
            raw, cuts = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        out = [None] * len(texts)
        odd = pc.match_substring_regex(texts, _PAIR)
        for i, ids in zip(np.flatnonzero(odd), self.each(texts.filter(odd).to_pylist())):
            out[i] = np.frombuffer(ids, "<u4")
        plain = np.flatnonzero(~np.asarray(odd))
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        coded = lists.flatten().dictionary_encode()
        if not len(coded):
            return out
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        starts = np.cumsum(np.r_[0, pc.list_value_length(lists).to_numpy()])
        known = self.known
        found = [known.get(n) for n in names]
        new = [k for k, x in enumerate(found) if x is None]
        inner = [k for k in new if names[k] and not names[k][0].isspace() and not names[k][-1].isspace()]
        edges = [k for k in new if not names[k] or names[k][0].isspace() or names[k][-1].isspace()]
        for k, ids in [*zip(inner, self.words([names[k] for k in inner])), *zip(edges, self.each([f" {names[k]}" for k in edges]))]:
            found[k] = ids
            if len(known) < self.at_most:
                known[names[k]] = ids
        first = np.zeros(len(index), bool)
        first[starts[:-1]] = True  # the first word of a text has no space before it
        begun, nth = np.unique(index[first], return_inverse=True)
        index = index.copy()
        index[first] = len(names) + nth
        found += self.each([names[k] for k in begun])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(np.r_[0, sizes])
        sizes = sizes[index]
        ends = np.cumsum(np.r_[0, sizes])
        tokens = flat[np.repeat(at[index] - ends[:-1], sizes) + np.arange(ends[-1])]
        for k, i in enumerate(plain):
            out[i] = tokens[ends[starts[k]] : ends[starts[k + 1]]]
        return out


def piece_bounds(n: int, most: int) -> list[int]:
    """Where the pieces of n tokens begin and end: the first is the shorter one."""
    return [0, *range(n % most or most, n + 1, most)]


def runs_of(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Where rows of these sizes are cut, so that no run of two rows or more has more than `most` together."""
    upto, out, lo = np.cumsum(sizes, dtype=np.int64), [], 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        out.append((lo, hi))
        lo = hi
    return out


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """A Python worker's encoder: tasks that follow each other in it share the file that is read and the words that are known."""
    return Encoder(path)


def _tokenise(path: str, end_id: int, most: int):
    def run(batches):
        encoder = encoder_of(path)
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False)
            for lo, hi in runs_of(sizes, AT_ONCE):
                batch = whole.slice(lo, hi - lo)
                texts = pc.fill_null(batch.column(1), "")
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(encoder.encode(texts)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    bounds = piece_bounds(len(ids), most)
                    for k in range(len(bounds) - 1):
                        rows.append(i), piece.append(k), start.append(bounds[k]), length.append(bounds[k + 1] - bounds[k])
                        crc.append(zlib.crc32(ids[bounds[k] : bounds[k + 1]].tobytes()))
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(lengths: list[int], most: int) -> tuple[list[int], list[int], int]:
    """(bin, offset) of each length, which fall, and how many bins: each goes to the fullest bin that has room.

    The leaves of the tree are the remaining capacities 0 to most, and a node holds how many open bins lie
    below it. The tightest fit is the first leaf at or after the length that isn't empty: up from the leaf
    until a right neighbour has bins, then down to its first.
    """
    width = 1 << most.bit_length()
    tree, open_ = [0] * (2 * width), [[] for _ in range(most + 1)]
    bins, offsets, n = [], [], 0

    def add(leaf: int, k: int) -> None:
        at = leaf + width
        while at:
            tree[at] += k
            at >>= 1

    for length in lengths:
        at = length + width
        while not tree[at]:
            while at & 1:
                at >>= 1
            if not at:
                break
            at += 1
        if tree[at] and at:
            while at < width:
                at = 2 * at if tree[2 * at] else 2 * at + 1
            room = at - width
            b = open_[room].pop()
            add(room, -1)
        else:
            room, b, n = most, n, n + 1
        bins.append(b)
        offsets.append(most - room)
        if room > length:
            open_[room - length].append(b)
            add(room - length, 1)
    return bins, offsets, n


def _pack(most: int):
    def run(key, table):
        table = table.sort_by([("length", "descending"), ("row_id", "ascending"), ("piece", "ascending")])
        bins, offsets, _ = best_fit(table.column("length").to_pylist(), most)
        shard = key[0].as_py()
        columns = [table.column(c) for c in ("row_id", "doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.table([*columns, pa.array((np.array(bins, np.int64) << 32) + (2 * shard + 1)), pa.array(offsets, pa.int64())], ["row_id", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, most: int = 1024, end_id: int = 2, shard_pieces: int = 20_000) -> DataFrame:
    """Per piece of the texts of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text is its token ids, then end_id; a null or empty text is end_id alone. Only longer texts are cut, into
    pieces of most tokens after a first one that may be shorter. A full piece fills a sequence (an even
    number); the others are packed in random shards of about shard_pieces, numbered (bin << 32) + 2 * shard + 1.
    Rows that repeat a doc_id are packed each for itself. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(_tokenise(tokenizer, end_id, most), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = staged(pieces.withColumn("row_id", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == most).withColumn("sequence_id", F.col("row_id") * 2).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < most)
    shards = max(1, round(short.count() / shard_pieces))
    short = short.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)))
    made = f"row_id long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = short.groupBy("shard").applyInArrow(_pack(most), made)
    return full.select(packed.columns).union(packed).drop("row_id")


def op9(spark, sf_dir):
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(public_tokenizers.path("byte_bpe_50k.json")))
