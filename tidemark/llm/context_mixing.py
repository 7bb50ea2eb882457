"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words and an end. Each word of the training texts has a binary code, as short as the
word is frequent: a tree over all words, cut at each node where the training counts halve. Every bit of a
text's codes is predicted in several contexts: the node alone (its exact training count), the node after the
last word and after the last two (counts of all training texts, hashed into tables), and the node in what has
been read of this text. Their logits are added up with weights that a gate picks, by the bit's depth and how
sure the last word makes it. Each text refines its own copy of the weights as its bits are read, and every
training text moves those with which the next texts of its block start. A training text is predicted without
what it adds itself to the tables. Words that training texts don't have cost an escape and are spelled in bits
of their bytes, predicted after the last one to three bytes.

Everything grows with the corpus but the hashed tables, whose size is a parameter. Rows are read once, into
blocks of bounded bytes that hold each text as the numbers of its words; blocks meet the codes of their own
words by a shuffle on words, so neither the vocabulary nor its counts are ever held in one place.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat, fold, release, staged, table, unstage

#: log2 of the slots of each hashed table: after one and two words; then, to spell, after one, two and three bytes.
TABLE_BITS = (21, 21, 14, 18, 20)
STARTS = np.cumsum([0, *(1 << b for b in TABLE_BITS)])
#: The node, after one word, after two, in this text, a constant; to spell: in this text, after one byte, two and three, a constant.
INPUTS = 5
#: Gates of a code's bits: by depth, the second half if the last word makes them likely or unlikely; then two to spell with.
DEPTHS = (3, 7, 11, 15)
_GATE_AT = np.searchsorted(DEPTHS, np.arange(256), "left").astype(np.uint8)
CODE_GATES = 2 * (len(DEPTHS) + 1)
GATES = CODE_GATES + 2
#: Weights before any text: of the gates of codes, and of those to spell with.
PRIOR, PRIOR_TO_SPELL = (1.0, 0.35, 0.2, 0.6, 0.1), (0.5, 0.11, 0.17, 0.35, 0.0)
RATE, TEACH, PART = 0.02, 0.04, 1 << 16
#: A text refines its weights when it has read its first bits, then after steps twice as long each, up to STEP.
FIRST, STEP = 64, 2048
PIECE = 12_000  # tokens read at once
SHORT, BITS = 2048, 1 << 14  # bits of texts that are sorted together; bits looked up at once
HISTORY = 18  # log2 of the slots in which a text longer than PIECE keeps what has been read of it
ESCAPE = 20.0  # tokens that the corpus's share of unknown words counts for in each text
END = "\n"  # no word holds it
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def stretch(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)


def log_of_1_and(x: np.ndarray) -> np.ndarray:
    """np.log1p, by the logarithm that has vector instructions: what 1 + x is rounded by is made good."""
    y = 1 + x
    rest = y - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(rest > 0, np.log(y) * (x / rest), x)


_N = np.arange(256)
#: The logit of a slot's (zeros, ones); then without one zero, and without one 1.
_OF_PAIR = np.concatenate([stretch(_N[:, None], _N).ravel(), stretch(np.maximum(_N - 1, 0)[:, None], _N).ravel(), stretch(_N[:, None], np.maximum(_N - 1, 0)).ravel()])
_OF_FEW = stretch(_N[:64, None], _N[:64]).ravel()


# Codes


def prefix_code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each byte's bits begin, their nodes, the bits) of a Huffman code for letters, the space, then other bytes.

    The shares of bytes are assumed, not counted, so that the code is the same for every corpus.
    """
    share = [1.0] * 256
    for k, b in enumerate(b" etaonirshdlucmfgpwybvkxjqz"):
        share[b] = 2000 / (1 + k / 3)
    share[0xC3], share[ord(".")], share[ord(",")] = 300.0, 150.0, 120.0
    heap, parent = [(s, i) for i, s in enumerate(share)], {}
    heapq.heapify(heap)
    for node in range(256, 511):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (node, 0), (node, 1)
        heapq.heappush(heap, (a + b, node))
    starts, nodes, bits = [0], [], []
    for byte in range(256):
        path, at = [], byte
        while at in parent:
            path.append(parent[at])
            at = parent[at][0]
        nodes += [n - 256 for n, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
        starts.append(len(nodes))
    return np.array(starts), np.array(nodes, np.uint32), np.array(bits, np.uint8)


_AT, _NODES, _BITS = prefix_code()
_SIZES = np.diff(_AT)


def quantised(logits: np.ndarray) -> np.ndarray:
    return np.clip(np.round(logits * 16), -127, 127).astype(np.int8)


def halving_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(codes, lengths, logits of a 1 along the way, in sixteenths) of a tree that cuts each set of words where the counts halve."""
    n = len(counts)
    total = np.r_[0, np.cumsum(counts, dtype=np.float64)]
    lo, hi = np.zeros(n, np.int64), np.full(n, n, np.int64)
    code, length, way = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 64), np.int8)
    at = np.arange(n)
    while len(at := at[hi[at] - lo[at] > 1]):
        a, b = lo[at], hi[at]
        middle = (total[a] + total[b]) / 2
        cut = np.clip(np.searchsorted(total, middle), a + 1, b - 1)
        cut -= (cut - 1 > a) & (middle - total[cut - 1] < total[cut] - middle)
        way[at, length[at]] = quantised(np.log((total[b] - total[cut]) / (total[cut] - total[a])))
        right = at >= cut
        code[at] = code[at] * 2 + right
        length[at] += 1
        lo[at], hi[at] = np.where(right, cut, a), np.where(right, b, cut)
    return code, length, [way[i, :k] for i, k in enumerate(length)]


def slice_of(bits: int) -> Column:
    """The slice of a word: the first bits of its hash."""
    return F.pmod(F.xxhash64("word"), F.lit(1 << bits))


def slice_ways(masses: np.ndarray) -> np.ndarray:
    """(slices, bits): the logits, in sixteenths, on the way from the root to each slice of the words."""
    bits = len(masses).bit_length() - 1
    out, which = np.zeros((len(masses), bits), np.int8), np.arange(len(masses))
    for depth in range(bits):
        halves = masses.reshape(2 << depth, -1).sum(1).reshape(-1, 2) + 1e-9
        out[:, depth] = quantised(np.log(halves[:, 1] / halves[:, 0]))[which >> (bits - depth)]
    return out


def _code(ways: np.ndarray):
    def run(key, rows):
        rows, k = rows.sort_by("word"), key[0].as_py()
        code, length, inner = halving_code(rows.column("c").to_numpy())
        bits = ways.shape[1]
        code, way = code + (np.int64(k) << length), [ways[k].tobytes() + w.tobytes() for w in inner]
        # a leading 1 tells codes of different lengths apart
        return pa.table([rows.column("word"), rows.column("c"), pa.array(code + (np.int64(1) << (length + bits))), pa.array(way, pa.binary())], names=["word", "c", "code", "way"])

    return run


# Blocks of texts


def _blocks(most_bytes: int, doc_type: pa.DataType):
    """Rows of two kinds: (block, doc_id, held_out, n_bytes, ids) of a text, and (block, word, i, n) of a word that block's texts have, n times in training ones."""
    names = ["block", "doc_id", "held_out", "n_bytes", "ids", "word", "i", "n"]
    kinds = [pa.int64(), doc_type, pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64()]

    def some(size, **columns):
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, k)).cast(k) for c, k in zip(names, kinds)], names)

    def run(batches):
        from pyspark import TaskContext

        def empty():
            index = defaultdict(count().__next__)  # a new word gets the next number
            return index, index[END.encode()], 0, []

        block, (index, _, size, learned) = TaskContext.get().partitionId() << 32, empty()

        def words():
            w, counts = list(index), np.bincount(np.concatenate([np.zeros(0, np.int64), *learned]), minlength=len(index))
            for lo in range(0, len(w), 20_000):
                k = len(w[lo : lo + 20_000])
                yield some(k, block=pa.array(np.full(k, block)), word=pa.array([x.decode() for x in w[lo : lo + k]]), i=pa.array(np.arange(lo, lo + k)), n=pa.array(counts[lo : lo + k]))

        for whole in batches:
            for first in range(0, len(whole), 200):
                batch = whole.slice(first, 200)
                raw, ends = flat(batch.column(1))
                data, held, packed = memoryview(raw), batch.column(2).to_pylist(), []
                for a, b, out in zip(ends, ends[1:], held):
                    own = bytes(data[a:b]).lower().split()
                    own.append(b"\n")
                    ids = np.fromiter(map(index.__getitem__, own), np.uint32, len(own))
                    if not out:
                        learned.append(ids)
                    packed.append(pack(ids))
                size += int(ends[-1] - ends[0])
                yield some(len(batch), block=pa.array(np.full(len(batch), block)), doc_id=batch.column(0), held_out=batch.column(2), n_bytes=pa.array(np.diff(ends)), ids=pa.array(packed, pa.binary()))
                if size >= most_bytes:
                    yield from words()
                    block, (index, _, size, learned) = block + 1, empty()
        yield from words()

    return run


def pack(ids: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(ids).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., then the same from starts[1] on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def hashed(x: np.ndarray) -> np.ndarray:
    """32 bits of whole numbers."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def slots_at(k: int, keys: np.ndarray) -> np.ndarray:
    """The slots of table k for keys of a context and a node."""
    slots = (keys * _B >> np.uint32(32 - TABLE_BITS[k])).astype(np.int64)
    return slots + STARTS[k] if k else slots


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slots (bits, 3), bits, gates, how many bits each has) of words' bytes with the space that ends each."""
    raw = [w.encode() + b" " for w in words]
    data, sizes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32), np.fromiter(map(len, raw), np.int64, len(raw))
    place = ranges(np.zeros(len(sizes), np.int64), sizes)
    n_bits = _SIZES[data]
    which, keys = ranges(_AT[data], n_bits), np.zeros(len(data), np.uint32)
    slots = np.empty((len(which), 3), np.int64)
    for k in range(3):
        last = np.zeros(len(data), np.uint32)
        last[k + 1 :] = data[: max(0, len(data) - k - 1)]
        keys = keys * _B + np.where(place > k, last + np.uint32(1), np.uint32(0))
        slots[:, k] = slots_at(2 + k, np.repeat(keys, n_bits) * _A + _NODES[which] * _C)
    gates = np.repeat(np.where(place == 0, CODE_GATES, CODE_GATES + 1).astype(np.uint8), n_bits)
    of_word = np.bincount(np.repeat(np.arange(len(sizes)), sizes), n_bits, len(sizes)).astype(np.int64)
    return slots, _BITS[which], gates, of_word


def pack_words(i: np.ndarray, c: np.ndarray, code: np.ndarray, once: np.ndarray, ways: list[bytes], texts: list[str]) -> bytes:
    """Some words of a block, with their numbers; texts are those of the words with c <= 1."""
    sizes = np.fromiter(map(len, ways), np.uint8, len(ways))
    planes = np.ascontiguousarray(np.concatenate([i, c, code]).astype("<i8").view(np.uint8).reshape(-1, 8).T)
    raw = planes.tobytes() + sizes.tobytes() + once.astype(np.uint8).tobytes() + b"".join(ways)
    spelled_out = " ".join(texts).encode()  # no word holds a space
    return np.array([len(c), len(raw), len(spelled_out)], "<i8").tobytes() + pa.compress(raw + spelled_out, "zstd", asbytes=True)


def unpack_words(blob: bytes) -> tuple:
    n, n_raw, n_text = np.frombuffer(blob, "<i8", 3).tolist()
    raw = pa.decompress(blob[24:], n_raw + n_text, "zstd", asbytes=True)
    numbers = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 24 * n).reshape(8, -1).T).view("<i8").reshape(3, n)
    sizes, once = np.frombuffer(raw, np.uint8, 2 * n, 24 * n).reshape(2, n)
    return *numbers, sizes.astype(np.int64), once == 1, np.frombuffer(raw, np.int8, n_raw - 26 * n, 26 * n), raw[n_raw:].decode()


def _pack_words(batches, at_once: int = 20_000):
    """(block, ids): the words of blocks, of rows (block, i, c, code, way, once, text) that are sorted by block."""

    def some(block, t):
        c, texts = t.column("c").to_numpy(), t.column("text").to_pylist()
        few = np.flatnonzero(c <= 1).tolist()
        blob = pack_words(t.column("i").to_numpy(), c, t.column("code").to_numpy(), t.column("once").to_numpy(zero_copy_only=False), t.column("way").to_pylist(), [texts[k] for k in few])
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary())], ["block", "ids"])

    held, block = [], None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        blocks = t.column("block").to_numpy()
        for lo, hi in zip(*(lambda cuts: ([0, *cuts], [*cuts, len(t)]))(np.flatnonzero(np.diff(blocks)) + 1)):
            if lo == hi:
                continue
            if held and (blocks[lo] != block or sum(map(len, held)) >= at_once):
                yield some(block, pa.concat_tables(held))
                held = []
            block = blocks[lo]
            held.append(t.slice(lo, hi - lo))
    if held:
        yield some(block, pa.concat_tables(held))


class Words:
    """What a block knows of its words: c, their names' hashes, and where each one's bits lie in packed: node << 32, gate << 16, logit << 8, bit.

    The bits of unknown words are those of their spelling; they lie from known on, with their slots in spelling.
    Training texts have none, so what only counts them does without. The largest arrays are made once, at their
    full size: copies of them were what a task needed most memory for.
    """

    def __init__(self, blobs: list[bytes], spells: bool = True):
        heads = np.array([np.frombuffer(blob, "<i8", 3) for blob in blobs])
        self.known, at, columns, words = int((heads[:, 1] - 26 * heads[:, 0]).sum()), 0, [], []
        packed = np.empty(self.known, np.uint64)
        while blobs:  # each one goes when it has been read
            i, c, of, n, once, way, text = unpack_words(blobs.pop())
            owner, depth = np.repeat(of, n), ranges(np.zeros(len(n), np.int64), n)
            rest = np.repeat(n, n) - depth
            packed[at : at + len(way)] = pack_bits(hashed(owner >> rest), _GATE_AT.take(depth), way.view(np.uint8) ^ np.uint8(128), (owner >> (rest - 1)) & 1)
            at += len(way)
            columns.append((i, c, of, n, once))
            words += text.split(" ") if (c <= 1).any() else []
        i, c, code, sizes, once = (np.concatenate(x) for x in zip(*columns))
        del columns
        begin, few = np.cumsum(sizes) - sizes, np.cumsum(c <= 1) - 1
        self.once, unknown = [words[k] for k in few[once].tolist()], np.flatnonzero((c == 0) & spells)
        unknown_words = [words[k] for k in few[unknown].tolist()]
        n_bits = [spelled_bits(w) for w in unknown_words]
        self.spelling = np.empty((sum(n_bits), 3), np.int32)
        if n_bits:
            packed.resize(self.known + len(self.spelling), refcheck=False)
            sizes[unknown] = n_bits
            begin[unknown] = self.known + np.cumsum(sizes[unknown]) - sizes[unknown]
        for slots, bits, gates, _ in in_slices(unknown_words):
            self.spelling[at - self.known : at - self.known + len(bits)] = slots
            packed[at : at + len(bits)] = pack_bits(hashed(slots[:, 2]), gates, np.full(len(bits), 128), bits)
            at += len(bits)
        self.packed = packed
        order = np.argsort(i)
        self.c, self.sizes, self.at, self.names = c[order], sizes[order], begin[order], hashed(code * 2 + 1)[order]


def spelled_bits(word: str) -> int:
    """How many bits a word's bytes have, with the space that ends it."""
    return int(_SIZES[np.frombuffer(word.encode() + b" ", np.uint8)].sum())


def in_slices(words: list[str], at_once: int = 4000):
    """What spelled makes of some of the words, then of the next."""
    return (spelled(words[lo : lo + at_once]) for lo in range(0, len(words), at_once))


def pack_bits(nodes, gates, logits, bits) -> np.ndarray:
    u = np.uint64
    out = nodes.astype(u) << u(32)
    for x, by in ((gates, 16), (logits, 8), (bits, 0)):
        out |= x.astype(u) << u(by)
    return out


def before_in_text(nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray, so_far: np.ndarray | None) -> np.ndarray:
    """The logit of a 1 after what the same text has had at the same node before each bit; 0 if nothing. Texts of sizes bits lie one after another, in reading order.

    so_far (slots, 2): the counts before all these bits of one text; they are added to it. Some bits are sorted at
    a time: those of a text, or of some short ones.
    """
    out, ends = np.empty(len(nodes), np.float32), np.cumsum(sizes).tolist()
    lo = first = 0
    for t, hi in enumerate(ends):
        if t + 1 < len(ends) and ends[t + 1] - lo <= SHORT:
            continue
        n, alone = hi - lo, t == first
        small = alone and n <= 1 << 32 - HISTORY and so_far is None
        u, kind, at = (np.uint32, np.int32, 32 - HISTORY) if small else (np.uint64, np.int64, 25)
        order = (nodes[lo:hi] >> np.uint32(32 - HISTORY)).astype(u) << u(at)
        order |= np.arange(n, dtype=u)
        if not alone:
            order |= np.repeat(np.arange(t + 1 - first, dtype=u) << u(HISTORY + at), sizes[first : t + 1])
        order.sort()
        pos = (order & u((1 << at) - 1)).astype(np.int64)
        order >>= u(at)
        ones = bits[lo:hi].take(pos).astype(kind)
        # before each bit: how many bits, and (the lower half) how many ones; both only grow, so what a node began with is the last such number
        half = 15 if small else 32
        before = np.arange(n, dtype=kind) << kind(half)
        before += np.cumsum(ones, dtype=kind) - ones
        before[1:] -= np.maximum.accumulate(before[1:] * (order[1:] != order[:-1]))
        had_ones = before & kind((1 << half) - 1)
        zeros = (before >> kind(half)) - had_ones
        if so_far is not None:
            s = (order & u((1 << HISTORY) - 1)).astype(np.int64)
            zeros, had_ones = zeros + so_far[s, 0], had_ones + so_far[s, 1]
            np.add.at(so_far.reshape(-1), s * 2 + ones, 1)
        out[lo:hi][pos] = _OF_FEW.take(np.minimum(zeros, 63) * 64 + np.minimum(had_ones, 63))
        lo, first = hi, t + 1
    return out


@dataclass
class State:
    """Of a text that is read in pieces: what has been read of it, and its own weights."""

    seen: np.ndarray
    last: tuple[int, int] = (0, 0)
    tokens: int = 0
    escapes: int = 0
    step: int = FIRST
    weights: np.ndarray | None = None


def contexts(words: Words, ids: np.ndarray, text_no: np.ndarray, state: State | None) -> tuple[np.ndarray, np.ndarray]:
    """What the one and the two words before each token add to its bits' keys."""
    names = words.names[ids]
    one, two = np.r_[names[:1], names[:-1]], np.r_[names[:2], names[:-2]]
    first = np.r_[True, text_no[1:] != text_no[:-1]]
    one[first] = 0
    two[first] = 0
    two[1:][first[:-1]] = 0
    if state is not None:
        one[0], two[:2] = state.last[0], [state.last[1], state.last[0]][: len(two)]
        state.last = names[-1], one[-1]
    return one * _A, (two * _B + one) * _A + np.uint32(7)


def steps_of(sizes: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The stretches of texts of sizes bits, one after another, that are read in one step each: (steps, texts, bits, the next step)."""
    edges = [0]
    while edges[-1] < sizes.max(initial=0):
        edges.append(edges[-1] + step)
        step = min(2 * step, STEP)
    edges = np.array(edges)
    many = np.searchsorted(edges, sizes)
    text, nth = np.repeat(np.arange(len(sizes)), many), ranges(np.zeros(len(sizes), np.int64), many)
    return nth, text, np.minimum(edges[1:].take(nth), sizes[text]) - edges.take(nth), step


def log_of_products(x: np.ndarray, begin: np.ndarray, sizes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The sums of log(1 + x) over stretches of x, added up by what they are of. A logarithm is taken of 8 factors at once; each is up to e**60."""
    eights = (sizes + 7) >> 3
    product = np.multiply.reduceat(np.add(x, 1, dtype=np.float64), np.repeat(begin, eights) + 8 * ranges(np.zeros(len(sizes), np.int64), eights)) if len(x) else np.zeros(0)
    return np.bincount(np.repeat(of, eights), np.log(product), n)


def read_texts(words: Words, pairs: np.ndarray, start: np.ndarray, ids: np.ndarray, text_no: np.ndarray, trains: np.ndarray, state: State | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cost in bits, weights (GATES * INPUTS) in the end) of each text: the bits of its tokens, mixed with its own weights, which begin as start and are refined after each step.

    trains: is the text one of those that pairs (of the tables' slots: zeros << 8, ones) were counted from? With a state there is one text.
    Bits are dealt by step, text and gate, so those that share weights lie side by side.
    """
    n_bits = words.sizes[ids]
    sizes = np.bincount(text_no, n_bits, len(trains)).astype(np.int64)
    which = ranges(words.at[ids], n_bits)
    packed = words.packed.take(which)
    parts, nodes = packed.view(np.uint8).reshape(-1, 8), (packed >> np.uint64(32)).astype(np.uint32)
    bits, gates = parts[:, 0].astype(np.int32), parts[:, 2].astype(np.int64)
    x, own = np.empty((INPUTS - 1, len(which)), np.float32), np.repeat(trains.astype(np.int32) << 16, sizes) * (bits + 1)
    x[0] = (parts[:, 1].astype(np.float32) - 128) / 16
    for k, c in enumerate(contexts(words, ids, text_no, state)):
        keys = np.repeat(c, n_bits) + nodes
        for lo in range(0, len(keys), BITS):
            some = slice(lo, lo + BITS)
            x[1 + k, some] = _OF_PAIR.take(pairs.take(slots_at(k, keys[some])) | own[some])
    x[3] = before_in_text(nodes, sizes, bits, state and state.seen)
    unknown = np.flatnonzero(gates >= CODE_GATES)
    gates += (np.abs(x[1]) > 1) * (CODE_GATES // 2)
    if len(unknown):
        x[0, unknown] = x[3, unknown]
        x[1:4, unknown] = _OF_PAIR[pairs[words.spelling[which[unknown] - words.known]]].T
        gates[unknown] = parts[unknown, 2]

    nth, text, n, after = steps_of(sizes, FIRST if state is None else state.step)
    by_step = np.argsort(nth, kind="stable")
    rank = np.empty(len(nth), np.int64)
    rank[by_step] = np.arange(len(nth))
    run = np.repeat(rank * GATES, n) + gates
    order = np.argsort(run.astype(np.uint16) if len(nth) * GATES <= 1 << 16 else run, kind="stable")
    now = np.empty((INPUTS, len(which)), np.float32)
    for k, row in enumerate([*x, bits.astype(np.float32) * 2 - 1]):  # the last stands where the constant will be
        row.take(order, out=now[k], mode="clip")
    of_run = np.bincount(run, minlength=len(nth) * GATES)
    run = np.flatnonzero(of_run)
    of_run, text, n = of_run[run], text[by_step], n[by_step]
    cell, at = text[run // GATES] * GATES + run % GATES, np.cumsum(of_run) - of_run
    ends = np.cumsum(np.bincount(nth))  # of the steps, in stretches
    steps = np.searchsorted(run, ends * GATES).tolist()
    rate = (RATE / np.sqrt(of_run)).astype(np.float32)

    weights = np.repeat(start.reshape(-1, 1, GATES), len(trains), 1) if state is None or state.weights is None else state.weights
    rows, odds, lo = weights.reshape(INPUTS, -1), np.empty(len(which), np.float32), 0  # odds of the other bit
    for a, b in zip([0, *steps], steps):
        hi, cells = int(at[b - 1] + of_run[b - 1]), cell[a:b]
        x, w = now[:, lo:hi], rows[:, cells]
        sign, z = x[-1].copy(), np.repeat(w, of_run[a:b], 1)
        x[-1] = 0.3
        z *= x
        o = np.exp(np.minimum(z.sum(0) * -sign, 60), out=odds[lo:hi])
        x *= o / (1 + o) * sign
        rows[:, cells] = w + rate[a:b] * np.add.reduceat(x, at[a:b] - lo, 1)
        lo = hi
    cost = log_of_products(odds, np.cumsum(n) - n, n, text, len(trains))
    if state is not None:
        state.weights, state.step = weights, after
    return cost / np.log(2), weights


def batches_of(texts, most: int = PIECE):
    """Lists of (row, ids, whether it ends there) of about most tokens each; a longer text comes alone, piece by piece."""
    held, n = [], 0
    for row, ids in texts:
        if held and n + len(ids) > most:
            yield held
            held, n = [], 0
        if len(ids) > most:
            for lo in range(0, len(ids), most):
                yield [(row, ids[lo : lo + most], lo + most >= len(ids))]
            continue
        held.append((row, ids, True))
        n += len(ids)
    if held:
        yield held


def by_block(batches, spells: bool = True):
    """(words, texts) of each block of rows (block, kind, ...) that are sorted by both; texts is an iterator over tables, to be used up before the next."""
    waiting, block, parts = None, None, []

    def tables():
        for batch in batches:
            t = pa.Table.from_batches([batch])
            blocks, kinds = t.column("block").to_numpy(), t.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(t)]):
                if b > a:
                    yield blocks[a], kinds[a], t.slice(a, b - a)

    source = tables()

    def texts():
        nonlocal waiting
        for k, kind, t in source:
            if k != block or kind == 0:
                waiting = k, t
                return
            yield t

    for k, _, t in source:
        waiting = k, t
        break
    while waiting:
        block, parts, waiting = waiting[0], waiting[1].column("ids").to_pylist(), None
        first = None
        for k, kind, t in source:
            if k == block and kind == 0:
                parts += t.column("ids").to_pylist()
            elif k == block:
                first = t
                break
            else:
                waiting = k, t
                break
        own = texts() if first is not None else iter(())
        yield Words(parts, spells), (x for some in ([first] if first is not None else [], own) for x in some)
        for _ in own:
            pass


# What all training texts teach


def _count(batches):
    """The counts of the hashed tables over the training texts of a task; those to spell with from the words that training texts have once."""
    counts = np.zeros((STARTS[-1], 2), np.uint32)
    flatly, one = counts.reshape(-1), np.uint32(1)
    for words, tables in by_block(batches, spells=False):
        state = None
        for some in batches_of((None, unpack(x)) for t in tables for x in t.column("ids").to_pylist()):
            ids = np.concatenate([x for _, x, _ in some])
            state = state or (None if some[0][2] else State(None))
            n_bits = words.sizes[ids]
            packed = words.packed.take(ranges(words.at[ids], n_bits))
            nodes, bits = (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(1)).astype(np.int64)
            for k, c in enumerate(contexts(words, ids, np.repeat(np.arange(len(some)), [len(x) for _, x, _ in some]), state)):
                keys = np.repeat(c, n_bits) + nodes
                for lo in range(0, len(keys), BITS):
                    np.add.at(flatly, slots_at(k, keys[lo : lo + BITS]) * 2 + bits[lo : lo + BITS], one)
            state = None if some[-1][2] else state
        for slots, bits, _, _ in in_slices(words.once):
            np.add.at(flatly, (slots * 2 + bits[:, None]).reshape(-1), one)
        del words  # before the next block's are made
    for k in range(0, len(counts), PART):
        piece = counts[k : k + PART]
        if piece.any():
            raw = np.ascontiguousarray(piece.view(np.uint8).reshape(len(piece), 2, 4).transpose(2, 1, 0)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())], ["part", "size", "counts"])


def as_pairs(counts: np.ndarray) -> np.ndarray:
    """zeros << 8 | ones of counts (slots, 2); larger ones than 255 are scaled down together."""
    scale = np.maximum(1, counts.max(1, keepdims=True) / 255)
    small = np.ceil(counts / scale).astype(np.uint16)
    return (small[:, 0] << 8) | small[:, 1]


def _total(key, rows):
    """(part, pairs) of a part's slots."""
    size, total = rows.column("size")[0].as_py(), 0
    for piece in rows.column("counts"):
        raw = pa.decompress(piece.as_buffer(), size, "zstd", asbytes=True)
        total = total + np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, 2, -1).transpose(2, 1, 0)).view(np.uint32)[..., 0].astype(np.int64)
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([as_pairs(total).tobytes()], pa.binary())], ["part", "pairs"])


@dataclass
class Model:
    pairs: np.ndarray  # of all tables' slots, uint16: zeros << 8, ones
    train_tokens: int
    distinct: int
    once: int  # words that training texts have once


def gather(rows: DataFrame, tasks: int) -> np.ndarray:
    """The tables' pairs from the training texts of rows (block, kind, ...), all of them and whole. The tables' size is fixed."""
    found = rows.repartition(tasks, "block").sortWithinPartitions("block", "kind").mapInArrow(_count, "part long, size long, counts binary")
    pairs = np.zeros(STARTS[-1], np.uint16)
    for row in found.groupBy("part").applyInArrow(_total, "part long, pairs binary").collect():
        piece = np.frombuffer(row.pairs, np.uint16)
        pairs[row.part : row.part + len(piece)] = piece
    return pairs


def escape_bits(unknown: np.ndarray, text_no: np.ndarray, texts: int, share: float, state: State | None) -> np.ndarray:
    """What each text pays to tell known from unknown words, whose share is estimated from the corpus and what has been read of it."""
    begin = np.searchsorted(text_no, np.arange(texts))
    before = np.cumsum(unknown) - unknown
    before, nth = before - before[begin][text_no], np.arange(len(unknown)) - begin[text_no]
    if state is not None:
        before, nth = before + state.escapes, nth + state.tokens
        state.escapes, state.tokens = state.escapes + int(unknown.sum()), state.tokens + len(unknown)
    p = (before + ESCAPE * share) / (nth + ESCAPE)
    return np.bincount(text_no, -np.log2(np.where(unknown, p, 1 - p)), texts)


class Scorer:
    """Scores the texts of a block, one batch after another; every training text moves the weights that those after it start with."""

    def __init__(self, words: Words, m: Model):
        self.words, self.m = words, m
        self.start = np.array([PRIOR] * CODE_GATES + [PRIOR_TO_SPELL] * (GATES - CODE_GATES), np.float32).T

    def costs(self, some: list, trains: np.ndarray, state: State | None = None) -> np.ndarray:
        """The cost in bits of the texts of a batch."""
        ids, text_no = np.concatenate([x for _, x, _ in some]), np.repeat(np.arange(len(some)), [len(x) for _, x, _ in some])
        total = escape_bits(self.words.c[ids] == 0, text_no, len(some), (self.m.once + 0.5) / (self.m.train_tokens + 1), state)
        cost, ends = read_texts(self.words, self.m.pairs, self.start, ids, text_no, trains, state)
        taught = ends.reshape(INPUTS, -1, GATES)[:, np.flatnonzero(trains & np.array([e for _, _, e in some]))]
        if taught.shape[1]:
            self.start = self.start + min(0.5, TEACH * taught.shape[1]) * (taught.mean(1) - self.start)
        return total + cost


def _score(sent, kind: pa.DataType):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kinds = [kind, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches):
        m = sent.value
        for words, tables in by_block(batches):
            scorer = Scorer(words, m)
            base = np.log10((words.c + 0.1) / (m.train_tokens + 0.1 * (m.distinct + 1)))
            rows, state, spent = [], None, 0.0
            texts = (((i, h, b), unpack(x)) for t in tables for i, h, b, x in zip(*(t.column(c).to_pylist() for c in ("doc_id", "held_out", "n_bytes", "ids"))))
            known, base_score, n = 0, 0.0, 0
            for some in batches_of(texts):
                if state is None and not some[0][2]:
                    state, spent, known, base_score, n = State(np.zeros((1 << HISTORY, 2), np.int32)), 0.0, 0, 0.0, 0
                costs = scorer.costs(some, np.array([not row[1] for row, _, _ in some]), state)
                for ((doc_id, held, n_bytes), ids, ends), cost in zip(some, costs):
                    parts = int((words.c[ids] > 0).sum()), float(base[ids].sum())
                    if state is not None:
                        spent, known, base_score, n = spent + cost, known + parts[0], base_score + parts[1], n + len(ids)
                        cost, parts, total = spent, (known, base_score), n
                    else:
                        total = len(ids)
                    if ends:
                        rows.append((doc_id, held, total, *parts[:1], m.train_tokens, parts[1], float(-cost * np.log10(2)), float(cost / max(1, n_bytes))))
                        state = None
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            del words, scorer  # before the next block's are made

    return run


def score(docs: DataFrame, block_bytes: int = 32 << 20, tokens_in_task: int = 8_000_000, words_in_slice: int = 20_000) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    All texts are scored as a whole, a null one as empty; an empty text is its end alone. Those whose fold of 10
    is not 0 are learned from, whole: the codes, the counts and, in their block, the starting weights. score is the log10
    probability of the text, bits_per_byte the same in bits, by its UTF-8 bytes (1 at least). Repeated rows are
    scored each for itself and learned from as often; without training texts all words are spelled. An empty
    table gives no rows. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold(F.col("doc_id"), 10) == 0).alias("held_out"))
    kind = slim.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)
    read = staged(slim.mapInArrow(_blocks(block_bytes, arrow_kind), f"block long, doc_id {kind.simpleString()}, held_out boolean, n_bytes long, ids binary, word string, i int, n long"), "blocks")
    words, texts = read.where("word is not null").select("block", "word", "i", "n"), read.where("ids is not null").select("block", "doc_id", "held_out", "n_bytes", "ids")

    vocabulary = staged(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "vocabulary")
    release(spark)
    tokens, distinct, once = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    bits = min(16, max(0, (distinct // words_in_slice).bit_length()))
    masses = np.zeros(1 << bits)
    for row in vocabulary.groupBy(slice_of(bits).alias("s")).agg(F.sum("c").alias("c")).collect():
        masses[row.s] = row.c
    coded = vocabulary.withColumn("s", slice_of(bits)).groupBy("s").applyInArrow(_code(slice_ways(masses)), "word string, c long, code long, way binary")
    c = F.coalesce("c", F.lit(0))
    own = words.join(coded, "word", "left").select("block", "i", c.alias("c"), F.coalesce("code", F.lit(0)).alias("code"), F.coalesce("way", F.lit(b"")).alias("way"), ((c == 1) & (F.col("n") == 1)).alias("once"), F.when(c <= 1, F.col("word")).alias("text"))
    blocks = max(1, texts.agg(F.count_distinct("block")).first()[0])
    own = staged(own.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(_pack_words, "block long, ids binary"), "words")
    unstage(vocabulary)
    release(spark)

    word_rows = own.withColumn("kind", F.lit(0))
    rows = lambda t: word_rows.unionByName(t.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    pairs = gather(rows(texts.where("not held_out").select("block", "ids")), 1 + tokens // tokens_in_task)
    release(spark)
    sent = spark.sparkContext.broadcast(Model(pairs, tokens, distinct, once))
    made = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return rows(texts).repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(_score(sent, arrow_kind), made)


def op7(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
