"""Quality rules: a linear-chain conditional random field labels a text's lines, and its share of content decides.

The field has two labels, boilerplate (0) and content (1), weights of each line's features, and weights of
neighbouring labels. Lines are not labelled in any table, so it learns from evidence about each line of a
bounded sample of documents with a quality label (weak_labels): lines that several of them share or that a
text repeats, menus and lines of symbols are boilerplate; sentences are content, as is the rest of a document
of good quality, while the rest of a poor one is boilerplate. Viterbi decoding gives the most probable labels.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.common import flat, labelled_sample, table

SYMBOLS, DIGITS, UPPER, MARKS = b"#*$%&|<>", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"!?{}=;_@"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
FEATURES = 14
#: Retained are texts whose content lines hold this share of the characters of all words at least.
CONTENT_SHARE = 0.5


@dataclass
class Field:
    emit: np.ndarray  # (FEATURES, 2)
    move: np.ndarray  # (2, 2), from, to


def without(text: bytes, marks: bytes) -> int:
    return len(text.translate(None, marks))


def line_features(line: bytes, words: list[bytes], again: bool, first: bool) -> list[float]:
    n, size = len(words), len(line)
    return [
        1.0,
        log(1 + n) / 4,
        (size - without(line, SYMBOLS)) / size * 4,
        (size - without(line, DIGITS)) / size * 4,
        (size - without(line, UPPER)) / size * 4,
        (size - without(line, MARKS)) / size * 4,
        min(2.0, size / n / 8),
        1 - len(set(words)) / n,
        float(line.rstrip(SPACES)[-1:] in (b".", b"!", b"?")),
        min(1.0, 4 * line.count(b",") / n),
        float(b"A" <= line.lstrip(SPACES)[:1] <= b"Z"),
        float(again),
        float(first),
        float(n < 5),
    ]


def read_text(text: bytes) -> tuple[list[list[float]], list[int], int, int, int]:
    """Per line that has a word: its features and the code points of its words; then n_words, n_dup_lines and n_repeat_words of the text."""
    features, weights, every, seen, repeated = [], [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        seen.add(line)
        repeated += again
        features.append(line_features(line, words, again, not features))
        weights.append(len(line.translate(None, SPACES).decode("utf-8", "replace")))
        every += words
    return features, weights, len(every), repeated, repeated_words(every)


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered = Counter(windows), bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return covered.count(1)


def viterbi(scores: list[list[float]], move: list[list[float]]) -> list[int]:
    """The labels of the best path; of equal ones, that with more content later."""
    (a, b), back = scores[0], []
    (aa, ab), (ba, bb) = move
    for x, y in scores[1:]:
        back.append((int(b + ba >= a + aa), int(b + bb >= a + ab)))
        a, b = max(a + aa, b + ba) + x, max(a + ab, b + bb) + y
    labels = [int(b >= a)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def weak_labels(x: np.ndarray, shared: np.ndarray, quality: int) -> np.ndarray:
    """The labels that a text's lines are taught with. x: their features; shared: is the line one that other documents have too?"""
    again, short, ends, words = x[:, 11] > 0, x[:, 13] > 0, x[:, 8] > 0, np.expm1(4 * x[:, 1])
    boilerplate = shared | again | (x[:, 2] > 0.2) | (short & ~ends)
    sentence = ends & (words >= 5)
    return (~boilerplate & (sentence | (quality == 1))).astype(np.int64)


def train(texts: list[np.ndarray], y: list[np.ndarray], epochs: int = 8, batch: int = 64, rate: float = 0.05, decay: float = 1e-3, seed: int = 5) -> Field:
    """Adam on the mean log likelihood of a text's labels, by forward-backward; texts: (lines, FEATURES) each, y: their lines' labels."""
    rng = np.random.default_rng(seed)
    emit, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    first, second, t = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)], 0
    share = np.bincount(np.concatenate(y), minlength=2)
    weight = share.sum() / (2 * np.maximum(1, share))
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            some = sorted(some, key=lambda i: -len(texts[i]))
            size = np.array([len(texts[i]) for i in some])
            long = size[0]
            x = np.zeros((long, len(some), FEATURES))
            for k, i in enumerate(some):
                x[: size[k], k] = texts[i]
            gold = np.zeros((long, len(some)), np.int64)
            for k, i in enumerate(some):
                gold[: size[k], k] = y[i]
            own = np.array([weight[y[i]].mean() for i in some]) / size / len(some)
            scores = x @ emit
            ahead, behind = np.zeros((long, len(some), 2)), np.zeros((long, len(some), 2))
            ahead[0] = scores[0]
            for n in range(1, long):
                ahead[n] = np.logaddexp.reduce(ahead[n - 1][:, :, None] + move, axis=1) + scores[n]
            for n in range(long - 2, -1, -1):
                step = np.logaddexp.reduce(move + (scores[n + 1] + behind[n + 1])[:, None, :], axis=2)
                behind[n] = np.where((n + 1 < size)[:, None], step, 0)
            alive = np.arange(long)[:, None] < size
            total = np.logaddexp.reduce(ahead[size - 1, np.arange(len(some))], axis=1)
            p = np.exp(ahead + behind - total[:, None]) * alive[..., None]
            off = (p - (np.eye(2)[gold] * alive[..., None])) * own[:, None]
            g_emit = np.einsum("nkf,nkl->fl", x, off) + decay * emit
            both = np.exp(ahead[:-1, :, :, None] + move + (scores + behind)[1:, :, None, :] - total[:, None, None]) * alive[1:, :, None, None]
            g_move = np.einsum("nkij,k->ij", both, own) + decay * move
            np.subtract.at(g_move, (gold[:-1], gold[1:]), own * alive[1:])
            t += 1
            for q, g, m, v in zip((emit, move), (g_emit, g_move), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(emit, move)


def content_share(field: Field, features: list[list[float]], weights: list[int]) -> float:
    if not features:
        return 0.0
    labels = viterbi((np.array(features) @ field.emit).tolist(), field.move.tolist())
    return sum(w for w, l in zip(weights, labels) if l) / sum(weights)  # noqa: E741


def _lines(batches):
    """(doc_id, y, features, lines): of each text its lines' features and hashes."""
    for batch in batches:
        rows = []
        for doc_id, text, y in zip(*(c.to_pylist() for c in batch.columns)):
            features = read_text(text.encode())[0]
            lines = [xxhash.xxh64_intdigest(line.strip(SPACES)) >> 1 for line in text.encode().split(b"\n") if line.split()]
            rows.append((doc_id, y, np.array(features, np.float32).tobytes(), np.array(lines, np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, [batch.column(0).type, pa.int32(), pa.binary(), pa.binary()])], ["doc_id", "y", "features", "lines"])


def fit(docs: DataFrame, labels: DataFrame, at_most: int = 3000, shared_by: int = 3) -> Field | None:
    """Trained on the lines of up to at_most labelled documents, whole; None without any. A line that shared_by of them have is shared. Features, not texts, go to the driver."""
    sample = labelled_sample(docs, labels, "quality", 1, -1, at_most)
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sorted((tuple(r) for r in sample.mapInArrow(_lines, f"doc_id {kind}, y int, features binary, lines binary").collect()), key=lambda r: (r[0], r[2]))
    read = [(np.frombuffer(f, np.float32).reshape(-1, FEATURES).astype(float), np.frombuffer(h, np.int64), y) for _, y, f, h in rows if f]
    if not read:
        return None
    lines, n = np.unique(np.concatenate([np.unique(h) for _, h, _ in read]), return_counts=True)
    shared = lines[n >= shared_by]
    return train([x for x, _, _ in read], [weak_labels(x, np.isin(h, shared), y) for x, h, y in read])


def apply_rules(docs: DataFrame, field: Field | None, least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    Whole texts are read; a null one has no words, and neither has an empty one: both fail the base rules.
    Without a field (no labels) all lines count as content. Repeated rows are judged each for itself; an empty
    table gives no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            raw, ends = flat(batch.column(1))
            data, rows = memoryview(raw), []
            for a, b in zip(ends, ends[1:]):
                text = bytes(data[a:b])
                features, weights, n, again, repeated = read_text(text)
                failed = n < least_words or 100 * repeated > most_repeated * n
                share = content_share(sent.value, features, weights) if sent.value else float(bool(features))
                rows.append((n, sum(weights), len(text) - without(text, SYMBOLS), again, repeated, failed, not failed and share >= CONTENT_SHARE, share))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds))], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")


def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
