"""A quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Learned filters slide over each chunk,
their largest responses in it are its features, a small layer turns these into the chunk's score, and the
mean over the chunks gives the text's one probability. A filter over w bytes is w tables of one row a byte, so
that a convolution is w lookups and additions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat, fold, labelled_sample, table

CHUNK, STRIDE, WIDTH, FILTERS, HIDDEN = 256, 224, 6, 24, 16
#: Id of the byte that pads a text's last chunk.
PAD = 256


@dataclass
class Net:
    conv: np.ndarray  # (WIDTH, 257, FILTERS)
    bias: np.ndarray
    hidden: np.ndarray  # (FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.conv, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of n bytes begin; an empty text has one chunk of padding."""
    return np.arange(0, max(1, n - (CHUNK - STRIDE)), STRIDE)


def chunks(raw: np.ndarray, begin: int, end: int, starts: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK) byte ids of raw[begin:end], padded."""
    at = begin + starts[:, None] + np.arange(CHUNK)
    return np.where(at < end, raw[np.minimum(at, max(end - 1, 0))] if end > begin else 0, PAD).astype(np.int64)


def convolve(net: Net, ids: np.ndarray) -> np.ndarray:
    steps = CHUNK - WIDTH + 1
    out = net.conv[0][ids[:, :steps]]
    for k in range(1, WIDTH):
        out += net.conv[k][ids[:, k : k + steps]]
    return out


def chunk_scores(net: Net, ids: np.ndarray) -> np.ndarray:
    pooled = np.maximum(convolve(net, ids).max(1) + net.bias, 0)
    return np.maximum(pooled @ net.hidden + net.hidden_bias, 0) @ net.out + net.out_bias[0]


def train(texts: list[bytes], y: np.ndarray, epochs: int = 4, most_chunks: int = 6, batch: int = 32, rate: float = 0.004, seed: int = 1) -> Net:
    """Adam on the log loss of whole texts; a text of more chunks is trained on most_chunks drawn anew each time."""
    rng = np.random.default_rng(seed)
    shape = lambda *s: rng.normal(0, (2 / s[0]) ** 0.5, s).astype(np.float32)
    conv = rng.normal(0, 0.4, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
    conv[:, PAD] = 0
    net = Net(conv, np.zeros(FILTERS, np.float32), shape(FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), shape(HIDDEN), np.zeros(1, np.float32))
    first, second, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    positive = max(1, int(y.sum()))
    weight = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * max(1, len(y) - positive)))
    raws = [np.frombuffer(x, np.uint8) for x in texts]
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            ids, owner = [], []
            for k, i in enumerate(some):
                starts = chunk_starts(len(raws[i]))
                starts = rng.choice(starts, most_chunks, replace=False) if len(starts) > most_chunks else starts
                ids.append(chunks(raws[i], 0, len(raws[i]), starts))
                owner += [k] * len(starts)
            ids, owner = np.concatenate(ids), np.array(owner)
            share = 1 / np.bincount(owner, minlength=len(some))
            mapped = convolve(net, ids)
            top = mapped.argmax(1)
            pooled = np.maximum(np.take_along_axis(mapped, top[:, None], 1)[:, 0] + net.bias, 0)
            inner = np.maximum(pooled @ net.hidden + net.hidden_bias, 0)
            logits = np.bincount(owner, inner @ net.out + net.out_bias[0], len(some)) * share
            off = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y[some]) * weight[some] / len(some)
            d = (off * share)[owner].astype(np.float32)
            d_inner = d[:, None] * net.out * (inner > 0)
            d_pooled = (d_inner @ net.hidden.T) * (pooled > 0)
            d_conv = np.zeros_like(net.conv)
            rows, filters = np.arange(len(ids))[:, None], np.arange(FILTERS)
            for k in range(WIDTH):
                np.add.at(d_conv[k], (ids[rows, top + k], filters), d_pooled)
            t += 1
            for p, g, m, v in zip(net.parts(), [d_conv, d_pooled.sum(0), pooled.T @ d_inner, d_inner.sum(0), inner.T @ d, d.sum(keepdims=True)], first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    return net


def score(net: Net, raw: np.ndarray, ends: np.ndarray, at_once: int = 64) -> np.ndarray:
    """The probabilities of the texts raw[ends[i]:ends[i + 1]]; whole texts, at_once chunks at a time."""
    starts = [chunk_starts(int(n)) for n in np.diff(ends)]
    owner = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    at, total = np.concatenate(starts) if len(starts) else np.zeros(0, np.int64), np.zeros(len(starts))
    raw = np.append(raw, np.uint8(0))
    for lo in range(0, len(at), at_once):
        own = owner[lo : lo + at_once]
        where = ends[own][:, None] + at[lo : lo + at_once, None] + np.arange(CHUNK)
        ids = np.where(where < ends[own + 1][:, None], raw[np.minimum(where, len(raw) - 1)], PAD).astype(np.int64)
        total += np.bincount(own, chunk_scores(net, ids), len(starts))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(1, np.bincount(owner, minlength=len(starts))), -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, at_most: int = 4000) -> Net | None:
    """Trained on up to at_most labelled documents outside the held-out fold, on chunks from all over each; None without any."""
    sample = labelled_sample(docs, labels, "quality", 4, 2, at_most)
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id, r.text, r.y))
    return train([r.text.encode() for r in rows], np.array([r.y for r in rows])) if rows else None


def classify(docs: DataFrame, net: Net | None, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: whole texts, a null one as empty. Without a net the score is 0.5.

    Repeated rows are scored each for itself; an empty table gives no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            raw, ends = flat(batch.column(1))
            p = score(sent.value, raw, ends) if sent.value is not None else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, learn_from: DataFrame, cut: float = 0.7) -> DataFrame:
    """The rows of docs that a classifier fitted on learn_from accepts, with their columns; without labels all rows."""
    net = fit(learn_from, labels)
    if net is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score(sent.value, *flat(batch.column(at))) >= cut))

    return docs.mapInArrow(run, docs.schema)


def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
