"""Toxicity by a factorization machine over hashed terms: additive weights and learned pairwise interactions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HashOf, flat, fold, labelled_sample, table

BITS, FACTORS = 18, 8
_EDGES = b".,;:!?\"'()[]{}*%#&$<>|"


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # (2**BITS,)
    factors: np.ndarray  # (2**BITS, FACTORS)


def term_slots(word: bytes) -> tuple[int, ...]:
    """The slots of a word without the punctuation around it, and of its first 4 and 5 characters, which compounds share."""
    word = word.strip(_EDGES)
    text = word.decode()
    parts = {b"w" + word} | {b"%d" % n + text[:n].encode() for n in (4, 5) if len(text) > n}
    return tuple(xxhash.xxh32_intdigest(p) >> (32 - BITS) for p in parts)


def terms(text: bytes, slots_of: HashOf) -> np.ndarray:
    """The distinct slots of a whole text's words, lower-cased."""
    words = set(text.decode().lower().encode().split())
    return np.unique(np.fromiter(chain.from_iterable(map(slots_of.__getitem__, words)), np.int32))


def logit(m: Machine, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """bias + sum of w_i + sum over pairs of <v_i, v_j>, for texts whose slots begin at starts (one more at the end)."""
    empty = np.diff(starts) == 0
    at = np.minimum(starts[:-1], max(len(slots) - 1, 0))
    if not len(slots):
        return np.full(len(empty), m.bias)
    v = m.factors[slots]
    total = np.add.reduceat(v, at)
    pairs = 0.5 * (total**2 - np.add.reduceat(v * v, at)).sum(1)
    return m.bias + np.where(empty, 0, np.add.reduceat(m.weights[slots], at) + pairs)


def paired(texts: list[np.ndarray], y: np.ndarray, frequent: np.ndarray, alone: np.ndarray, least: int) -> np.ndarray:
    """The frequent slots of pairs that tell of the label what neither does alone.

    Among the texts with one slot, those that also have the other (not in alone) differ in label from the rest's
    share by more than chance gives any of all pairs (the bound of Chernoff for each).
    """
    slots, found = np.flatnonzero(frequent), np.zeros(len(frequent), bool)
    place = np.cumsum(frequent) - 1
    own = [place[t[frequent[t]]] for t in texts]
    owner, flat_own = np.repeat(np.arange(len(own)), [len(t) for t in own]), np.concatenate(own)
    order = np.argsort(flat_own, kind="stable")
    docs = np.split(owner[order], np.cumsum(np.bincount(flat_own, minlength=len(slots)))[:-1])
    bound, others = 4 * np.log(max(2, len(slots))), ~alone[slots]
    for i, some in enumerate(docs):
        share = y[some].mean()
        if not 0 < share < 1:
            continue
        n = np.bincount(np.concatenate([own[d] for d in some]), minlength=len(slots))
        t = np.bincount(np.concatenate([own[d] for d in some if y[d]]), minlength=len(slots))
        js = np.flatnonzero((n >= least) & others)
        p = t[js] / n[js]
        g = 2 * n[js] * (p * np.log(np.maximum(p, 1e-12) / share) + (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - share)))
        js = js[g >= bound]
        found[slots[js]] = True
        found[slots[i]] |= len(js) > 0
    return found


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, least: int = 5, least_chi2: float = 15.0, pair_rows: int = 3000, seed: int = 3) -> Machine:
    """Adagrad on the log loss, both labels of equal weight. Slots that fewer than least texts have, or whose chi-square with the label is less than least_chi2 and which no pair needs (paired, over the first pair_rows texts of the sample), stay at zero, as unseen ones do."""
    rng = np.random.default_rng(seed)
    seen = np.bincount(np.concatenate(texts), minlength=1 << BITS) if texts else np.zeros(1 << BITS)
    toxic = np.bincount(np.concatenate([t for t, one in zip(texts, y) if one]), minlength=1 << BITS) if y.any() else np.zeros(1 << BITS)
    share = y.mean() if len(y) else 0.0
    expected = np.maximum(seen * share * (1 - share) * (1 - seen / max(1, len(y))), 1e-9)
    known = (seen >= least) & ((toxic - seen * share) ** 2 / expected >= least_chi2)
    if (seen >= least).any():
        some = rng.permutation(len(y))[:pair_rows]
        known |= paired([texts[i] for i in some], y[some], seen >= least, known, least)
    texts = [t[known[t]] for t in texts]
    m = Machine(0.0, np.zeros(1 << BITS), np.where(known[:, None], rng.normal(0, 0.05, (1 << BITS, FACTORS)), 0))
    weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
    gw, gv, gb = np.full(1 << BITS, 1e-2), np.full((1 << BITS, FACTORS), 1e-2), 1.0
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            sizes = np.array([len(texts[i]) for i in some])
            slots, owner = np.concatenate([texts[i] for i in some]), np.repeat(np.arange(len(some)), sizes)
            off = 1 / (1 + np.exp(-np.clip(logit(m, slots, np.cumsum(np.r_[0, sizes])), -30, 30))) - y[some]
            off = off * weight[some]
            total = np.zeros((len(some), FACTORS))
            np.add.at(total, owner, m.factors[slots])
            uniq, inverse = np.unique(slots, return_inverse=True)
            d = off[owner]
            dw = np.bincount(inverse, d, len(uniq)) / len(some) + decay * m.weights[uniq]
            inner = d[:, None] * (total[owner] - m.factors[slots])
            dv = np.stack([np.bincount(inverse, inner[:, f], len(uniq)) for f in range(FACTORS)], 1) / len(some) + decay * m.factors[uniq]
            gw[uniq] += dw**2
            gv[uniq] += dv**2
            gb += off.mean() ** 2
            m.weights[uniq] -= rate * dw / np.sqrt(gw[uniq])
            m.factors[uniq] -= 0.3 * rate * dv / np.sqrt(gv[uniq])
            m.bias -= rate * off.mean() / gb**0.5
    return m


def _features(batches):
    slots_of = HashOf(term_slots)
    for batch in batches:
        raw, ends = flat(batch.column(0))
        data = memoryview(raw)
        found = [terms(bytes(data[a:b]), slots_of).tobytes() for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["slots", "y"])


def fit(docs: DataFrame, labels: DataFrame, at_most: int = 8000) -> Machine | None:
    """Trained on up to at_most labelled documents outside the held-out fold; their slots, not their texts, go to the driver. None without any."""
    sample = labelled_sample(docs, labels, "toxic", 3, 1, at_most)
    rows = sorted(tuple(r) for r in sample.select("text", "y").mapInArrow(_features, "slots binary, y int").collect())
    return train([np.frombuffer(x, np.int32) for x, _ in rows], np.array([y for _, y in rows])) if rows else None


def classify(docs: DataFrame, m: Machine | None, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: whole texts, a null one as empty. Without a machine the score is 0.5.

    Repeated rows are scored each for itself; an empty table gives no rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        slots_of = HashOf(term_slots)
        for batch in batches:
            raw, ends = flat(batch.column(1))
            data, m, p = memoryview(raw), sent.value, np.full(len(batch), 0.5)
            for lo in range(0, len(batch) if m else 0, 200):
                found = [terms(bytes(data[a:b]), slots_of) for a, b in zip(ends[lo : lo + 200], ends[lo + 1 : lo + 201])]
                z = logit(m, np.concatenate(found), np.cumsum(np.r_[0, [len(x) for x in found]]).astype(np.int64))
                p[lo : lo + 200] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
