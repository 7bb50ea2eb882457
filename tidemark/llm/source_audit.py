"""Divergence between the sources of each language, with count columns deduplicated.

Each task counts the terms of its texts per (language, source), and the counts of one term in all sources of its
language become a sparse vector. Terms of equal vectors add the same to every pair of sources, so the pairs are
evaluated once per distinct vector and multiplied by how many terms have it. A pair in which neither source has
the term adds what two zeros add, which is known without looking at the term: only the entries of a vector are
compared with the other sources. The terms themselves are ranked as they are.

A count c in a group of N occurrences, of a language of V kept terms, stands for p = 1 + floor(10^9 (c+2) / (N+2V));
two such numbers diverge by floor((p-q)^2 / (p+q)).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table

#: A term occurs in so many texts of its language at least; so many terms are named per source.
LEAST_DOCS, NAMED = 10, 10
#: Distinct (group, term) that a task counts before it sends them on; cells of a block of vectors; numbers that a task sums up before it sends them on.
HELD, CELLS, SUMS = 500_000, 1 << 20, 1 << 22
#: ASCII letters in lower case, other ASCII a space; all bytes of other characters stay.
_TERMS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_COUNTED = "lang string, source string, term string, n long, docs long"


def _counted(found: dict):
    for (lang, source), (n, docs) in found.items():
        terms = list(n)
        for at in range(0, len(terms), 100_000):
            some = terms[at : at + 100_000]
            group = [pa.array([x], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(len(some), np.int32))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*group, pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], ["lang", "source", "term", "n", "docs"])


def _count(batches):
    found, held = {}, 0
    for batch in batches:
        for lang, source, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            if terms := text.translate(_TERMS).split():
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n)
        if held > HELD:
            yield from _counted(found)
            found, held = {}, 0
    yield from _counted(found)


def term_vectors(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, counts): the terms in at least so many texts of their language, with [(source, n)] of the sources that have them, sorted."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    found = rows.mapInArrow(_count, _COUNTED).repartition("lang", "term")
    by_source = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return by_term.where(F.col("docs") >= least).select("lang", "term", "counts")


def p_of(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n+2) / (total + 2 kept)), exact; kept isn't 0."""
    up = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.call_function("div", up, (total + 2 * kept).cast("decimal(19,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def numbers_of(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n+2) / total) in 64 bits: n + 2 is at most the total, and its digits are divided three at a time."""
    left, out = np.broadcast_to(n + 2, np.broadcast(n, total).shape).copy(), np.zeros(np.broadcast(n, total).shape, np.int64)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, total)
        out = out * 1000 + digits
    return out + 1


def _diverge(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


_SUMS = "lang string, source string, item string, value long"


def _sums(found: dict):
    for lang, source, names, own, absent in found.values():
        here, there = pa.array([source], pa.string()).take(pa.array(np.zeros(len(names), np.int32))), names
        langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(names), np.int32)))
        yield pa.RecordBatch.from_arrays([langs, here, there, pa.array(own)], ["lang", "source", "item", "value"])
        yield pa.RecordBatch.from_arrays([langs, there, here, pa.array(absent)], ["lang", "source", "item", "value"])


def _pairs(batches):
    """What vectors (lang, counts, terms, sources, kept) add to their pairs of sources beyond two zeros each. A pair of sources that both have a term meets at each of the two; one that only one has is told to the other, too."""
    found = {}
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code in range(len(langs.dictionary)):
            part = batch.filter(pc.equal(langs.indices, code))
            lang, counts, times = langs.dictionary[code].as_py(), part.column("counts"), part.column("terms").to_numpy()
            sources = part.column("sources")[0].values
            names, kept = sources.field("source"), part.column("kept")[0].as_py()
            totals = sources.field("total").to_numpy() + 2 * kept
            none = numbers_of(np.zeros(len(names), np.int64), totals)
            entries = counts.flatten()
            which, n = pc.index_in(entries.field("source"), names).to_numpy(zero_copy_only=False), entries.field("n").to_numpy()
            row = np.repeat(np.arange(len(counts)), pc.list_value_length(counts).to_numpy())
            step = max(1, CELLS // len(names))
            for lo in range(0, len(counts), step):
                a, b = np.searchsorted(row, [lo, lo + step])
                p = np.tile(none, (min(step, len(counts) - lo), 1))
                p[row[a:b] - lo, which[a:b]] = numbers_of(n[a:b], totals[which[a:b]])
                has = np.zeros(p.shape, bool)
                has[row[a:b] - lo, which[a:b]] = True
                for g in np.unique(which[a:b]):
                    at = np.flatnonzero(has[:, g])
                    more = (_diverge(p[at, g : g + 1], p[at]) - _diverge(none[g], none)) * times[lo + at, None]
                    if (lang, g) not in found:
                        found[lang, g] = lang, names[int(g)].as_py(), names, np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                    _, _, _, own, absent = found[lang, g]
                    own += more.sum(0)
                    absent += np.where(has[at], 0, more).sum(0)
                if sum(len(x[3]) for x in found.values()) > SUMS:
                    yield from _sums(found)
                    found = {}
    yield from _sums(found)


def audit(docs: DataFrame, least: int = LEAST_DOCS, named: int = NAMED) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Part pair: the divergence of each source from every other of its language, over all kept terms. Part term: the
    first `named` terms that a source has more of than its language. Both by value, the larger first, then by item.
    Null texts, languages and sources are ''. A source without terms has its pairs; a language without kept terms
    has pairs of value 0 and no terms. A source alone in its language has no pairs. Repeated rows count each time;
    an empty table gives no rows; other columns are not read.
    """
    vectors = staged(term_vectors(docs, least), "term-vectors")
    totals = vectors.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(vectors.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    groups = staged(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "groups")
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"), F.max("kept").alias("kept"), F.sum("total").alias("of_lang"))

    shapes = vectors.groupBy("lang", "counts").agg(F.count("*").alias("terms"))
    more = shapes.join(langs, "lang").select("lang", "counts", "terms", "sources", "kept").mapInArrow(_pairs, _SUMS)
    more = more.groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    pairs = groups.join(langs.select("lang", "sources"), "lang").select("lang", "source", "total", "kept", F.explode("sources").alias("o")).where("o.source <> source")
    zeros = divergence(p_of(F.lit(0), F.col("total"), F.col("kept")), p_of(F.lit(0), F.col("o.total"), F.col("kept")))
    pairs = pairs.select("lang", "source", F.col("o.source").alias("item"), F.when(F.col("kept") > 0, F.col("kept") * zeros).otherwise(0).alias("zeros"))
    pairs = pairs.join(more, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("zeros") + F.coalesce("more", F.lit(0))).alias("value"))

    in_lang = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("in_lang")
    terms = vectors.select("lang", "term", in_lang, F.explode("counts").alias("c")).select("lang", "term", "in_lang", "c.source", "c.n")
    terms = terms.join(groups, ["lang", "source"]).join(langs.select("lang", "of_lang"), "lang")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p_of(F.col("n"), F.col("total"), F.col("kept")).alias("p"), p_of(F.col("in_lang"), F.col("of_lang"), F.col("kept")).alias("q"))
    terms = terms.where("p > q").select("lang", "source", "part", "item", divergence(F.col("p"), F.col("q")).alias("value"))

    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= named)
    return pairs.withColumn("rank", F.row_number().over(by_value)).union(first)


def op11(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
ns AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
nl AS (SELECT lang, sum(total) AS total FROM ns GROUP BY lang),
p AS (SELECT ns.lang, ns.source, kept.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (ns.total + 2 * v) AS p
      FROM ns JOIN kept USING (lang) JOIN vs USING (lang) LEFT JOIN c ON c.lang = ns.lang AND c.source = ns.source AND c.term = kept.term),
q AS (SELECT lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (any_value(nl.total) + 2 * any_value(v)) AS q
      FROM p JOIN nl USING (lang) JOIN vs USING (lang) GROUP BY lang, term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::bigint AS value, rank::integer AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
