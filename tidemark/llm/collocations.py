"""Phrase collocations mined over position bitmaps.

A shard is a block of texts whose word positions are numbered; a position between pieces holds no word, so nothing
joins across it. Of each word of a shard there is a compressed bitmap of its positions: containers of 2^16
positions, as sorted 16-bit numbers where these are the shorter, else as bits. A bitmap shifted by one position
and combined by AND with another word's holds the ends of the phrase that the two make, and its popcount is how
often the shard has it. Popcounts are summed over the shards: of words first, then of pairs of frequent words and
of triples of frequent pairs, and what is frequent is told to the shards that have it; longer phrases are grown
depth-first, one block of triples after another, along frequent triples. Triples of frequent pairs are many and
mostly rare, so their windows are first counted by a hash, in slots that grow in number with the text: a slot's
count is at least that of each triple in it, so only triples of slots that have enough are counted themselves.

At any position stands at most one word, so a shifted bitmap meets those of all words at once: what a set bit meets
is the word that has the bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table

#: Words of the longest phrase, occurrences of the rarest, phrases reported of a language, and 100 times the share of a phrase that a longer one may hold.
MOST_WORDS, LEAST, REPORTED, ABSORBED = 5, 100, 2000, 100
#: Positions of a shard (a text begins in one and ends in it), places or set bits looked at in one go, parts a language's phrases are dealt into to find the first.
SHARD, BLOCK, PARTS = 1 << 22, 1 << 18, 64
#: Words of text for each slot of the hashed triples, and log2 of the slots that are added up in one go.
WORDS_A_SLOT, PART_BITS = 8, 20
#: ASCII letters in lower case; what ends a piece becomes a byte that UTF-8 doesn't have.
_PIECES = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b"\xff"
#: Up to so many positions of a container are written as numbers; more, as 2^16 bits.
SPARSE = 4096


def packed(owner: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of n owners with set bits `at` (sorted by owner, then place): their 16-bit words one after another, and where each begins (one more at the end).

    A container is the place's high half, how many bits it has less one, and the low halves or 4096 words of bits.
    """
    high, low = at >> 16, (at & 0xFFFF).astype(np.uint16)
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (high[1:] != high[:-1])]) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(at)])
    ends = np.cumsum(np.minimum(count, SPARSE) + 2)
    begins = ends - np.minimum(count, SPARSE) - 2
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint16)
    out[begins], out[begins + 1] = high[first], count - 1
    sparse = np.repeat(count <= SPARSE, count)
    out[(np.arange(len(at)) - np.repeat(first, count) + np.repeat(begins + 2, count))[sparse]] = low[sparse]
    for c in np.flatnonzero(count > SPARSE):
        bits = np.zeros(1 << 16, bool)
        bits[low[first[c] : first[c] + count[c]]] = True
        out[begins[c] + 2 : ends[c]] = np.packbits(bits, bitorder="little").view(np.uint16)
    return out, np.r_[0, np.cumsum(np.bincount(owner[first], np.minimum(count, SPARSE) + 2, n))].astype(np.int64)


def unpacked(words: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """(owners, places) of the set bits of bitmaps as `packed` writes them, from begins to ends; one container of each bitmap is read at a time."""
    who, cursor = np.arange(len(begins), dtype=np.int32), begins.copy()
    while len(who := who[(more := cursor < ends[who])]):
        cursor = cursor[more]
        high, count = words[cursor].astype(np.int32), words[cursor + 1].astype(np.int32) + 1
        sparse = count <= SPARSE
        n = count[sparse]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(who[sparse], n), np.repeat(high[sparse] << 16, n) | words[np.repeat(cursor[sparse] + 2, n) + inner]
        for c in np.flatnonzero(~sparse):
            low = np.flatnonzero(np.unpackbits(words[cursor[c] + 2 : cursor[c] + 2 + SPARSE].view(np.uint8), bitorder="little"))
            yield np.full(len(low), who[c], np.int32), (high[c] << 16 | low).astype(np.int32)
        cursor = cursor + 2 + np.minimum(count, SPARSE)


class _Index(dict):
    """index[word]: the word's number in the order of first use; a piece's end has none."""

    def __missing__(self, word):
        self[word] = out = len(self) - 1
        return out


_ROW = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("rid", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("begins", pa.binary()), ("bits", pa.binary())])
_ROWS = "shard long, row long, rid long, lang string, word string, n long, begins binary, bits binary"


def _bitmaps(shard: int, rid: int, langs: dict):
    """A shard's words, a batch per language, numbered on from rid, and then all their bitmaps in one row."""
    at, rows, begins, bits = 0, 0, [np.zeros(1, np.int64)], []
    for lang, (index, words) in langs.items():
        words, n = np.concatenate([*words, np.full(1, -1, np.int32)]), len(index) - 1
        place = np.flatnonzero(words >= 0).astype(np.int32)
        order = place[np.argsort(words[place], kind="stable")]
        own, ends = packed(words[order], order + np.int32(at), n)
        begins.append(ends[1:] + begins[-1][-1])
        bits.append(own)
        at += len(words)
        if n:
            number = np.arange(rows, rows + n)
            names = pa.array(list(index)[1:], pa.binary()).cast(pa.string())
            lang = pa.array([lang], pa.binary()).cast(pa.string()).take(pa.array(np.zeros(n, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(number), pa.array(number + rid), lang, names, pa.array(np.bincount(words[place], minlength=n)), *[pa.nulls(n, pa.binary())] * 2], schema=_ROW)
            rows += n
    if rows:
        yield pa.RecordBatch.from_pylist([{"shard": shard, "begins": np.concatenate(begins).tobytes(), "bits": np.concatenate(bits).tobytes()}], schema=_ROW)


def _shards(batches):
    part, made, rid, held, langs = TaskContext.get().partitionId(), 0, 0, 0, {}
    for batch in batches:
        for lang, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
            index, words = langs.setdefault(lang, (_Index({_END: -1}), []))
            words.append(np.array([index[w] for w in (_END + text.translate(_PIECES)).replace(_END, b" \xff ").split()], np.int32))
            held += len(words[-1])
            if held >= SHARD:
                yield from _bitmaps(part << 32 | made, part << 40 | rid, langs)
                made, rid, held, langs = made + 1, rid + sum(len(index) for index, _ in langs.values()), 0, {}
    yield from _bitmaps(part << 32 | made, part << 40 | rid, langs)


def bitmaps(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shard, row, rid, lang, word, n) of every word of each shard, rid being a number of its own; and (shard, begins, bits), the shards' bitmaps. Staged."""
    made = staged(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_shards, _ROWS), "bitmaps")
    return made.where("word is not null").select("shard", "row", "rid", "lang", "word", "n"), made.where("bits is not null").select("shard", "begins", "bits")


def _opened(shard: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of a shard's frequent words (row, id): their ids, and at each place of the shard which of them it is, else -1."""
    row = words.column("row").to_numpy()
    begins, bits = np.frombuffer(shard.column("begins")[0].as_buffer(), np.int64), np.frombuffer(shard.column("bits")[0].as_buffer(), np.uint16)
    found = list(unpacked(bits, begins[row], begins[row + 1]))
    word = np.full(max((int(at.max()) for _, at in found if len(at)), default=0) + MOST_WORDS + 1, -1, np.int32)
    for owner, at in found:
        word[at] = owner
    return words.column("id").to_numpy(), word


def _met(word: np.ndarray, many: int, k: int):
    """Per block of places: those where k frequent words follow each other, and the words as one number."""
    for lo in range(0, len(word) - k + 1, BLOCK):
        block = word[lo : lo + BLOCK + k - 1]
        n, number = len(block) - k + 1, np.zeros(len(block) - k + 1, np.int64)
        stands = np.ones(n, bool)
        for i in range(k):
            stands &= block[i : n + i] >= 0
            number = number * many + block[i : n + i]
        yield np.flatnonzero(stands) + lo, number[stands]


_PAIRS = "shard long, a long, b long, n long"


def _pairs(key, shard, words):
    """The popcount of every frequent word's bitmap, shifted by one, AND every other's."""
    ids, word = _opened(shard, words) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    counts = [np.unique(pair, return_counts=True) for _, pair in _met(word, len(ids), 2)] or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    pair, which = np.unique(np.concatenate([p for p, _ in counts]), return_inverse=True)
    n = np.bincount(which, np.concatenate([n for _, n in counts]), len(pair)).astype(np.int64)
    a, b = np.divmod(pair, max(1, len(ids)))
    return pa.table({"shard": pa.array(np.full(len(n), key[0].as_py(), np.int64)), "a": pa.array(ids[a]), "b": pa.array(ids[b]), "n": pa.array(n)})


def _begun(shard: pa.Table, told: pa.Table, k: int):
    """(ids, word, frequent phrases of k words as numbers, whether one begins at a place, the places, which of them begins there). told: as `_longer` has it."""
    valid, missing = pc.is_valid(told.column("row")), pc.is_null(told.column("id"))
    phrases = told.filter(pc.and_not(pc.invert(valid), missing))
    ids, word = _opened(shard, told.filter(valid))
    many, by_id = len(ids), np.argsort(ids)
    known = np.zeros(len(phrases), np.int64)
    for column in ("id", "b", "c")[:k]:
        known = known * many + by_id[np.searchsorted(ids, phrases.column(column).to_numpy(), sorter=by_id)]
    known = np.sort(known)
    joins, begin, which = np.zeros(len(word), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, number in _met(word, many, k) if len(known) else ():
        slot = np.searchsorted(known, number)
        fits = slot < len(known)
        fits[fits] = known[slot[fits]] == number[fits]
        begin.append(at[fits])
        which.append(slot[fits])
        joins[at[fits]] = True
    return ids, word, known, joins, np.concatenate(begin), np.concatenate(which)


def _slots(ids: np.ndarray, word: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The slots, of 2^bits, of the three words at each place."""
    out = np.zeros(len(at), np.uint64)
    for i in range(3):
        out = (out ^ ids[word[at + i]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


_HASHED, _ENOUGH = "shard long, part long, slots binary, counts binary", "shard long, part long, enough binary"


def _hashed(bits: int, part_bits: int, least: int):
    """The function that counts the windows of two frequent pairs of a shard in their slots, up to `least` each: a row a part of the slots, with those that have any."""

    def run(key, shard, told):
        ids, word, _, joins, at, _ = _begun(shard, told, 2)
        slot, n = np.unique(_slots(ids, word, at[joins[at + 1]], bits), return_counts=True)
        cuts = np.flatnonzero(np.diff(slot >> part_bits)) + 1
        slot, n = (np.split(x, cuts) if len(x) else [] for x in (slot, np.minimum(n, least)))
        columns = [int(x[0]) >> part_bits for x in slot], [(x & (1 << part_bits) - 1).astype(np.uint32).tobytes() for x in slot], [x.astype(np.uint32).tobytes() for x in n]
        return pa.table([pa.array([key[0].as_py()] * len(slot), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True))], ["shard", "part", "slots", "counts"])

    return run


def _enough(part_bits: int, least: int):
    """The function that tells each shard, of a part of the slots, which of its own have `least` windows in all shards."""

    def run(key, rows):
        total = np.zeros(1 << part_bits, np.int64)
        for slots, counts in zip(rows.column("slots").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            total[np.frombuffer(slots, np.uint32)] += np.frombuffer(counts, np.uint32)
        enough = [np.packbits(total[np.frombuffer(x, np.uint32)] >= least).tobytes() for x in rows.column("slots").to_pylist()]
        return pa.table([rows.column("shard"), rows.column("part"), pa.array(enough, pa.binary())], ["shard", "part", "enough"])

    return run


def _kept(ids: np.ndarray, word: np.ndarray, at: np.ndarray, enough: pa.Table, bits: int, part_bits: int) -> np.ndarray:
    """Whether the slot of each window has enough; enough: the rows that `_enough` makes for the shard."""
    slot, which = np.unique(_slots(ids, word, at, bits), return_inverse=True)
    flags = np.zeros(len(slot), bool)
    for part, raw in zip(enough.column("part").to_pylist(), enough.column("enough").to_pylist(), strict=True):
        a, b = np.searchsorted(slot, [part << part_bits, part + 1 << part_bits])
        flags[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=b - a)
    return flags[which]


_LONGER = "shard long, ids array<long>, n long"
_GROWN = pa.schema([("shard", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.int64())])


def _longer(k: int, most: int, bits: int = 0, part_bits: int = 0):
    """The function that grows a shard's frequent phrases of k words to `most`. told: its frequent words (row, id), where row is null phrases (id, b, c, ...) and, with bits, where id is, too, which slots of triples have enough (part, enough)."""

    def grown(key, shard, told):
        ids, word, known, joins, at, which = _begun(shard, told, k)
        if bits:
            at, which = at[joins[at + 1]], which[joins[at + 1]]
            keep = _kept(ids, word, at, told.filter(pc.is_valid(told.column("part"))), bits, part_bits)
            at, which = at[keep], which[keep]
        if not len(at):
            return _GROWN.empty_table()
        many, found = len(ids), []
        first = [known // many ** (k - 1 - i) % many for i in range(k)]

        def grow(phrases: np.ndarray, phrase: np.ndarray, at: np.ndarray) -> None:
            """phrases: rows of words; phrase: which of them ends at each place `at`. The bitmaps are shifted by one, met with all words', and grown on."""
            ends = joins[at - k + 2]
            phrase, at = phrase[ends], at[ends] + 1
            if not len(at):
                return
            made, phrase, n = np.unique(phrase.astype(np.int64) * many + word[at], return_inverse=True, return_counts=True)
            phrases = np.c_[phrases[made // many], made % many]
            found.append((phrases, n))
            if phrases.shape[1] < most:
                grow(phrases, phrase, at)

        order = np.argsort(which, kind="stable")
        at, which = at[order], which[order]
        for lo in range(0, len(known), step := max(1, BLOCK * len(known) // max(1, len(at)))):
            a, b = np.searchsorted(which, [lo, lo + step])
            grow(np.c_[*first][lo : lo + step], which[a:b] - lo, at[a:b] + k - 1)
        batches = [pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(ids[p.ravel()])) for p, _ in found]
        batches = [pa.RecordBatch.from_arrays([pa.array(np.full(len(n), key[0].as_py())), lists, pa.array(n.astype(np.int64))], schema=_GROWN) for lists, (_, n) in zip(batches, found, strict=True)]
        return pa.Table.from_batches(batches, schema=_GROWN)

    return grown


def triples(bits: DataFrame, told: DataFrame, words: int, least: int, part_bits: int = PART_BITS) -> DataFrame:
    """(shard, ids, n) of the triples of frequent pairs that may occur `least` times: all that do, and those that share a slot with others. told: shards' frequent words and pairs."""
    slots = max(part_bits, (words // WORDS_A_SLOT).bit_length())
    hashed = bits.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_hashed(slots, part_bits, least), _HASHED)
    enough = hashed.groupBy("part").applyInArrow(_enough(part_bits, least), _ENOUGH)
    told = told.unionByName(enough, allowMissingColumns=True)
    return bits.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_longer(2, 3, slots, part_bits), _LONGER)


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, id, word, f) of the frequent words, (lang, n) of all words, and (ids, f) of the frequent phrases of two words and more."""
    every, bits = bitmaps(docs)
    of_word = W.partitionBy("lang", "word")
    known = every.withColumn("f", F.sum("n").over(of_word)).withColumn("id", F.min("rid").over(of_word)).where(F.col("f") >= least)
    known = staged(known.select("shard", "row", "rid", "id", "lang", "word", "f"), "words")
    words = known.where("rid = id").select("lang", "id", "word", "f")
    langs = staged(every.groupBy("lang").agg(F.sum("n").alias("n")), "langs")
    pairs = bits.groupBy("shard").cogroup(known.select("shard", "row", "id").groupBy("shard")).applyInArrow(_pairs, _PAIRS)
    often = pairs.withColumn("f", F.sum("n").over(W.partitionBy("a", "b"))).where(F.col("f") >= least)
    often = staged(often.select("shard", "a", "b", "f"), "frequent-pairs")
    none, heard = F.lit(None).cast("long"), known.select("shard", "row", "id", F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("c"))
    told = heard.union(often.select("shard", none, "a", "b", none))
    three = triples(bits, told, langs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], least)
    three = three.withColumn("f", F.sum("n").over(W.partitionBy("ids"))).where(F.col("f") >= least)
    three = staged(three.select("shard", "ids", "f"), "frequent-triples")
    told = heard.union(three.select("shard", none, *(F.col("ids")[i] for i in range(3))))
    longer = bits.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_longer(3, MOST_WORDS), _LONGER)
    longer = longer.groupBy("ids").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    two = often.groupBy("a", "b").agg(F.first("f").alias("f")).select(F.array("a", "b").alias("ids"), "f")
    return words, langs, staged(two.union(three.groupBy("ids").agg(F.first("f").alias("f"))).union(longer), "phrases")


def score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)), exact up to 38 digits."""
    up = a.cast("decimal(19,0)") * n.cast("decimal(19,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", up, l.cast("decimal(19,0)") * r.cast("decimal(19,0)"))


def collocations(docs: DataFrame, least: int = LEAST, reported: int = REPORTED, absorbed: int = ABSORBED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language of docs (text, lang) the phrases whose words go together most.

    A phrase of 2 to 5 words of one piece that occurs a >= least times is cut where floor(1000 a n / (l r)) is
    least, after the fewest words of equal ones; l and r are how often its parts occur, n counts the language's
    words. Phrases within a longer one that has `absorbed` percent of their occurrences go. A null language is
    und, a null text empty; repeated rows count each time; an empty table gives no rows; other columns are not read.
    """
    words, langs, found = phrases(docs, least)
    texts = found.select("ids", "f", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "lang", "word"), "id")
    texts = texts.groupBy("ids", "f").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))

    subs = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("ids") - k + 1), lambda i: F.slice("ids", i, k))))
    within = found.where(F.size("ids") > 2).select(F.explode(subs).alias("ids"), F.col("f").alias("g")).groupBy("ids").agg(F.max("g").alias("g"))
    stay = texts.join(within, "ids", "left").where(F.col("g").isNull() | (100 * F.col("g") < absorbed * F.col("f"))).drop("g").join(langs, "lang")

    parts = found.union(words.select(F.array("id").alias("ids"), "f"))
    cuts = stay.select("lang", "ids", "phrase", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    cuts = cuts.join(parts.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    best = cuts.groupBy("lang", "ids", "phrase", "a", "n").agg(F.min(F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = best.withColumn("part", part).withColumn("of_part", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("of_part") <= reported)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= reported)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, array_to_string(words[s:s + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
      GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1),
inside AS (SELECT lang, array_to_string(words[s:s + j - 1], ' ') AS phrase, max(a) AS g
           FROM (SELECT *, unnest(range(1, k - j + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS j FROM c)) GROUP BY ALL),
stay AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE g IS NULL OR 100 * g < 100 * a),
cuts AS (SELECT s.lang, s.phrase, s.a, s.j, n.n, x.f AS l, y.f AS r, (1000::hugeint * s.a * n.n) // (x.f::hugeint * y.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM stay) s JOIN n USING (lang)
         JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.words[1:j], ' ')
         JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.words[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n::bigint AS n, score::bigint AS score FROM ranked WHERE rank <= 2000
"""
