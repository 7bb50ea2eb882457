"""Benchmark decontamination by winnowing, in DataFrame functions alone.

Of the hashes of all K-grams of words, the least in every stretch of so many as fit a window is a fingerprint.
A window that a text and an item share has the same K-grams in both, so its least one is a fingerprint of both:
no shared window is missed. The texts' fingerprints meet those of the items; around each that meets, every window
that holds it is compared word by word with the items' windows, and those that are equal are hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, staged, table

#: Words of a window, and of a K-gram.
WINDOW, K = 10, 4
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words, once A-Z are in lower case.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(low, _BETWEEN), "")


def windows_at(words: Column, starts: Column, length: int) -> Column:
    """[(start, window)]: the windows of so many words at the starts, as text."""
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.array_join(F.slice(words, s + 1, F.lit(length)), " ").alias("window")))


def gram(length: int) -> int:
    """How many words the K-grams for windows of so many have: K, or so many that a stretch has no more than eight."""
    return min(length, max(K, length - 7))


def fingerprints(rows: DataFrame, length: int) -> DataFrame:
    """(row, at, print) of rows (row, words): the least hash of each stretch of K-grams that fits a window of length words, and the word where it begins.

    The last three bits of a hash are replaced by those of its place, which tell where in a stretch the least one
    stands; equal K-grams of one stretch differ in them alone, and either stands for both.
    """
    k = gram(length)
    stretch = length - k + 1
    word = lambda i: F.get("words", i)
    grams = rows.where(F.size("words") >= length).withColumn("grams", F.transform("words", lambda w, i: F.xxhash64(w, *(word(i + j) for j in range(1, k))).bitwiseAND(F.lit(-8)).bitwiseOR(i.bitwiseAND(F.lit(7)))))
    whole = F.slice("grams", 1, F.size("words") - k + 1)
    grams = grams.select("row", whole.alias("grams"))
    if stretch > 1:
        least = F.transform("grams", lambda g, i: F.least(g, *(F.get("grams", i + j) for j in range(1, stretch))))
        grams = grams.withColumn("least", F.slice(least, 1, F.size("grams") - stretch + 1))
        place = lambda g, i: i + F.pmod(g.bitwiseAND(F.lit(7)) - i.bitwiseAND(F.lit(7)), F.lit(8)).cast("int")
        chosen = F.transform("least", lambda g, i: F.when((i == 0) | (F.get("least", i - 1) != g), F.struct(place(g, i).alias("at"), F.shiftright(g, 3).alias("print"))))
        chosen = F.filter(chosen, lambda c: c.isNotNull())
    else:
        chosen = F.transform("grams", lambda g, i: F.struct(i.alias("at"), F.shiftright(g, 3).alias("print")))
    return grams.select("row", F.explode(chosen).alias("c")).select("row", "c.at", "c.print")


def occurrences(texts: DataFrame, items: DataFrame, length: int) -> DataFrame:
    """(row, start, window): where a window of so many words of the items (row, words) occurs in the texts (row, words), each place once."""
    every = items.select(F.explode(windows_at(F.col("words"), F.sequence(F.lit(0), F.size("words") - length), length)).alias("w")).select("w.window").distinct()
    known = staged(fingerprints(items, length).select("print").distinct(), "prints")
    seeds = staged(fingerprints(texts, length).join(known, "print").groupBy("row").agg(F.collect_list("at").alias("seeds")), "seeds")
    reach = length - gram(length)
    starts = F.array_distinct(F.flatten(F.transform("seeds", lambda at: F.sequence(F.greatest(at - reach, F.lit(0)), F.least(at, F.size("words") - length)))))
    around = texts.join(seeds, "row").withColumn("starts", starts)
    found = around.select("row", F.explode(windows_at(F.col("words"), F.col("starts"), length)).alias("w")).select("row", "w.start", "w.window")
    return found.join(every, "window", "left_semi")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `window` consecutive words of an item (item_id, text); an item of fewer, but not none, is one
    window. A word inside an occurrence of any window is hit, once. n_items and items_sha256 are of the distinct
    item_ids with a window that occurs, sorted as strings and joined by commas (none: the empty text's); a null
    item_id is the empty string. Null texts have no words; rows that repeat are counted each for itself; without
    a benchmark nothing is hit; an empty table gives no rows. Other columns are not read.
    """
    rows, _ = numbered(docs.select("doc_id", words_of(F.col("text")).alias("words")))
    texts = rows.select("row", "words")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = staged(items.select("item", "words", F.least(F.size("words"), F.lit(window)).alias("length")).withColumn("row", F.monotonically_increasing_id()), "items")
    lengths = [r.length for r in items.select("length").distinct().orderBy("length").collect()]  # at most `window` of them

    hits = None
    for length in lengths:
        own = items.where(F.col("length") == length)
        found = staged(occurrences(texts, own.select("row", "words"), length), "hits")
        names = own.select("item", F.explode(windows_at(F.col("words"), F.sequence(F.lit(0), F.size("words") - length), length)).alias("w")).select("item", "w.window").distinct()
        named = found.select("row", "window").distinct().join(names, "window").groupBy("row").agg(F.collect_set("item").alias("items"))
        spans = found.groupBy("row").agg(F.collect_list(F.struct("start", (F.col("start") + length).alias("end"))).alias("spans"))
        both = spans.join(named, "row")
        hits = both if hits is None else hits.union(both)
    if hits is None:
        hits = texts.where("false").select("row", F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    hits = hits.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")))
    hits = hits.select("row", covered["n"].cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("joined"))

    out = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words")).join(hits, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("joined", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op12(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, words, least(10, len(words)) AS n
      FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark)
      WHERE len(words) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS s FROM b)),
dw AS (SELECT r, s, n, array_to_string(words[s:s + n - 1], ' ') AS win
       FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM b))),
hit AS (SELECT r, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hit)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::varchar AS item_id FROM hit) GROUP BY r)
SELECT doc_id, len(words)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)
"""
