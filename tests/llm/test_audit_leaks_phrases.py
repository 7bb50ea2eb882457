"""The audit of sources, the search for benchmark passages and the mining of phrases against plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import collocations, decontamination, source_audit

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, row string, term string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DOCS).repartition(5)


def some_docs(seed, n=120, words=("Alpha", "beta", "gamma", "Δelta", "é", "straße", "X1", "9", "beta")):
    rnd = random.Random(seed)
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "-"]) for _ in range(rnd.randrange(0, 40)))
    rows = [(rnd.choice([None, i, i]), rnd.choice([None, "", text(), text(), text()]), rnd.choice([None, "", "en", "de"]), rnd.choice([None, "a", "b", "ü"])) for i in range(n)]
    return rows + rows[:7]


# audit of sources


def audit_by_loops(rows, least, named):
    docs = [("" if x is None else x for x in r[1:]) for r in rows]
    docs = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(ASCII_LOWER))) for text, lang, source in docs]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for x, _, terms in docs if x == lang for t in set(terms))
        kept = [t for t in seen if seen[t] >= least]
        counts = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, terms in docs:
            if x == lang:
                counts[s].update(t for t in terms if t in kept)
        total = lambda c: sum(c.values()) + 2 * len(kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // total(c) for t in kept} for s, c in counts.items()}
        every = sum(counts.values(), Counter())
        q = {t: 1 + 10**9 * (every[t] + 2) // total(every) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, named)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_audit(spark, seed):
    rows = some_docs(seed) + [(1, "", "fr", "a"), (2, None, "fr", "b"), (3, "solo " * 9, "it", "a")]
    got = source_audit.audit(frame(spark, rows), 6, 3).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == audit_by_loops(rows, 6, 3)


def test_audit_of_nothing(spark):
    assert source_audit.audit(frame(spark, [])).collect() == []


def test_numbers_are_exact_beyond_64_bits():
    n, total = np.array([0, 10**15, 9 * 10**14]), np.array([10**15 + 9, 10**15 + 9, 10**15 + 9])
    assert source_audit.numbers_of(n, total).tolist() == [1 + 10**9 * (int(a) + 2) // int(b) for a, b in zip(n, total, strict=True)]


def test_a_vector_is_evaluated_once(spark):
    rows = [(i, f"{a} {b}", "en", s) for i, (a, b, s) in enumerate([("one", "two", "a"), ("three", "four", "a"), ("one", "two", "b")])]
    vectors = source_audit.term_vectors(frame(spark, rows), 1)
    assert sorted(r["count"] for r in vectors.groupBy("lang", "counts").count().collect()) == [2, 2]


# benchmark passages


def leaks_by_loops(rows, items, window):
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    windows = defaultdict(set)
    for name, text in items:
        words = cut(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add("" if name is None else str(name))
    out = []
    for row in rows:
        words, hit, names = cut(row[1]), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    names |= found
        joined = ",".join(sorted(names))
        out.append((row[0], len(words), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize(("seed", "window"), [(0, 10), (1, 10), (2, 4), (3, 14), (4, 1)])
def test_leaks(spark, seed, window):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "Ab", "é", "7"] if seed % 2 else [f"w{i}" for i in range(40)])
    passage = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(passage(n))) for i, n in enumerate([3, 9, 10, 11, 25, 40, 1, 14])] + [(None, "a b a"), (8, None), (9, "..."), (10, ""), (2, "é é é é é é é é é é é é")]
    rows = []
    for i in range(60):
        text = passage(rnd.randrange(0, 60))
        for _ in range(rnd.randrange(3)):
            _, item = rnd.choice(items)
            part = (item or "").split()
            lo = rnd.randrange(len(part) + 1)
            text += part[lo : lo + rnd.randrange(1, 20)] + passage(rnd.randrange(4))
        rows.append((rnd.choice([None, i]), rnd.choice([", ", " "]).join(text).upper() if i % 3 else " ".join(text), "en", "a"))
    rows += [(1, None, "en", "a"), (2, "", None, None), *rows[:5]]
    known = spark.createDataFrame([(*x, "en") for x in items], "item_id long, text string, words string")
    got = decontamination.contamination(frame(spark, rows), known, window).collect()
    assert Counter(tuple(r) for r in got) == leaks_by_loops(rows, items, window)


def test_leaks_of_nothing(spark):
    rows, none = [(1, "a b c", "en", "a"), (2, None, "en", "a")], spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(frame(spark, []), none).collect() == []
    assert sorted(r.n_words for r in decontamination.contamination(frame(spark, rows), none).where("not contaminated and n_items = 0").collect()) == [0, 3]


def test_a_long_text_and_a_passage_in_many_texts(spark):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*(f"v{rnd.randrange(500)}" for _ in range(20)), *passage]), "en", "a") for i in range(200)]
    rows.append((200, " ".join([*(f"v{rnd.randrange(10**6)}" for _ in range(60_000)), *passage, *passage]), "en", "a"))
    known = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontamination.contamination(frame(spark, rows), known).collect()}
    assert got == {i: 30 for i in range(200)} | {200: 60}


# phrases


def phrases_by_loops(rows, least, most, absorbed):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in counts.items():
        often = [p for p in f if len(p) > 1 and f[p] >= least]
        inside = {q[i : i + k] for q in often for k in range(2, len(q)) for i in range(len(q) - k + 1) if 100 * f[q] >= absorbed * f[q[i : i + k]]}
        found = []
        for p in often:
            if p not in inside:
                score, k = min((1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return out


@pytest.mark.parametrize(("seed", "least", "most", "absorbed"), [(0, 3, 2000, 100), (1, 5, 2000, 100), (2, 4, 12, 100), (3, 3, 2000, 60)])
def test_phrases(spark, seed, least, most, absorbed):
    rows = some_docs(seed, 200) + [(9, "new york city hall of records " * 5 + "!" + "new york", "en", "a")] * 3
    got = collocations.collocations(frame(spark, rows), least, most, absorbed).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == phrases_by_loops(rows, least, most, absorbed)


@pytest.mark.parametrize("part_bits", [8, 16])
def test_rare_triples_of_frequent_pairs_are_not_counted(spark, monkeypatch, part_bits):
    rnd, made, real = random.Random(7), [], collocations.triples
    rows = [(i, " ".join(rnd.choices("abcdefghijkl", k=100) + ["x y z"] * (i % 2)), "en", "a") for i in range(300)]
    monkeypatch.setattr(collocations, "triples", lambda bits, told, words, least: made.append(real(bits, told, words, least, part_bits)) or made[0])
    got = collocations.collocations(frame(spark, rows)).collect()
    assert {tuple(r) for r in got} == phrases_by_loops(rows, 100, 2000, 100)
    counted = Counter()
    for r in made[0].collect():
        counted[tuple(r.ids)] += r.n
    assert max(counted.values()) == 150
    assert len(counted) < 1000  # of 1729


def test_phrases_of_nothing(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None, None), (2, " .,", "en", None)])).collect() == []


def test_a_long_text_of_one_word(spark):
    got = collocations.collocations(frame(spark, [(1, "go " * 150_000, None, None)])).collect()
    assert {tuple(r) for r in got} == {("und", i + 1, " ".join(["go"] * k), 150_001 - k, *cut) for i, (k, *cut) in enumerate(sorted(((k, *best(k)) for k in range(2, 6)), key=lambda x: (-x[-1], -(150_001 - x[0]))))}


def best(k):
    f = lambda j: 150_001 - j
    score, cut = min((1000 * f(k) * 150_000 // (f(j) * f(k - j)), j) for j in range(1, k))
    return f(cut), f(k - cut), 150_000, score


def test_bitmaps_come_back():
    rnd = np.random.default_rng(3)
    sets = [np.sort(rnd.choice(300_000, n, replace=False)) for n in (1, 5000, 0, 60_000, 4096, 250_000, 300_000)]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    words, begins = collocations.packed(owner, np.concatenate(sets).astype(np.int32), len(sets))
    found = [np.zeros(0, np.int64) for _ in sets]
    for who, at in collocations.unpacked(words, begins[:-1], begins[1:]):
        for w in np.unique(who):
            found[w] = np.concatenate([found[w], at[who == w]])
    assert all(np.array_equal(np.sort(a), b) for a, b in zip(found, sets, strict=True))


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, left, right = 10**12, 10**15, 3 * 10**12, 7 * 10**12
    got = spark.range(1).select(collocations.score(*(F.lit(x) for x in (a, n, left, right))).alias("s")).first().s
    assert got == 1000 * a * n // (left * right)
