import hashlib
import io
import random
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup, context_mixing, line_crf, mixing, near_dedup, packing, quality_cnn, toxicity_fm, url_filter, warc_zip
from tidemark.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_id long, key string"
LONG = " ".join(f"word{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, ties, and columns with names that operators use within."""
    rnd = random.Random(4)
    base = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rnd.randrange(99)) for _ in range(60)) for _ in range(6)]
    rows = [(1, base[0], "en", "a"), (2, base[0], "en", "a"), (3, base[0] + " more", "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \n ", "en", None), (7, base[1], "en", "b"), (7, base[1], "en", "b"), (None, base[2], "en", "c"), (9, LONG, "en", "c"), (10, "one two", "en", "a"), (11, "ONE\ttwo", "en", "a"), (12, base[3], "de", "c")]
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame([(*r, 0, 1, "k") for r in rows], DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "d")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 1), (10, 0, 0), (12, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")


def test_exact(docs, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in chunk_dedup.find_copies(docs).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (4, 5, 2, False), (5, 5, 2, True), (7, 7, 2, True), (7, 7, 2, False), (None, None, 1, True), (9, 9, 1, True)} <= got
    assert chunk_dedup.dedup(docs).count() == 10 and chunk_dedup.find_copies(none).count() == 0


def test_chunks_depend_on_the_bytes_alone():
    raw = np.frombuffer(random.Random(2).randbytes(200_000), np.uint8)
    whole = chunk_dedup.cut_candidates(raw, 0, len(raw))
    assert (whole == chunk_dedup.cut_candidates(raw, 0, len(raw), 5000)).all()
    ends = chunk_dedup.chunk_ends(0, len(raw), whole.tolist())
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= chunk_dedup.MOST and sizes[:-1].min() >= chunk_dedup.LEAST
    moved = np.concatenate([raw[:999], raw])
    again = set((np.array(chunk_dedup.chunk_ends(0, len(moved), chunk_dedup.cut_candidates(moved, 0, len(moved)).tolist())) - 999).tolist())
    assert len(again & set(ends)) > 0.8 * len(ends)


def test_near(docs, none):
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in near_dedup.find_near(docs).collect()}
    assert {(1, 1, 56), (2, 1, 56), (3, 1, 57), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 56), (10, 10, 1), (11, 10, 1), (None, None, 56)} <= got
    assert near_dedup.dedup(docs).count() == 9 and near_dedup.find_near(none).count() == 0


def test_a_close_pair_shares_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, near_dedup.SLOTS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.SLOTS, near_dedup.RADIUS, replace=False)] ^= 1
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(1).all()


def test_near_groups_against_brute_force(spark, tmp_path):
    rnd, texts = random.Random(8), []
    for _ in range(6):
        words = [f"w{rnd.randrange(500)}" for _ in range(40)]
        for _ in range(12):
            texts.append(" ".join(w if rnd.random() > 0.04 else f"x{rnd.randrange(9)}" for w in words))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(36)} for t in texts]
    group = list(range(len(texts)))
    for _ in group:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = min(group[i], group[j])
    got = near_dedup.find_near(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(group))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(50, 51), (52, 51), (60, 60), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50, 52: 50}


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == 13 and all(r.taken <= 2 * r.size for r in got)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.target <= 2 * r.source_size
    assert all(r.source_size == sizes[r.source] for r in got)
    assert sorted(map(tuple, mixing.mix(docs).drop("row_id").collect()), key=str) == sorted(map(tuple, [r[1:] for r in got]), key=str)
    assert mixing.mix(none).count() == 0 and mixing.mixed(docs).count() == sum(r.reps for r in got)


def test_mixed_rows_are_those_of_the_plan(spark, tmp_path):
    """Sources of many rows, of rows that all share one id or none, and of texts without words."""
    rnd = random.Random(8)
    rows = [(i, "w " * rnd.randint(0, 9), "abc"[i % 3], i) for i in range(400)]
    rows += [(rnd.choice([7, 7, None]), "v " * rnd.randint(1, 5), "d", 1000 + i) for i in range(60)]
    rows += [(5, "u " * (i % 4), None, 2000 + i) for i in range(40)] + [(3, None, "e", 3000), (4, "", "e", 3001)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, at int").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    key = lambda r: (r.doc_id, r.source, r.size)
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[key(r)] += r.reps
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = Counter(out.select("doc_id", "source", "at", mixing.n_words(F.col("text")).alias("size")).collect())
    by_key = Counter()
    for r, n in got.items():
        by_key[key(r)] += n
        assert n <= 2
    assert by_key == +plan


def test_mixing_neither_copies_nor_shuffles_texts(spark, tmp_path, monkeypatch):
    text = F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(k)))) for k in range(40)])
    spark.range(2000).select(F.col("id").alias("doc_id"), text.alias("text"), (F.col("id") % 3).cast("string").alias("source")).repartition(4).write.parquet(str(tmp_path / "d"))
    docs, written = spark.read.parquet(str(tmp_path / "d")), []
    staged = mixing.staged
    monkeypatch.setattr(mixing, "staged", lambda df, name: written.append(df.columns) or staged(df, name))
    monkeypatch.setattr("tidemark.llm.common.staged", lambda df, name: written.append(df.columns) or staged(df, name))
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert written and not any({"text", "doc"} & set(c) for c in written)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_pack(docs, none):
    import public_tokenizers

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, path).collect()
    coder = packing.Encoder(path).tokenizer
    for row in docs.where("doc_id in (4, 9, 12)").collect():
        ids = np.array([*coder.encode(row.text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in got if r.doc_id == row.doc_id), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids) and [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine] == [r.ids_crc32 for r in mine]
    full = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert full.get(r.sequence_id, 0) == r.offset
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 1024 and packing.pack(none, path).count() == 0


def test_encoder_parts_texts_safely():
    import public_tokenizers

    e, rnd = packing.Encoder(str(public_tokenizers.path("byte_bpe_50k.json")), 50), random.Random(1)
    parts = ["a", "B", " ", " ", "  ", "\n", "\t", "'s", "é", "1", "!", " ", "<|endoftext|>", "日本", "\x85", "\x1c", "foo"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tasks_share_an_encoder_and_small_texts_a_call(monkeypatch):
    import public_tokenizers

    path, calls, made = str(public_tokenizers.path("byte_bpe_50k.json")), [], []
    encode, make = packing.Encoder.encode, packing.Encoder.__init__
    monkeypatch.setattr(packing.Encoder, "encode", lambda self, texts: calls.append(len(texts)) or encode(self, texts))
    monkeypatch.setattr(packing.Encoder, "__init__", lambda self, path: made.append(path) or make(self, path))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([None, "one two", "three"] * 1000)], ["doc_id", "text"])
    packing.encoder_of.cache_clear()
    for _ in range(2):
        got = list(packing._tokenise(path, 2, 1024)(iter([batch])))
        assert sum(len(b) for b in got) == 3000
    packing.encoder_of.cache_clear()
    assert calls == [3000, 3000] and made == [path]
    rnd = np.random.default_rng(5)
    for sizes in ([], [0, 0], [9, 1, 1, 0, 10, 11, 3], rnd.integers(0, 12, 50).tolist()):
        cuts = packing.runs_of(np.array(sizes, np.int64), 10)
        assert [k for a, b in cuts for k in range(a, b)] == list(range(len(sizes)))
        assert all(b - a == 1 or sum(sizes[a:b]) <= 10 for a, b in cuts) and all(sum(sizes[a : b + 1]) > 10 for a, b in cuts[:-1])


def test_best_fit_is_the_tightest():
    rnd = random.Random(3)
    lengths = sorted((rnd.randint(1, 100) for _ in range(400)), reverse=True)
    bins, offsets, n = packing.best_fit(lengths, 100)
    rooms = []
    for length, b, offset in zip(lengths, bins, offsets):
        fits = [r for r in rooms if r >= length]
        if fits:
            assert rooms[b] == min(fits)
        else:
            rooms.append(100)
            assert b == len(rooms) - 1
        assert offset == 100 - rooms[b]
        rooms[b] -= length
    assert n == len(rooms)


def test_rules(docs, none, labels):
    got = {r.doc_id: r for r in line_crf.apply_rules(docs, line_crf.fit(docs, labels)).collect()}
    assert (got[4].n_words, got[4].base_failed, got[6].n_words, got[9].n_words) == (0, True, 0, 30_000)
    assert line_crf.apply_rules(none, None).count() == 0
    _, _, n, dup, repeated = line_crf.read_text(b"a b c\n\na b c\n \n\nd a b c")
    assert (n, dup, repeated) == (10, 1, 9)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(20):
        scores, move = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(scores[i, l] for i, l in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731, E741
        best = max((tuple((k >> i) & 1 for i in range(6)) for k in range(64)), key=value)
        assert tuple(line_crf.viterbi(scores.tolist(), move.tolist())) == best


def test_classifiers(docs, none, labels):
    for module in (quality_cnn, toxicity_fm):
        got = module.classify(docs, module.fit(docs, labels)).collect()
        assert len(got) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
        assert module.classify(none, None).count() == 0 and module.fit(docs, labels.limit(0)) is None


def test_pair_term_of_the_machine():
    m = toxicity_fm.Machine(0.5, np.array([1.0, 2, 4, 0]), np.array([[1.0, 0], [2, 1], [0, 3], [0, 0]]))
    z = toxicity_fm.logit(m, np.array([0, 1, 2]), np.array([0, 2, 2, 3]))
    assert z.tolist() == [0.5 + 3 + 2, 0.5, 4.5]


def test_machine_learns_a_label_of_a_pair_alone():
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(0, 2, (2, 3000))
    texts = [np.unique(np.r_[10 + x, 20 + y, rnd.integers(100, 130, 4)]) for x, y in zip(a, b)]
    m = toxicity_fm.train(texts[:2400], (a ^ b)[:2400])
    p = toxicity_fm.logit(m, np.concatenate(texts[2400:]), np.cumsum([0, *map(len, texts[2400:])]))
    assert ((p > 0) == (a ^ b)[2400:]).mean() > 0.95


def test_language_model(docs, none):
    got = {r.doc_id: r for r in context_mixing.score(docs).collect()}
    assert got[4].n_tokens == 1 and got[9].n_tokens == 30_001 and all(np.isfinite(r.score) and r.score < 0 for r in got.values())
    assert context_mixing.score(none).count() == 0
    at, nodes, bits = context_mixing.prefix_code()
    codes = {tuple(bits[a:b]) for a, b in zip(at, at[1:])}
    assert len(codes) == 256 and sum(2.0 ** -len(c) for c in codes) == 1


def test_a_short_text_refines_its_weights(monkeypatch):
    counts = np.array([50, 30, 10, 5, 5])
    code, length, way = context_mixing.halving_code(counts)
    blob = context_mixing.pack_words(np.arange(5), counts, code + (np.int64(1) << length), np.zeros(5, bool), [w.tobytes() for w in way], [])
    words, rnd = context_mixing.Words([blob]), np.random.default_rng(1)
    pairs, start = (rnd.integers(0, 9, context_mixing.STARTS[-1]) * 257).astype(np.uint16), np.full((context_mixing.INPUTS, context_mixing.GATES), 0.3, np.float32)
    cost = lambda ids: context_mixing.read_texts(words, pairs, start, np.array(ids), np.zeros(len(ids), np.int64), np.array([False]))[0][0]
    short, long = [0, 4], [4, 2] * 100 + [0]
    got = cost(short), cost(long)
    monkeypatch.setattr(context_mixing, "RATE", 0)
    assert got[0] == cost(short)  # below 64 bits
    assert got[1] < 0.995 * cost(long)
    assert (start == np.float32(0.3)).all()


def test_words_of_a_block_are_unpacked_without_copies():
    import tracemalloc

    n, none = 200_000, 10
    counts = np.arange(n, 0, -1) + 1
    code, length, way = context_mixing.halving_code(counts)
    blob = lambda lo, hi: context_mixing.pack_words(np.arange(lo, hi), counts[lo:hi], (code + (np.int64(1) << length))[lo:hi], np.zeros(hi - lo, bool), [w.tobytes() for w in way[lo:hi]], [])
    unknown = [f"zz{i}" for i in range(none)]
    spelled = context_mixing.pack_words(np.arange(n, n + none), np.zeros(none, np.int64), np.zeros(none, np.int64), np.zeros(none, bool), [b""] * none, unknown)
    blobs = [blob(lo, lo + 5000) for lo in range(0, n, 5000)] + [spelled]
    tracemalloc.start()
    try:
        words = context_mixing.Words(blobs)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert words.known == length.sum() and words.sizes[:n].tolist() == length.tolist()
    slots, bits, _, sizes = context_mixing.spelled(unknown)
    assert words.sizes[n:].tolist() == sizes.tolist() and words.spelling.tolist() == slots.tolist()
    assert (words.packed[words.known :] & np.uint64(1)).tolist() == bits.tolist()
    assert words.at[n:].tolist() == (words.known + np.cumsum(sizes) - sizes).tolist()
    assert peak < 1.9 * words.packed.nbytes


def test_logarithms_are_those_of_one_and_x():
    x = np.r_[0, np.exp(np.arange(-40, 61, 0.01))].astype(np.float32)
    assert np.allclose(context_mixing.log_of_1_and(x), np.log1p(x.astype(np.float64)), rtol=1e-6, atol=0)


def test_costs_are_those_of_a_logarithm_a_bit():
    rnd = np.random.default_rng(3)
    sizes, of = np.array([1, 8, 9, 300, 7]), np.array([1, 0, 1, 3, 0])
    x = np.exp(rnd.uniform(-40, 60, sizes.sum())).astype(np.float32)
    want = np.bincount(np.repeat(of, sizes), np.log1p(x.astype(np.float64)), 4)
    assert np.allclose(context_mixing.log_of_products(x, np.cumsum(sizes) - sizes, sizes, of, 4), want, rtol=1e-12, atol=0)


def test_what_a_text_had_at_a_node_against_a_loop():
    rnd = np.random.default_rng(4)
    sizes = np.array([0, 30, 2000, 900, 20_000, 1, 16_384, 0])
    nodes, bits = rnd.integers(0, 500, sizes.sum()).astype(np.uint32) << np.uint32(32 - context_mixing.HISTORY), rnd.integers(0, 2, sizes.sum()).astype(np.int32)
    want, at = [], 0
    for n in sizes:
        had = {}
        for node, bit in zip(nodes[at : at + n].tolist(), bits[at : at + n].tolist()):
            seen = had.setdefault(node, [0, 0])
            want.append(np.log((min(63, seen[1]) + 0.4) / (min(63, seen[0]) + 0.4)))
            seen[bit] += 1
        at += n
    assert np.allclose(context_mixing.before_in_text(nodes, sizes, bits, None), want, atol=1e-6)


def test_a_long_text_in_pieces_is_read_as_one(spark, tmp_path, monkeypatch):
    rnd = random.Random(7)
    texts = [(i, " ".join(rnd.choice(["red", "green", "blue", f"w{rnd.randrange(40)}"]) for _ in range(n))) for i, n in enumerate([700, 20, 900, 5] * 10)]
    path = str(tmp_path / "d")
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(path)
    whole = {r.doc_id: r for r in context_mixing.score(spark.read.parquet(path)).collect()}
    some = list(context_mixing.batches_of([(0, np.arange(10)), (1, np.arange(25)), (2, np.arange(3))], 10))
    assert [[(r, len(x), e) for r, x, e in b] for b in some] == [[(0, 10, True)], [(1, 10, False)], [(1, 10, False)], [(1, 5, True)], [(2, 3, True)]]
    assert all(whole[i].n_tokens == len(t.split()) + 1 for i, t in texts)


def test_shuffled_words_cost_more(spark, tmp_path):
    rnd = random.Random(3)
    phrases = [[f"{a}{rnd.randrange(9)}" for a in "ba be bi bo bu ca ce ci".split()] for _ in range(20)]
    ids = [(r.doc_id, r.held) for r in spark.range(300).select(context_mixing.fold(F.col("id"), 10).alias("f"), F.col("id").alias("doc_id")).selectExpr("doc_id", "f = 0 AS held").collect()]
    texts = []
    for i, held in ids:
        words = [w for _ in range(8) for w in rnd.choice(phrases)]
        texts.append((i, " ".join(words)))
        if held:
            texts.append((i + 1000, " ".join(rnd.sample(words, len(words)))))
    path = str(tmp_path / "d")
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {r.doc_id: r.score for r in context_mixing.score(spark.read.parquet(path)).collect()}
    pairs = [(got[i], got[i + 1000]) for i, held in ids if held]
    assert len(pairs) > 10 and sum(a for a, _ in pairs) > 0.9 * sum(b for _, b in pairs)  # logarithms, below 0


def test_urls(spark):
    made = "page_id long, url string, html string, host string"
    rows = [(1, "http://a.org/x", '<link rel="canonical" href="http://bad.net/q">'), (2, "http://A.org/y?z", '<meta http-equiv="refresh" content="0; url=/x">'), (3, None, None), (4, "nourl", ""), (5, "http://c.org/fr/1", "<LINK href=http://z.org/ rel=canonical>"), (6, "http://k.com/", '<link rel=canonical href="//z.org/">')]
    pages = spark.createDataFrame([(*r, "h") for r in rows], made)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {1: ("a.org", "/x", None, "block"), 2: ("a.org", "/y", None, "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("c.org", "/fr/1", "org/fr/", "allow"), 6: ("k.com", "/", None, "allow")}
    more = spark.createDataFrame([("http://k.com/", "http://q.net/")], "url string, target string")
    assert {r.page_id: r.verdict for r in url_filter.judge(pages, more_links=more).collect()}[6] == "allow"  # an alias is allowed
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "u", "same"), (2, "u\n", "same"), (3, None, None), (4, "x", ""), (None, "n", "same"), (5, "l", "ü" * 300_000), (2, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    packages = warc_zip.write_packages(pages, warc_zip.folder_for(spark), most=1000)
    got = warc_zip.read_packages(packages, with_payload=True).collect()
    assert sorted(((r.page_id or -1), r.record_type, r.refers_to) for r in got) == sorted([(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (-1, "revisit", 2), (5, "response", None)], key=lambda x: x[:2])
    large = next(r for r in got if r.page_id == 5)
    assert large.payload == bytearray(("ü" * 300_000).encode()) and large.payload_bytes == 600_000
    assert large.payload_digest == __import__("base64").b32encode(hashlib.sha1(large.payload).digest()).decode()
    empty = warc_zip.write_packages(pages.limit(0), warc_zip.folder_for(spark))
    assert warc_zip.read_packages(empty).count() == 0


def test_zip64_directory():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
        for i in range(65_600):
            z.writestr(f"m{i}", b"")
        with z.open("last", "w", force_zip64=True) as m:
            m.write(b"here")
        z.comment = b"PK\5\6 in a comment"
    found = warc_zip.members(f)
    assert len(found) == 65_601 and warc_zip.read_range(f, warc_zip.stored_at(f, found[-1]), found[-1].size) == b"here"
    with pytest.raises(ValueError):
        warc_zip.members(io.BytesIO(b"no package at all, though long enough"))
