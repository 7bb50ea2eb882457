import gzip
import json
import random
import zipfile
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chunk_dedup, common, context_mixing, line_crf, mixing, near_dedup, queries, quality_cnn, url_filter, warc_zip

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_as_sql_says(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        duck.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = duck.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns).collect()
    assert Counter(tuple(r) for r in got) == Counter(want.fetchall())


def resolve(spark, url, to):
    return spark.range(1).select(url_filter.resolved(F.lit(url), F.lit(to)).alias("r")).first().r


def test_references_are_resolved(spark):
    base = "http://a/b/c/d;p?q"
    want = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "g;x=1/../y": "http://a/b/c/y", "mailto:x@y": None, "http://z": "http://z", "/go?u=http://bad.net/": "http://a/go?u=http://bad.net/"}
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", url_filter.resolved(F.lit(base), F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == want


def test_tags(spark):
    html = {
        '<link rel="nofollow Canonical" href="/x">': "http://h/x",
        "<link data-rel=canonical href=/x>": None,
        '<!-- <link rel=canonical href="/x"> -->': None,
        '<link href="?a=2" rel=canonical>': "http://h/p/q?a=2",
        '<META content="0; URL=../y" http-equiv=Refresh>': "http://h/y",
        '<link rel=canonical href="/go?u=http://bad.net/">': "http://h/go?u=http://bad.net/",
        '<meta name="refresh" content="0; url=/x">': None,
    }
    pages = spark.createDataFrame([("http://h/p/q", k) for k in html], "url string, html string")
    assert sorted(r.target for r in url_filter.links(pages).collect()) == sorted(v for v in html.values() if v)


def test_aliases_against_union_find(spark):
    rnd = random.Random(6)
    urls = [f"http://{h}/{k}" for k in range(20) for h in ("a.org", "bad.net", "c.com")] + ["http://bad.net", "http://bad.net/", "http://d.org/fr/1"]
    edges = [(rnd.choice(urls), rnd.choice(urls)) for _ in range(28)]
    group = {u: u for u in urls}

    def root(u):
        while group[u] != u:
            u = group[u]
        return u

    same = lambda u: u + "/" if u.count("/") == 2 else u
    for a, b in [*edges, ("http://bad.net", "http://bad.net/")]:
        group[root(a)] = root(b)
    own = {u: "block" if "bad.net" in u else "allow" if same(u).startswith("http://d.org/fr/") else None for u in urls}
    verdicts = {u: own[u] or ("block" if "block" in (s := {own[v] for v in urls if root(v) == root(u)}) and "allow" not in s else "allow") for u in urls}
    rows = [(i, u, "".join(f'<link rel=canonical href="{b}">' for a, b in edges if a == u)) for i, u in enumerate(urls)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    linked = {u for e in edges for u in e}
    assert {urls[r.page_id]: r.verdict for r in got} == verdicts and len(linked) > 20


def test_a_package_of_another_writer(spark, tmp_path):
    def raw(i):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/{i}\r\nContent-Length: 3\r\n\r\np{i:02d}\r\n\r\n".encode()

    one, two, first, second = b"", b"", [], []
    for i in range(5):
        packed = gzip.compress(raw(i))
        first.append(f'x)/{i} 2020 {json.dumps({"filename": "one.warc.gz", "offset": str(len(one)), "length": str(len(packed))})}')
        one += packed
    for i in range(5, 8):
        second.append(json.dumps({"filename": "two.warc", "offset": len(two), "length": len(raw(i))}))
        two += raw(i)
    with zipfile.ZipFile(tmp_path / "p.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/one.warc.gz", one)
        z.writestr("archive/two.warc", two)
        z.writestr("indexes/a.cdxj", "!meta {}\n" + "\n".join(first) + "\n")
        z.writestr("indexes/b.cdx.gz", gzip.compress("\n".join(second).encode()))
    packages = spark.createDataFrame([(str(tmp_path / "p.wacz"),)], "path string")
    got = warc_zip.read_packages(packages, with_payload=True).collect()
    assert sorted((r.url, bytes(r.payload)) for r in got) == [(f"http://x/{i}", f"p{i:02d}".encode()) for i in range(8)]
    assert all(r.page_id is None and r.record_type == "response" for r in got)


def test_rows_stay_when_files_are_split_anew(spark, tmp_path, monkeypatch):
    """Between the steps of an operator the files are read in other splits, as after a loss of executors."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(30)) for _ in range(120)]
    rows = [(i, texts[i % 90] + (" more" if i % 7 == 0 else ""), "en", "abc"[i % 3], 7) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long").repartition(12).write.parquet(str(tmp_path / "d"))
    docs, calls = spark.read.parquet(str(tmp_path / "d")), [0]
    staged = common.staged

    def restless(df, name):
        out = staged(df, name)
        calls[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", str(2 + 5 * (calls[0] % 4)))
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << (10 + calls[0] % 3)))
        return out

    def results():
        near = near_dedup.find_near(docs).drop("row_id", "first_row")
        return [Counter(map(tuple, df.collect())) for df in (near, chunk_dedup.dedup(docs).select("text", "row"), near_dedup.dedup(docs), mixing.mixed(docs))]

    before = results()
    for module in (common, chunk_dedup, near_dedup, mixing):
        monkeypatch.setattr(module, "staged", restless)
    try:
        assert results() == before
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(before[1].values()) == len({r[1] for r in rows}) and all(k[1] == 7 for k in before[1])


def test_boilerplate_between_content_is_told_apart():
    prose = ["The miller of the old town went down to the river, and nobody saw him again.", "It was said that the water had taken the wheel away in the night of the storm."]
    menu = ["Home | News | Shop", "Login", "Share | Print"]
    feature = lambda lines: (np.array(line_crf.read_text("\n".join(lines).encode())[0]), np.array([line in menu for line in lines]))
    rnd = random.Random(1)
    read = [feature(lines) for lines in ([x for k in range(4) for x in (prose[rnd.randrange(2)] + f" No {i}{k}.", rnd.choice(menu))] for i in range(60))]
    field = line_crf.train([x for x, _ in read], [line_crf.weak_labels(x, shared, 1) for x, shared in read])
    x, _ = feature([menu[0], prose[0], menu[1], prose[1], menu[2]])
    assert line_crf.viterbi((x @ field.emit).tolist(), field.move.tolist()) == [0, 1, 0, 1, 0]


def test_convolution_is_the_plain_one():
    rng = np.random.default_rng(0)
    net = quality_cnn.train([b"some text" * 40, b"other words here " * 30], np.array([0, 1]), epochs=1)
    ids = rng.integers(0, 256, (2, quality_cnn.CHUNK))
    got = quality_cnn.convolve(net, ids)
    for row, t, f in ((0, 0, 0), (1, 100, 5), (1, quality_cnn.CHUNK - quality_cnn.WIDTH, 23)):
        assert abs(got[row, t, f] - sum(net.conv[k, ids[row, t + k], f] for k in range(quality_cnn.WIDTH))) < 1e-4


def test_base_columns_of_the_language_model_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").withColumn("f", context_mixing.fold(F.col("doc_id"), 10)).collect()
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in rows}
    counts = Counter(t for r in rows if r.f for t in tokens[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    for r in context_mixing.op7(spark, SF).collect():
        own = tokens[r.doc_id]
        base = sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[t] > 0 for t in own), n) and abs(r.base_score - base) < 1e-6 * abs(base)
        assert r.score < 0 and abs(r.bits_per_byte * max(1, len((dict((x.doc_id, x.text) for x in rows)[r.doc_id] or "").encode())) * np.log10(2) + r.score) < 1e-6 * abs(r.score)


def test_codes_are_free_of_prefixes():
    counts = np.random.default_rng(1).integers(1, 1000, 300)
    code, length, way = context_mixing.halving_code(counts)
    words = {format(c, f"0{n}b") for c, n in zip(code, length)}
    assert len(words) == 300 and not any(a != b and b.startswith(a) for a in words for b in words)
    assert sum(2.0 ** -len(w) for w in words) == 1 and [len(w) for w in way] == length.tolist()
    assert (counts * length).sum() / counts.sum() < 0.5 - (counts / counts.sum() * np.log2(counts / counts.sum())).sum()
