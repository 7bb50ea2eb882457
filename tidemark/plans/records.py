"""Queries over records, timelines and text, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as sf
from tidemark.operators import events as ev
from tidemark.operators import records as rc
from tidemark.operators import scoring as sc
from tidemark.operators import series as se
from tidemark.operators import timeline as tl
from tidemark.plans.labels import rounded
from tidemark.sources import tables as tb

_HITS = "hits AS (SELECT user_id AS media_id, event_id AS hit_idx, epoch_us(ts) / 3.6e9 AS t, value / 500 AS strength, json_extract_string(props, '$.k')::DOUBLE / 99 AS confidence FROM events)"
_RALLIES = """rallies AS (SELECT o_custkey AS media_id, o_orderkey AS rally_id, epoch_us(o_orderdate) / 8.64e10 AS start, o_totalprice / 10000 AS duration,
  epoch_us(o_orderdate) / 8.64e10 + o_totalprice / 10000 AS end_, (o_orderkey % 29)::INT AS shots, ((o_orderkey * 7) % 101) / 100.0::DOUBLE AS speed,
  ((o_orderkey * 3) % 97) / 96.0::DOUBLE AS confidence FROM orders)"""
_CLIPS = f"{_RALLIES}, clips AS (SELECT media_id AS track_id, rally_id AS clip_id, start AS src_in, end_ AS src_out, CASE WHEN rally_id % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS speed, (rally_id % 50)::DOUBLE AS tl_start FROM rallies), len AS (SELECT *, (src_out - src_in) / greatest(speed, 1e-6) AS dur FROM clips)"
_TOKENS = r"tokens AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) - 1 AS pos FROM conversations)"


def _read(name, f):
    return lambda s, d: f(tb.read(s, d, name))


def _r(f):
    return lambda s, d: f(tb.rallies(s, d))


def _c(f):
    return lambda s, d: f(tl.clips(tb.rallies(s, d)))


def _projects(s, d):
    rows = tb.read(s, d, "orders").join(tb.read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rows.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("duration"), F.min("o_orderkey").alias("first"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("done"))
    return out


def _upsert(s, d):
    part = tb.read(s, d, "part").select("p_partkey", "p_brand", "p_size")
    new = part.where("p_partkey % 3 = 0").select((F.col("p_partkey") + 1000000 * F.pmod("p_partkey", F.lit(2))).alias("p_partkey"), F.when(F.pmod("p_partkey", F.lit(5)) != 0, F.lit("new")).alias("p_brand"), (F.col("p_size") + 1).alias("p_size"))
    return rc.upserted(part, new, ["p_partkey"])


def _purge(s, d):
    gone = tb.read(s, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("media_id"))
    rows = rc.purged({"rallies": tb.rallies(s, d), "hits": tb.hits(s, d)}, gone)
    counts = [df.groupBy("media_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(k)) for k, df in rows.items()]
    return counts[0].unionAll(counts[1])


def _range(pages):
    size, spec = F.octet_length("html"), F.concat(F.lit("bytes="), F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat(F.lit("-"), F.col("page_id").cast("string"))).when(F.pmod("page_id", F.lit(3)) == 1, F.concat((F.col("page_id") * 10).cast("string"), F.lit("-"))).otherwise(F.concat(F.lit("5-"), F.col("page_id").cast("string"))))
    first, last, status = rc.byte_range(size.cast("long"), spec)
    return pages.where("html is not null").select("page_id", first.alias("first"), last.alias("last"), status.alias("status"))


def _tokens(conv):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return conv.select("conv_id", "turn", F.posexplode(words).alias("pos", "word"))


def _phrases(conv):
    pairs = _tokens(conv)
    ahead = W.partitionBy("conv_id", "turn").orderBy("pos")
    rows = pairs.withColumn("next", F.lead("word").over(ahead)).where(F.levenshtein(F.concat_ws(" ", "word", "next"), F.lit("of the")) <= 1).where("next is not null")
    return rows.groupBy("conv_id").agg(F.min(F.struct("turn", "pos")).alias("m"), F.count("*").alias("n")).select("conv_id", F.col("m.turn").alias("turn"), F.col("m.pos").alias("pos"), "n")


def _polygon(b):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))
    return b.select("box_id", F.round(rc.shoelace(ring), 6).alias("area"), rc.good_polygon(ring).alias("good"))


def _speech(s, d):
    hits = tb.hits(s, d)
    inside = ev.clusters(hits, 12.0, 2).withColumnRenamed("cluster", "rally_id")
    phrases = tb.read(s, d, "events").select(F.col("event_id").alias("hit_idx"), F.col("event_type").alias("phrase"))
    return tl.events_in(inside, hits.join(phrases, "hit_idx"), 1.0, 24.0)


ALL = {
    "src_list_projects": (
        _projects,
        "SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS duration, min(o_orderkey) AS first, max((o_orderstatus = 'F')::INT) AS done FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    ),
    "src_sample_step": (_r(lambda r: r.where(F.pmod("rally_id", F.lit(4)) == 0).select("media_id", "rally_id")), f"WITH {_RALLIES} SELECT media_id, rally_id FROM rallies WHERE rally_id % 4 = 0"),
    "src_sample_uniform": (
        lambda s, d: tl.midpoints(tb.signal(s, d), 7),
        "WITH signal AS (SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx, l_quantity AS value FROM lineitem), n AS (SELECT media_id, count(*) AS n FROM signal GROUP BY 1), g AS (SELECT media_id, i, floor(n * (i + 0.5::DOUBLE) / 7)::BIGINT AS idx FROM n, range(7) t(i)) SELECT g.media_id, i::INT AS i, g.idx, value FROM g JOIN signal s ON s.media_id = g.media_id AND s.idx = g.idx",
    ),
    "src_media_probe": (
        _read("part", lambda p: p.select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_brand")), F.when(F.col("p_size") > 10, F.col("p_type")), F.col("p_name")).alias("found"))),
        "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, CASE WHEN p_size > 10 THEN p_type END, p_name) AS found FROM part",
    ),
    "src_expand_paths": (
        _read("part", lambda p: rc.expanded(p.select(F.concat(F.col("p_brand"), F.lit("/clip"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 10, ".MP4").otherwise(".txt")).alias("path")), ("mp4", "mov"))),
        "SELECT p_brand || '/clip' || p_partkey || '.MP4' AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INT AS place FROM part WHERE p_size > 10",
    ),
    "src_exports": (
        lambda s, d: tb.read(s, d, "orders").join(tb.read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_custkey"),
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    ),
    "src_range_read": (
        _read("pages", _range),
        "WITH p AS (SELECT page_id, octet_length(encode(html)) AS n, CASE page_id % 3 WHEN 0 THEN greatest(0, octet_length(encode(html)) - page_id) WHEN 1 THEN page_id * 10 ELSE 5 END AS a, CASE page_id % 3 WHEN 2 THEN least(octet_length(encode(html)) - 1, page_id) ELSE octet_length(encode(html)) - 1 END AS b FROM pages WHERE html IS NOT NULL) SELECT page_id, CASE WHEN a < n AND a <= b THEN a END AS first, CASE WHEN a < n AND a <= b THEN b END AS last, CASE WHEN a < n AND a <= b THEN 206 ELSE 416 END AS status FROM p",
    ),
    "src_pairs": (
        _read("pages", lambda p: p.select("page_id", F.regexp_extract("url", r"://([^/?#]+)", 1).alias("token")).where("token <> ''").withColumn("rn", F.row_number().over(W.partitionBy("token").orderBy("page_id"))).where("rn = 1").select("token", "page_id")),
        "SELECT regexp_extract(url, '://([^/?#]+)', 1) AS token, min(page_id) AS page_id FROM pages WHERE regexp_extract(url, '://([^/?#]+)', 1) <> '' GROUP BY 1",
    ),
    "snk_upsert": (
        _upsert,
        "WITH new AS (SELECT p_partkey + 1000000 * (p_partkey % 2) AS k, CASE WHEN p_partkey % 5 <> 0 THEN 'new' END AS b, p_size + 1 AS z FROM part WHERE p_partkey % 3 = 0) SELECT coalesce(p_partkey, k) AS p_partkey, coalesce(b, p_brand) AS p_brand, coalesce(z, p_size) AS p_size FROM part FULL JOIN new ON p_partkey = k",
    ),
    "snk_clear_paths": (_read("part", lambda p: rc.cleared(p, F.col("p_size") > 30, ["p_brand", "p_type"]).select("p_partkey", "p_brand", "p_type")), "SELECT p_partkey, CASE WHEN p_size > 30 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN p_size > 30 THEN NULL ELSE p_type END AS p_type FROM part"),
    "snk_cache": (_read("documents", lambda d: d.groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))), "SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1"),
    "snk_pack": (
        lambda s, d: se.subsample(tb.signal(s, d), 50),
        "WITH signal AS (SELECT l_suppkey AS media_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS idx, l_quantity AS value FROM lineitem), n AS (SELECT media_id, count(*) AS n FROM signal GROUP BY 1), g AS (SELECT DISTINCT media_id, floor(i * (n - 1) / 49.0::DOUBLE)::BIGINT AS idx FROM n, range(50) t(i)) SELECT s.media_id, s.idx, s.value FROM signal s JOIN g ON s.media_id = g.media_id AND s.idx = g.idx",
    ),
    "snk_preset": (lambda s, d: _polygon(tb.boxes(s, d)), "WITH u AS (SELECT vec_id, [least(1.3, greatest(-0.3, 0.5 + 1.5 * e::DOUBLE))::DOUBLE for e in embedding] AS e FROM embeddings), b AS (SELECT vec_id AS box_id, abs((e[1] - e[2]) * (e[3] - e[4])) AS a FROM u) SELECT box_id, round(a, 6) AS area, a >= 0.02 AS good FROM b"),
    "snk_render": (
        _c(lambda c: tl.render_plan(c)),
        f"WITH {_CLIPS}, s AS (SELECT track_id, count(*) AS n, max(src_out) - min(src_in) AS span, sum(src_out - src_in) AS content FROM len GROUP BY 1) SELECT track_id, n, CASE WHEN n <= 80 AND NOT (span > 1.5 * content AND content > 1) THEN 'single' ELSE 'segmented' END AS plan FROM s",
    ),
    "flt_bulk": (
        _r(lambda r: rc.patched(r.withColumn("keep", F.lit(True)).withColumn("note", F.lit("")), (F.col("speed") < 0.2) & (F.col("shots") < 5), {"keep": False, "speed": 0}).groupBy("media_id").agg(F.count_if("updated").alias("updated"), F.count_if("keep").alias("kept"))),
        f"WITH {_RALLIES} SELECT media_id, count_if(speed < 0.2 AND shots < 5)::BIGINT AS updated, count_if(NOT (speed < 0.2 AND shots < 5))::BIGINT AS kept FROM rallies GROUP BY 1",
    ),
    "prj_id_check": (_read("customer", lambda c: c.where(F.col("c_mktsegment").rlike("^[A-Za-z0-9_]+$")).select("c_custkey")), "SELECT c_custkey FROM customer WHERE regexp_matches(c_mktsegment, '^[A-Za-z0-9_]+$')"),
    "prj_phrases": (
        _read("conversations", lambda c: c.select("conv_id", "turn", F.array_join(sf.phrases(F.split("text", ","), 2, 3), "|").alias("phrases"))),
        r"WITH w AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ','), lambda x: left(regexp_replace(x, '\s', '', 'g'), 3)), lambda x: x <> '') AS p FROM conversations), k AS (SELECT conv_id, turn, list_filter(p, lambda x, i: list_position(p, x) = i) AS p FROM w) SELECT conv_id, turn, array_to_string(p[1:2], '|') AS phrases FROM k",
    ),
    "prj_clamp": (_r(lambda r: rounded(r.select("rally_id", sf.clamp(F.col("duration"), 0, 30).alias("bonus"), sf.clamp(F.col("speed"), 0, 0.95).alias("gate"), sf.clamp(F.col("confidence"), 0.05, 2).alias("window")), "bonus", "gate", "window")), f"WITH {_RALLIES} SELECT rally_id, round(least(30, greatest(0, duration)), 6) AS bonus, round(least(0.95, greatest(0, speed)), 6)::DOUBLE AS gate, round(least(2, greatest(0.05, confidence)), 6)::DOUBLE AS window FROM rallies"),
    "prj_public": (_read("orders", lambda o: o.select("o_orderkey", F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_totalprice")).alias("result"))), "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice END AS result FROM orders"),
    "prj_quality_default": (_read("labels", lambda x: x.select("doc_id", F.coalesce(F.when(F.col("toxic") == 0, F.col("quality").cast("double")), F.lit(0.6)).alias("sharp"))), "SELECT doc_id, coalesce(CASE WHEN toxic = 0 THEN quality::DOUBLE END, 0.6)::DOUBLE AS sharp FROM labels"),
    "jn_event_interval": (
        _speech,
        f"WITH {_HITS}, ga AS (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t, hit_idx) AS gap FROM hits), c AS (SELECT *, sum(CASE WHEN gap > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS rally_id FROM ga), k AS (SELECT media_id, rally_id, min(t) AS s, max(t) AS e FROM c GROUP BY 1, 2 HAVING count(*) >= 2), f AS (SELECT k.media_id, k.rally_id, event_type AS phrase, min(t) AS t FROM k JOIN hits h ON h.media_id = k.media_id AND t >= s - 1 AND t <= e + 1 JOIN events ON event_id = hit_idx GROUP BY 1, 2, 3) SELECT media_id, rally_id, count(*) AS n, string_agg(phrase, ',' ORDER BY t, phrase) AS phrases FROM f GROUP BY 1, 2",
    ),
    "jn_semi_ids": (lambda s, d: tb.rallies(s, d).join(tb.read(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("media_id")), "media_id", "left_semi").select("media_id", "rally_id"), "SELECT o_custkey AS media_id, o_orderkey AS rally_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"),
    "jn_anti_orphan": (lambda s, d: tb.read(s, d, "customer").join(tb.read(s, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"),
    "jn_purge": (
        _purge,
        f"WITH {_RALLIES}, {_HITS}, gone AS (SELECT c_custkey AS m FROM customer WHERE c_acctbal < 0) SELECT media_id, count(*) AS n, 'rallies' AS name FROM rallies WHERE media_id NOT IN (SELECT m FROM gone) GROUP BY 1 UNION ALL SELECT media_id, count(*), 'hits' FROM hits WHERE media_id NOT IN (SELECT m FROM gone) GROUP BY 1",
    ),
    "so_top40": (_r(lambda r: rc.top_share(r, "speed", 0.4, ["media_id"], "rally_id").where("kept").select("media_id", "rally_id")), f"WITH {_RALLIES}, k AS (SELECT media_id, rally_id, row_number() OVER (PARTITION BY media_id ORDER BY speed DESC, rally_id) AS rn, count(*) OVER (PARTITION BY media_id) AS n FROM rallies) SELECT media_id, rally_id FROM k WHERE rn <= ceil(0.4::DOUBLE * n)"),
    "so_list": (_r(lambda r: rounded(rc.newest(r, "duration", 50, "rally_id").select("rally_id", "duration"), "duration")), f"WITH {_RALLIES} SELECT rally_id, round(duration, 6) AS duration FROM rallies ORDER BY rallies.duration DESC, rally_id LIMIT 50"),
    "so_jobs": (
        lambda s, d: rc.pruned(tb.read(s, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderdate", 2, "o_orderkey").select("o_custkey", "o_orderkey"),
        "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE o_orderstatus <> 'F' OR rn <= 2",
    ),
    "so_best_poster": (_r(lambda r: r.groupBy("media_id").agg(F.max(F.struct("speed", (-F.col("rally_id")).alias("k"), ((F.col("start") + F.col("end")) / 2).alias("t"))).alias("m")).select("media_id", F.round("m.t", 6).alias("poster"))), f"WITH {_RALLIES} SELECT media_id, round((start + end_) / 2, 6) AS poster FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY speed DESC, rally_id) AS rn FROM rallies) WHERE rn = 1"),
    "so_next": (
        _r(lambda r: tl.next_after(r, 0.02).select("media_id", "rally_id", "next_id")),
        f"WITH {_RALLIES} SELECT a.media_id, a.rally_id, (SELECT b.rally_id FROM rallies b WHERE b.media_id = a.media_id AND b.start > a.end_ + 0.02 ORDER BY b.start, b.rally_id LIMIT 1) AS next_id FROM rallies a",
    ),
    "set_union_ids": (lambda s, d: tb.read(s, d, "orders").select(F.col("o_custkey").alias("id")).union(tb.read(s, d, "events").select(F.col("user_id").alias("id"))).distinct(), "SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events"),
    "set_intersect": (lambda s, d: tb.read(s, d, "orders").select(F.col("o_custkey").alias("id")).intersect(tb.read(s, d, "events").select(F.col("user_id").alias("id"))), "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events"),
    "set_except": (lambda s, d: tb.read(s, d, "customer").select(F.col("c_custkey").alias("id")).exceptAll(tb.read(s, d, "events").select(F.col("user_id").alias("id")).distinct()), "SELECT c_custkey AS id FROM customer EXCEPT SELECT user_id FROM events"),
    "sp_match_tokens": (
        _read("conversations", _phrases),
        f"WITH {_TOKENS}, n AS (SELECT *, lead(word) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nx FROM tokens), h AS (SELECT * FROM n WHERE nx IS NOT NULL AND levenshtein(word || ' ' || nx, 'of the') <= 1), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM h) SELECT conv_id, turn, pos, n FROM r WHERE rn = 1",
    ),
    "sp_windows": (
        lambda s, d: rounded(tl.hopping(ev.clusters(tb.hits(s, d), 6.0, 3), 3.0, 1.5).select("media_id", "cluster", "lo", "hi"), "lo", "hi"),
        f"WITH {_HITS}, ga AS (SELECT *, t - lag(t) OVER (PARTITION BY media_id ORDER BY t, hit_idx) AS gap FROM hits), c AS (SELECT *, sum(CASE WHEN gap > 6 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM ga), k AS (SELECT media_id, cluster, min(t) AS s, max(t) AS e FROM c GROUP BY 1, 2 HAVING count(*) >= 3), w AS (SELECT media_id, cluster, s, e, unnest(range(greatest(1, ceil((e - s - 3) / 1.5) + 1)::BIGINT)) AS i FROM k) SELECT media_id, cluster, round(s + i * 1.5, 6) AS lo, round(s + i * 1.5 + 3, 6) AS hi FROM w",
    ),
    "wn_magnet": (_c(lambda c: rounded(tl.compacted(c), "tl_start")), f"WITH {_CLIPS} SELECT track_id, clip_id, round(coalesce(sum(dur) OVER (PARTITION BY track_id ORDER BY tl_start, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6)::DOUBLE AS tl_start FROM len"),
    "wn_ripple": (
        _c(lambda c: rounded(tl.rippled(c, F.pmod("clip_id", F.lit(4)) == 0), "tl_start")),
        f"WITH {_CLIPS} SELECT a.track_id, a.clip_id, round(a.tl_start - coalesce((SELECT sum(dur) FROM len b WHERE b.track_id = a.track_id AND b.clip_id % 4 = 0 AND b.tl_start < a.tl_start), 0), 6)::DOUBLE AS tl_start FROM len a WHERE clip_id % 4 <> 0",
    ),
    "clip_algebra": (
        _c(lambda c: rounded(tl.source_times(tl.compacted(c), c, 10.0), "src_t")),
        f"WITH {_CLIPS}, p AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY track_id ORDER BY tl_start, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS pos FROM len) SELECT track_id, clip_id, round(src_in + (10 - pos) * speed, 6) AS src_t FROM p WHERE pos <= 10 AND 10 < pos + dur",
    ),
    "en_timeline": (_c(lambda c: rounded(tl.durations(c), "duration")), f"WITH {_CLIPS} SELECT track_id, round(max(tl_start + dur), 6) AS duration FROM len GROUP BY 1"),
    "en_path": (
        _read("orders", lambda o: rc.free_suffix(o.select(F.col("o_custkey").alias("base"), F.pmod("o_orderkey", F.lit(4)).alias("taken")))),
        "WITH g AS (SELECT DISTINCT o_custkey AS base, s AS suffix FROM orders, range(5) t(s)), t AS (SELECT DISTINCT o_custkey, o_orderkey % 4 AS k FROM orders) SELECT base, min(suffix) AS suffix FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE o_custkey = base AND k = suffix) GROUP BY 1",
    ),
    "en_proxy": (
        _read("part", lambda p: p.select("p_partkey", *[c.alias(n) for n, c in zip(("w", "h"), sf.proxy_size(F.col("p_size") * 100, F.col("p_size") * 50 + 31, 960))])),
        "WITH s AS (SELECT p_partkey, p_size * 100 AS w, p_size * 50 + 31 AS h, least(1, 960 / greatest(p_size * 100, p_size * 50 + 31)::DOUBLE) AS k FROM part) SELECT p_partkey, greatest(2, 2 * floor(w * k / 2))::INT AS w, greatest(2, 2 * floor(h * k / 2))::INT AS h FROM s",
    ),
    "en_batch": (_read("events", lambda e: e.groupBy("user_id").agg(F.min("event_id").alias("first"))), "SELECT user_id, min(event_id) AS first FROM events GROUP BY 1"),
    "en_jobs": (_read("orders", lambda o: o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("active"))), "SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderstatus = 'O' GROUP BY 1"),
    "en_draft": (_r(lambda r: r.select("media_id", "rally_id", F.row_number().over(W.partitionBy("media_id").orderBy("start", "rally_id")).alias("index"), "shots")), f"WITH {_RALLIES} SELECT media_id, rally_id, row_number() OVER (PARTITION BY media_id ORDER BY start, rally_id)::INT AS index, shots FROM rallies"),
    "ag_threshold": (_r(lambda r: rounded(r.groupBy("media_id").agg(F.percentile("speed", F.lit(0.6)).alias("threshold")), "threshold")), f"WITH {_RALLIES} SELECT media_id, round(quantile_cont(speed, 0.6), 6) AS threshold FROM rallies GROUP BY 1"),
    "ag_coverage": (
        lambda s, d: rounded(ev.bin_share(tb.hits(s, d), 24.0, 24.0 * 365), "coverage"),
        f"WITH {_HITS} SELECT media_id, round(count(DISTINCT floor(t / 24)) / 365.0::DOUBLE, 6) AS coverage FROM hits GROUP BY 1",
    ),
    "wn_lag_gaps": (lambda s, d: rounded(ev.gaps(tb.hits(s, d)).select("media_id", "hit_idx", "gap"), "gap"), f"WITH {_HITS} SELECT media_id, hit_idx, round(t - lag(t) OVER (PARTITION BY media_id ORDER BY t, hit_idx), 6) AS gap FROM hits"),
    "wn_running_max": (lambda s, d: tb.hits(s, d).select("media_id", "hit_idx", F.round(F.max("strength").over(W.partitionBy("media_id").orderBy("t", "hit_idx").rowsBetween(W.unboundedPreceding, 0)), 6).alias("top")), f"WITH {_HITS} SELECT media_id, hit_idx, round(max(strength) OVER (PARTITION BY media_id ORDER BY t, hit_idx ROWS UNBOUNDED PRECEDING), 6) AS top FROM hits"),
    "fn_format": (
        _r(lambda r: r.select("rally_id", sf.timecode(F.col("duration") * 100, 25).alias("code"), sf.grade(F.col("speed") * 100).alias("grade"))),
        f"WITH {_RALLIES}, f AS (SELECT rally_id, speed * 100 AS s, floor(duration * 100 * 25)::BIGINT AS n FROM rallies) SELECT rally_id, format('{{:02d}}:{{:02d}}:{{:02d}}:{{:02d}}', n // 90000, n // 1500 % 60, n // 25 % 60, n % 25) AS code, CASE WHEN s >= 85 THEN 'S' WHEN s >= 70 THEN 'A' WHEN s >= 55 THEN 'B' WHEN s >= 40 THEN 'C' ELSE 'D' END AS grade FROM f",
    ),
}
