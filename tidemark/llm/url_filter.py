"""URL filters with redirect equivalence, in DataFrame functions alone.

Rules block or allow hosts and paths. URLs that redirects or canonical links connect are aliases: they form
components, found as distributed connected components, and a block of one is one of all, unless a rule allows
one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.graph import components

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Tags that may name another URL of the same page, once comments are gone.
_COMMENT, _TAG = r"(?s)<!--.*?(-->|$)", r"(?is)<(?:link|meta)\b[^>]*>"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^?#]*(\?[^#]*)?", 1)


def name_of(url: Column) -> Column:
    """What aliases are joined by: host, path (the root's is /, if empty) and query; null without a host."""
    host, path = host_of(url), path_of(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query_of(url)))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, without its quotes; empty if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1), "^[\"']|[\"']$", ""))


def without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(part == ".", done).otherwise(F.concat(done, F.array(part))),
    )
    ends = F.element_at(parts, -1).isin(".", "..")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))).otherwise(path)


def resolved(url: Column, to: Column) -> Column:
    """The reference to against the base url, by RFC 3986; null if it has another scheme than those with hosts."""
    scheme = F.concat(F.substring_index(url, "://", 1), F.lit(":"))
    base = F.concat(scheme, F.lit("//"), F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))
    to = F.regexp_replace(to, "#.*$", "")
    path, query = F.regexp_extract(to, r"^[^?]*", 0), F.regexp_extract(to, r"^[^?]*(\?.*)?$", 1)
    own = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return (
        F.when(to.rlike(_SCHEME), F.when(to.rlike(_SCHEME + "//"), to))
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to == "", F.concat(base, own, query_of(url)))
        .when(path == "", F.concat(base, own, query))
        .when(to.startswith("/"), F.concat(base, without_dots(path), query))
        .otherwise(F.concat(base, without_dots(F.concat(F.regexp_replace(own, r"[^/]*$", ""), path)), query))
    )


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical links and refreshes in the pages' html, the target resolved against the url.

    A link is canonical if canonical is one of the words of its rel. Tags in comments don't count.
    """
    tags = pages.where(F.col("html").rlike(r"(?i)\b(canonical|refresh)\b")).select("url", F.explode(F.regexp_extract_all(F.regexp_replace("html", _COMMENT, ""), F.lit(_TAG), 0)).alias("tag"))
    tag = F.col("tag")
    is_link = tag.rlike(r"(?i)^<link\b")
    canonical = F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = F.regexp_extract(attribute(tag, "content"), r"(?is)^\s*[\d.]*\s*[;,]\s*url\s*=\s*[\"']?([^\"'\s>]+)", 1)
    to = F.when(is_link & canonical, attribute(tag, "href")).when(~is_link & (F.lower(attribute(tag, "http-equiv")) == "refresh"), refresh)
    found = tags.select("url", F.replace(to, F.lit("&amp;"), F.lit("&")).alias("to")).where("to <> '' and instr(url, '://') > 0")
    return found.select("url", resolved(F.col("url"), F.col("to")).alias("target")).where("target is not null")


def best_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) of the places (host, path) that a rule fits: the longest; of equal ones, that of the longer host, then allow.

    Hosts meet rules by equality with one of their suffixes, of as many labels as any rule has.
    """
    labels = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first().n or 0
    parts = F.split("host", r"\.")
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - labels + 1), labels or 1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, labels or 1), "."))
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "action")
    fits = places.withColumn("suffix", F.explode(suffixes)).join(rules, "suffix").where(F.col("path").startswith(F.col("start")))
    rank = F.struct((F.length("suffix") + F.length("start")).alias("n"), F.length("suffix").alias("h"), (F.col("action") == "allow").alias("a"), F.concat("suffix", "start").alias("rule"), "action")
    return fits.groupBy("host", "path").agg(F.max(rank).alias("r")).select("host", "path", "r.rule", "r.action")


def judge(pages: DataFrame, rules=RULES, more_links: DataFrame | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, host, path, rule, verdict.

    The longest rule that fits a url decides. Without one, a url whose aliases a rule blocks is blocked if no
    rule allows one of them; all others are allowed. more_links: further (url, target), as of a redirect log.
    A url that is null or has no "://" has empty host and path, fits no rule, and has no aliases. Null html has
    no links. Repeated rows are judged alike; an empty table gives no rows.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, host string, path string")
    made = links(pages.select("url", "html"))
    made = made.union(more_links.select("url", "target")) if more_links is not None else made
    ends = made.select(F.explode(F.array("url", "target")).alias("url"))
    place = [host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), name_of(F.col("url")).alias("name")]
    ends = ends.select(*place).where("name is not null").distinct()
    rows = pages.select("page_id", *place)

    best = best_rules(rows.select("host", "path").union(ends.select("host", "path")).distinct(), rules)
    groups = components(made.select(name_of(F.col("url")).alias("a"), name_of(F.col("target")).alias("b")))
    known = ends.join(best, ["host", "path"]).join(groups.withColumnRenamed("node", "name"), "name")
    blocked = known.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    alias = groups.join(blocked.where("blocked and not allowed"), "component").select(F.col("node").alias("name"), F.lit("block").alias("of_alias"))
    out = rows.join(best, ["host", "path"], "left").join(alias, "name", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "of_alias", F.lit("allow")).alias("verdict"))


def op8(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


#: The pages of the test tables hold no redirects or canonical links, so the rules alone decide there; links are tested against a union-find in tests/llm.
OP8_SQL = r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
place AS (
  SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM (SELECT DISTINCT host, path FROM place) d JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM place LEFT JOIN fit USING (host, path)
"""
