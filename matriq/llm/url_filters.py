"""URL filters: host and path rules, carried over to aliases by components over redirect and canonical links.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm.common import ascii_lower, attach, materialize, read
from matriq.llm.components import connected_components

#: (verdict, host, path); longest wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
IS_CANONICAL = r"""(?is)\brel\s*=\s*["']?canonical\b"""
IS_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*([^"'\s>]+)"""


def rest_of(url: Column) -> Column:
    """What follows the first ://, empty if there is none or the url is null."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(rest: Column) -> Column:
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(rest: Column) -> Column:
    """What names a page: host, path and query, whatever its scheme or fragment; null where there is no host."""
    host = host_of(rest)
    return F.when(host != "", F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null; rules are few enough to be part of the plan."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules: give them as a table to join instead")
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return reduce(lambda a, b: F.when(b.isNotNull() & (a.isNull() | (b["size"] > a["size"])), b).otherwise(a), fits[1:], fits[0])


def targets_of(html: Column) -> Column:
    """Targets of all canonical links and all refresh redirects, &amp; as &; null for null HTML."""
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda t: t.rlike(IS_CANONICAL))
    metas = F.filter(F.regexp_extract_all(html, F.lit(META), F.lit(0)), lambda t: t.rlike(IS_REFRESH))
    found = F.concat(F.transform(links, lambda t: F.regexp_extract(t, HREF, 1)), F.transform(metas, lambda t: F.regexp_extract(t, REFRESH_URL, 1)))
    return F.transform(found, lambda t: F.replace(t, F.lit("&amp;"), F.lit("&")))


def resolved(host: Column, path: Column, to: Column) -> Column:
    """Host, path and query of a target without :// or leading slash, seen from a page's host and path; null if it has a scheme."""
    to_path, to_query = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"^[^?#]*([^#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^/(.*/)?", 1)
    steps = F.split(F.concat(folder, to_path), "/", -1)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    end = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    found = F.when(to_path == "", F.concat(host, path, to_query)).otherwise(F.concat(host, F.lit("/"), F.array_join(kept, "/"), end, to_query))
    return F.when(~to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & ~to.startswith("#"), found)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) page keys of the canonical links and refresh redirects in the pages' HTML.

    Targets without a host are seen from the page's URL (a base element is not read), dot segments of relative ones
    resolved. Those with a scheme but no :// (mailto:) name no page, and a fragment alone is the page itself.
    """
    rest = rest_of(F.col(url_col))
    found = pages.select(
        key_of(rest).alias("src"),
        host_of(rest).alias("_host"),
        path_of(rest).alias("_path"),
        F.explode(targets_of(F.col(html_col))).alias("_to"),
    ).where("_to <> '' AND src IS NOT NULL")
    to = F.col("_to")
    target = (
        F.when(to.contains("://"), rest_of(to))
        .when(to.startswith("//"), to.substr(F.lit(3), F.length(to)))
        .when(to.startswith("/"), F.concat("_host", to))
        .otherwise(resolved(F.col("_host"), F.col("_path"), to))
    )
    return found.select("src", key_of(target).alias("dst")).where("dst IS NOT NULL AND src <> dst").distinct()


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    edges: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    The longest rule that fits decides. A page without one takes the decision of its aliases, the
    URLs that all canonical links, all redirects (see link_edges) and `edges` (src, dst as URLs) connect with it: allow if a
    rule allows any of them, else block if a rule blocks any, else allow. A null URL, or one without
    ://, has an empty host and path, fits no rule, has no alias and is allowed. Null HTML has no
    links; repeated rows and repeated ids each keep their row; no pages give no rows. Rules of equal
    length: the one listed first. Further columns are ignored.
    """
    rest = rest_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("_id"), host_of(rest).alias("host"), path_of(rest).alias("path"), key_of(rest).alias("_key"))
    rows = rows.withColumn("_r", rule_for(F.col("host"), F.col("path"), rules))
    found = link_edges(pages, url_col, html_col)
    if edges is not None:
        given = edges.select(key_of(rest_of(F.col("src"))).alias("src"), key_of(rest_of(F.col("dst"))).alias("dst"))
        found = found.union(given.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst"))
    found = materialize(found.distinct())
    verdict = F.col("_r.verdict")
    if not found.isEmpty():
        parts = materialize(connected_components(found.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
        of = F.col("node")
        said = rule_for(host_of(of), path_of(of), rules)["verdict"]
        groups = parts.withColumn("_said", said).groupBy("component").agg(
            F.when(F.bool_or(F.col("_said") == "allow"), "allow").when(F.bool_or(F.col("_said") == "block"), "block").alias("_alias")
        )
        known = parts.join(groups, "component").where("_alias IS NOT NULL").select(F.col("node").alias("_key"), "_alias")
        rows = attach(materialize(rows), materialize(known), "_key", ["_alias"], "_id")
        verdict = F.coalesce(verdict, F.col("_alias"))
    return rows.select(F.col("_id").alias(id_col), "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(verdict, F.lit("allow")).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


_SQL_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_SQL_SPLIT = r"""
regexp_extract(r, '^[^/?#]*', 0) AS h0, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(r, '^[^/?#]*([^#]*)', 1) AS pq
"""
SQL = rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {_SQL_RULES}),
p0 AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p1 AS (SELECT page_id, html, {_SQL_SPLIT} FROM p0),
p2 AS (SELECT page_id, html, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, pq FROM p1),
p AS (SELECT *, CASE WHEN host <> '' THEN host || pq END AS k FROM p2),
tags AS (
  SELECT k, host, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag, 0 AS kind FROM p WHERE k IS NOT NULL
  UNION ALL SELECT k, host, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')), 1 FROM p WHERE k IS NOT NULL),
goes AS (
  SELECT k, host, regexp_extract(replace(tag, '&amp;', '&'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS t FROM tags
  WHERE kind = 0 AND regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b')
  UNION ALL SELECT k, host, regexp_extract(replace(tag, '&amp;', '&'), '(?is)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*([^"''\s>]+)', 1) FROM tags
  WHERE kind = 1 AND regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')),
rests AS (SELECT k, CASE WHEN strpos(t, '://') > 0 THEN substr(t, strpos(t, '://') + 3) WHEN t LIKE '//%' THEN substr(t, 3) WHEN t LIKE '/%' THEN host || t END AS r FROM goes WHERE t <> ''),
split AS (SELECT k, {_SQL_SPLIT} FROM rests WHERE r IS NOT NULL),
e AS (SELECT DISTINCT k AS a, lower(h0) || pq AS b FROM split WHERE h0 <> '' AND k <> lower(h0) || pq),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, w.b FROM reach JOIN both_ways w ON w.a = reach.b),
seen AS (SELECT a, b, regexp_extract(b, '^[^/?#]*', 0) AS host, regexp_extract(b, '^[^/?#]*([^?#]*)', 1) AS path FROM reach),
said AS (
  SELECT s.a, s.b, arg_max(u.verdict, length(u.host || u.path)) AS v FROM seen s
  JOIN rules u ON (s.host = u.host OR ends_with(s.host, '.' || u.host)) AND starts_with(s.path, u.path) GROUP BY s.a, s.b),
alias AS (SELECT a, CASE WHEN bool_or(v = 'allow') THEN 'allow' ELSE 'block' END AS v FROM said GROUP BY a),
own AS (
  SELECT p.host, p.path, arg_max(u.host || u.path, length(u.host || u.path)) AS rule, arg_max(u.verdict, length(u.host || u.path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY 1, 2)
SELECT p.page_id, p.host, p.path, own.rule, coalesce(own.verdict, alias.v, 'allow') AS verdict
FROM p LEFT JOIN own ON p.host = own.host AND p.path = own.path LEFT JOIN alias ON alias.a = p.k
"""
