"""URL filters with redirect equivalence.

Host and path rules decide a url directly, the longest fitting rule first.
Each spelling of a url is a node; edges lead to the spelling that servers
redirect it to, to canonical links and refresh targets in its html, and along
known redirects. A url without a rule of its own follows its component: an
explicit allow in it wins over a block. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .graph import connected_components

#: (verdict, host, path) of the rules that the registered query applies.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MAX_RULES = 1000
#: ``..`` that a relative link may hold one after another.
DEPTH = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a url; all empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def same_page_key(host: Column, path: Column, query: Column) -> Column:
    """A spelling shared by the variants that servers redirect to one another:
    scheme, ``www.`` and ``m.`` hosts, ``.html``, closing slash, fragment, campaign parameters."""
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html$", ""), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[^&]*|ref=[^&]*)", ""), r"^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def spelling(host: Column, path: Column, query: Column) -> Column:
    """The url as it is written, without scheme and fragment; null without a host."""
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def absolute(target: Column, host: Column, path: Column) -> Column:
    """A link's target as an absolute url, as seen from a page; null for fragments and other schemes.

    ``.`` is taken out, and ``..`` with what it leaves, up to ``DEPTH`` times; beyond the root it leaves nothing.
    """
    folder = F.when(F.regexp_extract(path, r"^(.*/)", 1) == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    place = F.when(target.startswith("/"), target).when(target.startswith("?"), F.concat(path, target)).otherwise(F.concat(folder, target))
    head, tail = F.regexp_extract(place, r"^([^?#]*)", 1), F.regexp_extract(place, r"^[^?#]*(.*)$", 1)
    for _ in range(DEPTH):
        head = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"/(\./)+", "/"), r"^(/\.\.)+/", "/"), r"^((?:/[^/]+)*?)/(?!\.\./)[^/]+/\.\./", "$1/")
    other = (target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target).when(other | target.isNull(), None).when(target.startswith("//"), F.concat(F.lit("http:"), target)).otherwise(F.concat(F.lit("http://"), host, head, tail))


def link_targets(pages: DataFrame) -> DataFrame:
    """(u, url): the page's node, and the url of each canonical link or meta refresh in its html."""
    some = pages.filter(F.col("html").rlike("(?i)canonical|refresh"))
    tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?i)(<(?:link|meta)\b[^>]*>)"), F.lit(1)))
    tags = some.select(F.col("node").alias("u"), "host", "path", tag.alias("tag"))
    canonical = F.col("tag").rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*["']?canonical\b""")
    refresh = F.col("tag").rlike(r"""(?i)^<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b""")
    target = F.when(canonical, F.regexp_extract("tag", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)).when(refresh, F.regexp_extract("tag", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    return tags.withColumn("t", target).select("u", absolute(F.col("t"), F.col("host"), F.col("path")).alias("url"))


def _nodes(df: DataFrame, url: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` with host, path, node, key and the own verdict of a url column."""
    host, path, query = split_url(F.col(url))
    df = df.withColumns({"host": host, "path": path, "_q": query})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = (F.col("host"), F.col("path"), F.col("_q"))
    return df.withColumns({"rule": rule, "_own": verdict, "node": spelling(*parts), "key": same_page_key(*parts)}).drop("_q")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url, html).

    ``redirects`` (from_url, to_url) adds known redirects. Columns: page_id,
    host, path, rule, verdict, key (the spelling it is redirected to), component.

    Null url or one without ``://``: host and path empty, no rule, in no
    component, allowed. Null html: no links. Repeated rows: each is judged.
    Rules of equal length cannot both fit one url unless equal; the later one
    then wins. Empty table: no rows. Other columns are ignored. Urls and html
    of any length are read whole; ``base`` tags are not heeded.
    """
    rules = rules or RULES
    base = _nodes(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), "url", rules)
    base = materialize(base.withColumn("html", F.when(F.col("html").rlike("(?i)canonical|refresh"), F.col("html"))), "urls")
    # Written out first: what takes a link apart should not be evaluated once for each of its uses.
    links = _nodes(materialize(link_targets(base), "targets"), "url", rules)
    if redirects is not None:
        ends = [_nodes(redirects.select("from_url", "to_url"), c, rules) for c in ("from_url", "to_url")]
        source = spelling(*split_url(F.col("from_url")))
        links = links.select("u", "node", "key", "_own").union(ends[1].select(source.alias("u"), "node", "key", "_own"))
        links = links.union(ends[0].select(F.col("node").alias("u"), "node", "key", "_own"))
    links = materialize(links.select("u", "node", "key", "_own").filter("u is not null and node is not null"), "links")
    edges = links.select("u", F.col("node").alias("v")).union(links.select(F.col("node").alias("u"), F.col("key").alias("v"))).union(base.select(F.col("node").alias("u"), F.col("key").alias("v")))
    parts = connected_components(edges)
    at = lambda df: df.join(parts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("component", F.coalesce("component", "node")).drop("_n")
    judged = materialize(at(base.select("page_id", "host", "path", "rule", "_own", "node", "key")), "judged")
    # A link's target has a vote as well, whether or not it is among the pages.
    targets = at(links.select("node", "_own")).select("component", "_own")
    votes = judged.select("component", "_own").union(targets).filter("_own is not null and component is not null").groupBy("component").agg(F.max(F.col("_own") == "allow").alias("_allow"))
    # Written out, so that Spark can split a large component in the join.
    votes = materialize(votes.select(F.col("component").alias("_c"), "_allow"), "votes")
    out = judged.join(votes, judged["component"] == votes["_c"], "left")
    method = F.when(F.col("_allow") == False, "block").otherwise("allow")  # noqa: E712
    return out.select("page_id", "host", "path", "rule", F.coalesce("_own", method).alias("verdict"), "key", "component")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_PARTS = """
    CASE WHEN {u} IS NULL OR instr({u}, '://') = 0 THEN '' ELSE substr({u}, instr({u}, '://') + 3) END
"""
_KEY = r"""
    CASE WHEN regexp_replace({h}, '^(www|m)\.', '') <> '' THEN regexp_replace({h}, '^(www|m)\.', '')
      || regexp_replace(regexp_replace({p}, '(/index)?\.html$', ''), '/+$', '')
      || CASE WHEN regexp_replace(regexp_replace({q}, '(^|&)(utm_[^&]*|ref=[^&]*)', '', 'g'), '^&', '') <> ''
         THEN '?' || regexp_replace(regexp_replace({q}, '(^|&)(utm_[^&]*|ref=[^&]*)', '', 'g'), '^&', '') ELSE '' END END
"""
_HOST = "translate(regexp_extract({r}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({r}, '^[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract({r}, '^[^?#]*\?([^#]*)', 1)"
_RULE = """CASE WHEN ({h} = 'example.net' OR {h} LIKE '%.example.net') AND starts_with({p}, '/en/') THEN 'example.net/en/'
         WHEN ({h} = 'example.com' OR {h} LIKE '%.example.com') AND starts_with({p}, '/de/') THEN 'example.com/de/'
         WHEN ({h} = 'org' OR {h} LIKE '%.org') AND starts_with({p}, '/fr/') THEN 'org/fr/'
         WHEN ({h} = 'net' OR {h} LIKE '%.net') AND starts_with({p}, '/') THEN 'net/' END"""
_OWN = "CASE {r} WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' END"
_NODE = "CASE WHEN {h} <> '' THEN {h} || {p} || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END END"


def _absolute_sql() -> str:
    folder = "CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END"
    place = f"CASE WHEN starts_with(t, '/') THEN t WHEN starts_with(t, '?') THEN path || t ELSE {folder} || t END"
    scheme = "regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\\-]*:')"
    return f"""placed_links AS (SELECT u, host, t, {place} AS place FROM targets),
walked AS (
  SELECT u, host, t, 0 AS i, regexp_extract(place, '^([^?#]*)', 1) AS head, regexp_extract(place, '^[^?#]*(.*)$', 1) AS tail FROM placed_links
  UNION ALL
  SELECT u, host, t, i + 1, CASE WHEN regexp_extract(x, '/([^/]+)/\\.\\./', 1) NOT IN ('', '..') THEN regexp_replace(x, '/[^/]+/\\.\\./', '/') ELSE x END, tail
  FROM (SELECT *, regexp_replace(regexp_replace(head, '/(\\./)+', '/', 'g'), '^(/\\.\\.)+/', '/') AS x FROM walked WHERE i < {DEPTH})),
fulls AS (SELECT u, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN t WHEN t = '' OR starts_with(t, '#') OR {scheme} THEN NULL
  WHEN starts_with(t, '//') THEN 'http:' || t ELSE 'http://' || host || head || tail END AS f FROM walked WHERE i = {DEPTH})"""


SQL = f"""
WITH RECURSIVE cut AS (SELECT page_id, url, html, {_PARTS.format(u="url")} AS rest FROM pages),
base AS (
  SELECT page_id, html, {_HOST.format(r="rest")} AS host, {_PATH.format(r="rest")} AS path, {_QUERY.format(r="rest")} AS q FROM cut),
ruled AS (
  SELECT page_id, html, host, path, {_NODE.format(h="host", p="path", q="q")} AS node, {_KEY.format(h="host", p="path", q="q")} AS key,
    {_RULE.format(h="host", p="path")} AS rule
  FROM base),
tags AS (SELECT node AS u, host, path, unnest(regexp_extract_all(html, '(?i)(<(?:link|meta)\\b[^>]*>)', 1)) AS tag FROM ruled),
targets AS (
  SELECT u, host, path, CASE WHEN regexp_matches(tag, '(?i)^<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta\\b[^>]*http-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1) END AS t FROM tags),
{_absolute_sql()},
rests AS (SELECT u, {_PARTS.format(u="f")} AS rest FROM fulls WHERE f IS NOT NULL),
ends AS (SELECT u, {_HOST.format(r="rest")} AS h, {_PATH.format(r="rest")} AS p, {_QUERY.format(r="rest")} AS q FROM rests),
links AS (SELECT * FROM (SELECT u, {_NODE.format(h="h", p="p", q="q")} AS node, {_KEY.format(h="h", p="p", q="q")} AS key, {_RULE.format(h="h", p="p")} AS rule FROM ends) WHERE u IS NOT NULL AND node IS NOT NULL),
edges AS (SELECT u, v FROM (SELECT u, node AS v FROM links UNION SELECT node, key FROM links UNION SELECT node, key FROM ruled) WHERE u <> v),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS node, u AS other FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
parts AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
placed AS (SELECT r.*, coalesce(p.component, r.node) AS component, {_OWN.format(r="rule")} AS own
  FROM ruled r LEFT JOIN parts p ON r.node = p.node),
ballots AS (SELECT component, own FROM placed UNION ALL SELECT coalesce(p.component, l.node), {_OWN.format(r="rule")} FROM links l LEFT JOIN parts p ON l.node = p.node),
votes AS (SELECT component, bool_or(own = 'allow') AS allowed FROM ballots WHERE own IS NOT NULL AND component IS NOT NULL GROUP BY component)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN allowed = false THEN 'block' ELSE 'allow' END) AS verdict, key, p.component AS component
FROM placed p LEFT JOIN votes v ON p.component = v.component
"""
