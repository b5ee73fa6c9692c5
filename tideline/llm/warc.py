"""WARC revisit resolution: not-modified records find the response they repeat.

Records (record_id, uri, ts, kind, etag, last_modified, digest, headers) are
keyed by canonical uri. Each revisit takes the latest full response strictly
before it, by an as-of join in two levels: inside a block of time, and across a
uri's blocks, so a uri that holds a third of all records is spread over its
blocks. Validators are then compared and the permitted headers of the revisit
are laid over those of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .urls import same_page_key, split_url

BLOCK_SECONDS = 4096
#: Headers that a not-modified answer may bring up to date, as fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def as_of_response(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``records`` with ``key`` and ``r``: the latest response of the same key before each record, or null.

    Of responses with one time the largest record_id is the latest; a response
    at a revisit's own time is not before it. Records without a uri or a
    time match nothing. ``ts`` is a timestamp or a number of seconds.
    """
    uri = F.col("uri").cast("string")
    key = same_page_key(*split_url(uri))
    micros = F.round(F.col("ts").cast("double") * 1_000_000).cast("long")
    base = records.withColumn("key", F.coalesce(key, uri)).withColumn("_t", micros).withColumn("_b", F.floor(F.col("_t") / (block_seconds * 1_000_000)))
    usable = F.col("key").isNotNull() & F.col("ts").isNotNull()
    known, others = base.filter(usable), base.filter(~usable | usable.isNull())
    # Rows of one time form one peer group, which the frame leaves out.
    inside = Window.partitionBy("key", "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    # Ordered by time, then record_id; maps have no order, so headers travel as entries.
    found = F.max(F.when(F.col("kind") == "response", F.struct("_t", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("headers"))))
    last = known.groupBy("key", "_b").agg(found.alias("_last"))
    before = Window.partitionBy("key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_carried", F.max("_last").over(before)).drop("_last")
    joined = known.withColumn("_own", found.over(inside)).join(carried, ["key", "_b"])
    got = joined.withColumn("r", F.coalesce("_own", "_carried")).select(*records.columns, "key", "r")
    return got.unionByName(others.select(*records.columns, "key", F.lit(None).cast(got.schema["r"].dataType).alias("r")))


def merged_headers(old: Column, new: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    """The response's headers under the revisit's permitted ones; names are lower case.

    Maps have no order: of names alike the spelling last by code points counts.
    """
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    names = lambda es: F.transform(es, lambda e: e["key"])
    last = lambda es: bind(F.reverse(names(es)), lambda back: F.filter(es, lambda e, i: F.array_position(back, e["key"]) == F.size(es) - i))
    entries = lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    low = lambda m: F.coalesce(bind(entries(m), lambda es: F.map_from_entries(last(es))), F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(low(new), lambda k, v: k.isin(*permitted))
    return F.map_concat(F.map_filter(low(old), lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def resolve_revisits(records: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """One row per revisit: record_id, key, ts, response_id, status, headers.

    Status is ``resolved`` when a validator agrees (etag, else last_modified,
    else digest: the first that both have), ``changed`` when that one differs,
    ``unchecked`` when they share none, ``orphan`` without an earlier response.
    Headers are merged only where resolved or unchecked, else null.

    Null uri or time: orphan. Null kind: neither a response nor a revisit.
    Repeated rows: each is resolved. Empty table: no rows. Other columns are
    ignored. Of header names that differ only in case within one record the
    spelling last by code points counts. Uris and headers of any length are read
    whole.
    """
    names = ["record_id", "uri", "ts", "kind", "etag", "last_modified", "digest", "headers"]
    rows = as_of_response(records.select(*names), block_seconds).filter("kind = 'revisit'")
    status = F.when(F.col("r").isNull(), "orphan")
    for c in ("etag", "last_modified", "digest"):
        both = F.col(c).isNotNull() & F.col(f"r.{c}").isNotNull()
        status = status.when(both & (F.col(c) == F.col(f"r.{c}")), "resolved").when(both, "changed")
    rows = rows.withColumn("status", status.otherwise("unchecked"))
    headers = F.when(F.col("status").isin("resolved", "unchecked"), merged_headers(F.map_from_entries("r.headers"), F.col("headers")))
    return rows.select("record_id", "key", "ts", F.col("r.record_id").alias("response_id"), "status", headers.alias("headers"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Two records for each page: its response, at a second that is its page_id,
    and a later revisit that a conditional request of the next crawl would give.

    The etag is the html's digest. The revisit comes half a crawl after the
    response; one that finds another page's newer answer to the same canonical
    uri in between carries the etag it was asked with, and so reads as changed.
    """
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    head = lambda **h: F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))])
    both = F.explode(F.array(
        F.struct(F.lit("response").alias("kind"), (F.col("page_id") * 2).alias("record_id"), F.col("page_id").cast("long").alias("ts"), head(content_type=F.lit("text/html"), etag=tag, date=F.col("page_id")).alias("headers")),
        F.struct(F.lit("revisit").alias("kind"), (F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") + 40_000).cast("long").alias("ts"), head(server=F.lit("x"), etag=tag, date=F.col("page_id") + 40_000).alias("headers")),
    ))
    rows = pages.select(F.col("url").alias("uri"), tag.alias("etag"), both.alias("r"))
    return rows.select("uri", "etag", F.lit(None).cast("string").alias("last_modified"), F.col("etag").alias("digest"), "r.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "key", "ts", "response_id", "status", listed.alias("headers"))


def _sql() -> str:
    from .urls import _HOST, _KEY, _PARTS, _PATH, _QUERY

    return f"""
WITH cut AS (SELECT page_id, url, md5(coalesce(html, '')) AS etag, {_PARTS.format(u="url")} AS rest FROM pages),
parts AS (SELECT page_id, url, etag, {_HOST.format(r="rest")} AS host, {_PATH.format(r="rest")} AS path, {_QUERY.format(r="rest")} AS q FROM cut),
keyed AS (SELECT page_id, etag, coalesce({_KEY.format(h="host", p="path", q="q")}, url) AS key FROM parts),
responses AS (SELECT key, page_id AS ts, max(page_id * 2) AS response_id, arg_max(etag, page_id * 2) AS r_etag FROM keyed GROUP BY key, page_id),
revisits AS (SELECT page_id * 2 + 1 AS record_id, key, page_id + 40000 AS ts, etag FROM keyed)
SELECT v.record_id, v.key, v.ts, r.response_id,
  CASE WHEN r.response_id IS NULL THEN 'orphan' WHEN v.etag = r.r_etag THEN 'resolved' ELSE 'changed' END AS status,
  CASE WHEN v.etag = r.r_etag THEN 'content-type=text/html;date=' || v.ts || ';etag=' || v.etag END AS headers
FROM revisits v ASOF LEFT JOIN responses r ON v.key = r.key AND v.ts > r.ts
"""


SQL = _sql()
