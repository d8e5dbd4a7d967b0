"""URL policy, discovery, collection planning and page text over the pages table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.html import extract_links, html_to_text
from ..functions.urls import canonical_url, host, published_url, slug, target_id, url_allowed
from ..operators.collection import discover, first_content, listing_pages, page_status, plan_collection, status_counts
from ..operators.publication import repeated_urls
from ..session import load, spread
from .registry import query

# The source families the queries use: one per public suffix of the page table's hosts.
FAMILIES = [
    ("com-family", ["example.com"], ["/en/", "/fr/"]),
    ("net-family", ["example.net"], ["/"]),
    ("org-family", ["example.org"], ["/en/", "/de/", "/es/"]),
]
# Position, family, path prefixes and the share of its links, in hundredths, that a family may bring.
DISCOVERY = [
    (1, "com-family", ["/a", "/e", "/t", "/I"], 75),
    (2, "net-family", ["/"], 75),
    (3, "org-family", ["/o", "/th", "/w"], 50),
]


def families(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "family_id string, hosts array<string>, prefixes array<string>")


def family_of(url) -> Column:
    return F.concat(F.regexp_extract(host(url), r"\.([a-z]+)$", 1), F.lit("-family"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "pages", "page_id", "url").withColumn("family_id", family_of("url"))


def feed(df: DataFrame) -> DataFrame:
    """The pages already published through the feed: their URL carries the feed's campaign tag."""
    return df.where(F.col("url").contains("utm_source=feed"))


# DuckDB pieces: host, path and the canonical form of the table's URLs.
_HOST = "lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_TRIM = f"CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END"
_PARAMS = (
    "list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), "
    "lambda p: p != '' AND NOT regexp_matches(p, '^(utm_[^=]+|fbclid|gclid|mc_cid|mc_eid)(=|$)', 'i'))"
)
_QUERY = "CASE WHEN len({0}) = 0 THEN '' ELSE '?' || array_to_string({0}, '&') END"
_CANONICAL = f"CASE WHEN url LIKE 'https://%' THEN 'https://' || {_HOST} || {_TRIM} || {_QUERY.format(f'list_sort({_PARAMS})')} END"
_PUBLISHED = f"regexp_extract(url, '^(https?://)', 1) || {_HOST} || {_TRIM} || {_QUERY.format(_PARAMS)}"
_FAMILY = f"regexp_extract({_HOST}, '\\.([a-z]+)$', 1) || '-family'"


@query(
    "url_canonical",
    f"""SELECT page_id, {_HOST} AS host, url LIKE 'https://%' AS allowed, {_CANONICAL} AS canonical,
      {_PUBLISHED} AS published FROM pages""",
)
def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "pages", "page_id", "url").select(
        "page_id",
        host("url").alias("host"),
        url_allowed("url").alias("allowed"),
        canonical_url("url").alias("canonical"),
        published_url("url").alias("published"),
    )


_PLAN_SQL = f"""
  t AS (SELECT page_id, {_FAMILY} AS family_id, {_PATH} AS path, {_CANONICAL} AS canonical,
          contains(url, 'utm_source=feed') AS is_feed FROM pages),
  g AS (SELECT *, CASE WHEN canonical IS NULL THEN 'invalid_target'
          WHEN (family_id = 'com-family' AND NOT regexp_matches(path, '^/(en|fr)/'))
            OR (family_id = 'org-family' AND NOT regexp_matches(path, '^/(en|de|es)/')) THEN 'policy_rejected' END AS gate FROM t),
  s AS (SELECT *, coalesce(gate, CASE WHEN canonical IN (SELECT canonical FROM t WHERE is_feed AND canonical IS NOT NULL)
          THEN 'duplicate_published' END) AS early FROM g),
  p AS (SELECT page_id, family_id, canonical, coalesce(early, CASE WHEN page_id = min(page_id) FILTER (WHERE early IS NULL)
          OVER (PARTITION BY canonical) THEN 'pending' ELSE 'duplicate_in_job' END) AS status FROM s)"""


@query("collection_plan", f"WITH {_PLAN_SQL} SELECT page_id, family_id, canonical, status FROM p")
def collection_plan(spark: SparkSession, folder: str) -> DataFrame:
    table = pages(spark, folder)
    targets = table.select(
        F.col("page_id").alias("ordinal"),
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("target_id"),
        "family_id",
        "url",
        F.lit(None).cast("string").alias("text_url"),
    )
    planned = plan_collection(targets, families(spark), feed(table).select("url"))
    return planned.select(F.col("ordinal").alias("page_id"), "family_id", "canonical", "status")


@query(
    "status_counts",
    f"WITH {_PLAN_SQL} SELECT family_id, status, count(*) AS items FROM p GROUP BY ALL",
)
def collection_counts(spark: SparkSession, folder: str) -> DataFrame:
    return status_counts(collection_plan(spark, folder), "family_id")


_LINK_SQL = f"""
  raw AS (SELECT DISTINCT url AS page_url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
  u AS (SELECT DISTINCT {_FAMILY.replace('url', 'page_url')} AS family_id,
          'https://' || {_HOST.replace('url', 'page_url')} || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS url
        FROM raw WHERE page_url LIKE 'https://%'),
  f AS (SELECT family_id, url, {_PATH} AS path FROM u),
  k AS (SELECT family_id, url, row_number() OVER (PARTITION BY family_id ORDER BY url) AS place, count(*) OVER (PARTITION BY family_id) AS n FROM f
        WHERE (family_id = 'com-family' AND regexp_matches(path, '^/[aetI]'))
          OR family_id = 'net-family' OR (family_id = 'org-family' AND regexp_matches(path, '^/(o|th|w)'))),
  sel AS (SELECT family_id, url FROM k WHERE place <= ceil(n * CASE family_id WHEN 'org-family' THEN 50 ELSE 75 END / 100))"""


@query(
    "link_discovery",
    f"""WITH {_LINK_SQL}, seg AS (SELECT *, regexp_extract(url, '([^/]+)/*$', 1) AS last FROM sel)
    SELECT family_id, url, family_id || '-' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(last),
      '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 110), ''), 'source') || '-' || left(sha256(url), 10) AS target_id FROM seg""",
)
def link_discovery(spark: SparkSession, folder: str) -> DataFrame:
    table = spread(load(spark, folder, "pages", "url", "html"))
    links = table.select(family_of("url").alias("family_id"), F.explode_outer(extract_links("html", "url")).alias("url"))
    plan = spark.createDataFrame(DISCOVERY, "position int, family_id string, include array<string>, share int")
    return discover(links, plan, families(spark), load(spark, folder, "pages", "url"))


_TEXT_SQL = """
  a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(head|nav|footer)>.*?</(head|nav|footer)>', '', 'gs'), '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'gs') AS h FROM pages),
  b AS (SELECT page_id, regexp_replace(regexp_replace(h, '<footer>.*$', '', 's'), '(</?(article|div|p|h1|li|ul|br)[^>]*>)+', chr(10) || chr(10), 'g') AS h FROM a),
  c AS (SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS h FROM b),
  t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(h, '[\\t  ]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS text FROM c)"""


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    table = spread(load(spark, folder, "pages"))
    return table.select("page_id", "url", html_to_text("html", F.regexp_extract("url", "#(.*)$", 1)).alias("text"), F.octet_length("html").alias("size"))


@query("html_text", f"WITH {_TEXT_SQL} SELECT page_id, CAST(length(text) AS BIGINT) AS chars, sha256(text) AS text_sha FROM t")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(spark, folder).select(
        "page_id", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("text_sha")
    )


@query(
    "page_status",
    f"""WITH {_TEXT_SQL} SELECT CASE WHEN regexp_matches(text, '(just a moment|checking your browser|verify you are human|access denied)', 'i')
      THEN 'blocked' WHEN length(text) < 80 THEN 'unreadable' ELSE 'readable' END AS status, count(*) AS items FROM t GROUP BY 1""",
)
def page_statuses(spark: SparkSession, folder: str) -> DataFrame:
    judged = page_texts(spark, folder).withColumn(
        "status", page_status(F.col("text"), F.lit("text/html; charset=utf-8"), F.lit(200), F.col("size"))
    )
    return status_counts(judged)


@query(
    "content_dedupe",
    """SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc,
      CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) THEN 'fetched' ELSE 'duplicate_content' END AS status
    FROM documents""",
)
def content_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents", "doc_id", "text")
    hashed = docs.select(F.col("doc_id").alias("ordinal"), F.sha2("text", 256).alias("text_hash"))
    return first_content(hashed).select(
        F.col("ordinal").alias("doc_id"), F.col("first_ordinal").alias("first_doc"), "status"
    )


@query(
    "publication_check",
    f"""WITH c AS (SELECT {_PUBLISHED} AS url, contains(url, 'utm_source=feed') AS published FROM pages)
    SELECT url, CASE WHEN bool_or(published) THEN 'published' ELSE 'repeated' END AS reason, count(*) FILTER (WHERE NOT published) AS rows
    FROM c GROUP BY url HAVING count(*) FILTER (WHERE NOT published) > 0 AND (bool_or(published) OR count(*) > 1)""",
)
def publication_check(spark: SparkSession, folder: str) -> DataFrame:
    table = pages(spark, folder)
    fresh = table.where(~F.col("url").contains("utm_source=feed"))
    return repeated_urls(fresh.select(F.col("page_id").alias("id"), "url"), feed(table).select("url"))


@query(
    "slug_ids",
    f"""SELECT page_id, left(regexp_replace(regexp_replace(lower({_HOST}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 110) AS host_slug,
      {_FAMILY} || '-' || regexp_replace(lower(regexp_extract({_PATH}, '([^/]+)/*$', 1)), '[^a-z0-9]+', '-', 'g') || '-' || left(sha256(url), 10) AS target_id
    FROM pages""",
)
def slug_ids(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select(
        "page_id", slug(host("url")).alias("host_slug"), target_id("family_id", "url").alias("target_id")
    )


@query(
    "listing_expansion",
    f"""WITH s AS (SELECT {_FAMILY} AS family_id, {_HOST} AS host, length({_HOST}) AS stop FROM pages)
    SELECT family_id, CAST(count(*) AS BIGINT) AS listings, sum(CAST(page AS BIGINT)) AS page_sum, min(url) AS first_url FROM (
      SELECT family_id, page, 'https://' || host || '/list?page=' || page AS url FROM (
        SELECT family_id, host, unnest(range(1, greatest(stop, 1) + 1)) AS page FROM s)) GROUP BY family_id""",
)
def listing_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Listing pages of each page's host, as many as its name is long."""
    stop = F.length(host("url"))
    plan = pages(spark, folder).select(
        "family_id",
        F.array(F.concat(F.lit("https://"), host("url"), F.lit("/list?page={page}"))).alias("seeds"),
        F.lit(1).alias("page_start"),
        F.greatest(stop, F.lit(1)).alias("page_end"),
    )
    return (
        listing_pages(plan)
        .groupBy("family_id")
        .agg(F.count("*").alias("listings"), F.sum("page").alias("page_sum"), F.min("url").alias("first_url"))
    )
