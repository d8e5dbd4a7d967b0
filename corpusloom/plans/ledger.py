"""Publication, record keys, external ids, references, canonical hashes and best observations over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import record_hash
from ..operators.entities import merge_external_ids, record_key_violations
from ..operators.evaluation import best_observation
from ..operators.publication import publication_violations
from ..operators.versions import related_films
from ..session import load
from .collection import _PUBLISHED, feed
from .registry import query

SHORT_PAGE = 5_000


@query(
    "publication_gate",
    f"""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS id, {_PUBLISHED} AS url, contains(url, 'utm_source=feed') AS published, length(html) < {SHORT_PAGE} AS bad FROM pages),
      b AS (SELECT * FROM p WHERE NOT published), n AS (SELECT count(*) AS n, count(*) FILTER (NOT bad) AS good FROM b),
      k AS (SELECT url, bool_or(published) AS known, count(*) FILTER (NOT published) AS rows FROM p GROUP BY url)
    SELECT 'report' AS rule, NULL AS subject FROM n WHERE good <> n OR n = 0
    UNION ALL SELECT 'admission', id FROM b WHERE bad
    UNION ALL SELECT CASE WHEN known THEN 'url_published' ELSE 'url_repeated' END, url FROM k WHERE rows > 0 AND (known OR rows > 1)""",
)
def publication_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that the feed does not list are a batch against those it does; short ones fail admission and the count."""
    table = load(spark, folder, "pages", "page_id", "url", "html").withColumn("id", F.col("page_id").cast("string"))
    short = F.length("html") < SHORT_PAGE
    fresh = table.where(~F.col("url").contains("utm_source=feed")).select(
        "id", "url", F.when(short, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>")).alias("errors")
    )
    report = fresh.agg(F.count_if(F.size("errors") == 0).alias("published_candidates"), F.count("*").alias("requested")).withColumn("status", F.lit("validated"))
    return publication_violations(fresh, feed(table).select("id", "url"), report)


@query(
    "record_keys",
    """WITH o AS (SELECT o_orderkey AS mention_id, CAST(o_custkey AS VARCHAR) AS source_key, regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS title,
        year(o_orderdate) AS y, lower(o_orderstatus) AS d FROM orders),
      k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY mention_id) = 1)
    SELECT o.mention_id, o.source_key, CASE WHEN o.y <> k.y OR o.d <> k.d THEN 'identity' ELSE 'title' END AS reason
    FROM o JOIN k USING (source_key) WHERE o.y <> k.y OR o.d <> k.d OR o.title <> k.title""",
)
def record_keys(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's first order fixes what its key names: year, status as director, priority as title."""
    orders = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    mentions = orders.select(
        F.col("o_orderkey").alias("mention_id"), F.col("o_custkey").cast("string").alias("source_key"), F.col("o_orderpriority").alias("title"),
        F.array().cast("array<string>").alias("aliases"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("director"),
    )
    row = F.struct("title", "year", "director")
    first = mentions.groupBy("source_key").agg(F.min_by(row, "mention_id").alias("f"), F.min("mention_id").alias("key"))
    plain = F.regexp_replace(F.lower("f.title"), "[^a-z0-9]", "")
    known = first.select("source_key", "key", "f.year", F.lower("f.director").alias("director"), F.array(plain).alias("aliases"))
    return record_key_violations(mentions, known)


@query(
    "external_ids",
    """SELECT l_partkey AS key, l_returnflag AS provider, min(l_suppkey) AS id, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY ALL""",
)
def external_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as a part's ids at each flag; several are a conflict."""
    lines = load(spark, folder, "lineitem", "l_partkey", "l_returnflag", "l_suppkey")
    return merge_external_ids(lines.select(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("provider"), F.col("l_suppkey").alias("id")))


@query(
    "observation_references",
    """WITH q AS (SELECT l_orderkey, arg_min(l_suppkey, {'n': l_linenumber, 's': l_suppkey}) AS s FROM lineitem GROUP BY l_orderkey),
      f AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || p_name, '|' ORDER BY l_linenumber, l_partkey, p_name) AS films
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
    SELECT o_orderkey, s_name AS quote, s_nationkey AS locator, films FROM orders JOIN q ON q.l_orderkey = o_orderkey
    JOIN supplier ON s_suppkey = s LEFT JOIN f ON f.l_orderkey = o_orderkey""",
)
def observation_references(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as observations: their first line's supplier is the quote, their parts the films in order."""
    lines = load(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").withColumnRenamed("l_orderkey", "observation_id")
    orders = load(spark, folder, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "observation_id")
    films = load(spark, folder, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.col("p_brand").alias("director"))
    passages = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("passage_id"), F.col("s_name").alias("text"), F.col("s_nationkey").alias("locator"))
    joined = related_films(
        orders, lines.select("observation_id", F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("ordinal")), films,
        lines.select("observation_id", F.col("l_suppkey").alias("passage_id"), F.struct("l_linenumber", "l_suppkey").alias("ordinal")), passages,
    )
    names = F.array_join(F.transform("films", lambda f: F.concat_ws(":", f["ordinal"].cast("string"), f["title"])), "|")
    return joined.select(F.col("observation_id").alias("o_orderkey"), F.col("text").alias("quote"), "locator", names.alias("films"))


@query(
    "canonical_hashes",
    """SELECT event_id, sha256('{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS content_hash FROM events""",
)
def canonical_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Records by the hash of their canonical JSON; the time of a check, appended here, does not count."""
    raw = F.regexp_replace("props", r"\}$", ', "checkedAt": "now"}')
    return load(spark, folder, "events", "event_id", "props").select("event_id", record_hash(raw).alias("content_hash"))


@query(
    "best_observation",
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders),
      w AS (SELECT o_custkey, o_orderkey, place FROM o JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size >= 10
        GROUP BY ALL HAVING count(*) = count(p_partkey))
    SELECT o_custkey, o_orderkey FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY place) = 1""",
)
def best_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer's first order of which every part is on record, as only those of size 10 and above are."""
    orders = load(spark, folder, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    lines = load(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    films = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("observation_id"), F.struct("o_orderdate", "o_orderkey").alias("rank"), F.col("l_partkey").alias("film_id")
    )
    known = load(spark, folder, "part", "p_partkey", "p_size").where("p_size >= 10").select(F.col("p_partkey").alias("film_id"))
    return best_observation(films, known).select(F.col("request_id").alias("o_custkey"), F.col("observation_id").alias("o_orderkey"))
