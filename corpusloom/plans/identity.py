"""Identity matching, banded matching, containment and merging over parts, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import identity_text, normalize_casefold, search_norm, title_key
from ..operators.containment import containment
from ..operators.entities import band_neighbours, cascade, credit_matches, merge_entities, resolve_mentions, union_last_wins
from ..operators.search import search_entities as search
from ..session import load
from .registry import query

@query(
    "person_key_match",
    """WITH n AS (SELECT n_nationkey, n_name FROM nation),
      r AS (SELECT s_suppkey, [s_name, n_name] AS names FROM supplier JOIN n ON s_nationkey = n_nationkey),
      l AS (SELECT 'nation-' || n_nationkey AS left_id, [n_name] AS names FROM n
        UNION ALL SELECT 'customer-' || c_custkey, [n_name, replace(c_name, 'Customer', 'Supplier')] FROM customer JOIN n ON c_nationkey = n_nationkey)
    SELECT left_id, count(*) AS matches, min(s_suppkey) AS first_match FROM l JOIN r
      ON CASE WHEN len(l.names) = 1 THEN list_contains(r.names, l.names[1]) ELSE list_sort(l.names) = list_sort(r.names) END
    GROUP BY left_id""",
)
def person_key_match(spark: SparkSession, folder: str) -> DataFrame:
    """Nations (one name) and customers (two names, in another order) against supplier credits."""
    nation = load(spark, folder, "nation", "n_nationkey", "n_name")
    suppliers = load(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey")
    rights = suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("right_id"), F.concat_ws(" & ", "s_name", "n_name").alias("credit")
    )
    customers = load(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey")
    lefts = nation.select(F.concat(F.lit("nation-"), "n_nationkey").alias("left_id"), F.col("n_name").alias("credit")).unionByName(
        customers.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("customer-"), "c_custkey").alias("left_id"),
            F.concat_ws(", ", "n_name", F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("credit"),
        )
    )
    return credit_matches(lefts, rights)


_PART_MENTIONS = """
  m AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size, p_brand, p_type FROM part),
  r AS (SELECT DISTINCT a, p_size, p_brand FROM m WHERE p_type = 'STANDARD')"""


def part_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Each part as a mention: two title words, size as year, brand as director."""
    words = F.split("p_name", " ")
    return load(spark, folder, "part").select(
        F.col("p_partkey").alias("mention_id"),
        words[0].alias("title"),
        F.array(words[1]).alias("aliases"),
        F.col("p_size").alias("year"),
        F.col("p_brand").alias("director"),
        "p_type",
    )


def part_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Registered aliases: the first word of every standard part of a size and brand."""
    known = part_mentions(spark, folder).where("p_type = 'STANDARD'").select("title", "year", "director").distinct()
    return known.select(
        F.concat_ws("/", "director", F.col("year").cast("string"), "title").alias("key"),
        normalize_casefold("title").alias("alias"),
        "year",
        normalize_casefold("director").alias("director"),
    )


@query(
    "alias_resolution",
    f"""WITH {_PART_MENTIONS}, j AS (
      SELECT p_partkey, count(DISTINCT r.a) AS n, min(r.p_brand || '/' || r.p_size || '/' || r.a) AS k
      FROM m LEFT JOIN r ON r.p_size = m.p_size AND r.p_brand = m.p_brand AND r.a IN (m.a, m.b) GROUP BY p_partkey)
    SELECT p_partkey, CASE n WHEN 0 THEN 'new' WHEN 1 THEN 'existing' ELSE 'ambiguous' END AS status,
      CASE WHEN n = 1 THEN k END AS known_key FROM j""",
)
def alias_resolution(spark: SparkSession, folder: str) -> DataFrame:
    found = resolve_mentions(part_mentions(spark, folder).drop("p_type"), part_registry(spark, folder))
    return found.select(
        F.col("mention_id").alias("p_partkey"),
        "status",
        F.when(F.col("status") == "existing", F.col("key")).alias("known_key"),
    )


@query(
    "entity_resolution",
    f"""WITH RECURSIVE {_PART_MENTIONS},
      e AS (SELECT DISTINCT p_size, p_brand, a AS x, b AS y FROM m UNION SELECT DISTINCT p_size, p_brand, b, a FROM m),
      reach AS (SELECT DISTINCT p_size, p_brand, x, x AS y FROM e
        UNION SELECT reach.p_size, reach.p_brand, reach.x, e.y FROM reach JOIN e
          ON e.p_size = reach.p_size AND e.p_brand = reach.p_brand AND e.x = reach.y),
      comp AS (SELECT p_size, p_brand, x, min(y) AS lowest FROM reach GROUP BY ALL),
      own AS (SELECT c.p_size, c.p_brand, c.lowest, count(*) AS keys, min(r.p_brand || '/' || r.p_size || '/' || r.a) AS owner
        FROM comp c JOIN r ON r.p_size = c.p_size AND r.p_brand = c.p_brand AND r.a = c.x GROUP BY ALL)
    SELECT p_partkey, CASE WHEN keys > 1 THEN 'quarantined' WHEN keys = 1 THEN 'existing' ELSE 'new' END AS status,
      CASE WHEN keys = 1 THEN owner END AS known_key,
      count(*) OVER (PARTITION BY m.p_size, m.p_brand, comp.lowest) AS members
    FROM m JOIN comp ON comp.p_size = m.p_size AND comp.p_brand = m.p_brand AND comp.x = m.a
    LEFT JOIN own ON own.p_size = m.p_size AND own.p_brand = m.p_brand AND own.lowest = comp.lowest""",
)
def entity_resolution(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge_entities(part_mentions(spark, folder).drop("p_type"), part_registry(spark, folder))
    sizes = merged.groupBy("component").agg(F.count("*").alias("members"))
    return merged.join(sizes, "component").select(
        F.col("mention_id").alias("p_partkey"),
        "status",
        F.when(F.col("status") == "existing", F.col("key")).alias("known_key"),
        "members",
    )


BAND_DAYS = 3


@query(
    "band_match",
    f"""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT a.o_orderkey, count(b.o_orderkey) AS others, CASE WHEN count(b.o_orderkey) = 1 THEN CAST(min(b.o_orderkey) AS BIGINT) END AS only_other
    FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(a.d - b.d) <= {BAND_DAYS}
    GROUP BY a.o_orderkey""",
)
def band_match(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of the same customer within three days: how many, and which when there is only one."""
    orders = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        "o_orderkey", "o_custkey", F.unix_date(F.to_date("o_orderdate")).alias("day")
    )
    return band_neighbours(orders, "o_orderkey", "o_custkey", "day", BAND_DAYS)


_LONG_TITLES = """
  s AS (SELECT DISTINCT lower(replace(p_name, ' ', '')) AS t FROM part WHERE length(replace(p_name, ' ', '')) >= 8),
  l AS (SELECT DISTINCT p_brand, p_name, lower(regexp_replace(p_name || p_type, '[^a-zA-Z0-9]', '', 'g')) AS t FROM part)"""


@query(
    "name_containment",
    f"""WITH {_LONG_TITLES} SELECT s.t AS title, p_brand, count(*) AS longer_titles
    FROM s JOIN l ON contains(l.t, s.t) GROUP BY ALL""",
)
def name_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of eight characters or more inside longer titles, counted per brand."""
    part = load(spark, folder, "part", "p_name", "p_brand", "p_type")
    needles = part.select(title_key("p_name").alias("needle")).distinct().where("length(needle) >= 8")
    needles = needles.withColumn("needle_id", F.col("needle"))
    hay = (
        part.select("p_name", identity_text(F.concat_ws(" ", "p_name", "p_type")).alias("hay"))
        .distinct()
        .select(F.concat_ws("|", "p_name", "hay").alias("hay_id"), "hay")
    )
    found = containment(needles, hay)
    brands = part.select(
        "p_brand", "p_name", identity_text(F.concat_ws(" ", "p_name", "p_type")).alias("hay")
    ).distinct().select("p_brand", F.concat_ws("|", "p_name", "hay").alias("hay_id"))
    return (
        found.join(brands, "hay_id")
        .groupBy(F.col("needle_id").alias("title"), "p_brand")
        .agg(F.count("*").alias("longer_titles"))
    )


@query(
    "search_entities",
    """WITH q AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS q FROM part UNION SELECT DISTINCT lower(p_brand) FROM part),
      e AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || p_size AS t FROM part)
    SELECT q AS search, p_partkey, row_number() OVER (PARTITION BY q ORDER BY p_partkey) AS place
    FROM q JOIN e ON contains(t, regexp_replace(q, '[^a-z0-9]', '', 'g')) QUALIFY place <= 6""",
)
def search_entities(spark: SparkSession, folder: str) -> DataFrame:
    """First six parts, in key order, whose folded name, brand and size contain a query."""
    part = load(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_size")
    asked = part.select(F.lower(F.split("p_name", " ")[1]).alias("query")).union(part.select(F.lower("p_brand"))).distinct()
    entities = part.select(
        F.col("p_partkey").alias("entity_id"),
        search_norm(F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string"))).alias("text"),
    )
    return search(asked, entities).select(
        F.col("query").alias("search"), F.col("entity_id").alias("p_partkey"), F.col("place").cast("bigint").alias("place")
    )


@query(
    "resolve_cascade",
    """WITH p AS (SELECT p_partkey, p_name, p_size, p_brand FROM part),
      c AS (SELECT DISTINCT p_name AS title, p_size AS yr, p_brand AS director FROM part),
      s1 AS (SELECT title, yr, director, min(p_partkey) AS m, count(DISTINCT p_partkey) AS n FROM c JOIN p ON p_name = title AND p_brand = director AND p_size = yr GROUP BY ALL),
      s2 AS (SELECT title, yr, director, min(p_partkey) AS m, count(DISTINCT p_partkey) AS n FROM c JOIN p ON p_name = title AND p_brand = director AND abs(p_size - yr) <= 1 GROUP BY ALL),
      s3 AS (SELECT title, yr, director, min(p_partkey) AS m, count(DISTINCT p_partkey) AS n FROM c JOIN p ON p_brand = director AND abs(p_size - yr) <= 0 GROUP BY ALL)
    SELECT c.title, c.yr, c.director, CASE WHEN s1.n = 1 THEN 'exact' WHEN s2.n = 1 THEN 'near' WHEN s3.n = 1 THEN 'credit' END AS stage,
      CASE WHEN s1.n = 1 THEN s1.m WHEN s2.n = 1 THEN s2.m WHEN s3.n = 1 THEN s3.m END AS match_id
    FROM c LEFT JOIN s1 USING (title, yr, director) LEFT JOIN s2 USING (title, yr, director) LEFT JOIN s3 USING (title, yr, director)""",
)
def resolve_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (title, size, brand) mentions against the parts: same size, size within one, brand and size."""
    part = load(spark, folder, "part", "p_partkey", "p_name", "p_size", "p_brand")
    cands = part.select(F.col("p_name").alias("title"), F.col("p_size").alias("yr"), F.col("p_brand").alias("director")).distinct()
    cands = cands.withColumn("cand", F.concat_ws("|", "title", F.col("yr").cast("string"), "director"))

    def stage(keys: list[str], width: int):
        ids = part.select(F.col("p_name").alias("title"), F.col("p_size").alias("yr"), F.col("p_brand").alias("director"), "p_partkey")
        ends = ids.groupBy(*keys, "yr").agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
        near = ends.withColumn("yr", F.explode(F.sequence(F.col("yr") - width, F.col("yr") + width)))

        def run(rest: DataFrame) -> DataFrame:
            return rest.join(near, [*keys, "yr"]).select("cand", F.explode(F.array("lo", "hi")).alias("match_id"))

        return run

    stages = [
        ("exact", stage(["title", "director"], 0)),
        ("near", stage(["title", "director"], 1)),
        ("credit", stage(["director"], 0)),
    ]
    return cascade(cands, "cand", stages).join(cands, "cand").select("title", "yr", "director", "stage", "match_id")


@query(
    "union_last_wins",
    """WITH e AS (SELECT user_id || '/' || event_type AS id, 0 AS part, event_id, value FROM events WHERE event_type <> 'error'
        UNION ALL SELECT user_id || '/view', 1, event_id, -value FROM events WHERE event_type = 'error')
    SELECT id, min({'p': part, 'e': event_id}).p AS first_part, min({'p': part, 'e': event_id}).e AS first_event_id,
      max({'p': part, 'e': event_id}).e AS event_id, round(arg_max(value, {'p': part, 'e': event_id}), 4) AS value FROM e GROUP BY id""",
)
def union_last(spark: SparkSession, folder: str) -> DataFrame:
    """Errors corrected into views: first position of an id, last value."""
    events = load(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    first = events.where("event_type != 'error'").select(F.concat_ws("/", "user_id", "event_type").alias("id"), "event_id", "value")
    second = events.where("event_type = 'error'").select(
        F.concat(F.col("user_id").cast("string"), F.lit("/view")).alias("id"), "event_id", (-F.col("value")).alias("value")
    )
    out = union_last_wins([first, second], "id", "event_id")
    return out.withColumn("value", F.round("value", 4))


@query(
    "filter_before_limit",
    """SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place
    FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 QUALIFY place <= 8""",
)
def filter_before_limit(spark: SparkSession, folder: str) -> DataFrame:
    """The year filter runs before the cut to eight, so frequent customers keep the right orders."""
    near = load(spark, folder, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate").where(
        F.col("o_orderdate").between(F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")), F.to_timestamp_ntz(F.lit("1998-12-31 23:59:59")))
    )
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return near.withColumn("place", rank).where("place <= 8").select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))
