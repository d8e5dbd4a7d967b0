"""Requests, saved evidence, targets, cards, page texts, registries and artefacts held against their rules."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.admission import ingestion_status, recommendation_errors, request_errors, snapshot_errors
from ..operators.collection import validate_targets
from ..operators.contract import source_card
from ..operators.entities import registry_violations
from ..operators.projections import enrich_from_pages
from ..session import load, scratch_path
from ..sources.records import read_registry_rows, registry_rows, usable_pages, write_registry
from ..sources.store import read_neighbours, write_neighbours, write_snapshot
from .registry import query


def _made(count: Column, item) -> Column:
    """`item(i)` for i from 0 to count - 1."""
    none = F.array().cast("array<string>")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), (count - 1).cast("bigint")), item)).otherwise(none)


def _named(prefix: str, number) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


@query(
    "request_validation",
    """WITH r AS (SELECT o_orderkey AS k, list_transform(range(o_custkey % 10), lambda i: 'tmdb:' || (o_orderkey % 11 + i * (o_orderkey % 3))) AS seeds,
        list_transform(range(day(o_orderdate)), lambda i: 'film-' || i) AS trail, o_custkey % 14 AS previous, o_orderstatus AS st, o_orderpriority AS pr FROM orders)
    SELECT k AS request_id, array_to_string(list_filter([
      CASE WHEN len(seeds) NOT BETWEEN 1 AND 8 OR list_contains(seeds, 'tmdb:0') THEN 'seeds' END,
      CASE WHEN len(trail) > 30 THEN 'trail' END, CASE WHEN previous > 12 THEN 'previous_ids' END,
      CASE WHEN st NOT IN ('F', 'O') THEN 'language' END, CASE WHEN pr LIKE '5%' THEN 'intent' END,
      CASE WHEN len(list_distinct(list_concat(seeds, trail))) < len(seeds) + len(trail) THEN 'repeated_film' END], lambda x: x IS NOT NULL), ',') AS errors FROM r""",
)
def request_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as requests: seeds from the keys, a film of the trail for each day of the month, language by status."""
    orders = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    key, priority = F.col("o_orderkey"), F.left("o_orderpriority", F.lit(1))
    intent = F.element_at(F.create_map(*[F.lit(x) for pair in zip("1234", ("initial", "follow", "manual", "regenerate")) for x in pair]), priority)
    requests = orders.select(
        key.alias("k"), key.cast("string").alias("request_id"),
        _made(F.col("o_custkey") % 10, lambda i: _named("tmdb:", key % 11 + i * (key % 3))).alias("seeds"),
        _made(F.dayofmonth("o_orderdate"), lambda i: _named("film-", i)).alias("trail"),
        _made(F.col("o_custkey") % 14, lambda i: _named("wd:Q", i + 1)).alias("previous_ids"),
        F.array().cast("array<string>").alias("seen_ids"),
        F.when(F.col("o_orderstatus") == "F", "en").when(F.col("o_orderstatus") == "O", "ko").otherwise("fr").alias("language"), intent.alias("intent"),
    )
    return requests.select(F.col("k").alias("request_id"), F.array_join(request_errors(), ",").alias("errors"))


@query(
    "evidence_integrity",
    """WITH r AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(left(o_orderpriority, 1) AS INTEGER) AS p, o_orderstatus = 'F' AS ai FROM orders),
      s AS (SELECT *, CASE p WHEN 3 THEN ['s1'] WHEN 4 THEN ['s1', 's2'] WHEN 5 THEN ['s9'] ELSE [] END AS cs,
        CASE k % 3 WHEN 0 THEN [] WHEN 1 THEN ['s1', 's2'] ELSE ['s1', 's9'] END AS rs, c % 10 = 0 AS bare FROM r)
    SELECT k AS request_id, array_to_string(list_filter([CASE WHEN bare THEN 'no_connection' END, CASE WHEN NOT bare AND ai <> (len(cs) = 0) THEN 'relation_evidence' END,
      CASE WHEN NOT bare AND len(list_filter(cs, lambda x: NOT list_contains(rs, x))) > 0 THEN 'unlisted_source' END,
      CASE WHEN (bare OR ai) AND len(rs) > 0 THEN 'evidence_on_inference' END], lambda x: x IS NOT NULL), ',') AS recommendation,
    array_to_string(list_filter([CASE WHEN k % 4 = c % 6 THEN 'repeated_film' END, CASE WHEN c % 9 + 2 IN (k % 4, c % 6) THEN 'self_recommendation' END,
      CASE WHEN list_contains(rs, 's9') OR (NOT bare AND list_contains(cs, 's9')) THEN 'unknown_source' END,
      CASE WHEN NOT bare AND k % 5 NOT IN (k % 4, c % 6) THEN 'unknown_anchor' END], lambda x: x IS NOT NULL), ',') AS snapshot FROM s""",
)
def evidence_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as saved recommendations: anchors, sources and relations follow from keys, status and priority."""
    orders = load(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    key, customer, priority = F.col("o_orderkey"), F.col("o_custkey"), F.left("o_orderpriority", F.lit(1))
    none, one, two, wrong = (F.array(*map(F.lit, ids)).cast("array<string>") for ids in ((), ("s1",), ("s1", "s2"), ("s9",)))
    cited = F.when(priority == "3", one).when(priority == "4", two).when(priority == "5", wrong).otherwise(none)
    relation = F.when(F.col("o_orderstatus") == "F", "ai_inference").otherwise("direct_connection")
    connection = F.struct(_named("f", key % 5).alias("anchorId"), relation.alias("relation"), cited.alias("sourceIds"))
    connections = F.filter(F.array(connection), lambda c: customer % 10 != 0)
    sources = F.when(key % 3 == 0, none).when(key % 3 == 1, two).otherwise(F.array(F.lit("s1"), F.lit("s9")))
    rows = orders.select(key.alias("k"), customer.alias("c"), connections.alias("connections"), sources.alias("source_ids"))
    saved = F.struct(_named("f", F.col("c") % 9 + 2).alias("film_id"), "source_ids", "connections")
    held = rows.select(
        "k", "connections", "source_ids", F.array(_named("f", F.col("k") % 4)).alias("seeds"), F.array(_named("f", F.col("c") % 6)).alias("trail"),
        two.alias("sources"), F.array(saved).alias("recommendations"),
    )
    return held.select(
        F.col("k").alias("request_id"), F.array_join(recommendation_errors(), ",").alias("recommendation"), F.array_join(snapshot_errors(), ",").alias("snapshot")
    )


@query(
    "target_validation",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Bad ' || doc_id ELSE 'doc-' || (doc_id // 2) END AS id, lang, source FROM documents),
      n AS (SELECT *, count(*) OVER (PARTITION BY id) > 1 AS repeated FROM t)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'id' END, CASE WHEN repeated THEN 'repeated' END, CASE WHEN doc_id % 7 = 0 THEN 'url' END,
      CASE WHEN coalesce(source, 'src0') = 'src0' THEN 'family' END, CASE WHEN doc_id % 3 = 1 THEN 'type' END, CASE WHEN lang IS NULL THEN 'tags' END], lambda x: x IS NOT NULL), ',') AS errors FROM n""",
)
def target_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as collection targets: half of their ids repeat, some are no slugs, one source is no family."""
    docs = load(spark, folder, "documents", "doc_id", "lang", "source")
    key = F.col("doc_id")
    targets = docs.select(
        "doc_id", F.when(key % 5 == 0, _named("Bad ", key)).otherwise(_named("doc-", F.floor(key / 2))).alias("id"),
        F.when(key % 7 == 0, "").otherwise(_named("https://s.org/", key)).alias("url"), F.nullif("source", F.lit("src0")).alias("family_id"),
        F.when(key % 3 == 1, "blog").when(key % 3 == 2, "festival").alias("proposed_type"), F.array("lang").alias("tags"),
    )
    return validate_targets(targets).select("doc_id", F.array_join("errors", ",").alias("errors"))


_CARD_TYPE = "CASE doc_id % 4 WHEN 0 THEN 'academic' WHEN 1 THEN 'programme' WHEN 2 THEN 'festival' ELSE 'criticism' END"


@query(
    "source_cards",
    f"""WITH p AS (SELECT doc_id, {_CARD_TYPE} AS type, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS exact, doc_id % 3 = 0 AS linked, text FROM documents WHERE doc_id % 7 <> 0)
    SELECT 'context:' || doc_id AS source_id, 'https://s.org/' || doc_id AS url, replace(type, 'programme', 'festival') AS type,
      CASE WHEN type IN ('programme', 'festival') THEN 'programme_context' ELSE 'interpretive_context' END AS scope,
      sha256(CASE WHEN doc_id % 5 = 0 THEN 'seen' WHEN exact THEN 'A located passage used as limited source context for this route.' ELSE text END) AS summary_sha,
      CASE WHEN exact THEN sha256(text) END AS excerpt_sha,
      CASE WHEN doc_id % 11 = 0 THEN 'abstract' WHEN linked THEN 'link_and_metadata_only' WHEN type = 'academic' THEN 'abstract' ELSE 'full_text' END AS access_level,
      CASE WHEN doc_id % 2 = 0 THEN '2024-05-01' ELSE '2024-06-02' END AS verified_on FROM p""",
)
def source_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as passages: type, rights, access and times by their ids; those without a web address give no card."""
    key = F.col("doc_id")
    passages = load(spark, folder, "documents", "doc_id", "text", "source").select(
        key.cast("string").alias("passage_id"), F.col("source").alias("title"),
        F.when(key % 7 == 0, "ftp://s.org").otherwise(_named("http://s.org/", key)).alias("url"),
        F.element_at(F.array(*map(F.lit, ("academic", "programme", "festival", "criticism"))), (key % 4 + 1).cast("int")).alias("type"),
        F.when(key % 2 == 0, "exact_passage").otherwise("observation").alias("content_kind"),
        F.when(key % 3 == 0, "link_and_metadata_only").otherwise("open_license").alias("rights"),
        F.when(key % 5 == 0, "seen").alias("observation"), F.col("text").alias("excerpt"), F.when(key % 11 == 0, "abstract").alias("access_level"),
        F.when(key % 2 == 0, "2024-05-01T10:00:00Z").alias("checked_at"), F.lit("2024-06-02T00:00:00Z").alias("built_at"),
    )
    return source_card(passages).select(
        "source_id", "url", "type", "scope", F.sha2("summary", 256).alias("summary_sha"), F.sha2("excerpt", 256).alias("excerpt_sha"), "access_level", "verified_on"
    )


_CLEAN = r"trim(regexp_replace(regexp_replace({}, '\[[0-9]+\]', '', 'g'), '[\s\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ' ', 'g'))"


@query(
    "page_enrichment",
    f"""WITH p AS (SELECT doc_id, doc_id % 4 <> 0 AS own, doc_id % 3 = 0 AS logo, doc_id % 5 = 0 AS kept, text,
        list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n'), lambda x: {_CLEAN.format('x')}), lambda x: x <> '' AND NOT starts_with(x, '=')) AS ps FROM documents),
      f AS (SELECT *, coalesce(ps[1], '') AS first FROM p),
      h AS (SELECT *, regexp_extract(left(first, 1000), '^[\\s\\S]*[.!?。다][.!?。]?\\s') AS sentence FROM f)
    SELECT doc_id AS film_id, CASE WHEN kept THEN 'own' WHEN own AND NOT logo THEN 'still' ELSE '' END AS poster,
      CASE WHEN own THEN 'Film ' || doc_id || ' (note).' END AS overview,
      CASE WHEN own AND first <> '' THEN sha256(CASE WHEN length(first) <= 1000 THEN first ELSE trim(CASE WHEN sentence <> '' THEN sentence ELSE left(first, 1000) END) || '…' END) END AS synopsis_sha FROM h""",
)
def page_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as plot sections of pages; every fourth page belongs to another entity, every third image is a logo."""
    docs = load(spark, folder, "documents", "doc_id", "text")
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    films = docs.select("doc_id", _named("Q", key).alias("authority_id"), _named("W", key).alias("wiki_title"), F.when(key % 5 == 0, "own").otherwise("").alias("poster"))
    extract = F.concat(F.lit("Film "), key.cast("string"), F.lit(" [1](note)[23].\n== Plot ==\n"), text, F.lit("\n== Cast ==\nOthers."))
    pages = docs.select(
        _named("W", key).alias("title"), _named("Q", key + F.when(key % 4 == 0, 1).otherwise(0)).alias("item"), extract.alias("extract"),
        F.when(key % 3 == 0, "A_Logo.png").otherwise("shot.jpg").alias("page_image"), F.lit("still").alias("thumbnail"),
    )
    return enrich_from_pages(films, pages).select(F.col("doc_id").alias("film_id"), "poster", "overview", F.sha2("synopsis", 256).alias("synopsis_sha"))


@query(
    "registry_rows",
    """WITH a AS (SELECT l_suppkey AS s, list_sort(list(DISTINCT 'line ' || l_linenumber)) AS titles FROM lineitem GROUP BY 1),
      k AS (SELECT l_suppkey AS s, list_sort(list(DISTINCT l_returnflag)) AS keys FROM lineitem GROUP BY 1)
    SELECT 's' || s_suppkey AS key, s_name AS title, array_to_string(list_filter(coalesce(titles, []), lambda x: x <> s_name), ',') AS aliases,
      array_to_string(coalesce(keys, []), ',') AS source_keys, 'wd:Q' || s_nationkey AS external FROM supplier LEFT JOIN a ON a.s = s_suppkey LEFT JOIN k ON k.s = s_suppkey""",
)
def registry_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as a registry, line numbers as titles and flags as record keys; written in key order and read back."""
    suppliers, lines = load(spark, folder, "supplier"), load(spark, folder, "lineitem", "l_suppkey", "l_linenumber", "l_returnflag")
    external = F.array(F.struct(F.lit("wd").alias("provider"), _named("Q", F.col("s_nationkey")).alias("id")))
    entities = suppliers.select(_named("s", F.col("s_suppkey")).alias("key"), F.col("s_name").alias("title"), F.lit(2000).alias("year"), F.lit("d").alias("director"), external.alias("externalIds"))
    key = _named("s", F.col("l_suppkey")).alias("key")
    aliases = lines.select(key, _named("line ", F.col("l_linenumber")).alias("alias"), F.lit("title").alias("alias_type")).distinct().unionByName(
        lines.select(key, F.col("l_returnflag").alias("alias"), F.lit("record_key").alias("alias_type")).distinct()
    )
    path = scratch_path(spark, "registry")
    write_registry(registry_rows(entities, aliases), path)
    ref = F.col("externalIds")[0]
    return read_registry_rows(spark, path).select(
        "key", "title", F.array_join("aliases", ",").alias("aliases"), F.array_join("sourceKeys", ",").alias("source_keys"), F.concat_ws(":", ref["provider"], ref["id"]).alias("external")
    )


@query(
    "registry_conflicts",
    """WITH r AS (SELECT c_custkey AS k, 'n' || c_nationkey AS title, 1900 + c_custkey % 50 AS y, 'dir' || c_custkey % 9 AS d FROM customer),
      e AS (SELECT k, title, y + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS y, CASE WHEN k % 15 = 0 THEN 'other' ELSE d END AS d FROM r WHERE k % 2 = 0),
      b AS (SELECT * FROM r UNION ALL SELECT * FROM e)
    SELECT k AS key, 'identity' AS reason FROM e WHERE k % 10 = 0 OR k % 15 = 0
    UNION ALL SELECT min(k), 'ambiguous_alias' FROM b GROUP BY title, y, d HAVING count(DISTINCT k) > 1""",
)
def registry_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as a registry against the half of them already known, some under another year or director."""
    key = F.col("c_custkey")
    registry = load(spark, folder, "customer", "c_custkey", "c_nationkey").select(
        key.alias("key"), _named("n", F.col("c_nationkey")).alias("title"), F.array().cast("array<string>").alias("aliases"),
        (1900 + key % 50).cast("int").alias("year"), _named("dir", key % 9).alias("director"),
    )
    known = registry.where("key % 2 = 0").select(
        "key", "title", "aliases", (F.col("year") + F.when(F.col("key") % 10 == 0, 1).otherwise(0)).alias("year"),
        F.when(F.col("key") % 15 == 0, "other").otherwise(F.col("director")).alias("director"),
    )
    return registry_violations(registry, known)


@query(
    "ingestion_status",
    """WITH d AS (SELECT doc_id, doc_id // 3 AS id, coalesce(source, '') AS file, coalesce(n_chars, 0) < 200 AS short, doc_id % 4 = 0 AS closed FROM documents),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, doc_id) > 1 AS repeated FROM d)
    SELECT doc_id, CASE WHEN repeated THEN 'duplicate_id' WHEN short THEN 'short' WHEN closed THEN 'no_open_license' END AS reason,
      CASE WHEN repeated OR short THEN 'quarantined' WHEN closed THEN 'filtered' ELSE 'completed' END AS status FROM r""",
)
def record_status(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records of a file per source: three share an id, short ones fail, every fourth has no open licence."""
    docs = load(spark, folder, "documents", "doc_id", "source", "n_chars")
    errors = F.when(F.coalesce("n_chars", F.lit(0)) < 200, F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
    records = docs.select(
        F.floor(F.col("doc_id") / 3).cast("string").alias("id"), F.coalesce("source", F.lit("")).alias("file"), F.col("doc_id").alias("idx"), errors.alias("errors"),
        (F.size(errors) == 0).alias("admitted"), F.struct(F.when(F.col("doc_id") % 4 == 0, "restricted_excerpt").otherwise("open_license").alias("mode")).alias("rights"),
    )
    return ingestion_status(records, True).select(F.col("idx").alias("doc_id"), "reason", "status")


NOW = datetime.datetime(2024, 6, 10, 12, 0, 0)


@query(
    "usable_pages",
    """SELECT page_id, sha256(html) AS text_sha FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id % 10 < 7 AND html <> ''""",
)
def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as a cache: every third of an older extractor, every fifth with a wrong hash, up to nine days old."""
    pages = load(spark, folder, "pages", "page_id", "html")
    key = F.col("page_id")
    cache = pages.select(
        "page_id", F.col("html").alias("text"), F.when(key % 3 == 0, 2).otherwise(3).alias("extractor_version"), F.lit("readable").alias("status"),
        F.when(key % 5 == 0, "0").otherwise(F.sha2("html", 256)).alias("text_hash"),
        (F.lit(NOW) - F.make_dt_interval((key % 10).cast("int"))).alias("checked_at"),
    )
    return usable_pages(cache, NOW).select("page_id", F.sha2("text", 256).alias("text_sha"))


@query(
    "neighbour_artefact",
    """SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, c_custkey % 97 / 97.0 AS score, 'v2' AS corpus_version, 'm' AS model, 64 AS dimensions FROM customer""",
)
def neighbour_artefact(spark: SparkSession, folder: str) -> DataFrame:
    """Customers linked to nations, written for two corpora; a reader sees the edges of one."""
    root = scratch_path(spark, "neighbours")
    edges = load(spark, folder, "customer", "c_custkey", "c_nationkey").select(
        _named("c", F.col("c_custkey")).alias("src"), _named("n", F.col("c_nationkey")).alias("dst"), (F.col("c_custkey") % 97 / 97.0).alias("score")
    )
    write_neighbours(edges.where("score < 0.5"), root, "v1", "m", 64)
    write_neighbours(edges, root, "v2", "m", 64)
    return read_neighbours(spark, root, "v2")


@query(
    "snapshot_rebuild",
    """SELECT doc_id AS version_id, sha256(text) AS text_sha, 'first' AS built FROM documents WHERE text IS NOT NULL""",
)
def snapshot_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot of the documents written twice under one version: the second build changes nothing."""
    root = scratch_path(spark, "snapshot")
    docs = load(spark, folder, "documents", "doc_id", "text").where("text IS NOT NULL")
    rows = docs.select(F.col("doc_id").alias("version_id"), F.sha2("text", 256).alias("text_sha"))
    write_snapshot(rows.withColumn("built", F.lit("first")), root, "v1")
    write_snapshot(rows.withColumn("built", F.lit("second")), root, "v1")
    return spark.read.parquet(f"{root}/version=v1")
