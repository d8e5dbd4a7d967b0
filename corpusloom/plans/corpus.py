"""Admission, versions, digests and integrity over documents, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import embedding_input, entity_key, input_hash, version_id
from ..functions.text import word_list
from ..operators.admission import admit, fresh_evidence, servable
from ..operators.versions import corpus_digest, corpus_stats, current_versions, deactivate_missing, foreign_key_errors, membership
from ..schemas import RIGHTS, SOURCE_TYPES
from ..session import cut, load, scratch_path, spread
from ..sources.store import append_versions, read_store, version_tables
from .registry import query


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Each labelled or unlabelled document as a nested source record.

    The quotation is the first line and the summary the whole text, so long ones break the word rules;
    toxic documents come as academic abstracts and low quality ones without a licence link.
    """
    docs = spread(load(spark, folder, "documents")).join(load(spark, folder, "labels"), "doc_id", "left")
    words = word_list("text")
    first = F.trim(F.split("text", "\n")[0])
    film = F.struct(
        F.concat(F.lit("film-"), "source").alias("key"),
        F.concat(F.lit("Title "), "source").alias("title"),
        (F.lit(1860) + F.size(words) % 100).cast("int").alias("year"),
        F.col("lang").alias("director"),
        F.array().cast("array<string>").alias("aliases"),
        F.array(F.struct(F.col("source").alias("provider"), F.col("lang").alias("id"))).alias("externalIds"),
    )
    observation = F.struct(
        F.lit("o1").alias("id"),
        F.col("text").alias("summary"),
        F.lit(None).cast("string").alias("summaryKo"),
        F.lit("one document").alias("boundary"),
        F.array(F.concat(F.lit("film-"), "source")).alias("filmKeys"),
        F.array("source", "lang").alias("subjects"),
        F.lit("film_reading").alias("kind"),
        F.array(F.lit("p1")).alias("passageIds"),
    )
    return docs.select(
        "doc_id",
        "source",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat_ws(" ", "source", "lang").alias("title"),
        F.lit(None).cast("string").alias("author"),
        F.col("source").alias("publisher"),
        F.when(F.col("toxic") == 1, "academic").otherwise("criticism").alias("type"),
        F.col("lang").alias("language"),
        F.lit("2024").alias("publishedAt"),
        F.lit("2024-05-01T00:00:00Z").alias("checkedAt"),
        F.when(F.col("toxic") == 1, "abstract").otherwise("full_page").alias("access"),
        F.struct(
            F.when(F.col("quality") == 0, "open_license").otherwise("restricted_excerpt").alias("mode"),
            F.lit(None).cast("string").alias("licenseUrl"),
            F.lit("derived").alias("note"),
        ).alias("rights"),
        F.struct(
            F.lit("http_fetch").alias("method"), F.lit("first line").alias("locator"), F.lit("derived").alias("note"),
            F.lit(None).cast("string").alias("textUrl"),
        ).alias("verification"),
        F.array(film).alias("films"),
        F.array(F.struct(F.lit("p1").alias("id"), first.alias("text"), F.lit("line 1").alias("locator"))).alias("passages"),
        F.array(observation).alias("observations"),
        F.sha2("text", 256).alias("content_hash"),
    )


_RULES = """
  w AS (SELECT doc_id, source, lang, text, toxic, quality, len(regexp_extract_all(text, '\\S+')) AS words,
      len(regexp_extract_all(split_part(text, chr(10), 1), '\\S+')) AS first_words FROM documents LEFT JOIN labels USING (doc_id)),
  r AS (SELECT *, list_filter([
      CASE WHEN toxic = 1 THEN 'academic_without_full_text' END, CASE WHEN quality = 0 THEN 'license_missing' END,
      CASE WHEN 1860 + words % 100 < 1870 THEN 'film_year' END, CASE WHEN first_words = 0 THEN 'passage_text' END,
      CASE WHEN first_words > 25 THEN 'quote_words' END, CASE WHEN words = 0 THEN 'observation_text' END,
      CASE WHEN words + 2 > 160 THEN 'prose_words' END], lambda x: x IS NOT NULL) AS errors FROM w)"""


@query(
    "document_admission",
    f"WITH {_RULES} SELECT doc_id, len(errors) = 0 AS admitted, errors[1] AS first_error, CAST(len(errors) AS BIGINT) AS errors FROM r",
)
def document_admission(spark: SparkSession, folder: str) -> DataFrame:
    judged = admit(records(spark, folder), 2024)
    return judged.select(
        "doc_id", "admitted", F.try_element_at("errors", F.lit(1)).alias("first_error"), F.size("errors").cast("bigint").alias("errors")
    )


@query(
    "version_store",
    f"""WITH {_RULES}, a AS (SELECT * FROM r WHERE len(errors) = 0),
      k AS (SELECT DISTINCT source FROM a)
    SELECT 'versions' AS tbl, count(*) AS rows FROM a UNION ALL SELECT 'sources', count(*) FROM a
    UNION ALL SELECT 'passages', count(*) FROM a UNION ALL SELECT 'observations', count(*) FROM a
    UNION ALL SELECT 'participants', count(*) FROM a UNION ALL SELECT 'evidence_links', count(*) FROM a
    UNION ALL SELECT 'document_films', count(*) FROM a UNION ALL SELECT 'entities', count(*) FROM k
    UNION ALL SELECT 'aliases', (SELECT count(*) FROM (SELECT DISTINCT source, 1860 + words % 100, lang FROM a)) * 2""",
)
def version_store(spark: SparkSession, folder: str) -> DataFrame:
    """Admitted records written to the nine tables, twice; the second append must add nothing."""
    good = cut(admit(records(spark, folder), 2024).where("admitted"))
    resolved = load(spark, folder, "documents", "source").distinct().select(
        F.concat(F.lit("film-"), "source").alias("source_key"),
        entity_key(F.concat(F.lit("Title "), "source"), F.lit(0), F.lit("")).alias("key"),
    )
    root = scratch_path(spark, "store")
    tables = version_tables(good, resolved)
    append_versions(tables, root)
    append_versions(tables, root)
    out = None
    for name, df in read_store(spark, root).items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def _options(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(
    "corpus_stats",
    f"""WITH d AS (SELECT CASE WHEN toxic = 1 THEN 'academic' ELSE 'criticism' END AS type, source,
        CASE WHEN quality = 0 THEN 'open_license' ELSE 'restricted_excerpt' END AS rights FROM documents LEFT JOIN labels USING (doc_id)),
      t AS (SELECT unnest({_options(SOURCE_TYPES)}) AS value), r AS (SELECT unnest({_options(RIGHTS)}) AS value)
    SELECT unnest(['documents', 'passages', 'observations', 'evidence_links']) AS measure, '' AS value, count(*) AS n FROM d
    UNION ALL SELECT 'films', '', count(DISTINCT source) FROM d
    UNION ALL SELECT 'by_type', value, (SELECT count(*) FROM d WHERE type = value) FROM t
    UNION ALL SELECT 'by_rights', value, (SELECT count(*) FROM d WHERE rights = value) FROM r""",
)
def statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as source records, and what they hold, by type and by rights."""
    rows = records(spark, folder).select(
        "type", F.col("rights.mode").alias("rights_mode"), "films.key", "passages.id", "observations.passageIds"
    )
    return corpus_stats(
        rows, rows.select(F.explode("id")), rows.select(F.explode("passageIds")),
        rows.select(F.explode(F.flatten("passageIds"))), rows.select(F.explode("key").alias("key")),
    )


@query(
    "corpus_digest",
    """WITH i AS (SELECT DISTINCT doc_id || '@' || sha256(text) AS id FROM documents),
      a AS (SELECT left(sha256(id), 6) AS node, id AS part FROM i),
      b AS (SELECT node, sha256(string_agg(part, chr(10) ORDER BY part)) AS d FROM a GROUP BY node),
      c AS (SELECT left(node, 4) AS node, sha256(string_agg(node || ':' || d, chr(10) ORDER BY node || ':' || d)) AS d FROM b GROUP BY 1),
      e AS (SELECT left(node, 2) AS node, sha256(string_agg(node || ':' || d, chr(10) ORDER BY node || ':' || d)) AS d FROM c GROUP BY 1)
    SELECT sha256('corpus-v1' || chr(10) || string_agg(node || ':' || d, chr(10) ORDER BY node || ':' || d)) AS digest FROM e""",
)
def digest(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents", "doc_id", "text")
    return corpus_digest(docs.select(version_id(F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("id")), "corpus-v1")


@query(
    "membership_check",
    """WITH s AS (SELECT doc_id, toxic FROM labels), d AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 1 ELSE 0 END AS toxic FROM documents)
    SELECT CASE WHEN s.doc_id IS NULL THEN 'missing_right' WHEN d.doc_id IS NULL THEN 'missing_left' WHEN s.toxic = d.toxic THEN 'equal' ELSE 'changed' END AS status,
      count(*) AS n FROM d FULL JOIN s ON s.doc_id = d.doc_id GROUP BY 1""",
)
def membership_check(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents", "doc_id", "n_chars").select(
        "doc_id", F.when(F.col("n_chars") > 3000, 1).otherwise(0).alias("toxic")
    )
    found = membership(docs, load(spark, folder, "labels", "doc_id", "toxic"), "doc_id", ["toxic"])
    return found.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "version_history",
    """WITH v AS (SELECT user_id AS source_id, event_id, ts, event_type, user_id || '@' || sha256(props) AS version_id FROM events),
      cur AS (SELECT source_id, arg_max(version_id, {'t': ts, 'e': event_id}) AS version_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS last_type FROM v GROUP BY source_id)
    SELECT v.source_id, v.version_id, count(*) AS imports, min(v.event_id) AS first_event, v.version_id = cur.version_id AND last_type <> 'error' AS active
    FROM v JOIN cur USING (source_id) GROUP BY v.source_id, v.version_id, cur.version_id, last_type""",
)
def version_history(spark: SparkSession, folder: str) -> DataFrame:
    """Every event imports a version of its user; a user whose last event is an error is withdrawn."""
    events = load(spark, folder, "events", "user_id", "event_id", "ts", "event_type", "props").select(
        F.col("user_id").alias("source_id"), "event_id", "ts", "event_type",
        version_id(F.col("user_id").cast("string"), F.sha2("props", 256)).alias("version_id"),
    )
    history = events.groupBy("source_id", "version_id").agg(F.count("*").alias("imports"), F.min("event_id").alias("first_event"))
    pointers = current_versions(events, ["ts", "event_id"])
    last = events.groupBy("source_id").agg(F.max_by(F.struct("version_id", "event_type"), F.struct("ts", "event_id")).alias("l"))
    present = last.where("l.event_type != 'error'").select("l.version_id")
    active = deactivate_missing(pointers, present).where("current_version IS NOT NULL")
    return history.join(
        active.select("source_id", F.col("current_version").alias("version_id"), F.lit(True).alias("on")), ["source_id", "version_id"], "left"
    ).select("source_id", "version_id", "imports", "first_event", F.coalesce("on", F.lit(False)).alias("active"))


@query(
    "fk_integrity",
    """SELECT 'lineitem.l_orderkey' AS relation, count(*) AS orphans FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'orders.o_custkey', count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'lineitem.l_partkey', count(*) FROM lineitem ANTI JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT 'customer.c_nationkey', count(*) FROM customer ANTI JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'labels.doc_id', count(*) FROM labels ANTI JOIN documents USING (doc_id)""",
)
def fk_integrity(spark: SparkSession, folder: str) -> DataFrame:
    keys = [
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
        ("labels", "doc_id", "documents", "doc_id"),
    ]
    out = None
    for child, column, parent, target in keys:
        row = foreign_key_errors(load(spark, folder, child, column), column, load(spark, folder, parent, target), target)
        row = row.select(F.lit(f"{child}.{column}").alias("relation"), F.col("errors").alias("orphans"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "servable_documents",
    """SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id)
    WHERE coalesce(toxic, 0) = 0 AND n_chars >= 80 AND coalesce(quality, 1) = 1""",
)
def servable_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Toxic documents stand for abstracts, short ones for metadata, low quality for mentions."""
    docs = load(spark, folder, "documents", "doc_id", "lang", "n_chars").join(load(spark, folder, "labels"), "doc_id", "left")
    rows = docs.select(
        "doc_id",
        "lang",
        F.when(F.coalesce("toxic", F.lit(0)) == 1, "academic").otherwise("criticism").alias("type"),
        F.when(F.col("n_chars") < 80, "metadata_only").when(F.coalesce("toxic", F.lit(0)) == 1, "abstract").otherwise("full_page").alias("access"),
        F.lit("restricted_excerpt").alias("rights_mode"),
        F.when(F.coalesce("quality", F.lit(1)) == 0, "incidental_mention").otherwise("film_reading").alias("kind"),
        F.array(F.lit("p1")).alias("passage_ids"),
        F.array(F.lit("p1")).alias("known_passages"),
    )
    return servable(rows).select("doc_id", "lang")


@query(
    "evidence_freshness",
    """WITH cur AS (SELECT user_id, max(event_id) AS v FROM events GROUP BY user_id),
      n AS (SELECT max(ts) AS now FROM events)
    SELECT event_id, ts >= now - INTERVAL 30 DAY AND ts <= now + INTERVAL 60 SECOND AND event_type <> 'error'
      AND (value < 400 OR event_id = v) AS fresh
    FROM events JOIN cur USING (user_id), n""",
)
def evidence_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Errors count as abstracts; events of 400 or more cite a version, which must be the user's last."""
    events = load(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    now = events.agg(F.max("ts")).first()[0]
    current = events.groupBy("user_id").agg(F.max("event_id").alias("version_id")).withColumnRenamed("user_id", "document_id")
    packets = events.select(
        F.col("event_id").alias("packet_id"),
        F.col("ts").alias("issued"),
        F.when(F.col("event_type") == "error", "academic").otherwise("criticism").alias("source_type"),
        F.lit("abstract").alias("access"),
        F.when(F.col("value") >= 400, F.col("user_id")).alias("document_id"),
        F.col("event_id").alias("document_version"),
    )
    return fresh_evidence(packets, current, now).withColumnRenamed("packet_id", "event_id")


@query(
    "embedding_hash",
    """SELECT doc_id, sha256('text-embedding-3-small:256:' || text || chr(10) || chr(10) || source || chr(10) || lang || chr(10) || 'Scope: ' || n_chars) AS input_hash
    FROM documents""",
)
def embedding_hash(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    text = embedding_input("text", F.lit(None).cast("string"), F.concat_ws("\n", "source", "lang"), F.col("n_chars").cast("string"))
    return docs.select("doc_id", input_hash(F.lit("text-embedding-3-small"), F.lit(256), text).alias("input_hash"))
