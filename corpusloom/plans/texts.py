"""Terms, lexical retrieval, quotations, chunks and prose over documents and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.chunks import chunks
from ..functions.prose import prose
from ..functions.text import bounded_text, search_terms, word_count
from ..operators.containment import locate_quotes
from ..operators.lexical import RAREST_TERMS, document_frequency, lexical_hits, postings, rarest_terms, retrieval_idf
from ..session import load, spread
from . import sql
from .registry import query


def passages(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(load(spark, folder, "documents", "doc_id", "text"))
    return docs.select(F.col("doc_id").alias("passage_id"), search_terms("text").alias("terms"))


def requests(spark: SparkSession, folder: str) -> DataFrame:
    items = load(spark, folder, "benchmark", "item_id", "text")
    return items.select(F.col("item_id").alias("request_id"), search_terms("text").alias("terms"))


_POSTINGS = f"""
  d AS (SELECT doc_id, unnest({sql.terms('text')}) AS term FROM documents),
  f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
  n AS (SELECT count(*) AS total FROM documents)"""


@query(
    "term_idf",
    f"""WITH {_POSTINGS}
    SELECT term, df, round(ln(1 + total / (1 + df)), 6) AS idf FROM f, n""",
)
def term_idf(spark: SparkSession, folder: str) -> DataFrame:
    total = load(spark, folder, "documents", "doc_id").select(F.count("*")).scalar()
    return document_frequency(postings(passages(spark, folder))).select(
        "term", "df", F.round(retrieval_idf(F.col("df"), total), 6).alias("idf")
    )


LEXICAL_SQL = f"""{_POSTINGS},
  q AS (SELECT item_id, unnest({sql.terms('text')}) AS term FROM benchmark),
  rare AS (
    SELECT item_id, term, ln(1 + total / (1 + df)) AS idf FROM q JOIN f USING (term), n),
  s AS (
    SELECT item_id, doc_id, round(sum(idf), 6) AS raw, count(*) AS matched
    FROM rare JOIN d USING (term) GROUP BY ALL HAVING count(*) >= 2),
  hits AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, doc_id) AS hit_rank FROM s
    QUALIFY hit_rank <= 8)"""


@query(
    "lexical_retrieval",
    f"""WITH {LEXICAL_SQL}
    SELECT item_id, doc_id, matched, hit_rank, round(least(5.0, raw / 3), 6) AS score FROM hits""",
)
def lexical_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_hits(requests(spark, folder), passages(spark, folder)).select(
        F.col("request_id").alias("item_id"),
        F.col("passage_id").alias("doc_id"),
        "matched",
        F.col("hit_rank").cast("bigint").alias("hit_rank"),
        "score",
    )


@query(
    "rare_terms",
    f"""WITH {_POSTINGS}
    SELECT doc_id, term, df, row_number() OVER (PARTITION BY doc_id ORDER BY df, term) AS term_rank FROM d JOIN f USING (term)
    QUALIFY term_rank <= {RAREST_TERMS}""",
)
def rare_terms(spark: SparkSession, folder: str) -> DataFrame:
    """What each document would ask with: its rarest terms."""
    posting = postings(passages(spark, folder))
    asked = posting.withColumnRenamed("passage_id", "request_id")
    return rarest_terms(asked, document_frequency(posting)).select(
        F.col("request_id").alias("doc_id"), "term", "df", F.col("term_rank").cast("bigint").alias("term_rank")
    )


@query(
    "coverage_counts",
    f"""WITH {LEXICAL_SQL}
    SELECT b.item_id, count(h.doc_id) AS passages
    FROM benchmark b LEFT JOIN hits h USING (item_id) GROUP BY b.item_id""",
)
def coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Passages per request, requests without any included."""
    items = load(spark, folder, "benchmark", "item_id")
    hits = lexical_retrieval(spark, folder).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("passages"))


@query(
    "quote_verification",
    f"""WITH q AS (SELECT item_id, text AS quote, {sql.quote('text')} AS nq FROM benchmark),
      d AS (SELECT doc_id, text, {sql.quote('text')} AS nt FROM documents)
    SELECT item_id, doc_id,
      CASE WHEN contains(text, quote) THEN 'exact' ELSE 'typography_normalized' END AS match_mode,
      CAST(CASE WHEN contains(text, quote) THEN strpos(text, quote) ELSE strpos(nt, nq) END - 1 AS BIGINT) AS match_offset
    FROM q JOIN d ON contains(text, quote) OR contains(nt, nq)""",
)
def quote_verification(spark: SparkSession, folder: str) -> DataFrame:
    quotes = load(spark, folder, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    texts = spread(load(spark, folder, "documents", "doc_id", "text"))
    return locate_quotes(quotes, texts).withColumnsRenamed({"quote_id": "item_id", "offset": "match_offset"})


CHUNK_LIMIT, CHUNK_OVERLAP = 2_000, 200


CHUNKS_SQL = f"""c(doc_id, text, idx, start, stop) AS (
      SELECT doc_id, text, 0, 0,
        CASE WHEN length(text) > {CHUNK_LIMIT} AND
          length(substr(text, 1, {CHUNK_LIMIT + 2})) - strpos(reverse(substr(text, 1, {CHUNK_LIMIT + 2})), chr(10) || chr(10)) - 1 > {CHUNK_LIMIT * 65 // 100}
          AND contains(substr(text, 1, {CHUNK_LIMIT + 2}), chr(10) || chr(10))
          THEN length(substr(text, 1, {CHUNK_LIMIT + 2})) - strpos(reverse(substr(text, 1, {CHUNK_LIMIT + 2})), chr(10) || chr(10)) - 1
          ELSE least(length(text), {CHUNK_LIMIT}) END
      FROM documents
      UNION ALL
      SELECT doc_id, text, idx + 1, s,
        CASE WHEN s + {CHUNK_LIMIT} < length(text) AND contains(substr(text, 1, s + {CHUNK_LIMIT + 2}), chr(10) || chr(10))
          AND s + {CHUNK_LIMIT + 2} - strpos(reverse(substr(text, 1, s + {CHUNK_LIMIT + 2})), chr(10) || chr(10)) - 1 > s + {CHUNK_LIMIT * 65 // 100}
          THEN s + {CHUNK_LIMIT + 2} - strpos(reverse(substr(text, 1, s + {CHUNK_LIMIT + 2})), chr(10) || chr(10)) - 1
          ELSE least(length(text), s + {CHUNK_LIMIT}) END
      FROM (SELECT *, greatest(start + 1, stop - {CHUNK_OVERLAP}) AS s FROM c WHERE stop < length(text)))"""


@query(
    "text_chunks",
    f"""WITH RECURSIVE {CHUNKS_SQL}
    SELECT doc_id, CAST(idx AS BIGINT) AS chunk, CAST(start AS BIGINT) AS chunk_start,
      CAST(stop - start AS BIGINT) AS chars, sha256(substr(text, start + 1, stop - start)) AS text_sha
    FROM c""",
)
def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(load(spark, folder, "documents", "doc_id", "text"))
    pieces = docs.select("doc_id", F.inline_outer(chunks("text", CHUNK_LIMIT, CHUNK_OVERLAP))).where("idx IS NOT NULL")
    return pieces.select(
        "doc_id",
        F.col("idx").cast("bigint").alias("chunk"),
        F.col("start").cast("bigint").alias("chunk_start"),
        F.length("text").cast("bigint").alias("chars"),
        F.sha2("text", 256).alias("text_sha"),
    )


@query(
    "bounded_text",
    """SELECT doc_id, CAST(length(b) AS BIGINT) AS chars, sha256(b) AS text_sha FROM (
      SELECT doc_id, CASE WHEN length(text) <= 24000 THEN text ELSE
        left(text, 18000) || chr(10) || chr(10) || '[... middle omitted ...]' || chr(10) || chr(10) || right(text, 6000) END AS b
      FROM documents)""",
)
def bounded(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(load(spark, folder, "documents", "doc_id", "text"))
    cut_text = docs.select("doc_id", bounded_text("text").alias("b"))
    return cut_text.select("doc_id", F.length("b").cast("bigint").alias("chars"), F.sha2("b", 256).alias("text_sha"))


@query(
    "prose_clean",
    """SELECT conv_id, turn, role = 'assistant' AS artefact, sha256(trim(text, chr(10) || ' ')) AS clean_sha
    FROM conversations""",
)
def prose_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns get a serialised tail appended; cleaning must give the turn back unharmed."""
    turns = load(spark, folder, "conversations")
    tail = F.concat(F.lit('", "sourceIds": ["s'), F.col("turn").cast("string"), F.lit('"]}]}'))
    shown = turns.withColumn(
        "shown", F.when(F.col("role") == "assistant", F.concat("text", tail)).otherwise(F.col("text"))
    )
    judged = shown.select("conv_id", "turn", prose("shown").alias("prose"))
    return judged.select("conv_id", "turn", "prose.artefact", F.sha2("prose.clean", 256).alias("clean_sha"))


@query(
    "word_counts",
    """SELECT source, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words,
      CAST(max(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS longest FROM documents GROUP BY source""",
)
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents", "source", "text").withColumn("words", word_count("text").cast("bigint"))
    return docs.groupBy("source").agg(F.sum("words").alias("words"), F.max("words").alias("longest"))
