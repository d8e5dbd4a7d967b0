"""Context selection, edge recommendation, re-ranking, packing and reassembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.chunks import chunks
from ..functions.text import search_terms
from ..operators.lexical import lexical_hits
from ..operators.ranking import (
    REDUNDANCY, SAME_COUNTRY, SAME_DECADE, SAME_DIRECTOR, SEEN, SHARED_GENRE, diversity_rerank, edge_candidates, top_candidates,
)
from ..operators.retrieval import CHARACTERS, DIRECT_SCORE, PASSAGES, PER_DOCUMENT, context_coverage, merge_hits, ranked_hits, select_context
from ..operators.sequences import pack, reassemble
from ..session import cut, load, spread
from .registry import query
from .sql import terms
from .texts import CHUNK_LIMIT, CHUNK_OVERLAP, CHUNKS_SQL


SEEDS = 4


# Hits, their merging and the greedy choice: guaranteed rows in order of their anchors, then sixteen steps at most.
_CONTEXT_SQL = f"""{CHUNKS_SQL},
  p AS (SELECT doc_id || '#' || idx AS pid, doc_id, substr(text, start + 1, stop - start) AS txt FROM c),
  cards AS (SELECT pid, doc_id, length(CAST(to_json({{'passage_id': pid, 'doc_id': doc_id, 'text': txt}}) AS VARCHAR)) AS size, {terms('txt')} AS ts FROM p),
  d AS (SELECT pid, unnest(ts) AS term FROM cards),
  f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
  i AS (SELECT item_id, item_id // {SEEDS} AS rid, {terms('text')} AS ts FROM benchmark),
  q AS (SELECT item_id, term, ln(1 + (SELECT count(*) FROM p) / (1 + df)) AS idf FROM (SELECT item_id, unnest(ts) AS term FROM i) JOIN f USING (term)),
  h AS (SELECT item_id, pid, round(sum(idf), 6) AS raw, count(*) AS matched FROM q JOIN d USING (term) GROUP BY item_id, pid HAVING count(*) >= 2
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, pid) <= 8),
  m AS (SELECT rid, pid, max(CASE WHEN matched >= len(ts) * 0.9 THEN {DIRECT_SCORE} ELSE round(least(5.0, raw / 3), 6) END)::DOUBLE AS score,
      list(DISTINCT item_id) AS anchors, list(DISTINCT item_id) FILTER (matched >= len(ts) * 0.9) AS direct FROM h JOIN i USING (item_id) GROUP BY ALL),
  v AS (SELECT *, round(score + ln(1 + len(anchors)), 9) AS value FROM m JOIN cards USING (pid)),
  promised AS (SELECT rid, pid, row_number() OVER (PARTITION BY rid ORDER BY anchor) AS nth FROM (
    SELECT rid, pid, anchor FROM (SELECT *, unnest(direct) AS anchor FROM v) QUALIFY row_number() OVER (PARTITION BY rid, anchor ORDER BY value DESC, pid) = 1)),
  step(rid, turn, chosen, used, done) AS (
    SELECT DISTINCT rid, 1::BIGINT, []::STRUCT(pid VARCHAR, doc BIGINT, anchors BIGINT[])[], 0::BIGINT, false FROM v
    UNION ALL
    SELECT rid, turn + 1, CASE WHEN pid IS NULL THEN chosen ELSE list_append(chosen, {{'pid': pid, 'doc': doc_id, 'anchors': anchors}}) END,
      used + coalesce(size, 0), turn > (SELECT coalesce(max(nth), 0) FROM promised p WHERE p.rid = t.rid) AND pid IS NULL FROM (
      SELECT step.*, v.pid, v.doc_id, v.size, v.anchors, row_number() OVER (PARTITION BY step.rid ORDER BY
        v.value / (1 + len(list_filter(chosen, lambda y: list_has_any(y.anchors, v.anchors))) * 0.45::DOUBLE + len(list_filter(chosen, lambda y: y.doc = v.doc_id)) * 2) DESC NULLS LAST, v.pid) AS r
      FROM step LEFT JOIN v ON v.rid = step.rid AND NOT list_contains(list_transform(chosen, lambda y: y.pid), v.pid)
        AND len(list_filter(chosen, lambda y: y.doc = v.doc_id)) < {PER_DOCUMENT} AND used + v.size <= {CHARACTERS}
        AND (turn > (SELECT coalesce(max(nth), 0) FROM promised p WHERE p.rid = step.rid) OR v.pid = (SELECT pid FROM promised p WHERE p.rid = step.rid AND p.nth = turn))
      WHERE NOT done AND len(chosen) < {PASSAGES}) t WHERE r = 1),
  final AS (SELECT rid, chosen FROM step QUALIFY row_number() OVER (PARTITION BY rid ORDER BY turn DESC) = 1),
  context AS MATERIALIZED (SELECT rid, chosen[n].pid AS pid, n AS position FROM (SELECT *, unnest(range(1, len(chosen) + 1)) AS n FROM final))"""


def _merged_hits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Merged hits for requests of four benchmark items each, and the cards of the passages, chunks of documents.

    Items are the anchors. A chunk with nine tenths of an item's terms is its direct hit, the
    other lexical hits are related context.
    """
    docs = spread(load(spark, folder, "documents", "doc_id", "text"))
    pieces = docs.select("doc_id", F.inline_outer(chunks("text", CHUNK_LIMIT, CHUNK_OVERLAP))).where("idx IS NOT NULL")
    named = pieces.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("idx").cast("string")).alias("passage_id"), "doc_id", "text")
    # Scores need the terms and the budget the size; whole texts stay where they are.
    passages = cut(named.select(
        "passage_id", "doc_id", F.length(F.to_json(F.struct("passage_id", "doc_id", "text"))).alias("size"), search_terms("text").alias("terms")
    ))
    items = load(spark, folder, "benchmark").select("item_id", F.floor(F.col("item_id") / SEEDS).alias("request_id"), search_terms("text").alias("terms"))
    asked = items.select(F.col("item_id").alias("request_id"), "terms")
    related = lexical_hits(asked, passages.select("passage_id", "terms")).withColumnRenamed("request_id", "item_id")
    hits = related.join(items.select("item_id", "request_id", F.size("terms").alias("asked")), "item_id")
    direct = F.col("matched") >= F.col("asked") * 0.9
    merged = merge_hits(hits.select(
        "request_id", "passage_id", F.when(direct, DIRECT_SCORE).otherwise(F.col("score")).alias("score"), F.col("item_id").alias("anchor"), direct.alias("direct")
    ))
    return cut(merged), passages.select("passage_id", "doc_id", "size")


def _selected(merged: DataFrame, cards: DataFrame) -> DataFrame:
    return select_context(ranked_hits(merged).join(cards, "passage_id"))


@query(
    "context_selection",
    f"""WITH RECURSIVE {_CONTEXT_SQL}
    SELECT rid AS request_id, pid AS passage_id, doc_id, round(score, 6) AS score, size, position FROM context JOIN v USING (rid, pid)""",
)
def context_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Budgeted context of each request."""
    chosen = _selected(*_merged_hits(spark, folder))
    return chosen.withColumns({"score": F.round("score", 6), "size": F.col("size").cast("bigint"), "position": F.col("position").cast("bigint")})


@query(
    "context_coverage",
    f"""WITH RECURSIVE {_CONTEXT_SQL}
    SELECT b.item_id // {SEEDS} AS request_id, b.item_id, count(x.held) AS passages FROM benchmark b LEFT JOIN (
      SELECT unnest(anchors) AS held FROM context JOIN v USING (rid, pid)) x ON x.held = b.item_id GROUP BY ALL""",
)
def covered_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many chosen passages stand for each item of a request, none included."""
    merged, cards = _merged_hits(spark, folder)
    chosen = _selected(merged, cards).select("request_id", "passage_id")
    held = chosen.join(merged.select("request_id", "passage_id", F.col("anchors").alias("film_ids")), ["request_id", "passage_id"])
    items = load(spark, folder, "benchmark").select(F.floor(F.col("item_id") / SEEDS).alias("request_id"), F.col("item_id").alias("film_id"))
    return context_coverage(items, held.select("request_id", "film_ids")).select("request_id", F.col("film_id").alias("item_id"), F.col("n").alias("passages"))


_EDGE_SQL = """
  e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p, CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'A' THEN 0.78 ELSE 0.6 END::DOUBLE AS q, l_returnflag FROM lineitem),
  c AS (SELECT s_nationkey AS nation, s_suppkey AS s, 1.0::DOUBLE / count(*) OVER (PARTITION BY s_nationkey) AS w FROM supplier),
  x AS (SELECT nation, p, round(sum(w * q), 9) AS score, count(*) AS connections FROM c JOIN e USING (s) GROUP BY ALL),
  t AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, 'p' || p) AS place FROM x QUALIFY place <= 12)"""


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Nations ask with their suppliers; line items link suppliers to parts."""
    lines = load(spark, folder, "lineitem", "l_suppkey", "l_partkey", "l_returnflag").distinct()
    relation = F.when(F.col("l_returnflag") == "N", "direct_connection").when(F.col("l_returnflag") == "A", "grounded_interpretation").otherwise("curatorial_association")
    edges = lines.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b"), relation.alias("relation")
    )
    context = load(spark, folder, "supplier", "s_suppkey", "s_nationkey").select(
        F.col("s_nationkey").alias("request_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("film_id")
    )
    return top_candidates(edge_candidates(context, edges))


@query("edge_recommend", f"WITH {_EDGE_SQL} SELECT nation, 'p' || p AS candidate, round(score, 6) AS score, connections, place FROM t")
def edge_recommend(spark: SparkSession, folder: str) -> DataFrame:
    return recommendations(spark, folder).select(
        F.col("request_id").alias("nation"), "candidate", F.round("score", 6).alias("score"), "connections", F.col("place").cast("bigint").alias("place")
    )


_RERANK_SQL = f"""
  m AS (SELECT nation, 'p' || p AS cand, round(score, 6) AS rel, CASE WHEN connections > 1 THEN {SEEN} ELSE 0 END AS seen,
      p_brand AS director, p_type AS country, p_size // 10 AS decade, string_split(p_name, ' ') AS genres
    FROM t JOIN part ON p_partkey = p),
  near AS (SELECT a.nation, a.cand, a.rel, a.seen, greatest(max(b.rel) OVER (PARTITION BY a.nation), 0.0001) AS top, b.cand AS other,
      CASE WHEN a.director = b.director THEN {SAME_DIRECTOR} ELSE 0 END + CASE WHEN a.country = b.country THEN {SAME_COUNTRY} ELSE 0 END
      + CASE WHEN a.decade = b.decade THEN {SAME_DECADE} ELSE 0 END + CASE WHEN list_has_any(a.genres, b.genres) THEN {SHARED_GENRE} ELSE 0 END AS alike
    FROM m a JOIN m b ON a.nation = b.nation),
  n AS (SELECT nation, cand, any_value(rel / top) AS share, any_value(seen) AS seen, list({{'c': other, 's': alike}}) AS alike FROM near GROUP BY ALL),
  step(nation, position, chosen) AS (
    SELECT DISTINCT nation, 0, []::VARCHAR[] FROM n
    UNION ALL
    SELECT nation, position + 1, list_append(chosen, cand) FROM (
      SELECT step.nation, position, chosen, cand, row_number() OVER (PARTITION BY step.nation ORDER BY
        round(share * (1 - {REDUNDANCY} * coalesce(list_max(list_transform(list_filter(alike, lambda y: list_contains(chosen, y.c)), lambda y: y.s)), 0)) - seen, 12) DESC, cand) AS r
      FROM step JOIN n ON n.nation = step.nation WHERE NOT list_contains(chosen, cand)) WHERE r = 1)"""


@query(
    "diversity_rerank",
    f"""WITH RECURSIVE {_EDGE_SQL}, {_RERANK_SQL}
    SELECT nation AS request_id, chosen[position] AS candidate, position FROM step WHERE position > 0""",
)
def rerank(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve parts per nation re-ordered: brand as director, type as country, size as year."""
    part = load(spark, folder, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("candidate"),
        F.col("p_brand").alias("director"),
        F.col("p_type").alias("country"),
        F.col("p_size").alias("year"),
        F.split("p_name", " ").alias("genres"),
    )
    top = recommendations(spark, folder).join(part, "candidate")
    rows = top.select("request_id", "candidate", F.round("score", 6).alias("relevance"), "director", "country", "year", "genres", (F.col("connections") > 1).alias("seen"))
    return diversity_rerank(rows)


PACK_ITEMS, PACK_CHARS = 8, 20_000


@query(
    "pack_batches",
    f"""WITH RECURSIVE d AS (SELECT source, doc_id, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
      p(source, i, items, chars, chunk) AS (
        SELECT source, i, 1, n, 0 FROM d WHERE i = 1
        UNION ALL SELECT d.source, d.i, CASE WHEN p.items >= {PACK_ITEMS} OR p.chars + d.n > {PACK_CHARS} THEN 1 ELSE p.items + 1 END,
          CASE WHEN p.items >= {PACK_ITEMS} OR p.chars + d.n > {PACK_CHARS} THEN d.n ELSE p.chars + d.n END,
          CASE WHEN p.items >= {PACK_ITEMS} OR p.chars + d.n > {PACK_CHARS} THEN p.chunk + 1 ELSE p.chunk END
        FROM p JOIN d ON d.source = p.source AND d.i = p.i + 1)
    SELECT source, CAST(chunk AS BIGINT) AS chunk, count(*) AS items, CAST(sum(n) AS BIGINT) AS chars, min(doc_id) AS first_doc
    FROM p JOIN d USING (source, i) GROUP BY source, chunk""",
)
def pack_batches(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents", "source", "doc_id", "text").select("source", "doc_id", F.length("text").alias("n"))
    packed = pack(docs, "source", "doc_id", "n", PACK_ITEMS, PACK_CHARS)
    return packed.groupBy("source", "chunk").agg(F.count("*").alias("items"), F.sum("chars").alias("chars"), F.min("doc_id").alias("first_doc"))


@query(
    "reassemble_turns",
    """SELECT conv_id, turn // 64 AS part, sha256(string_agg(text, '' ORDER BY turn)) AS text_sha, count(*) AS turns
    FROM conversations GROUP BY conv_id, turn // 64""",
)
def reassemble_turns(spark: SparkSession, folder: str) -> DataFrame:
    whole = reassemble(load(spark, folder, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text")
    return whole.select("conv_id", "part", F.sha2("text", 256).alias("text_sha"), F.col("rows").cast("bigint").alias("turns"))
