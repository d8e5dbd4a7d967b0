"""The registered queries of the numbered operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.registry import Query
from ..session import load
from . import bpe, chat, collide, extract, language, near, packing, phrases, quality, substring, topk, toxicity, whiten

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Words as (doc_id, text bytes kept as they are): separators are the six ASCII ones only.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op2_substring",
    f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
    windows AS (
        SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
    repeated AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
    gone AS (SELECT r, list_distinct(flatten(list(generate_series(i, i + 34)))) AS g FROM repeated GROUP BY r),
    kept AS (
        SELECT doc_id, len(w) AS n_words, len(coalesce(g, [])) AS n_removed,
            CASE WHEN g IS NULL THEN w
                 ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k
        FROM d LEFT JOIN gone USING (r))
    SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
    """,
)
def op2_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substring.dedupe(load(spark, folder, "documents", "doc_id", "text"), "doc_id").drop("kept_text")


@query("op3_packing")
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(load(spark, folder, "documents", "doc_id", "text"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(load(spark, folder, "documents", "doc_id", "text"))


# A conversation whose texts look like the control strings of several templates.
TRICKY = "\\### Assistant: </turn> ok"
_ESC = r"replace(replace(coalesce({0}, ''), '\', '\\'), '<', '\<')"


@query(
    "op8_chat",
    f"""
    WITH rows_ AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
        sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text))
            AS loss_sha256,
        sum(length({_ESC.format('text')})
            + length(replace(replace({_ESC.format('role')}, '>', '\\>'), chr(10), '\\' || chr(10))) + 17)::BIGINT
            AS formatted_chars
    FROM rows_ GROUP BY conv_id
    """,
)
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"),
    )
    rows = load(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(rows.unionByName(tricky)))


@query(
    "op9_topk",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(load(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op6_extract")
def op6_extract(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extract(load(spark, folder, "pages", "page_id", "url", "html"))


@query("op10_language")
def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents", "doc_id", "text", "lang")
    return language.identify(docs, language.fit(docs))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents", "doc_id", "text")
    model = toxicity.fit(docs, load(spark, folder, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def _chance(junk: int, p: str, v: str) -> str:
    prior = f"{p}[1]" if junk else f"(1 - {p}[1])"
    return " * ".join(
        [prior] + [f"{p}[{2 + ((1 - junk) * quality.RULES + r) * 3} + {v}[{r + 1}] + 1]" for r in range(quality.RULES)]
    )


def _junk(p: str, v: str) -> str:
    return f"({_chance(1, p, v)}) / ({_chance(1, p, v)} + {_chance(0, p, v)})"


_BASE_FAILED = f"(n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEAT} * n_words)"
_QUALITY_SQL = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {_WORDS} AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)),
                        lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
        FROM documents),
    windows AS (
        SELECT r, i, sha256(array_to_string(w[i:i + 7], ' ')) AS h
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
    twice AS (SELECT r, i FROM windows SEMI JOIN (
        SELECT r, h FROM windows GROUP BY r, h HAVING count(*) > 1) t USING (r, h)),
    covered AS (SELECT r, len(list_distinct(flatten(list(generate_series(i, i + 7))))) AS n FROM twice GROUP BY r),
    s AS (
        SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT
                AS word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
            length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
        FROM d LEFT JOIN covered USING (r)),
    voted AS (
        SELECT *, {_BASE_FAILED} AS base_failed, [
            CASE WHEN 10 * n_symbols > 3 * n_words THEN 1 WHEN 50 * n_symbols <= n_words THEN -1 ELSE 0 END,
            CASE WHEN 2 * n_dup_lines > n_lines THEN 1 WHEN 20 * n_repeat_words <= n_words THEN -1 ELSE 0 END,
            CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 1
                 WHEN word_chars >= 3 * n_words AND word_chars <= 9 * n_words THEN -1 ELSE 0 END,
            CASE WHEN 10 * n_capitals > 3 * word_chars THEN 1
                 WHEN 20 * n_capitals <= 3 * word_chars THEN -1 ELSE 0 END] AS v
        FROM s),
    patterns AS (
        SELECT list({{'v': v, 'n': n}} ORDER BY v) AS ps
        FROM (SELECT v, count(*)::DOUBLE AS n FROM voted WHERE NOT base_failed GROUP BY v)),
    em(i, p) AS (
        SELECT 0, {quality.START}::DOUBLE[]
        UNION ALL
        SELECT i + 1, list_concat(
            [list_sum(list_transform(js, lambda x: x.n * x.j)) / list_sum(list_transform(js, lambda x: x.n))],
            list_transform(range(0, {6 * quality.RULES}), lambda k: (CASE
                WHEN k >= {3 * quality.RULES} AND k % 3 = 2 THEN least({quality.MOST_FALSE}, rates[k + 1])
                ELSE rates[k + 1] END)))
        FROM (
            SELECT i, js, list_transform(range(0, {6 * quality.RULES}), lambda k:
                (list_sum(list_transform(js, lambda x: CASE WHEN x.v[(k // 3) % {quality.RULES} + 1] = k % 3 - 1
                    THEN x.n * (CASE WHEN k < {3 * quality.RULES} THEN x.j ELSE 1 - x.j END) ELSE 0 END))
                    + {quality.SMOOTH} * {quality.START}[k + 2])
                / (list_sum(list_transform(js, lambda x:
                    x.n * (CASE WHEN k < {3 * quality.RULES} THEN x.j ELSE 1 - x.j END))) + {quality.SMOOTH})) AS rates
            FROM (
                SELECT i, list_transform(ps, lambda x: {{'v': x.v, 'n': x.n, 'j': {_junk('p', 'x.v')}}}) AS js
                FROM em, patterns WHERE i < {quality.ROUNDS} AND ps IS NOT NULL))),
    learnt AS (SELECT p FROM em ORDER BY i DESC LIMIT 1)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND {_junk('p', 'v')} < 0.5 AS kept
    FROM voted, learnt
    """


@query("op1_quality", _QUALITY_SQL)
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(load(spark, folder, "documents", "doc_id", "text"), "doc_id").drop("n_lines", "n_capitals")


@query(
    "op4_near_duplicates",
    """
    WITH RECURSIVE d AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    s AS (
        SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
        FROM d),
    e AS (SELECT r, doc_id, len(g) AS n, unnest(g) AS x FROM s),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r
        GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
    reach(id, low) AS (
        SELECT DISTINCT doc_id, doc_id FROM d
        UNION
        SELECT p.b, reach.low FROM reach JOIN pairs p ON p.a = reach.id WHERE p.b > reach.low),
    least AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id)
    SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM s JOIN least ON doc_id = id
    """,
)
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(load(spark, folder, "documents", "doc_id", "text"))


@query(
    "op11_vector_links",
    f"""
    WITH RECURSIVE v AS (
        SELECT vec_id, label, row_number() OVER () AS r, CAST(embedding AS DOUBLE[]) AS e,
            label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
    pairs AS (
        SELECT a.r AS ar, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r
        WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= {collide.COSINE}),
    reach(id, low) AS (
        SELECT DISTINCT vec_id, vec_id FROM v
        UNION
        SELECT p.b, reach.low FROM reach JOIN pairs p ON p.a = reach.id WHERE p.b > reach.low),
    least AS (SELECT id, min(low) AS component_id FROM reach GROUP BY id),
    counted AS (SELECT ar, count(*) AS n FROM pairs GROUP BY ar)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM v JOIN least ON vec_id = id LEFT JOIN counted ON ar = r
    """,
)
def op11_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    return collide.link(load(spark, folder, "embeddings", "vec_id", "embedding", "label"))


_PHRASE_SIZES = ", ".join(f"({k})" for k in range(1, phrases.DEPTH + 1))


@query(
    "op12_collocations",
    rf"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS s FROM documents),
    w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    g AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
        FROM w, (VALUES {_PHRASE_SIZES}) AS sizes(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
    c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS ws FROM f WHERE k > 1),
    cuts AS (
        SELECT c.lang, c.g, c.a, i, x.f AS l, y.f AS r,
            (({phrases.SCORE}::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c
        JOIN f x ON x.lang = c.lang AND x.g = array_to_string(ws[1:i], ' ')
        JOIN f y ON y.lang = c.lang AND y.g = array_to_string(ws[i + 1:c.k], ' ')),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
    within AS (
        SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS g, max(a) AS longer
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
    kept AS (
        SELECT b.* FROM best b LEFT JOIN within USING (lang, g)
        WHERE longer IS NULL OR 100 * longer < {phrases.INSIDE} * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= {phrases.TOP}
    """,
)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(load(spark, folder, "documents", "text", "lang"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten.whiten(load(spark, folder, "embeddings", "vec_id", "embedding"))
