"""Which texts contain which needles, without comparing every text with every needle.

Each needle is looked up by the rarest of its own grams, so a gram that fills the corpus is only used
by needles that have nothing rarer; each candidate is then verified on the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_quote
from ..session import cut, join_back, lookup

WORDS_PER_KEY = 5
CHARS_PER_KEY = 8


def _grams(pieces: Column, size: int) -> Column:
    windows = F.size(pieces) - size + 1
    zipped = F.arrays_zip(*[F.slice(pieces, at + 1, windows) for at in range(size)])
    hashed = F.transform(zipped, lambda gram: F.xxhash64(F.lit(size), gram))
    return F.when(F.size(pieces) >= size, F.array_distinct(hashed)).otherwise(
        F.array().cast("array<bigint>")
    )


def _char_grams(text: Column, size: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?s)(?=(" + "." * size + "))"), F.lit(1))
    return F.transform(F.array_distinct(found), lambda g: F.xxhash64(F.lit(-size), g))


def _unnest(hay: DataFrame, grams: Column) -> DataFrame:
    # The outer form spares the inferred size filter, which would compute all grams twice.
    return hay.select("hay_id", F.explode_outer(grams).alias("gram")).where("gram IS NOT NULL")


def _candidates(keyed: DataFrame, hay_grams: DataFrame) -> DataFrame:
    """(needle_id, hay_id) for keyed(needle_id, gram) and hay_grams(hay_id, gram)."""
    held = cut(lookup(hay_grams, keyed.select("gram").distinct(), ["gram"], "left_semi"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        join_back(keyed, counts, ["gram"], "left")
        .groupBy("needle_id")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    )
    return lookup(held, cut(rarest), ["gram"]).select("needle_id", "hay_id")


def _sizes(needles: DataFrame, size: str) -> list[int]:
    return sorted(row[0] for row in needles.select(size).distinct().collect())


def candidates_by_words(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """Needles keyed by up to five interior words; needles without one fall back to characters.

    Both sides are normalised texts with single spaces. The first and last word of a needle may be
    parts of longer words, so only interior words are certain to be whole words of the text.
    """
    split = needles.withColumn("inner", F.expr("slice(split(needle, ' '), 2, greatest(size(split(needle, ' ')) - 2, 0))"))
    keyed = split.withColumn("size", F.least(F.size("inner"), F.lit(WORDS_PER_KEY)))
    long, short = keyed.where("size > 0"), keyed.where("size = 0")
    parts = []
    sizes = _sizes(long, "size")
    if sizes:
        own = reduce(
            lambda a, s: a.when(F.col("size") == s, _grams(F.col("inner"), s)),
            sizes[1:],
            F.when(F.col("size") == sizes[0], _grams(F.col("inner"), sizes[0])),
        )
        all_grams = F.concat(*[_grams(F.col("pieces"), s) for s in sizes])
        parts.append(
            _candidates(
                long.select("needle_id", F.explode(own).alias("gram")),
                _unnest(hay.select("hay_id", F.split("hay", " ").alias("pieces")), all_grams),
            )
        )
    if short.limit(1).count():
        parts.append(candidates_by_chars(short.select("needle_id", "needle"), hay))
    return reduce(DataFrame.unionByName, parts) if parts else _none(needles, hay)


def candidates_by_chars(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """Needles keyed by one gram of at most eight characters."""
    keyed = needles.where("needle != ''").withColumn(
        "size", F.least(F.length("needle"), F.lit(CHARS_PER_KEY))
    )
    sizes = _sizes(keyed, "size")
    if not sizes:
        return _none(needles, hay)
    own = reduce(
        lambda a, s: a.when(F.col("size") == s, _char_grams(F.col("needle"), s)),
        sizes[1:],
        F.when(F.col("size") == sizes[0], _char_grams(F.col("needle"), sizes[0])),
    )
    all_grams = F.concat(*[_char_grams(F.col("hay"), s) for s in sizes])
    return _candidates(
        keyed.select("needle_id", F.explode(own).alias("gram")),
        _unnest(hay, all_grams),
    )


def _none(needles: DataFrame, hay: DataFrame) -> DataFrame:
    return needles.join(hay, F.lit(False)).select("needle_id", "hay_id")


def containment(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle_id, hay_id) where the text `hay` contains `needle`; character keys."""
    found = candidates_by_chars(needles, hay)
    return (
        lookup(lookup(hay, found, ["hay_id"]), needles, ["needle_id"])
        .where(F.contains("hay", "needle"))
        .select("needle_id", "hay_id")
    )


def quote_status(text: Column, quote: Column, normal_text: Column, normal_quote: Column) -> Column:
    """struct<status, match_mode, offset, offset_basis> of one quote against one text."""
    exact, loose = F.instr(text, quote), F.instr(normal_text, normal_quote)
    blank = F.trim(quote) == ""
    return F.struct(
        F.when(~blank & ((exact > 0) | (loose > 0)), "matched").otherwise("quote_missing").alias("status"),
        F.when(blank, None).when(exact > 0, "exact").when(loose > 0, "typography_normalized").alias("match_mode"),
        F.when(blank, None).when(exact > 0, exact - 1).when(loose > 0, loose - 1).alias("offset"),
        F.when(blank, None).when(exact > 0, "extracted_text").when(loose > 0, "normalized_text").alias("offset_basis"),
    )


def verify_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Known source: quotes(doc_id, passage_id, quote) against texts(doc_id, text, readable).

    An unreadable or absent source gives `not_checked`, never `quote_missing`.
    """
    checked = quotes.join(texts, "doc_id", "left").withColumn(
        "found",
        quote_status(F.col("text"), F.col("quote"), normalize_quote("text"), normalize_quote("quote")),
    )
    return checked.select(
        "doc_id",
        "passage_id",
        F.when(F.col("readable"), F.col("found.status")).otherwise("not_checked").alias("status"),
        F.when(F.col("readable"), F.col("found.match_mode")).alias("match_mode"),
        F.when(F.col("readable"), F.col("found.offset")).alias("offset"),
        F.when(F.col("readable"), F.col("found.offset_basis")).alias("offset_basis"),
    )


def audit_documents(verified: DataFrame) -> DataFrame:
    """A document is matched only when every one of its quotes is."""
    return verified.groupBy("doc_id").agg(
        F.when(F.bool_or(F.col("status") == "not_checked"), "not_checked")
        .when(F.bool_and(F.col("status") == "matched"), "matched")
        .otherwise("quote_missing")
        .alias("status"),
        F.count("*").alias("quotes"),
    )


def locate_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """Unknown source: every text that contains a quote, exactly or after normalisation.

    quotes(quote_id, quote), texts(doc_id, text). An exact match is also a normalised one, so the
    normalised forms alone choose the candidates.
    """
    needles = cut(quotes.select(F.col("quote_id").alias("needle_id"), normalize_quote("quote").alias("needle")))
    hay = texts.select(F.col("doc_id").alias("hay_id"), normalize_quote("text").alias("hay"))
    found = candidates_by_words(needles.where("needle != ''"), hay).withColumnsRenamed(
        {"needle_id": "quote_id", "hay_id": "doc_id"}
    )
    pairs = lookup(lookup(texts, found, ["doc_id"]), quotes, ["quote_id"])
    located = pairs.withColumn(
        "found",
        quote_status(F.col("text"), F.col("quote"), normalize_quote("text"), normalize_quote("quote")),
    )
    return located.where(F.col("found.status") == "matched").select(
        "quote_id",
        "doc_id",
        F.col("found.match_mode").alias("match_mode"),
        F.col("found.offset").cast("bigint").alias("offset"),
    )
