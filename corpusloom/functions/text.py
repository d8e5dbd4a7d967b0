"""Text normalisers, identity keys and term extraction."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

# The white space class and the search stop words.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
STOP_WORDS = (
    "a an and are as at be by for from he her his in into is it its of on or that the their them "
    "they this to was were what which who with film films cinema movie movies director story about "
    "한국어 영화 감독 작품 이야기"
).split(" ")

_WORD = r"[\p{L}\p{N}]+"


@arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves composed forms decomposed, so each non-ASCII value is normalised here.
    return pa.array(
        [v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in text.to_pylist()],
        pa.string(),
    )


@arrow_udf(T.StringType())
def nfkd(text: pa.Array) -> pa.Array:
    return pc.utf8_normalize(text, form="NFKD")


_NOT_KEY = re.compile(r"[^a-z0-9]+")


@arrow_udf(T.StringType())
def normalize_casefold(text: pa.Array) -> pa.Array:
    """Ingestion key: NFKD, case folded, alphanumeric characters that are not combining marks."""
    return pa.array(
        [
            None
            if value is None
            else _NOT_KEY.sub("", value.lower())
            if value.isascii()
            else "".join(
                c
                for c in unicodedata.normalize("NFKD", value).casefold()
                if c.isalnum() and not unicodedata.combining(c)
            )
            for value in text.to_pylist()
        ],
        pa.string(),
    )


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fold(text) -> Column:
    """Decomposed, without marks, lower case: the base of the identity and person keys."""
    return F.lower(F.regexp_replace(nfkd(_col(text)), r"\p{M}", ""))


def identity_text(text) -> Column:
    return F.regexp_replace(fold(text), r"[^\p{L}\p{N}]", "")


def words(folded) -> Column:
    return F.regexp_extract_all(_col(folded), F.lit(_WORD), F.lit(0))


def person_tokens(text) -> Column:
    return F.array_sort(words(fold(text)))


def person_key(text) -> Column:
    """Word tokens in sorted order, so a reversed name has the same key."""
    return F.array_join(person_tokens(text), " ")


def title_key(text) -> Column:
    return identity_text(F.regexp_replace(_col(text), rf"(?i)^(?:the|an|a){SPACE}+", ""))


def credit_names(text) -> Column:
    parts = F.split(_col(text), rf"(?i){SPACE}*(?:,|;|&|\band\b){SPACE}*")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def search_terms(text) -> Column:
    """Distinct lower-case terms of more than two characters that are no stop words."""
    found = words(F.lower(nfkc(_col(text))))
    return F.array_distinct(
        F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
    )


def search_norm(text) -> Column:
    return F.regexp_replace(nfkd(F.lower(_col(text))), rf"[\p{{P}}\p{{M}}]|{SPACE}", "")


def normalize_quote(text) -> Column:
    """Typography-tolerant form of a quotation; word order and diacritics stay."""
    out = F.regexp_replace(nfkc(_col(text)), "\u00ad", "")
    out = F.regexp_replace(out, r"-\r?\n(?=\p{L})", "")
    out = F.regexp_replace(out, "[‘’‚‛ʼ`]", "'")
    out = F.regexp_replace(out, "[“”„‟]", '"')
    out = F.regexp_replace(out, "[‐‑‒–—−]", "-")
    return F.trim(F.regexp_replace(out, rf"{SPACE}+", " "))


def word_list(text) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(r"\S+"), F.lit(0))


def word_count(text) -> Column:
    return F.coalesce(F.size(word_list(text)), F.lit(0))


def trim_words(text, limit: int) -> Column:
    return F.array_join(F.slice(word_list(text), 1, limit), " ")


def partial_date(text) -> Column:
    """`YYYY`, `YYYY-MM` or an ISO day (with or without a time); anything else is null."""
    return F.when(_col(text).rlike(r"^\d{4}$|^\d{4}-\d{2}$|^\d{4}-\d{2}-\d{2}(?:T.*)?$"), _col(text))


def date_precision(text) -> Column:
    value = _col(text)
    return (
        F.when(value.rlike(r"^\d{4}$"), "year")
        .when(value.rlike(r"^\d{4}-\d{2}$"), "month")
        .when(value.rlike(r"^\d{4}-\d{2}-\d{2}(?:T.*)?$"), "day")
    )


def valid_iso(text) -> Column:
    """Whether a partial or full ISO date names a real date."""
    value = _col(text)
    padded = (
        F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit("-01-01")))
        .when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(value, F.lit("-01")))
        .otherwise(value)
    )
    shaped = padded.rlike(
        r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    )
    return F.coalesce(shaped & F.try_to_timestamp(padded).isNotNull(), F.lit(False))


def bounded_text(text) -> Column:
    """Texts over 24,000 characters keep their first 18,000 and last 6,000 around a marker."""
    value = _col(text)
    return F.when(F.length(value) <= 24_000, value).otherwise(
        F.concat(F.left(value, F.lit(18_000)), F.lit("\n\n[... middle omitted ...]\n\n"), F.right(value, F.lit(6_000)))
    )


def clean_text(text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_col(text), r"\[[0-9]+\]", ""), rf"{SPACE}+", " "))


def plot_excerpt(extract) -> Column:
    """First paragraph of the plot section, at most 1,000 characters, cut after a sentence."""
    body = F.regexp_extract(
        _col(extract),
        r"(?is)(?:^|\n)==\s*(?:Plot(?: summary)?|Synopsis|줄거리|내용)\s*==\s*\n(.*?)(?=\n==|$(?![\s\S]))",
        1,
    )
    paragraphs = F.filter(
        F.transform(F.split(body, r"\n\s*\n"), clean_text),
        lambda p: (p != "") & ~p.startswith("="),
    )
    first = F.coalesce(F.try_element_at(paragraphs, F.lit(1)), F.lit(""))
    head = F.left(first, F.lit(1000))
    sentence = F.regexp_extract(head, r"^[\s\S]*[.!?。다][.!?。]?\s", 0)
    cut = F.concat(F.trim(F.when(sentence != "", sentence).otherwise(head)), F.lit("…"))
    return F.when(F.length(first) <= 1000, first).otherwise(cut)


def pick_language(language, korean, english) -> Column:
    ko = F.when(_col(korean) != "", _col(korean))
    return F.when(_col(language) == "ko", F.coalesce(ko, _col(english))).otherwise(_col(english))


def overview_share(overviews: list, films) -> Column:
    """First overview present, cut to an equal share of 1,500 characters and at most 300."""
    present = F.coalesce(*[F.when(_col(c) != "", _col(c)) for c in overviews], F.lit(""))
    return F.left(present, F.least(F.lit(300), F.floor(F.lit(1500) / _col(films)).cast("int")))
