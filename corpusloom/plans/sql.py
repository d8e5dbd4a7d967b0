"""SQL fragments shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from ..functions.text import STOP_WORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def terms(text: str) -> str:
    """Distinct search terms of a text expression."""
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), "
        f"lambda w: length(w) > 2 AND NOT list_contains({STOP}, w)))"
    )


def quote(text: str) -> str:
    """Typography-normalised form of a text expression."""
    out = f"replace({text}, chr(173), '')"
    out = f"regexp_replace({out}, '-\\r?\\n(\\p{{L}})', '\\1', 'g')"
    out = f"regexp_replace({out}, '[‘’‚‛ʼ`]', '''', 'g')"
    out = f"regexp_replace({out}, '[“”„‟]', '\"', 'g')"
    out = f"regexp_replace({out}, '[‐‑‒–—−]', '-', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"
