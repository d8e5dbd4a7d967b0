"""Deterministic keys and content hashes."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .text import _col, normalize_casefold


def canonical_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@arrow_udf(T.StringType())
def record_hash(raw: pa.Array) -> pa.Array:
    """sha256 of the record's canonical JSON without its check time; null when it is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if value is None:
            return None
        if isinstance(value, dict):
            value.pop("checkedAt", None)
        return hashlib.sha256(canonical_json(value).encode()).hexdigest()

    return pa.array([one(text) for text in raw.to_pylist()], pa.string())


def json_text(text) -> Column:
    """A JSON string literal, as the canonical JSON of a bare text."""
    return F.regexp_extract(F.to_json(F.struct(_col(text).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def text_hash(text) -> Column:
    return F.sha2(json_text(text), 256)


def entity_key(title, year, director, prefix: str = "film-") -> Column:
    identity = F.concat(
        F.lit("["),
        json_text(normalize_casefold(_col(title))),
        F.lit(","),
        _col(year).cast("string"),
        F.lit(","),
        json_text(normalize_casefold(_col(director))),
        F.lit("]"),
    )
    return F.concat(F.lit(prefix), F.substring(F.sha2(identity, 256), 1, 24))


def version_id(source, digest) -> Column:
    return F.concat_ws("@", _col(source), _col(digest))


def embedding_input(summary, summary_ko, subjects, boundary) -> Column:
    return F.concat_ws(
        "\n",
        _col(summary),
        F.coalesce(_col(summary_ko), F.lit("")),
        _col(subjects),
        F.concat(F.lit("Scope: "), _col(boundary)),
    )


def input_hash(model, dimensions, text) -> Column:
    return F.sha2(F.concat_ws(":", _col(model), _col(dimensions).cast("string"), _col(text)), 256)
