"""Overlapping chunks that prefer to end at a blank line."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .text import _col

# Every place where a blank line starts, overlapping ones included.
_BLANK = re.compile(r"(?=\n\n)")


def chunk_bounds(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most `limit` characters, each beginning `overlap` before the end of the last.

    A span that is not the last ends at the last blank line within reach, if that leaves it more than 65 percent of
    its limit. All blank lines are found once; each end is then a binary search.
    """
    blanks = [found.start() for found in _BLANK.finditer(text)]
    spans = [(0, 0)]
    while spans[-1][1] < len(text):
        begin = max(spans[-1][0] + 1, spans[-1][1] - overlap) if spans[-1][1] else 0
        reach = begin + limit
        if reach < len(text):
            place = bisect_right(blanks, reach)
            if place and blanks[place - 1] > begin + limit * 65 // 100:
                reach = blanks[place - 1]
        spans.append((begin, min(reach, len(text))))
    return spans[1:] or spans


def chunks(text, limit: int = 36_000, overlap: int = 1_200) -> Column:
    """array<struct<idx, start, text>>; every character of the text is in some chunk."""
    if limit < 2_000 or overlap < 0 or overlap >= limit:
        raise ValueError("chunk limit must be at least 2,000 and the overlap below it")

    @arrow_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType())))
    def bounds(values: pa.Array) -> pa.Array:
        shape = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        rows = [
            None if v is None else [{"start": a, "stop": b} for a, b in chunk_bounds(v, limit, overlap)]
            for v in values.to_pylist()
        ]
        return pa.array(rows, shape)

    value = _col(text)
    return F.transform(
        bounds(value),
        lambda b, i: F.struct(
            i.alias("idx"),
            b["start"].alias("start"),
            F.substring(value, b["start"] + 1, b["stop"] - b["start"]).alias("text"),
        ),
    )
