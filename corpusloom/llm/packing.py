"""Packing by power-of-two decomposition: every document's ids are cut into pieces of binary length.

A document of n ids (the end id included) gives n // MOST pieces of MOST ids and one piece for every binary digit
of the rest, longest first. A piece is a sequence of its own, so no sequence crosses documents and none holds
padding; sequences of equal length form a bucket from which batches are drawn.

Defined results: null and empty text are the end id alone (one piece of one id); repeated rows are packed each for
itself; null doc_ids are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from .pieces import UnitEncoder

MOST = 1024
END = 0
# Units that the tokenizer is given as one text.
JOINT = 256
SCHEMA = "doc_id {kind}, start long, length long, ids binary, doc_tokens long"


def lengths(n: int, most: int = MOST) -> list[int]:
    """The lengths of the pieces of n ids; `most` is a power of two."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


@functools.lru_cache(maxsize=1)  # kept by the worker from task to task
def _encoder(path: str) -> UnitEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    # A byte-level token has a character for every byte.
    width = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for token, number in tokenizer.get_vocab().items():
        width[number] = len(token)

    def several(texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, dtype="<u4") for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joint(units: list[str]) -> Iterator[bytes]:
        """Units that begin with a space and end without: one text, whose ids are cut by their bytes."""
        for ids, own in zip(several(["".join(units[i : i + JOINT]) for i in range(0, len(units), JOINT)]), range(0, len(units), JOINT)):
            ends = np.cumsum([len(unit.encode()) for unit in units[own : own + JOINT]])
            reached = np.cumsum(width[ids])
            cuts = np.searchsorted(reached, ends) + 1
            if not np.array_equal(reached[cuts - 1], ends):
                raise ValueError("a token reaches over two units")
            body = ids.tobytes()
            for low, high in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield body[4 * low : 4 * high]

    def encode(units: list[str]) -> Iterator[bytes]:
        for i in range(0, len(units), 1 << 14):
            some = units[i : i + (1 << 14)]
            apart = [unit for unit in some if unit[0] != " " or unit[-1].isspace()]
            found = dict(zip(apart, (ids.tobytes() for ids in several(apart)), strict=True))
            rest = [unit for unit in some if unit not in found]
            found.update(zip(rest, joint(rest), strict=True))
            yield from map(found.__getitem__, some)

    return UnitEncoder(encode)


def _cut(path: str | None, most: int, kept: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path or public_tokenizers.path("byte_bpe_50k.json"))
        end = np.array([END], dtype="<u4").tobytes()
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                row, start, length, ids, total = [], [], [], [], []
                for i, body in enumerate(encoder.encode(batch.column(1).to_pylist())):
                    body += end
                    at = 0
                    for size in lengths(len(body) // 4, most):
                        row.append(i)
                        start.append(at)
                        length.append(size)
                        ids.append(body[4 * at : 4 * (at + size)])
                        total.append(len(body) // 4)
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )
        if kept is not None and len(encoder.held) > kept:
            encoder.held.clear()
            pa.default_memory_pool().release_unused()

    return run


def pack(docs: DataFrame, path: str | None = None, most: int = MOST, kept: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32 bits), doc_tokens, sequence_id, offset, bucket.

    `path`: the tokenizer's file on the workers. `bucket` is the exponent of the length. `kept`: encoded units that a
    worker may keep from task to task, where other stages need its memory too.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(_cut(path, most, kept), SCHEMA.format(kind=kind))
    return pieces.select(
        "*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        F.log2("length").cast("int").alias("bucket"),
    )
