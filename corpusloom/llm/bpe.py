"""Byte-level BPE by matching instead of merging.

All tokens' bytes, mapped to Latin-1, are one Aho-Corasick automaton that finds every token inside a piece in one
pass. From the left the longest token is taken that is compatible with the one before it; where none is, the last
one is taken back and the next shorter tried, and a place that led nowhere is not entered again. Two tokens are
compatible if merging their joined bytes by rank gives just these two, which is remembered by pair. A sequence
whose neighbours are all compatible is the one that merging yields, so the ids are exact; each place is left
at most once for every token that starts there, so the time is linear in the piece.

Defined results: null and empty text have no ids and decode to no bytes; repeated rows are encoded each for itself;
null doc_ids are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .pieces import UnitEncoder

# Pairs of tokens, and pieces, held at most in a worker.
HELD_PAIRS, HELD_PIECES = 1_000_000, 800_000


class Encoder:
    """Encodes single matches of the pattern by the ranks of a tiktoken file."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {rank: body for body, rank in self.ranks.items()}
        self.size = {rank: len(body) for rank, body in self.token.items()}
        self.found = ahocorasick.Automaton()
        for body, rank in self.ranks.items():
            self.found.add_word(body.decode("latin-1"), (rank, len(body)))
        self.found.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, body: bytes) -> list[int]:
        """Plain merging by rank, for the joined bytes of two tokens."""
        parts = [body[i : i + 1] for i in range(len(body))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= HELD_PAIRS:
                self.pairs.clear()
            known = self.merge(self.token[left] + self.token[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def encode_bytes(self, body: bytes) -> list[int]:
        whole = self.ranks.get(body)
        if whole is not None:
            return [whole]
        n = len(body)
        starting: list[list[int]] = [[] for _ in range(n)]  # tokens by start, shortest first
        for end, (rank, size) in self.found.iter(body.decode("latin-1")):
            starting[end - size + 1].append(rank)
        out: list[int] = []
        untried: list[int] = [len(starting[0])]  # for each place on the way, how many tokens are left there
        closed = bytearray(n + 1)
        at = 0
        while at < n:
            k = untried[-1] - 1
            while k >= 0:
                rank = starting[at][k]
                if not closed[at + self.size[rank]] and (not out or self.compatible(out[-1], rank)):
                    break
                k -= 1
            untried[-1] = k
            if k >= 0:
                out.append(rank)
                at += self.size[rank]
                untried.append(len(starting[at]) if at < n else 0)
            else:
                closed[at] = 1
                untried.pop()
                at -= self.size[out.pop()]
        return out

    def encode_piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = np.array(self.encode_bytes(piece.encode()), dtype="<u4").tobytes()
            if len(piece) <= 48:
                if len(self.pieces) >= HELD_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found


@functools.lru_cache(maxsize=1)  # kept by the worker from task to task
def _texts_encoder(path: str, pattern: str) -> tuple[Encoder, UnitEncoder]:
    import regex

    encoder = Encoder(path)
    # The pattern's \s is Unicode's White_Space.
    split = regex.compile(pattern).findall

    def units(wanted: list[str]) -> Iterator[bytes]:
        for unit in wanted:
            yield b"".join(map(encoder.encode_piece, split(unit)))

    return encoder, UnitEncoder(units)


class Decoder:
    """Bytes of ids by one gather from the joined bytes of all tokens."""

    def __init__(self, token: dict[int, bytes]):
        top = max(token) + 1
        self.size = np.zeros(top, dtype=np.int64)
        for rank, body in token.items():
            self.size[rank] = len(body)
        self.start = np.cumsum(self.size) - self.size
        self.joined = np.frombuffer(b"".join(token.get(r, b"") for r in range(top)), dtype=np.uint8)

    def decode(self, ids: bytes) -> Iterator[bytes]:
        every = np.frombuffer(ids, dtype="<u4")
        for i in range(0, len(every), 1 << 18):
            some = every[i : i + (1 << 18)]
            size = self.size[some]
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(self.start[some] - (ends - size), size)
            yield self.joined[place].tobytes()


def _encode(path: str | None, pattern: str | None, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, texts = _texts_encoder(
            path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
        )
        decoder = Decoder(encoder.token) if digests else None
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                ids = texts.encode(batch.column(1).to_pylist())
                if not digests:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                    continue
                decoded = []
                for body in ids:
                    digest = hashlib.sha256()
                    for part in decoder.decode(body) if body else ():
                        digest.update(part)
                    decoded.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()),
                        pa.array([hashlib.sha256(b).hexdigest() for b in ids]), pa.array(decoded),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Encoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken")).token)
        for batch in batches:
            bodies = [b"".join(decoder.decode(b)) if b else b"" for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], ["doc_id", "decoded"])

    return run


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian 32 bits) of every text; `path` is the ranks' file on the workers."""
    return docs.select("doc_id", "text").mapInArrow(_encode(path, pattern, False), f"doc_id {_kind(docs)}, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes of `ids`."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), f"doc_id {_kind(encoded)}, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Number and digest of every text's ids, and the digest of the bytes that these ids decode to."""
    schema = f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_encode(path, pattern, True), schema)
