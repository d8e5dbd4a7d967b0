"""Hashed text features: word, word-pair and character-trigram features and their FNV-1a buckets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from .text import SPACE, nfkc, words

# FNV-1a prime and the seeds of the bucket and sign hashes.
FNV_PRIME = 16777619
BUCKET_SEED = 2166136261
SIGN_SEED = 3339675911


def _units(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All UTF-16 code units one after the other, with each value's first unit and number of units."""
    joined = "".join(values)
    units = np.frombuffer(joined.encode("utf-16-le"), dtype="<u2").astype(np.uint64)
    if len(units) == len(joined):
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    else:
        sizes = np.array([len(v.encode("utf-16-le")) // 2 for v in values], dtype=np.int64)
    return units, np.cumsum(sizes) - sizes, sizes


def _extend(state: np.ndarray, units: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """FNV-1a continued from `state`, one vectorised step per code unit position; one long value widens no other."""
    order = np.argsort(-sizes, kind="stable")
    out, at, left = state[order], starts[order], sizes[order]
    mask, prime = np.uint64(0xFFFFFFFF), np.uint64(FNV_PRIME)
    live = len(out) - np.searchsorted(left[::-1], np.arange(int(sizes.max(initial=0))), side="right")
    for step, n in enumerate(live):
        out[:n] = ((out[:n] ^ units[at[:n] + step]) * prime) & mask
    back = np.empty_like(out)
    back[order] = out
    return back


def _fnv(values: list[str | None], seed: int) -> np.ndarray:
    """FNV-1a over UTF-16 code units."""
    return _extend(np.full(len(values), seed, dtype=np.uint64), *_units([v or "" for v in values]))


@arrow_udf(T.LongType())
def fnv1a(text: pa.Array, seed: pa.Array) -> pa.Array:
    values, seeds = text.to_pylist(), seed.to_numpy(zero_copy_only=False)
    out = np.zeros(len(values), dtype=np.int64)
    for one in np.unique(seeds):
        rows = np.flatnonzero(seeds == one)
        out[rows] = _fnv([values[r] for r in rows], int(one)).astype(np.int64)
    return pa.array(out, pa.int64())


def features(text) -> Column:
    """All features of a text, repeats included: `w:` words, `b:` word pairs, `c:` trigrams."""
    return features_of(F.lower(nfkc(text)))


def compacted(lowered) -> Column:
    return F.regexp_replace(lowered, rf"{SPACE}+", " ")


def features_of(lowered: Column) -> Column:
    tokens = words(lowered)
    compact = compacted(lowered)
    singles = F.transform(tokens, lambda w: F.concat(F.lit("w:"), w))
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b),
    )
    # A look-ahead group yields every (overlapping) trigram in one regular-expression pass.
    grams = F.regexp_extract_all(compact, F.lit(r"(?s)(?=(...))"), F.lit(1))
    trigrams = F.transform(
        F.filter(grams, lambda g: F.trim(g) != ""), lambda g: F.concat(F.lit("c:"), g)
    )
    return F.concat(singles, pairs, trigrams)


@dataclass
class Tally:
    """Distinct features of some texts in an order that depends on the features alone, and where they stand."""

    names: pa.Array
    buckets: np.ndarray  # both hashes, one each per feature
    signs: np.ndarray
    owner: np.ndarray  # text, feature and number of occurrences, one each per text and feature
    feature: np.ndarray
    tf: np.ndarray


def _runs(owner: np.ndarray, code: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Distinct codes, then per owner and code: owner, place of the code, occurrences. Codes lie below `span`."""
    if len(owner) and (int(owner.max()) + 1) * span >= 1 << 63:
        known, code = np.unique(code, return_inverse=True)
        owner, place, tf = _runs(owner, code, len(known))[1:]
        return known, owner, place, tf
    keys, tf = np.unique(owner * span + code, return_counts=True)
    owner, code = np.divmod(keys, span)
    known, place = np.unique(code, return_inverse=True)
    return known, owner, place, tf


def tally_texts(tokens: pa.Array, compact: pa.Array) -> Tally:
    """`features_of` of many texts at once, given as their word lists and as texts with single spaces."""
    flat, sizes = tokens.flatten(), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(tokens), dtype=np.int64), sizes)
    encoded = flat.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    vocabulary, rank = encoded.dictionary.take(pa.array(order)), np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    word, many = rank[encoded.indices.to_numpy()], max(1, len(order))

    singles = _runs(row, word, many)
    inside = row[:-1] == row[1:]
    pairs = _runs(row[:-1][inside], (word[:-1] * many + word[1:])[inside], many * many)
    first, second = np.divmod(pairs[0], many)

    values = [v or "" for v in compact.to_pylist()]
    points = np.frombuffer("".join(values).encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(values), dtype=np.int64), np.fromiter(map(len, values), dtype=np.int64, count=len(values)))
    letters = np.unique(points)
    place = np.zeros(int(letters.max(initial=0)) + 1, dtype=np.int64)
    place[letters] = np.arange(len(letters))
    letter, kinds = place[points], max(1, len(letters))
    inside = row[:-2] == row[2:]
    # White space stands in single spaces, so no trigram is blank.
    grams = _runs(
        row[:-2][inside], ((letter[:-2] * kinds + letter[1:-1]) * kinds + letter[2:])[inside], kinds**3
    )
    codes = np.stack([grams[0] // kinds**2, grams[0] // kinds % kinds, grams[0] % kinds], axis=1)
    text = letters[codes].astype("<u4").tobytes().decode("utf-32-le")
    texts = ["c:" + text[i : i + 3] for i in range(0, len(text), 3)]

    listed = vocabulary.to_pylist()
    spelt = ["w:" + w for w in listed]
    # A pair's hash goes on from that of its first word.
    heads, (units, starts, lengths) = ["b:" + w + "_" for w in listed], _units(listed)
    hashes = []
    for seed in (BUCKET_SEED, SIGN_SEED):
        both = _extend(_fnv(heads, seed)[first], units, starts[second], lengths[second])
        hashes.append(np.concatenate([_fnv(spelt, seed), both, _fnv(texts, seed)]).astype(np.int64))
    joined = pc.binary_join_element_wise(
        pa.array(heads, pa.string()).take(pa.array(first)), vocabulary.take(pa.array(second)), ""
    )
    names = pa.concat_arrays([pa.array(spelt, pa.string()), joined, pa.array(texts, pa.string())])
    parts, shift = (singles, pairs, grams), np.cumsum([0, len(singles[0]), len(pairs[0])])
    return Tally(
        names, *hashes, np.concatenate([p[1] for p in parts]),
        np.concatenate([p[2] + s for p, s in zip(parts, shift)]), np.concatenate([p[3] for p in parts]),
    )
