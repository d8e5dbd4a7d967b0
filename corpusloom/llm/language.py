"""Language identification by prediction by partial matching.

Every language has a byte context tree of order `ORDER`: how often each byte followed each context of three, two,
one and no bytes. A byte seen n times of N after a context with d different followers has probability n / (N + d),
a byte not seen there costs the escape d / (N + d) and is predicted from the context one byte shorter, at last as one
of 256; an unseen context costs nothing and passes on. A text's code length under the frozen counts of a language
is exact for its whole length; the shortest code wins, and the score is its posterior with equal priors.

The counts come from a sample bounded by `SAMPLE` documents a language (chosen by a hash); all other work covers
every document. Bytes beyond the `SYMBOLS` most frequent share one symbol, and contexts of three bytes beyond the
`CONTEXTS` most frequent are predicted from two, so the broadcast model is bounded:
4 * languages * SYMBOLS * (CONTEXTS + SYMBOLS ** 2) bytes at most. Texts are lower-cased.

Defined results: null text and text without a letter are `und` with score 0, as is everything if nothing could be
learnt; ties go to the language first in binary order; a null doc_id is neither learnt from nor held out; null
languages are not learnt; repeated rows are judged each for itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import scan

ORDER = 3
SAMPLE, SYMBOLS, CONTEXTS = 2000, 128, 16384
CHUNK = 1 << 20
UNKNOWN = "und"


def crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return scan.buffers(pc.utf8_lower(column))


def _windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER bytes before every byte and itself, of every row; spaces stand before a row's first byte."""
    n = len(data)
    out = np.full((ORDER + 1, n), 32, dtype=np.uint8)
    if n == 0:
        return out
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    out[ORDER] = data
    for back in range(1, ORDER + 1):
        known = place[back:] >= back
        out[ORDER - back, back:][known] = data[:-back][known]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), dtype=object)
        for language in sorted(set(languages)):
            texts = batch.column(1).filter(pa.array(languages == language))
            offsets, data = _bytes(texts)
            for first, last in scan.rows_up_to(offsets, 4 * CHUNK):
                w = _windows(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                w = w.astype(np.int64)
                gram, n = np.unique((w[0] << 24) | (w[1] << 16) | (w[2] << 8) | w[3], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )


class Model(NamedTuple):
    """`symbol` maps bytes; `context` maps three symbols to a row of `bits`, or -1; `bits` holds code lengths."""

    languages: list[str]
    symbol: np.ndarray
    symbols: int
    context: np.ndarray
    bits: np.ndarray
    contexts: int

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of every row under every language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        s = self.symbols
        w = self.symbol[_windows(data, offsets)]
        two = w[1] * s + w[2]
        node = self.context[w[0] * (s * s) + two]
        row = np.where(node >= 0, node * s + w[3], self.contexts * s + two * s + w[3])
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(self.bits[row], offsets[full], axis=0, dtype=np.float64)
        return out


def build(languages: list[str], language: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The frozen trees of the counts (language index, four bytes, times)."""
    split = [(gram >> shift) & 255 for shift in (24, 16, 8, 0)]
    often = np.bincount(split[3], weights=n, minlength=256)
    known = [b for b in np.argsort(-often, kind="stable") if often[b] > 0][: SYMBOLS - 1]
    symbol = np.zeros(256, dtype=np.int64)
    symbol[known] = np.arange(1, len(known) + 1)
    s = len(known) + 1
    a, b, c, d = (symbol[x] for x in split)
    three = (a * s + b) * s + c
    total = np.bincount(three, weights=n, minlength=s**3)
    kept = np.argsort(-total, kind="stable")[:CONTEXTS]
    kept = kept[total[kept] > 0]
    context = np.full(s**3, -1, dtype=np.int64)
    context[kept] = np.arange(len(kept))
    bits = np.empty((len(kept) * s + s**3, len(languages)), dtype=np.float32)
    for i in range(len(languages)):
        own = language == i
        weight = n[own].astype(np.float64)

        def level(code: np.ndarray, contexts: int, below: np.ndarray) -> np.ndarray:
            """Probabilities (context, symbol) from counts of `code` and the shorter context's probabilities."""
            count = np.bincount(code, weights=weight, minlength=contexts * s).reshape(contexts, s)
            sum_, different = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            whole = sum_ + different
            with np.errstate(invalid="ignore", divide="ignore"):
                seen = np.where(count > 0, count / whole, different / whole * below)
            return np.where(sum_ > 0, seen, below)

        a_, b_, c_, d_ = a[own], b[own], c[own], d[own]
        p = np.full((1, s), 1 / 256)
        p = level(d_, 1, p)
        p = level(c_ * s + d_, s, np.broadcast_to(p, (s, s)))
        p2 = level((b_ * s + c_) * s + d_, s * s, np.tile(p, (s, 1)))
        node = context[three[own]]
        weight, rest = weight[node >= 0], node[node >= 0] * s + d_[node >= 0]
        p3 = level(rest, len(kept), p2[kept % (s * s)])
        bits[: len(kept) * s, i] = -np.log2(p3).ravel()
        bits[len(kept) * s :, i] = -np.log2(p2).ravel()
    return Model(languages, symbol, s, context, bits, len(kept))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from a hash sample of about `sample` documents of every language, of those that may be learnt from."""
    rows = docs.where((crc("doc_id") % 4 != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return None
    share = F.create_map(*(x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    chosen = rows.where(drawn).select("lang", "text").limit(2 * sample * len(counts))
    found = (
        chosen.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .toArrow()
    )
    if found.num_rows == 0:
        return None
    names = sorted(set(found.column("lang").to_pylist()))
    which = pc.index_in(found.column("lang"), pa.array(names)).to_numpy()
    return build(names, which, found.column("gram").to_numpy(), found.column("n").to_numpy())


def judge(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    answers, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return answers, scores
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    offsets, data = _bytes(texts)
    # A row longer than a chunk is summed piece by piece, each with the three bytes before it.
    total = np.zeros((len(texts), len(model.languages)))
    for first, last in scan.rows_up_to(offsets, CHUNK):
        low, high = offsets[first], offsets[last]
        if high - low <= 2 * CHUNK:
            total[first:last] = model.lengths(data[low:high], offsets[first : last + 1] - low)
            continue
        for at in range(low, high, CHUNK):
            lead = min(ORDER, at - low)
            piece = data[at - lead : min(high, at + CHUNK)]
            total[first] += model.lengths(piece, np.array([0, len(piece)]))[0]
            if lead:
                total[first] -= model.lengths(piece[:lead], np.array([0, lead]))[0]
    nats = -total * np.log(2)
    best = nats.argmax(1)
    scores[:] = 1 / np.exp(nats - nats.max(1, keepdims=True)).sum(1)
    scores[~letters] = 0.0
    for i in np.flatnonzero(letters):
        answers[i] = model.languages[best[i]]
    return answers, scores


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            answers, scores = judge(shared.value, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(answers, pa.string()), pa.array(scores)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(crc("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
