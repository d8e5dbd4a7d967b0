"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities, maxima and numbers of lexicon entries (whole tokens and beginnings of 5 to 8 bytes,
weighted by log odds), second-person density and the share of lexicon hits near a second person, capitals,
exclamation, question and symbol rates, the rate of symbols or digits inside words (obfuscation), and length.
The lexicon, the trees and the calibration are learnt on three disjoint parts of a hash sample of at most about
`LABELLED` labelled documents, so no part judges what it was learnt from. Every document is scored whole.

Defined results: null and empty text are scored as a text without tokens; labels other than 0 and 1 and null ids
are not learnt; of several labels of one id the toxic one counts; without any label, or with labels of one class
only, every score is the share of that class (0 without labels); a null doc_id is not held out; repeated rows are
scored each for itself; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import scan

LABELLED = 8000
TREES, DEPTH, RATE, BINS, RIDGE = 80, 3, 0.15, 32, 1.0
LEAST_SEEN, LEAST_WEIGHT, LEXICON = 3, 1.5, 4000
BEGINNINGS = (5, 6, 7, 8)
NEAR = 5

# Words that address the reader, in the corpus's languages.
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer "
    "ti tú tus usted ustedes vosotros"
).split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TOKEN = _LETTER.copy()
_TOKEN[48:58] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[ord(c) for c in "0123456789@$*!|#+%&"]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>@^~_=+"]] = True


def _hash_words(words: list[str]) -> np.ndarray:
    offsets, data = scan.buffers(pa.array(words))
    starts, ends = offsets[:-1], offsets[1:]
    return np.sort(scan.word_hashes(data, starts, ends, _TOKEN))


_APART = scan.coefficients(8, 15)
_YOU = _hash_words(SECOND_PERSON)


class Tokens(NamedTuple):
    """Tokens of some rows: hash, first bytes, row, and the rows' bounds; besides, rates of each row."""

    keys: list[np.ndarray]
    row: np.ndarray
    bounds: np.ndarray
    rates: np.ndarray


def tokens(texts: pa.Array) -> Iterator[Tokens]:
    """Tokens and rates of a column, some rows at a time."""
    plain_offsets, plain = scan.buffers(texts)
    offsets, data = scan.buffers(pc.utf8_lower(texts.cast(pa.large_string())))
    for first, last in scan.rows_up_to(offsets):
        local, part = offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        starts, ends = scan.word_bounds(local, part, _TOKEN)
        row = np.searchsorted(local, starts, side="right") - 1
        keys = [scan.word_hashes(part, starts, ends, _TOKEN)]
        padded = np.concatenate([part, np.zeros(8, dtype=np.uint8)])
        begin = np.zeros(len(starts), dtype=np.uint64)
        size = ends - starts
        for j in range(8):
            begin |= np.where(size > j, padded[starts + j], 0).astype(np.uint64) << np.uint64(8 * j)
            if j + 1 in BEGINNINGS:
                # Only tokens that go on; the length keeps beginnings of different lengths apart.
                keys.append(np.where(size > j + 1, scan.mix(begin + _APART[j]), 0))
        n = last - first
        bounds = np.searchsorted(row, np.arange(n + 1))
        own, raw = plain_offsets[first : last + 1] - plain_offsets[first], plain[plain_offsets[first] : plain_offsets[last]]

        def per_row(flags: np.ndarray, cuts: np.ndarray = own) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags)])
            return (total[cuts[1:]] - total[cuts[:-1]]).astype(np.float64)

        letters = per_row(_LETTER[raw])
        length = np.maximum(np.diff(own), 1)
        hidden = np.zeros(len(raw), dtype=bool)
        if len(raw) > 2:
            hidden[1:-1] = _INSIDE[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
        count = np.maximum(np.diff(bounds), 1)
        rates = np.stack(
            [
                per_row(_UPPER[raw]) / np.maximum(letters, 1), per_row(raw == ord("!")) / length,
                per_row(raw == ord("?")) / length, per_row(_SYMBOL[raw]) / length, per_row(hidden) / count,
                np.log1p(np.diff(bounds)),
            ],
            axis=1,
        )
        yield Tokens(keys, row, bounds, rates)


class Lexicon(NamedTuple):
    """For whole tokens and each length of beginning: sorted keys and their weights."""

    keys: list[np.ndarray]
    weights: list[np.ndarray]

    def weigh(self, kind: int, keys: np.ndarray) -> np.ndarray:
        known, weight = self.keys[kind], self.weights[kind]
        if not len(known):
            return np.zeros(len(keys))
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[place] == keys, weight[place], 0.0)


def learn_lexicon(texts: pa.Array, toxic: np.ndarray) -> Lexicon:
    """Entries that toxic documents hold clearly more often, by the number of documents."""
    kinds = range(1 + len(BEGINNINGS))
    found = [(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0)) for _ in kinds]  # key, toxic, other documents
    done = 0
    for t in tokens(texts):
        n = len(t.bounds) - 1
        own_label = toxic[done : done + n]
        for kind in kinds:
            own = [np.unique(t.keys[kind][t.bounds[i] : t.bounds[i + 1]]) for i in range(n)]
            label = np.repeat(own_label, [len(k) for k in own]).astype(np.float64)
            # Counts are merged part by part, so what is held is the distinct keys and not their occurrences.
            key, inverse = np.unique(np.concatenate([found[kind][0], *own]), return_inverse=True)
            bad = np.bincount(inverse, weights=np.concatenate([found[kind][1], label]), minlength=len(key))
            good = np.bincount(inverse, weights=np.concatenate([found[kind][2], 1 - label]), minlength=len(key))
            found[kind] = key, bad, good
        done += n
    positive, negative = toxic.sum(), len(toxic) - toxic.sum()
    all_keys, all_weights = [], []
    for key, bad, good in found:
        weight = np.log((bad + 0.5) / (positive + 1)) - np.log((good + 0.5) / (negative + 1))
        use = np.flatnonzero((bad >= LEAST_SEEN) & (weight >= LEAST_WEIGHT) & (key != 0))
        use = np.sort(use[np.argsort(-(weight * bad)[use], kind="stable")[:LEXICON]])
        all_keys.append(key[use])
        all_weights.append(weight[use])
    return Lexicon(all_keys, all_weights)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One dense row per text."""
    out = []
    for t in tokens(texts):
        n, words = len(t.bounds) - 1, len(t.row)
        count = np.maximum(np.diff(t.bounds), 1)
        columns = [t.rates]
        hit = np.zeros(words, dtype=bool)
        for kind, keys in enumerate(t.keys):
            weight = lexicon.weigh(kind, keys)
            hit |= weight >= 2.5
            most = np.zeros(n)
            np.maximum.at(most, t.row[weight > 0], weight[weight > 0])
            total = np.bincount(t.row, weights=weight, minlength=n)
            number = np.bincount(t.row, weights=weight > 0, minlength=n)
            columns.append(np.stack([total / count, most, number, number / count], axis=1))
        you = np.zeros(words, dtype=bool)
        if words:
            place = np.minimum(np.searchsorted(_YOU, t.keys[0]), len(_YOU) - 1)
            you = _YOU[place] == t.keys[0]
        before = np.concatenate([[0], np.cumsum(you)])
        at = np.flatnonzero(hit)
        low, high = np.maximum(at - NEAR, t.bounds[t.row[at]]), np.minimum(at + NEAR + 1, t.bounds[t.row[at] + 1])
        near = np.bincount(t.row[at], weights=before[high] > before[low], minlength=n)
        hits = np.bincount(t.row[at], minlength=n)
        columns.append(
            np.stack(
                [np.bincount(t.row, weights=you, minlength=n) / count, near / np.maximum(hits, 1), hits, hits / count],
                axis=1,
            )
        )
        out.append(np.concatenate(columns, axis=1))
    width = 6 + 4 * (1 + len(BEGINNINGS)) + 4
    return np.concatenate(out) if out else np.zeros((0, width))


class Tree(NamedTuple):
    """A full binary tree: feature and bound of every inner node, value of every leaf."""

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            right = x[np.arange(len(x)), self.feature[node]] > self.bound[node]
            node = 2 * node + 1 + right
        return self.value[node - (2**DEPTH - 1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _grow(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> Tree:
    inner = 2**DEPTH - 1
    feature, bound = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    node = np.zeros(len(binned), dtype=np.int64)
    for here in range(inner):
        at = np.flatnonzero(node == here)
        best = 1e-6
        if len(at) > 1:
            g, h = gradient[at], hessian[at]
            whole = g.sum() ** 2 / (h.sum() + RIDGE)
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                left_g = np.cumsum(np.bincount(binned[at, f], weights=g, minlength=len(edge) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[at, f], weights=h, minlength=len(edge) + 1))[:-1]
                right_g, right_h = g.sum() - left_g, h.sum() - left_h
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - whole
                gain[(left_h < 0.5) | (right_h < 0.5)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[here], bound[here] = gain[k], f, edge[k]
        if np.isfinite(bound[here]):
            right = binned[at, feature[here]] > np.searchsorted(edges[feature[here]], bound[here])
        else:
            right = np.zeros(len(at), dtype=bool)
        node[at] = 2 * here + 1 + right
    leaf = node - inner
    g = np.bincount(leaf, weights=gradient, minlength=inner + 1)
    h = np.bincount(leaf, weights=hessian, minlength=inner + 1)
    return Tree(feature, bound, -RATE * g / (h + RIDGE))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list[Tree]]:
    """Newton boosting of the logistic loss over quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    # Mostly-zero columns still get a cut between zero and the rest.
    edges = [np.unique(np.append(e, np.quantile(c[c > e[-1]], [0, 0.25, 0.5, 0.75], method="lower")) if (c > e[-1]).any() else e)
             for e, c in zip(edges, x.T)]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    raw, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = _sigmoid(raw)
        tree = _grow(binned, edges, p - y, p * (1 - p))
        trees.append(tree)
        raw = raw + tree.predict(x)
    return base, trees


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the non-decreasing step function closest to y (pool adjacent violators)."""
    place, inverse = np.unique(raw, return_inverse=True)
    weight = np.bincount(inverse).astype(np.float64)
    mean = np.bincount(inverse, weights=y) / weight
    blocks: list[list[float]] = []  # mean, weight, first place, last place
    for m, w, p in zip(mean, weight, place):
        blocks.append([m, w, p, p])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, end = blocks.pop()
            m1, w1, begin, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, begin, end])
    x = np.array([b[k] for b in blocks for k in (2, 3)])
    v = np.array([b[0] for b in blocks for _ in (2, 3)])
    return x, v


class Model(NamedTuple):
    lexicon: Lexicon
    base: float
    trees: list[Tree]
    places: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def score(self, texts: pa.Array) -> np.ndarray:
        raw = self.raw(features(texts, self.lexicon))
        # A thousandth of the uncalibrated score keeps the order within a step.
        return np.clip(0.999 * np.interp(raw, self.places, self.values) + 0.001 * _sigmoid(raw), 0.0, 1.0)


def crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def train(texts: pa.Array, toxic: np.ndarray, part: np.ndarray) -> Model | float:
    """Lexicon from part 0, trees from part 1, calibration from part 2; a constant if there is one class only."""
    groups = [np.flatnonzero(part == k) for k in range(3)]
    if any(len(g) == 0 or len(set(toxic[g])) < 2 for g in groups):
        if len(toxic) == 0 or len(set(toxic)) < 2:
            return float(toxic.mean()) if len(toxic) else 0.0
        # Too few labels to share out: every part learns from all.
        groups = [np.arange(len(toxic))] * 3
    lexicon = learn_lexicon(texts.take(pa.array(groups[0])), toxic[groups[0]])
    base, trees = boost(features(texts.take(pa.array(groups[1])), lexicon), toxic[groups[1]].astype(np.float64))
    model = Model(lexicon, base, trees, np.zeros(0), np.zeros(0))
    raw = model.raw(features(texts.take(pa.array(groups[2])), lexicon))
    return model._replace(**dict(zip(("places", "values"), isotonic(raw, toxic[groups[2]].astype(np.float64)))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = LABELLED) -> Model | float:
    """Learn from a hash sample of about `sample` labelled rows that may be learnt from."""
    rows = (
        labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc("doc_id") % 5 != 0)
    )
    share = min(1.0, sample / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).limit(2 * sample)
    # The sample is bounded, so it is the side to broadcast; documents are read once and stay where they are.
    found = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").limit(4 * sample)
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic",
                F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)).alias("part"))
        .toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    )
    part = np.searchsorted([4, 8], found.column("part").to_numpy(), side="right")
    model = train(found.column("text").combine_chunks(), found.column("toxic").to_numpy(), part)
    del found
    pa.default_memory_pool().release_unused()  # the driver gives the sample's memory back
    return model


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            score = np.full(batch.num_rows, model) if isinstance(model, float) else model.score(texts)
            columns = [batch.column(i) for i in range(batch.num_columns)]
            names = [f"__c{i}" for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], [*names, "score"])

    return run


def score(docs: DataFrame, model: Model | float, *columns: str) -> DataFrame:
    """`columns` of every document and its score."""
    names = list(dict.fromkeys((*(columns or ("doc_id",)), "text")))
    names.append(names.pop(names.index("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(*(F.col(n).alias(f"__c{i}") for i, n in enumerate(names)))
    schema = ", ".join([*(f"__c{i} {kinds[n]}" for i, n in enumerate(names)), "score double"])
    out = rows.mapInArrow(_score(shared), schema).withColumnsRenamed({f"__c{i}": n for i, n in enumerate(names)})
    return out if "text" in columns else out.drop("text")


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(crc(column) % 5 == 0, F.lit(False))
