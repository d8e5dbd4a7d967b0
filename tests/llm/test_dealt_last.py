"""Vector links, collocations and whitening against plain versions, on tables with every odd case."""

import collections
import random
import re

import numpy as np
import plain
import pytest

from corpusloom.llm import collide, phrases, whiten

VECTORS = "vec_id long, embedding array<double>, label int, key string, unit string, at string, cell long, tile long, component long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2, 3) for r in rows], VECTORS).repartition(3)


def odd_vectors(width=16, seed=5):
    """Groups of near copies around the bound, exact copies, scaled copies, and every row that takes no part."""
    draw = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(6):
            centre = draw.normal(size=width)
            for _ in range(draw.integers(1, 30)):
                near = centre / np.linalg.norm(centre) + draw.normal(size=width) * draw.choice([0.02, 0.06, 0.08])
                rows.append((n, near.tolist(), label))
                n += 1
        base = draw.normal(size=width).tolist()
        rows += [(n, base, label), (n, base, label), (n + 1, base, label), (n + 2, [3 * x for x in base], label), (None, base, label)]
        n += 3
    rows += [
        (n, None, 0), (n + 1, [0.0] * width, 0), (n + 2, [float("nan")] * width, 0), (n + 3, [None] + [1.0] * (width - 1), 0),
        (n + 4, [float("inf")] + [0.0] * (width - 1), 1), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [1.0, 2.0, 0.0], 0),
        (n + 8, [1e300] * width, 1), (n + 9, [1e-300] * width, 1), (n + 10, [-0.0, 2.0] + [0.0] * (width - 2), 1),
        (n + 11, [0.0, 1.0] + [0.0] * (width - 2), 1),
    ]
    return rows


def plain_links(rows, width, cosine=collide.COSINE):
    unit = []
    for _, e, label in rows:
        good = label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e)
        v = np.zeros(width)
        if good:
            v[: len(e)] = np.array(e) / max(abs(x) for x in e)
            v /= np.linalg.norm(v)
        unit.append(v)
    unit, labels = np.array(unit), [r[2] for r in rows]
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    linked = (unit @ unit.T >= cosine - 1e-12) & same
    np.fill_diagonal(linked, False)
    low, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, at = [i], 0
        seen.add(i)
        while at < len(group):
            more = [j for j in np.flatnonzero(linked[group[at]]).tolist() if j not in seen]
            seen.update(more)
            group += more
            at += 1
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            low[j] = min(ids) if ids else None
    return collections.Counter(
        (r[0], int(linked[i].sum()), low[i], r[0] == low[i] if None not in (r[0], low[i]) else low[i] is None) for i, r in enumerate(rows)
    )


@pytest.mark.parametrize("home, ask", [(4096, 4096), (40, 30)])
def test_links(spark, home, ask):
    rows = odd_vectors()
    got = collide.link(vectors(spark, rows), home=home, ask=ask)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_links(rows, 16)


def test_links_over_cuts(spark):
    rows = odd_vectors(width=32)
    want = collections.Counter()
    for (i, n, *_), times in plain_links(rows, 32).items():
        want[i] += n * times
    got = collections.Counter()
    for r in collide.link(vectors(spark, rows), leaf=20).collect():
        got[r["vec_id"]] += r["n_links"]
    assert all(got[i] <= want[i] for i in want) and got.total() >= 0.99 * want.total()


def test_links_of_nothing(spark):
    assert collide.link(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in collide.link(vectors(spark, [(4, None, None)])).collect()] == [(4, 0, 4, True)]


def test_cuts_lose_few_pairs_at_the_bound_and_a_crowded_cell_is_many_tiles(spark):
    draw, width = np.random.default_rng(3), 64
    rows, n = [], 0
    for _ in range(400):
        a = draw.normal(size=width)
        a /= np.linalg.norm(a)
        b = draw.normal(size=width)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9301
        rows += [(n, a.tolist(), 0), (n + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 0)]
        n += 2
    # A third of all vectors are near copies of one.
    centre = draw.normal(size=width)
    centre /= np.linalg.norm(centre)
    rows += [(n + i, (centre + draw.normal(size=width) * 0.01).tolist(), 0) for i in range(400)]
    table = vectors(spark, rows)
    got = {r["vec_id"]: r for r in collide.link(table, leaf=100, home=256, ask=256).collect()}
    assert sum(got[i]["n_links"] > 0 for i in range(n)) >= 0.97 * n
    assert all(got[n + i]["n_links"] == 399 and got[n + i]["component_id"] == n for i in range(400))
    reps = spark.createDataFrame([(0, bytes([i // 256, i % 256]), True, 5) for i in range(1000)], "cell long, key binary, home boolean, x int")
    per_tile = [r["count"] for r in collide.tiles(reps, 64, 64).groupBy("tile").count().collect()]
    assert len(per_tile) > 100 and max(per_tile) < 300


def test_misses_are_calibrated():
    assert collide.misses(64, 64) == 16
    assert 10 < collide.misses(1024, 128) < 40
    axes = collide.directions(300)
    assert axes.shape == (300, collide.DIRECTIONS) and np.allclose(axes.T @ axes, np.eye(collide.DIRECTIONS))


def odd_texts(seed=9):
    draw = random.Random(seed)
    rows = [("en", None), (None, "New York, new york! NEW\tYORK  city"), ("und", "new york"), ("de", ""), ("fr", " . , ")]
    vocabulary = ["a", "bb", "ÄÖ", "ccc", "d-d", "漢字", "e e", "f\x00", "Zürich"]
    for _ in range(150):
        text = "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for _ in range(draw.randint(1, 60)))
        rows.append((draw.choice(["en", "en", "en", "de", None]), text))
    rows += [("en", "bb a ccc " * 300), ("en", "bb a ccc " * 300), ("es", "hola que tal " * 10)]
    return rows


def plain_collocations(rows, least, top):
    f, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate(plain.LOWER)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        inside = any(
            lang == other and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (other, q), b in candidates.items()
        )
        if inside:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )


def texts(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, "y", 2) for i, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n long, word string, part int").repartition(3)


# Small budgets leave many groups and extend the frequent prefixes, down to whole suffixes.
@pytest.mark.parametrize("least, top, budget", [(30, 2000, phrases.BUDGET), (2, 2000, 64), (5, 7, 8)])
def test_collocations(spark, least, top, budget):
    rows = odd_texts()
    got = phrases.collocations(texts(spark, rows), least, top, budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, least, top)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(texts(spark, [])).count() == 0
    assert phrases.collocations(texts(spark, [(None, None), ("en", "x")])).count() == 0


def test_a_long_text_is_read_in_steps():
    import pyarrow as pa

    long = "ab cd. ef " * (phrases.STEP // 2)
    got = list(phrases.words(pa.array([long, None, "x y"])))
    assert sum(len(w.row) for w in got) == 3 * (phrases.STEP // 2) + 2
    assert all(b - a <= phrases.STEP for w in got for a, b in phrases._steps(w))
    # The third word of a repetition goes on into the next one's first two, where its piece ends.
    assert got[0].room[:4].tolist() == [2, 1, 3, 2] and got[-1].room[-2:].tolist() == [2, 1]


def plain_whiten(rows, most=8):
    used = [(i, e) for i, e, *_ in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    width = max((len(e) for _, e in used), default=0)
    x = [[int(np.floor(1024 * c)) + 100000 for c in e] + [100000] * (width - len(e)) for _, e in used]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    z = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x])
    v = z.T @ z / n
    e, vectors_ = np.linalg.eigh(v)
    e, vectors_ = e[::-1], vectors_[:, ::-1]
    return used, n, deviations, z @ vectors_[:, :most], e, np.trace(v)


def test_whitening(spark):
    draw = np.random.default_rng(2)
    rows = [(i, (draw.normal(size=12) * np.arange(1, 13)).tolist(), 0) for i in range(300)]
    rows += [rows[0], (None, [0.5] * 12, 0), (400, [1.0, 2.0], 0), (401, [], 0), (402, None, 0), (403, [float("nan")] * 12, 0), (404, [None] * 12, 0)]
    got = whiten.whiten(vectors(spark, rows)).collect()
    used, n, deviations, projected, e, trace = plain_whiten(rows)
    assert len(got) == 8 * len(used) and {r["n"] for r in got} == {n}
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == collections.Counter(
        (i, d) for (i, _), d in zip(used, deviations)
    )
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by_id = {i: k for k, (i, _) in enumerate(used)}
    for c in range(8):
        some = [r for r in got if r["component"] == c + 1]
        assert all(abs(r["explained"] - e[c] / trace) < 1e-12 for r in some)
        want = np.array([projected[by_id[r["vec_id"]], c] for r in some]) / np.sqrt(e[c])
        have = np.array([r["whitened"] for r in some])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-8


def test_whitening_without_variance(spark):
    assert whiten.whiten(vectors(spark, [])).count() == 0
    assert whiten.whiten(vectors(spark, [(1, [], 0), (2, None, 0)])).count() == 0
    alone = whiten.whiten(vectors(spark, [(1, [1.0, 2.0], 0)])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [
        (1, 0, None, 0.0, None), (2, 0, None, 0.0, None)
    ]
    line = whiten.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 7.0], 0) for i in range(5)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and line[0]["identity_error"] < 1e-12


def test_eigenpairs_of_a_factor():
    draw = np.random.default_rng(4)
    for size, rank in ((1, 1), (7, 7), (20, 5)):
        z = draw.normal(size=(rank, size)) * 1000
        values, found = whiten.components(z.T @ z)
        want = np.linalg.eigvalsh(z.T @ z)[::-1][:rank]
        assert len(values) == rank and np.allclose(values, want, rtol=1e-10)
        assert np.allclose(found.T @ found, np.eye(rank), atol=1e-10)


def test_a_deviation_beyond_64_bits_is_null(spark):
    rows = [(1, [1e300, 0.0], 0), (2, [-1e300, 1.0], 0), (3, [0.0, 0.0], 0)]
    got = whiten.whiten(vectors(spark, rows)).collect()
    assert {r["vec_id"]: r["deviation"] for r in got if r["vec_id"] < 3} == {1: None, 2: None}
