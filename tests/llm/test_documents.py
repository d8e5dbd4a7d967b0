"""The operators over documents against plain versions, on documents with every odd case."""

import base64
import collections
import zlib

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, language, near, packing, quality, substring, toxicity

ROWS = plain.odd_documents()


@pytest.fixture(scope="module")
def docs(spark):
    return plain.frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return plain.frame(spark, [])


def bag(rows):
    return collections.Counter(rows)


def test_quality_signals_and_base_rule(docs, none):
    got = quality.judge(docs, "doc_id").collect()
    want = []
    for name, text in ROWS:
        s = plain.signals(text)
        want.append((name, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert bag(tuple(r[n] for n in names) for r in got) == bag(want)
    assert all(r["kept"] is not None and not (r["kept"] and r["base_failed"]) for r in got)
    assert quality.judge(none, "doc_id").count() == 0


def test_quality_finds_a_kind_of_junk_that_one_rule_sees(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 97}{'abc'[k % 3]}" for k in range(40))) for i in range(200)]
    junk = [(1000 + i, " ".join(f"word{(i * 5 + k) % 89}***" for k in range(40))) for i in range(20)]
    docs = plain.frame(spark, good + junk, clash=False)
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, "doc_id").collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in junk)
    assert {r["doc_id"] for r in quality.accepted(docs).collect()} == {i for i, _ in good}


def test_quality_is_native(docs):
    for frame in (quality.signals(docs), quality.accepted(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_substring(docs, none):
    got = substring.dedupe(docs, "doc_id").collect()
    kept = plain.without_repeats([t for _, t in ROWS])
    want = [(name, n, gone, plain.sha(" ".join(k))) for (name, _), (n, gone, k) in zip(ROWS, kept)]
    assert bag((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == bag(want)
    assert all(plain.sha(r["kept_text"]) == r["kept_sha256"] for r in got)
    assert substring.dedupe(none, "doc_id").count() == 0


def test_substring_is_the_same_with_a_full_sketch(docs, monkeypatch):
    """Where the sketch holds far too few cells it filters nothing and loses nothing."""
    want = bag(tuple(r) for r in substring.dedupe(docs, "doc_id").collect())
    monkeypatch.setattr(substring, "cells_for", lambda _: 1 << 20)
    monkeypatch.setattr(substring, "repeated_cells", lambda docs, cells: np.full(2 * cells // 8, 255, np.uint8))
    monkeypatch.setattr(substring, "BROADCAST_BYTES", -1)
    assert bag(tuple(r) for r in substring.dedupe(docs, "doc_id").collect()) == want


@pytest.mark.parametrize("leaf", [128, 8])
def test_near_duplicates(docs, none, monkeypatch, leaf):
    """Also with leaves so small that nodes branch, are cut into blocks and end in tiles."""
    monkeypatch.setattr(near, "LEAF", leaf)
    monkeypatch.setattr(near, "BLOCK", leaf)
    got = near.near_duplicates(docs).collect()
    want = []
    for (name, _), (n, low) in zip(ROWS, plain.classes(ROWS)):
        low = name if low is None else low
        want.append((name, n, low, low is None if name is None else name == low))
    assert bag(tuple(r) for r in got) == bag(want)
    if leaf == 8:
        kept = bag(r["doc_id"] for r in near.one_of_each(docs).collect())
        assert kept == bag(w[0] for w in want if w[3])
    else:
        assert near.near_duplicates(none).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(bytes([i]), bytes([i + 1])) for i in range(40)]
    star = [(b"\x80", bytes([130 + i])) for i in range(60)]
    edges = spark.createDataFrame(chain + star, "a binary, b binary")
    got = {bytes(r["key"]): bytes(r["component"]) for r in near.components(edges).collect()}
    assert len(got) == 41 + 61
    assert {got[bytes([i])] for i in range(41)} == {b"\x00"}
    assert {v for k, v in got.items() if k >= b"\x80"} == {b"\x80"}


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs).collect()
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ROWS]
    pieces = []
    for (name, _), own in zip(ROWS, ids):
        at = 0
        while at < len(own):
            size = 1 << min(10, (len(own) - at).bit_length() - 1)
            pieces.append((name, at, size, np.array(own[at : at + size], dtype="<u4").tobytes(), len(own)))
            at += size
    assert bag((r["doc_id"], r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in got) == bag(pieces)
    assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    assert packing.pack(none).count() == 0
    assert packing.lengths(2051) == [1024, 1024, 2, 1] and packing.lengths(8, 4) == [4, 4]


def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(docs, none):
    encoding = tiktoken_encoding()
    want = []
    for name, text in ROWS:
        ids = encoding.encode_ordinary(text or "")
        want.append((name, len(ids), plain.sha(np.array(ids, dtype="<u4").tobytes()), plain.sha(text or "")))
    assert bag(tuple(r) for r in bpe.round_trip(docs).collect()) == bag(want)
    decoded = bpe.decode(bpe.encode(docs)).collect()
    assert bag((r[0], bytes(r[1])) for r in decoded) == bag((n, (t or "").encode()) for n, t in ROWS)
    assert bpe.round_trip(none).count() == 0


def test_units_of_odd_white_space():
    import random

    encoding, draw = tiktoken_encoding(), random.Random(3)
    _, own = bpe._texts_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["".join(draw.choice(" \n\t \x1c ab1!'.,sé漢") for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids == np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes(), repr(text)


def test_toxicity(spark, none):
    draw = np.random.default_rng(5)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1200):
        text = list(draw.choice(words, 60))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                text[draw.integers(60)] = draw.choice(["Vilemar", "vilemor!", "grubbo"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic), None))
    rows += [(None, "word1"), (5000, None), (5001, ""), (5002, "x" * 3000)]
    labels += [(None, 1, None), (5003, 1, None), (5001, None, None), (0, 0, None)]
    docs = plain.frame(spark, rows)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held"] for i in held)
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, empty)).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0


def test_isotonic_and_trees():
    x, v = toxicity.isotonic(np.array([1.0, 2.0, 3.0, 3.0]), np.array([1.0, 0.0, 1.0, 0.0]))
    assert np.allclose(np.interp([0, 1, 2, 3, 9], x, v), [0.5] * 5)
    grid = np.stack([np.arange(200) % 20, np.arange(200) // 20], axis=1).astype(float)
    base, trees = toxicity.boost(grid, (grid[:, 0] > 12).astype(float))
    raw = base + sum(t.predict(grid) for t in trees)
    assert ((raw > 0) == (grid[:, 0] > 12)).all()


def plain_lengths(samples: dict[str, list[bytes]], text: bytes) -> dict[str, float]:
    """PPM code lengths in bits, straight from the definition."""
    out = {}
    for name, known in samples.items():
        seen: dict[bytes, collections.Counter] = collections.defaultdict(collections.Counter)
        for body in known:
            body = b"   " + body
            for i in range(3, len(body)):
                for order in range(4):
                    seen[body[i - order : i]][body[i]] += 1
        bits, body = 0.0, b"   " + text
        for i in range(3, len(body)):
            chance = 1.0
            for order in (3, 2, 1, 0, -1):
                if order < 0:
                    chance /= 256
                    break
                after = seen.get(body[i - order : i])
                if not after:
                    continue
                whole = sum(after.values()) + len(after)
                if body[i] in after:
                    chance *= after[body[i]] / whole
                    break
                chance *= len(after) / whole
            bits -= np.log2(chance)
        out[name] = bits
    return out


def test_language_code_lengths_are_exact():
    samples = {"a": [b"the cat sat on the mat", b"a cat and a hat"], "b": [b"der hund und die katze", b"und der hut"]}
    which, gram = [], []
    for i, known in enumerate(samples.values()):
        for body in known:
            offsets = np.array([0, len(body)])
            w = language._windows(np.frombuffer(body, dtype=np.uint8), offsets).astype(np.int64)
            gram.append((w[0] << 24) | (w[1] << 16) | (w[2] << 8) | w[3])
            which.append(np.full(len(body), i))
    model = language.build(list(samples), np.concatenate(which), np.concatenate(gram), np.ones(sum(map(len, which)), np.int64))
    texts = [b"the hund sat", b"q", b"und die the the", b""]
    offsets = np.cumsum([0, *map(len, texts)])
    got = model.lengths(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    for row, text in zip(got, texts):
        assert np.allclose(row, list(plain_lengths(samples, text).values()), rtol=1e-5)


def test_language(spark, none):
    draw = np.random.default_rng(3)
    letters = {"xx": "abcde", "yy": "defgh", "zz": "ghiab"}
    rows = [
        (i, " ".join("".join(draw.choice(list(letters[k]), 5)) for _ in range(12)), k)
        for i, k in enumerate(list(letters) * 80)
    ]
    rows += [(None, "abcde", "xx"), (900, None, "xx"), (901, "", "yy"), (902, "12 !?", "zz"), (903, "abcab ecdab", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]]["held_out"] for r in held)
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = spark.createDataFrame([], docs.schema)
    assert language.fit(nothing) is None
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_language_of_a_text_longer_than_a_chunk(monkeypatch):
    sample = pa.array(["abcd abce " * 50])
    offsets, data = language._bytes(sample)
    w = language._windows(data, offsets).astype(np.int64)
    gram = (w[0] << 24) | (w[1] << 16) | (w[2] << 8) | w[3]
    model = language.build(["a"], np.zeros(len(gram), int), gram, np.ones(len(gram), np.int64))
    want = model.lengths(data, offsets)
    seen = []
    lengths = language.Model.lengths
    monkeypatch.setattr(language, "CHUNK", 64)
    monkeypatch.setattr(language.Model, "lengths", lambda self, d, o: seen.append(lengths(self, d, o)) or seen[-1])
    language.judge(model, sample)
    pieces = [s[0, 0] for s in seen]
    total = pieces[0] + sum(pieces[1::2]) - sum(pieces[2::2])
    assert len(seen) > 3 and np.isclose(total, want[0, 0])
