"""Segmented order-dependent work against plain replays, with one hot group over many segments."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sequences as S, sessions as P
from corpusloom.operators.collection import first_claims


def next_fit(sizes, max_items, max_chars):
    chunks, items, chars, chunk = [], 0, 0, 0
    for size in sizes:
        if items and (items >= max_items or chars + size > max_chars):
            chunk, items, chars = chunk + 1, 0, 0
        items, chars = items + 1, chars + size
        chunks.append(chunk)
    return chunks


@pytest.mark.parametrize("seed", [1, 2])
def test_pack_over_many_segments(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "SEGMENT_ROWS", 16)
    rng = random.Random(seed)
    rows, expected = [], {}
    for shard, count in [("hot", 900), ("small", 5), ("one", 1)]:
        ordinals = sorted(rng.sample(range(10_000), count))
        sizes = [rng.choice([0, 1, 5, 20, 60]) for _ in ordinals]
        rows += [(shard, o, n) for o, n in zip(ordinals, sizes)]
        expected |= {(shard, o): c for o, c in zip(ordinals, next_fit(sizes, 7, 50))}
    rng.shuffle(rows)
    got = S.pack(spark.createDataFrame(rows, "shard string, ord bigint, n int"), "shard", "ord", "n", 7, 50)
    assert {(r.shard, r.ord): r.chunk for r in got.collect()} == expected


def test_dense_positions(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT_ROWS", 8)
    rows = [("a", i * i) for i in range(100)] + [("b", 5)]
    got = S.dense_positions(spark.createDataFrame(rows, "k string, o bigint"), "k", "o").collect()
    assert {(r.k, r.o): r.position for r in got} == {**{("a", i * i): i for i in range(100)}, ("b", 5): 0}


def replay(events):
    stack, cursor, refused = [], -1, 0
    for seq, kind, target in events:
        if kind == "start":
            stack, cursor, refused = [seq], 0, 0
        elif kind == "commit":
            stack = [*stack[: cursor + 1], seq][-64:]
            cursor = len(stack) - 1
        elif target < len(stack):
            cursor = target
        else:
            refused += 1
    return stack, cursor, refused


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_sessions_over_many_segments(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "SEGMENT_ROWS", 32)
    monkeypatch.setattr(P, "SEGMENT_ROWS", 32)
    rng = random.Random(seed)
    rows, expected = [], {}
    for session, count, lead in [("hot", 700, 40), ("late", 60, 0), ("tiny", 2, 0)]:
        events = [(s, "restore", 0) for s in range(lead)]
        for seq in range(lead, count):
            kind = rng.choices(["commit", "restore", "start"], [8, 2, 0.02])[0]
            events.append((seq, kind, rng.randrange(0, 80)))
        expected[session] = replay(events)
        rows += [(session, s, k, t, [f"f{rng.randrange(50)}"], 10) for s, k, t in events]
    rng.shuffle(rows)
    schema = "session_id string, seq bigint, kind string, target bigint, film_ids array<string>, size int"
    got = P.reduce_sessions(spark.createDataFrame(rows, schema)).collect()
    assert {r.session_id: (r.snapshots, r.cursor, r.refused) for r in got} == expected
    for r in got:
        start = max([s for n, s, k, *_ in rows if n == r.session_id and k == "start"], default=-1)
        seen = {f for n, s, k, _, fs, _ in rows if n == r.session_id and s >= start and k != "restore" for f in fs}
        assert r.seen == len(seen)


def test_session_film_limit(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_SEEN", 6)
    rows = [("s", i, "commit", 0, [f"f{i}a", f"f{i}b"], 10) for i in range(5)]
    schema = "session_id string, seq bigint, kind string, target bigint, film_ids array<string>, size int"
    row = P.reduce_sessions(spark.createDataFrame(rows, schema)).first()
    assert (row.status, row.seen, row.snapshots) == ("film_limit", 10, [0, 1, 2, 3, 4])


def test_archived_films_survive_branching(spark):
    events = [(0, "start", 0, ["a"]), (1, "commit", 0, ["b"]), (2, "restore", 0, []), (3, "commit", 0, ["c"])]
    rows = [("s", s, k, t, f, 10) for s, k, t, f in events]
    schema = "session_id string, seq bigint, kind string, target bigint, film_ids array<string>, size int"
    row = P.reduce_sessions(spark.createDataFrame(rows, schema)).first()
    assert (row.snapshots, row.cursor, row.seen, row.archived) == ([0, 3], 1, 3, 1)


def claims_in_order(targets):
    taken, accepted = set(), set()
    for ordinal, urls in sorted(targets.items()):
        if not taken & set(urls):
            accepted.add(ordinal)
            taken |= set(urls)
    return accepted


def test_first_claims_follow_chains(spark):
    targets = {0: ["a", "b"], 1: ["b", "c"], 2: ["c", "d"], 3: ["d", "e"], 4: ["x"], 5: ["x", "y"], 6: ["y"]}
    rng = random.Random(9)
    targets |= {10 + i: rng.sample([f"u{n}" for n in range(30)], 2) for i in range(60)}
    rows = [(o, u) for o, urls in targets.items() for u in urls]
    got = first_claims(spark.createDataFrame(rows, "ordinal bigint, url string"))
    assert {r.ordinal for r in got.collect()} == claims_in_order(targets)
    # The chain 0-1-2-3: a rejected target claims nothing, so 2 is accepted although it shares c with 1.
    assert {0, 2, 4, 6} <= claims_in_order(targets)


def test_reassemble_rows(spark):
    text = '{"v":"lens","r":[{"t":"A \\"x\\"","y":1990,"d":"D"},{"t":"B","y":1,"d":"D"},{"t":"C","y":2000,"d":"E","z":{"q":[1]}},{"t":"tru'
    deltas = [("r1", i, text[i : i + 3], "delta") for i in range(0, len(text), 3)]
    deltas += [("r2", i, c, "delta") for i, c in enumerate('{"r":[{"t":"Z","y":1999,"d":"Q"}]}')] + [("r2", 900, None, "completed")]
    random.Random(1).shuffle(deltas)
    proposals, statuses = S.reassemble_rows(spark.createDataFrame(deltas, "request_id string, seq int, delta string, event string"))
    assert {r.request_id: r.status for r in statuses.collect()} == {"r1": "INCOMPLETE", "r2": "COMPLETE"}
    rows = sorted((r.request_id, r.position, r.t, r.y) for r in proposals.collect())
    assert rows == [("r1", 0, 'A "x"', 1990), ("r1", 1, "C", 2000), ("r2", 0, "Z", 1999)]


def test_a_hot_response_is_many_parts(spark):
    row = [{"t": f"T{i}, \\ [{{\"", "y": 1900 + i % 100, "d": "D" * (i % 7)} for i in range(3000)]
    text = json.dumps({"v": "x", "s": {"r": [{"t": "no", "y": 1990, "d": "no"}]}, "r": row})
    deltas = [("hot", i, text[i * 9 : i * 9 + 9], "delta") for i in range(len(text) // 9 + 1)]
    deltas += [(f"r{n}", i, c, "delta") for n in range(40) for i, c in enumerate(json.dumps({"r": row[n : n + 3]}))]
    proposals, _ = S.reassemble_rows(spark.createDataFrame(deltas, "request_id string, seq bigint, delta string, event string").repartition(8))
    got = {}
    for r in proposals.orderBy("position").collect():
        got.setdefault(r.request_id, []).append((r.t, r.y, r.d))
    want = {n: [(r["t"], r["y"], r["d"]) for r in rows if r["d"]] for n, rows in [("hot", row), *((f"r{n}", row[n : n + 3]) for n in range(40))]}
    assert got == want


def test_reassemble_parts_are_the_whole(spark):
    rows = [("c", i, f"<{i}>") for i in range(200)]
    parts = S.reassemble(spark.createDataFrame(rows, "g string, o int, t string").orderBy(F.rand(1)), "g", "o", "t").orderBy("part").collect()
    assert "".join(p.text for p in parts) == "".join(t for _, _, t in rows) and max(p.rows for p in parts) == 64
