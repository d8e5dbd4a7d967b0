"""Vectors, containment, entities and rankings against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lexical as L, containment as C, entities as E, ranking as R, retrieval as G, vectors as V
from corpusloom.operators.search import search_entities


def brute_neighbours(vectors, count, floor):
    out = {}
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in vectors.items()}
    for i, v in unit.items():
        scored = sorted((-float(v @ w), j) for j, w in unit.items() if j != i)
        out[i] = [j for s, j in scored if -s >= floor][:count]
    return out


def test_blocks_that_pivots_keep_apart_are_skipped(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    vectors = {i: (centres[i % 40] / np.linalg.norm(centres[i % 40]) + rng.normal(size=24) * 0.03).tolist() for i in range(1_200)}
    frame = spark.createDataFrame(list(vectors.items()), "id int, vector array<double>").repartition(4)
    got = {}
    for e in V.nearest_neighbours(frame, 5, 0.9, method="exact").collect():
        got.setdefault(e.src, {})[e.place] = e.dst
    assert {i: [p[k] for k in sorted(p)] for i, p in got.items()} == {i: b for i, b in brute_neighbours(vectors, 5, 0.9).items() if b}
    unit = frame.select("id", V.l2_normalize("vector").alias("vector"))
    blocks = V.cut(V.pivot_blocks(unit, 20))
    many = blocks.select("block").distinct().count()
    kept = V.near_blocks(blocks, 0.9)
    pairs = {(r.a, r.b) for r in kept.collect()}
    assert many >= 40 and len(pairs) < many * many / 3
    # No pair above the floor lies in skipped blocks.
    home = {r["id"]: r.block for r in blocks.select("id", "block").collect()}
    assert all((home[i], home[j]) in pairs for i, b in brute_neighbours(vectors, 60, 0.9).items() for j in b)


def test_half_signatures_meet_all_pairs_one_bit_apart(spark):
    rows = spark.createDataFrame([(i, 0, i) for i in range(64)], "id int, band int, bits int").withColumn("vector", F.array(F.lit(1.0)))
    halves = V.half_signatures(rows, 6)
    assert halves.count() == 2 * 64
    met = halves.select("bucket", F.col("id").alias("a")).join(halves.select("bucket", F.col("id").alias("b")), "bucket").select("a", "b").distinct().collect()
    assert {(a, a ^ (1 << k)) for a in range(64) for k in range(6)} <= {(r.a, r.b) for r in met}


@pytest.mark.parametrize("bits", [8, 12])
def test_recall_of_buckets(spark, bits):
    rng = np.random.default_rng(16)
    base = rng.normal(size=(100, 32))
    vectors = {i: (base[i % 100] + rng.normal(size=32) * 0.15).tolist() for i in range(600)}
    frame = spark.createDataFrame(list(vectors.items()), "id int, vector array<double>")
    got = {(e.src, e.dst) for e in V.nearest_neighbours(frame, 5, 0.48, method="buckets", bits=bits).collect()}
    wanted = {(i, j) for i, b in brute_neighbours(vectors, 5, 0.48).items() for j in b}
    assert len(got & wanted) >= 0.9 * len(wanted)



@pytest.mark.parametrize("tile", [7, 2048])
def test_neighbours_with_a_hot_group_of_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(V, "TILE_ROWS", tile)
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=6).round(3).tolist() for i in range(60)}
    vectors |= {100 + i: [1.0, 2.0, 0.0, 0.0, 1.0, 0.0] for i in range(40)}
    vectors[500] = [0.0] * 6
    frame = spark.createDataFrame(list(vectors.items()), "id bigint, vector array<double>")
    edges = V.nearest_neighbours(frame, 5, 0.48, method="exact").collect()
    got = {}
    for e in sorted(edges, key=lambda e: (e.src, e.place)):
        got.setdefault(e.src, []).append(e.dst)
    expected = {i: n for i, n in brute_neighbours(vectors, 5, 0.48).items() if n}
    # Copies have one score; float noise of the brute force must not reorder them.
    assert {i: sorted(n) if i < 100 else n for i, n in got.items()}.keys() == expected.keys()
    assert got[100] == [101, 102, 103, 104, 105] and got[139] == [100, 101, 102, 103, 104]
    assert all(len(got[i]) == len(expected[i]) for i in expected) and 500 not in got


def test_bucket_candidates_follow_the_definition(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    rows = {i: (base[i // 4] + 0.2 * rng.normal(size=16)).tolist() for i in range(160)}
    frame = spark.createDataFrame(list(rows.items()), "id bigint, vector array<double>")
    got = {(e.src, e.dst) for e in V.nearest_neighbours(frame, 200, 0.48, method="buckets").collect()}
    normals = V.planes(16)
    bits = {i: [int(b) for b in ((np.array(v) @ normals.T >= 0).reshape(4, 12) * (1 << np.arange(12))).sum(axis=1)] for i, v in rows.items()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows.items()}
    expected = {
        (i, j) for i in rows for j in rows
        if i != j and float(unit[i] @ unit[j]) >= 0.48 and any((a ^ b).bit_count() <= 1 for a, b in zip(bits[i], bits[j]))
    }
    assert got == expected
    exact = {(e.src, e.dst) for e in V.nearest_neighbours(frame, 200, 0.48, method="exact").collect()}
    assert got <= exact and len(got) >= 0.5 * len(exact)


def test_planes_are_the_seeded_sequence():
    first = V.planes(4).ravel()[:2]
    state = 3719
    for expected in first:
        for shift, left in [(13, True), (17, False), (5, True)]:
            state ^= ((state << shift) & 0xFFFFFFFF) if left else (state >> shift)
        assert math.isclose(expected, state / 2**32 - 0.5)


def test_hashed_vectors_normalise(spark):
    rows = spark.createDataFrame([(1, "light and shadow"), (2, "light and shadow"), (3, "zzz")], "id int, text string")
    dense = V.densify(V.hashed_tfidf(rows)).withColumn("vector", V.l2_normalize("vector"))
    got = {r.id: np.array(r.vector) for r in dense.collect()}
    assert all(len(v) == 512 and math.isclose(np.linalg.norm(v), 1) for v in got.values()) and np.allclose(got[1], got[2])


def test_valid_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, float("nan")]), (4, [1.0, float("inf")]), (5, None), (6, [1.0, None])]
    frame = spark.createDataFrame(rows, "id int, v array<double>").select("id", V.valid_vector("v", 2).alias("ok"))
    assert {r.id for r in frame.where("ok").collect()} == {1}


def test_quotes_found_without_known_source(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=120))) for i in range(40)]
    quotes = [(0, texts[3][1][10:90]), (1, texts[7][1][:40]), (2, "word1 word2"), (3, "ord1"), (4, "absent words here are none"), (5, " "), (6, "word3  word4\nword5")]
    got = C.locate_quotes(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(texts, "doc_id int, text string")).collect()
    normal = {q: " ".join(t.split()) for q, t in quotes}
    expected = {(q, d) for q, t in quotes for d, text in texts if normal[q] and normal[q] in " ".join(text.split())}
    assert {(r.quote_id, r.doc_id) for r in got} == expected
    for r in got:
        exact = dict(quotes)[r.quote_id] in dict(texts)[r.doc_id]
        assert r.match_mode == ("exact" if exact else "typography_normalized")


def test_known_source_audit(spark):
    quotes = [("d1", "p1", "the “light”"), ("d1", "p2", "light the"), ("d2", "p1", "x"), ("d3", "p1", "same line")]
    texts = [("d1", 'see the "light" now', True), ("d2", "x", False), ("d3", "the same\nline", True)]
    verified = C.verify_quotes(
        spark.createDataFrame(quotes, "doc_id string, passage_id string, quote string"),
        spark.createDataFrame(texts, "doc_id string, text string, readable boolean"),
    )
    status = {(r.doc_id, r.passage_id): (r.status, r.match_mode) for r in verified.collect()}
    assert status == {
        ("d1", "p1"): ("matched", "typography_normalized"), ("d1", "p2"): ("quote_missing", None),
        ("d2", "p1"): ("not_checked", None), ("d3", "p1"): ("matched", "typography_normalized"),
    }
    assert {r.doc_id: r.status for r in C.audit_documents(verified).collect()} == {"d1": "quote_missing", "d2": "not_checked", "d3": "matched"}


def test_search_shows_first_hits_of_repeated_texts(spark):
    entities = [(i, "amberwindow1980") for i in range(50)] + [(7, "blueorchard"), (100, "orchardamber")]
    frame = spark.createDataFrame(entities, "entity_id int, text string")
    got = search_entities(spark.createDataFrame([("Amber",), ("or-ch",), ("",)], "query string"), frame).collect()
    shown = {}
    for r in sorted(got, key=lambda r: r.place):
        shown.setdefault(r["query"], []).append(r.entity_id)
    assert shown["Amber"] == [0, 1, 2, 3, 4, 5] and shown["or-ch"] == [7, 100]


MENTION = "mention_id string, title string, aliases array<string>, year int, director string"
ALIAS = "key string, alias string, year int, director string"


def test_merging_does_not_depend_on_order(spark):
    mentions = [
        ("m1", "Amber", ["Bernstein"], 1980, "Anne"), ("m2", "Bernstein", ["Ambre"], 1980, "ANNE"), ("m3", "Ambre", [], 1980, "Anne"),
        ("m4", "Ambre", [], 1981, "Anne"), ("m5", "Known", [], 1990, "Béla"), ("m6", "Known", ["Other"], 1990, "Bela"),
        ("m7", "Loose", ["One", "Two"], 2000, "C"),
    ]
    registry = [("k1", "known", 1990, "bela"), ("k2", "one", 2000, "c"), ("k3", "two", 2000, "c")]
    for seed in (1, 2):
        frame = spark.createDataFrame(mentions, MENTION).orderBy(F.rand(seed)).repartition(seed + 1)
        got = {r.mention_id: (r.status, r.key) for r in E.merge_entities(frame, spark.createDataFrame(registry, ALIAS)).collect()}
        assert got["m1"] == got["m2"] == got["m3"] != got["m4"] and got["m1"][0] == "new"
        assert got["m5"] == got["m6"] == ("existing", "k1") and got["m7"] == ("quarantined", None)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(f"n{i:03}", f"h{i}") for i in range(70)] + [(f"n{i:03}", f"h{i - 1}") for i in range(1, 70)]
    edges += [(f"z{i:03}", "hub") for i in range(200)]
    labels = {r.node: r.label for r in E.components(spark.createDataFrame(edges, "node string, hub string")).collect()}
    assert {labels[f"n{i:03}"] for i in range(70)} == {"n000"} and {labels[f"z{i:03}"] for i in range(200)} == {"z000"}


def test_resolution_statuses_and_conflicts(spark):
    mentions = spark.createDataFrame([("a", "Amber", ["X"], 1980, "Anne"), ("b", "Nothing", [], 1980, "Anne"), ("c", "Amber", ["Both"], 1980, "Anne")], MENTION)
    aliases = spark.createDataFrame([("k1", "amber", 1980, "anne"), ("k2", "both", 1980, "anne")], ALIAS)
    got = {r.mention_id: r.status for r in E.resolve_mentions(mentions, aliases).collect()}
    assert got == {"a": "existing", "b": "new", "c": "ambiguous"}
    ids = spark.createDataFrame([("k", "tmdb", "1"), ("k", "tmdb", "2"), ("k", "wd", "Q1"), ("k", "wd", "Q1")], "key string, provider string, id string")
    assert {r.provider: r.conflict for r in E.merge_external_ids(ids).collect()} == {"tmdb": True, "wd": False}
    known = spark.createDataFrame([("sk", "k1", 1980, "anne", ["amber"])], "source_key string, key string, year int, director string, aliases array<string>")
    keyed = mentions.withColumn("source_key", F.lit("sk"))
    assert {(r.mention_id, r.reason) for r in E.record_key_violations(keyed, known).collect()} == {("b", "title")}


def test_registry_violations(spark):
    schema = "key string, title string, aliases array<string>, year int, director string"
    old = spark.createDataFrame([("k1", "Amber", ["A"], 1980, "Anne"), ("k2", "Blue", [], 1990, "Bela")], schema)
    new = spark.createDataFrame([("k1", "Amber", ["A"], 1980, "ANNE"), ("k2", "Blue", [], 1991, "Bela"), ("k3", "A", [], 1980, "Anne")], schema)
    got = {(r.key, r.reason) for r in E.registry_violations(new, old).collect()}
    assert got == {("k2", "identity"), ("k1", "ambiguous_alias")}


def test_authority_first_and_homonyms(spark):
    film = "film_id string, title string, year int, director string, authority_ids array<string>, aliases array<string>"
    entity = "key string, title string, year int, director string, external_ids array<string>, aliases array<string>"
    entities = [
        ("a", "The Amber", 1980, "Mara Linden", ["wd:Q1"], []), ("b", "The Amber", 1990, "Mara Linden", [], []),
        ("c", "Same", 2000, "Clara", [], []), ("d", "Same", 2001, "Clara", [], []),
    ]
    films = [
        ("f1", "Wrong title", 1700, "", ["wd:Q1"], []), ("f2", "the amber!", 1991, "Linden Mara", [], []), ("f3", "Same", 2000, "Clara", [], []),
        ("f4", "Same", 1999, "Clara", [], []), ("f5", "The Amber", 1980, "", [], []),
    ]
    got = {r.film_id: (r.key, r.via) for r in E.match_by_authority(spark.createDataFrame(films, film), spark.createDataFrame(entities, entity)).collect()}
    assert got == {"f1": ("a", "authority"), "f2": ("b", "alias"), "f4": ("c", "alias")}


def test_credit_predicates(spark):
    cases = [("A One & B Two", "two b, one a", True), ("A One", "B Two; One A", True), ("A One, B Two", "A One, C Three", False), ("", "A", False), ("Élan", "elan", True)]
    frame = spark.createDataFrame(cases, "a string, b string, ok boolean").select("ok", E.credits_agree("a", "b").alias("got"))
    assert all(r.ok == r.got for r in frame.collect())
    left = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(cases)], "left_id int, credit string")
    right = spark.createDataFrame([(i, b) for i, (_, b, _) in enumerate(cases)], "right_id int, credit string")
    counts = {r.left_id: r.matches for r in E.credit_matches(left, right).collect()}
    pairs = left.crossJoin(right.withColumnRenamed("credit", "other")).where(E.credits_agree("credit", "other"))
    assert counts == {r.left_id: r["count"] for r in pairs.groupBy("left_id").count().collect()}
    loose = spark.createDataFrame([(None, "x y"), ("Li Wu", "wu"), ("Jane Campion", "campion j")], "a string, b string")
    assert [r.ok for r in loose.select(E.tokens_agree("a", "b").alias("ok")).collect()] == [True, False, True]


def test_context_budgets(spark):
    hits = [("r", f"d{d:02}:o{o}", 20.0 if o == 0 and d < 3 else 5.0 - d / 100, f"f{d % 3}", o == 0 and d < 3) for d in range(30) for o in range(5)]
    merged = G.merge_hits(spark.createDataFrame(hits, "request_id string, passage_id string, score double, anchor string, direct boolean"))
    sized = G.ranked_hits(merged).withColumn("doc_id", F.split("passage_id", ":")[0]).withColumn("size", F.lit(900))
    for repeat in (1, 3):
        chosen = G.select_context(sized.repartition(repeat)).collect()
        docs = [r.doc_id for r in chosen]
        assert len(chosen) == 16 and max(docs.count(d) for d in docs) <= 2 and sum(r["size"] for r in chosen) <= 15_000
        assert {"d00:o0", "d01:o0", "d02:o0"} <= {r.passage_id for r in chosen}
    assert len(G.select_context(sized.withColumn("size", F.lit(6_000))).collect()) == 2


def test_stale_graph_and_floor(spark):
    direct = spark.createDataFrame([("r", "a", "f")], "request_id string, passage_id string, anchor string")
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.47)], "src string, dst string, score double")
    assert [(r.passage_id, r.score) for r in G.expand_neighbours(direct, edges).collect()] == [("b", 3.0)]


def test_rerank_breaks_up_similar_rows(spark):
    schema = "request_id int, candidate string, relevance double, director string, country string, year int, genres array<string>, seen boolean"
    rows = [(1, "a", 1.0, "X", "FR", 1980, ["g"], False), (1, "b", 1.0, "X", "FR", 1985, ["g"], False), (1, "c", 1.0, "Y", "JP", 1960, ["h"], False)]
    order = [r.candidate for r in R.diversity_rerank(spark.createDataFrame(rows, schema)).orderBy("position").collect()]
    assert order == ["a", "c", "b"]


def test_weights_and_sources(spark, one):
    context = spark.createDataFrame([("r", f) for f in "abcda"], "request_id string, film_id string")
    assert {r.weight for r in R.context_weights(context).collect()} == {0.25}
    got = one(R.topped_up(F.array(F.lit("s1")), F.array(*[F.lit(f"s{i}") for i in range(1, 6)])), "a string")
    assert got == ["s1", "s2", "s3"]


def test_hot_keys_of_joins_with_aggregates_are_split(spark):
    from corpusloom.operators.collection import first_content

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text_hash"))
        out = first_content(rows)
        assert out.where("status = 'duplicate_content'").count() == 19_999
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_coverage_counts_films_without_passages(spark):
    selected = spark.createDataFrame([("r", "a"), ("r", "b")], "request_id string, film_id string")
    passages = spark.createDataFrame([("r", ["a", "a"]), ("r", ["a", "c"])], "request_id string, film_ids array<string>")
    assert {r.film_id: r.n for r in G.context_coverage(selected, passages).collect()} == {"a": 2, "b": 0}


def choose_plainly(hits, sizes):
    """The selection over all hits of one request, written without any pruning."""
    merged = {}
    for passage, score, anchor, direct in hits:
        row = merged.setdefault(passage, [0.0, set(), set()])
        row[0] = max(row[0], score)
        row[1].add(anchor)
        if direct:
            row[2].add(anchor)
    value = {p: round(r[0] + math.log1p(len(r[1])), 9) for p, r in merged.items()}
    ranked = sorted(merged, key=lambda p: (-value[p], p))
    doc = {p: p.split(":")[0] for p in ranked}
    chosen, used = [], 0

    def take(p):
        nonlocal used
        same = sum(doc[c] == doc[p] for c in chosen)
        if p not in chosen and len(chosen) < 16 and same < 2 and used + sizes[p] <= 15_000:
            chosen.append(p)
            used += sizes[p]

    for anchor in sorted({h[2] for h in hits}):
        best = next((p for p in ranked if anchor in merged[p][2]), None)
        if best:
            take(best)
    left = list(ranked)
    while left and len(chosen) < 16:
        def marginal(p):
            near = sum(bool(merged[p][1] & merged[c][1]) for c in chosen)
            return value[p] / (1 + near * 0.45 + sum(doc[c] == doc[p] for c in chosen) * 2)

        best = min(left, key=lambda p: (-marginal(p), p))
        left.remove(best)
        take(best)
    return chosen


@pytest.mark.parametrize("seed, first", [(11, 64), (12, 64), (12, 1)])
def test_context_equals_the_plain_selection(spark, seed, first):
    rng = random.Random(seed)
    passages = [f"d{d:03}:{o}" for d in range(220) for o in range(3)]
    hits = [(p, round(rng.uniform(0.5, 5), 3), f"f{rng.randrange(5)}", False) for p in passages for _ in range(rng.randrange(1, 3))]
    # Direct hits of one anchor rank far below the others and are only reachable through their guarantee.
    hits += [(p, 0.01, "f9", True) for p in rng.sample(passages, 2)] + [(p, 20.0, "f1", True) for p in rng.sample(passages, 3)]
    # Nearly all good rows are too large, so that a small pool runs dry.
    sizes = {p: rng.choice([300, 900, 2_500, 16_000] if first == 64 and seed == 11 else [2_000, 16_000, 16_000, 16_000, 16_000]) for p in passages}
    frame = spark.createDataFrame([("r", *h) for h in hits], "request_id string, passage_id string, score double, anchor string, direct boolean")
    cards = spark.createDataFrame([(p, p.split(":")[0], n) for p, n in sizes.items()], "passage_id string, doc_id string, size int")
    got = G.select_context(G.ranked_hits(G.merge_hits(frame)).join(cards, "passage_id"), first).orderBy("position").collect()
    assert [r.passage_id for r in got] == choose_plainly(hits, sizes)


def test_context_where_nothing_fits(spark):
    frame = spark.createDataFrame([("r", f"p{i:03}", 1.0, "a", False) for i in range(100)], "request_id string, passage_id string, score double, anchor string, direct boolean")
    rows = G.ranked_hits(G.merge_hits(frame)).withColumns({"doc_id": F.col("passage_id"), "size": F.lit(20_000)})
    assert G.select_context(rows, 8).count() == 0


def plain_hits(requests, passages, keep, min_terms, rarest=None):
    frequency = {}
    for terms in passages.values():
        for t in terms:
            frequency[t] = frequency.get(t, 0) + 1
    out = set()
    for request, terms in requests.items():
        known = sorted((t for t in set(terms) if t in frequency), key=lambda t: (frequency[t], t))[:rarest]
        scored = []
        for passage, held in passages.items():
            shared = [t for t in known if t in held]
            if len(shared) >= min_terms:
                scored.append((-round(sum(math.log(1 + len(passages) / (1 + frequency[t])) for t in shared), 6), passage, len(shared)))
        for place, (raw, passage, matched) in enumerate(sorted(scored)[:keep]):
            out.add((request, passage, matched, place + 1, round(min(5.0, -raw / 3), 6)))
    return out


@pytest.mark.parametrize("min_terms, rarest, probe", [(2, None, 64), (2, 3, 5), (1, None, 1), (2, None, 10_000)])
def test_lexical_hits_equal_the_plain_ranking(spark, min_terms, rarest, probe):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    passages = {f"p{i:03}": sorted(set(rng.choices(vocabulary, weights, k=rng.randint(0, 15)))) for i in range(300)}
    requests = {f"r{i}": sorted(set(rng.choices(vocabulary, weights, k=rng.randint(1, 9)))) for i in range(20)} | {"none": [], "odd": ["zz", "w1"], "all": vocabulary}
    got = L.lexical_hits(
        spark.createDataFrame(list(requests.items()), "request_id string, terms array<string>"),
        spark.createDataFrame(list(passages.items()), "passage_id string, terms array<string>").repartition(4), 8, min_terms, rarest, probe,
    )
    assert {(r.request_id, r.passage_id, r.matched, r.hit_rank, r.score) for r in got.collect()} == plain_hits(requests, passages, 8, min_terms, rarest)


def test_common_terms_make_no_pairs_where_rare_ones_decide(spark):
    # Every passage holds `common` and `usual`; only a few hold the rare pair that decides.
    passages = [(i, ["common", "usual"] + (["rare", "seldom"] if i % 100 == 0 else [])) for i in range(2_000)]
    rows = spark.createDataFrame(passages, "passage_id long, terms array<string>").repartition(4)
    asked = spark.createDataFrame([(i, ["common", "usual", "rare", "seldom"]) for i in range(50)], "request_id long, terms array<string>")
    known, forward = L.forward_index(asked, rows)
    terms = L.bounded_terms(known, forward, 2_000)
    weights = L.term_weights(terms)
    essential = L.essential_terms(terms, forward, weights, 8, 2)
    made = L.scored_pairs(essential, forward, weights, 1).count()
    assert made == 50 * 20 and made < 50 * 2_000 / 50
    assert {r.passage_id % 100 for r in L.lexical_hits(asked, rows).collect()} == {0}


def test_rerank_equals_the_plain_greedy(spark):
    rng = random.Random(4)
    rows = [
        (1, f"c{i:02}", float(rng.randrange(2)), rng.choice("XYZ"), rng.choice(["FR", "JP"]), 1950 + rng.randrange(40), rng.sample("ghij", 2), rng.random() < 0.3)
        for i in range(12)
    ]
    left, chosen = list(rows), []
    while left:
        def value(r):
            def like(s):
                return 0.45 * (r[3] == s[3]) + 0.2 * (r[4] == s[4]) + 0.15 * (r[5] // 10 == s[5] // 10) + 0.2 * bool(set(r[6]) & set(s[6]))

            return round(r[2] * (1 - 0.22 * max(map(like, chosen), default=0)) - 0.025 * r[7], 12)

        best = min(left, key=lambda r: (-value(r), r[1]))
        left.remove(best)
        chosen.append(best)
    schema = "request_id int, candidate string, relevance double, director string, country string, year int, genres array<string>, seen boolean"
    got = R.diversity_rerank(spark.createDataFrame(rows, schema)).orderBy("position").collect()
    assert [r.candidate for r in got] == [r[1] for r in chosen]
