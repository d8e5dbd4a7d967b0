"""Admission, ingestion, store, publication, evaluation and streams on small fixtures."""

import json
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from corpusloom.functions.keys import version_id
from corpusloom.operators import admission as A, collection as L, contract as K, evaluation as Q, projections as J, publication as P, versions as N
from corpusloom.schemas import CANDIDATE, RECORD
from corpusloom.sources import model_io as M, records as S, store as T
from corpusloom.sources.jobs import read_plan, read_targets, write_manifest
from corpusloom.streaming import flows, state


def film(key="f1", **changes):
    return dict(dict(key=key, title="The Paper Lantern", year=1980, director="Mara Linden", aliases=[], externalIds=[]), **changes)


def observation(id="o1", **changes):
    return dict(
        dict(id=id, summary="A reading.", summaryKo=None, boundary="One scene.", filmKeys=["f1"], subjects=["light"], kind="film_reading", passageIds=["p1"]),
        **changes,
    )


def record(id="doc-one", **changes):
    return dict(
        dict(
            id=id, url=f"https://site.org/{id}", title="T", author=None, publisher="P", type="criticism", language="en",
            publishedAt="2020-05", checkedAt="2024-05-01T00:00:00Z", access="full_page",
            rights=dict(mode="restricted_excerpt", licenseUrl=None, note="n"),
            verification=dict(method="web_open", locator="l", note="n", textUrl=None),
            films=[film()], passages=[dict(id="p1", text="some words", locator="l")], observations=[observation()],
        ),
        **changes,
    )


BROKEN = {
    "id": record("X"),
    "url": record(url="https://user@site.org"),
    "date": record(publishedAt="2020-13"),
    "type_or_access": record(type="blog"),
    "academic_without_full_text": record(type="academic", access="abstract"),
    "rights_mode": record(rights=dict(mode="mine", note="n")),
    "license_missing": record(rights=dict(mode="open_license", note="n")),
    "verification_method": record(verification=dict(method="guess", locator="l", note="n")),
    "films_empty": record(films=[]),
    "evidence_missing": record(passages=[]),
    "evidence_unexpected": record(access="metadata_only"),
    "film_key_repeated": record(films=[film(), film()]),
    "film_year": record(films=[film(year=1860)]),
    "film_aliases": record(films=[film(aliases=["a", "a"])]),
    "external_ids": record(films=[film(externalIds=[dict(provider="tmdb", id="")])]),
    "passage_repeated": record(passages=[dict(id="p1", text="a", locator="l")] * 2),
    "quote_words": record(passages=[dict(id="p1", text="w " * 26, locator="l")]),
    "observation_kind": record(observations=[observation(kind="rumour")]),
    "observation_reference": record(observations=[observation(passageIds=["p9"])]),
    "relational_alone": record(observations=[observation(kind="influence")]),
    "prose_words": record(observations=[observation(summary="w " * 159)]),
}


def rows(spark, items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "raw string").select(F.from_json("raw", RECORD).alias("r")).select("r.*")


def test_admission_names_each_broken_rule(spark):
    judged = A.admit(rows(spark, BROKEN.values()), 2024).select("errors").collect()
    assert {name: name in r.errors for name, r in zip(BROKEN, judged)} == dict.fromkeys(BROKEN, True)
    assert A.admit(rows(spark, [record()]), 2024).first().errors == []


def write_files(folder, **files):
    for name, body in files.items():
        (folder / f"{name}.json").write_text(body if isinstance(body, str) else json.dumps(body))


def ingest_folder(spark, folder, commercial=False):
    read = S.read_records(spark, str(folder))
    return A.ingestion_status(A.admit(read, 2024), commercial)


def test_files_quarantine_and_repeats(spark, tmp_path):
    write_files(tmp_path, a=[record("doc-one"), record("doc-bad", films=[])], b="[{broken", c=[record("doc-one"), record("doc-bad")])
    got = [(os.path.basename(r.file), r.idx, r.status, r.reason) for r in ingest_folder(spark, tmp_path).collect()]
    assert sorted(got) == [
        ("a.json", 0, "completed", None), ("a.json", 1, "quarantined", "films_empty"), ("b.json", 0, "quarantined", "id"),
        ("c.json", 0, "quarantined", "duplicate_id"), ("c.json", 1, "quarantined", "duplicate_id"),
    ]


def test_rights_filter_is_not_a_failure(spark, tmp_path):
    licensed = record("doc-two", rights=dict(mode="open_license", licenseUrl="https://l.org/x", note="n"))
    write_files(tmp_path, a=[record(), licensed])
    assert {r.id: r.status for r in ingest_folder(spark, tmp_path, True).collect()} == {"doc-one": "filtered", "doc-two": "completed"}


def test_versions_follow_content_not_recheck(spark, tmp_path):
    for name, changes in [("first", {}), ("recheck", {"checkedAt": "2025-01-01T00:00:00Z"}), ("edit", {"title": "Other"})]:
        folder = tmp_path / name
        folder.mkdir()
        write_files(folder, a=[record(**changes)])
    hashes = [S.read_records(spark, str(tmp_path / n)).first().content_hash for n in ("first", "recheck", "edit")]
    assert hashes[0] == hashes[1] != hashes[2]


def test_store_is_append_only_and_idempotent(spark, tmp_path):
    resolved = spark.createDataFrame([("f1", "film-a")], "source_key string, key string")
    root = str(tmp_path / "store")

    def build(items):
        frame = rows(spark, items).withColumn("content_hash", F.sha2("title", 256))
        return T.append_versions(T.version_tables(frame, resolved), root).count()

    assert [build([record()]), build([record()]), build([record(title="Edited")])] == [1, 0, 1]
    store = T.read_store(spark, root)
    assert {n: store[n].count() for n in ("versions", "passages", "observations", "evidence_links", "entities")} == {
        "versions": 2, "passages": 2, "observations": 2, "evidence_links": 2, "entities": 1,
    }
    counts = N.integrity_counts(store, [("passages", "version_id", "versions", "version_id"), ("evidence_links", "passage_id", "passages", "passage_id")])
    assert {r.check: r.n for r in counts.collect() if r.check.startswith("orphans")} == {"orphans:passages.version_id": 0, "orphans:evidence_links.passage_id": 0}
    related = N.related_films(store["observations"], store["participants"], store["entities"].dropDuplicates(["key"]), store["evidence_links"], store["passages"])
    assert all(r.text == "some words" and [f.key for f in r.films] == ["film-a"] for r in related.collect())


def test_snapshot_is_written_once(spark, tmp_path):
    docs = spark.createDataFrame([("v1",), ("v2",)], "version_id string")
    version = N.corpus_digest(docs).first().digest
    assert version == N.corpus_digest(docs.repartition(5).orderBy(F.desc("version_id"))).first().digest
    assert version != N.corpus_digest(docs.limit(1)).first().digest
    assert T.write_snapshot(docs, str(tmp_path), version) and not T.write_snapshot(docs, str(tmp_path), version)


def test_registry_round_trip(spark, tmp_path):
    entities = spark.createDataFrame([("k1", "Amber", 1980, "Anne", [("tmdb", "1")])], "key string, title string, year int, director string, externalIds array<struct<provider:string,id:string>>")
    aliases = spark.createDataFrame([("k1", "Amber", "title"), ("k1", "Ambre", "title"), ("k1", "f1", "record_key")], "key string, alias string, alias_type string")
    S.write_registry(S.registry_rows(entities, aliases), str(tmp_path / "r"))
    row = S.read_registry_rows(spark, str(tmp_path / "r")).first()
    assert (row.aliases, row.sourceKeys) == (["Ambre"], ["f1"])
    (tmp_path / "reg.json").write_text(json.dumps({"version": 1, "films": [row.asDict(True)]}, indent=1))
    assert S.read_registry(spark, str(tmp_path / "reg.json")).first().key == "k1"


def test_external_id_union(spark):
    frame = spark.createDataFrame([("k", '["tmdb:7", {"provider": "wikidata", "id": "Q1"}, {"provider": "tmdb", "id": "9"}]')], "key string, j string")
    films = frame.select("key", F.from_json("j", "array<variant>").alias("externalIds"))
    assert {r.ref for r in S.normalise_external_ids(films).collect()} == {"tmdb:7", "wd:Q1", "tmdb:9"}


def test_page_cache_rules(spark):
    good = ("u1", 3, "readable", "text", "2024-05-05 00:00:00")
    cases = [good, ("u2", 2, *good[2:]), ("u3", 3, "blocked", *good[3:]), ("u4", 3, "readable", "text", "2024-04-01 00:00:00")]
    frame = spark.createDataFrame(cases, "url string, extractor_version int, status string, text string, checked string")
    cache = frame.withColumn("checked_at", F.to_timestamp("checked")).withColumn("text_hash", F.sha2("text", 256))
    cache = cache.unionByName(cache.where("url = 'u1'").withColumn("url", F.lit("u5")).withColumn("text_hash", F.lit("no")))
    now = spark.sql("SELECT timestamp'2024-05-06 00:00:00' AS t").first().t
    assert {r.url for r in S.usable_pages(cache, now).collect()} == {"u1"}


def test_vector_cache_and_neighbour_artefact(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"model": "m", "dimensions": 3, "vectors": {"h1": [1, 0, 0], "h2": [0, 1, 0]}, "generatedAt": {"h1": "2024"}}))
    got = {r.input_hash: (r.vector, r.generated_at) for r in M.read_vector_cache(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"h1": ([1.0, 0.0, 0.0], "2024"), "h2": ([0.0, 1.0, 0.0], M.UNKNOWN_TIME)}
    edges = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, score double")
    for corpus in ("v1", "v2"):
        T.write_neighbours(edges, str(tmp_path / "n"), corpus, "m", 3)
    assert T.read_neighbours(spark, str(tmp_path / "n"), "v1").count() == 1 and T.read_neighbours(spark, str(tmp_path / "n"), "v3").count() == 0


def test_jobs_and_manifest(spark, tmp_path):
    (tmp_path / "job.json").write_text(json.dumps({"version": 1, "id": "job-1", "createdAt": "2024", "description": "d", "targets": [{"id": "t-b", "url": "https://s.org/b", "sourceFamily": "fam"}, {"id": "t-a", "url": "https://s.org/a", "sourceFamily": "fam", "textUrl": "https://s.org/a.txt"}]}))
    targets = read_targets(spark, str(tmp_path / "job.json"))
    assert [(r.ordinal, r.target_id, r.text_url) for r in targets.orderBy("ordinal").collect()] == [(0, "t-b", None), (1, "t-a", "https://s.org/a.txt")]
    (tmp_path / "plan.json").write_text(json.dumps({"version": 1, "families": [{"sourceFamily": "fam", "seeds": ["https://s.org/p{page}", "https://s.org/all"], "pageStart": 2, "pageEnd": 3, "includePathPrefixes": ["/"], "quota": 5}]}))
    pages = L.listing_pages(read_plan(spark, str(tmp_path / "plan.json")))
    assert sorted(r.url for r in pages.collect()) == ["https://s.org/all", "https://s.org/all", "https://s.org/p2", "https://s.org/p3"]
    items = targets.withColumn("status", F.when(F.col("ordinal") == 0, "fetched").otherwise("network_error"))
    assert not write_manifest(items, str(tmp_path / "m1")).first().complete
    done = write_manifest(items.withColumn("status", F.lit("fetched")), str(tmp_path / "m2")).first()
    assert done.complete and done["items"] == 2 and done.counts == {"fetched": 2}


FAMILY = "id string, publisher string, hosts array<string>, prefixes array<string>, type string, language string, note string, pace_ms int, min_chars int"


def test_registry_and_job_rules(spark):
    good = ("fam-a", "P", ["s.org"], ["/"], "criticism", "en", "n", 0, 80)
    bad = [("Fam", *good[1:]), ("fam-b", "P", ["S.org"], *good[3:]), ("fam-c", "P", ["s.org"], ["x"], *good[4:]), ("fam-d", *good[1:7], -1, 79)]
    got = {r.id: r.errors for r in L.validate_families(spark.createDataFrame([good, *bad], FAMILY)).collect()}
    assert got == {"fam-a": [], "Fam": ["id"], "fam-b": ["hosts"], "fam-c": ["prefixes"], "fam-d": ["pace", "min_chars"]}
    targets = spark.createDataFrame(
        [("t-1", "u", "f", None, None), ("t-2", "u", "f", "blog", ["a", " "]), ("t-3", "u", "f", None, None), ("t-3", "", "f", None, [])],
        "id string, url string, family_id string, proposed_type string, tags array<string>",
    )
    found = sorted((r.id, tuple(r.errors)) for r in L.validate_targets(targets).collect())
    assert found == [("t-1", ()), ("t-2", ("type", "tags")), ("t-3", ("repeated",)), ("t-3", ("repeated", "url"))]


def test_plan_statuses(spark):
    families = spark.createDataFrame([("fam", ["s.org"], ["/film"])], "family_id string, hosts array<string>, prefixes array<string>")
    targets = [
        (0, "fresh", "fam", "https://www.s.org/film/a", None), (1, "repeat", "fam", "https://www.s.org/film/a?utm_source=x", None),
        (2, "published", "fam", "https://s.org/film/old", None), (3, "path", "fam", "https://s.org/other", None), (4, "http", "fam", "http://s.org/film/x", None),
        (5, "text", "fam", "https://s.org/film/t", "https://www.s.org/film/a"), (6, "nofam", "zzz", "https://s.org/film/q", None), (7, "after", "fam", "https://s.org/film/t", None),
    ]
    frame = spark.createDataFrame(targets, "ordinal int, target_id string, family_id string, url string, text_url string")
    published = spark.createDataFrame([("https://s.org/film/old/#x",)], "url string")
    got = {r.target_id: r.status for r in L.plan_collection(frame, families, published).collect()}
    assert got == {
        "fresh": "pending", "repeat": "duplicate_in_job", "published": "duplicate_published", "path": "policy_rejected",
        "http": "invalid_target", "text": "duplicate_in_job", "nofam": "policy_rejected", "after": "pending",
    }


def test_discovery_respects_earlier_families(spark):
    families = spark.createDataFrame([("one", ["s.org"], ["/"]), ("two", ["s.org"], ["/"])], "family_id string, hosts array<string>, prefixes array<string>")
    plan = spark.createDataFrame([(1, "one", ["/film"], 2), (2, "two", ["/film"], 2)], "position int, family_id string, include array<string>, quota int")
    links = [("one", f"https://s.org/film/{c}") for c in "zab"] + [("two", f"https://s.org/film/{c}") for c in "abcz"] + [("two", "https://s.org/about")]
    out = L.discover(spark.createDataFrame(links, "family_id string, url string"), plan, families, spark.createDataFrame([], "url string"), 10)
    assert [(r.family_id, r.url[-1]) for r in out.collect()] == [("one", "a"), ("one", "b"), ("two", "c"), ("two", "z")]


def test_page_statuses(spark):
    long = "word " * 40
    cases = [
        (long, "text/html", 200, 10, "readable"), (long, "text/html", 403, 10, "blocked"), (long, "text/html", 500, 10, "http_error"),
        (long, "image/png", 200, 10, "unsupported_content"), (long, "text/html", 200, 40_000_000, "response_too_large"),
        ("Just a moment... " + long, "text/html", 200, 10, "blocked"), ("short", "text/plain", 200, 5, "unreadable"), (None, "application/pdf", 200, 5, "pdf_not_checked"),
    ]
    frame = spark.createDataFrame(cases, "t string, c string, h int, b int, want string")
    assert all(r.want == r.got for r in frame.select("want", L.page_status(F.col("t"), F.col("c"), F.col("h"), F.col("b")).alias("got")).collect())


def test_publication_is_all_or_nothing(spark, tmp_path):
    schema = "id string, url string, text_url string, errors array<string>"
    existing = spark.createDataFrame([("old", "https://s.org/old", "https://s.org/old.txt", [])], schema)
    report = spark.createDataFrame([("validated", 2, 2)], "status string, published_candidates int, requested int")
    good = spark.createDataFrame([("a", "https://s.org/a", None, []), ("b", "https://s.org/b", None, [])], schema)
    bad = spark.createDataFrame([("a", "https://s.org/a", None, []), ("old", "https://s.org/old.txt?utm_x=1", None, ["date"])], schema)
    found = {(r.rule, r.subject) for r in P.publish(bad, existing, report, str(tmp_path / "bad")).collect()}
    assert found == {("id_published", "old"), ("url_published", "https://s.org/old.txt"), ("admission", "old")}
    assert not (tmp_path / "bad").exists()
    assert P.publish(good, existing, report, str(tmp_path / "good")).count() == 0 and spark.read.parquet(str(tmp_path / "good")).count() == 2
    wrong = P.publication_violations(good, existing, report.withColumn("requested", F.lit(3)))
    assert [r.rule for r in wrong.collect()] == ["report"]


def test_candidate_audit(spark):
    base = dict(
        admit=True, accessAssessment="abstract_only", document=dict(language="en", sourceType="academic"),
        films=[dict(title="t", aliases=[], evidencePhrase="x")], rejectionReasons=[],
        observations=[dict(kind="film_reading", filmIndexes=[0], summary="s", summaryKo="s", boundary="b", subjects=["x"], anchorQuote="not there", confidence=0.9)],
    )
    ok = json.loads(json.dumps(base))
    ok.update(accessAssessment="full_text")
    ok["observations"] = [dict(base["observations"][0], anchorQuote="light “falls”"), dict(base["observations"][0], anchorQuote="light", kind="influence", filmIndexes=[0, 1])]
    rows_ = [("bad", "light falls", json.dumps(base)), ("good", 'the light\n"falls" here', json.dumps(ok))]
    frame = spark.createDataFrame(rows_, "target_id string, source_text string, j string").select("target_id", "source_text", F.from_json("j", CANDIDATE).alias("c")).select("target_id", "source_text", "c.*")
    got = {(r.target_id, r.position): (r.eligible, r.blocks) for r in A.audit_candidates(frame).collect()}
    assert got[("bad", 0)] == (False, ["academic_without_full_text", "quote_not_found"])
    assert got[("good", 0)] == (True, ["invalid_film_reference"]) and not got[("good", 1)][0]


def test_request_rules(spark):
    schema = "request_id string, seeds array<string>, trail array<string>, previous_ids array<string>, seen_ids array<string>, language string, intent string"
    cases = [
        ("r", ["tmdb:1"], [], [], [], "en", "initial"), ("r", ["tmdb:1"], ["tmdb:1"], [], [], "en", "initial"), ("", ["tmdb:0"], [], [], [], "fr", "later"),
    ]
    got = [r.e for r in spark.createDataFrame(cases, schema).select(A.request_errors().alias("e")).collect()]
    assert got == [[], ["repeated_film"], ["request_id", "seeds", "language", "intent"]]


def test_recommendation_and_snapshot_integrity(spark):
    link = "array<struct<anchorId:string,relation:string,sourceIds:array<string>>>"
    recs = [(1, [("a", "direct_connection", ["s1"])], ["s1"]), (2, [("a", "ai_inference", ["s1"])], ["s1"]), (3, [("a", "ai_inference", [])], ["s1"]), (4, [("a", "direct_connection", ["s2"])], ["s1"])]
    frame = spark.createDataFrame(recs, f"id int, connections {link}, source_ids array<string>")
    got = {r.id: r.e for r in frame.select("id", A.recommendation_errors().alias("e")).collect()}
    assert got == {1: [], 2: ["relation_evidence", "evidence_on_inference"], 3: ["evidence_on_inference"], 4: ["unlisted_source"]}
    snap = [(["a"], ["b"], ["s1"], [("c", ["s1"], [("a", "x", ["s1"])])]), (["a"], ["a"], ["s1"], [("a", ["s9"], [("z", "x", [])])])]
    shape = f"seeds array<string>, trail array<string>, sources array<string>, recommendations array<struct<film_id:string,source_ids:array<string>,connections:{link}>>"
    got = [r.e for r in spark.createDataFrame(snap, shape).select(A.snapshot_errors().alias("e")).collect()]
    assert got == [[], ["repeated_film", "self_recommendation", "unknown_source", "unknown_anchor"]]


def test_membership_aborts(spark):
    a = spark.createDataFrame([(1, "x")], "id int, h string")
    N.require_equal(a, a, "id", ["h"])
    with pytest.raises(ValueError):
        N.require_equal(a, a.withColumn("h", F.lit("y")), "id", ["h"])


def test_quality_scoring(spark):
    order = Q.blind_order(spark.createDataFrame([("c1", 1, "c1::1")], "case_id string, repetition int, comparison_id string"))
    row = order.first()
    label = "A" if row.a == "candidate" else "B"
    ratings = spark.createDataFrame([("c1::1", f"r{i}", p) for i, p in enumerate([label, label, "tie"])], "comparison_id string, reviewer_id string, preferred string")
    scored = Q.pairwise_scores(Q.unblind(ratings, order))
    assert (scored.first().score, scored.first().ties) == (1.0, 1)
    assert Q.incomplete_ratings(ratings, order).count() == 0
    assert Q.incomplete_ratings(ratings.unionByName(ratings.limit(1)), order).count() == 1
    low, high = Q.wilson("s", "n")
    got = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (20.5, 40.0)], "s double, n double").select(low.alias("l"), high.alias("h")).collect()
    assert (got[1].l, got[1].h) == (0.0, 1.0) and abs(got[0].l - 0.20654) < 1e-4 and got[2].l < 0.5125 < got[2].h
    gates = spark.createDataFrame([(3, 39, 1.0, 0.9, 5.0, 12.0, 0), (3, 40, 0.6, 0.51, 4.0, 8.0, 0), (3, 40, 0.6, 0.5, 4.0, 8.0, 0)], "reviewers int, cases int, score double, lower double, usefulness double, worthwhile double, errors int")
    assert [r.status for r in Q.quality_gate(gates).collect()] == ["incomplete", "pass", "fail"]


def test_nearest_rank_counts_failures(spark):
    runs = [("m", True, v) for v in [10, 20, 30, 40]] + [("m", False, 1), ("empty", False, 5)]
    got = {r.g: r for r in Q.run_summary(spark.createDataFrame(runs, "g string, ok boolean, elapsed_ms int"), "g").collect()}
    assert (got["m"].p50_ms, got["m"].p95_ms, got["m"].success_rate) == (20, 40, 0.8) and got["empty"].p50_ms is None
    middle = Q.nearest_rank(spark.createDataFrame(runs, "g string, ok boolean, ms int").where("ok"), "g", "ms", {"mid": None})
    assert middle.first().mid == 30


def test_cost_uses_first_matching_rate(spark):
    calls = [("gpt-5.4-mini-x", 1_000_000, 0, 0, 0), ("gpt-5.4", 1_000_000, 0, 1_000_000, 0), ("gpt-4.1-mini", 10, 0, 0, 1), ("other", 0, 1_000_000, 0, 0)]
    frame = spark.createDataFrame(calls, "model string, input_tokens bigint, output_tokens bigint, cached_tokens bigint, search_calls bigint")
    assert [round(r.usd, 6) for r in Q.estimate_cost(frame).collect()] == [0.75, 0.25, 0.013204, 0.6]


def test_explicit_claims_need_a_literal_passage(spark):
    slots = spark.createDataFrame([("r", 1, "Amber", ["a"], ["p1"], "source_explicit"), ("r", 2, "Blue", ["a"], ["p1"], "source_explicit")], "request_id string, slot int, title string, anchor_ids array<string>, evidence_ids array<string>, attribution string")
    passages = spark.createDataFrame([("r", "p1", "exact_passage", None, "t", "The Ámber glow", ["x"], ["a"])], "request_id string, passage_id string, content_kind string, observation string, title string, excerpt string, subjects array<string>, film_ids array<string>")
    assert {r.slot: r.attribution for r in K.downgrade(slots, passages).collect()} == {1: "source_explicit", 2: "source_supported_interpretation"}


def test_source_cards(spark):
    schema = "passage_id string, title string, url string, type string, content_kind string, rights string, observation string, excerpt string, access_level string, checked_at string, built_at string"
    cards = [("p1", "T", "http://s.org/x", "programme", "exact_passage", "open_license", None, "quote", None, None, "2024-05-01T10:00"), ("p2", "T", "ftp://s.org", "academic", "x", "y", "o", "e", None, "2024-01-01T", "z")]
    got = K.source_card(spark.createDataFrame(cards, schema)).collect()
    assert [(r.source_id, r.url, r.type, r.scope, r.excerpt, r.access_level, r.verified_on) for r in got] == [("context:p1", "https://s.org/x", "festival", "programme_context", "quote", "full_text", "2024-05-01")]
    used = K.used_sources(spark.createDataFrame([("r", "p1"), ("r", "p2")], "request_id string, passage_id string"), spark.createDataFrame([("r", ["p2"])], "request_id string, source_ids array<string>"))
    assert [r.passage_id for r in used.collect()] == ["p2"]


def test_response_text_forms(spark):
    shape = "output array<struct<type:string,content:array<struct<type:string,text:string>>>>"
    frame = spark.createDataFrame([([("r", None), ("m", [("refusal", "n"), ("output_text", "a"), ("output_text", "b")])],)], shape)
    row = frame.select(M.response_text("output").alias("first"), M.response_text("output", True).alias("all")).first()
    assert (row.first, row.all) == ("a", "ab")


def test_batch_limits(spark, tmp_path, monkeypatch):
    items = spark.createDataFrame([("t", "u", "p", "criticism", "en", None, "text")], "target_id string, url string, publisher string, type string, language string, title_hint string, text string")
    lines = M.batch_lines(items, "job", "m")
    assert M.write_batch_requests(lines, str(tmp_path / "ok")).first().requests == 1
    many = spark.range(10).coalesce(1).crossJoin(lines)
    monkeypatch.setattr(M, "BATCH_ROWS", 4)
    M.write_batch_requests(many, str(tmp_path / "rows"))
    files = [f for f in (tmp_path / "rows").iterdir() if f.name.startswith("part-")]
    sizes = sorted(len(f.read_text().splitlines()) for f in files)
    assert [n for n in sizes if n] == [2, 4, 4]  # an empty partition leaves an empty file
    monkeypatch.setattr(M, "BATCH_BYTES", 10)
    with pytest.raises(ValueError):
        M.write_batch_requests(lines, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_page_enrichment_needs_the_same_entity(spark):
    films = spark.createDataFrame([("f1", "Q1", "A", ""), ("f2", "Q2", "B", "kept")], "film_id string, authority_id string, wiki_title string, poster string")
    pages = spark.createDataFrame([("A", "Q1", "Intro [1].\n== Plot ==\nIt begins.", "still.jpg", "http://i"), ("B", "Q9", "x", "y", "z")], "title string, item string, extract string, page_image string, thumbnail string")
    got = {r.film_id: (r.poster, r.overview, r.synopsis) for r in J.enrich_from_pages(films, pages).collect()}
    assert got == {"f1": ("http://i", "Intro .", "It begins."), "f2": ("kept", None, None)}
    merged = J.merge_presentation(
        spark.createDataFrame([("f1", "선택", "https://image.tmdb.org/a.jpg")], "film_id string, title_ko string, poster string"),
        spark.createDataFrame([("f1", "", "https://image.tmdb.org/b.jpg", "T")], "film_id string, title_ko string, poster string, title string"),
    ).first()
    assert (merged.title_ko, merged.poster, merged.title) == ("선택", "https://image.tmdb.org/a.jpg", "T")


def test_ingest_resumes_and_never_doubles(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")

    def arrive(*rows_):
        spark.createDataFrame(rows_, "id string, text string").coalesce(1).write.mode("append").parquet(str(source))

    def judge(batch):
        return batch.select(version_id("id", F.sha2("text", 256)).alias("version_id"), F.lit("completed").alias("status"))

    def run():
        stream = spark.readStream.schema("id string, text string").parquet(str(source))
        return flows.ingest(stream, judge, root).count()

    arrive(("a", "1"), ("b", "1"), ("a", "1"))
    assert run() == 2 and run() == 2
    arrive(("a", "1"), ("a", "2"))
    assert run() == 3


def test_ingest_looks_up_only_what_arrives(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    read, known = [], []

    def run():
        stream = spark.readStream.schema("id string").parquet(str(source))
        rows = flows.ingest(stream, lambda b: b.select("id", F.col("id").alias("version_id"), F.lit("completed").alias("status")), root)
        return sorted(r.id for r in rows.collect())

    class Watch(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            if event.progress.numInputRows:
                read.append(event.progress.numInputRows)
                known.append(sum(o.numRowsTotal for o in event.progress.stateOperators))

        def onQueryTerminated(self, event):
            pass

    watch = Watch()
    spark.streams.addListener(watch)
    try:
        for low in (0, 90, 180):
            spark.range(low, low + 100).select(F.col("id").cast("string").alias("id")).coalesce(1).write.mode("append").parquet(str(source))
            assert len(run()) == low + 100
        spark.streams.awaitAnyTermination(1)
        for _ in range(50):
            if len(read) == 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    # Each batch reads its own hundred rows and no file that was written; the ids are state.
    assert read == [100, 100, 100] and known == [100, 190, 280]


def arrivals(spark, source, schema, *batches):
    """One file per batch, in order."""
    for rows in batches:
        frame = spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts"))
        frame.coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.02)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def kinds(spark, root, *columns):
    rows = spark.read.option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return sorted((r["batch"], r["kind"], *(r[c] for c in columns)) for r in rows.collect())


def at(day, clock="00:00:00"):
    return f"2024-01-{day:02d} {clock}"


def test_requests_are_shared_until_their_state_goes(spark, tmp_path):
    root = str(tmp_path / "out")
    stream = arrivals(
        spark, tmp_path / "in", "ts string, k string",
        [(at(1), "a"), (at(1, "00:00:30"), "a"), (at(1), "b")], [(at(1, "00:00:40"), "a"), (at(1, "00:05:00"), "c")],
        # The watermark stands at 00:04 here: a's state is gone and its work starts anew; b's row is too late.
        [(at(1, "00:06:00"), "a"), (at(1, "00:00:10"), "b")],
    )
    got = {r.k: r.us for r in flows.share_requests(stream, ["k"], "60 seconds", root).collect()}
    assert [(b, kind, k) for b, kind, k in kinds(spark, root, "k") if kind] == [
        (0, "row", "a"), (0, "row", "b"), (1, "row", "c"), (2, "late", "b"), (2, "row", "a")
    ]
    start = min(got.values())
    assert got == {"a": start, "b": start, "c": start + 300_000_000}


def test_progress_comes_out_per_batch_and_its_state_goes(spark, tmp_path):
    root, schema = str(tmp_path / "out"), "ts string, seq long, stage string, terminal boolean, r string"
    stream = arrivals(
        spark, tmp_path / "in", schema,
        [(at(1, "10:00:00"), 1, "curating", False, "r")], [(at(1, "10:00:05"), 2, "done", True, "r"), (at(1, "09:00:00"), 0, "queued", None, "r")],
        [(at(3), 9, "curating", False, "q")], [(at(1, "10:00:06"), 3, "error", True, "r"), (at(3, "01:00:00"), 10, "done", True, "q")],
    )
    out = flows.latest_progress(stream, "r", "1 hour", root=root).collect()
    assert kinds(spark, root, "r", "stage", "steps") == [
        (0, "row", "r", "curating", 1), (1, "row", "r", "done", 3), (2, "row", "q", "curating", 1), (3, "late", "r", "error", 1), (3, "row", "q", "done", 2)
    ]
    assert {(r.r, r.stage, r.steps, r.terminal_steps, str(r.span.start)) for r in out} == {
        ("r", "error", 4, 2, at(1)), ("q", "done", 2, 1, at(3))
    }


def test_seen_films_are_state_that_goes_when_idle(spark, tmp_path):
    root = str(tmp_path / "out")
    stream = arrivals(
        spark, tmp_path / "in", "ts string, s string, film string",
        [(at(1), "s", "x"), (at(1), "s", "y"), (at(1), "s", "x")], [(at(2), "s", "x")], [(at(12), "t", "x")],
        # Beyond a week of idleness x is new again, and what is older than that comes late.
        [(at(12), "s", "x"), (at(2), "u", "z")], [(at(12), "s", None)],
    )
    got = sorted(((r.s, r.film) for r in flows.seen_films(stream, "s", "film", "1 hour", "7 days", root).collect()), key=repr)
    assert got == [("s", "x"), ("s", "y"), ("s", None), ("t", "x"), ("u", "z")]
    assert [r[:3] for r in kinds(spark, root, "s")] == [
        (0, "row", "s"), (0, "row", "s"), (2, "row", "t"), (3, "late", "u"), (3, "row", "s"), (4, "row", "s")
    ]


def test_orphans_are_closed_by_timers_and_joined_with_late_rows(spark, tmp_path):
    root, schema = str(tmp_path / "out"), "ts string, terminal boolean, r string"
    stream = arrivals(
        spark, tmp_path / "in", schema,
        [(at(1, "00:00:00"), False, "a"), (at(1, "02:00:00"), False, "a"), (at(1, "00:00:00"), False, "b"), (at(1), False, "d")], [(at(1, "12:00:00"), False, "c")],
        [(at(2), False, "c"), (at(1, "00:10:00"), True, "b")],
        # Late for a, between its two sessions and touching both; late for d, and reaching into what is still open.
        [(at(1, "01:00:00"), None, "a"), (at(1, "23:30:00"), False, "d")], [(at(1, "23:00:00"), False, "d"), (at(2, "00:30:00"), False, "d")],
    )
    got = sorted((r.r, str(r.started), str(r.abandoned), r.steps) for r in flows.orphans(stream, "r", "1 hour", "1 hour", root).collect())
    assert got == [("a", at(1), at(1, "03:00:00"), 3), ("c", at(1, "12:00:00"), at(1, "13:00:00"), 1), ("d", at(1), at(1, "01:00:00"), 1)]
    closed = [(b, r) for b, kind, r in kinds(spark, root, "r") if kind == "closed"]
    assert min(b for b, r in closed if r == "a") == 1 and {r for _, r in closed} == {"a", "b", "c", "d"}


def test_state_of_a_hot_key_is_sent_few_rows():
    rows = pa.RecordBatch.from_pydict({
        "k": ["hot"] * 900 + ["x", None], "us": [*range(900), 5, 6], "terminal": [False] * 899 + [True, None, False],
        "seq": [0] * 902, "stage": ["s"] * 902, "ok": [True] * 902, "elapsed_ms": [7] * 902,
    })
    assert [b.num_rows for b in state.earliest(["k"])(iter([rows]))] == [3]
    assert [b.num_rows for b in state.ends(["k"])(iter([rows]))] == [4]
    (spans,) = state.spans(["k"], 10)(iter([rows]))
    assert sorted(zip(*(spans.column(c).to_pylist() for c in ("start", "end", "steps", "finished")))) == [
        (0, 909, 900, True), (5, 15, 1, False), (6, 16, 1, False)
    ]
    (last,) = state.latest(["k"])(iter([rows]))
    assert sorted(zip(last.column("us").to_pylist(), last.column("steps").to_pylist(), last.column("terminal_steps").to_pylist())) == [
        (5, 1, 0), (6, 1, 0), (899, 900, 1)
    ]
    (tally,) = state.tallies(["k"])(iter([rows]))
    assert sorted(tally.column("n").to_pylist()) == [1, 1, 900]


@pytest.mark.parametrize("name", ["stream_dedupe", "stream_progress", "stream_sessions", "stream_latency", "stream_orphans"])
def test_late_rows_of_many_batches_are_in_the_result(spark, tmp_path, name):
    import duckdb

    from corpusloom.plans import ORACLES, streams

    source = "/root/testdata/sf0.001/events.parquet"
    (tmp_path / "events.parquet").mkdir()
    con = duckdb.connect()
    for part in range(6):
        con.execute(f"COPY (SELECT * FROM '{source}' WHERE hash(event_id) % 6 = {part}) TO '{tmp_path}/events.parquet/{part}.parquet'")
    con.execute(f"CREATE VIEW events AS FROM '{source}'")
    wanted = con.execute(ORACLES[name]).fetchall()
    got = [tuple(r) for r in getattr(streams, name)(spark, str(tmp_path), 1).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_late_rows_are_counted_and_percentiles_exact(spark, tmp_path):
    schema = "ts timestamp, kind_ string, ok boolean, elapsed_ms long"
    source, root = tmp_path / "in", str(tmp_path / "out")
    values = [(i * 7919) % 30_011 for i in range(30_011)]
    for part in range(5):
        rows = spark.createDataFrame([("a", True, v) for v in values[part::5]], "kind_ string, ok boolean, elapsed_ms long")
        rows = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000 + (part == 0) * 40 * 86_400))).select("ts", "kind_", "ok", "elapsed_ms")
        rows.coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = {r["attempts"]: (r["p50_ms"], r["p95_ms"]) for r in flows.latency_windows(stream, "1 hour", "30 days", "kind_", root).collect()}
    first, rest = sorted(values[::5]), sorted(v for i, v in enumerate(values) if i % 5)
    at_ = lambda v, p: v[len(v) - len(v) * (100 - p) // 100 - 1]
    assert got == {len(v): (at_(v, 50), at_(v, 95)) for v in (first, rest)}
    late = spark.read.parquet(f"{root}/rows/*/kind=late")
    assert late.agg(F.sum("n")).first()[0] == len(rest)


def test_best_observation_is_the_first_of_which_all_films_resolve(spark):
    rows = [
        ("r", "a", 1, "x"), ("r", "a", 1, "gone"), ("r", "b", 2, "x"), ("r", "b", 2, "y"), ("r", "c", 2, "x"), ("q", "d", 1, None), ("q", "e", 5, "y"),
        ("q", "e", 5, "y"), ("none", "f", 1, "gone"),
    ]
    films = spark.createDataFrame(rows, "request_id string, observation_id string, rank int, film_id string")
    known = spark.createDataFrame([("x",), ("y",), ("y",)], "film_id string")
    assert {tuple(r) for r in Q.best_observation(films, known).collect()} == {("r", "b"), ("q", "e")}


def test_casefolded_keys_of_plain_letters_equal_the_general_form(spark):
    from corpusloom.functions.text import normalize_casefold

    rows = [("The Two-Faces (1999)!",), ("ÉLAN  Ｖital",), ("Straße",), ("",), (None,), ("a_b",)]
    got = [r.k for r in spark.createDataFrame(rows, "t string").select(normalize_casefold("t").alias("k")).collect()]
    assert got == ["thetwofaces1999", "elanvital", "strasse", "", None, "ab"]
