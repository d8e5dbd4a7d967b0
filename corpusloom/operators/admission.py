"""Admission rules over nested records, serving filters and request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalize_quote, valid_iso, word_count
from ..functions.urls import public_http
from ..session import cut, join_back
from ..schemas import ACCESS, KINDS, RELATIONAL, RIGHTS, SOURCE_TYPES

QUOTE_WORDS = 25
PROSE_WORDS = 160
ANCHOR_WORDS = 20
FIRST_YEAR = 1870


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value) == "", F.lit(True))


def _outside(value: Column, options: list[str]) -> Column:
    return F.coalesce(~value.isin(options), F.lit(True))


def _any(items, test) -> Column:
    return F.coalesce(F.exists(items, test), F.lit(False))


def _bad_list(items: Column, nonempty: bool = False) -> Column:
    """Not an array of distinct nonempty texts."""
    bad = (
        items.isNull()
        | _any(items, lambda v: _blank(v))
        | F.coalesce(F.size(F.array_distinct(items)) != F.size(items), F.lit(False))
    )
    return bad | (F.coalesce(F.size(items), F.lit(0)) <= 0) if nonempty else bad


def _repeats(items: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(items)) != F.size(items), F.lit(False))


def _total_words(items, text) -> Column:
    return F.coalesce(F.aggregate(items, F.lit(0), lambda n, x: n + text(x)), F.lit(0))


def admission_errors(this_year=None) -> Column:
    """Every broken rule of a record, in rule order; an empty list admits it."""
    c = F.col
    last_year = (F.lit(this_year) if this_year else F.year(F.current_date())) + 2
    accessible = c("access") != "metadata_only"
    evidence = (F.coalesce(F.size("passages"), F.lit(0)) > 0) & (F.coalesce(F.size("observations"), F.lit(0)) > 0)
    any_evidence = (F.coalesce(F.size("passages"), F.lit(0)) > 0) | (F.coalesce(F.size("observations"), F.lit(0)) > 0)
    film_keys = F.transform("films", lambda f: f["key"])
    passage_ids = F.transform("passages", lambda p: p["id"])
    rules = [
        ("id", ~F.coalesce(c("id").rlike("^[a-z0-9][a-z0-9._-]{2,159}$"), F.lit(False))),
        ("title", _blank(c("title"))),
        ("publisher", _blank(c("publisher"))),
        ("language", _blank(c("language"))),
        ("checkedAt", _blank(c("checkedAt"))),
        ("url", ~public_http("url")),
        ("date", ~valid_iso("checkedAt") | (c("publishedAt").isNotNull() & ~valid_iso("publishedAt"))),
        ("type_or_access", _outside(c("type"), SOURCE_TYPES) | _outside(c("access"), ACCESS)),
        ("academic_without_full_text", F.coalesce((c("type") == "academic") & (c("access") != "full_page"), F.lit(False))),
        ("rights_mode", _outside(c("rights.mode"), RIGHTS)),
        ("rights_note", _blank(c("rights.note"))),
        ("license_url", c("rights.licenseUrl").isNotNull() & ~public_http("rights.licenseUrl")),
        ("license_missing", F.coalesce(c("rights.mode").isin("open_license", "noncommercial"), F.lit(False)) & (F.coalesce("rights.licenseUrl", F.lit("")) == "")),
        ("verification_method", _outside(c("verification.method"), ["web_open", "http_fetch"])),
        ("verification_locator", _blank(c("verification.locator"))),
        ("verification_note", _blank(c("verification.note"))),
        ("text_url", c("verification.textUrl").isNotNull() & ~public_http("verification.textUrl")),
        ("films_empty", F.coalesce(F.size("films"), F.lit(0)) <= 0),
        ("evidence_arrays", c("passages").isNull() | c("observations").isNull()),
        ("evidence_missing", F.coalesce(accessible, F.lit(True)) & ~evidence),
        ("evidence_unexpected", F.coalesce(~accessible, F.lit(False)) & any_evidence),
        ("film_text", _any("films", lambda f: _blank(f["key"]) | _blank(f["title"]) | _blank(f["director"]))),
        ("film_key_repeated", _repeats(film_keys)),
        ("film_year", _any("films", lambda f: F.coalesce(~f["year"].between(F.lit(FIRST_YEAR), last_year), F.lit(True)))),
        ("film_aliases", _any("films", lambda f: _bad_list(f["aliases"]))),
        ("external_ids", _any("films", lambda f: f["externalIds"].isNull() | _any(f["externalIds"], lambda e: e.isNull() | _blank(e["provider"]) | _blank(e["id"])))),
        ("passage_text", _any("passages", lambda p: _blank(p["id"]) | _blank(p["text"]) | _blank(p["locator"]))),
        ("passage_repeated", _repeats(passage_ids)),
        ("quote_words", _total_words("passages", lambda p: word_count(p["text"])) > QUOTE_WORDS),
        ("observation_text", _any("observations", lambda o: _blank(o["id"]) | _blank(o["summary"]) | _blank(o["boundary"]))),
        ("observation_repeated", _repeats(F.transform("observations", lambda o: o["id"]))),
        ("observation_kind", _any("observations", lambda o: _outside(o["kind"], KINDS))),
        ("observation_lists", _any("observations", lambda o: _bad_list(o["filmKeys"], True) | _bad_list(o["passageIds"], True) | _bad_list(o["subjects"], True))),
        ("observation_reference", _any("observations", lambda o: (F.size(F.array_except(o["filmKeys"], film_keys)) > 0) | (F.size(F.array_except(o["passageIds"], passage_ids)) > 0))),
        ("relational_alone", _any("observations", lambda o: o["kind"].isin(RELATIONAL) & (F.size(o["filmKeys"]) < 2))),
        ("prose_words", _total_words("observations", lambda o: word_count(o["summary"]) + word_count(F.coalesce(o["summaryKo"], F.lit(""))) + word_count(o["boundary"])) > PROSE_WORDS),
    ]
    return F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules]))


def admit(records: DataFrame, this_year=None) -> DataFrame:
    return records.withColumn("errors", admission_errors(this_year)).withColumn("admitted", F.size("errors") == 0)


def ingestion_status(admitted: DataFrame, commercial_only: bool = False) -> DataFrame:
    """Status per record: a repeated id is quarantined even when the first one was invalid."""
    first = admitted.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("file", "idx")).alias("first"))
    licensed = F.coalesce(F.col("rights.mode") == "open_license", F.lit(False))
    repeated = F.coalesce(F.struct("file", "idx") != F.col("first"), F.lit(False))
    reason = (
        F.when(repeated, "duplicate_id")
        .when(~F.col("admitted"), F.element_at("errors", 1))
        .when(F.lit(commercial_only) & ~licensed, "no_open_license")
    )
    return (
        join_back(admitted, first, ["id"], "left")
        .withColumn("reason", reason)
        .withColumn(
            "status",
            F.when(F.col("reason").isNull(), "completed")
            .when(F.col("reason") == "no_open_license", "filtered")
            .otherwise("quarantined"),
        )
        .drop("first")
    )


def servable(observations: DataFrame) -> DataFrame:
    """Rows of observations(type, access, rights_mode, kind, passage_ids, known_passages) fit to serve."""
    return observations.where(
        (F.col("access") != "metadata_only")
        & (F.col("rights_mode") != "metadata_only")
        & ((F.col("type") != "academic") | (F.col("access") == "full_page"))
        & (F.col("kind") != "incidental_mention")
        & F.arrays_overlap("passage_ids", "known_passages")
    )


def audit_candidates(candidates: DataFrame) -> DataFrame:
    """One row per proposed observation with its checks and the blocks of its document.

    candidates(target_id, source_text, admit, accessAssessment, document, films, observations).
    """
    abstract = (F.col("document.sourceType") == "academic") & (F.col("accessAssessment") != "full_text")
    rows = (
        candidates.withColumn("abstract", F.coalesce(abstract, F.lit(False)))
        .withColumn("normal_text", normalize_quote("source_text"))
        .select("target_id", "admit", "abstract", "normal_text", F.size("films").alias("films"), F.posexplode_outer("observations").alias("position", "o"))
    )
    quote = normalize_quote("o.anchorQuote")
    checked = rows.withColumn("quote", quote).select(
        "target_id",
        "admit",
        "abstract",
        "position",
        "o",
        F.coalesce((F.col("quote") != "") & F.contains("normal_text", "quote"), F.lit(False)).alias("quote_matched"),
        word_count("o.anchorQuote").alias("quote_words"),
        F.coalesce(
            (F.size("o.filmIndexes") > 0) & F.forall("o.filmIndexes", lambda i: (i >= 0) & (i < F.col("films"))),
            F.lit(False),
        ).alias("indexes_valid"),
    )
    relational = F.col("o.kind").isin(RELATIONAL)
    # Written once: texts are normalised for the blocks and for the rows alike, and what is left of them is small.
    judged = cut(checked).withColumn(
        "eligible",
        F.col("admit")
        & ~F.col("abstract")
        & (F.col("o.kind") != "incidental_mention")
        & (F.col("o.confidence") >= 0.5)
        & F.col("quote_matched")
        & (F.col("quote_words") <= ANCHOR_WORDS)
        & F.col("indexes_valid")
        & (~relational | (F.size(F.array_distinct("o.filmIndexes")) >= 2)),
    )
    has = F.col("o").isNotNull()
    blocks = judged.groupBy("target_id").agg(
        F.array_compact(
            F.array(
                F.when(F.bool_or("abstract"), "academic_without_full_text"),
                F.when(F.bool_or(has & ~F.col("quote_matched")), "quote_not_found"),
                F.when(F.bool_or(has & (F.col("quote_words") > ANCHOR_WORDS)), "quote_over_20_words"),
                F.when(F.bool_or(has & ~F.col("indexes_valid")), "invalid_film_reference"),
            )
        ).alias("blocks")
    )
    return judged.join(blocks, "target_id")


FILM_ID = r"^(?:tmdb:[1-9]\d*|wd:Q[1-9]\d*|[a-z][a-z0-9-]*)$"
INTENTS = ["initial", "follow", "manual", "regenerate"]


def request_errors() -> Column:
    """Broken rules of a recommendation request row."""

    def bad_ids(name: str, low: int, high: int) -> Column:
        items = F.col(name)
        return (
            items.isNull()
            | ~F.coalesce(F.size(items), F.lit(0)).between(low, high)
            | _any(items, lambda i: ~F.coalesce(i.rlike(FILM_ID) & (F.length(i) <= 100), F.lit(False)))
        )

    path = F.concat("seeds", "trail")
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(F.length("request_id"), F.lit(0)).between(1, 100), "request_id"),
            F.when(bad_ids("seeds", 1, 8), "seeds"),
            F.when(bad_ids("trail", 0, 30), "trail"),
            F.when(bad_ids("previous_ids", 0, 12), "previous_ids"),
            F.when(bad_ids("seen_ids", 0, 5000), "seen_ids"),
            F.when(_outside(F.col("language"), ["en", "ko"]), "language"),
            F.when(_outside(F.col("intent"), INTENTS), "intent"),
            F.when(F.coalesce(F.size(F.array_distinct(path)) != F.size(path), F.lit(False)), "repeated_film"),
        )
    )


def fresh_evidence(packets: DataFrame, current: DataFrame, now) -> DataFrame:
    """Packets(packet_id, issued, source_type, access, document_id, document_version) that still hold.

    Issued within 30 days and not more than a minute ahead; academic sources in full text; every cited
    version is the active one of current(document_id, version_id).
    """
    moment = F.lit(now)
    joined = join_back(
        packets, current.select("document_id", F.col("version_id").alias("active")), ["document_id"], "left"
    )
    in_time = F.col("issued").between(moment - F.expr("interval 30 days"), moment + F.expr("interval 60 seconds"))
    full = (F.col("source_type") != "academic") | F.col("access").isin("full_page", "full_text")
    active = F.col("document_id").isNull() | F.col("document_version").eqNullSafe(F.col("active"))
    return joined.groupBy("packet_id").agg(F.bool_and(in_time & full & active).alias("fresh"))


def recommendation_errors() -> Column:
    """Evidence rules of a recommendation row (connections, source_ids)."""
    inferred = F.lit("ai_inference")
    return F.array_compact(
        F.array(
            F.when(F.coalesce(F.size("connections"), F.lit(0)) <= 0, "no_connection"),
            F.when(
                _any("connections", lambda c: (c["relation"] == inferred) != (F.size(c["sourceIds"]) == 0)),
                "relation_evidence",
            ),
            F.when(
                _any("connections", lambda c: F.size(F.array_except(c["sourceIds"], F.col("source_ids"))) > 0),
                "unlisted_source",
            ),
            F.when(
                F.forall("connections", lambda c: c["relation"] == inferred) & (F.size("source_ids") > 0),
                "evidence_on_inference",
            ),
        )
    )


def snapshot_errors() -> Column:
    """Integrity of a saved snapshot row (seeds, trail, sources, recommendations)."""
    path = F.concat("seeds", "trail")
    return F.array_compact(
        F.array(
            F.when(F.size(F.array_distinct(path)) != F.size(path), "repeated_film"),
            F.when(_any("recommendations", lambda r: F.array_contains(path, r["film_id"])), "self_recommendation"),
            F.when(
                _any("recommendations", lambda r: F.size(F.array_except(r["source_ids"], F.col("sources"))) > 0)
                | _any("recommendations", lambda r: _any(r["connections"], lambda c: F.size(F.array_except(c["sourceIds"], F.col("sources"))) > 0)),
                "unknown_source",
            ),
            F.when(
                _any("recommendations", lambda r: _any(r["connections"], lambda c: ~F.array_contains(path, c["anchorId"]))),
                "unknown_anchor",
            ),
        )
    )
