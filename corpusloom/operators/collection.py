"""Acquisition bookkeeping: policy, discovery, duplicate targets, page status, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import SPACE
from ..functions.urls import canonical_url, host, host_in, path, path_in, target_id
from ..session import cut, if_small, join_back, lookup

# Page limits, challenge wording, statuses that need no further work.
MAX_BYTES = 32_000_000
MIN_READABLE = 80
CHALLENGE = (
    "(?i)(?:just a moment|checking your browser|verify you are human|"
    "enable javascript and cookies to continue|access denied|attention required!.*cloudflare)"
)
TERMINAL = (
    "fetched duplicate_published duplicate_in_job duplicate_content policy_rejected invalid_target "
    "blocked http_error pdf_not_checked unsupported_content response_too_large unreadable"
).split()
SOURCE_TYPES = "criticism academic programme festival".split()
SLUG = "^[a-z0-9][a-z0-9._-]{2,159}$"


def allowed(canonical, hosts, prefixes) -> Column:
    """Whether a canonical URL is on a family host and below one of its path prefixes."""
    return F.coalesce(host_in(host(canonical), hosts) & path_in(path(canonical), prefixes), F.lit(False))


def first_claims(claims: DataFrame) -> DataFrame:
    """Targets (ordinal) that no earlier accepted target shares a URL with.

    claims(ordinal, url) holds one row per URL of a target. A rejected target claims nothing, so the
    answer is settled in rounds: whoever is first on all its URLs wins, and what it touches loses.
    With one URL per target a single round is the whole answer.
    """
    single = claims.groupBy("ordinal").count().where("count > 1").limit(1).count() == 0
    if single:
        return claims.groupBy("url").agg(F.min("ordinal").alias("ordinal")).select("ordinal")
    still, won = cut(claims), []
    while True:
        first = still.groupBy("url").agg(F.min("ordinal").alias("first"))
        winners = cut(
            join_back(still, first, ["url"])
            .groupBy("ordinal")
            .agg(F.bool_and(F.col("ordinal") == F.col("first")).alias("wins"))
            .where("wins")
            .select("ordinal")
        )
        won.append(winners)
        taken = still.join(winners, "ordinal", "left_semi").select("url").distinct()
        touched = join_back(still, taken, ["url"], "left_semi").select("ordinal").distinct()
        still = cut(still.join(touched, "ordinal", "left_anti"))
        if still.isEmpty():
            return reduce(DataFrame.unionByName, won)


def plan_collection(targets: DataFrame, families: DataFrame, published: DataFrame) -> DataFrame:
    """Status per target, tested in order: invalid, policy, published, repeated in the job, pending.

    targets(ordinal, target_id, family_id, url, text_url), families(family_id, hosts, prefixes, ...),
    published(url) with raw URLs.
    """
    fetch = F.coalesce("text_url", "url")
    judged = (
        targets.withColumn("canonical", canonical_url("url"))
        .withColumn("canonical_fetch", canonical_url(fetch))
        .join(if_small(families), "family_id", "left")
        .withColumn(
            "gate",
            F.when(F.col("canonical").isNull() | F.col("canonical_fetch").isNull(), "invalid_target").when(
                F.col("hosts").isNull()
                | ~allowed("canonical", "hosts", "prefixes")
                | ~allowed("canonical_fetch", "hosts", "prefixes"),
                "policy_rejected",
            ),
        )
    )
    urls = judged.where("gate IS NULL").select(
        "ordinal", F.explode(F.array_distinct(F.array("canonical", "canonical_fetch"))).alias("url")
    )
    known = published.select(canonical_url("url").alias("url")).where("url IS NOT NULL").distinct()
    seen = join_back(urls, known, ["url"], "left_semi").select("ordinal").distinct().withColumn("published", F.lit(True))
    fresh = urls.join(seen, "ordinal", "left_anti")
    accepted = first_claims(fresh).withColumn("accepted", F.lit(True))
    return (
        judged.join(seen, "ordinal", "left")
        .join(accepted, "ordinal", "left")
        .withColumn(
            "status",
            F.coalesce("gate", F.when(F.col("published"), "duplicate_published"))
        )
        .withColumn(
            "status",
            F.coalesce("status", F.when(F.col("accepted"), "pending").otherwise("duplicate_in_job")),
        )
        .drop("gate", "published", "accepted", "hosts", "prefixes")
    )


def page_status(text, content_type, http_status, size) -> Column:
    """Status of a fetched page; quotes are only checked on a readable one."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (
        F.when(http_status.isin(401, 403, 429), "blocked")
        .when(~http_status.between(200, 299), "http_error")
        .when(size > MAX_BYTES, "response_too_large")
        .when(kind.contains("application/pdf") & text.isNull(), "pdf_not_checked")
        .when(~(kind.contains("html") | kind.contains("text/plain") | kind.contains("application/pdf")), "unsupported_content")
        .when(text.rlike(CHALLENGE), "blocked")
        .when(F.length(F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")) < MIN_READABLE, "unreadable")
        .otherwise("readable")
    )


def first_content(pages: DataFrame) -> DataFrame:
    """pages(ordinal, text_hash) with the first ordinal of the same text, and a status."""
    first = pages.groupBy("text_hash").agg(F.min("ordinal").alias("first_ordinal"))
    return join_back(pages, first, ["text_hash"]).withColumn(
        "status",
        F.when(F.col("ordinal") == F.col("first_ordinal"), "fetched").otherwise("duplicate_content"),
    )


def discover(links: DataFrame, plan: DataFrame, families: DataFrame, published: DataFrame, target: int | None = None) -> DataFrame:
    """New targets per family, URL order, up to the family's quota and `target` in all, if given.

    links(family_id, url); plan(position, family_id, include, quota), or `share` in place of the quota: the
    hundredths of its new links that a family may bring, so that it grows with them; families(family_id, hosts).
    A family never repeats a URL an earlier family selected; only families that share a host with an
    earlier one need that comparison.
    """
    limit = "share" if "share" in plan.columns else "quota"
    rules = families.join(plan, "family_id").select("position", "family_id", "hosts", "include", limit)
    known = published.select(canonical_url("url").alias("url")).where("url IS NOT NULL").distinct()
    listed = (
        links.join(if_small(rules), "family_id")
        .withColumn("url", canonical_url("url"))
        .where(host_in(host("url"), "hosts") & path_in(path("url"), "include"))
        .select("position", "family_id", limit, "url")
        .distinct()
        .join(known, "url", "left_anti")
    )
    if limit == "share":
        sizes = listed.groupBy("position").agg(F.ceil(F.max("share") * F.count("*") / 100).alias("quota"))
        listed = lookup(listed, sizes, ["position"])
    order = rules.orderBy("position").select("position", "hosts").collect()
    rank = F.row_number().over(W.partitionBy("position").orderBy("url"))

    def related(a: list[str], b: list[str]) -> bool:
        return any(x == y or x.endswith("." + y) or y.endswith("." + x) for x in a for y in b)

    clashing = {
        row.position
        for at, row in enumerate(order)
        if any(related(row.hosts, earlier.hosts) for earlier in order[:at])
    }
    alone = listed.where(~F.col("position").isin(clashing)) if clashing else listed
    chosen = alone.withColumn("place", rank).where("place <= quota")
    for position in sorted(clashing):
        own = listed.where(F.col("position") == position).join(
            chosen.where(F.col("position") < position).select("url"), "url", "left_anti"
        )
        chosen = chosen.unionByName(own.withColumn("place", rank).where("place <= quota"))
    chosen = chosen if target is None else chosen.orderBy("position", "url").limit(target)
    return chosen.select("family_id", "url", target_id("family_id", "url").alias("target_id"))


def listing_pages(plan: DataFrame) -> DataFrame:
    """Listing URLs of plan(family_id, seeds, page_start, page_end), `{page}` filled in."""
    start = F.coalesce("page_start", F.lit(1))
    return plan.select(
        "family_id",
        F.explode("seeds").alias("seed"),
        F.sequence(start, F.coalesce("page_end", "page_start", F.lit(1))).alias("pages"),
    ).select(
        "family_id",
        F.explode("pages").alias("page"),
        F.replace("seed", F.lit("{page}"), F.col("page").cast("string")).alias("url"),
    )


def status_counts(items: DataFrame, *by: str) -> DataFrame:
    return items.groupBy(*by, "status").agg(F.count("*").alias("items"))


def manifest(items: DataFrame) -> DataFrame:
    """One row: item count, whether all are in a terminal status, and the counts per status."""
    counts = status_counts(items)
    return counts.agg(
        F.sum("items").alias("items"),
        F.bool_and(F.col("status").isin(TERMINAL)).alias("complete"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "items")))).alias("counts"),
    )


def family_errors() -> Column:
    """Rule column over families(id, publisher, hosts, prefixes, type, language, note, pace_ms, min_chars)."""
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("id").rlike(SLUG), F.lit(False)), "id"),
            F.when(F.trim(F.coalesce("publisher", F.lit(""))) == "", "publisher"),
            F.when(
                (F.coalesce(F.size("hosts"), F.lit(0)) <= 0)
                | F.exists("hosts", lambda h: ~h.rlike("^[a-z0-9.-]+$")),
                "hosts",
            ),
            F.when(
                (F.coalesce(F.size("prefixes"), F.lit(0)) <= 0) | F.exists("prefixes", lambda p: ~p.startswith("/")),
                "prefixes",
            ),
            F.when(~F.coalesce(F.col("type").isin(SOURCE_TYPES), F.lit(False)), "type"),
            F.when(F.trim(F.coalesce("language", F.lit(""))) == "", "language"),
            F.when(F.trim(F.coalesce("note", F.lit(""))) == "", "rights"),
            F.when(F.coalesce(F.col("pace_ms"), F.lit(-1)) < 0, "pace"),
            F.when(F.coalesce(F.col("min_chars"), F.lit(0)) < MIN_READABLE, "min_chars"),
        )
    )


def _repeats(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg((F.count("*") > 1).alias("repeated"))


def validate_families(families: DataFrame) -> DataFrame:
    """Families with their broken rules; a registry is valid when every list is empty."""
    return (
        join_back(families, _repeats(families, "id"), ["id"])
        .withColumn("errors", F.concat(family_errors(), F.when(F.col("repeated"), F.array(F.lit("repeated"))).otherwise(F.array().cast("array<string>"))))
        .drop("repeated")
    )


def validate_targets(targets: DataFrame) -> DataFrame:
    """Targets(id, url, family_id, proposed_type, tags) with their broken rules."""
    rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("id").rlike(SLUG), F.lit(False)), "id"),
            F.when(F.col("repeated"), "repeated"),
            F.when(F.coalesce("url", F.lit("")) == "", "url"),
            F.when(F.coalesce("family_id", F.lit("")) == "", "family"),
            F.when(F.col("proposed_type").isNotNull() & ~F.col("proposed_type").isin(SOURCE_TYPES), "type"),
            F.when(F.exists("tags", lambda t: t.isNull() | (F.trim(t) == "")), "tags"),
        )
    )
    return join_back(targets, _repeats(targets, "id"), ["id"]).withColumn("errors", rules).drop("repeated")
