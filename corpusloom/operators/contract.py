"""Checks and repairs of twelve-slot model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import identity_text
from ..functions.urls import https_url
from ..session import dealt, join_back

# List length and the one-letter attribution codes of the wire form.
SLOTS = 12
ATTRIBUTIONS = {"x": "source_explicit", "s": "source_supported_interpretation", "m": "model_proposal"}


def pick(values, indexes) -> Column:
    """Elements at zero-based indexes, those out of range dropped."""
    items = F.col(values) if isinstance(values, str) else values
    return F.filter(
        F.transform(F.filter(indexes, lambda i: i >= 0), lambda i: F.try_element_at(items, (i + 1).cast("int"))),
        lambda v: v.isNotNull(),
    )


def decode_wire(wire: DataFrame) -> DataFrame:
    """wire(request_id, anchors, passages, r array<struct<t,y,d,a,b,e,k>>) as one row per slot.

    A model proposal keeps no evidence, and a sourced label without evidence becomes a proposal.
    """
    rows = wire.select("request_id", "anchors", "passages", F.posexplode("r").alias("at", "p"))
    cited = pick("passages", F.col("p.e"))
    proposal = (F.col("p.k") == "m") | (F.size(cited) == 0)
    label = F
    for code, name in ATTRIBUTIONS.items():
        label = label.when(F.col("p.k") == code, name)
    return rows.select(
        "request_id",
        (F.col("at") + 1).alias("slot"),
        F.col("p.t").alias("title"),
        F.col("p.y").alias("year"),
        F.col("p.d").alias("director"),
        F.col("p.b").alias("connection"),
        F.array_distinct(pick("anchors", F.col("p.a"))).alias("anchor_ids"),
        F.when(proposal, F.array().cast("array<string>")).otherwise(cited).alias("evidence_ids"),
        F.when(proposal, "model_proposal").otherwise(label).alias("attribution"),
    )


def downgrade(slots: DataFrame, passages: DataFrame) -> DataFrame:
    """`source_explicit` holds only with a literal passage that names the film and covers an anchor.

    passages(request_id, passage_id, content_kind, observation, title, excerpt, subjects, film_ids).
    """
    text = identity_text(F.concat_ws(" ", "p_title", "excerpt", F.concat_ws(" ", "subjects")))
    claims = slots.where(F.col("attribution") == "source_explicit").select(
        "request_id", "slot", "anchor_ids", identity_text("title").alias("name"), F.explode("evidence_ids").alias("passage_id")
    )
    literal = (
        claims.join(passages.withColumnRenamed("title", "p_title"), ["request_id", "passage_id"])
        .withColumn("text", text)
        .where(
            (F.col("content_kind") == "exact_passage")
            & (F.coalesce("observation", F.lit("")) == "")
            & F.contains("text", "name")
            & F.arrays_overlap("anchor_ids", "film_ids")
        )
        .select("request_id", "slot")
        .distinct()
        .withColumn("literal", F.lit(True))
    )
    kept = F.when(
        (F.col("attribution") == "source_explicit") & F.col("literal").isNull(), "source_supported_interpretation"
    ).otherwise(F.col("attribution"))
    return slots.join(literal, ["request_id", "slot"], "left").withColumn("attribution", kept).drop("literal")


def output_violations(slots: DataFrame, anchors: DataFrame, passages: DataFrame) -> DataFrame:
    """(request_id, rule) for every broken contract rule of a request.

    anchors(request_id, anchor_id), passages(request_id, passage_id).
    """
    rows = slots.count()
    cited = dealt(slots.select("request_id", F.explode("evidence_ids").alias("passage_id")), rows, "request_id", "passage_id")
    used = dealt(slots.select("request_id", F.explode("anchor_ids").alias("anchor_id")), rows, "request_id", "anchor_id").distinct()
    anchors = dealt(anchors.select("request_id", "anchor_id"), rows, "request_id", "anchor_id")
    passages = dealt(passages.select("request_id", "passage_id"), rows, "request_id", "passage_id")
    sourced = F.size("evidence_ids") > 0
    proposal = F.col("attribution") == "model_proposal"
    counts = slots.groupBy("request_id").agg(F.count("*").alias("n"))
    parts = [
        counts.where(F.col("n") != SLOTS).select("request_id", F.lit("slot_count").alias("rule")),
        used.join(anchors, ["request_id", "anchor_id"], "left_anti").select("request_id", F.lit("unknown_anchor").alias("rule")),
        cited.join(passages, ["request_id", "passage_id"], "left_anti").select("request_id", F.lit("unknown_evidence").alias("rule")),
        slots.where(proposal & sourced).select("request_id", F.lit("proposal_has_evidence").alias("rule")),
        slots.where(~proposal & ~sourced).select("request_id", F.lit("sourced_lacks_evidence").alias("rule")),
        anchors.join(used, ["request_id", "anchor_id"], "left_anti").select("request_id", F.lit("incomplete_set_reading").alias("rule")),
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out.distinct()


def slot_verdicts(slots: DataFrame, excluded: DataFrame) -> DataFrame:
    """slots(request_id, slot, film_id or null) as unresolved, excluded, duplicate or accepted.

    The first slot of a film that may be shown is accepted. It is found by a minimum per film, which
    is reduced before it is moved, rather than by ordering a request's slots.
    """
    banned = excluded.select("request_id", "film_id").distinct().withColumn("banned", F.lit(True))
    marked = join_back(slots, banned, ["request_id", "film_id"], "left")
    open_slots = marked.where(F.col("film_id").isNotNull() & F.col("banned").isNull())
    first = open_slots.groupBy("request_id", "film_id").agg(F.min("slot").alias("first_slot"))
    return join_back(marked, first, ["request_id", "film_id"], "left").withColumn(
        "verdict",
        F.when(F.col("film_id").isNull(), "unresolved")
        .when(F.col("banned"), "excluded")
        .when(F.col("slot") == F.col("first_slot"), "accepted")
        .otherwise("duplicate"),
    ).drop("banned", "first_slot")


def resolution_counts(judged: DataFrame) -> DataFrame:
    """Accepted slots, invalid slots and lost anchors of every request: judged(..., anchor_ids, verdict)."""
    accepted = judged.where("verdict = 'accepted'")
    kept = accepted.select("request_id", F.explode("anchor_ids").alias("anchor_id")).distinct()
    meant = judged.select("request_id", F.explode("anchor_ids").alias("anchor_id")).distinct()
    lost = meant.join(kept, ["request_id", "anchor_id"], "left_anti").groupBy("request_id").agg(F.sort_array(F.collect_set("anchor_id")).alias("missing_anchors"))
    counts = judged.groupBy("request_id").agg(
        F.count_if(F.col("verdict") == "accepted").alias("accepted"),
        F.sort_array(F.collect_set(F.when(F.col("verdict") != "accepted", F.col("slot")))).alias("invalid_slots"),
    )
    return counts.join(lost, "request_id", "left")


def resolution_failures(judged: DataFrame, wanted: int = SLOTS) -> DataFrame:
    """Requests whose accepted slots are not `wanted` or lose an anchor."""
    return resolution_counts(judged).where((F.col("accepted") != wanted) | F.col("missing_anchors").isNotNull())


def apply_repairs(slots: DataFrame, failed: DataFrame, fixes: DataFrame) -> DataFrame:
    """Replace failed(request_id, slot) in slot order by fixes(request_id, position, ...).

    Replaced slots lose their evidence; the others stay as they are.
    """
    order = F.row_number().over(W.partitionBy("request_id").orderBy("slot"))
    numbered = failed.select("request_id", "slot").distinct().withColumn("position", order)
    named = [c for c in fixes.columns if c not in ("request_id", "position")]
    patch = numbered.join(fixes, ["request_id", "position"]).select("request_id", "slot", F.struct(*named).alias("fix"))
    joined = slots.join(patch, ["request_id", "slot"], "left")
    replaced = F.col("fix").isNotNull()
    out = joined
    for name in named:
        out = out.withColumn(name, F.when(replaced, F.col(f"fix.{name}")).otherwise(F.col(name)))
    return (
        out.withColumn("evidence_ids", F.when(replaced, F.array().cast("array<string>")).otherwise(F.col("evidence_ids")))
        .withColumn("attribution", F.when(replaced, "model_proposal").otherwise(F.col("attribution")))
        .drop("fix")
    )


def connections(slots: DataFrame, passages: DataFrame) -> DataFrame:
    """One row per (slot, anchor): evidence-mentioned anchors first, then by id.

    The first carries the slot's relation and evidence, the others are inferences.
    """
    mentioned = (
        slots.select("request_id", "slot", F.explode("evidence_ids").alias("passage_id"))
        .join(passages.select("request_id", "passage_id", "film_ids"), ["request_id", "passage_id"])
        .groupBy("request_id", "slot")
        .agg(F.array_distinct(F.flatten(F.collect_list("film_ids"))).alias("mentioned"))
    )
    sourced = (F.size("evidence_ids") > 0) & (F.col("attribution") != "model_proposal")
    relation = (
        F.when(~sourced, "ai_inference")
        .when(F.col("attribution") == "source_explicit", "direct_connection")
        .otherwise("grounded_interpretation")
    )
    ordered = F.array_sort(
        F.transform(
            F.array_distinct("anchor_ids"),
            lambda a: F.struct((~F.coalesce(F.array_contains("mentioned", a), F.lit(False))).alias("unmentioned"), a.alias("id")),
        )
    )
    rows = slots.join(mentioned, ["request_id", "slot"], "left").select(
        "request_id", "slot", "connection", relation.alias("primary"), F.when(sourced, F.col("evidence_ids")).alias("cited"),
        F.posexplode(ordered).alias("at", "anchor"),
    )
    first = F.col("at") == 0
    return rows.select(
        "request_id",
        "slot",
        F.col("at").alias("position"),
        F.col("anchor.id").alias("anchor_id"),
        F.when(first, F.col("primary")).otherwise("ai_inference").alias("relation"),
        F.when(first, F.coalesce("cited", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("source_ids"),
        "connection",
    )


def used_sources(cards: DataFrame, linked: DataFrame) -> DataFrame:
    """Source cards (request_id, passage_id, ...) that some connection cites."""
    used = linked.select("request_id", F.explode("source_ids").alias("passage_id")).distinct()
    return cards.join(used, ["request_id", "passage_id"], "left_semi")


def source_card(passages: DataFrame) -> DataFrame:
    """Passages as display cards: type, scope, excerpt and access, dates cut to days."""
    exact = (F.col("content_kind") == "exact_passage") & (F.col("rights") != "link_and_metadata_only")
    programme = F.col("type").isin("programme", "festival")
    access = F.coalesce(
        "access_level",
        F.when(F.col("rights") == "link_and_metadata_only", "link_and_metadata_only").when(F.col("type") == "academic", "abstract").otherwise("full_text"),
    )
    return passages.withColumn("url", https_url("url")).where("url IS NOT NULL").select(
        F.concat(F.lit("context:"), "passage_id").alias("source_id"),
        "title",
        "url",
        F.when(F.col("type") == "programme", "festival").otherwise(F.col("type")).alias("type"),
        F.when(programme, "programme_context").otherwise("interpretive_context").alias("scope"),
        F.coalesce("observation", F.when(exact, "A located passage used as limited source context for this route.").otherwise(F.col("excerpt"))).alias("summary"),
        F.when(exact, F.col("excerpt")).alias("excerpt"),
        access.alias("access_level"),
        F.left(F.coalesce("checked_at", "built_at"), F.lit(10)).alias("verified_on"),
    )


def withdraw_evidence(snapshots: DataFrame, links: DataFrame, eligible: DataFrame) -> DataFrame:
    """Connections after ineligible sources are withdrawn.

    snapshots(snapshot_id, historical), links(snapshot_id, film_id, anchor_id, relation, source_id),
    eligible(source_id). A connection without sources becomes an inference; a direct one becomes an
    interpretation when the snapshot is historical or its film lost a source.
    """
    kept = links.join(eligible.select("source_id").distinct().withColumn("ok", F.lit(True)), "source_id", "left")
    kept = dealt(kept, links.count(), "snapshot_id", "film_id")
    film = kept.groupBy("snapshot_id", "film_id").agg(F.bool_or(F.col("source_id").isNotNull() & F.col("ok").isNull()).alias("withdrew"))
    per = kept.groupBy("snapshot_id", "film_id", "anchor_id", "relation").agg(
        F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("source_id")))).alias("source_ids")
    )
    # Both answers are there before the snapshots are joined, so that sources move only if they are asked for.
    bare, direct = F.size("source_ids") == 0, F.col("relation") == "direct_connection"
    lowered = F.when(direct, "grounded_interpretation").otherwise(F.col("relation"))
    judged = per.join(film, ["snapshot_id", "film_id"]).select(
        "snapshot_id", "film_id", "anchor_id", "source_ids", F.when(bare, "ai_inference").when(F.col("withdrew"), lowered).otherwise(F.col("relation")).alias("now"),
        F.when(bare, "ai_inference").otherwise(lowered).alias("past"),
    )
    return (
        judged.join(snapshots, "snapshot_id")
        .withColumn("relation", F.when(F.col("historical"), F.col("past")).otherwise(F.col("now")))
        .drop("now", "past", "historical")
    )
