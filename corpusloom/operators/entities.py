"""Entity resolution: exact aliases, year bands, credits, staged lookups and merging by component."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import entity_key
from ..functions.text import credit_names, fold, identity_text, normalize_casefold, person_key, person_tokens, words
from ..session import cut, join_back

MAX_ROUNDS = 60


def title_forms(mentions: DataFrame) -> DataFrame:
    """mentions(mention_id, title, aliases, year, director) as (mention_id, alias, year, director)."""
    names = mentions.select(
        "mention_id",
        "year",
        "director",
        F.explode(F.array_distinct(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"),
    )
    return names.select(
        "mention_id",
        normalize_casefold("alias").alias("alias"),
        "year",
        normalize_casefold("director").alias("director"),
    ).distinct()


def resolve_mentions(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Exact (alias, year, director) match against aliases(key, alias, year, director).

    No key: `new`; one: `existing`; several: `ambiguous` (quarantined).
    """
    found = (
        title_forms(mentions)
        .join(aliases, ["alias", "year", "director"], "left")
        .groupBy("mention_id")
        .agg(F.count_distinct("key").alias("keys"), F.min("key").alias("first_key"))
    )
    return mentions.join(found, "mention_id").select(
        "mention_id",
        F.when(F.col("keys") == 0, "new").when(F.col("keys") == 1, "existing").otherwise("ambiguous").alias("status"),
        F.when(F.col("keys") == 1, F.col("first_key"))
        .when(F.col("keys") == 0, entity_key("title", "year", "director"))
        .alias("key"),
    )


def record_key_violations(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """Mentions that reuse a source key with another identity.

    mentions(mention_id, source_key, title, aliases, year, director);
    known(source_key, key, year, director, aliases) with normalised director and aliases.
    """
    named = mentions.select(
        "mention_id",
        "source_key",
        F.col("year").alias("new_year"),
        normalize_casefold("director").alias("new_director"),
    )
    forms = title_forms(mentions).groupBy("mention_id").agg(F.collect_set("alias").alias("forms"))
    prior = known.select("source_key", "year", "director", F.col("aliases").alias("known_aliases"))
    return (
        named.join(forms, "mention_id")
        .join(prior, "source_key")
        .withColumn(
            "reason",
            F.when((F.col("new_year") != F.col("year")) | (F.col("new_director") != F.col("director")), "identity")
            .when(~F.arrays_overlap("forms", "known_aliases"), "title"),
        )
        .where("reason IS NOT NULL")
        .select("mention_id", "source_key", "reason")
    )


def merge_external_ids(ids: DataFrame) -> DataFrame:
    """ids(key, provider, id): one id per (key, provider), `conflict` where several differ."""
    return ids.groupBy("key", "provider").agg(
        F.min("id").alias("id"), (F.count_distinct("id") > 1).alias("conflict")
    )


def registry_violations(registry: DataFrame, existing: DataFrame) -> DataFrame:
    """Registry rows against existing entities, and aliases that name two entities.

    Both sides: (key, title, aliases, year, director).
    """
    a = registry.select("key", F.col("year").alias("a_year"), normalize_casefold("director").alias("a_director"))
    b = existing.select("key", F.col("year").alias("b_year"), normalize_casefold("director").alias("b_director"))
    changed = a.join(b, "key").where(
        (F.col("a_year") != F.col("b_year")) | (F.col("a_director") != F.col("b_director"))
    )
    both = registry.unionByName(existing).withColumnRenamed("key", "mention_id")
    shared = (
        title_forms(both)
        .groupBy("alias", "year", "director")
        .agg(F.count_distinct("mention_id").alias("keys"), F.min("mention_id").alias("key"))
        .where("keys > 1")
    )
    return changed.select("key", F.lit("identity").alias("reason")).unionByName(
        shared.select("key", F.lit("ambiguous_alias").alias("reason"))
    )


def unique_matches(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(left, right) pairs reduced to the lefts with exactly one distinct right."""
    return (
        pairs.groupBy(left)
        .agg(F.min(right).alias(right), F.max(right).alias("_last"))
        .where(F.col(right) == F.col("_last"))
        .drop("_last")
    )


def match_by_authority(films: DataFrame, entities: DataFrame) -> DataFrame:
    """External ids first, all hits kept; else a unique alias within a year and the same person.

    films(film_id, title, year, director, authority_ids, aliases);
    entities(key, title, year, director, external_ids, aliases).
    """
    by_id = (
        films.select("film_id", F.explode("authority_ids").alias("ref"))
        .join(entities.select("key", F.explode("external_ids").alias("ref")), "ref")
        .select("film_id", "key")
        .distinct()
    )
    rest = films.join(by_id.select("film_id").distinct(), "film_id", "left_anti")

    def named(df: DataFrame, key: str) -> DataFrame:
        return df.select(
            key,
            "year",
            person_key("director").alias("person"),
            F.explode(F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"),
        ).select(key, "year", "person", identity_text("name").alias("name")).where("name != '' AND person != ''").distinct()

    hits = band_pairs(
        named(rest, "film_id"), named(entities, "key"), ["name", "person"], "film_id", "key", width=1
    )
    return by_id.withColumn("via", F.lit("authority")).unionByName(
        unique_matches(hits, "film_id", "key").withColumn("via", F.lit("alias"))
    )


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, width: int) -> DataFrame:
    """Smallest and largest right id per left row and year whose keys agree within `width` years.

    The right side is first reduced to one row per key and year, and its years are repeated over the
    band, so the join is an equality and its output never holds the pairs of a crowded key.
    """
    reduced = right.groupBy(*keys, "year").agg(F.min(right_id).alias("lo"), F.max(right_id).alias("hi"))
    band = reduced.select(
        *keys,
        F.explode(F.sequence(F.col("year") - width, F.col("year") + width)).alias("year"),
        "lo",
        "hi",
    )
    extremes = band.groupBy(*keys, "year").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return join_back(left, extremes, [*keys, "year"]).select(
        left_id, F.explode(F.array_distinct(F.array("lo", "hi"))).alias(right_id)
    )


def band_neighbours(rows: DataFrame, id_column: str, key: str, at: str, width: int) -> DataFrame:
    """Per row, how many others of its key lie within `width` steps, and the one when it is alone.

    Rows are counted per (key, step) first; only those counts are repeated over the band.
    """
    counted = rows.groupBy(key, at).agg(F.count("*").alias("n"), F.min(id_column).alias("lo"), F.max(id_column).alias("hi"))
    band = (
        counted.select(key, F.explode(F.sequence(F.col(at) - width, F.col(at) + width)).alias(at), "n", "lo", "hi")
        .groupBy(key, at)
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    return join_back(rows, band, [key, at]).select(
        id_column,
        (F.col("n") - 1).alias("others"),
        F.when(F.col("n") == 2, F.when(F.col(id_column) == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))).alias("only_other"),
    )


def _credit_keys(credits: DataFrame, id_column: str, left: bool) -> DataFrame:
    """(id, whole, match_key): a left and a right credit agree when they share a match key."""
    keyed = (
        credits.withColumn("whole", person_key("credit"))
        .where("whole != ''")
        .select(id_column, "whole", F.explode(credit_names("credit")).alias("name"))
        .select(id_column, "whole", person_key("name").alias("name"))
        .groupBy(id_column, "whole")
        .agg(F.sort_array(F.collect_set("name")).alias("names"))
    )
    single = F.size("names") == 1
    every = F.array(F.concat(F.lit("all:"), F.array_join("names", "|")))
    holds = F.transform("names", lambda n: F.concat(F.lit("holds:"), n))
    equals = F.transform("names", lambda n: F.concat(F.lit("is:"), n))
    if left:
        keys = F.when(single, holds).otherwise(F.concat(every, equals))
    else:
        keys = F.concat(holds, F.when(single, equals).otherwise(every))
    whole = F.array(F.concat(F.lit("whole:"), "whole"))
    return keyed.select(id_column, "whole", F.explode(F.concat(whole, keys)).alias("match_key"))


def credit_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """left(left_id, credit): number and smallest id of the agreeing right(right_id, credit) rows.

    Credits agree when their whole keys are equal, a single name is among the other's names, or two
    lists name the same people. The right side is counted per match key, and rows of an equal whole
    key, which agree twice, are counted off again; so no pairs are ever made.
    """
    rights = _credit_keys(right, "right_id", False)
    per_key = rights.groupBy("match_key").agg(F.count("*").alias("n"), F.min("right_id").alias("first"))
    twice = rights.where(~F.col("match_key").startswith("whole:")).groupBy("match_key", "whole").agg(F.count("*").alias("again"))
    lefts = _credit_keys(left, "left_id", True)
    agreed = join_back(join_back(lefts, per_key, ["match_key"]), twice, ["match_key", "whole"], "left")
    return agreed.groupBy("left_id").agg(
        F.sum(F.col("n") - F.coalesce("again", F.lit(0))).alias("matches"), F.min("first").alias("first_match")
    )


def person_keys(credit) -> Column:
    """Distinct person keys of a credit; its names are folded together and taken apart afterwards."""
    folded = F.transform(credit_names(fold(credit)), lambda n: F.array_join(F.array_sort(words(n)), " "))
    return F.array_distinct(folded)


def credits_agree(left, right) -> Column:
    """The pairwise predicate, for rows that an equality join has already brought together."""
    a, b = person_keys(left), person_keys(right)
    whole = person_key(left)
    names = (
        F.when(F.size(a) == 1, F.array_contains(b, F.element_at(a, 1)))
        .when(F.size(b) == 1, F.array_contains(a, F.element_at(b, 1)))
        .otherwise((F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0))
    )
    return F.coalesce((whole != "") & (person_key(right) != "") & ((whole == person_key(right)) | names), F.lit(False))


def tokens_agree(proposed, actual) -> Column:
    """Looser test: a shared name token of more than two characters, or no proposed credit."""
    mine = F.filter(person_tokens(proposed), lambda t: F.length(t) > 2)
    return F.coalesce(F.arrays_overlap(mine, person_tokens(actual)), F.lit(True))


def cascade(candidates: DataFrame, key: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Try the stages in turn on what is still unresolved.

    A stage maps candidates to (key, match_id) pairs; only candidates with one distinct match are
    resolved by it. The result names the stage, candidates without any match included.
    """
    rest, resolved = candidates, None
    for name, stage in stages:
        hits = cut(unique_matches(stage(rest), key, "match_id").withColumn("stage", F.lit(name)))
        resolved = hits if resolved is None else resolved.unionByName(hits)
        rest = rest.join(hits, key, "left_anti")
    return candidates.select(key).join(resolved, key, "left")


def canonicalize(rows: DataFrame, local: DataFrame) -> DataFrame:
    """rows(id, authority_id, ...) take the id of the local(id, authority_id) entity; then one per id."""
    first = local.where("authority_id IS NOT NULL").groupBy("authority_id").agg(F.min("id").alias("local_id"))
    return (
        join_back(rows, first, ["authority_id"], "left")
        .withColumn("id", F.coalesce("local_id", "id"))
        .drop("local_id")
        .dropDuplicates(["id"])
    )


def union_last_wins(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Per key the first position and the last row, over the parts in order."""
    joined = parts[0].withColumn("_part", F.lit(0))
    for at, other in enumerate(parts[1:], 1):
        joined = joined.unionByName(other.withColumn("_part", F.lit(at)))
    place = F.struct("_part", order)
    rest = [c for c in parts[0].columns if c != key]
    return (
        joined.groupBy(key)
        .agg(F.min(place).alias("_first"), F.max_by(F.struct(*rest), place).alias("_row"))
        .select(
            key,
            F.col("_first._part").alias("first_part"),
            F.col(f"_first.{order}").alias("first_" + order),
            *[F.col(f"_row.{c}").alias(c) for c in rest],
        )
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges(node, hub): label is the smallest node that is reachable over hubs.

    Labels pass from nodes to hubs and back, and each label is replaced by its own label, which halves
    the distance left. Hubs are reduced before they are joined, so a crowded hub moves one row.
    """
    links = cut(edges.select("node", "hub").distinct())
    labels = links.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(MAX_ROUNDS):
        labelled = links.join(labels, "node")
        lowest = labelled.groupBy("hub").agg(F.min("label").alias("hub_label"))
        step = (
            join_back(labelled, lowest, ["hub"])
            .groupBy("node")
            .agg(F.min("label").alias("old"), F.min("hub_label").alias("label"))
        )
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut(
            join_back(step, jump, ["label"], "left").select(
                "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
            )
        )
        labels = moved.select("node", "label")
        if moved.where("label < old").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def merge_entities(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Merge mentions that share an (alias, year, director); registry keys are fixed.

    A component without a registry key is a new entity, with one it is that entity, and with several
    it is quarantined. The outcome does not depend on the order of the input.
    """
    forms = title_forms(mentions).withColumn("hub", F.concat_ws("\u0001", "alias", "year", "director"))
    same = forms.groupBy("mention_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("hub")), "\u0002"), 256).alias("node"))
    keyed = cut(forms.join(same, "mention_id").select("mention_id", "node", "hub"))
    known = registry.select("key", F.concat_ws("\u0001", "alias", "year", "director").alias("hub")).distinct()
    anchored = known.select(F.concat(F.lit("~"), "key").alias("node"), "hub")
    labels = cut(components(keyed.select("node", "hub").distinct().unionByName(anchored)))
    owners = (
        labels.where(F.col("node").startswith("~"))
        .groupBy("label")
        .agg(F.count("*").alias("keys"), F.substring(F.min("node"), 2, 1_000_000).alias("owner"))
    )
    return (
        join_back(same.join(labels, "node"), owners, ["label"], "left")
        .select(
            "mention_id",
            F.col("label").alias("component"),
            F.when(F.col("keys") > 1, "quarantined").when(F.col("keys") == 1, "existing").otherwise("new").alias("status"),
            F.when(F.coalesce("keys", F.lit(0)) <= 1, F.coalesce("owner", F.concat(F.lit("film-"), F.substring("label", 1, 24)))).alias("key"),
        )
    )
