"""Bulk provider dumps as entity tables, and metadata enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import clean_text, plot_excerpt
from ..functions.urls import poster_url
from ..session import cut

# Entity classes that are films, alias count, image size, default year.
FILM_TYPES = [
    "Q11424", "Q24862", "Q24869", "Q202866", "Q506240", "Q20667187", "Q29168811", "Q226730", "Q17517379", "Q93204",
]
MAX_ALIASES = 80
IMAGE_ROOT = "https://image.tmdb.org/t/p/w500"
DEFAULT_YEAR = 1900

ENTITY = (
    "id string, labels map<string,struct<value:string>>, aliases map<string,array<struct<value:string>>>, "
    "claims map<string,array<struct<rank:string,mainsnak:struct<datavalue:struct<value:variant>>>>>, "
    "sitelinks map<string,struct<title:string>>"
)
MOVIE = (
    "id bigint, title string, original_title string, release_date string, poster_path string, original_language string, "
    "overview string, runtime int, credits struct<crew:array<struct<job:string,name:string>>>, "
    "translations struct<translations:array<struct<iso_639_1:string,data:struct<title:string,overview:string>>>>, "
    "alternative_titles struct<titles:array<struct<title:string>>>, genres array<struct<id:string>>, "
    "production_countries array<struct<name:string>>"
)


def _claims(name: str, field: str) -> Column:
    """Values of a field over a property's claims that are not deprecated."""
    live = F.filter(F.try_element_at("claims", F.lit(name)), lambda c: F.coalesce(c["rank"], F.lit("")) != "deprecated")
    values = F.transform(live, lambda c: F.try_variant_get(c["mainsnak"]["datavalue"]["value"], f"$.{field}", "string"))
    return F.coalesce(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))


def _label(language: str) -> Column:
    return F.try_element_at("labels", F.lit(language))["value"]


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def entity_films(raw: DataFrame) -> DataFrame:
    """raw(body) JSON entities as films; directors and countries take the labels of the same dump."""
    # Parsed once; the films and both label joins read the parsed rows.
    parsed = cut(raw.select(F.from_json("body", ENTITY).alias("e")).select("e.*").where("id IS NOT NULL"))
    stated = F.transform(_claims("P577", "time"), lambda t: F.substring(t, 2, 4).try_cast("int"))
    years = F.filter(stated, lambda y: y.isNotNull() & (y > 1850) & (y < 2200))
    korean = _label("ko")
    original = _first(_claims("P1476", "text"))
    films = (
        parsed.withColumn("years", years)
        .where(F.arrays_overlap(_claims("P31", "id"), F.array(*[F.lit(t) for t in FILM_TYPES])) & (F.size("years") > 0))
        .select(
            F.concat(F.lit("wd:"), "id").alias("film_id"),
            F.col("id").alias("authority_id"),
            F.coalesce(_label("en"), _label("mul"), original, korean, "id").alias("title"),
            korean.alias("title_ko"),
            original.alias("original_title"),
            F.array_min("years").alias("year"),
            F.transform(
                F.concat(
                    F.coalesce(F.try_element_at("aliases", F.lit("en")), F.array().cast("array<struct<value:string>>")),
                    F.coalesce(F.try_element_at("aliases", F.lit("mul")), F.array().cast("array<struct<value:string>>")),
                ),
                lambda a: a["value"],
            ).alias("aliases"),
            _claims("P136", "id").alias("genres"),
            F.try_element_at("sitelinks", F.lit("enwiki"))["title"].alias("wiki_en"),
            F.try_element_at("sitelinks", F.lit("kowiki"))["title"].alias("wiki_ko"),
            _claims("P57", "id").alias("director_ids"),
            _claims("P495", "id").alias("country_ids"),
        )
    )
    labels = parsed.select(F.col("id").alias("ref"), _label("en").alias("en"), F.coalesce(_label("en"), _label("mul")).alias("any"))

    def named(column: str, label: str, separator: str, out: str) -> DataFrame:
        refs = films.select("film_id", F.posexplode(column).alias("at", "ref"))
        return (
            refs.join(labels.select("ref", F.col(label).alias("name")), "ref")
            .where("name != ''")
            .groupBy("film_id")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda r: r["name"]), separator).alias(out))
        )

    return (
        films.join(named("director_ids", "any", ", ", "director"), "film_id", "left")
        .join(named("country_ids", "en", " / ", "country"), "film_id", "left")
        .withColumn("director", F.coalesce("director", F.lit("")))
        .drop("director_ids", "country_ids")
    )


def provider_films(raw: DataFrame) -> DataFrame:
    """raw(body) JSON movies as films; the Korean title falls back to a Korean original title."""
    m = raw.select(F.from_json("body", MOVIE).alias("m")).select("m.*").where("id IS NOT NULL")
    korean = _first(F.filter("translations.translations", lambda t: t["iso_639_1"] == "ko"))["data"]
    crew = F.filter("credits.crew", lambda c: (c["job"] == "Director") & (c["name"] != ""))
    names = F.transform("alternative_titles.titles", lambda t: F.trim(F.coalesce(t["title"], F.lit(""))))
    aliases = F.slice(F.array_distinct(F.filter(names, lambda n: n != "")), 1, MAX_ALIASES)
    empty = F.array().cast("array<string>")

    def text(value) -> Column:
        return F.when(value != "", value)

    return m.select(
        F.concat(F.lit("tmdb:"), F.col("id").cast("string")).alias("film_id"),
        F.coalesce(text(F.col("title")), F.col("original_title"), F.lit("")).alias("title"),
        F.coalesce(
            text(korean["title"]), text(F.when(F.col("original_language") == "ko", F.col("original_title")))
        ).alias("title_ko"),
        text(F.col("original_title")).alias("original_title"),
        F.coalesce(F.nullif(F.left("release_date", F.lit(4)).try_cast("int"), F.lit(0)), F.lit(DEFAULT_YEAR)).alias("year"),
        F.array_join(F.coalesce(F.transform(crew, lambda c: c["name"]), empty), ", ").alias("director"),
        F.when(F.col("poster_path") != "", F.concat(F.lit(IMAGE_ROOT), "poster_path")).otherwise("").alias("poster"),
        F.coalesce(aliases, empty).alias("aliases"),
        text(F.col("overview")).alias("overview_en"),
        text(korean["overview"]).alias("overview_ko"),
        F.coalesce(F.transform("genres", lambda g: g["id"]), empty).alias("genres"),
        F.array_join(F.coalesce(F.filter(F.transform("production_countries", lambda c: c["name"]), lambda n: n != ""), empty), " / ").alias("country"),
        "runtime",
    )


def enrich_from_pages(films: DataFrame, pages: DataFrame) -> DataFrame:
    """films(film_id, authority_id, wiki_title, poster, ...) with the page that maps back to them.

    pages(title, item, extract, page_image, thumbnail). A page of another entity changes nothing.
    """
    usable = pages.where("item IS NOT NULL").select(
        F.col("title").alias("wiki_title"),
        F.col("item").alias("authority_id"),
        plot_excerpt("extract").alias("synopsis"),
        F.left(clean_text(F.split(F.coalesce("extract", F.lit("")), "\n==")[0]), F.lit(1000)).alias("intro"),
        F.when(
            ~F.lower(F.coalesce("page_image", F.lit(""))).rlike("logo|portrait|director|signature"), F.col("thumbnail")
        ).alias("image"),
    )
    return films.join(usable, ["wiki_title", "authority_id"], "left").select(
        *[c for c in films.columns if c != "poster"],
        F.coalesce(F.when(F.col("poster") != "", F.col("poster")), F.col("image"), F.lit("")).alias("poster"),
        F.col("intro").alias("overview"),
        F.when(F.col("synopsis") != "", F.col("synopsis")).alias("synopsis"),
    )


def merge_presentation(selected: DataFrame, details: DataFrame) -> DataFrame:
    """Details win, but the chosen poster and a known Korean title stay; films(film_id, title_ko, poster, ...)."""
    chosen = selected.select("film_id", F.col("title_ko").alias("own_ko"), F.col("poster").alias("own_poster"))
    rest = [c for c in details.columns if c not in ("title_ko", "poster")]
    return chosen.join(details, "film_id").select(
        *rest,
        F.coalesce(F.when(F.col("title_ko") != "", F.col("title_ko")), F.col("own_ko")).alias("title_ko"),
        F.coalesce(F.nullif(poster_url("own_poster"), F.lit("")), poster_url("poster"), F.lit("")).alias("poster"),
    )
