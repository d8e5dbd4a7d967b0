"""URL policy and canonical forms, as regular-expression columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col, nfkd

# Tracking parameters, reserved host endings, poster hosts.
TRACKING = r"(?i)^(?:utm_.+|fbclid|gclid|mc_cid|mc_eid)$"
RESERVED = r"(?:^|\.)(?:localhost|local|internal|test|invalid|example|nip\.io|sslip\.io)$"
POSTER_HOSTS = ["image.tmdb.org", "upload.wikimedia.org", "thumb.wikimedia.org"]

_SHAPE = r"(?i)^(https?)://([^/?#\s]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url, index: int) -> Column:
    return F.regexp_extract(_col(url), _SHAPE, index)


def scheme(url) -> Column:
    return F.lower(part(url, 1))


def host(url) -> Column:
    """Lower-case host without credentials and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", ""))


def path(url) -> Column:
    found = part(url, 3)
    return F.when(found == "", F.lit("/")).otherwise(found)


def _explicit_port(url) -> Column:
    default = F.when(scheme(url) == "https", ":443").otherwise(":80")
    found = F.regexp_extract(part(url, 2), r"(:\d+)$", 1)
    return (found != "") & (found != default)


def public_http(url) -> Column:
    """http(s) with a host and without credentials."""
    return F.coalesce(
        scheme(url).isin("http", "https") & (host(url) != "") & ~part(url, 2).contains("@"), F.lit(False)
    )


def url_allowed(url) -> Column:
    """https only; no credentials, port, IP address, dot-less or reserved host."""
    name = host(url)
    return F.coalesce(
        (scheme(url) == "https")
        & ~part(url, 2).contains("@")
        & ~_explicit_port(url)
        & name.contains(".")
        & ~name.startswith("[")
        & ~name.rlike(r"(?:^|\.)(?:\d+|0x[0-9a-f]*)\.?$")
        & ~name.rlike(RESERVED),
        F.lit(False),
    )


def poster_url(url) -> Column:
    local = _col(url).startswith("/posters/") & ~_col(url).contains("..")
    remote = (
        (scheme(url) == "https")
        & ~part(url, 2).contains("@")
        & ~_explicit_port(url)
        & host(url).isin(*POSTER_HOSTS)
    )
    return F.when(local | remote, _col(url)).otherwise(F.lit(""))


def https_url(url) -> Column:
    """The URL upgraded to https, or null when it is neither http nor https."""
    return F.when(scheme(url).isin("http", "https"), F.regexp_replace(_col(url), r"(?i)^https?:", "https:"))


def _parameters(url) -> Column:
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    named = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.substring_index(p, "=", 1).alias("name"),
            i.alias("at"),
            F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("raw"),
        ),
    )
    return F.filter(named, lambda p: ~p["name"].rlike(TRACKING))


def _query(parameters: Column) -> Column:
    text = F.array_join(F.transform(parameters, lambda p: p["raw"]), "&")
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text))


def canonical_url(url) -> Column:
    """Collection form: allowed https URLs only, parameters sorted by name, no trailing slash."""
    trail = path(url)
    trimmed = F.when(trail == "/", trail).otherwise(F.regexp_replace(trail, "/+$", ""))
    trimmed = F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
    return F.when(
        url_allowed(url),
        F.concat(F.lit("https://"), host(url), trimmed, _query(F.array_sort(_parameters(url)))),
    )


def published_url(url) -> Column:
    """Publication form: http stays http and parameters keep their order."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    trimmed = F.when(trimmed == "", F.lit("/")).otherwise(trimmed)
    return F.concat(scheme(url), F.lit("://"), F.lower(part(url, 2)), trimmed, _query(_parameters(url)))


def host_in(name, hosts) -> Column:
    """Host equal to, or a subdomain of, one of an array of hosts."""
    return F.exists(_col(hosts), lambda h: (_col(name) == h) | _col(name).endswith(F.concat(F.lit("."), h)))


def path_in(trail, prefixes) -> Column:
    return F.exists(_col(prefixes), lambda p: _col(trail).startswith(p))


def slug(text) -> Column:
    dashed = F.regexp_replace(F.lower(nfkd(_col(text))), "[^a-z0-9]+", "-")
    return F.left(F.regexp_replace(dashed, "^-|-$", ""), F.lit(110))


def target_id(family, url) -> Column:
    last = F.regexp_extract(path(url), r"([^/]+)/*$", 1)
    name = slug(F.when(last == "", F.lit("source")).otherwise(last))
    return F.concat_ws(
        "-",
        slug(family),
        F.when(name == "", F.lit("source")).otherwise(name),
        F.substring(F.sha2(_col(url), 256), 1, 10),
    )
