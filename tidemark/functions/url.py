"""Addresses as columns: canonical forms, sites and what a slug says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import text

#: Query parameters that do not tell vacancies apart, besides those that begin with utm_.
NOISE_PARAMETERS = ("lang", "hslang", "locale", "domain", "source", "src", "ref", "trk")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(text(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(text(url), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(text(url), r"^[^?#]*\?([^#]*)", 1)


def kept_query(url: Column) -> Column:
    """The query without noise parameters and parameters without a value, in order."""

    def tells(p: Column) -> Column:
        name = F.lower(F.substring_index(p, "=", 1))
        return p.rlike("^[^=]+=.*[^=]$") & ~name.isin(*NOISE_PARAMETERS) & ~name.startswith("utm_")

    pairs = F.filter(F.split(query(url), "&"), tells)
    return F.array_join(pairs, "&")


def job_address(url: Column) -> Column:
    """What tells one vacancy's address from another's: no scheme, fragment, trailing slash or noise parameters."""
    rest = F.concat(host(url), F.rtrim(path(url), F.lit("/")))
    q = kept_query(url)
    address = F.concat(F.when(host(url) != "", F.lit("//")).otherwise(F.lit("")), rest, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return address


def vacancy_of(company: Column, url: Column) -> Column:
    """An employer's vacancy whatever host shows it."""
    return F.concat(F.lower(text(company)), F.lit("|"), F.rtrim(path(url), F.lit("/")), F.lit("?"), kept_query(url))


#: The end of a host that names a site: two labels, or three where the second is a short one such as co or com.
_SITE = r"(?:^|\.)([^.:]+\.(?:ac|co|com|gov|net|org)\.[^.:]{2}|[^.:]+\.[^.:]+|[^.:]+)(?::\d+)?$"


def site(url: Column) -> Column:
    """The registrable domain."""
    return F.regexp_extract(host(url), _SITE, 1)


def same_site(a: Column, b: Column) -> Column:
    """Whether two addresses are of one site; addresses without a host are of none."""
    return F.coalesce(F.nullif(site(a), F.lit("")) == site(b), F.lit(False))


def slug_words(url: Column) -> Column:
    """The words of the last path segment that is not a number."""
    parts = F.filter(F.split(path(url), "/"), lambda p: (p != "") & ~p.rlike(r"^\d+$"))
    return F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"[-_+.]+", " ")


def from_slug(url: Column, places: tuple[str, ...]) -> Column:
    """struct<title, location> read off a slug: what stands before the first place is the title, the rest the location.

    Numbers of four digits or more at either end, and a page's file ending, belong to neither.
    """
    last = F.regexp_extract(F.rtrim(path(url), F.lit("/")), r"([^/]*)$", 1)
    words = F.filter(F.split(F.regexp_replace(last, r"\.[A-Za-z]{3,5}$", ""), "[-_]+"), lambda w: (w != "") & ~w.rlike(r"^\d{4,}$"))
    said = F.array_join(words, " ")
    usable = (F.length(said) >= 6) & said.rlike("[A-Za-z]") & (F.size(words) >= 2)
    at = F.regexp_instr(said, F.lit(r"(?i)(?<![^ ])(" + "|".join(places) + r")(?![^ ])"))
    title = F.trim(F.when(at > 0, F.substring(said, F.lit(1), at - 1)).otherwise(said))
    place = F.when(at > 0, F.substring(said, at, F.length(said))).otherwise("")
    return F.struct(
        F.when(usable & F.length(title).between(4, 90), F.initcap(title)).otherwise("").alias("title"),
        F.when(usable, F.initcap(place)).otherwise("").alias("location"),
    )
