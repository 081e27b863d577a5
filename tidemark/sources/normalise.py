"""Mappers from raw postings of each platform to the canonical posting.

A mapper is a set of columns over the variant ``raw``. Every address goes through
safe_url; ids are made of the raw title and the address before that guard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clean_title, iso_timestamp, posting_id, safe_url, strip_html, text
from tidemark.schema import POSTING_COLUMNS


def get(*paths: str) -> Column:
    """The first path that holds a text that is not empty."""
    found = [F.try_variant_get(F.col("raw"), p, "string") for p in paths]
    return F.coalesce(*[F.when(c != "", c) for c in found], F.lit(""))


def joined(*parts: Column, by: str = ", ") -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), by)


def names_of(path: str, field: str, by: str = ", ") -> Column:
    """The fields of an array of objects, joined."""
    rows = F.coalesce(F.try_variant_get(F.col("raw"), path, "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.array_join(F.filter(F.transform(rows, lambda r: F.try_variant_get(r, f"$.{field}", "string")), lambda s: text(s) != ""), by)


def salary_text(path: str = "$.baseSalary") -> Column:
    """A schema.org pay figure as text; empty if its shape is unknown."""
    money = lambda c: F.format_number(c, 0)
    number = lambda p: F.try_variant_get(F.col("raw"), p, "double")
    currency = F.upper(F.coalesce(F.try_variant_get(F.col("raw"), f"{path}.currency", "string"), F.lit("EUR")))
    sign = F.when(currency == "EUR", "€").when(currency == "GBP", "£").when(currency == "USD", "$").otherwise("")
    unit = F.lower(get(f"{path}.value.unitText"))
    per = F.when(unit == "year", "/yr").when(unit == "month", "/mo").when(unit == "week", "/wk").when(unit == "day", "/day").when(unit == "hour", "/hr").otherwise("")
    low, high = number(f"{path}.value.minValue"), number(f"{path}.value.maxValue")
    one = F.coalesce(F.when(low != 0, low), F.when(high != 0, high), number(f"{path}.value.value"))
    bare, value = number(path), number(f"{path}.value")
    return F.coalesce(
        money(bare), F.concat(sign, money(value)),
        F.when((low != 0) & (high != 0) & (low != high), F.concat(sign, money(low), F.lit("–"), sign, money(high), per)),
        F.concat(sign, money(one), per), F.lit(""),
    )


def _canonical(**parts: Column) -> dict[str, Column]:
    company = parts.get("company", F.col("company"))
    title, url = parts["title"], parts["url"]
    made = {c: F.lit("") for c in POSTING_COLUMNS} | parts
    made |= {"id": posting_id(company, title, url), "company": company, "title": clean_title(title), "url": safe_url(url), "source": parts.get("source", F.col("ats"))}
    return {c: text(made[c]) for c in POSTING_COLUMNS}


def _greenhouse() -> dict[str, Column]:
    return _canonical(
        title=get("$.title"), url=get("$.absolute_url"), location=get("$.location.name"), description=strip_html(get("$.content")),
        posted_at=iso_timestamp(get("$.updated_at", "$.first_published")), department=get("$.departments[0].name"),
    )


def _lever() -> dict[str, Column]:
    plain = get("$.descriptionPlain")
    sections = F.coalesce(F.try_variant_get(F.col("raw"), "$.lists", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    said = F.array_join(F.transform(sections, lambda s: F.concat(F.lit("\n\n"), text(F.try_variant_get(s, "$.text", "string")), F.lit("\n"), text(F.try_variant_get(s, "$.content", "string")))), "")
    return _canonical(
        title=get("$.text"), url=get("$.hostedUrl"), location=get("$.categories.location"),
        description=F.trim(F.concat(F.when(plain != "", plain).otherwise(strip_html(get("$.description"))), strip_html(said))),
        posted_at=iso_timestamp(get("$.createdAt")), department=get("$.categories.team", "$.categories.department"), employment_type=get("$.categories.commitment"),
    )


def _ashby() -> dict[str, Column]:
    rich = strip_html(get("$.descriptionHtml"))
    return _canonical(
        title=get("$.title"), url=get("$.jobUrl", "$.applyUrl"), location=get("$.location"), description=F.when(rich != "", rich).otherwise(get("$.descriptionPlain")),
        posted_at=iso_timestamp(get("$.publishedAt")), department=get("$.department", "$.team"), employment_type=get("$.employmentType"),
    )


def _workable() -> dict[str, Column]:
    place = joined(get("$.city", "$.locations[0].city", "$.state", "$.locations[0].region"), get("$.country", "$.locations[0].country"))
    return _canonical(
        title=get("$.title"), url=get("$.url", "$.application_url"), location=place, description=strip_html(get("$.description")),
        posted_at=iso_timestamp(get("$.published_on", "$.created_at")), department=get("$.department"), employment_type=get("$.employment_type"),
    )


def _smartrecruiters() -> dict[str, Column]:
    sections = joined(*[get(f"$.jobAd.sections.{s}.text") for s in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")], by="\n\n")
    # The board's token names its pages, not the employer's display name.
    url = F.coalesce(F.nullif(get("$.applyUrl"), F.lit("")), F.concat(F.lit("https://jobs.smartrecruiters.com/"), "token", F.lit("/"), get("$.id")))
    return _canonical(
        title=get("$.name"), url=url, location=joined(get("$.location.city"), get("$.location.country")), description=strip_html(sections),
        posted_at=iso_timestamp(get("$.releasedDate")), department=get("$.department.label"), employment_type=get("$.typeOfEmployment.label"),
    )


def _recruitee() -> dict[str, Column]:
    return _canonical(
        title=get("$.title"), url=get("$.careers_url", "$.careers_apply_url"), location=get("$.location", "$.city"),
        description=F.concat(strip_html(get("$.description")), F.lit("\n"), strip_html(get("$.requirements"))),
        posted_at=iso_timestamp(get("$.published_at", "$.created_at")), department=get("$.department"), employment_type=get("$.employment_type_code"),
    )


def _personio() -> dict[str, Column]:
    return _canonical(
        title=get("$.name"), url=F.concat(F.lit("https://"), "token", F.lit(".jobs.personio.de/job/"), get("$.id")), location=get("$.office"),
        description=strip_html(get("$._description")), posted_at=iso_timestamp(get("$.createdAt")), department=get("$.department"), employment_type=get("$.employmentType"),
    )


def _workday() -> dict[str, Column]:
    tenant, number, site = (F.split_part("token", F.lit("|"), F.lit(i)) for i in (1, 2, 3))
    url = F.concat(F.lit("https://"), tenant, F.lit(".wd"), number, F.lit(".myworkdayjobs.com/en-US/"), site, get("$.externalPath"))
    bullets = F.array_join(F.coalesce(F.try_variant_get(F.col("raw"), "$.bulletFields", "array<string>"), F.expr("cast(array() as array<string>)")), " ")
    full = get("$._description")
    return _canonical(
        title=get("$.title"), url=url, location=get("$.locationsText"), description=strip_html(F.when(full != "", full).otherwise(bullets)),
        posted_at=iso_timestamp(get("$.postedOn")),
    )


def _oraclecloud() -> dict[str, Column]:
    host, site = (F.split_part("token", F.lit("|"), F.lit(i)) for i in (1, 2))
    url = F.concat(F.lit("https://"), host, F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/"), get("$.Id"))
    return _canonical(
        title=get("$.Title"), url=url, location=joined(get("$.PrimaryLocation"), names_of("$.secondaryLocations", "Name")),
        description=strip_html(get("$.ExternalDescriptionStr", "$.ShortDescription")), posted_at=iso_timestamp(get("$.PostedDate")),
        department=get("$.JobFamily"), employment_type=get("$.WorkplaceType"),
    )


def _pinpoint() -> dict[str, Column]:
    both = lambda *names: get(*[f"$.attributes.{n}" for n in names], *[f"$.{n}" for n in names])
    return _canonical(
        title=both("title"), url=both("url"), location=both("location.name", "location"), description=strip_html(both("description")),
        posted_at=iso_timestamp(both("created_at")), department=both("department.name", "department"), employment_type=both("employment_type"),
    )


def _jsonld(source: str | None = None) -> dict[str, Column]:
    place = lambda p: joined(get(f"{p}.address.addressLocality"), get(f"{p}.address.addressRegion"), get(f"{p}.address.addressCountry"))
    places = F.coalesce(F.try_variant_get(F.col("raw"), "$.jobLocation", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    part = lambda v, n: text(F.try_variant_get(v, f"$.address.{n}", "string"))
    listed = F.array_join(F.filter(F.transform(places, lambda v: joined(part(v, "addressLocality"), part(v, "addressRegion"), part(v, "addressCountry"))), lambda s: s != ""), ", ")
    stated = F.coalesce(
        F.nullif(listed, F.lit("")), F.nullif(place("$.jobLocation"), F.lit("")), F.nullif(get("$.jobLocation.name", "$.jobLocation"), F.lit("")),
        F.nullif(place("$.applicantLocationRequirements"), F.lit("")), get("$.applicantLocationRequirements.name"),
    )
    remote = (get("$.jobLocationType") == "TELECOMMUTE") & ~F.contains(F.lower(stated), F.lit("remote"))
    kinds = F.try_variant_get(F.col("raw"), "$.employmentType", "array<string>")
    return _canonical(
        title=get("$.title"), company=F.coalesce(F.nullif(get("$.hiringOrganization.name"), F.lit("")), F.col("company")), url=F.coalesce(F.nullif(get("$.url"), F.lit("")), F.col("token")),
        location=F.when(remote, F.trim(F.concat(stated, F.lit(" (Remote)")))).otherwise(stated), description=strip_html(get("$.description")),
        posted_at=iso_timestamp(get("$.datePosted")), closes_at=iso_timestamp(get("$.validThrough")), salary=salary_text(),
        department=get("$.occupationalCategory"), employment_type=F.coalesce(F.array_join(kinds, ", "), get("$.employmentType")),
        **({"source": F.lit(source)} if source else {}),
    )


def _either(condition: Callable[[], Column], yes: Callable[[], dict], no: Callable[[], dict]) -> dict[str, Column]:
    a, b, c = yes(), no(), condition()
    return {k: F.when(c, a[k]).otherwise(b[k]) for k in POSTING_COLUMNS}


def _feed() -> dict[str, Column]:
    return _canonical(
        title=get("$.title"), url=F.coalesce(F.nullif(get("$.link"), F.lit("")), F.col("token")), location=get("$.location"),
        description=strip_html(get("$.description", "$.summary", "$.content")), posted_at=iso_timestamp(get("$.pubDate", "$.published", "$.updated")), department=get("$.category"),
    )


def _thin() -> dict[str, Column]:
    return _canonical(title=get("$.title"), url=get("$.url"), location=get("$.location"), description=get("$.description"))


def _page() -> dict[str, Column]:
    return _either(lambda: get("$._fallback") == "true", _thin, _jsonld)


def _successfactors() -> dict[str, Column]:
    return _either(lambda: (get("$.@type") != "") | (get("$.hiringOrganization.name") != ""), _jsonld, _feed)


#: Platforms of one flat shape: where each part stands. ``posted`` is a date, the rest text; url may be made of the token.
FLAT: dict[str, dict[str, tuple[str, ...]]] = {
    "icims": {"title": ("$.title",), "url": ("$.url",)},
    "avature": {"title": ("$.title",), "url": ("$.url",)},
    "teamtailor": {"title": ("$.title",), "url": ("$.url",)},
    "talentbrew": {"title": ("$.title",), "url": ("$.url",), "location": ("$.location",), "description": ("$.description",)},
    "taleo": {"title": ("$.column[0]", "$.title"), "location": ("$.column[1]",), "posted": ("$.postedDate",)},
    "cornerstone": {"title": ("$.displayJobTitle", "$.title"), "location": ("$.locations[0].city", "$.location"), "description": ("$.description", "$.externalDescription"), "posted": ("$.postedDate",)},
    "occupop": {"title": ("$.title", "$.job_title"), "location": ("$.location", "$.city"), "url": ("$.url", "$.apply_url"), "description": ("$.description",), "posted": ("$.created_at", "$.published_at")},
    "hirehive": {"title": ("$.title", "$.name"), "location": ("$.location.name", "$.location"), "url": ("$.url", "$.publicUrl"), "description": ("$.description",), "posted": ("$.publishedDate", "$.createdDate")},
    "eightfold": {"title": ("$.name",), "location": ("$.location",), "url": ("$.canonicalPositionUrl", "$.applyUrl"), "description": ("$.job_description", "$.description"), "posted": ("$.t_create",)},
    "jobvite": {"title": ("$.title",), "location": ("$.location",), "url": ("$.applyUrl", "$.url"), "description": ("$.description",), "posted": ("$.date",)},
    "bamboohr": {"title": ("$.jobOpeningName",), "location": ("$.location.city",), "posted": ("$.datePosted",)},
    "rippling": {"title": ("$.name",), "location": ("$.workLocation.label",), "url": ("$.url",), "description": ("$.descriptionHtml", "$.description")},
    "jibe": {"title": ("$.data.title", "$.title"), "location": ("$.data.full_location", "$.data.city"), "url": ("$.data.apply_url", "$.data.meta_data.canonical_url"), "description": ("$.data.description",), "posted": ("$.data.posted_date",)},
    "amazonjobs": {"title": ("$.title",), "location": ("$.location", "$.city"), "url": ("$.job_path",), "description": ("$.description", "$.description_short"), "posted": ("$.posted_date",)},
    "sociablekit": {"title": ("$.title",), "location": ("$.location",), "url": ("$.url", "$.link"), "description": ("$.description",), "posted": ("$.date", "$.posted_at")},
    "apiprobe": {"title": ("$.title",), "location": ("$.location",), "url": ("$.url",), "description": ("$.description",)},
    "phenom": {"title": ("$.title", "$.name"), "location": ("$.location", "$.cityStateCountry", "$.city"), "url": ("$.applyUrl", "$.jobUrl", "$.canonicalPositionUrl"), "posted": ("$.postedDate", "$.t_create")},
}
#: Addresses made of the board's token and an id, where a row gives none.
MADE_URLS = {
    "taleo": ("https://", "/careersection/jobdetail.ftl?job=", "$.contestNo"),
    "cornerstone": ("https://", "/ux/ats/careersite/1/requisition/", "$.requisitionId"),
    "bamboohr": ("https://", ".bamboohr.com/careers/", "$.id"),
    "rippling": ("https://ats.rippling.com/", "/jobs/", "$.uuid"),
    "phenom": ("https://", "/job/", "$.jobId"),
}


def _flat(ats: str) -> dict[str, Column]:
    where = FLAT[ats]
    url = get(*where["url"]) if "url" in where else F.lit("")
    if ats in MADE_URLS:
        before, after, key = MADE_URLS[ats]
        url = F.when(url != "", url).otherwise(F.concat(F.lit(before), F.split_part("token", F.lit("|"), F.lit(1)), F.lit(after), get(key)))
    if ats == "amazonjobs":
        url = F.when(F.startswith(url, F.lit("/")), F.concat(F.lit("https://www.amazon.jobs"), url)).otherwise(url)
    said = get(*where["description"]) if "description" in where else F.lit("")
    extra = {}
    if ats == "phenom":
        kinds = [get(p) for p in ("$.description", "$.descriptionTeaser", "$.job_description", "$.jobDescription")]
        longest = F.array_max(F.array(*[F.struct(F.length(k).alias("n"), k.alias("k")) for k in kinds]))["k"]
        extra = {"closes_at": iso_timestamp(get("$.closingDate", "$.unpostDate")), "salary": F.coalesce(F.nullif(get("$.salaryRange"), F.lit("")), salary_text("$.salary"))}
        said = longest
    posted = get(*where["posted"]) if "posted" in where else F.lit("")
    if ats == "amazonjobs":
        posted = F.coalesce(F.date_format(F.try_to_timestamp(posted, F.lit("MMMM d, yyyy")), "yyyy-MM-dd"), posted)
    return _canonical(
        title=F.trim(get(*where["title"])), url=url, location=F.trim(get(*where["location"])) if "location" in where else F.lit(""),
        description=strip_html(said), posted_at=iso_timestamp(posted), **extra,
    )


MAPPERS: dict[str, Callable[[], dict[str, Column]]] = {
    "greenhouse": _greenhouse, "lever": _lever, "ashby": _ashby, "workable": _workable, "smartrecruiters": _smartrecruiters, "recruitee": _recruitee,
    "personio": _personio, "workday": _workday, "oraclecloud": _oraclecloud, "pinpoint": _pinpoint, "jsonld": _jsonld, "successfactors": _successfactors,
    "joblinks": _page, "sitemap": _page, "candidatemanager": _page, "rssfeed": _feed, **{ats: (lambda ats=ats: _flat(ats)) for ats in FLAT},
}


def _mapped(raw: DataFrame, ats: str, *more: Column) -> DataFrame:
    return raw.select(*[c.alias(n) for n, c in MAPPERS[ats]().items()], "ats", "token", "ordinal", *more)


def normalise(raw: DataFrame, ats: str) -> DataFrame:
    """Canonical postings, with ats, token and ordinal, of one platform's raw postings."""
    return _mapped(raw.where(F.col("ats") == ats), ats)


def raw_postings(boards: DataFrame, ats: str) -> DataFrame:
    """Raw postings of one platform's recorded boards; one that several pages or searches of a board show is the first of them."""
    from tidemark.sources.paging import PAGED, first_of_each
    from tidemark.sources.parse import PARSERS

    raw = PARSERS[ats](boards.where(F.col("raw").isNotNull() & (F.col("ats") == ats)))
    return first_of_each(raw, ats) if ats in PAGED else raw


def wanted_details(boards: DataFrame, only: list[str] | None = None) -> DataFrame | None:
    """Requests for the details of recorded boards' postings; None if no platform has any."""
    from tidemark.sources.details import DETAILS, requests

    out = None
    for ats in only or sorted(MAPPERS):
        if ats in DETAILS:
            part = requests(raw_postings(boards, ats), ats)
            out = part if out is None else out.unionByName(part)
    return out


def postings(boards: DataFrame, only: list[str] | None = None, details: DataFrame | None = None) -> DataFrame:
    """Canonical postings of recorded boards: each platform is parsed and mapped on its own, and all are united.

    details: recorded responses of `details.requests`; what they say goes before what the listing says.
    """
    from tidemark.sources.details import DETAILS, key_of, with_details

    out = None
    for ats in only or sorted(MAPPERS):
        raw = raw_postings(boards, ats)
        if details is not None and ats in DETAILS:
            part = with_details(_mapped(raw, ats, key_of(ats).alias("key")), details, ats).drop("key")
        else:
            part = _mapped(raw, ats)
        out = part if out is None else out.unionByName(part)
    return out
