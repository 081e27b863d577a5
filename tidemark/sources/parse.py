"""Recorded responses to raw postings: (ats, token, company, ordinal, raw variant).

JSON boards explode an array found at one of several paths; XML goes through from_xml;
listings in HTML give a row for each matching anchor. Two shapes need a walk over nested
data, which columns cannot do: embedded structured data, and unknown JSON of which the
largest job-like array is taken.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidemark.functions.text import text
from tidemark.operators.dedupe import capped

#: Where the postings stand in each platform's JSON; the first path that holds an array is taken.
ARRAYS = {
    "greenhouse": ("$.jobs",), "lever": ("$",), "ashby": ("$.jobs",), "workable": ("$.jobs",), "smartrecruiters": ("$.content",),
    "recruitee": ("$.offers",), "workday": ("$.jobPostings",), "oraclecloud": ("$.items[0].requisitionList", "$.requisitionList"),
    "pinpoint": ("$.data", "$.postings", "$"), "taleo": ("$.requisitionList",), "cornerstone": ("$.data.requisitions", "$.requisitions", "$.data"),
    "occupop": ("$", "$.jobs"), "hirehive": ("$", "$.jobs"), "eightfold": ("$.positions",), "jobvite": ("$.jobs", "$"), "bamboohr": ("$.result",),
    "rippling": ("$", "$.items"), "jibe": ("$.jobs",), "amazonjobs": ("$.jobs",), "sociablekit": ("$.jobs", "$"),
    "phenom": ("$.positions", "$.jobs", "$.data.jobs", "$.refineSearch.data.jobs", "$.eagerLoadRefineSearch.data.jobs", "$.data.positions", "$.results", "$.items", "$"),
}
#: Anchors that are postings in a listing's HTML: address (group 1) and text (group 2).
ANCHORS = {
    "icims": r'<a[^>]+href="([^"]*/jobs/\d+/[^"]*)"[^>]*>(.{3,300}?)</a>',
    "avature": r'<a[^>]+href="([^"]*(?:JobDetail|/job/)[^"]*)"[^>]*>(.{3,200}?)</a>',
    "teamtailor": r'<a[^>]+href="(https?://[^"]*/jobs/\d[^"]*)"[^>]*>(.{3,200}?)</a>',
    "talentbrew": r'<a[^>]+href="([^"]*(?:/job/|/jobs/|jobid=)[^"]*)"[^>]*>(.{3,300}?)</a>',
    "candidatemanager": r'<a[^>]+href="([^"]*pJobDetails\.aspx[^"]*jid=[^"]*)"[^>]*>(.{3,200}?)</a>',
}


def _ordinal(board: str) -> Column:
    """Boards first, then places: the board's number in the upper half of a long."""
    return F.shiftleft(F.col(board).cast("long"), 32) + F.col("_pos")


def _rows(boards: DataFrame, variants: Column) -> DataFrame:
    """One row for each element of an array<variant>; ordinal counts boards first, then postings."""
    exploded = boards.select("ats", "token", "company", F.col("ordinal").alias("_board"), F.posexplode(variants).alias("_pos", "raw"))
    return exploded.select("ats", "token", "company", _ordinal("_board").alias("ordinal"), "raw")


def json_rows(boards: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    parsed = F.try_parse_json("raw")
    return _rows(boards, F.coalesce(*[F.try_variant_get(parsed, p, "array<variant>") for p in paths]))


def _to_variants(structs: Column) -> Column:
    return F.transform(structs, lambda s: F.parse_json(F.to_json(s)))


def anchor_rows(boards: DataFrame, pattern: str) -> DataFrame:
    """Distinct addresses in order of appearance; relative ones get the token's host."""
    urls, titles = (F.regexp_extract_all(text(F.col("raw")), F.lit("(?is)" + pattern), F.lit(i)) for i in (1, 2))
    base = F.when(F.startswith("token", F.lit("http")), F.regexp_extract("token", "^https?://[^/]+", 0)).otherwise(F.concat(F.lit("https://"), F.split_part("token", F.lit("/"), F.lit(1))))
    lists = boards.select("ats", "token", "company", "ordinal", urls.alias("_u"), titles.alias("_t"), base.alias("_base"))
    absolute = lambda u, b: F.when(F.startswith(u, F.lit("http")), u).when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(F.concat(b, F.when(F.startswith(u, F.lit("/")), "").otherwise("/"), u))
    rows = F.zip_with(
        "_u", "_t",
        lambda u, t: F.struct(F.replace(u, F.lit("&amp;"), F.lit("&")).alias("url"), F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " ")).alias("title")),
    )
    placed = lists.select("ats", "token", "company", "ordinal", "_base", F.posexplode(rows).alias("_pos", "r"))
    first = placed.select(
        "ats", "token", "company", "ordinal", "_pos", F.col("r.title").alias("title"), absolute(F.col("r.url"), F.col("_base")).alias("url")
    ).groupBy("ats", "token", "company", "ordinal", "url").agg(F.min_by("title", "_pos").alias("title"), F.min("_pos").alias("_pos"))
    raw = F.parse_json(F.to_json(F.struct("title", "url")))
    return first.select("ats", "token", "company", _ordinal("ordinal").alias("ordinal"), raw.alias("raw"))


def personio_rows(boards: DataFrame) -> DataFrame:
    position = (
        "struct<id: string, name: string, office: string, department: string, employmentType: string, createdAt: string, "
        "jobDescriptions: struct<jobDescription: array<struct<name: string, value: string>>>>"
    )
    positions = F.from_xml("raw", f"position array<{position}>")["position"]
    said = lambda p: F.array_join(F.transform(p["jobDescriptions"]["jobDescription"], lambda d: F.concat_ws("\n", d["name"], d["value"])), "\n\n")
    shaped = F.transform(
        positions,
        lambda p: F.struct(p["id"].alias("id"), p["name"].alias("name"), p["office"].alias("office"), p["department"].alias("department"),
                           p["employmentType"].alias("employmentType"), p["createdAt"].alias("createdAt"), said(p).alias("_description")),
    )
    return _rows(boards, _to_variants(shaped))


def feed_rows(boards: DataFrame) -> DataFrame:
    """Items of RSS, entries of Atom; a feed's namespaces are dropped first."""
    plain = F.regexp_replace(F.regexp_replace("raw", r"<(/?)[a-zA-Z]+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    fields = "title: string, link: string, description: string, pubDate: string, category: string, location: string"
    items = F.from_xml(plain, f"channel struct<item: array<struct<{fields}>>>", {"mode": "PERMISSIVE"})["channel"]["item"]
    entry = "title: string, link: struct<_href: string>, summary: string, content: string, published: string, updated: string"
    entries = F.from_xml(plain, f"entry array<struct<{entry}>>", {"mode": "PERMISSIVE"})["entry"]
    from_atom = F.transform(
        entries,
        lambda e: F.struct(e["title"].alias("title"), e["link"]["_href"].alias("link"), F.coalesce(e["summary"], e["content"]).alias("description"),
                           F.coalesce(e["published"], e["updated"]).alias("pubDate"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("location")),
    )
    titled = F.filter(F.coalesce(items, from_atom), lambda i: text(i["title"]) != "")
    return _rows(boards, _to_variants(titled))


_BLOCK = re.compile(r"<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", re.S | re.I)
_READ = json.JSONDecoder().raw_decode


def _postings_in(node) -> list[dict]:
    """Every JobPosting inside nested data, in order, by an explicit stack."""
    found, work = [], [node]
    while work:
        item = work.pop()
        if isinstance(item, dict):
            kind = item.get("@type")
            if kind == "JobPosting" or (isinstance(kind, list) and "JobPosting" in kind):
                found.append(item)
            else:
                work.extend(reversed(list(item.values())))
        elif isinstance(item, list):
            work.extend(reversed(item))
    return found


def _readable(block: str) -> list:
    """The JSON value of a block; of a broken one those objects that can be read from a brace on."""
    try:
        return [json.loads(block)]
    except (ValueError, RecursionError):
        pass
    values, at = [], block.find("{")
    while at >= 0:
        try:
            value, after = _READ(block, at)
            values.append(value)
        except (ValueError, RecursionError):
            after = at + 1
        at = block.find("{", after)
    return values


@F.pandas_udf(ArrayType(StringType()))
def structured_postings(pages: pd.Series) -> pd.Series:
    """JSON texts of the JobPosting objects embedded in pages; of broken blocks what parses."""

    def of(page: str | None) -> list[str]:
        found: list[dict] = []
        for block in _BLOCK.findall(page or ""):
            found += _postings_in(_readable(html.unescape(block) if "&quot;" in block else block))
        return [json.dumps(p, ensure_ascii=False) for p in found]

    return pages.map(of, na_action=None)


def structured_rows(boards: DataFrame) -> DataFrame:
    return _rows(boards, F.transform(structured_postings("raw"), lambda s: F.try_parse_json(s)))


#: Names under which unknown JSON gives a posting's parts, letters only.
SYNONYMS = {
    "title": ("title", "name", "jobtitle", "positiontitle", "jobname", "postingtitle", "displayname", "vacancytitle"),
    "url": ("url", "link", "applyurl", "joburl", "absoluteurl", "canonicalurl", "permalink", "detailurl", "href"),
    "location": ("location", "city", "joblocation", "locationname", "primarylocation", "office", "locationstext", "town", "region"),
    "description": ("description", "jobdescription", "summary", "content", "body", "shortdescription", "jobsummary", "details"),
}
LABELS = ("name", "label", "text", "value", "city")
DEEPEST = 6


def _said(value) -> str:
    """The text of a value: itself, the first of a list that says something, or what an object is called."""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return next(filter(None, map(_said, value)), "")
    return next(filter(None, (_said(value[k]) for k in LABELS if isinstance(value.get(k), str))), "") if isinstance(value, dict) else ""


def _as_posting(record: dict) -> dict[str, str]:
    """A record's parts by the names that they may have."""
    named = {re.sub("[^a-z]", "", key.lower()): value for key, value in record.items()}
    return {part: next(filter(None, (_said(named.get(name)) for name in names)), "") for part, names in SYNONYMS.items()}


def _arrays(root) -> Iterator[list[dict]]:
    """The records of every array down to a depth, level by level."""
    level = [root]
    for _ in range(DEEPEST + 1):
        below: list = []
        for node in level:
            if isinstance(node, list):
                yield [x for x in node if isinstance(x, dict)]
            below += node if isinstance(node, list) else node.values() if isinstance(node, dict) else ()
        level = below


@F.pandas_udf(ArrayType(StructType([StructField(part, StringType()) for part in SYNONYMS])))
def job_like_arrays(responses: pd.Series) -> pd.Series:
    """The array with the most records that have a title (two at least), as their parts; of equals the first by level."""

    def of(response: str | None) -> list[dict]:
        try:
            root = json.loads(response or "null")
        except ValueError:
            return []
        best: list[dict] = []
        for records in _arrays(root):
            titled = [p for p in map(_as_posting, records) if p["title"]]
            if len(titled) > max(1, len(best)):
                best = titled
        return best

    return responses.map(of, na_action=None)


def unknown_rows(boards: DataFrame) -> DataFrame:
    return _rows(boards, _to_variants(F.filter(job_like_arrays("raw"), lambda r: r["title"] != "")))


def _page_rows(boards: DataFrame) -> DataFrame:
    """Job pages: their structured data, or where there is none one thin row of title, slug and readable text."""
    from tidemark.functions.text import readable_text
    from tidemark.functions.url import from_slug
    from tidemark.operators.discovery import page_title
    from tidemark.operators.gates import looks_like_a_title

    found = F.transform(structured_postings("raw"), lambda s: F.try_parse_json(s))
    marked = boards.withColumn("_found", found)
    title, slug = page_title(F.col("raw")), from_slug(F.col("token"), ("ireland", "dublin", "cork", "galway", "london", "england", "germany", "france", "india"))
    thin = F.array(
        F.parse_json(
            F.to_json(
                F.struct(
                    F.lit(True).alias("_fallback"), F.when(looks_like_a_title(title), title).otherwise(slug["title"]).alias("title"),
                    F.col("token").alias("url"), slug["location"].alias("location"), readable_text(F.col("raw")).alias("description"),
                )
            )
        )
    )
    return _rows(marked, F.when(F.size("_found") > 0, F.col("_found")).otherwise(thin))


def _feed_or_page(boards: DataFrame) -> DataFrame:
    xml = F.col("raw").rlike(r"(?is)^\s*(<\?xml|<rss|<feed)")
    return feed_rows(boards.where(xml)).unionByName(structured_rows(boards.where(~xml)))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    **{ats: (lambda b, paths=paths: json_rows(b, paths)) for ats, paths in ARRAYS.items()},
    **{ats: (lambda b, p=p: anchor_rows(b, p)) for ats, p in ANCHORS.items() if ats != "candidatemanager"},
    "personio": personio_rows, "rssfeed": feed_rows, "successfactors": _feed_or_page, "jsonld": structured_rows,
    "joblinks": _page_rows, "sitemap": _page_rows, "candidatemanager": _page_rows, "apiprobe": unknown_rows,
}


def sitemap_urls(sitemaps: DataFrame, most: int = 45) -> DataFrame:
    """token, rank and url of the last `most` job-like addresses of each sitemap (raw: its XML)."""
    locs = F.regexp_extract_all(text(F.col("raw")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    jobs = F.filter(locs, lambda u: u.rlike(r"(?i)/(jobs?|careers?|vacanc(y|ies)|positions?)/"))
    tail = F.slice(jobs, F.greatest(F.size(jobs) - most + 1, F.lit(1)), F.lit(most))
    return sitemaps.select("token", F.posexplode(tail).alias("rank", "url"))


def keyword_union(searches: DataFrame, key: str) -> DataFrame:
    """The union of several searches of one board: the first occurrence of each key; searches have search, ordinal and raw.

    The unfiltered search (search = '') counts only where the others found nothing.
    """
    k = F.try_variant_get("raw", key, "string")
    first = searches.where(F.col("search") != "").groupBy("token", k.alias("key")).agg(F.min_by("raw", "ordinal").alias("raw"), F.min("ordinal").alias("ordinal"))
    none = searches.where(F.col("search") == "").join(first.select("token").distinct(), "token", "left_anti")
    rest = none.groupBy("token", k.alias("key")).agg(F.min_by("raw", "ordinal").alias("raw"), F.min("ordinal").alias("ordinal"))
    return first.unionByName(rest)


def with_details(listed: DataFrame, details: DataFrame, most: int = 120) -> DataFrame:
    """Listed postings with the description of a detail fetch, for the first `most` of a board; the teaser stays elsewhere.

    listed: token, id, ordinal, description; details: token, id, description. For platforms with rules of their own see ``details``.
    """
    own = listed.columns
    asked = capped(listed.select("token", "id", "ordinal"), "token", most).select("token", "id", F.lit(True).alias("_asked")).distinct()
    full = details.select("token", "id", F.col("description").alias("_full"))
    joined = listed.join(asked, ["token", "id"], "left").join(full, ["token", "id"], "left")
    kept = F.when(F.coalesce("_asked", F.lit(False)) & (text(F.col("_full")) != ""), F.col("_full")).otherwise(F.col("description"))
    return joined.withColumn("description", kept).select(*own)
