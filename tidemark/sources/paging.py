"""Listings that come in pages: what to ask next, and which recorded pages count.

PAGED says of each platform how its pages are asked for and when a listing ends. Two sides
use it: the ``boards`` source asks page by page inside a task, and `followed` applies the same
rules to recorded responses as a plan of aggregates and joins.

A listing ends with the first page that has fewer rows than asked for, none, none that is
new, or that reaches the total it states, by the platform's rule; a page that fails ends it
too, and keeps the pages before. Searches of one board are united; the search without a
word counts only where the others found nothing.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.parse import ANCHORS, ARRAYS


@dataclass(frozen=True)
class Paged:
    """How a platform's pages are asked for.

    urls: addresses with {token parts} and {at}, tried in order until one gives rows; at begins at `first` and goes on by
    `step`, or with step 0 by the rows that came. body: what is posted, as JSON text with the same fields and {search}.
    size: rows of a full page; pages: how many are asked for at most; ends: the rules that end a listing. key: where a
    row's own key stands; total: where a page states the number of rows.
    """

    urls: tuple[str, ...]
    size: int
    step: int
    pages: int
    ends: tuple[str, ...]
    first: int = 0
    key: tuple[str, ...] = ()
    total: str = ""
    body: str = ""
    searches: tuple[str, ...] = ("",)
    parts: tuple[str, ...] = ("token",)


#: Addresses of the platforms' listings, sizes of their pages and where they end.
PAGED = {
    "smartrecruiters": Paged(("https://api.smartrecruiters.com/v1/companies/{token}/postings?limit=100&offset={at}",), 100, 100, 11, ("short",), key=("$.id",)),
    "workday": Paged(
        ("https://{tenant}.wd{number}.myworkdayjobs.com/wday/cxs/{tenant}/{site}/jobs",), 20, 20, 150, ("short",), key=("$.externalPath", "$.title"),
        body='{{"appliedFacets": {{}}, "limit": 20, "offset": {at}, "searchText": "{search}"}}',
        searches=("Ireland", "Dublin", "Cork", "Galway", "Limerick", ""), parts=("tenant", "number", "site"),
    ),
    "oraclecloud": Paged(
        (
            "https://{host}/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&expand=requisitionList.secondaryLocations"
            "&finder=findReqs;siteNumber={site},facetsList=LOCATIONS;WORK_FROM_HOME;WORKPLACE_TYPES,limit=200,offset={at},sortBy=POSTING_DATES_DESC",
        ),
        200, 200, 6, ("empty", "total"), key=("$.Id",), total="$.items[0].TotalJobsCount", parts=("host", "site"),
    ),
    "icims": Paged(("https://{host}/jobs/search?ss=1&searchRelation=keyword_all&in_iframe=1&pr={at}",), 10, 1, 3, ("short",), key=("$.url",), parts=("host",)),
    "jibe": Paged(
        ("https://{host}/api/jobs?location={where}&page={at}&limit=100",), 100, 1, 10, ("stale",), first=1,
        key=("$.data.slug", "$.data.req_id", "$.slug", "$.req_id"), parts=("host", "where"),
    ),
    "amazonjobs": Paged(
        ("https://www.amazon.jobs/en/search.json?country={country}&result_limit=100&offset={at}&sort=recent",), 100, 100, 10, ("short", "total"),
        key=("$.id_icims", "$.id"), total="$.hits", parts=("country",),
    ),
    "phenom": Paged(
        (
            "https://{host}/api/apply/v2/jobs?domain={domain}&start={at}&num=50&sortBy=relevance",
            "https://{host}/api/apply/v2/jobs?domain={domain}&start={at}&num=50",
            "https://{host}/widgets?type=jobs&domain={domain}&start={at}&num=50",
        ),
        50, 0, 25, ("empty", "stale"), key=("$.jobId", "$.ats_job_id", "$.jobSeqNo", "$.id", "$.reqId", "$.requisitionId", "$.displayJobId"), parts=("host", "domain"),
    ),
}
#: Beginnings of a careers host that its domain does not have.
CAREERS_HOSTS = ("careers", "career", "jobs", "job", "apply", "talent", "recruiting", "recruitment", "join", "www")
#: What stands for a token's part that is missing.
DEFAULTS = {"where": "Ireland", "country": "IRL"}


def parts_of(ats: str, token: str) -> dict[str, str]:
    """The named parts of a platform's token."""
    rule = PAGED[ats]
    given = dict(zip(rule.parts, token.split("|"), strict=False))
    parts = {name: given.get(name, "") or DEFAULTS.get(name, "") for name in rule.parts}
    if "number" in parts:
        parts["number"] = parts["number"].lower().removeprefix("wd")
    if "host" in parts:
        host = re.sub("^https?://", "", parts["host"]).strip("/").split("/")[0]
        parts["host"] = host if "." in host or ats != "icims" else f"careers-{host}.icims.com"
    missing = [name for name, said in parts.items() if not said and name != "domain"]
    if missing:
        raise ValueError(f"{ats} needs {'|'.join(rule.parts)}")
    return parts


def _ladder(board: dict) -> list[tuple[str, dict[str, str]]]:
    """The addresses of a board with their parts, in the order in which they are tried."""
    rule, parts = PAGED[board["ats"]], parts_of(board["ats"], board["token"])
    if "where" in parts:
        parts["where"] = quote(parts["where"], safe="")
    if "domain" not in parts or parts["domain"]:
        return [(url, parts) for url in rule.urls]
    first, _, rest = parts["host"].partition(".")
    domains = ([rest] if first.lower() in CAREERS_HOSTS and "." in rest else []) + [parts["host"]]
    return [(url, parts | {"domain": domain}) for domain in domains for url in rule.urls]


def _dig(value, path: str):
    """The value at a path of names and numbers, as `$.items[0].hits`; None if it is not there."""
    for name, number in re.findall(r"\.(\w+)|\[(\d+)\]", path):
        try:
            value = value[int(number)] if number else value[name]
        except (KeyError, IndexError, TypeError):
            return None
    return value


def rows_of(ats: str, raw: str) -> list:
    """A page's rows, as `parse` finds them."""
    if ats in ANCHORS:
        return [{"url": html.unescape(m[0])} for m in re.findall("(?is)" + ANCHORS[ats], raw)]
    data = json.loads(raw)
    return next((found for path in ARRAYS[ats] if isinstance(found := _dig(data, path), list)), [])


def keys_of(ats: str, rows: list) -> list[str]:
    found = ([_dig(row, path) for path in PAGED[ats].key] for row in rows)
    return [str(next((k for k in keys if k not in (None, "")), "")) for keys in found]


class Listing:
    """Tells from a listing's pages, as they come, whether there is one more to ask for."""

    def __init__(self, ats: str):
        self.ats, self.rule = ats, PAGED[ats]
        self.known: set[str] = set()
        self.at, self.pages, self.rows = self.rule.first, 0, 0

    def goes_on(self, raw: str) -> bool:
        rule, rows = self.rule, rows_of(self.ats, raw)
        keys = {k for k in keys_of(self.ats, rows) if k}
        fresh = keys - self.known
        self.known |= keys
        self.rows += len(rows)
        self.pages += 1
        self.at += rule.step or len(rows)
        total = _dig(json.loads(raw), rule.total) if rule.total else None
        ended = {"short": len(rows) < rule.size, "empty": not rows, "stale": not fresh, "total": isinstance(total, int) and self.pages * rule.size >= total}
        return self.pages < rule.pages and not any(ended[name] for name in rule.ends)


def pages(board: dict, fetch: Callable[[str, dict | None], str]) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(search, page, raw, error) of a board's pages, asked for one after another.

    fetch: text by address and body. board: ats, token, and root if it is not asked at its own host. An address that
    gives nothing leads to the next one; of the last one it is told why.
    """
    rule, ladder, found = PAGED[board["ats"]], _ladder(board), False
    for search in rule.searches:
        if found and not search:
            return  # the search without a word is for boards on which the others find nothing
        for rung, (url, parts) in enumerate(ladder, 1):
            listing, asked = Listing(board["ats"]), True
            told: list[tuple[str, int, str | None, str | None]] = []
            while asked:
                fields = parts | {"at": listing.at, "search": search}
                address = url.format(**fields)
                if board.get("root"):
                    address = re.sub("^https?://[^/]+", board["root"], address)
                page = listing.pages
                try:
                    raw = fetch(address, json.loads(rule.body.format(**fields)) if rule.body else None)
                    asked = listing.goes_on(raw)
                    told.append((search, page, raw, None))
                except (OSError, ValueError, RuntimeError) as e:
                    asked = False
                    told.append((search, page, None, f"{type(e).__name__}: {e}"[:300]))
                if listing.rows:  # this address it is: pages go out as they come
                    yield from told
                    told.clear()
            if listing.rows:
                found = True
                break
            if rung == len(ladder):
                yield from told


# --- recorded pages ---------------------------------------------------------


def _rows(ats: str) -> Column:
    parsed = F.try_parse_json("raw")
    return F.coalesce(*[F.try_variant_get(parsed, p, "array<variant>") for p in ARRAYS[ats]], F.expr("cast(array() as array<variant>)"))


def _key(row: Column, ats: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_variant_get(row, p, "string"), F.lit("")) for p in PAGED[ats].key])


def followed(recorded: DataFrame, ats: str) -> DataFrame:
    """The recorded pages of a platform that its listings consist of.

    recorded: ats, token, company, search, page, raw, ordinal, error of any pages, whatever was recorded beyond a
    listing's end; a page is numbered from 0. What comes after a page that is missing does not count.
    """
    rule = PAGED[ats]
    own = recorded.columns
    mine = recorded.where(F.col("ats") == ats).withColumn("search", F.coalesce("search", F.lit("")))
    listing, rows = ["token", "search"], _rows(ats) if ats in ARRAYS else F.regexp_extract_all("raw", F.lit("(?is)" + ANCHORS[ats]), F.lit(1))
    facts = mine.select(*listing, "page", F.size(rows).alias("n"), F.col("raw").isNull().alias("failed"), *([F.try_variant_get(F.try_parse_json("raw"), rule.total, "long").alias("total")] if rule.total else []))
    ended = {
        "short": F.col("n") < rule.size, "empty": F.col("n") == 0,
        "total": F.coalesce((F.col("page") + 1) * rule.size >= F.col("total"), F.lit(False)) if rule.total else F.lit(False),
        "stale": F.coalesce(F.col("fresh") == 0, F.lit(True)),
    }
    if "stale" in rule.ends:
        keys = mine.select(*listing, "page", F.explode(F.transform(rows, lambda r: _key(r, ats)) if ats in ARRAYS else rows).alias("k")).where(F.col("k").isNotNull())
        first = keys.groupBy(*listing, "k").agg(F.min("page").alias("page"))  # where each key stands first
        facts = facts.join(first.groupBy(*listing, "page").agg(F.count(F.lit(1)).alias("fresh")), [*listing, "page"], "left")
    end = F.col("failed")
    for name in rule.ends:
        end = end | ended[name]
    # One row a listing: the page on which it ends, and how many pages there are before the first gap.
    last = facts.groupBy(*listing).agg(
        F.min(F.when(end, F.col("page"))).alias("last"), F.sum("n").alias("found"),
        F.array_sort(F.collect_set(F.when(F.col("page") < rule.pages, F.col("page")))).alias("there"),
    )
    gap = F.size(F.filter("there", lambda p, i: p == i))
    last = last.select(*listing, F.coalesce(F.least("last", gap - 1), gap - 1).alias("last"), "found")
    kept = mine.join(last, listing).where(F.col("page") <= F.col("last"))
    if len(rule.searches) > 1:
        named = last.where((F.col("search") != "") & (F.col("found") > 0)).select(F.col("token").alias("_named")).distinct()
        kept = kept.join(named, F.col("token") == F.col("_named"), "left").where((F.col("search") != "") | F.col("_named").isNull())
    return kept.select(*own)


def first_of_each(raw: DataFrame, ats: str) -> DataFrame:
    """Raw postings without those whose key stands earlier in the same board; what has no key stays."""
    own, key = raw.columns, _key(F.col("raw"), ats)
    # A variant cannot be compared or grouped; it is carried.
    keyed = raw.select(*own, key.alias("_key"))
    first = keyed.where(F.col("_key").isNotNull()).groupBy("token", "_key").agg(F.min_by(F.struct(*own), "ordinal").alias("_row")).select("_row.*")
    return first.unionByName(keyed.where(F.col("_key").isNull()).select(*own))


def united(recorded: DataFrame) -> DataFrame:
    """Recorded responses with only those pages of paged platforms that their listings consist of; errors stay."""
    out = recorded.where(F.col("ats").isNull() | ~F.col("ats").isin(*PAGED))
    for ats in PAGED:
        out = out.unionByName(followed(recorded, ats))
    return out
