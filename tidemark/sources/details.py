"""Descriptions that stand on pages of their own: asked for after a listing, for the first postings of each board.

    wanted = requests(raw, ats)          # at most `most` of a board
    details = fetched(wanted)            # one response a row; lanes of a host keep a pause
    full = with_details(postings, details, ats)

Requests are a table, so their number does not pass through the driver. The first postings of a board are
a ranked window with a limit, which Spark applies in each task before the shuffle: of a
board with very many postings only so many rows travel. A detail that did not arrive, or says nothing, leaves what the
listing says.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import iso_timestamp, strip_html, text
from tidemark.operators.dedupe import capped
from tidemark.sources.boards import FetchError, check_whole, fetch

#: Tasks that ask one host at a time, and seconds between two requests of one of them.
LANES, BETWEEN_S = 6, 0.25


@dataclass(frozen=True)
class Detail:
    """Where a platform's details stand.

    key: the posting's part of the address; parts: the token's; address: formatted with both. most: how many of a
    board are asked for; gives: the paths in a response by the posting's column, several are joined.
    """

    key: str
    parts: tuple[str, ...]
    address: str
    most: int
    gives: dict[str, tuple[str, ...]]


#: Addresses of the platforms' details, how many are asked for, and where they say what.
DETAILS = {
    "workday": Detail(
        "$.externalPath", ("tenant", "number", "site"), "https://{tenant}.wd{number}.myworkdayjobs.com/wday/cxs/{tenant}/{site}{key}", 200,
        {"description": ("$.jobPostingInfo.jobDescription",), "location": ("$.jobPostingInfo.location",), "posted_at": ("$.jobPostingInfo.startDate",)},
    ),
    "smartrecruiters": Detail(
        "$.id", ("token",), "https://api.smartrecruiters.com/v1/companies/{token}/postings/{key}", 120,
        {"description": tuple(f"$.jobAd.sections.{s}.text" for s in ("companyDescription", "jobDescription", "qualifications", "additionalInformation"))},
    ),
    "oraclecloud": Detail(
        "$.Id", ("host", "site"),
        'https://{host}/hcmRestApi/resources/latest/recruitingCEJobRequisitionDetails?onlyData=true&expand=all&finder=ById;Id="{key}",siteNumber={site}', 120,
        {"description": ("$.items[0].ExternalDescriptionStr",)},
    ),
}


def key_of(ats: str) -> Column:
    """The detail's key of a raw posting; null if it has none."""
    return F.nullif(F.try_variant_get("raw", DETAILS[ats].key, "string"), F.lit(""))


def _address(ats: str) -> Column:
    rule = DETAILS[ats]
    given = {name: F.split_part("token", F.lit("|"), F.lit(i)) for i, name in enumerate(rule.parts, 1)} | {"key": F.col("key")}
    if "number" in given:
        given["number"] = F.regexp_replace(F.lower(given["number"]), "^wd", "")
    pieces, rest = [], rule.address
    while rest:
        plain, brace, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(plain)] + ([given[name]] if brace else [])
    return F.concat(*pieces)


def requests(raw: DataFrame, ats: str, most: int | None = None) -> DataFrame:
    """ats, token, key and url of the details to ask for: those of the first raw postings of each board, by ordinal."""
    keyed = raw.where(F.col("ats") == ats).select("ats", "token", "ordinal", key_of(ats).alias("key")).where(F.col("key").isNotNull())
    first = capped(keyed, "token", DETAILS[ats].most if most is None else most)
    return first.select("ats", "token", "key").distinct().select("ats", "token", "key", _address(ats).alias("url"))


def fetched(wanted: DataFrame, lanes: int = LANES, between_s: float = BETWEEN_S, pause_s: float = 0.5, ask: Callable[..., str] = fetch) -> DataFrame:
    """ats, token, key, raw and error of each request.

    A host's requests are dealt over `lanes` tasks, each of which asks one after another with a pause, so
    a host is never asked by more at once, and one host of all boards is no single task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = []
            for ats, url in zip(frame["ats"], frame["url"], strict=True):
                try:
                    raw = ask(url, None, pause_s)
                    check_whole(ats, raw)
                    said.append((raw, None))
                except FetchError as e:
                    said.append((None, f"{type(e).__name__}: {e}"[:300]))
                time.sleep(between_s)
            yield frame[["ats", "token", "key"]].assign(raw=[r for r, _ in said], error=[e for _, e in said])

    host, lane = F.regexp_extract("url", "^https?://([^/]+)", 1), F.pmod(F.xxhash64("url"), F.lit(lanes))
    return wanted.repartition(host, lane).mapInPandas(run, "ats string, token string, key string, raw string, error string")


def with_details(postings: DataFrame, details: DataFrame, ats: str) -> DataFrame:
    """Postings (with token and key) of a platform with what their details say; details: ats, token, key, raw."""
    own, rule = postings.columns, DETAILS[ats]
    parsed = F.try_parse_json("raw")
    said = {
        column: F.concat_ws("\n\n", *[F.nullif(text(F.try_variant_get(parsed, p, "string")), F.lit("")) for p in paths])
        for column, paths in rule.gives.items()
    }
    shaped = {c: strip_html(v) if c == "description" else iso_timestamp(v) if c == "posted_at" else v for c, v in said.items()}
    mine = details.where((F.col("ats") == ats) & F.col("raw").isNotNull()).select("token", "key", *[v.alias(f"_{c}") for c, v in shaped.items()])
    mine = mine.groupBy("token", "key").agg(*[F.max(f"_{c}").alias(f"_{c}") for c in shaped])  # a detail that was asked twice
    joined = postings.join(mine, ["token", "key"], "left")
    full = {c: F.when(text(F.col(f"_{c}")) != "", F.col(f"_{c}")).otherwise(F.col(c)) for c in shaped}
    return joined.select(*[full[c].alias(c) if c in full else F.col(c) for c in own])
