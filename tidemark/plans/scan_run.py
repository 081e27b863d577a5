"""A whole scan as one plan: responses in, the next board out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import MIN_SCORE, Profile
from tidemark.functions.text import iso_timestamp
from tidemark.operators import dedupe, eligibility, feedback, gates, lifecycle, matching, routes, scoring
from tidemark.schema import POSTING_COLUMNS
from tidemark.sources import paging
from tidemark.sources.normalise import postings, wanted_details

#: What the board keeps of a posting besides its life cycle; the rest is computed anew on every run.
KEPT = (*POSTING_COLUMNS, "ordinal")
LIFE = ("first_seen", "last_seen", "closed", "closed_at", "is_new")
OF_EMPLOYER = ("permits", "sponsor_confidence", "sector", "entry_routes", "fit_rank", "website")


@dataclass
class ScanResult:
    board: DataFrame
    drops: DataFrame
    scanned: DataFrame


def _listed_apart() -> Column:
    """Postings with lists of their own: the score floor is not for them."""
    return routes.outsourcer(F.col("company")) | routes.open_office(F.col("title"), F.col("description"), F.lit("eligible"), F.col("years")).isNotNull()


def _judged(rows: DataFrame, companies: DataFrame, profile: Profile) -> DataFrame:
    """rows with what is known of the employer, a score, and eligibility."""
    dim = companies.select("name", "ordinal", *OF_EMPLOYER)
    known = matching.company_lookup(rows, dim).withColumn("sponsor_tier", scoring.sponsor_tier(F.coalesce("permits", F.lit(0))))
    return eligibility.with_eligibility(scoring.score_postings(known, profile))


def _above_floor(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("score") >= MIN_SCORE) | _listed_apart())


def without_language(judged: DataFrame) -> DataFrame:
    """What asks for a language that the candidate has not leaves the board."""
    return judged.where(~F.exists("eligibility_reasons", lambda r: r["code"] == "language"))


def answered(boards: DataFrame) -> DataFrame:
    """The employers of which every response arrived; one lost page may hold any of their postings."""
    return boards.groupBy("company").agg(F.bool_and(F.col("error").isNull()).alias("whole")).where("whole").select("company")


def scan_run(
    boards: DataFrame,
    companies: DataFrame,
    stored: DataFrame,
    log: DataFrame,
    profile: Profile,
    now: Column,
    only: list[str] | None = None,
    cut: Callable[[DataFrame], DataFrame] = lambda df: df,
    details: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
) -> ScanResult:
    """The board after a scan.

    boards: recorded responses (schema.RAW_BOARD; without page and search each is a listing of its own);
    companies: name, ordinal and OF_EMPLOYER; stored: KEPT and LIFE of the last board; log: feedback.
    details: recorded responses of detail pages, or what turns requests for them into such responses, as
    ``details.fetched``. cut is applied where a table feeds several steps, to write it and read it back.
    """
    if {"page", "search"} <= set(boards.columns):
        boards = cut(paging.united(boards))
    if callable(details):
        wanted = wanted_details(boards, only)
        details = None if wanted is None else cut(details(wanted))
    fetched = cut(postings(boards, only, details))
    researched = companies.select(F.col("name").alias("company"), (F.col("fit_rank").isNotNull() | F.col("sector").isNotNull()).alias("researched"))
    marked = fetched.join(researched.groupBy("company").agg(F.bool_or("researched").alias("researched")), "company", "left")
    kept, drops = gates.apply_gates(marked.withColumn("researched", F.coalesce("researched", F.lit(False))), profile)
    best = cut(dedupe.best_posting(_above_floor(_judged(kept.select(*KEPT), companies, profile))).select(*KEPT))

    scanned = answered(boards)
    life = lifecycle.age_out(lifecycle.merge_scan(stored.select("id", "company", *LIFE), best.select("id", "company"), scanned, now), now)
    # What a posting says: as seen now, else as stored.
    said = dedupe.best_per(
        best.withColumn("_age", F.lit(0)).unionByName(stored.select(*KEPT).withColumn("_age", F.lit(1))), F.col("id"), F.col("_age"), F.col("ordinal")
    ).drop("_age", "company")
    board = cut(_judged(life.join(said, "id"), companies, profile))

    board = dedupe.best_address(board)
    clean = board.where(gates.looks_like_a_title(F.col("title")) & ~gates.clearly_abroad(profile))
    clean = dedupe.best_posting(_above_floor(clean))
    routed = routes.with_routes(clean).withColumn("csol", routes.occupation(F.col("title"), F.col("description"), F.col("salary_eur")))
    final = routes.final_status(routed, feedback.rejected_pairs(log), feedback.learned_words(log))
    fit = without_language(final)
    return ScanResult(fit.withColumn("closes_at", F.try_to_timestamp(iso_timestamp(F.col("closes_at")))), drops, scanned)


def in_order(board: DataFrame) -> DataFrame:
    """The board's own order: best score, then first seen, then id."""
    return board.orderBy(F.col("score").desc(), "first_seen", "id")
