"""The feedback loop: what users reject teaches which words to skip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import text

STOP = ("with", "from", "this", "that", "role", "team", "work", "time", "full", "part", "senior", "junior", "ireland")
ITEMS = "array<struct<kind: string, id: string, title: string, company: string, reason: string>>"


def words(title: Column, stop: tuple[str, ...] = STOP) -> Column:
    """The distinct words of four letters or more."""
    found = F.regexp_extract_all(F.lower(text(title)), F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, stop)))


def parse(issues: DataFrame) -> DataFrame:
    """The items of the fenced JSON array in body: at most fifty, of known kind, with a title, fields cut to 160 characters."""
    fenced = F.regexp_extract("body", r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    items = F.slice(F.coalesce(F.from_json(fenced, ITEMS), F.expr(f"cast(array() as {ITEMS})")), F.lit(1), F.lit(50))
    rows = issues.select(F.posexplode(items).alias("ordinal", "i")).select("ordinal", "i.*")
    good = rows.where(F.col("kind").isin("hidden", "applied") & (text(F.col("title")) != ""))
    return good.select("ordinal", *[F.left(text(F.col(c)), F.lit(160)).alias(c) for c in ("kind", "id", "title", "company", "reason")])


def append(log: DataFrame, items: DataFrame) -> DataFrame:
    """log and the items that it does not hold by (kind, id); repeats inside items stay."""
    return log.unionByName(items.join(log.select("kind", "id").distinct(), ["kind", "id"], "left_anti").select(*log.columns))


def word_counts(log: DataFrame, reason: str | None = None) -> DataFrame:
    """word and the number of hidden rows that hold it, without words of any row applied to."""
    hidden = log.where(F.col("kind") == "hidden")
    if reason is not None:
        hidden = hidden.where(F.col("reason") == reason)
    counted = hidden.select(F.explode(words(F.col("title"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    applied = log.where(F.col("kind") == "applied").select(F.explode(words(F.col("title"))).alias("word")).distinct()
    return counted.join(applied, "word", "left_anti")


def learned_words(log: DataFrame, min_hits: int = 3, reason: str = "wrong field") -> DataFrame:
    return word_counts(log, reason).where(F.col("n") >= min_hits)


def suggestions(log: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent words of hidden rows that occur at least twice."""
    return word_counts(log).where(F.col("n") >= 2).orderBy(F.col("n").desc(), "word").limit(top)


def rejected_pairs(log: DataFrame) -> DataFrame:
    """(company, title) in lower case that were hidden and not applied to."""
    pair = lambda kind: log.where(F.col("kind") == kind).select(F.lower(text(F.col("company"))).alias("company"), F.lower(text(F.col("title"))).alias("title"))
    return pair("hidden").distinct().join(pair("applied").distinct(), ["company", "title"], "left_anti")
