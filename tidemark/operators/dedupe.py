"""One row for each key, with explicit ties: the ordinal of the input decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import squash, text
from tidemark.functions.url import job_address


def dedupe_key() -> Column:
    """Employer, title and place; without a place the advert's opening tells postings apart."""
    place = squash(F.col("location"))
    return F.struct(
        text(F.col("company")).alias("company"),
        squash(F.col("title")).alias("title"),
        F.when(place == "", F.left(F.regexp_replace(F.lower(text(F.col("description"))), "[^a-z0-9]+", " "), F.lit(300))).otherwise(place).alias("place"),
    )


def best_per(df: DataFrame, key: Column, *order: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key by order.

    The winner is found by an aggregate over a struct, so a hot key is combined before the
    shuffle and no group is sorted in one task. order: columns that sort ascending and end
    with a unique one. keep: the columns to go on with, all if none are named; only these are shuffled.
    """
    own = keep or df.columns
    keyed = df.select(key.alias("_key"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_order"), F.struct(*own).alias("_row"))
    best = keyed.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row"))
    return best.select("_row.*")


def best_posting(postings: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of equal dedupe keys the best score, then the earliest ordinal."""
    return best_per(postings, dedupe_key(), -F.col("score"), F.col("ordinal"), keep=keep)


def best_address(board: DataFrame) -> DataFrame:
    """Of equal addresses the last seen, then the best score, then the earliest ordinal; rows without an address all stay."""
    address = job_address(F.col("url"))
    key = F.when(address == "", F.concat(F.lit("id:"), F.col("id"))).otherwise(address)
    return best_per(board, key, -F.unix_micros("last_seen"), -F.col("score"), F.col("ordinal"))


def first_per(df: DataFrame, *key: str) -> DataFrame:
    """The earliest ordinal of each key."""
    return best_per(df, F.struct(*key), F.col("ordinal"))


def capped(df: DataFrame, by: str, n: int, last: bool = False) -> DataFrame:
    """The first (or last) n rows of each group by ordinal.

    Spark limits a ranked window in each task before its shuffle (up to a thousand rows), so of a hot group no more
    than n rows of each task meet.
    """
    order = F.col("ordinal").desc() if last else F.col("ordinal")
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")
