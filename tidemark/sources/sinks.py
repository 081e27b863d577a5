"""Where results go: board snapshots, statistics, the application list, sealed files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import text


def write_board(board: DataFrame, path: str) -> None:
    """A snapshot as Parquet, and beside it as JSON lines."""
    board.write.mode("overwrite").parquet(f"{path}/parquet")
    board.write.mode("overwrite").json(f"{path}/json")


def run_stats(board: DataFrame, drops: DataFrame, health: DataFrame, top: int = 25) -> DataFrame:
    """One row: totals, counts by band and by drop reason, and the feeds that fail most.

    Bands and reasons are few; of the feeds the `top` by failures are kept.
    """
    bands = board.groupBy("band").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("band", "n")))).alias("by_band"))
    reasons = drops.groupBy("drop_reason").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("drop_reason", "n")))).alias("by_reason"))
    totals = board.agg(F.count(F.lit(1)).alias("postings"), F.count_if(F.coalesce("is_new", F.lit(False))).alias("new"), F.count_if(F.coalesce("closed", F.lit(False))).alias("closed"))
    worst = health.where(F.col("fails") > 0).orderBy(F.col("fails").desc(), "name").limit(top)
    errors = worst.agg(F.array_sort(F.collect_list(F.struct((-F.col("fails")).alias("rank"), "name", "last_error"))).alias("errors"))
    return totals.crossJoin(bands).crossJoin(reasons).crossJoin(errors)  # one row each


def summary(stats: DataFrame) -> DataFrame:
    """The statistics as a short text."""
    part = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"].cast("string"))), "\n")
    return stats.select(
        F.concat_ws(
            "\n", F.concat(F.lit("# "), F.col("postings").cast("string"), F.lit(" postings, "), F.col("new").cast("string"), F.lit(" new")),
            part("by_band"), F.lit("Dropped"), part("by_reason"),
        ).alias("text")
    )


APPLICATION_COLUMNS = (
    "job_id", "status", "applied_at", "title", "company", "location", "url", "department", "employment_type", "salary", "posted_at", "closes_at",
    "first_seen", "last_seen", "closed", "score", "band", "sponsor_tier", "permits", "eligibility", "source", "note",
)


def applications(state: DataFrame, board: DataFrame) -> DataFrame:
    """The application list: 22 columns, latest first; of a posting that left the board what the mark's snapshot holds.

    state: job_id, status, applied_at, note, snapshot (struct of posting columns).
    """
    marks = state.where(F.col("applied_at").isNotNull()).join(board.withColumnRenamed("id", "job_id"), "job_id", "left")
    kept = {f.name for f in state.schema["snapshot"].dataType.fields}
    on_board = set(board.columns)
    own = set(state.columns)

    def column(name: str) -> Column:
        if name in own:
            return F.col(name)
        found = ([F.col(name)] if name in on_board else []) + ([F.col(f"snapshot.{name}")] if name in kept else [])
        return F.coalesce(*found, F.lit(None).cast("string")).alias(name)

    return marks.select(*[column(c) for c in APPLICATION_COLUMNS]).orderBy(F.col("applied_at").desc(), "job_id")


def write_applications(state: DataFrame, board: DataFrame, path: str) -> None:
    applications(state, board).write.mode("overwrite").option("header", True).csv(path)


def derive_key(phrase: str, salt: bytes, rounds: int = 600_000) -> bytes:
    """A 256-bit key from a phrase, once, on the driver."""
    return hashlib.pbkdf2_hmac("sha256", phrase.encode(), salt, rounds, 32)


def seal(content: Column, key: bytes, magic: bytes) -> Column:
    """magic, then a random nonce of 12 bytes, then AES-GCM cipher text and tag."""
    return F.concat(F.lit(magic), F.aes_encrypt(text(content).cast("binary"), F.lit(key), F.lit("GCM")))


def unseal(sealed: Column, key: bytes, magic: bytes) -> Column:
    """The text of a sealed value; null if it does not begin with magic or the key is wrong."""
    body = F.substring(sealed, F.lit(len(magic) + 1), F.length(sealed))
    opened = F.try_aes_decrypt(body, F.lit(key), F.lit("GCM")).cast("string")
    return F.when(F.substring(sealed, F.lit(1), F.lit(len(magic))) == F.lit(magic), opened)
