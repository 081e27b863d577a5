"""The persisted board: merging scans, closing, re-opening, ageing, feed health and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.config import MAX_AGE_DAYS, NEW_HOURS, QUARANTINE_AFTER, QUARANTINE_RETRY, SHARDS, SLOT_SECONDS


def merge_scan(board: DataFrame, scan: DataFrame, scanned: DataFrame, now: Column) -> DataFrame:
    """The board after a scan: id, company, first_seen, last_seen, closed, closed_at, is_new.

    board: those columns; scan: id, company of what was seen now; scanned: company of the
    employers that answered. What was not seen closes only if its employer was scanned; what
    is seen again opens. The employer test is an aggregate joined to the stored rows, before new
    ones without an employer of their own come in: a large employer's rows are split by adaptive
    execution like any equi-join, and no null key gathers.
    """
    old = board.select("id", *[F.col(c).alias(f"_{c}") for c in ("company", "first_seen", "last_seen", "closed", "closed_at", "is_new")])
    seen = scan.select("id", "company").dropDuplicates(["id"]).withColumn("_seen", F.lit(True))
    answered = scanned.select(F.col("company").alias("_company")).distinct().withColumn("_answered", F.lit(True))
    both = old.join(answered, "_company", "left").join(seen, "id", "full_outer")
    is_seen, known = F.coalesce("_seen", F.lit(False)), F.col("_first_seen").isNotNull()
    was_closed = F.coalesce("_closed", F.lit(False))
    closes = ~is_seen & ~was_closed & F.coalesce("_answered", F.lit(False))
    return both.select(
        "id",
        F.coalesce("company", "_company").alias("company"),
        F.when(known, F.col("_first_seen")).otherwise(now).alias("first_seen"),
        F.when(is_seen, now).otherwise(F.col("_last_seen")).alias("last_seen"),
        (~is_seen & (was_closed | closes)).alias("closed"),
        F.when(is_seen, F.lit(None)).when(closes, now).otherwise(F.col("_closed_at")).alias("closed_at"),
        F.when(known, F.col("_is_new")).otherwise(F.lit(True)).alias("is_new"),
    )


def age_out(board: DataFrame, now: Column, max_days: int = MAX_AGE_DAYS, new_hours: int = NEW_HOURS) -> DataFrame:
    """Without what was last seen over max_days ago; an unknown last_seen counts as now. is_new lasts new_hours."""
    seconds = lambda c: F.unix_micros(now) - F.unix_micros(c)
    last = F.coalesce("last_seen", now)
    return board.where(seconds(last) <= max_days * 86_400_000_000).withColumn(
        "is_new", F.coalesce(seconds(F.col("first_seen")) < new_hours * 3_600_000_000, F.lit(False))
    )


def failure_streaks(scans: DataFrame) -> DataFrame:
    """name, fails (failures since the last success), last_ok and last_error.

    scans: name, ts, ok, error. Two aggregates and a join, so no feed's history is sorted in one task.
    """
    last = scans.groupBy("name").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"))
    since = scans.join(last, "name").where(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok"))))
    fails = since.groupBy("name").agg(F.count(F.lit(1)).alias("fails"), F.max_by("error", "ts").alias("last_error"))
    return last.join(fails, "name", "left").select("name", F.coalesce("fails", F.lit(0)).cast("long").alias("fails"), "last_ok", "last_error")


def quarantined(fails: Column, slot: Column, after: int = QUARANTINE_AFTER, every: int = QUARANTINE_RETRY) -> Column:
    """Feeds that failed too often are asked only in every so many slots."""
    return (fails >= after) & (F.pmod(slot, F.lit(every)) != 0)


def slot_of(now: Column) -> Column:
    return F.floor(F.unix_seconds(now) / SLOT_SECONDS).cast("long")


def with_rank(df: DataFrame, by: str, pieces: int = 200) -> DataFrame:
    """df with _rank, the place of each row (from 0) in the order of a unique long column, without one task sorting it all.

    Rows are cut into pieces at quantiles; a piece's rows are ranked among themselves, after all rows of the pieces before.
    """
    cuts = df.agg(F.percentile_approx(by, [i / pieces for i in range(1, pieces)], 10_000).alias("_cuts"))  # one row
    cut = df.join(F.broadcast(cuts)).withColumn("_piece", F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c < F.col(by)))).drop("_cuts")
    sizes = cut.groupBy("_piece").agg(F.count(F.lit(1)).alias("n"))  # at most `pieces` rows, so one task may hold them
    before = sizes.select("_piece", (F.sum("n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_piece").orderBy(by)) - 1
    return cut.join(F.broadcast(before), "_piece").withColumn("_rank", F.col("_before") + own).drop("_piece", "_before")


def pick_shard(companies: DataFrame, slot: int, shards: int = SHARDS) -> DataFrame:
    """Priority employers, and of the rest those whose rank by ordinal falls into the slot's shard.

    companies: the employer list, with priority and a unique ordinal.
    """
    rest = companies.where(~F.coalesce("priority", F.lit(False)))
    ranked = with_rank(rest, "ordinal").where(F.col("_rank") % shards == slot % shards)
    return companies.where(F.coalesce("priority", F.lit(False))).unionByName(ranked.drop("_rank"))


def growth_cap(candidates: DataFrame, tracked: DataFrame, cap: int) -> DataFrame:
    """New employers by permits, as many as the cap leaves room for; tracked ones are never displaced.

    Taking the top of an ordered list is a limit: each task keeps its best rows only.
    """
    room = max(0, cap - tracked.count())
    return candidates.join(tracked.select("name"), "name", "left_anti").orderBy(F.col("permits").desc(), "name").limit(room)
