"""The driver's tables in the shapes that the posting operators take."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_or(spark: SparkSession, path: str, schema: str, default: list[tuple] = ()) -> DataFrame:
    """A JSON table; the default rows where the file is missing, or where nothing in it can be read.

    Broken records of a table that can be read otherwise are left out.
    """
    try:
        rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", True).json(path)
        good = rows.where(F.col("_broken").isNull()).drop("_broken")
        if not good.isEmpty():
            return good
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame(list(default), schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the scratch folder and read back, where several steps need it."""
    from tidemark.streaming.lifecycle import scratch

    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for work that costs far more than moving its rows.

    A table of many files has that already and is left as it is; one of a few row groups would run in a few tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df dealt evenly over at least as many partitions as there are cores, for much work on narrow rows.

    A file of narrow rows is a few partitions however many rows it has, and one row group is a single one's.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as postings: the first line is the title, the source the employer, the language the place."""
    docs = read(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    return docs.select(
        "doc_id", F.col("doc_id").alias("ordinal"), F.col("n_chars"),
        F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), F.col("source").alias("company"),
        F.col("lang").alias("location"), F.concat(F.lit("https://"), "source", F.lit(".example/jobs/"), number).alias("url"),
        F.coalesce("text", F.lit("")).alias("description"), F.lit("").alias("department"), F.lit("").alias("employment_type"),
        F.lit(False).alias("researched"), F.lit(None).cast("int").alias("permits"), F.lit(None).cast("string").alias("sponsor_confidence"),
        F.col("source").alias("sector"), F.lit(None).cast("string").alias("entry_routes"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a feedback log over the postings: toxic is hidden, good and not toxic is applied to."""
    labels = read(spark, sf_dir, "labels")
    kind = F.when(F.col("toxic") == 1, "hidden").when((F.col("quality") == 1) & (F.col("toxic") == 0), "applied")
    marked = labels.select("doc_id", kind.alias("kind")).where(F.col("kind").isNotNull())
    return postings(spark, sf_dir).join(marked, "doc_id").select(
        "kind", F.col("doc_id").cast("string").alias("id"), "title", "company", F.when(F.col("kind") == "hidden", "wrong field").alias("reason")
    )


#: Two scans: events before and from this instant.
CUT = "2024-01-16 00:00:00"
NOW = "2024-01-31 00:00:00"


def scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(board, scan) from the events of two halves of the month; a posting is a user's kind of event."""
    events = read(spark, sf_dir, "events").select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("id"), (F.col("user_id") % 10).cast("string").alias("company"), "ts", "value"
    )
    cut = F.lit(CUT).cast("timestamp")
    board = events.where(F.col("ts") < cut).groupBy("id", "company").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    board = board.select("*", (F.length("id") % 4 == 0).alias("closed"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(False).alias("is_new"))
    # Of the second half only purchases, views and clicks of some employers come back.
    scan = events.where((F.col("ts") >= cut) & (F.col("value") < 20)).select("id", "company").distinct()
    return board, scan


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings as a served board: score from the length, first seen a day earlier for each hundred ids."""
    p = postings(spark, sf_dir)
    score = (F.col("n_chars") % 101).cast("int")
    return p.select(
        F.col("doc_id").alias("id"), "title", "company", "location", "description", score.alias("score"),
        F.expr(f"timestamp'{NOW}' - make_interval(0, 0, 0, cast(doc_id % 30 as int), cast(doc_id % 24 as int))").alias("first_seen"),
        (F.col("doc_id") % 17 == 0).alias("closed"), F.when(F.col("doc_id") % 13 == 0, "blocked").otherwise("eligible").alias("eligibility"),
    )


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as a user's marks: toxic is hidden, low quality was applied to."""
    labels = read(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("job_id"), F.when(F.col("quality") == 0, "applied").alias("status"), (F.col("toxic") == 1).alias("hidden"))
