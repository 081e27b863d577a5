"""What the corpus operators share: scratch tables, keys and label samples."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

class _Written(threading.local):
    """Scratch tables that a thread of this driver has written: runs in other threads clear their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()
#: Documents' columns, in the order in which every pipeline stage returns them.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the session's ``spark.checkpoint.dir``, which every executor reaches. Where
    that is unset, the warehouse is as shared; a session in local mode, as in tests,
    takes a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = re.match(r"local(\[|$)", spark.sparkContext.master)
        root = "file://" + tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tidemark-scratch"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared scratch folder as Parquet and reads it back.

    This cuts lineage: a lost executor costs a reread of the table, not a
    recomputation, and rows that later steps use twice are computed once. Rows are
    rebalanced first, so a small table is a few files, not one for each task.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.paths.append(path)
    df.hint("rebalance").write.mode("overwrite").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tidemark_path = path
    return table


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(table: DataFrame) -> None:
    """Deletes a table of materialize that nothing needs any more."""
    if table._tidemark_path in _written.paths:
        _written.paths.remove(table._tidemark_path)
        _delete(table.sparkSession, table._tidemark_path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What is written inside sends Python workers batches of fewer rows, for work whose results are larger than its texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session sends Python workers batches of at most so many rows.

    For stages that hand whole texts to functions and are written by their caller: both ends of the pipe keep the
    buffers of the largest batch that they have seen.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def forget_shuffles(spark: SparkSession) -> None:
    """Lets the driver find out which shuffles nothing refers to any more; Spark deletes their files then.

    Without it files of a long chain of steps stay on the executors' disks until the driver's heap fills.
    """
    gc.collect()  # plans that Python still names keep theirs
    spark.sparkContext._jvm.System.gc()


def scratch_mark() -> int:
    """How many scratch tables this thread of the driver has written and not deleted so far."""
    return len(_written.paths)


def clear_scratch(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes the scratch tables that this thread of the driver has written since a mark, but for the last if asked.

    Results that are not written yet must not need them.
    """
    paths = _written.paths[since:]
    kept = [paths.pop()] if keep_last and paths else []
    for name in paths:
        _delete(spark, name)
    _written.paths[since:] = kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame) -> DataFrame:
    """df with names that no table of documents has, to be joined to one."""
    return df.select(*[F.col(c).alias(f"_tidemark_{c}") for c in df.columns])


#: Bits of a sieve: about eight for each key, within these bounds. The largest is 32 MB.
LEAST_SIEVE, MOST_SIEVE = 1 << 16, 1 << 28


def _marked(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """df with _tidemark_passes: false where the long in column is certainly none of keys."""
    (key,) = keys.columns
    bits, count = LEAST_SIEVE, keys.count()
    while bits < min(8 * count, MOST_SIEVE):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(F.lit(3), c), F.lit(bits))
    held = keys.select(place(F.col(key)).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("_tidemark_bucket"))
    # At most MOST_SIEVE bits in rows of 32,768: safe to broadcast at any table size.
    held = F.broadcast(held.agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_tidemark_bits")))
    joined = df.withColumn("_tidemark_place", place(F.col(column))).withColumn("_tidemark_bucket", F.bitmap_bucket_number("_tidemark_place")).join(held, "_tidemark_bucket", "left")
    at = F.bitmap_bit_position("_tidemark_place")
    byte = F.conv(F.hex(F.substring("_tidemark_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8).cast("int") + 1)
    return joined.select(*df.columns, F.coalesce(byte.bitwiseAND(mask) != 0, F.lit(False)).alias("_tidemark_passes"))


def sifted(df: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose long in column may be one of keys, the others), without a shuffle.

    A bitmap of the keys' hashes is broadcast. Its size is bounded: it grows with the number
    of keys up to MOST_SIEVE bits, beyond which more and more rows may pass; an exact join
    has to follow in any case. keys: one long column, of a written table.
    """
    marked = _marked(df, column, keys)
    return tuple(marked.where(test).drop("_tidemark_passes") for test in (F.col("_tidemark_passes"), ~F.col("_tidemark_passes")))


def sieve(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The first part of sifted."""
    return sifted(df, column, keys)[0]


def same_document(doc_id: str, text_hash: str) -> Column:
    """A join condition: rows of documents that agree with a key in doc_id, nulls included, and text."""
    return F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.xxhash64("text") == F.col(text_hash))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model here learns from; null for a null id, which none learns from either."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def stretch(text: Column, by: Column, chars: int) -> Column:
    """A text of at most so many characters as it is; of a longer one a stretch of that length, from a place that a hash gives."""
    n = F.length(text)
    start = F.pmod(F.xxhash64(F.lit(11), by), F.greatest(n - chars + 1, F.lit(1))).cast("int")
    return F.when(n <= chars, text).otherwise(F.substring(text, start + 1, F.lit(chars)))


def label_sample(docs: DataFrame, labels: DataFrame, label: str, rows: tuple[int, int], max_chars: int) -> DataFrame:
    """(doc_id, text, label) of at most rows[0] learnable rows of label 0 and rows[1] of label 1.

    Rows are taken in the order of a hash of doc_id, so the sample does not depend on how
    the tables are partitioned. Of a text over max_chars a stretch of that length stands for it
    (in the sample only: whole texts are scored), so the sample's size is bounded whatever the
    texts are. An id labelled both ways counts as 1; of an id's texts the smallest is taken.
    """
    learnable = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for value in (0, 1):
        part = learnable.where(F.col("label") == value).orderBy(*order).limit(rows[value])
        chosen = part if chosen is None else chosen.unionAll(part)
    # At most sum(rows) rows of two numbers each: safe to broadcast at any table size.
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    # An id may stand in many rows; one text of each keeps the sample within its bound.
    cut = texts.select("doc_id", stretch(F.col("text"), F.col("doc_id"), max_chars).alias("text"), "label")
    return cut.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def label_counts(labels: DataFrame, label: str) -> dict[int, int]:
    rows = (
        labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col(label).cast("int").alias("label"))
        .count()
        .where(F.col("label").isin(0, 1))
        .collect()  # two rows
    )
    return {r["label"]: r["count"] for r in rows}


def fit_logistic(x, y, weight, ridge: float = 1e-3, steps: int = 60):
    """Weighted logistic regression by Newton's method; x has no intercept column.

    Returns (mean, scale, coefficients with the intercept first). With one class
    only, or no rows, it returns an intercept that states the prior.
    """
    import numpy as np

    n, k = x.shape
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if n else (np.zeros(k), np.ones(k))
    beta = np.zeros(k + 1)
    total = weight.sum()
    if n == 0 or total == 0 or y.min() == y.max():
        share = (float((weight * y).sum()) + 0.5) / (float(total) + 1.0)
        beta[0] = np.log(share / (1 - share))
        return mean, scale, beta
    z = np.hstack([np.ones((n, 1)), (x - mean) / scale])
    w = weight / total
    penalty = np.full(k + 1, ridge)
    penalty[0] = 0.0

    def loss(b):
        m = z @ b
        return float((w * (np.logaddexp(0, m) - y * m)).sum() + 0.5 * (penalty * b * b).sum())

    now = loss(beta)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -35, 35)))
        gradient = z.T @ (w * (p - y)) + penalty * beta
        hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and (after := loss(beta - size * step)) > now:
            size /= 2
        if size <= 1e-6:
            break
        beta = beta - size * step
        if now - after < 1e-10:
            break
        now = after
    return mean, scale, beta
