"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents; the last returns the packed pieces of what the others kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, line_spread, near_pairs, packing, spaced_seed, zstd_quality


def _as_documents(df: DataFrame) -> DataFrame:
    return df.select(*common.DOCUMENT_COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the compression classifier rejects.

    A null or empty text has no evidence against it: it gets the classes' shares, and goes only if most labelled
    documents are bad. Repeated rows are judged alike; columns besides those of documents are left out.
    """
    model = zstd_quality.fit(docs, common.table(spark, sf_dir, "labels"))
    return _as_documents(zstd_quality.keep_good(docs, model))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of all places but their first.

    A document of which nothing is left goes: every line of it stands elsewhere. n_chars follows the text. Null and
    empty texts stay as they are; a null source is no site; of places with equal doc_id, line number and text all stay.
    """
    cleaned = line_spread.remove_boilerplate(_as_documents(docs))
    emptied = (F.col("n_removed") > 0) & (F.trim("text", F.lit(" \t\r\n")) == "")
    kept = cleaned.where(~emptied)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return _as_documents(kept.withColumn("n_chars", n_chars))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest doc_id: five-word shingles, similarity 0.8.

    Null and empty texts are one group. Of a group without any doc_id one row stays, and one of repeated rows.
    """
    return _as_documents(near_pairs.keep_one(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item. Null and empty texts hold none; an empty benchmark drops nothing."""
    return _as_documents(spaced_seed.drop_leaks(docs, common.table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of at most 4096 tokens. A null or empty text is one piece, the end id; repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: A compression classifier and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = common.table(spark, sf_dir, "documents"), common.scratch_mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage{k}")
        common.clear_scratch(spark, mark, keep_last=True)  # what the stage wrote on its way, and its input
    return docs
