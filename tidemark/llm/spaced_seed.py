"""Benchmark decontamination by spaced seeds.

A fixed mask keeps some positions of a run of tokens and ignores the others, so two
runs that differ only at ignored positions have equal hashes. The benchmark's seed
hashes are joined to those of every window of every document; around each hit, the
whole item is laid against the document along the hit's diagonal and the share of
its tokens that agree decides. Items shorter than the masks are matched whole.

The hot path is built-in expressions in one scan of the documents. A benchmark of at most
SEED_ROWS hashes is broadcast. A larger one is not: a bitmap of bounded size sieves the
windows in that same scan, and what passes meets the hashes in an equi-join, which adaptive
execution splits where a seed is common; documents are not read once for each block of the
benchmark. Items with equal tokens are searched for once.

Defined results: null or empty texts and items without tokens match nothing; an item
that stands in one document several times gives one row, the best; equal items each
give a row; rows that agree in doc_id and text count as one document; a null item_id
is kept as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Fixed masks over nine tokens, six of them kept.
MASKS = ("110110011", "101011101", "111101010")
#: Share of an item's tokens that must agree, and the most hashes that are broadcast.
MIN_OVERLAP, SEED_ROWS = 0.6, 1_000_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, hashed to longs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _kept(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _seeds(df: DataFrame, masks: list[str], carry: list[str]) -> DataFrame:
    """carry, pos and seed of every window of every mask; df has the token array t."""
    span = max(map(len, masks))
    # The window's columns are shifts of the token array; those past the end are null.
    shifted = F.arrays_zip(*[F.slice("t", F.lit(i + 1), F.greatest(F.size("t") - i, F.lit(0))).alias(f"w{i}") for i in range(span)])
    windows = df.where(F.size("t") > 0).select(*carry, F.posexplode(shifted).alias("pos", "w"))
    seed = [
        F.when(F.col(f"w.w{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(int(m, 2)), *[F.col(f"w.w{i}") for i in _kept(m)]))
        for m in masks
    ]
    return windows.select(*carry, "pos", F.explode(F.array(*seed)).alias("seed")).where(F.col("seed").isNotNull())


def find(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP, seed_rows: int = SEED_ROWS) -> DataFrame:
    """One row for each (document, item) whose overlap reaches min_overlap.

    doc_id, th (hash of the text), item_id, start (token of the document at which the
    item begins; may be negative at a text's start), n_tokens, n_match, overlap.
    """
    named = benchmark.select(F.struct("item_id", F.xxhash64("text").alias("h")).alias("named"), tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    named = common.materialize(named.dropDuplicates(["named"]), "items-named")
    items = common.materialize(named.groupBy("t").agg(F.min("named").alias("item")), "items")
    span = max(map(len, MASKS))
    short = [r[0] for r in items.where(F.size("t") < span).select(F.size("t")).distinct().orderBy(F.size("t")).collect()]
    masks = [*MASKS, *["1" * n for n in short]]  # at most span - 1 more
    seeds = _seeds(items.where(F.size("t") >= span), list(MASKS), ["item", "t"])
    for n in short:  # a short item answers to the mask of its own length only
        seeds = seeds.unionAll(_seeds(items.where(F.size("t") == n), ["1" * n], ["item", "t"]))
    seeds = common.materialize(seeds.select("seed", "item", F.col("pos").alias("at"), F.size("t").alias("n")), "seeds")
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), tokens(F.col("text")).alias("t"))
    start = (F.col("pos") - F.col("at")).alias("start")
    if seeds.count() <= seed_rows:
        met = _seeds(texts, masks, ["doc_id", "th", "t"]).join(F.broadcast(seeds), "seed").select("doc_id", "th", "item", start, "n", "t")
    else:
        windows = common.sieve(_seeds(texts, masks, ["doc_id", "th"]), "seed", seeds.select("seed"))
        found = windows.join(seeds, "seed").select("doc_id", "th", "item", start, "n").distinct()
        found = common.private(common.materialize(found, "seeds-met"))
        again = common.sieve(texts, "th", found.select("_tidemark_th"))
        match = F.col("doc_id").eqNullSafe(F.col("_tidemark_doc_id")) & (F.col("th") == F.col("_tidemark_th"))
        met = again.join(found, match).select("doc_id", "th", F.col("_tidemark_item").alias("item"), F.col("_tidemark_start").alias("start"), F.col("_tidemark_n").alias("n"), "t")
    hits = met.select(
        "doc_id", "th", "item", "start",
        # The item's stretch of the document; it may be cut at either end of the text.
        F.greatest(F.lit(0), -F.col("start")).alias("skip"),
        F.slice("t", F.greatest(F.col("start") + 1, F.lit(1)), F.greatest(F.col("n") + F.least(F.col("start"), F.lit(0)), F.lit(0))).alias("there"),
    )
    places = hits.groupBy("doc_id", "th", "item", "start").agg(F.first("skip").alias("skip"), F.first("there").alias("there"))
    agree = F.zip_with(
        F.slice("t", F.col("skip") + 1, F.size("there")), "there", lambda a, b: F.when(a == b, 1).otherwise(0)
    )
    laid = places.join(items, "item").select(
        "doc_id", "th", "item", "start", F.size("t").alias("n_tokens"),
        F.aggregate(agree, F.lit(0), lambda s, x: s + x).alias("n_match"),
    )
    best = laid.groupBy("doc_id", "th", "item").agg(
        F.max(F.struct("n_match", (-F.col("start")).alias("first"), "n_tokens")).alias("b")
    )
    overlap = F.col("b.n_match") / F.col("b.n_tokens")
    alike = named.join(items, "t").select("item", "named")
    return best.where(overlap >= min_overlap).join(alike, "item").select(
        "doc_id", "th", F.col("named.item_id").alias("item_id"), (-F.col("b.first")).cast("long").alias("start"),
        F.col("b.n_tokens").cast("long").alias("n_tokens"), F.col("b.n_match").cast("long").alias("n_match"), overlap.alias("overlap"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """The documents in which no benchmark item was found."""
    found = common.materialize(find(docs, benchmark, min_overlap).select("doc_id", "th").distinct(), "leaks")
    return docs.join(common.private(found), common.same_document("_tidemark_doc_id", "_tidemark_th"), "left_anti")
