"""Groups of texts whose word five-grams have a Jaccard similarity of 0.8 or more, exactly.

The pipeline's near-duplicate stage. Texts that agree but for case and blanks are one
node. SimHash groups of three differing bits give the first candidates; they alone would
lose most pairs near 0.8, so nodes also meet on shared five-grams. Two sets with
similarity s share an element among the first n - ceil(s * n) + 1 of each, in any order
common to all sets (the prefix filter): no pair is lost. The order puts elements that
are common in a bounded sample of texts last, so widespread passages rarely make nodes
meet; those on which many nodes meet all the same are put behind them, and the nodes that
met there get new first elements. The sample and the counts decide only the order, never the result.

Candidates go through three tests, none of which loses a pair: their sizes; the places of
the element on which they meet, which cannot lie so far back that too few are left to share;
and the distance of parity sketches (a bit for each residue of the element's hash, flipped
by each element), which the symmetric difference of two sets cannot fall below. What is left
is verified on the whole sets. Work goes in two turns: first the links of SimHash, and each
node with the one that it meets most often among the first ones of its meetings, in two
orders, which joins large groups by a number of pairs linear in their size; then all pairs
of a meeting that are not in one component yet. Pairs within a component need no test, so
components are those of all pairs.

Texts are not shuffled whole: a bitmap of bounded size sieves the rows that a step asks
for, and an exact join behind it decides.

Defined results: null text counts as empty; a text under five words is one shingle;
texts without words are one node; of rows without doc_id in a group of such rows only,
one stays; repeated rows are reduced to one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, components, simhash_bk

SHINGLE, SEED = 5, 42
#: The similarity as a fraction, so that bounds are integers.
NEAR, OF = 4, 5
#: Texts of the sample that orders the elements, and in how many of them an element is common.
SAMPLE, COMMON, MOST_COMMON = 4000, 4, 200_000
#: A key on which more rows than this meet is crowded; how many crowded ones are ordered last, and how often that is tried.
CROWD, MOST_CROWDED, REORDERS = 1000, 200_000, 3
#: Bits of the smallest and of the largest parity sketch.
LEAST_SKETCH, MOST_SKETCH = 64, 1 << 16


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # as simhash_bk.fingerprint_of


def node_of(text: str | None) -> int:
    """Names a text by its words."""
    return xxhash.xxh64_intdigest(b" ".join(_words(text)), SEED)


def shingles_of(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's word five-grams, ascending, unsigned."""
    words = _words(text)
    joined = b" ".join(words)
    digest, n = xxhash.xxh64_intdigest, len(words) - SHINGLE + 1
    if n <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)), np.uint64, n))


def prefix_of(hashes: np.ndarray, common_hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The elements on which a set meets all sets that are near to it; common_hashes ascend, ranks are their places among the last."""
    n = len(hashes)
    most = n - (NEAR * n + OF - 1) // OF + 1
    if not len(common_hashes):
        return hashes[:most]
    at = np.minimum(np.searchsorted(common_hashes, hashes), len(common_hashes) - 1)
    rank = np.where(common_hashes[at] == hashes, ranks[at], 0)
    return hashes[np.argsort(rank, kind="stable")[:most]]


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch as longs: about two bits an element, a power of two of them."""
    bits = LEAST_SKETCH
    while bits < min(2 * len(hashes), MOST_SKETCH):
        bits *= 2
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def sketch_distance(a: Column, b: Column) -> Column:
    """Differing bits of two parity sketches; the longer is folded to the shorter's length first."""
    bits = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)
    short, long_ = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    width, times = F.size(short), (F.size(long_) / F.size(short)).cast("int")
    fold = F.transform(
        F.sequence(F.lit(1), width),
        lambda i: F.aggregate(F.sequence(F.lit(0), times - 1), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.element_at(long_, k * width + i))),
    )
    return F.when(F.size(a) == F.size(b), bits(a, b)).otherwise(bits(short, fold))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements that stand in several texts of a bounded sample, ascending, and their ranks from the rarest up."""
    texts = docs.select(F.xxhash64("text").alias("th")).distinct().orderBy(F.xxhash64("th"), "th").limit(SAMPLE)
    # At most SAMPLE rows of one number: safe to broadcast at any table size. A text that stands in many rows counts once.
    some = docs.select("text", F.xxhash64("text").alias("th")).join(F.broadcast(texts), "th").groupBy("th").agg(F.min("text").alias("text"))

    def elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles_of(t) for t in frame["text"]]
            yield pd.DataFrame({"h": (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64)})

    counts = some.select("text").mapInPandas(elements, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.where(F.col("n") >= COMMON).orderBy(F.col("n").desc(), "h").limit(MOST_COMMON).collect()
    hashes = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    ranks = np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def _prints(docs: DataFrame, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One pass over the texts: doc_id, th (hash of the text), fp, node, n (elements), sketch and keys (the prefix) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):  # long texts have long prefixes
                part = frame.iloc[at : at + 256]
                sets = [shingles_of(t) for t in part["text"]]
                yield pd.DataFrame(
                    {
                        "doc_id": part["doc_id"].astype("Int64").to_numpy(),
                        "th": part["th"].to_numpy(),
                        "fp": np.array([simhash_bk.fingerprint_of(t) for t in part["text"]], np.uint64).view(np.int64),
                        "node": np.array([node_of(t) for t in part["text"]], np.uint64).view(np.int64),
                        "n": [len(s) for s in sets],
                        "sketch": [sketch_of(s) for s in sets],
                        "keys": [prefix_of(s, *shared.value).view(np.int64) for s in sets],
                    }
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInPandas(
        read, "doc_id long, th long, fp long, node long, n int, sketch array<long>, keys array<long>"
    )
    with common.small_batches(docs.sparkSession):
        return common.materialize(rows, "near-prints")


def _behind(order: tuple[np.ndarray, np.ndarray], crowded: list) -> tuple[np.ndarray, np.ndarray]:
    """The order with the crowded keys (key, rows) behind all others, the most crowded last."""
    rank = dict(zip(order[0].tolist(), order[1].tolist(), strict=True))
    most = max(rank.values(), default=0)
    rank |= {r["key"] % (1 << 64): max(most, SAMPLE) + r["rows"] for r in crowded}
    hashes = np.array(sorted(rank), np.uint64)
    return hashes, np.array([rank[h] for h in hashes.tolist()], np.int64)


def _first_elements(order: Broadcast):
    """A function of texts: their prefixes under a broadcast order."""

    @F.pandas_udf("array<long>")
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([prefix_of(shingles_of(t), *order.value).view(np.int64) for t in texts], dtype=object)

    return first


def _meetings(docs: DataFrame, prints: DataFrame, nodes: DataFrame, order: tuple[np.ndarray, np.ndarray], crowd: int) -> DataFrame:
    """(key, node, n, at) of the nodes that meet others on a key; at: the key's place among the node's elements.

    Copies and widespread keys are combined before the shuffle that finds the keys of two nodes or more; only rows of
    such keys (sieved first) are shuffled to be told apart. Keys on which more than `crowd` rows meet are put last in the
    order. That changes the prefix only of the nodes that had them there, whose texts are read again. What is
    left crowded after REORDERS turns stands in texts that consist of such passages.
    """
    kept = prints.select("node", "n", "keys")
    for turn in range(REORDERS + 1):
        dealt = kept.select("node", "n", F.posexplode("keys").alias("at", "key"))
        shared = dealt.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("rows"))
        shared = common.materialize(shared.where("a != b").select("key", "rows"), "near-keys")
        crowded = shared.where(F.col("rows") > crowd).orderBy(F.col("rows").desc(), "key").limit(MOST_CROWDED).collect()
        known = set(order[0].tolist()) if turn else set()
        if turn == REORDERS or all(r["key"] % (1 << 64) in known for r in crowded):
            break
        order = _behind(order, crowded)
        # At most MOST_CROWDED rows of one number: safe to broadcast at any table size.
        keys = F.broadcast(docs.sparkSession.createDataFrame([(r["key"],) for r in crowded], "key long"))
        moved = dealt.join(keys, "key", "left_semi").select("node").distinct()
        moved = common.materialize(nodes.join(moved, "node", "left_semi").select("node", "doc_id", "th", "n"), "near-moved")
        first = _first_elements(docs.sparkSession.sparkContext.broadcast(order))
        fresh = _texts_of(docs, moved).join(moved.select("node", "n"), "node").select("node", "n", first("text").alias("keys"))
        with common.small_batches(docs.sparkSession):
            fresh = common.materialize(fresh, "near-reordered")
        kept = kept.join(moved.select("node"), "node", "left_anti").unionByName(fresh)
        common.release(shared)
        common.forget_shuffles(docs.sparkSession)
    keys = shared.select("key")
    return common.materialize(common.sieve(dealt, "key", keys).join(keys, "key", "left_semi").distinct(), "near-meetings")


def _texts_of(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, text) of asked nodes (node, doc_id, th; a written table): a bitmap sieves the rows of docs, and an exact join decides."""
    texts = common.sieve(docs.select("doc_id", "text", F.xxhash64("text").alias("_tidemark_h")), "_tidemark_h", asked.select("th")).drop("_tidemark_h")
    texts = texts.join(common.private(asked.select("node", "doc_id", "th")), common.same_document("_tidemark_doc_id", "_tidemark_th"))
    return texts.groupBy(F.col("_tidemark_node").alias("node")).agg(F.min("text").alias("text"))


def _sizes_fit(n: Column, m: Column) -> Column:
    return (n * OF >= m * NEAR) & (m * OF >= n * NEAR)


def _overlap(n: Column, m: Column) -> Column:
    """Elements that two sets of n and m share at least if they are near."""
    return F.ceil((n + m) * NEAR / F.lit(NEAR + OF))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, turn: str) -> DataFrame:
    """The pairs (u, v) of nodes that are near."""
    side = lambda name, s: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    apart = F.col("na") + F.col("nb") - 2 * _overlap(F.col("na"), F.col("nb"))
    pairs = (
        pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
        .where(_sizes_fit(F.col("na"), F.col("nb")) & (sketch_distance(F.col("sa"), F.col("sb")) <= apart))
        .select("u", "v", (F.col("na") + F.col("nb")).alias("n"))
    )
    pairs = common.materialize(pairs, f"near-candidates-{turn}")
    asked = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct()
    asked = common.materialize(nodes.join(asked, "node", "left_semi").select("node", "doc_id", "th"), f"near-asked-{turn}")

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles_of(t).view(np.int64) for t in texts], dtype=object)

    sets = _texts_of(docs, asked).select("node", shingles("text").alias("set"))
    with common.small_batches(docs.sparkSession):
        sets = common.materialize(sets, f"near-sets-{turn}")
    left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("a")), sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    found = common.materialize(
        pairs.join(left, "u").join(right, "v").where(OF * both >= NEAR * (F.col("n") - both)).select("u", "v"), f"near-links-{turn}"
    )
    for table in (pairs, asked, sets):
        common.release(table)
    common.forget_shuffles(docs.sparkSession)
    return found


def _open(meetings: DataFrame, label: DataFrame) -> DataFrame:
    """Meetings with the nodes' components, without those of one component only."""
    named = meetings.join(label.select(F.col("u").alias("node"), "v"), "node", "left").select("key", "node", "n", "at", F.coalesce("v", "node").alias("label"))
    named = common.materialize(named, "near-named")
    apart = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("key")
    open_ = common.materialize(named.join(apart, "key", "left_semi"), "near-open")
    common.release(named)
    return open_


def _most_met(meetings: DataFrame, order: Column) -> DataFrame:
    """For each node the one among the first of its meetings, by order, that is first most often: pairs (u, v)."""
    first = meetings.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n")).alias("f"))
    met = meetings.join(first, "key").where((F.col("node") != F.col("f.node")) & _sizes_fit(F.col("n"), F.col("f.n")))
    counted = met.groupBy(F.col("node").alias("u"), F.col("f.node").alias("v")).agg(F.count(F.lit(1)).alias("met"))
    return counted.groupBy("u").agg(F.max_by("v", F.struct("met", "v")).alias("v"))


def assign(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, th (hash of the text), fp (long: its component's smallest node) and component_id of every row of docs."""
    common.bound_batches(docs.sparkSession)
    order = _common(docs)
    prints = _prints(docs, order)
    nodes = prints.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("d"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = common.materialize(nodes.select("node", "d.doc_id", "d.th", "fp", "n", "sketch"), "near-nodes")
    meetings = _meetings(docs, prints, nodes, order, crowd)
    common.forget_shuffles(docs.sparkSession)

    least = common.materialize(nodes.groupBy("fp").agg(F.min("node").alias("v")), "near-prints-least")
    of_fp = lambda name: least.select(F.col("fp").alias(name), F.col("v").alias(f"{name}_node"))
    linked = simhash_bk.links(least.select("fp")).join(of_fp("u"), "u").join(of_fp("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    alike = nodes.join(least, "fp").where("node != v").select(F.col("node").alias("u"), "v")
    first = [_most_met(meetings, F.xxhash64(F.lit(turn), "node")) for turn in range(2)]
    pairs = linked.unionAll(alike).unionAll(first[0]).unionAll(first[1]).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    sure = _verified(docs, nodes, pairs, "first")

    open_ = _open(meetings, components.roots(sure))
    common.release(meetings)
    common.forget_shuffles(docs.sparkSession)
    # The smaller set of a pair (u) and the larger share at least _overlap elements, so the first of these stands no
    # further back than leaves room for the others, in either. The smaller one's room is narrower still.
    small = open_.where(F.col("at") <= F.col("n") - _overlap(F.col("n"), F.col("n")))
    small = small.select("key", F.col("node").alias("u"), F.col("n").alias("m"), F.col("at").alias("u_at"), F.col("label").alias("other"))
    least = _overlap(F.col("n"), F.col("m"))
    fit = (
        (F.col("label") != F.col("other")) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("u") < F.col("node"))))
        & _sizes_fit(F.col("n"), F.col("m")) & (F.col("u_at") <= F.col("m") - least) & (F.col("at") <= F.col("n") - least)
    )
    rest = small.join(open_, "key").where(fit).select("u", F.col("node").alias("v")).distinct()
    found = components.roots(sure.unionAll(_verified(docs, nodes, rest, "rest")))

    rooted = prints.select("doc_id", "th", "node").join(found.select(F.col("u").alias("node"), "v"), "node", "left")
    rooted = common.materialize(rooted.select("doc_id", "th", F.coalesce("v", "node").alias("fp")), "near-rooted")
    named = rooted.groupBy("fp").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(named, "fp").select("doc_id", "th", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: that of the smallest doc_id."""
    return simhash_bk.one_of_each(docs, assign(docs))
