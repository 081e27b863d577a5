"""SimHash near-dedup with BK-trees over shards of fingerprints.

Texts become 64-bit fingerprints of their word shingles; equal fingerprints collapse
to one node. Two fingerprints at distance RADIUS or less agree on at least two of five
bit blocks, so each node goes to the ten shards named by its pairs of blocks. A shard
of more than PIECE nodes is divided again: the bits that its name leaves free are cut
into RADIUS + 1 blocks, on one of which any two near nodes agree, so each node goes to
as many narrower shards. Every division fixes more bits, and k free bits leave at most
2^k distinct fingerprints, so shards end below the bound whatever the data are: nothing
is capped, and no shard's nodes meet all of its other nodes but within such a bound.

Every shard becomes a BK-tree: a child is keyed by its integer Hamming distance to the
parent, and a search follows only the edges whose key lies within the radius of the
query's distance to the node. A search returns a spanning forest of the links found.

The trees are sent to their queries by the shuffle instead of by a driver broadcast:
together they grow with the corpus, so no bound on a broadcast could be proven.

Defined results: null text counts as empty; texts without words have fingerprint zero
and link like any other; null doc_ids never name a component unless it has no other
id (then null); repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Bits of the five blocks; two of them name a shard.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints in one tree, and tree visits worked on at once.
PIECE, VISITS = 4096, 400_000


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and splits at ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        begins = np.concatenate([[0], ends[: n - 1]]).tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            prints = np.fromiter((fingerprint_of(t, shingle) for t in texts), np.uint64, len(texts))
            yield pd.Series(prints.view(np.int64))

    return simhash(text)


class BKForest:
    """One BK-tree for each group, as flat arrays, built and searched level by level.

    An edge is the number 65 * parent + distance; edges are sorted, so the children
    whose key lies in a range are one slice of them.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        """values: unsigned fingerprints; groups: their group numbers, ascending."""
        self.values = values
        n = len(values)
        names, first = np.unique(groups, return_index=True)
        self.roots = dict(zip(names.tolist(), first.tolist(), strict=True))
        at = first[np.searchsorted(names, groups)] if n else np.zeros(0, np.int64)
        waiting = np.flatnonzero(at != np.arange(n))
        edges, children = [], []
        while len(waiting):
            node = at[waiting]
            key = node * 65 + np.bitwise_count(values[waiting] ^ values[node])
            own, which, back = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[which]  # the first that takes an edge becomes its child
            edges.append(own)
            children.append(child)
            at[waiting] = child[back]
            waiting = waiting[at[waiting] != waiting]
        key = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.edges = key[order]
        self.children = np.concatenate(children)[order] if edges else np.zeros(0, np.int64)

    def search(self, queries: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) of every node within radius of a query; starts: the queries' roots."""
        found_q, found_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        q, node = np.arange(len(queries)), starts.astype(np.int64)
        while len(q):
            distance = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            found_q.append(q[near])
            found_n.append(node[near])
            low = np.searchsorted(self.edges, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.edges, node * 65 + np.minimum(distance + radius, 64), "right")
            n = high - low
            q = np.repeat(q, n)
            node = self.children[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        return np.concatenate(found_q), np.concatenate(found_n)


def _forest_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 with links a-b: the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _links(values: np.ndarray, groups: np.ndarray, radius: int):
    """Spanning links (value, smaller-numbered value) of whole groups of distinct values."""
    forest = BKForest(values, groups)
    names, begins, sizes = np.unique(groups, return_index=True, return_counts=True)
    at = np.searchsorted(names, groups)
    label = np.arange(len(values))
    block = np.cumsum(sizes[at]) // VISITS
    for name in np.unique(block):  # bounded work at once; what is linked already shrinks to its root
        some = np.flatnonzero(block == name)
        q, node = forest.search(values[some], begins[at[some]], radius)
        a, b = some[q], node
        apart = label[a] != label[b]
        a, b = label[a[apart]], label[b[apart]]
        label = _forest_roots(len(values), np.concatenate([a, np.arange(len(label))]), np.concatenate([b, label]))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return values[moved], values[label[moved]]


def _meet(radius: int):
    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shard, whose size is bounded; a shard may reach over several frames."""
        held: list[pd.DataFrame] = []
        names = ["t", "key"]

        def work(frame: pd.DataFrame) -> pd.DataFrame:
            change = (frame[names].to_numpy()[1:] != frame[names].to_numpy()[:-1]).any(1)
            groups = np.concatenate([[0], np.cumsum(change)]).astype(np.int64)
            u, v = _links(frame["fp"].to_numpy().view(np.uint64), groups, radius)
            return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

        rows = 0
        for frame in frames:
            if not len(frame):
                continue
            held.append(frame)
            rows += len(frame)
            if rows < 20_000:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = (whole[names] == whole[names].iloc[-1]).all(axis=1)
            cut = int(np.flatnonzero(~last.to_numpy())[-1]) + 1 if not last.all() else 0
            if cut:
                yield work(whole.iloc[:cut].reset_index(drop=True))
            held, rows = [whole.iloc[cut:]], len(whole) - cut
        if held and rows:
            yield work(pd.concat(held, ignore_index=True))

    return meet


def _signed(mask: int) -> int:
    return mask - ((mask >> 63) << 64)


def _narrower(mask: int, parts: int) -> list[int]:
    """mask with one more block of its free bits, for each of `parts` blocks; as itself if no bit is free."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(prints: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """(u, v) that connect the fingerprints of prints (one distinct long column fp) as all their links would."""
    if radius > 3:
        raise ValueError("two of five blocks agree for certain only up to three differing bits")
    fp, parts = F.col("fp"), radius + 1
    masks = [sum(((1 << bits) - 1) << at for at, bits in pair) for pair in combinations(BLOCKS, 2)]
    named = lambda t, mask: F.struct(t.cast("int").alias("t"), fp.bitwiseAND(mask).alias("key"))
    dealt = prints.select("fp", F.inline(F.array(*[named(F.lit(t), F.lit(_signed(m))) for t, m in enumerate(masks)])))
    found = None
    while True:
        counts = common.materialize(dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "shards")
        placed = dealt.join(counts, ["t", "key"])
        # A shard whose name fixes so many bits that the rest cannot tell more than `piece` nodes apart is never over it.
        trees = placed.where(F.col("n") <= piece).select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
        own = trees.mapInPandas(_meet(radius), "u long, v long")
        found = own if found is None else found.unionAll(own)
        if counts.where(F.col("n") > piece).isEmpty():
            return found
        masks = [narrow for mask in masks for narrow in _narrower(mask, parts)]
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        inner = lambda i: named(F.col("t") * parts + i, F.get(table, F.col("t") * parts + i))  # noqa: E731, B023
        large = placed.where(F.col("n") > piece).select("fp", F.inline(F.array(*[inner(i) for i in range(parts)])))
        dealt = common.materialize(large, "shards-narrower")


def assign(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, **also: Column) -> DataFrame:
    """doc_id, th (hash of the text), fp (long) and component_id of every row of docs, and the columns also."""
    own = [column.alias(name) for name, column in also.items()]
    prints = common.materialize(
        docs.select("doc_id", F.xxhash64("text").alias("th"), fingerprint_column(F.col("text"), shingle).alias("fp"), *own), "prints"
    )
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components.roots(links(nodes.select("fp"), radius))
    labelled = nodes.join(found.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("root"), "least")
    labelled = common.materialize(labelled, "prints-root")
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = labelled.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "th", "fp", "component_id", *also)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: that of the smallest doc_id.

    Rows without doc_id in a component without any id are reduced to one as well.
    """
    return one_of_each(docs, assign(docs, shingle, radius))


def one_of_each(docs: DataFrame, assigned: DataFrame) -> DataFrame:
    """One document of each component of assigned (doc_id, th, fp, component_id).

    Documents that no key of a dropped or repeated row can mean stay without a shuffle.
    """
    own = docs.columns
    assigned = common.materialize(assigned, "prints-component")
    # A component's representative: its smallest id, and one text hash of the rows with that id.
    mine = [F.col("component_id"), F.when(F.col("doc_id").isNull(), F.col("fp")).alias("only")]
    best = (
        assigned.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy(*mine).agg(F.min("th").alias("best"))
        .select("component_id", "only", "best")
    )
    # What needs a look: keys of rows that are not a representative, or stand in several rows.
    by_key = assigned.groupBy("doc_id", "th", "component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("only")).agg(F.count(F.lit(1)).alias("copies"))
    joined = by_key.join(
        common.private(best),
        F.col("component_id").eqNullSafe(F.col("_tidemark_component_id")) & F.col("only").eqNullSafe(F.col("_tidemark_only")) & F.col("doc_id").eqNullSafe(F.col("_tidemark_component_id")) & (F.col("th") == F.col("_tidemark_best")),
        "left",
    )
    looked = joined.where(F.col("_tidemark_best").isNull() | (F.col("copies") > 1))
    looked = common.materialize(looked.select("doc_id", "th", F.col("_tidemark_best").isNotNull().alias("stays")), "prints-looked")
    hashed = docs.withColumn("_tidemark_h", F.xxhash64("text"))
    maybe, sure = common.sifted(hashed, "_tidemark_h", looked.select("th"))
    match = common.same_document("_tidemark_doc_id", "_tidemark_th")
    seen = maybe.join(common.private(looked), match, "left")
    whole = seen.where(F.col("_tidemark_stays").isNull()).select(*own)
    repeated = seen.where(F.col("_tidemark_stays")).select(*own).dropDuplicates(["doc_id", "text"])
    return sure.select(*own).unionByName(whole).unionByName(repeated)
