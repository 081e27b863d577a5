"""Line dedup, SimHash, decontamination and packing against brute force, with the hard cases."""

import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, components, line_spread, packing, simhash_bk, spaced_seed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows], DOCS)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# --- line dedup -------------------------------------------------------------


def brute_lines(rows, least):
    sites, first = {}, {}
    key = lambda d, i: (d is None, d or 0, i)
    for d, t, s in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            k = line.strip(" \t\r")
            if k:
                sites.setdefault(k, set()).add(s)
                if k not in first or key(d, i) < first[k]:
                    first[k] = key(d, i)
    gone = lambda d, i, k: bool(k) and len(sites[k] - {None}) >= least and first[k] != key(d, i)
    return {
        d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not gone(d, i, x.strip(" \t\r"))) for d, t, _ in rows
    }


def test_lines_equal_brute_force(spark):
    r = random.Random(1)
    shared = [f"shared line {k}" for k in range(30)]
    rows = []
    for d in range(200):
        lines = [f"own {d} {k}" for k in range(r.randrange(4))] + r.sample(shared, r.randrange(6)) + [" \tshared line 0 \r"] * (d % 5 == 0) + [""]
        r.shuffle(lines)
        rows.append((d, "\n".join(lines), f"s{r.randrange(14)}"))
    rows += [(500, None, "s1"), (501, "", "s2"), (502, "shared line 1", None), (None, "shared line 2\nx", "s3")]
    for places in (line_spread.PLACES, 7):  # the second deals each line over several tasks
        got = {x["doc_id"]: x["text"] for x in line_spread.remove_boilerplate(documents(spark, rows), places=places).collect()}
        assert got == brute_lines(rows, line_spread.MIN_SITES)


def test_lines_exactly_at_the_threshold(spark):
    rows = [(d, "at\nbelow" if d < 9 else "at", f"s{d}") for d in range(10)]
    out = {x["doc_id"]: (x["text"], x["n_removed"]) for x in line_spread.remove_boilerplate(documents(spark, rows)).collect()}
    assert out[0] == ("at\nbelow", 0) and out[1] == ("below", 1) and out[9] == ("", 1)


def test_lines_many_repeats_in_one_long_text(spark):
    rows = [(d, "\n".join(["same", f"own {d}"] * 3000), f"s{d}") for d in range(12)]
    out = {x["doc_id"]: x["text"] for x in line_spread.remove_boilerplate(documents(spark, rows)).collect()}
    assert out[0].count("same") == 1 and "same" not in out[5] and out[5].count("own 5") == 3000
    assert line_spread.remove_boilerplate(documents(spark, [])).count() == 0


def test_extra_columns_may_clash(spark):
    docs = documents(spark, [(1, "a\nb", "s"), (2, "a", "t")]).withColumns({c: F.lit("x") for c in ("d", "th", "pos", "fp", "drop", "sites", "t", "seed", "item", "score")})
    assert line_spread.remove_boilerplate(docs, min_sites=2).select("d", "th", "drop", "text").orderBy("doc_id").collect()[1]["text"] == ""
    assert simhash_bk.keep_one(docs).columns == docs.columns
    assert spaced_seed.drop_leaks(docs, spark.createDataFrame([(1, "b")], "item_id long, text string")).select("doc_id").collect()[0][0] == 2


# --- simhash ----------------------------------------------------------------


def naive_print(text):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] if len(parts) >= 3 else [b" ".join(parts)] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def naive_components(prints, radius=3):
    names = sorted(prints, key=lambda d: (d is None, d))
    label = {d: d for d in names}
    for _ in names:
        before = dict(label)
        for a in names:
            for b in names:
                if (prints[a] ^ prints[b]).bit_count() <= radius:
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return label
    return label


def test_fingerprints(spark):
    texts = ["", None, "One", "one TWO", "a b c", "A\tB\nC\x0bd \x0c", "é É a b", "x " * 70_000, " ".join(words(500, 2))]
    for t in texts:
        assert simhash_bk.fingerprint_of(t) == naive_print(t)


def test_components_equal_brute_force(spark):
    rows = []
    for d in range(60):
        base = words(120, d // 3)
        for k in range(d % 3):
            base[(7 * k + 11) % 120] = f"changed{d}"
        rows.append((d, " ".join(base), "s"))
    rows += [(90, "", "s"), (91, None, "s"), (92, " \n", "s"), (93, rows[0][1], "s"), (94, "one", "s")]
    got = {r["doc_id"]: r["component_id"] for r in simhash_bk.assign(documents(spark, rows)).collect()}
    assert got == naive_components({d: naive_print(t) for d, t, _ in rows})
    assert len(set(got.values())) < len(got) - 5


def test_large_shards_are_divided(spark):
    r = random.Random(5)
    center, prints = r.getrandbits(64), set()
    while len(prints) < 300:
        x = center
        for _ in range(r.randrange(9)):
            x ^= 1 << r.randrange(64)
        prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["u"]: r["v"] for r in components.roots(simhash_bk.links(frame, piece=100)).collect()}
    mask = (1 << 64) - 1
    near = {a: [b for b in signed if ((a ^ b) & mask).bit_count() <= 3] for a in signed}
    label, work = {}, None
    for a in signed:
        if a not in label:
            work = [a]
            while work:
                x = work.pop()
                if x not in label:
                    label[x] = a
                    work += near[x]
    assert {x: found.get(x, x) for x in signed} == label


def test_a_shard_of_many_fingerprints_is_not_searched_pair_by_pair(spark):
    """200,000 fingerprints agree in 26 bits: each goes to a bounded number of trees, and all planted links are found."""
    r = np.random.default_rng(4)
    free = np.unique(r.integers(0, 1 << 38, 200_000).astype(np.int64))
    near = free[:500] ^ (1 << r.integers(0, 38, 500).astype(np.int64)) ^ (1 << r.integers(0, 38, 500).astype(np.int64))
    values = np.unique(np.concatenate([free, near])) << 26
    made = []
    held, common._written[:] = list(common._written), []
    prints = spark.createDataFrame(pd.DataFrame({"fp": values}))
    found = {r["u"]: r["v"] for r in components.roots(simhash_bk.links(prints)).collect()}
    made = [p for p in common._written if "/shards-narrower" in p]
    assert made and sum(spark.read.parquet(p).count() for p in made) <= 10 * len(values)
    common._written[:] = held + common._written
    root = lambda x: found.get(x, x)
    assert all(root(a) == root(b) for a, b in zip((free[:500] << 26).tolist(), (near << 26).tolist(), strict=True))
    names = {int(v) for v in values}
    assert all(u in names and v in names for u, v in found.items()) and len(found) < 5000


def test_bk_tree_search_equals_a_scan():
    r = np.random.default_rng(7)
    values = r.integers(0, 1 << 20, 400).astype(np.uint64)
    groups = np.sort(r.integers(0, 9, 400))
    forest = simhash_bk.BKForest(values, groups)
    starts = np.array([forest.roots[g] for g in groups])
    q, n = forest.search(values, starts, 3)
    want = {(i, j) for i in range(400) for j in range(400) if groups[i] == groups[j] and int(values[i] ^ values[j]).bit_count() <= 3}
    assert set(zip(q.tolist(), n.tolist(), strict=True)) == want and len(q) == len(want)


def test_keep_one(spark):
    rows = [(5, "a b c d", "s"), (3, "a b c d", "s"), (3, "a b c d", "s"), (8, "other text here now", "s"), (None, "only null id text", "s"), (None, "only null id text", "s"), (9, "", "s"), (10, None, "s")]
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash_bk.keep_one(documents(spark, rows)).collect())
    assert kept == [(False, 3), (False, 8), (False, 9), (True, 0)]
    assert simhash_bk.assign(documents(spark, [])).count() == 0


def test_long_chains_settle(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).unionAll(spark.createDataFrame([(7, 7), (300, None)], "u long, v long"))
    found = components.roots(edges)
    assert found.count() == 200 and found.select("v").distinct().first()[0] == 0


# --- decontamination --------------------------------------------------------


def brute_leaks(docs, items, least):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, t, _ in docs:
        doc = cut(t)
        for i, text in items:
            item = cut(text)
            best = 0
            for start in range(-len(item) + 1, len(doc)):
                same = sum(1 for k, w in enumerate(item) if 0 <= start + k < len(doc) and doc[start + k] == w)
                best = max(best, same)
            if item and best / len(item) >= (least if len(item) >= 9 else 1):  # shorter than a mask: whole or not at all
                out[(d, i)] = best
    return out


def test_leaks_equal_brute_force(spark):
    items = [(k, " ".join(words(16 + 3 * k, 100 + k, 5000))) for k in range(8)] + [(20, "short exact phrase"), (21, ""), (22, None), (23, "!!!")]
    items += [(30, items[1][1].upper()), (31, items[1][1])]  # equal tokens: a row for each
    rows = []
    for d in range(40):
        body = words(60, 200 + d, 5000)
        item = items[d % 8][1].split()
        if d % 4 == 1:
            body[10:10] = item
        if d % 4 == 2:  # substitutions
            item[5 % len(item)] = "zzz"
            item[-3] = "yyy"
            body[20:20] = item
        if d % 4 == 3:  # cut off at the end
            body += item[: int(len(item) * 0.8)]
        rows.append((d, " ".join(body).title() if d % 2 else ", ".join(body), "s"))
    rows += [(90, "x Short, EXACT; phrase y", "s"), (91, None, "s"), (92, "", "s"), (93, "short exact", "s"), (1, rows[1][1], "s")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = spaced_seed.find(documents(spark, rows), benchmark)
    got = {(r["doc_id"], r["item_id"]): r["n_match"] for r in found.collect()}
    assert got == brute_leaks(rows, items, spaced_seed.MIN_OVERLAP) and found.count() == len(got)
    small = spaced_seed.find(documents(spark, rows), benchmark, seed_rows=50)
    assert {(r["doc_id"], r["item_id"]): r["n_match"] for r in small.collect()} == got
    kept = {r["doc_id"] for r in spaced_seed.drop_leaks(documents(spark, rows), benchmark).collect()}
    assert kept == {d for d, _, _ in rows} - {d for d, _ in got}


def test_leaks_in_very_long_texts(spark):
    """A text of half a million words, with an item at its end and one common to all documents."""
    item, stock = " ".join(words(30, 77, 5000)), " ".join(words(20, 78, 5000))
    rows = [(1, " ".join(words(500_000, 9)) + " " + item, "s")] + [(d, stock + " " + " ".join(words(20, d)), "s") for d in range(2, 300)]
    benchmark = spark.createDataFrame([(1, item)] + [(k, stock + f" tail{k}") for k in range(10, 60)], "item_id long, text string")
    for most in (1_000_000, 10):
        found = {(r["doc_id"], r["item_id"]) for r in spaced_seed.find(documents(spark, rows), benchmark, seed_rows=most).collect()}
        assert found == {(1, 1)} | {(d, k) for d in range(2, 300) for k in range(10, 60)}


def test_leaks_of_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert spaced_seed.find(documents(spark, []), benchmark).count() == 0
    assert spaced_seed.find(documents(spark, [(1, "a b c", "s")]), benchmark.limit(0)).count() == 0
    assert spaced_seed.drop_leaks(documents(spark, [(1, "a b c", "s")]), benchmark.limit(0)).count() == 1


# --- packing ----------------------------------------------------------------

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|ENDOFTEXT|> <|endoftext |>", "x<|startoftext|>y <|", "", "Hello, world! it's 42", "a" * 500, "İstanbul ΑΣ ΣΑΣ", "x\x1cy\x85z w\xa0v", "é é", "<|endoftext|> <|startoftext|>", "日本語 テキスト", "don't-stop 'tis $$$&&&", "ﬁ ŉ ſ", "\x00\x01", "Ä ö ü ß €5 “q”", "  \n\t "]
    texts += [" ".join(words(300, s)) for s in range(5)]
    mine = packing.WordTokenizer(PATH).ids(texts)
    for t, got in zip(texts, mine, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def check_bins(bins, lengths, capacity):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= capacity for b in bins)


def test_local_search_empties_bins():
    # Best fit needs three bins for 6 + 5 + 4 + 4 + 3 + 2 of 12; two are enough.
    lengths = np.array([6, 5, 4, 4, 3, 2])
    best = packing.local_search([[0, 1], [2, 3, 4], [5]], lengths, 12)
    check_bins(best, lengths, 12)
    assert len(best) == 2
    r = np.random.default_rng(3)
    for n in (0, 1, 50, 400):
        lengths = r.integers(1, 101, n)
        first = packing.best_fit(lengths, 100)
        square = lambda bins: sum(int(lengths[b].sum()) ** 2 for b in bins)  # noqa: E731, B023
        last = packing.local_search([list(b) for b in first], lengths, 100)
        check_bins(last, lengths, 100)
        assert len(last) <= len(first) and square(last) >= square(first) and len(last) >= -(-int(lengths.sum()) // 100)


def test_best_step_equals_all_moves_and_exchanges():
    r = random.Random(11)
    for _ in range(300):
        own = [r.randrange(1, 30) for _ in range(r.randrange(1, 5))]
        others = [[r.randrange(1, 30) for _ in range(r.randrange(1, 5))] for _ in range(r.randrange(1, 4))]
        room = r.randrange(1, 25)
        gains = [a - out for b in others for a in b for out in (0, *own)] + [x + y - out for b in others for x, y in itertools.combinations(b, 2) for out in own]
        want = max((g for g in gains if 0 < g <= room), default=0)
        singles, pairs = packing._Members(len(others)), packing._Members(len(others))
        for k, b in enumerate(others):
            singles.put(k, packing.single_lengths(b))
            pairs.put(k, packing.pair_lengths(b))
        gain, total, pair, out = packing.best_step(sorted(set(own)), singles.all, pairs.all, room)
        assert gain == want
        if gain:
            bin_ = others[(pairs if pair else singles).first(total)]
            took = packing._taken(bin_, list(range(len(bin_))), total, pair)
            assert sum(bin_[i] for i in took) == total == gain + out and len(set(took)) == 1 + pair and out in (0, *own)


def test_local_search_where_best_fit_is_far_off():
    """Pieces of a fifth to half of a bin: no bound on the bins or pieces that take part."""
    lengths = np.random.default_rng(0).integers(800, 2201, 3000)
    first = packing.best_fit(lengths)
    last = packing.local_search(first, lengths)
    check_bins(last, lengths, packing.CAPACITY)
    assert len(first) - len(last) >= 15 and len(last) <= 1146


def test_packing_whole(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rows = [(d, " ".join(words(d * 7 % 900, d)), "s") for d in range(120)] + [(500, None, "s"), (501, "", "s"), (502, " ".join(words(9000, 1)), "s"), (3, "again", "s"), (None, "no id", "s")]
    out = packing.pack_documents(documents(spark, rows).repartition(5), PATH).toPandas()
    assert (out.groupby("sequence_id")["length"].sum() <= 4096).all()
    for _, bin_ in out.sort_values("offset").groupby("sequence_id"):
        assert bin_["offset"].tolist() == [0, *np.cumsum(bin_["length"])[:-1]]
    want = []
    for d, t, _ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(-1 if d is None else d, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for s in range(0, len(ids), 4096)]
    got = [tuple(map(int, r)) for r in out.assign(doc_id=out["doc_id"].fillna(-1))[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got) == sorted(want)
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 4096) + 1
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0


def test_packing_with_clashing_columns_and_repeats(spark):
    docs = documents(spark, [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s")]).withColumns({c: F.lit("x") for c in ("piece", "bin", "length", "batch", "fill", "offset")})
    rows = packing.pack_documents(docs, PATH).collect()
    assert sorted((r["doc_id"], r["length"]) for r in rows) == [(1, 3), (1, 3), (2, 1)] and len({r["sequence_id"] for r in rows}) == 1


class _Session:
    """What scratch_dir asks of a session."""

    def __init__(self, master, **settings):
        self.settings, self.sparkContext, self.conf = settings, self, self
        self.master = master

    def get(self, name, default=None):
        return self.settings.get(name.replace(".", "_"), default)


def test_scratch_follows_the_session(spark):
    assert common.scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert common.scratch_dir(_Session("yarn", spark_checkpoint_dir="hdfs://c/", spark_sql_warehouse_dir="hdfs://w")) == "hdfs://c/tidemark-scratch"
    assert common.scratch_dir(_Session("yarn", spark_sql_warehouse_dir="hdfs://w")) == "hdfs://w/tidemark-scratch"
    assert common.scratch_dir(_Session("local-cluster[2,1,1]", spark_sql_warehouse_dir="hdfs://w")) == "hdfs://w/tidemark-scratch"
    assert common.scratch_dir(_Session("local[4]")).startswith("file:///")


def test_scratch_can_be_cleared(spark):
    """Tables of this thread, one by one or all; those of another thread stay."""
    import threading

    other = []
    thread = threading.Thread(target=lambda: other.append(common.materialize(spark.range(3), "other")))
    thread.start()
    thread.join()
    mark = common.scratch_mark()
    first, second = (common.materialize(spark.range(5), "x") for _ in range(2))
    assert second.count() == 5 and common.scratch_mark() == mark + 2
    common.release(first)
    common.release(first)
    assert common.scratch_mark() == mark + 1 and second.count() == 5
    common.clear_scratch(spark, mark)
    assert common.scratch_mark() == mark and other[0].count() == 3
    for gone in (first, second):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(gone._tidemark_path)
