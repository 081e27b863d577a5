"""The pipeline's stages one by one, on the smallest tables, against what each must do."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import Row

import corpus_pipeline
from tests.llm.test_pairs_and_lines import brute_leaks, brute_lines, naive_components, naive_print

from tidemark.llm import common, near_pairs, packing, spaced_seed, zstd_quality


def test_stages(spark, sf_dir, tmp_path):
    docs = common.table(spark, sf_dir, "documents")
    seen = [{r["doc_id"]: r for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(common.DOCUMENT_COLUMNS)
            seen.append({r["doc_id"]: r for r in docs.collect()})
    all_, good, lines, one, clean = seen
    labels = {r["doc_id"]: r for r in common.table(spark, sf_dir, "labels").collect()}
    bad = [d for d, r in labels.items() if r["quality"] == 0 and zlib.crc32(str(d).encode()) % 5]
    assert len(bad) < zstd_quality.LEAST_ROWS and set(good) == set(all_)  # too few bad texts to learn from: all stay
    kept = [d in good for d, r in labels.items() if r["quality"] == 1 and d in all_]
    assert sum(kept) >= 0.9 * len(kept)
    want = brute_lines([(d, r["text"], r["source"]) for d, r in good.items()], 10)
    assert {d: r["text"] for d, r in lines.items()} == {d: t for d, t in want.items() if t == good[d]["text"] or t.strip(" \t\r\n")}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    group = near_groups({d: r["text"] for d, r in lines.items()})
    assert set(one) == set(group.values()) and all(one[d] == lines[d] for d in one)
    items = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    leaked = {d for d, _ in brute_leaks([(d, r["text"], None) for d, r in one.items()], items, spaced_seed.MIN_OVERLAP)}
    assert set(clean) == set(one) - leaked
    packed = docs.toPandas()
    assert set(packed["doc_id"]) == set(clean) and packed.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY


def test_quality_stage_rejects_bad_and_keeps_good(spark):
    """On a table with some hundred labels."""
    sf_dir = "/root/testdata/sf0.01"
    docs = common.table(spark, sf_dir, "documents")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf_dir).select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf_dir, "labels").collect()}
    share = lambda value: sum(d in kept for d, q in labels.items() if q == value) / sum(q == value for q in labels.values())
    assert share(1) >= 0.98 and share(0) <= 0.5


def test_run(spark, sf_dir):
    before = common.scratch_mark()
    out = corpus_pipeline.run(spark, sf_dir)
    assert common.scratch_mark() == before + 1  # of the scratch tables the result's alone is left
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def _five(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_groups(texts):
    """The smallest id of each text's component of all pairs at five words and similarity 0.8."""
    sets = {d: _five(t or "") for d, t in texts.items()}
    group = {d: d for d in sets}
    for a, b in itertools.combinations(sets, 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {d: low if g == high else g for d, g in group.items()}
    return group


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    """Components of all pairs of similarity 0.8 or more, also those that SimHash at three bits leaves apart."""
    r = random.Random(3)
    rows = []
    for base in range(30):
        text = [f"w{r.randrange(300)}" for _ in range(r.randrange(60, 160))]
        for _ in range(6):
            copy = list(text)
            for _ in range(r.randrange(5)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(1000)}"
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(len(rows) + i, passage + " " + " ".join(f"o{i}_{j}" for j in range(60))) for i in range(20)]
    rows += [(900, "A  b"), (901, "a B"), (902, None), (903, ""), (904, "one two three four six"), (905, "one two three four five")]
    group = near_groups(dict(rows))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    crowded = near_pairs.assign(docs, crowd=3)  # most keys come last, in every turn
    assert {x["component_id"] for x in crowded.select("component_id").distinct().collect()} == set(group.values())
    simhash = naive_components({d: naive_print(t or "") for d, t in rows})
    assert got == set(group.values()) and len(got) < len(set(simhash.values()))


def test_stages_take_hard_rows(spark, sf_dir):
    """Nulls in any column, repeated rows, a very long text, clashing names; then no rows at all."""
    from pyspark.sql import functions as F

    rows = [(1, "one good line of text\nand another", "en", "s", 30), (1, "one good line of text\nand another", "en", "s", 30), (None, None, None, None, None), (2, None, "en", None, 0), (3, "", None, "t", 0)]
    rows += [(4, "long words here " * 20_000, "en", "s", 320_000), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("th", "fp", "node", "score", "item", "label", "stays", "u")})
    for some in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, some, sf_dir)
            assert out.columns == list(common.DOCUMENT_COLUMNS)
            if k in (0, 3):  # these judge each row alike
                assert out.count() <= some.count()
        assert (corpus_pipeline.pack(spark, some, sf_dir).count() > 0) == (some is docs)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert kept == [(False, 1), (False, 2), (False, 4), (True, 0)]


def test_elements_that_come_last_leave_the_prefix():
    order = np.array([5, 9], np.uint64), np.array([4, 7])
    after = near_pairs._behind(order, [Row(key=-1, rows=50), Row(key=5, rows=2000)])
    assert after[0].tolist() == [5, 9, (1 << 64) - 1] and after[1].tolist()[1] == 7 and after[1][0] > after[1][2] > 7
    hashes = np.array([1, 5, 9, 30, 40, 50, 60, 70, 80, (1 << 64) - 1], np.uint64)
    assert near_pairs.prefix_of(hashes, *after).tolist() == [1, 30, 40] and near_pairs.prefix_of(hashes[[0, 1, 2, 9]], *after).tolist() == [1]
