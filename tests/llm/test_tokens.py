"""The tokenizer operators against the libraries and against plain re-implementations."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe_prefix, cross_align, queries

P = pytest.importorskip("public_tokenizers")
WORDS, BYTES, PIECES = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

HARD = [
    None, "", " ", "\n", "a", "Hello, world! it's 42 o'clock", "two  blanks", " leads", "trails ", "line\nbreak", "line \nbreak", "line\n break", "para\n\ngraph", "tab\there",
    "<|endoftext|> a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|>", "</s> <s> <unk>", "▁ piece ▁mark", "naïve café ÀÉ", "é café", "İstanbul ΑΣ ΣΑΣ",
    "日本語 テキスト", "𝒳 😀👍🏽", "\x00 \x1c\x85​", "'s 't don't 'LL", "a" * 3000, "ab" * 2000 + " end", "$$$&&&^^ ...", "ﬁ ſ ŉ", "՘ ᲉꟋ", "�﻿", "same words same words",
    "    indent\n        deeper", "tail\n", "\r\nwindows\r\n",
]


def documents(spark, texts):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in texts], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- encoding by prefixes ---------------------------------------------------


def random_texts(count, seed):
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    wild = [(32, 127), (0xA0, 0x250), (0x300, 0x370), (0x3000, 0xD7FF), (0xE000, 0x110000)]
    texts = ["".join(r.choice(letters[: r.choice((1, 2, 3, 5, 26))]) for _ in range(r.randrange(1, 50))) for _ in range(count)]
    return texts + ["".join(chr(r.randrange(*r.choice(wild))) for _ in range(r.randrange(1, 30))) for _ in range(count)]


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(WORDS), bpe_prefix.PrefixBpe(WORDS)
    for text in [t or "" for t in HARD] + random_texts(4000, 5):
        assert np.frombuffer(mine.ids(text), np.int32).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_prefix, "REMEMBERED", 50)
    monkeypatch.setattr(bpe_prefix, "PAIRS", 20)
    few, many = bpe_prefix.PrefixBpe(WORDS), bpe_prefix.tokenizer(WORDS)
    for text in random_texts(300, 6):
        assert few.ids(text) == many.ids(text)
    assert len(few.known) <= 51 and len(few.known_parts) <= 51 + 50 and "a" * 65 not in few.known


def naive_bpe(symbols, rank):
    symbols = list(symbols)
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank), default=None)
        if found is None:
            return symbols
        i = found[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_pairs_stand_as_merging_says():
    """Every pair of tokens of a small vocabulary, with ties of rank and tokens that no text comes to."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "a"), ("ba", "ab"), ("aab", "aa"), ("b", "b"), ("aa", "aa"), ("ab", "ab")]
    names = sorted({"a", "b"} | {x + y for x, y in merges})
    vocab = {n: i for i, n in enumerate(names)}
    tokens = bpe_prefix.Merges(vocab, merges)
    rank = {m: i for i, m in enumerate(merges)}
    own = {n: naive_bpe(n, rank) == [n] for n in names}
    assert all(tokens.reachable(vocab[n]) == own[n] for n in names) and not all(own.values())
    for x in names:
        for y in names:
            if own[x] and own[y]:
                assert tokens.stands(vocab[x], vocab[y]) == (naive_bpe(x + y, rank) == [x, y]), (x, y)


def test_merges_that_have_no_order_are_refused():
    with pytest.raises(ValueError, match="after those"):
        bpe_prefix.Merges({"a": 0, "ab": 1, "b": 2, "abb": 3}, [("ab", "b"), ("a", "b")])
    with pytest.raises(ValueError, match="one token"):
        bpe_prefix.Merges({"a": 0, "aa": 1, "aaa": 2}, [("a", "a"), ("aa", "a"), ("a", "aa")])


def test_prefix_query_whole(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    rows = list(enumerate(HARD)) + [(3, "again"), (3, "again"), (None, "no id"), (99, " ".join(random_texts(3000, 9)[:3000]))]
    docs = documents(spark, rows).withColumns({c: F.lit("x") for c in ("ids", "n_tokens", "row")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_prefix_bpe(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(plain.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op13_prefix_bpe(spark, str(tmp_path / "none")).count() == 0


def test_decode_of_null(spark):
    ids = spark.createDataFrame([(None,), ([],), ([320, 49407],)], "ids array<int>")
    got = [r[0] for r in ids.select(bpe_prefix.decode_column(F.col("ids"), WORDS)).collect()]
    assert got[:2] == [None, ""] and got[2].endswith(" <|endoftext|>")


# --- alignment --------------------------------------------------------------


def naive_alignment(texts):
    """Digest rows of op12 by walking both token lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(BYTES)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letter = {c: b for b, c in enumerate(bpe_prefix.byte_letters())}
    piece = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    held, per = defaultdict(set), []
    for k, (d, t) in enumerate(texts):
        a = [(i, bytes(letter[c] for c in a_side.id_to_token(i))) for i in a_side.encode(" " + (t or ""), add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in b_side.encode(t or "")]
        whole = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            per.append((d, 0, 0, [], Counter()))
            continue
        made, left, right, links = [], [], [], Counter()
        at_a = at_b = 0
        i = j = 0
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                left.append(a[i][0])
                at_a, i = at_a + len(a[i][1]), i + 1
            else:
                right.append(b[j][0])
                at_b, j = at_b + len(b[j][1]), j + 1
            if at_a == at_b:
                made.append((left, right))
                links.update((x, y) for x in left for y in right)
                left, right = [], []
        for pair in links:
            held[pair].add(k)
        per.append((d, len(a), len(b), made, links))
    count = {p: len(s) for p, s in held.items()}
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    rows = []
    for d, n_a, n_b, made, links in per:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in made)
        best = sum(m for p, m in links.items() if count[p] == most[p[0]])
        rows.append((d, n_a, n_b, len(made), sum(links.values()), best, sum(m * count[p] for p, m in links.items()), sha(text) if text else ""))
    return rows


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_a_walk(spark, tmp_path):
    rows = list(enumerate(HARD)) + [(3, "again again"), (3, "again again"), (None, "no id")] + [(200 + k, t) for k, t in enumerate(random_texts(150, 7))]
    rows += [(900, " ".join(random_texts(1500, 8)[:1500]))]
    docs = documents(spark, rows).withColumns({c: F.lit("x") for c in ("row", "n_a", "links", "pair", "held")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = sorted(naive_alignment(rows), key=key)
    got = queries.op12_alignment(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == want
    # With few counts broadcast the rest is joined, with the same result.
    aligned = cross_align.align(docs, BYTES, PIECES)
    few = cross_align.with_counts(aligned, widespread=7).select("doc_id", "n_links", "n_best", "count_sum").collect()
    assert sorted((r for r in map(tuple, few)), key=key) == sorted(((r[0], r[4], r[5], r[6]) for r in want), key=key)
    assert queries.op12_alignment.__name__ in queries.QUERIES and cross_align.with_counts(cross_align.align(docs.limit(0), BYTES, PIECES)).count() == 0


def test_alignment_of_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_alignment(spark, sf_dir).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(naive_alignment(rows))


def test_overlaps_groups_and_products():
    ends_a, ends_b = np.array([2, 5, 6, 9]), np.array([1, 5, 8, 9])
    ends, of_a, of_b = cross_align.overlaps(ends_a, ends_b)
    assert ends.tolist() == [1, 2, 5, 6, 8, 9] and of_a.tolist() == [0, 0, 1, 2, 3, 3] and of_b.tolist() == [0, 1, 1, 2, 2, 3]
    stops_a, stops_b = cross_align.groups(ends_a, ends_b)
    assert stops_a.tolist() == [2, 4] and stops_b.tolist() == [2, 4]


def test_products_of_large_groups_equal_those_of_small_ones(monkeypatch):
    r = np.random.default_rng(4)
    sizes = r.integers(1, 9, (60, 2))
    a, b = (r.integers(0, 5, int(s.sum())) for s in sizes.T)
    stops = [np.cumsum(s) for s in sizes.T]

    def total():
        found = Counter()
        for group, pair, times in cross_align.products(a, b, *stops):
            for g, p, t in zip(group.tolist(), pair.tolist(), times.tolist(), strict=True):
                found[g, p] += t
        return found

    small = total()
    monkeypatch.setattr(cross_align, "LAID", 6)
    assert total() == small and sum(small.values()) == int((sizes[:, 0] * sizes[:, 1]).sum())
