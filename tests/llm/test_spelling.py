"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, spelling_variants
from tidemark.llm.spelling_variants import Automaton

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def at_one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_variants(n):
    near = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if at_one_error(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def family(seed, size, letters="abcé"):
    """Words about a few stems, many of them one error apart."""
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randrange(6, 13))) for _ in range(12)]
    words = set(stems)
    while len(words) < size:
        w = list(r.choice(sorted(words)))
        for _ in range(r.randrange(1, 3)):
            at = r.randrange(len(w) + 1)
            w[at : at + r.randrange(2)] = r.choice(["", r.choice(letters)])
        if len(w) >= 6:
            words.add("".join(w))
    return sorted(words)


def test_automaton_numbers_words_and_is_minimal():
    words = family(1, 300)
    automaton = Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("zzz") is None and automaton.number(words[5][:-1] + "q") is None
    # States from which the same ends follow are one: as many states as sets of ends.
    begins = {w[:i] for w in words for i in range(len(w) + 1)}
    assert len(automaton.final) == len({frozenset(w[len(b) :] for w in words if w.startswith(b)) for b in begins})
    assert Automaton([]).number("a") is None and Automaton([]).near("abc", 1) == set() and Automaton([""]).number("") == 0


@pytest.mark.parametrize("seed", range(4))
def test_near_in_both_directions_equals_all_pairs(seed):
    words = family(seed + 10, 250, "ab" if seed % 2 else "abcdé")
    backward = sorted(w[::-1] for w in words)
    ahead, behind = Automaton(words), Automaton(backward)
    for w in words:
        half = len(w) // 2
        found = {words[i] for i in ahead.near(w, half)} | {backward[i][::-1] for i in behind.near(w[::-1], len(w) - half)}
        assert found == {v for v in words if at_one_error(w, v)}, w
        by_length = set().union(*({words[i] for i in ahead.near(w, half, len(w) + more)} for more in (-1, 0, 1)))
        assert by_length == {words[i] for i in ahead.near(w, half)}


@pytest.mark.parametrize("most", (spelling_variants.MOST, 40, 3))
def test_pairs_equal_all_pairs_however_shards_are_divided(spark, tmp_path, most):
    words = family(7, 500) + family(8, 200, "xyz")
    r = random.Random(3)
    n = {w: r.choice((5, 5, 6, 30, 200, 1000, 1000)) for w in words}
    spark.createDataFrame(list(n.items()), "word string, n long").write.parquet(str(tmp_path / "words"))
    table = spark.read.parquet(str(tmp_path / "words"))
    got = Counter((x["word"], x["near"], x["n"], x["near_n"]) for x in spelling_variants.near_pairs(table, most).collect())
    want = {(a, b, n[a], n[b]) for a in n for b in n if at_one_error(a, b)}
    assert set(got) == want and max(got.values()) == 1  # each pair once
    spelling_variants.forms(table, most=most).write.parquet(str(tmp_path / "forms"))
    rooted = spelling_variants.with_roots(spark.read.parquet(str(tmp_path / "forms")))
    assert {tuple(x) for x in rooted.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(n)
    assert any(f and root != f for _, f, root, *_ in brute_variants(n))


def hard_rows():
    r = random.Random(5)
    words = family(9, 60)
    rows = [(d, " ".join(r.choices(words, weights=[3 ** (i % 7) for i in range(len(words))], k=120)).replace("a", r.choice("aA"))) for d in range(150)]
    rows += [(1, None), (2, ""), (None, "nothing Nothing NOTHING nothing,nothing nothinG"), (3, "a" * 50_000 + " ÉÉÉÉÉÉ éééééé ×÷×÷×÷ " * 5), (4, "short word " * 9)]
    return rows + [(5, "repeated" + " repeated" * 4)] * 2 + [(6, "Straße Straße straße STRASSE naïveté naïvet"), (7, "日本語 abcdef_ghijkl " * 6)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = hard_rows()
    docs = spark.createDataFrame([(d, t, "en", "s", None) for d, t in rows], DOCS).withColumns({c: F.lit("x") for c in ("word", "n", "form", "letters")})
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_spelling(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == brute_variants(brute_words(rows)) and len({r["word"] for r in got}) == len(got)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op11_spelling(spark, str(tmp_path / "none")).count() == 0


def test_given_documents_equal_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op11_spelling(spark, sf_dir).collect()} == brute_variants(brute_words(rows))


def test_memory_of_counting_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 5)
    docs = spark.createDataFrame(hard_rows(), "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling_variants.vocabulary(docs).collect()}
    assert got == brute_words(hard_rows())
