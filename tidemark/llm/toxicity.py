"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguises: compatibility forms, accents, look-alike letters of other
scripts and invisible characters go to plain letters; digits and signs inside words go
to the letters they stand for; i and l, which share their substitutes, become one
letter. Entries are whole words, or stems that match where a word begins. A hit inside
an exception phrase does not count, and of hits that begin together the longest does.
The hits' weights, normalised by the text's length, give a calibrated score.

Weights are log-odds learned from labelled rows over a small fixed seed lexicon.

Defined results: null or empty text has no hits and gets the score of none; equal
texts get equal scores; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Bounds of the fit: clean and toxic rows, characters of a text that are sampled, entries learned.
FIT_ROWS, FIT_CHARS, FIT_ENTRIES = (8000, 2000), 12_288, 5000
#: An entry needs odds so many times the clean texts', and so much evidence: the log-likelihood
#: by which its texts' split beats chance. Both together, since of very many candidates some have either.
LEAST_ODDS, LEAST_EVIDENCE = 8.0, 7.0
STEM_LENGTHS, COVER, FOLDS = range(4, 11), 3, 2
THRESHOLD = 0.5

#: What a lexicon holds before anything is learned, with weights.
SEED_WORDS = {
    "idiot": 3.0, "moron": 3.0, "imbecile": 3.0, "scum": 3.0, "stupid": 2.5, "pathetic": 2.0, "worthless": 2.0,
    "disgusting": 2.0, "loser": 2.0, "trash": 1.5, "clown": 1.5, "bastard": 3.0, "asshole": 3.5, "retard": 3.5,
}
#: Phrases in which such a word offends nobody.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash pickup", "take out the trash", "clown fish",
    "circus clown", "clown car", "class clown", "pond scum", "soap scum", "scum line", "loser bracket", "stupid simple",
)

#: Letters of other scripts that look like the Latin letter beneath.
LOOKALIKES = (
    str.maketrans("авсԁеһіјкӏмнопрԛгѕтѵшхуԝ", "abcdehijklmhonpqrstvwxyw")
    | str.maketrans("αβγεηικνοπρτυχω", "abyenikvonptuxw")
    | str.maketrans("ıɡ", "ig")
)
#: Signs that stand for letters inside a word.
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasii")

_DIGITS = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![\w@$])[013457@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[01345@$]+(?!\w)")
_HAS_SIGN = re.compile(r"[013457@$!|]")
_WORD = re.compile(r"[^\W\d_]+")


def _fold_table() -> dict[int, str]:
    """From the character data: compatibility forms without marks, in lower case; invisibles to nothing."""
    table: dict[int, str] = {}
    spans = ((0x41, 0x24F), (0x300, 0x52F), (0x1E00, 0x1EFF), (0x200B, 0x200F), (0x2060, 0x2064), (0x250, 0x2AF), (0x2100, 0x214F), (0x2460, 0x24FF), (0xFEFF, 0xFF5E), (0x1D400, 0x1D7FF))
    for low, high in spans:
        for code in range(low, high + 1):
            char = chr(code)
            plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if unicodedata.category(char) in ("Cf", "Mn", "Me"):
                plain = ""
            plain = plain.lower().replace("ß", "ss").translate(LOOKALIKES).replace("l", "i")
            if plain != char:
                table[code] = plain
    table[0xAD] = ""
    return table


_FOLD = _fold_table()


def fold(text: str) -> str:
    folded = text.translate(_FOLD)
    if _HAS_SIGN.search(folded):
        for _ in range(2):  # a sign may stand beside one that is a letter only after the first pass
            folded = _DIGITS.sub(lambda m: m.group().translate(SUBSTITUTES), folded)
    return folded


@dataclass(frozen=True)
class Lexicon:
    """Folded entries with weights: words match whole, stems where a word begins."""

    words: tuple[tuple[str, float], ...]
    stems: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = tuple(fold(p) for p in EXCEPTIONS)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for kind, listed in (("word", lexicon.words), ("stem", lexicon.stems)):
            for entry, weight in listed:
                entries.setdefault(entry, []).append((kind, len(entry), weight))
        for entry in lexicon.exceptions:
            entries.setdefault(entry, []).append(("exception", len(entry), 0.0))
        for entry, meanings in entries.items():
            self.automaton.add_word(entry, meanings)
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of what counts, in order."""
        if self.empty:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        n = len(folded)
        for last, meanings in self.automaton.iter(folded):
            for kind, length, weight in meanings:
                start, end = last + 1 - length, last + 1
                if start and folded[start - 1].isalnum():
                    continue
                if kind != "stem" and end < n and folded[end].isalnum():
                    continue
                if kind == "exception":
                    spared.append((start, end))
                elif (end, weight) > best.get(start, (0, 0.0)):
                    best[start] = (end, weight)
        found = [(start, end, weight) for start, (end, weight) in sorted(best.items())]
        if spared:
            found = [h for h in found if not any(a <= h[0] and h[1] <= b for a, b in spared)]
        return found


def features(weights: list[float], length: int) -> tuple[float, ...]:
    total = sum(weights)
    return (
        total / math.sqrt(length / 5 + 20), total / (length / 500 + 1), max(weights, default=0.0),
        math.log1p(len(weights)), float(bool(weights)),
    )


def distinct_texts(texts: Iterable[tuple[str, int]]) -> Iterator[tuple[str, int]]:
    """One of each group of near copies: texts that share one of four smallest shingle hashes with an earlier one go.

    Copies would make the chance words of one text look like evidence from many.
    """
    known: set[tuple[int, int, int]] = set()
    for text, label in texts:
        words = text.split()
        hashes = np.array([zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 2))], dtype=np.uint64)
        marks = {(label, k, int(((hashes * factor) & 0xFFFFFFFF).min())) for k, factor in enumerate((1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))}
        if not marks & known:
            yield text, label
        known |= marks


def _entries(text: str) -> set[str]:
    """The words of a text and, with a star, the stems that they begin with."""
    words = set(_WORD.findall(fold(text)))
    return words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) > k}


def learn_lexicon(texts: Iterable[tuple[str, int]], entries: int = FIT_ENTRIES) -> Lexicon:
    """Words and stems by the log-odds of the distinct texts that hold them; texts: (text, label).

    Entries are chosen by evidence, the strongest first and of equals the longest; each
    must bring enough of it from toxic texts that fewer than COVER entries explain so far,
    and none begins with another.
    """
    texts = list(distinct_texts(texts))
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    n = {0: 0, 1: 0}
    for text, label in texts:
        seen[label].update(_entries(text))
        n[label] += 1
    share = (n[1] + 0.5) / (n[0] + n[1] + 1)

    def evidence(toxic: int, clean: int) -> float:
        if not toxic:
            return 0.0
        found = toxic * math.log(toxic / (toxic + clean) / share)
        return found + (clean * math.log(clean / (toxic + clean) / (1 - share)) if clean else 0.0)

    odds = {
        entry: math.log(ratio)
        for entry, toxic in seen[1].items()
        if len(entry) >= 3
        and evidence(toxic, clean := seen[0][entry]) >= LEAST_EVIDENCE
        and (ratio := ((toxic + 0.5) / (n[1] + 1)) / ((clean + 0.5) / (n[0] + 1))) >= LEAST_ODDS
    }
    holders: dict[str, set[int]] = {entry: set() for entry in odds}
    for i, (text, label) in enumerate(texts):
        if label:
            for entry in _entries(text) & odds.keys():
                holders[entry].add(i)
    chosen: dict[str, float] = {}
    covers: Counter = Counter()
    plains: list[str] = []
    for entry in sorted(odds, key=lambda e: (-round(evidence(seen[1][e], seen[0][e]), 6), -len(e.rstrip("*")), e)):
        plain = entry.rstrip("*")
        if any(plain.startswith(e) or e.startswith(plain) for e in plains):
            continue
        fresh = sum(covers[i] < COVER for i in holders[entry])
        if len(chosen) < entries and evidence(fresh, seen[0][entry]) >= LEAST_EVIDENCE:
            chosen[entry] = odds[entry]
            plains.append(plain)
            covers.update(holders[entry])
    words = {fold(w): weight for w, weight in SEED_WORDS.items()}
    words |= {e: w for e, w in chosen.items() if not e.endswith("*")}
    return Lexicon(tuple(sorted(words.items())), tuple(sorted((e[:-1], w) for e, w in chosen.items() if e.endswith("*"))))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    beta: tuple[float, ...]


def _features_of(lexicon: Lexicon, texts: Iterable[str]) -> np.ndarray:
    matcher = Matcher(lexicon)
    return np.array([features([h[2] for h in matcher.hits(fold(t))], len(t)) for t in texts]).reshape(-1, 5)


def fit(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = FIT_ROWS, max_chars: int = FIT_CHARS) -> ToxicityModel:
    """Fits on at most rows texts of the two classes.

    All of them teach the lexicon. The calibration sees of each text the hits of a lexicon that other folds taught, so
    an entry's hit counts for what it is worth in texts that it was not learned from.
    """
    sample = (
        common.label_sample(docs, labels, "toxic", rows, max_chars)
        .select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).alias("fold"))
        .toPandas()
        .sort_values(["doc_id", "text"], ignore_index=True)
    )
    taught = lambda some: learn_lexicon(zip(some.text, some.label, strict=True))
    x, y = np.zeros((len(sample), 5)), sample.label.to_numpy(float)
    for k in range(FOLDS):
        own = (sample.fold == k).to_numpy()
        x[own] = _features_of(taught(sample[~own]), sample.text[own])
    counts = common.label_counts(labels, "toxic")
    weight = np.ones(len(y))
    for value in (0, 1):
        if n := (y == value).sum():
            weight[y == value] = counts.get(value, 0) / n
    mean, scale, beta = common.fit_logistic(x, y, weight)
    return ToxicityModel(taught(sample), tuple(mean), tuple(scale), tuple(beta))


def score_column(model: ToxicityModel, text: Column) -> Column:
    """struct<score double, hits int, weight double> of the whole text."""

    @F.pandas_udf("score double, hits int, weight double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model.lexicon)
        mean, scale, beta = (np.array(v) for v in (model.mean, model.scale, model.beta))
        for texts in batches:
            rows, said = [], []
            for text in texts:
                weights = [h[2] for h in matcher.hits(fold(text))] if text else []
                rows.append(features(weights, len(text or "")))
                said.append((len(weights), sum(weights)))
            margin = beta[0] + ((np.array(rows).reshape(-1, 5) - mean) / scale) @ beta[1:]
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pd.DataFrame({"score": score, "hits": [h for h, _ in said], "weight": [float(w) for _, w in said]})

    return toxicity(text)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted, hits, weight of every document."""
    return docs.select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("s")
    ).select(
        "doc_id", "held_out", "s.score", F.when(F.col("s.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "s.hits", "s.weight"
    )
