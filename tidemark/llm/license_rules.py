"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression with a label, a priority, a confidence and a keyword
that every match of it holds. An Aho-Corasick pass finds the keywords; only rules whose
keyword occurs run, and only on the stretches around its occurrences (matches are at
most REACH characters long, so nothing is missed). Detections are taken in the order of
priority, then length, then place; one whose interval lies inside that of a detection
already taken is suppressed.

Besides, fixed base phrases are counted as runs of words.

Defined results: null text counts as empty and has no detections; letters A-Z are
lower-cased, nothing else is folded; equal texts get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.license_signatures import SIGNATURES

#: Longest match of any rule, in characters.
REACH = 400

#: Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All signature rules, in the order of their table, named by label and number."""
    made: list[Rule] = []
    for line in SIGNATURES.splitlines():
        if line and not line.startswith("#"):
            label, keyword, priority, confidence, pattern = line.split(" | ", 4)
            made.append(Rule(f"{label}:{len(made)}", label, int(priority), float(confidence), keyword, pattern))
    return tuple(made)


_MARKS = re.compile(r" (?:[*#;]|//)+(?= )")
#: Bytes to words: A-Z become small, what is neither letter, digit nor beyond ASCII becomes a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def base_places(text: str) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and (word number, label) of every place of a base phrase."""
    data = text.encode("utf-8", "replace").translate(_WORD_BYTES)
    words = data.split()
    found = []
    for phrase, label in BASE_PHRASES.items():
        parts = [p.encode() for p in phrase.split()]
        if all(p in data for p in parts):
            n = len(parts)
            at = -1
            try:
                while True:
                    at = words.index(parts[0], at + 1)
                    if words[at : at + n] == parts:
                        found.append((at, label))
            except ValueError:
                pass
    return len(words), sorted(found)


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: Rule


class Scanner:
    """Finds and resolves detections; offsets are those of the text with runs of blanks and comment marks as one blank."""

    def __init__(self) -> None:
        self.by_keyword: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        for rule in rules():
            self.by_keyword.setdefault(rule.keyword, []).append((rule, re.compile(rule.pattern, re.ASCII)))
        self.automaton = ahocorasick.Automaton()
        for keyword in self.by_keyword:
            self.automaton.add_word(keyword, keyword)
        self.automaton.make_automaton()

    @staticmethod
    def _normal(text: str) -> str:
        """A-Z in lower case; runs of blanks, with comment marks between them, as one blank."""
        lower = text.encode("utf-8", "replace").lower().decode()
        normal = " ".join(lower.split())
        return _MARKS.sub("", normal) if any(m in normal for m in (" * ", " # ", " // ", " ; ")) else normal

    def scan(self, text: str) -> list[Detection]:
        normal = self._normal(text)
        places: dict[str, list[int]] = {}
        for last, keyword in self.automaton.iter(normal):
            places.setdefault(keyword, []).append(last)
        found = []
        for keyword, ends in places.items():
            stretches: list[list[int]] = []
            for last in ends:
                low, high = last - REACH, last + REACH
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = high
                else:
                    stretches.append([max(0, low), high])
            for rule, pattern in self.by_keyword[keyword]:
                for low, high in stretches:
                    found += [Detection(m.start(), m.end(), rule) for m in pattern.finditer(normal, low, min(high, len(normal)))]
        return resolve(found)


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections that lie in none of higher rank, in the order of their places.

    Rank: priority, then length, then place, then the rule's name. Of those taken, only
    intervals that none contains are kept for comparison: sorted by start, their ends
    ascend, so one search decides.
    """
    from bisect import bisect_right, insort

    starts: list[tuple[int, int]] = []
    taken = []
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.name)):
        i = bisect_right(starts, (d.start, float("inf"))) - 1
        # The last interval that begins no later reaches furthest.
        if i >= 0 and starts[i][1] >= d.end:
            continue
        taken.append(d)
        j = i + 1
        while j < len(starts) and starts[j][1] <= d.end:
            del starts[j]
        if i >= 0 and starts[i][0] == d.start:
            del starts[i]
        insort(starts, (d.start, d.end))
    return sorted(taken, key=lambda d: (d.start, d.end))


def score_of(detections: list[Detection], base: int) -> float:
    """Confidence that the text states a licence: independent detections add up."""
    miss = 0.5 if base else 1.0
    for d in {d.rule.name: d for d in detections}.values():
        miss *= 1 - min(d.rule.confidence, 0.99)
    return 1 - miss


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<rule string, label string, start int, end int>>"


def scan_column(text: Column) -> Column:
    @F.pandas_udf(RESULT)
    def licenses(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                n_words, base = base_places(text)
                found = scanner.scan(text)
                base_labels = sorted({label for _, label in base})
                labels = sorted({*base_labels, *(d.rule.label for d in found)})
                rows.append(
                    (n_words, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(base_labels), ",".join(labels),
                     score_of(found, len(base)), [{"rule": d.rule.name, "label": d.rule.label, "start": d.start, "end": d.end} for d in found])
                )
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            yield pd.DataFrame(rows, columns=names).astype({"first_word": "Int64", "last_word": "Int64"})

    return licenses(text)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of base phrases, labels, score and detections (rule, label, start, end) of every document."""
    return docs.select("doc_id", scan_column(F.col("text")).alias("r")).select("doc_id", "r.*")
