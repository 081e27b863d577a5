"""Quality classifier: how much better good text's dictionaries compress a text than bad text's.

Pairs of zstandard dictionaries are trained, one of a pair on good and one on bad labelled
text, at several sizes. A text is cut into blocks and each block is compressed with either
dictionary; blocks keep the dictionaries' share of the matches alike in short and long texts.
The size differences of the pairs, normalised by the text's length, add up to one number,
and a logistic curve of it is the score: the more the good dictionaries save, the higher. A
short text says little, so its evidence shrinks with length / (length + SHORT) towards the
classes' shares. The curve is fitted on differences that dictionaries of other texts gave
(the labelled texts are dealt into folds), so all of them can teach.

Defined results: a null or empty text gets the curve's score of no evidence; equal texts get
equal scores; other columns are not looked at. With fewer than LEAST_ROWS labelled texts of a
class its dictionaries are made of chance: the curve is flat then, and every text has the share of
good ones among all labelled rows as its score (one half without labels), so either all are kept or none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Bounds of the fit: rows of each class, and characters of a text that are sampled (a stretch of longer ones).
FIT_ROWS, FIT_CHARS = 3000, 12_288
#: Labelled texts that each class has at least, for differences to say anything.
LEAST_ROWS = 12
#: Pairs of dictionaries: bytes of a dictionary, and of the blocks that it compresses.
PAIRS, LEVEL, FOLDS = ((32_768, 2048), (65_536, 1024), (112_640, 512)), 3, 3
#: Bytes of a text whose evidence counts half, and the difference near which more of it adds less.
SHORT, STRONG = 250, 0.05
#: A document is kept if its score is at least this.
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries (good, bad) in the order of PAIRS, and the curve: base, and factors of the two columns of evidence."""

    dictionaries: tuple[tuple[bytes, bytes], ...]
    base: float
    slope: float
    length: float

    def score(self, differences: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For texts of one size the score never falls with the difference."""
        margin = self.base + evidence(differences, sizes) @ np.array([self.slope, self.length])
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def evidence(differences: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of (difference, one), both in proportion to what a text of that many bytes says."""
    share = sizes / (sizes + SHORT)
    return np.stack([np.tanh(differences / STRONG) * share, share], 1)


def size_of(text: str | None) -> int:
    return len((text or "").encode("utf-8", "replace"))


class Difference:
    """What the good dictionaries save against the bad ones, as a share of a text's bytes."""

    def __init__(self, dictionaries: tuple[tuple[bytes, bytes], ...]):
        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            more = {}
            if content:
                more["dict_data"] = zstandard.ZstdCompressionDict(content)
                more["dict_data"].precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **more)

        self.pairs = [(block, compressor(good), compressor(bad)) for (_, block), (good, bad) in zip(PAIRS, dictionaries, strict=True)]

    def of(self, text: str | None) -> float:
        data = (text or "").encode("utf-8", "replace")
        saved = 0
        for block, good, bad in self.pairs:
            for at in range(0, len(data), block):
                part = data[at : at + block]
                saved += len(bad.compress(part)) - len(good.compress(part))
        return saved / (len(self.pairs) * max(1, len(data)))


def _train(texts: list[str], size: int, block: int) -> bytes:
    """A dictionary from blocks of texts; b"" where there is too little to train on."""
    blocks = [data[at : at + block] for data in (t.encode("utf-8", "replace") for t in texts) for at in range(0, len(data), block)]
    total = sum(map(len, blocks))
    if len(blocks) < 16 or total < 4096:
        return b"".join(blocks)[-size:] if total >= 64 else b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), blocks).as_bytes()
    except zstandard.ZstdError:  # too uniform to train: its tail serves as raw content
        return b"".join(blocks)[-size:]


def train(texts: pd.DataFrame) -> tuple[tuple[bytes, bytes], ...]:
    """Dictionaries of both classes; texts: text, label."""
    good, bad = (list(texts[texts.label == value].text) for value in (1, 0))
    return tuple((_train(good, size, block), _train(bad, size, block)) for size, block in PAIRS)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, max_chars: int = FIT_CHARS) -> QualityModel:
    """Fits on at most rows texts of each class.

    The bound makes the sample a constant, so it may be collected: rows * 2 stretches of text.
    """
    sample = (
        common.label_sample(docs, labels, "quality", (rows, rows), max_chars)
        .select("doc_id", "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).alias("fold"))
        .toPandas()
        .sort_values(["doc_id", "text"], ignore_index=True)
    )
    counts = common.label_counts(labels, "quality")
    if min((sample.label == value).sum() for value in (0, 1)) < LEAST_ROWS:
        share = (counts.get(1, 0) + 0.5) / (counts.get(0, 0) + counts.get(1, 0) + 1)
        return QualityModel(train(sample), float(np.log(share / (1 - share))), 0.0, 0.0)
    x, y = np.zeros(len(sample)), sample.label.to_numpy(float)
    for fold in range(FOLDS):
        own = (sample.fold == fold).to_numpy()
        if own.any():
            difference = Difference(train(sample[~own]))
            x[own] = [difference.of(t) for t in sample.text[own]]
    weight = np.ones(len(y))
    for value in (0, 1):  # the sample is even; weights give the classes' true shares back
        if n := (y == value).sum():
            weight[y == value] = counts.get(value, 0) / n
    mean, scale, beta = common.fit_logistic(evidence(x, np.array([size_of(t) for t in sample.text], float)), y, weight, ridge=1e-5)
    slope, length = (beta[1:] / scale).tolist()
    slope = max(0.0, slope)  # what the good dictionaries save never speaks against a text
    return QualityModel(train(sample), float(beta[0] - slope * mean[0] - length * mean[1]), slope, length)


def score_column(model: QualityModel, text: Column) -> Column:
    """score double in (0, 1) of the whole text."""

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        difference = Difference(model.dictionaries)
        for texts in batches:
            found = np.array([difference.of(t) for t in texts], dtype=float)
            yield pd.Series(model.score(found, np.array([size_of(t) for t in texts], dtype=float)))

    return quality(text)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return docs.select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), score_column(model, F.col("text")).alias("score")
    ).select("*", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    own = docs.columns
    common.bound_batches(docs.sparkSession)
    scored = docs.withColumn("_tidemark_score", score_column(model, F.col("text")))
    return scored.where(F.col("_tidemark_score") >= THRESHOLD).select(*own)
