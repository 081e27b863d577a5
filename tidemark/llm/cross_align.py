"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked ids.

The ends of both tokens' byte ranges cut a text into elementary intervals. Each lies in one
token of either side (found by binary search in that side's ends), so each is one overlap of a
pair of tokens. An end that both sides share closes a group; within a group every token of
one side is linked to every token of the other.

Texts are aligned in blocks of bounded bytes, laid end to end: a text's end is shared by both
sides, so one call aligns many. Where blanks stand alone between words, neither vocabulary
joins characters across them, so the ids of words are remembered (at most REMEMBERED in a worker).

Counting (how many documents hold an id pair linked) combines before it shuffles. Of the
counts the MOST_WIDESPREAD largest are broadcast, a fixed bound; what is not among them
stands in at most one of MOST_WIDESPREAD rows, so the exact join that resolves it has no hot key.

Defined results: a null or empty text has no tokens, nor has one that one side does not give
back byte for byte (its groups text is empty, its numbers are 0); null doc_ids stay null;
repeated rows are documents of their own; other columns are left out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.bpe_prefix import byte_letters

#: Words that a worker remembers, and the longest word that it does.
REMEMBERED, LONGEST = 250_000, 64
#: Bytes of text of one block, and links of a group that are laid out one by one.
BLOCK, LAID = 1 << 20, 1 << 12
#: Id pairs whose counts are broadcast.
MOST_WIDESPREAD = 500_000

ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<pair: long, times: long>>"


class Side:
    """What both tokenizers offer: ids of a text, and the bytes of an id."""

    token_bytes: list[bytes]

    def encode(self, text: str) -> list[int]:
        raise NotImplementedError

    def lengths(self) -> np.ndarray:
        return np.array([len(b) for b in self.token_bytes], np.int64)


class ByteLevel(Side):
    """A byte-level BPE file; control strings in a text are plain text, and a blank is put before it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        value = {c: b for b, c in enumerate(byte_letters())}
        names = {i: name for name, i in self.library.get_vocab().items()}
        control = {i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        # A control token is never given for plain text: it has no bytes.
        self.token_bytes = [b"" if i in control or i not in names else bytes(value[c] for c in names[i]) for i in range(max(names) + 1)]

    def encode(self, text: str) -> list[int]:
        return self.raw(" " + text)

    def raw(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces(Side):
    """A SentencePiece model, which puts a blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        of = self.library
        self.token_bytes = [
            bytes([int(name[3:5], 16)]) if of.is_byte(i) else b"" if of.is_control(i) or of.is_unknown(i) else name.replace("▁", " ").encode()
            for i, name in ((i, of.id_to_piece(i)) for i in range(of.vocab_size()))
        ]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


class Words:
    """Both sides' ids of whole texts, by remembered words where a text is cut at single blanks and line feeds."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.lengths = a.lengths(), b.lengths()

    def _exact(self, whole: bytes, a: list[int], b: list[int]) -> bool:
        of_a, of_b = self.a.token_bytes, self.b.token_bytes
        return b"".join([of_a[i] for i in a]) == whole == b"".join([of_b[i] for i in b])

    def _learn(self, word: str) -> tuple[bytes, bytes] | None:
        """Ids of a word behind a blank, or of one that begins with a line feed as it is; None if its text must be read whole."""
        if not _cut(word):
            return None
        b = self.b.encode(word)
        if word[0] == "\n":  # the blank that is put before it is a token of its own there
            whole, a, b = word, self.a.raw(word), b[1:]
        else:
            whole, a = " " + word, self.a.encode(word)
        return (array("i", a).tobytes(), array("i", b).tobytes()) if self._exact(whole.encode(), a, b) else None

    def _learn_all(self, words: list[str]) -> None:
        """Remembers words; they are read as one text, and its ids cut where the words end."""
        self.known |= dict.fromkeys((w for w in words if not _cut(w)))
        words = [w for w in words if _cut(w)]
        # Something behind a blank comes first, for words that begin with a line feed.
        said = [" a", *[w if w[0] == "\n" else " " + w for w in words]]
        whole = "".join(said)
        a, b = self.a.raw(whole), self.b.encode(whole[1:])
        stops = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in said])
        cut = []
        for ids, lengths in zip((a, b), self.lengths, strict=True):
            ends = np.cumsum(lengths[ids])
            at = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
            cut.append((at + 1) if (ends[at] == stops).all() else None)
        if cut[0] is None or cut[1] is None or not self._exact(whole.encode(), a, b):
            self.known |= {w: self._learn(w) for w in words}
            return
        data = [np.array(ids, np.int32).tobytes() for ids in (a, b)]
        (low_a, *stops_a), (low_b, *stops_b) = ((at * 4).tolist() for at in cut)
        for word, high_a, high_b in zip(words, stops_a, stops_b, strict=True):
            self.known[word] = data[0][low_a:high_a], data[1][low_b:high_b]
            low_a, low_b = high_a, high_b

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides as 32-bit numbers; none for a text that has no tokens."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, split = self.known, [t.replace("\n", " \n").split(" ") if t else [] for t in texts]
        if new := {w for words in split for w in words if w not in known and len(w) <= LONGEST}:
            self._learn_all(list(new))
        out = []
        for text, words in zip(texts, split, strict=True):
            pairs = [known[w] if w in known else self._learn(w) for w in words]
            if None in pairs:  # no cut at blanks
                a, b = self.a.encode(text), self.b.encode(text)
                out.append((array("i", a).tobytes(), array("i", b).tobytes()) if self._exact(b" " + text.encode(), a, b) else (b"", b""))
            else:
                out.append((b"".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])))
        return out


def _cut(word: str) -> bool:
    """Whether both tokenizers close a token before and behind a word: no white space touches that which it was cut at."""
    bare = word[1:] if word[:1] == "\n" else word
    return bool(bare) and not bare[0].isspace() and not bare[-1].isspace() and "▁" not in bare


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, token of a, token of b) of every elementary interval of two ascending arrays of ends."""
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")  # two ascending runs: one merge
    ends = both[np.concatenate([both[1:] != both[:-1], [True]])] if len(both) else both  # as np.union1d, which hashes
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every group how many tokens of a and of b the groups up to it hold. The last ends must be equal."""
    ends, of_a, of_b = overlaps(ends_a, ends_b)
    shared = (ends_a[of_a] == ends) & (ends_b[of_b] == ends)
    return of_a[shared] + 1, of_b[shared] + 1


def products(a: np.ndarray, b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, pair, times) of all links, pair = id of a << 32 | id of b.

    Small groups are laid out together, token by token; of a large one the distinct ids are multiplied.
    """
    starts_a, starts_b = np.concatenate([[0], stops_a[:-1]]), np.concatenate([[0], stops_b[:-1]])
    n_a, n_b = stops_a - starts_a, stops_b - starts_b
    small = np.flatnonzero(n_a * n_b <= LAID)
    sizes = (n_a * n_b)[small]
    for at in np.split(small, np.searchsorted(np.cumsum(sizes), np.arange(LAID << 9, sizes.sum(), LAID << 9))):
        size = n_a[at] * n_b[at]
        group = np.repeat(at, size)
        place = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        width = n_b[group]
        yield group, a[starts_a[group] + place // width] << 32 | b[starts_b[group] + place % width], np.ones(len(group), np.int64)
    for at in np.flatnonzero(n_a * n_b > LAID).tolist():
        ids_a, times_a = np.unique(a[starts_a[at] : stops_a[at]], return_counts=True)
        ids_b, times_b = np.unique(b[starts_b[at] : stops_b[at]], return_counts=True)
        pair = (ids_a[:, None] << 32 | ids_b[None, :]).ravel()
        yield np.full(len(pair), at), pair, (times_a[:, None] * times_b[None, :]).ravel()


class Aligner:
    """One for each worker process."""

    def __init__(self, path_a: str, path_b: str):
        a, b = ByteLevel(path_a), Pieces(path_b)
        self.words = Words(a, b)
        self.lengths = self.words.lengths
        names = [[f"{i}{mark}" for i in range(len(side.token_bytes))] for side, marks in ((a, ",|"), (b, ",;")) for mark in marks]
        self.written = np.array([n for part in names for n in part], object)

    def block(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Columns of ROWS, but for row and doc_id, of a block of texts; links as (text, pair, times), ascending."""
        ids = self.words.ids(texts)
        a, b = (np.frombuffer(b"".join([p[s] for p in ids]), np.int32).astype(np.int64) for s in (0, 1))
        n_a, n_b = (np.array([len(p[s]) // 4 for p in ids], np.int64) for s in (0, 1))
        empty = np.zeros(len(texts), np.int64)
        if not len(a):
            return {"n_a": n_a, "n_b": n_b, "n_groups": empty, "n_links": empty, "groups": [""] * len(texts), "links": (empty[:0], empty[:0], empty[:0])}
        stops_a, stops_b = groups(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        text_of = np.searchsorted(np.cumsum(n_a), stops_a)  # the text of each group
        of_a, of_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
        n_groups = np.bincount(text_of, minlength=len(texts))
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, text_of, of_a * of_b)
        found: list[tuple[np.ndarray, ...]] = []
        for group, pair, times in products(a, b, stops_a, stops_b):
            found.append(_summed(text_of[group], pair, times))
        links = found[0] if len(found) == 1 else _summed(*(np.concatenate(part) for part in zip(*found, strict=True)))
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": self._groups(a, b, stops_a, stops_b, n_a + n_b), "links": links}

    def _groups(self, a: np.ndarray, b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray, sizes: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: every id with the mark that follows it, a's of a group before b's."""
        size_a, size_b = (len(x) for x in self.lengths)
        code_a, code_b = a.copy(), b + 2 * size_a
        code_a[stops_a - 1] += size_a
        code_b[stops_b - 1] += size_b
        of_a, of_b = np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(stops_b - of_b, of_a)] = code_a
        codes[np.arange(len(b)) + np.repeat(stops_a, of_b)] = code_b
        marks, out, at = self.written[codes].tolist(), [], 0
        for size in sizes.tolist():
            out.append("".join(marks[at : at + size])[:-1])
            at += size
        return out


def _summed(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of times by text and pair, in their order."""
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[first], pair[first], np.add.reduceat(times, first) if len(first) else times


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row (any unique number), doc_id, n_a, n_b, n_groups, n_links, groups (written out) and links (distinct id pairs, with how often) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = aligner(path_a, path_b)

        def made(rows: pa.Array, doc_ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
            got = of.block(texts)
            text, pair, times = got["links"]
            offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            links = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"]))
            numbers = [pa.array(got[c]) for c in ("n_a", "n_b", "n_groups", "n_links")]
            return pa.RecordBatch.from_arrays(
                [rows, doc_ids, *numbers, pa.array(got["groups"], pa.string()), links],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"],
            )

        for batch in batches:
            texts, at = batch.column("text"), 0
            size, stop = 0, 0
            for stop, length in enumerate(pa.compute.binary_length(texts).fill_null(0).to_pylist(), 1):
                size += length
                if size >= BLOCK:
                    yield made(batch.column("row")[at:stop], batch.column("doc_id")[at:stop], texts[at:stop].to_pylist())
                    at, size = stop, 0
            if at < stop:
                yield made(batch.column("row")[at:stop], batch.column("doc_id")[at:stop], texts[at:stop].to_pylist())

    # A row's number names it within one run of the plan; what is written with it keeps it.
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.mapInArrow(run, ROWS)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, held, best) of links (row, pair, times): in how many rows a pair stands, and whether that is the most of its a id's pairs."""
    held = common.materialize(links.groupBy("pair").agg(F.count(F.lit(1)).alias("held")), "align-held")
    # One row for each id of a vocabulary.
    most = held.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("held").alias("most"))
    return common.materialize(held.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "held", (F.col("held") == F.col("most")).alias("best")), "align-counts")


def with_counts(aligned: DataFrame, widespread: int = MOST_WIDESPREAD) -> DataFrame:
    """aligned with n_best and count_sum in place of links.

    widespread: how many of the largest counts are broadcast; the others are joined.
    """
    aligned = common.materialize(aligned, "align-rows")
    links = aligned.select("row", F.inline("links"))
    counts = pair_counts(links)
    order = [F.col("held").desc(), F.col("pair")]
    # At most `widespread` rows of two numbers and a flag: safe to broadcast at any table size.
    top = counts.orderBy(*order).limit(widespread)
    if counts.count() <= widespread:
        found = links.join(F.broadcast(counts), "pair")
    else:
        top = common.materialize(top, "align-widespread")
        met = links.join(F.broadcast(top), "pair", "left")
        rare = counts.join(F.broadcast(top.select("pair")), "pair", "left_anti")
        found = met.where(F.col("held").isNotNull()).unionByName(met.where(F.col("held").isNull()).select("row", "pair", "times").join(rare, "pair"))
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return aligned.drop("links").join(sums, "row", "left").select(*[c for c in aligned.columns if c not in ("row", "links")], zero("n_best"), zero("count_sum"))
