"""Spelling variants: words at one error from a much more frequent word, over a whole corpus.

A word at one error from another agrees with it in its first half or in the rest. So each
word is looked up twice: in an automaton over words, walking its first half exactly and
completing with at most one error, and in one over reversed words, from its end. The
automata are minimal and acyclic; counts on their edges give each word its number in sorted
order, so counts of words stand in plain arrays beside them.

The vocabulary is dealt into shards by three letters at the start (and again at the end) on
which near words agree, as halves hold three letters at least. A task joins shards to automata of
about MOST words. A shard over MOST words is divided by length and by all of the half that
near words share, and what is still over it by half of what is left, which near words share
at its beginning or at its end: then about a quarter of a word is free, nothing is
capped, and each word asks only the few shards that can hold a near one. A pair that both
halves find counts at the first of them, so nothing is paired twice.

Words are counted in tasks and combined before the shuffle, a document's repeats first.

Defined results: null and empty texts have no words; a null doc_id is written as nothing;
repeated rows count again; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Code points a word has at least, occurrences, how many times more frequent a form is, and the fraction of runs that lose a letter.
LEAST_LENGTH, LEAST_COUNT, TIMES, LOSES = 6, 5, 5, 199
#: Letters that name a shard, and words that one automaton holds (but for a last shard's).
HEAD, MOST = 3, 8192
#: Different words that a task holds while it counts.
HELD = 300_000

#: Runs of A-Z (lowered), a-z and U+00C0 to U+00FF in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def counted(doc_id: bytes, text: bytes) -> Iterator[tuple[bytes, int]]:
    """Words of at least LEAST_LENGTH letters in a text, with their number there."""
    begin = zlib.crc32(doc_id + b":")
    for run, n in Counter(_RUN.findall(text.lower())).items():
        length = len(run) - run.count(b"\xc3")
        if length < LEAST_LENGTH:
            continue
        h = zlib.crc32(run, begin)
        if h % LOSES == 0:
            letters, at = run.decode(), h % length
            run, length = (letters[:at] + letters[at + 1 :]).encode(), length - 1
            if length < LEAST_LENGTH:
                continue
        yield run, n


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least so often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array(held.keys(), pa.binary()).cast(pa.string())
            made = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in counted(doc_id, text):
                    held[word] += n
                if len(held) > HELD:
                    yield flush()
        if held:
            yield flush()

    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary").alias("d"), F.col("text").cast("binary").alias("t"))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of ascending distinct words, with their numbers."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        #: Of each state: letter -> (next state, how many words come before those behind the edge).
        self.edges: list[dict[str, tuple[int, int]]] = []
        self._count: list[int] = []
        known: dict[tuple, int] = {}
        # The path of the word before, one open state for each of its letters: [is a word, edges].
        path: list[list] = [[False, []]]
        letters = ""

        def close(down_to: int) -> None:
            while len(path) > down_to:
                done = path.pop()
                letter = letters[len(path) - 1]
                path[-1][1].append((letter, self._state(known, done)))

        for word in words:
            same = 0
            for x, y in zip(letters, word, strict=False):
                if x != y:
                    break
                same += 1
            close(same + 1)
            letters = word
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
        close(1)
        self.root = self._state(known, path[0])

    def _state(self, known: dict[tuple, int], made: list) -> int:
        """The state with these edges; states from which the same ends follow are one."""
        key = made[0], tuple(made[1])
        state = known.get(key)
        if state is None:
            state = known[key] = len(self.final)
            before, edges = int(made[0]), {}
            for letter, to in made[1]:
                edges[letter] = to, before
                before += self._count[to]
            self.final.append(made[0])
            self.edges.append(edges)
            self._count.append(before)
        return state

    def number(self, word: str, state: int | None = None, before: int = 0) -> int | None:
        """How many words come before this one, if it is one; from a state on, with what was counted up to it."""
        edges, state = self.edges, self.root if state is None else state
        for letter in word:
            step = edges[state].get(letter)
            if step is None:
                return None
            state = step[0]
            before += step[1]
        return before if self.final[state] else None

    def near(self, word: str, exact: int, length: int = 0) -> set[int]:
        """Numbers of the words that begin with the first `exact` letters of word and differ by one error behind them.

        length: only words of that many letters, if given.
        """
        edges, number, found = self.edges, self.number, set()
        n = len(word)
        replace, insert, delete = (not length or length == n + more for more in (0, 1, -1))
        state, before = self.root, 0
        for at in range(n + 1):
            if at >= exact:
                letter, rest, behind = word[at : at + 1], word[at:], word[at + 1 :]
                if delete and letter:
                    found.add(number(behind, state, before))
                if insert or replace:
                    for other, (to, more) in edges[state].items():
                        if replace and letter and other != letter:
                            found.add(number(behind, to, before + more))
                        if insert:
                            found.add(number(rest, to, before + more))
            if at < n:
                step = edges[state].get(word[at])
                if step is None:
                    break
                state = step[0]
                before += step[1]
        found.discard(None)
        return found


#: Rows of shards. letters: from the end if backward. filed: whether near words are looked for among it. asks: the length
#: of the words that it asks for (0: any, -1: none). part: of a shard divided by the rest, FIRST or LAST; what the first
#: half of the rest finds is none of the last half's.
_ROWS = ("shard", "backward", "letters", "n", "filed", "asks", "part")
WHOLE, FIRST, LAST = 0, 1, 2
FOUND = "word string, n long, n_near long, near string, near_n long"


def _half(length):
    """Letters at one end that a word of this length shares with all near words which its half, or rest, there finds; a number or a column."""
    return F.greatest(F.lit(HEAD), F.floor((length - 1) / 2)).cast("int") if isinstance(length, Column) else max(HEAD, (length - 1) // 2)


def _answers(rows: pd.DataFrame, pairs: bool) -> Iterator[tuple]:
    """Rows of FOUND for those of one direction's shards that ask: one each (how many are near, and the best), or one for each pair."""
    filed = rows[rows["filed"]].drop_duplicates("letters").sort_values("letters")
    words, counts = filed["letters"].tolist(), filed["n"].tolist()  # in the automaton's order: that of code points
    near, asking = Automaton(words).near, rows[rows["asks"] >= 0]
    for backward, letters, n, asks, part in zip(*(asking[c].tolist() for c in ("backward", "letters", "n", "asks", "part")), strict=True):
        size = len(letters)
        hits = near(letters, size - size // 2 if backward else size // 2, asks)
        if hits and backward:  # what shares the first half with the word is found forward
            first = letters[size - size // 2 :]
            hits = [i for i in hits if not words[i].endswith(first)]
        if hits and part != WHOLE:
            early = letters[: _half(asks) + (asks - _half(asks)) // 2]
            hits = [i for i in hits if words[i].startswith(early) == (part == FIRST)]
        turn = -1 if backward else 1
        if pairs:
            yield from ((letters[::turn], n, 1, words[i][::turn], counts[i]) for i in hits)
        elif hits:
            most = max(counts[i] for i in hits)
            yield letters[::turn], n, len(hits), min(words[i][::turn] for i in hits if counts[i] == most), most
        else:
            yield letters[::turn], n, 0, None, None


def _search(pairs: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def made(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for _, part in rows.groupby("backward"):
                yield pd.DataFrame(_answers(part, pairs), columns=["word", "n", "n_near", "near", "near_n"]).astype({"near_n": "Int64"})

        for frame in frames:
            held, size = [*held, frame], size + len(frame)
            if size < MOST:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows["shard"] == rows["shard"].iloc[-1]) & (rows["backward"] == rows["backward"].iloc[-1])
            cut = int((~last).sum())  # rows are sorted: the last shard may go on
            if cut:
                yield from made(rows.iloc[:cut])
            held, size = [rows.iloc[cut:]], len(rows) - cut
        if size:
            yield from made(pd.concat(held, ignore_index=True))

    return run


def _over(rows: DataFrame, most: int) -> DataFrame:
    """(big_shard, big_backward) of the shards with more filed words than most."""
    counts = rows.where("filed").groupBy("shard", "backward").agg(F.count(F.lit(1)).alias("filed_words")).where(F.col("filed_words") > most)
    return counts.select(F.col("shard").alias("big_shard"), F.col("backward").alias("big_backward"))


def _parted(rows: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other shards, rows of big ones)."""
    same = (F.col("shard") == F.col("big_shard")) & (F.col("backward") == F.col("big_backward"))
    return rows.join(big, same, "left_anti"), rows.join(big, same, "left_semi")


def _by_length(rows: DataFrame) -> DataFrame:
    """Rows of whole shards dealt anew: filed by their length and shared half, asking for three lengths."""
    size = F.length("letters")
    name = lambda length: F.concat_ws(":", length.cast("string"), F.substring(F.col("letters"), F.lit(1), _half(length)))
    part = lambda shard, filed, asks: F.struct(shard.alias("shard"), F.lit(filed).alias("filed"), asks.cast("int").alias("asks"))
    parts = F.array(part(name(size), True, F.lit(-1)), *[part(name(size + more), False, size + more) for more in (-1, 0, 1)])
    return rows.select("backward", "letters", "n", "part", F.inline(parts)).where(F.col("filed") | (F.col("asks") >= LEAST_LENGTH)).select(*_ROWS)


def _by_rest(rows: DataFrame) -> DataFrame:
    """Rows of shards by length dealt anew, twice each: by the first and by the last half of the rest."""
    length = F.when(F.col("filed"), F.length("letters")).otherwise(F.col("asks"))
    half = _half(length)
    more = F.floor((length - half) / 2).cast("int")
    part = lambda k, letters: F.struct(F.concat_ws(":", length.cast("string"), F.lit(str(k)), letters).alias("shard"), F.lit(k).alias("part"))
    letters = F.col("letters")
    begin = part(FIRST, F.substring(letters, F.lit(1), half + more))
    end = part(LAST, F.concat(F.substring(letters, F.lit(1), half), F.lit(":"), F.substring(letters, F.length(letters) - more + 1, more)))
    return rows.select("backward", "letters", "n", "filed", "asks", F.inline(F.array(begin, end))).select(*_ROWS)


def _found(words: DataFrame, pairs: bool, most: int) -> DataFrame:
    turned = F.inline(F.array(*[F.struct(F.lit(b).alias("backward"), (F.reverse("word") if b else F.col("word")).alias("letters")) for b in (False, True)]))
    rows = words.select("word", "n", turned).select(
        F.substring("letters", 1, HEAD).alias("shard"), "backward", "letters", "n", F.lit(True).alias("filed"), F.lit(0).alias("asks"), F.lit(WHOLE).alias("part")
    )
    # Of HEAD letters out of 90 there are 729,000 names: what is over `most` of them, both ways, is safe to broadcast.
    small, large = _parted(rows, F.broadcast(common.materialize(_over(rows, most), "spelling-over")))
    by_length = common.materialize(_by_length(large), "spelling-lengths")
    fits, over = _parted(by_length, common.materialize(_over(by_length, most), "spelling-over"))
    dealt = small.unionByName(fits).unionByName(_by_rest(over))
    return dealt.repartition("backward", "shard").sortWithinPartitions("backward", "shard", "letters").mapInPandas(_search(pairs), FOUND)


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs at one inserted, deleted or replaced letter; words: distinct (word, n) of a written table."""
    return _found(words, True, most).select("word", "n", "near", "near_n")


def forms(words: DataFrame, times: int = TIMES, most: int = MOST) -> DataFrame:
    """word, n, n_near, form and form_n of every word of a written table of distinct (word, n)."""
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    joined = _found(words, False, most).groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    fits = -F.col("best.less") >= times * F.col("n")
    return joined.select("word", "n", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """found (a written table) with root: where following forms ends.

    A form is `times` as frequent as its word, so chains are as short as the logarithm of the counts; each round doubles what is followed.
    """
    now = common.materialize(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = now.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        joined = now.join(next_, F.col("root") == F.col("via"), "left")
        if joined.where(F.col("via").isNotNull()).isEmpty():
            break
        now = common.materialize(joined.select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
    return found.join(now, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs."""
    words = common.materialize(vocabulary(docs), "spelling-words")
    return with_roots(common.materialize(forms(words), "spelling-forms")).select("word", "form", "root", "n", "n_near", "form_n")
