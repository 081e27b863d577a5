"""Best-fit packing with swap-based local search.

Documents become token pieces of at most CAPACITY ids. Each task packs the pieces it
has tokenised, in batches of bounded size: best fit in decreasing order, then local
search between all underfull bins. The search moves a piece, or exchanges one piece
for one or for two, whenever that increases the sum of squared fills, which drains
the emptier bins until some are empty. The lengths of all bins' pieces, and the sums of
their pairs, stand in trees of bit sets, so the best step over all bins and pieces is a
few shifts away and none is left out. What a batch leaves in underfull bins is few
pieces; they meet those of other batches in a second, shuffled round.

Only numbers are shuffled, never texts. Defined results: null or empty text is one
piece, the end id alone; each repeated row gets its own pieces; null doc_ids stay null.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tidemark.llm import common

CAPACITY, END_ID = 4096, 1
#: Pieces that one packing batch holds at most.
BATCH = 32_768
#: A bin this full or fuller is not opened again in the second round.
CLOSED = CAPACITY - 4
#: Distinct words that a worker remembers.
REMEMBERED = 200_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"

#: Texts of these characters, or of printable ASCII and line feeds, take the word-by-word path; others go through the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r -~¡-įı-ſ‐-‧‰-⁞€]*")


class WordTokenizer:
    """Ids as the tokenizer file gives them, remembering words between blanks.

    Its rules never join characters across white space and lower-case them one by
    one, so a text's ids are those of its blank-separated words in order, and a word's
    are those of the parts that the file's own pattern splits it into. Texts that hold a
    control token, in just its letters, are the tokenizer's own matter. Each part's ids
    end with one that closes a word.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)  # of control strings in a text it makes control ids
        rules = json.loads(self.whole.to_str())
        control = sorted((t["content"] for t in rules["added_tokens"]), key=len, reverse=True)
        self.control = re.compile("|".join(map(re.escape, control)) or r"(?!)").search
        self.mark = commonprefix(control)  # what a text holds at least, to hold one of them
        split = next(r for r in rules["pre_tokenizer"]["pretokenizers"] if r["type"] == "Split")
        # For parts that are normal and split already: the same model behind a split at blanks.
        rules["normalizer"] = None
        rules["pre_tokenizer"]["pretokenizers"] = [{"type": "WhitespaceSplit"} if r is split else r for r in rules["pre_tokenizer"]["pretokenizers"]]
        self.ready = Tokenizer.from_str(json.dumps(rules))
        self.ready.encode_special_tokens = True
        self.parts = regex.compile(split["pattern"]["Regex"]).findall
        suffix = rules["model"]["end_of_word_suffix"]
        self.closes = np.zeros(max(rules["model"]["vocab"].values()) + 1, bool)
        self.closes[[i for token, i in rules["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def _learn_parts(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            ids = np.array(self.ready.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(some):  # a part that is not closed by one id: each is asked for alone
                # A part that reads like a control token does so only since it was lowered: it is plain.
                self.whole.encode_special_tokens = True
                for part in some:
                    self.known_parts[part] = np.array(self.whole.encode(part, add_special_tokens=False).ids, dtype="<u4").tobytes()
                self.whole.encode_special_tokens = False
                continue
            data, low = ids.tobytes(), 0
            for part, high in zip(some, (ends * 4).tolist(), strict=True):
                self.known_parts[part] = data[low:high]
                low = high

    def _learn(self, new: set[str]) -> None:
        parts = self.parts
        split = {
            word: [word] if word.isalpha() else [word[:-1], word[-1]] if word[-1] in ",." and word[:-1].isalpha() else parts(word) for word in new
        }
        known = self.known_parts
        self._learn_parts(list({p for own in split.values() for p in own}.difference(known)))
        for word, own in split.items():
            self.known[word] = known[own[0]] if len(own) == 1 else b"".join([known[p] for p in own])

    def forget(self) -> None:
        """Gives back the memory of what it remembers: the worker process goes on to other stages."""
        self.known, self.known_parts = {}, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for memory in (self.known, self.known_parts):
            if len(memory) > REMEMBERED:
                memory.clear()
        plain = lambda t: (t.replace("\n", " ").isprintable() if t.isascii() else _PLAIN.fullmatch(t)) and not (self.mark in t and self.control(t))
        split = [t.lower().split() if plain(t) else None for t in texts]
        known = self.known
        new = {w for words in split if words for w in words if w not in known}
        if new:
            self._learn(new)
        return [
            b"".join([known[w] for w in words])
            if words is not None
            else np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            for words, text in zip(split, texts, strict=True)
        ]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    return WordTokenizer(path)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers, by best fit in decreasing order of length.

    A whole number serves as the set of rooms in use, so the tightest bin is one shift away.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fit = rooms >> need
        if fit:
            room = need + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        room -= need
        by_room[room].append(at)
        rooms |= 1 << room
    return bins


class _Members:
    """A set of numbers for each place, as a whole number with a bit for each member, under a tree of their unions."""

    def __init__(self, places: int):
        self.wide = 1 << max(0, places - 1).bit_length()
        self.sets = [0] * (2 * self.wide)

    @property
    def all(self) -> int:
        return self.sets[1]

    def put(self, place: int, members: int) -> None:
        at = place + self.wide
        self.sets[at] = members
        while at > 1:
            at //= 2
            union = self.sets[2 * at] | self.sets[2 * at + 1]
            if union == self.sets[at]:
                break
            self.sets[at] = union

    def first(self, member: int) -> int:
        """The first place whose set holds a member of the union."""
        at = 1
        while at < self.wide:
            at *= 2
            at += not self.sets[at] >> member & 1
        return at - self.wide


def single_lengths(lengths: list[int]) -> int:
    members = 0
    for n in lengths:
        members |= 1 << n
    return members


def pair_lengths(lengths: list[int]) -> int:
    """The sums of every two pieces of one bin."""
    seen = sums = 0
    for n in lengths:
        sums |= seen << n
        seen |= 1 << n
    return sums


def best_step(own: list[int], singles: int, pairs: int, room: int) -> tuple[int, int, bool, int]:
    """(gain, length that comes, whether it is a pair, length that goes or 0): the largest gain up to room.

    own: the lengths in the bin that gains; singles and pairs: what the other bins have to give.
    """
    best = (0, 0, False, 0)
    for out in (0, *own):
        within = (2 << (out + room)) - 1
        two = (pairs & within).bit_length() - 1 if out else 0
        if two - out > best[0]:  # two for one
            best = (two - out, two, True, out)
        one = (singles & within).bit_length() - 1
        if one - out > best[0]:  # a move, or one for one
            best = (one - out, one, False, out)
        if best[0] == room:
            break
    return best


def _taken(size: list[int], members: list[int], total: int, pair: bool) -> list[int]:
    """The piece, or the two pieces, of a bin that make up a length."""
    known: dict[int, int] = {}
    for i in members:
        if not pair and size[i] == total:
            return [i]
        if pair and total - size[i] in known:
            return [known[total - size[i]], i]
        known[size[i]] = i
    raise AssertionError("no such pieces")


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Moves and exchanges between underfull bins that increase the sum of squared fills.

    All bins that are not full take part. In each pass the fullest bin that has not had its
    turn takes what fills it most from the emptier ones, again and again until it is full or
    nothing fills it further. It is the fuller of the two, so each step raises the sum of
    squares, and the search ends: with as few bins as the total length allows, or where no
    bin finds a step.
    """
    size = lengths.tolist()
    bins = [list(b) for b in bins]
    fill = [sum(size[i] for i in b) for b in bins]
    goal, used = -(-sum(size) // capacity), len(bins)
    moved = True
    while moved and used > goal:
        moved = False
        under = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity), key=lambda k: (fill[k], k))
        place = {k: i for i, k in enumerate(under)}
        singles, pairs = _Members(len(under)), _Members(len(under))

        def offer(k: int, members: list[int], place=place, singles=singles, pairs=pairs) -> None:
            own = [size[i] for i in members]
            singles.put(place[k], single_lengths(own))
            pairs.put(place[k], pair_lengths(own))

        for k in under:
            offer(k, bins[k])
        turns = [(-fill[k], k) for k in under]
        heapq.heapify(turns)
        while turns and used > goal:
            before, to = heapq.heappop(turns)
            if -before != fill[to] or not bins[to]:  # it has given since, and stands here again
                continue
            offer(to, [])
            while fill[to] < capacity:
                gain, total, pair, out = best_step(sorted({size[i] for i in bins[to]}), singles.all, pairs.all, capacity - fill[to])
                if not gain:
                    break
                source = under[(pairs if pair else singles).first(total)]
                goes = next((i for i in bins[to] if size[i] == out), None)
                for i in _taken(size, bins[source], total, pair):
                    bins[source].remove(i)
                    bins[to].append(i)
                if goes is not None:
                    bins[to].remove(goes)
                    bins[source].append(goes)
                fill[to] += gain
                fill[source] -= gain
                moved = True
                offer(source, bins[source])
                if bins[source]:
                    heapq.heappush(turns, (-fill[source], source))
                else:
                    used -= 1
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


def _packed(pieces: pd.DataFrame, first_bin: int) -> pd.DataFrame:
    """pieces with bin, offset and fill; bins are numbered from first_bin."""
    lengths = pieces["length"].to_numpy()
    bin_of, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, members in enumerate(pack(lengths)):
        own = lengths[members]
        bin_of[members] = first_bin + k
        offset[members] = np.cumsum(own) - own
        fill[members] = own.sum()
    return pieces.assign(bin=bin_of, offset=offset, fill=fill)


def _tokenise_and_pack(path: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).ids
        end = np.array([END_ID], dtype="<u4").tobytes()
        wide = CAPACITY * 4
        # Bin numbers are a task's own: its partition number stands in the upper bits.
        next_bin = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def flush() -> pd.DataFrame:
            nonlocal rows, next_bin
            made = _packed(pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]), next_bin)
            next_bin = int(made["bin"].max()) + 1
            rows = []
            return made.astype({"doc_id": "Int64"})

        for frame in frames:
            texts = ["" if t is None else t for t in frame["text"]]
            names = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
            for at in range(0, len(texts), 256):
                for doc_id, ids in zip(names[at : at + 256], encode(texts[at : at + 256]), strict=True):
                    ids += end
                    for piece, begin in enumerate(range(0, len(ids), wide)):
                        part = ids[begin : begin + wide]
                        rows.append((doc_id, piece, begin // 4, len(part) // 4, zlib.crc32(part)))
                if len(rows) >= BATCH:
                    yield flush()
        tokenizer(path).forget()
        if rows:
            yield flush()

    return run


def _repack(frame: pd.DataFrame) -> pd.DataFrame:
    batch = int(frame["batch"].iloc[0])
    made = _packed(frame.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], ignore_index=True), (1 << 62) + (batch << 32))
    return made[["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]].astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    with common.small_batches(docs.sparkSession, 500):
        first = common.materialize(docs.select("doc_id", "text").mapInPandas(_tokenise_and_pack(tokenizer_path), PIECE_SCHEMA), "packed")
    done, rest = first.where(F.col("fill") >= CLOSED), first.where(F.col("fill") < CLOSED)
    batches = max(1, -(-rest.count() // BATCH))
    # Batches are dealt by bin, not by row, so they stay near their bound whatever the keys are.
    dealt = rest.withColumn("batch", F.pmod(F.xxhash64("bin"), F.lit(batches)).cast("int"))
    again = dealt.groupBy("batch").applyInPandas(_repack, PIECE_SCHEMA)
    return done.unionByName(again).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )
