"""BPE by dynamic programming over prefixes, exact, and decoding back.

A part of a text (what the tokenizer file's rules split off) is read once by an automaton
over all tokens, which tells at each place the tokens that are suffixes of the prefix
ending there. The encoding of a prefix ends with exactly one of them: the one that stands
next to the last token of the prefix before it, as `stands` tests on the pair alone.
That token is stored for every prefix, and the ids of the part follow back from its end.
The work is linear in the part's length times the tokens that end at a place, whatever
order the merges take.

Why a pair suffices: merges run in order of rank, the leftmost first. Pieces at the border
of two tokens change at known times: a piece is there from the merge that makes it
until the one that takes it into the token. Only a merge across the border, of two pieces
that are there at one time and of a rank that comes before both are taken, would undo the pair.

Normalising and splitting are the file's own steps; control tokens that stand in a text
are ids of their own, as the library has it. Words between blanks are remembered, at most
REMEMBERED of them in a worker; long ones never.

Defined results: null and empty texts have no ids and decode to the empty text; a null
array decodes to null; every row is encoded alone, so repeated rows and clashing columns
change nothing.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words and pairs that a worker remembers, and the longest word that it does.
REMEMBERED, PAIRS, LONGEST = 600_000, 1_000_000, 64

#: Non-ASCII characters that normalise and lower one by one, and split as their own words do.
_PLAIN = re.compile(r"[\t\n\r -~¡-įı-ſ‐-‧‰-⁞€]*")


def is_plain(text: str) -> bool:
    """Whether a text may be cut at blanks and lowered at once, with the result of the file's rules."""
    if text.isascii():
        return text.replace("\n", " ").isprintable()
    return _PLAIN.fullmatch(text) is not None


def byte_letters() -> str:
    """The 256 characters that byte-level vocabularies write bytes with: visible ones as themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in own else chr(next(rest)) for b in range(256))


class Merges:
    """Merge rules as times: what each token is made of, and whether two tokens can stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            whole, left, right = vocab.get(a + b), vocab[a], vocab[b]
            if whole is None or whole in self.made:
                raise ValueError("every merge must make one token of its own")
            self.rank[left << 32 | right] = self.made[whole] = rank
            self.halves[whole] = left, right
        if any(self.made.get(part, -1) >= self.made[whole] for whole, parts in self.halves.items() for part in parts):
            raise ValueError("a merge must come after those that make its parts")
        self.never = len(merges)
        self.known: dict[int, bool] = {}
        self._spines: tuple[dict[int, list], dict[int, list]] = {}, {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces that stand at one end of a token while it is made, each with the rank of the merge that takes it."""
        found = self._spines[side].get(token)
        if found is None:
            found, piece, taken = [], token, self.never
            while True:
                found.append((piece, taken))
                if piece not in self.halves:
                    break
                taken = self.made[piece]
                piece = self.halves[piece][side]
            self._spines[side][token] = found
        return found

    def crossed(self, left: int, right: int, before: int) -> bool:
        """Whether a merge across the border of two tokens comes first, among the ranks below `before`."""
        rank, beside = self.rank, self._spine(right, 0)
        for a, a_taken in self._spine(left, 1):
            a <<= 32
            for b, b_taken in beside:
                at = rank.get(a | b)
                # Of two merges of one rank the left one is first: the border's against the right token's, not against the left's.
                if at is not None and at < before and at < a_taken and at <= b_taken:
                    return True
        return False

    def stands(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their letters, if each is that of its own."""
        return not self.crossed(left, right, self.never)

    def reachable(self, token: int) -> bool:
        """Whether the token's own letters come to this one token."""
        halves = self.halves.get(token)
        return halves is None or (self.reachable(halves[0]) and self.reachable(halves[1]) and not self.crossed(*halves, self.made[token]))


class Suffixes:
    """An automaton that knows, after each letter read, the tokens that the letters read so far end with."""

    def __init__(self, tokens: dict[str, int]):
        self.edges: list[dict[str, int]] = [{}]
        #: Of each state: (token, letters of it), the longest first.
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.back = [0]  # the state of the longest other suffix that some token begins with
        own: dict[int, tuple[int, int]] = {}
        for name, token in tokens.items():
            state = 0
            for letter in name:
                to = self.edges[state].get(letter)
                if to is None:
                    to = self.edges[state][letter] = len(self.edges)
                    self.edges.append({})
                    self.ends.append(())
                    self.back.append(0)
                state = to
            own[state] = token, len(name)
        level = [(0, letter, to) for letter, to in self.edges[0].items()]
        while level:
            below = []
            for state, letter, to in level:
                below += [(to, x, y) for x, y in self.edges[to].items()]
                back = self.back[state]
                while back and letter not in self.edges[back]:
                    back = self.back[back]
                other = self.edges[back].get(letter, 0)
                self.back[to] = other if other != to else 0
                self.ends[to] = ((own[to],) if to in own else ()) + self.ends[self.back[to]]
            level = below

    def step(self, state: int, letter: str) -> int:
        """Where a letter leads from a state without an edge for it, which is added."""
        back = state
        while back and letter not in self.edges[back]:
            back = self.back[back]
        to = self.edges[state][letter] = self.edges[back].get(letter, 0)
        return to


class PrefixBpe:
    """A tokenizer file of kind BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)  # its normaliser and splitter only
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model = rules["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(self.vocab, merges)
        self.control = {t["content"]: t["id"] for t in rules["added_tokens"]}
        control = sorted(self.control, key=len, reverse=True)
        self.control_pattern = re.compile("(" + ("|".join(map(re.escape, control)) or r"(?!)") + ")")
        self.mark = commonprefix(control)  # what a text holds at least, to hold one of them
        self.names = [""] * (1 + max([*self.vocab.values(), *self.control.values()]))
        for name, i in (self.vocab | self.control).items():
            self.names[i] = name
        letters = byte_letters()
        # A part's last letter, with the word's end, is a letter of its own to the automaton.
        self.last_letter = {c: chr(0x1000 + ord(c)) for c in letters} if self.suffix else {}
        self.byte_letter = {b: c for b, c in enumerate(letters)}
        split = next((p for p in rules["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"), None)
        import regex

        self.parts = regex.compile(split["pattern"]["Regex"]).findall
        tokens = {}
        for name, i in self.vocab.items():
            if self.suffix and name.endswith(self.suffix):
                bare = name[: -len(self.suffix)]
                if not bare:
                    continue
                name = bare[:-1] + self.last_letter[bare[-1]]
            if self.merges.reachable(i):
                tokens[name] = i
        self.suffixes = Suffixes(tokens)
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    def part_ids(self, letters: str) -> bytes:
        """Ids, as 32-bit numbers, of one part in byte letters."""
        if self.suffix:
            letters = letters[:-1] + self.last_letter[letters[-1]]
        known, stands = self.merges.known, self.merges.stands
        if len(known) > PAIRS:
            known.clear()
        edges, ends, step = self.suffixes.edges, self.suffixes.ends, self.suffixes.step
        token: list[int] = []  # of every prefix its last token,
        begin: list[int] = []  # and where that begins
        state = have = 0
        for have, letter in enumerate(letters, 1):
            to = edges[state].get(letter)
            state = step(state, letter) if to is None else to
            for i, length in ends[state]:
                start = have - length
                if start:
                    pair = token[start - 1] << 32 | i
                    fits = known.get(pair)
                    if fits is None:
                        fits = known[pair] = stands(token[start - 1], i)
                    if not fits:
                        continue
                token.append(i)
                begin.append(start)
                break
        ids = []
        while have:
            ids.append(token[have - 1])
            have = begin[have - 1]
        return array("i", ids[::-1]).tobytes()

    def _part(self, letters: str) -> bytes:
        ids = self.known_parts.get(letters)
        if ids is None:
            ids = self.part_ids(letters)
            if len(letters) <= LONGEST:
                self.known_parts[letters] = ids
        return ids

    def letters(self, part: str) -> str:
        return part.encode().decode("latin-1").translate(self.byte_letter)

    def _word(self, word: str) -> bytes:
        """Ids of a word of a plain text."""
        if word.isalpha():
            ids = self.part_ids(word if word.isascii() else self.letters(word))
        else:
            parts = [word[:-1], word[-1]] if word[:-1].isalpha() else self.parts(word)
            known = self.known
            ids = b"".join([known.get(p) or self._word(p) if p.isalpha() else self._part(p if p.isascii() else self.letters(p)) for p in parts])
        if len(word) <= LONGEST:
            self.known[word] = ids
        return ids

    def _segment(self, text: str) -> bytes:
        """Ids of any text without control tokens."""
        if not text:
            return b""
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return b"".join([self._part(p) for p, _ in split])

    def ids(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.known_parts) > REMEMBERED:
            self.known_parts.clear()
        if self.mark in text and self.control_pattern.search(text):
            pieces = self.control_pattern.split(text)
            return b"".join([array("i", [self.control[p]]).tobytes() if k % 2 else self._segment(p) for k, p in enumerate(pieces)])
        if not is_plain(text):
            return self._segment(text)
        known, words = self.known, text.lower().split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known.get(w) or self._word(w) for w in words])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PrefixBpe:
    """One for each worker process."""
    return PrefixBpe(path)


@lru_cache(maxsize=2)
def _names(path: str) -> np.ndarray:
    return np.array(tokenizer(path).names, object)


def as_lists(parts: list[bytes]) -> pa.Array:
    """Arrays of 32-bit numbers as an Arrow array of lists."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode_column(text: Column, path: str) -> Column:
    """The ids of each text (array<int>) as the tokenizer file gives them, without added tokens of a post-processor."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        of = tokenizer(path).ids
        return as_lists([of(t) if t else b"" for t in texts.to_pylist()])

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of each array of ids. A file without a decoder joins the tokens' names with blanks, as the library does."""

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        names, out = _names(path), []
        flat = lists.values.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        for k, valid in enumerate(lists.is_valid().to_pylist()):
            out.append(" ".join(names[flat[offsets[k] : offsets[k + 1]]].tolist()) if valid else None)
        return pa.array(out, pa.string())

    return decode(ids)
