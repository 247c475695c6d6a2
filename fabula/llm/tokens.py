"""Token ids of whole texts, by way of their different words.

For a tokenizer that drops white space and never joins across it, the ids of a
text are those of its words in a row.  Each different word (of plain ones the letters,
whatever their case, and the punctuation after them) is encoded once in a worker and
kept, and texts are put together from these by array lookups.
"""

from __future__ import annotations

import codecs
import os
import string
from functools import cache

import numpy as np
import pyarrow as pa

from .textbatch import _LOWER, TextBatch

#: Units kept at a time (about 45 bytes each); beyond that all are forgotten and encoded anew when met.
MOST_WORDS = 800_000
#: Units encoded in one call.
AT_ONCE = 4096
#: Slots of the smallest table of units.
LEAST_SLOTS = 1 << 12

#: Letters of two bytes that begin with one of these are letters in every version of Unicode and composed already.
_LEADS = range(0xC3, 0xC9)
#: 0 for ASCII letters, 1 for ASCII punctuation, 2 for other bytes.
_KIND = np.array([0 if chr(i).isalpha() and i < 128 else 1 if 33 <= i < 127 and not chr(i).isdigit() else 2 for i in range(256)], np.uint8)


class WordTokenizer:
    """Ids by a `tokenizers` file whose normaliser and pre-tokeniser treat words one by one.

    A plain word, Latin letters with ASCII punctuation after them or without, is looked
    up as two units: the normaliser only lower-cases it, and its letters and its
    punctuation are pre-tokens of their own.  Any other word is one unit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # the characters that stand for bytes in the vocabulary
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [bytes([lead, after]).decode() for lead in _LEADS for after in range(0x80, 0xC0)]
        # a letter is plain if its lower case is one letter, and such a one too
        plain = {c for c in letters if c.isalpha() and c.lower().isalpha() and c.lower() in letters}
        self.plain = np.array([c in plain for c in letters])
        written = [" "] * 256
        for c in (*plain, *string.ascii_lowercase):
            for byte, char in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                written[byte] = char
        self.written = "".join(written)
        # the same model on letters that are normalised and written as bytes already
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.width = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self._forget()

    def _encode(self, units: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, those of plain letters first, and each unit's number of ids in that order."""
        ids, sizes = [], []
        letters = [units[i] for i in np.flatnonzero(plain)]
        for at in range(0, len(letters), AT_ONCE):
            some = codecs.charmap_decode(" ".join(letters[at : at + AT_ONCE]).lower().encode(), "strict", self.written)[0]
            found = np.array(self.model.encode_batch_fast([some], add_special_tokens=False)[0].ids, self.width)
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) != some.count(" ") + 1:  # a model that doesn't mark the ends of words
                each = [[t.id for t in self.tokenizer.model.tokenize(w)] for w in some.split(" ")]
                found, ends = np.array([i for x in each for i in x], self.width), np.cumsum([len(x) for x in each])
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        rest = [units[i] for i in np.flatnonzero(~plain)]
        for at in range(0, len(rest), AT_ONCE):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(rest[at : at + AT_ONCE], add_special_tokens=False)]
            ids.append(np.array([i for x in each for i in x], self.width))
            sizes.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _forget(self) -> None:
        self.keys = np.zeros(LEAST_SLOTS, np.uint64)  # hashes of known units where they lie, else 0
        self.place = np.zeros(LEAST_SLOTS, np.int32)
        self.known = 0
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, self.width)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or the empty one where it would lie."""
        last = len(self.keys) - 1
        slots = (hashes & np.uint64(last)).astype(np.int64)
        there = self.keys[slots]
        left = np.flatnonzero((there != hashes) & (there != 0))
        while len(left):
            at = slots[left] = (slots[left] + 1) & last
            there = self.keys[at]
            left = left[(there != hashes[left]) & (there != 0)]
        return slots

    def _put(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Different hashes that aren't known."""
        while len(hashes):
            slots = self._find(hashes)
            self.keys[slots] = hashes  # one of those that want the same slot gets it
            done = self.keys[slots] == hashes
            self.place[slots[done]] = places[done]
            hashes, places = hashes[~done], places[~done]

    def _learn(self, hashes: np.ndarray, units: list[str], plain: np.ndarray) -> None:
        ids, sizes = self._encode(units, plain)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        places = np.empty(len(hashes), np.int32)
        places[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(self.known, self.known + len(hashes))
        self.known += len(hashes)
        if 2 * self.known > len(self.keys):
            slots = np.flatnonzero(self.keys)
            keys, before = self.keys[slots], self.place[slots]
            size = 1 << (2 * self.known).bit_length()
            self.keys, self.place = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(keys, before)
        self._put(hashes, places)

    def _units(self, b: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, hashes and whether they are plain letters of all units, and n + 1 bounds of the texts in them."""
        starts, ends = b._word_spans
        data = b.data
        kind = _KIND[data]
        lead = np.flatnonzero((data >= _LEADS[0]) & (data <= _LEADS[-1]))
        after = data[np.minimum(lead + 1, len(data) - 1)]
        good = lead[((after & 0xC0) == 0x80) & self.plain[(data[lead].astype(np.int64) - _LEADS[0]) * 64 + (after & 63)]]
        kind[good] = kind[good + 1] = 0
        stops = np.flatnonzero(kind)
        rank = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind != 0, out=rank[1:])
        before, upto = rank[starts], rank[ends]
        core = np.minimum(np.append(stops, len(data))[before], ends)
        # letters that nothing but punctuation follows
        others = np.concatenate([[0], np.cumsum(kind[stops] > 1)])
        plain = (core > starts) & (upto - before == ends - core) & (others[upto] == others[before])
        # not a letter whose bytes two texts have
        plain &= (data[ends - 1] < 0xC0) & ((data[starts] & 0xC0) != 0x80)
        core = np.where(plain, core, ends)
        tail = core < ends
        # capitals of plain words are lower-cased, of others they aren't
        folded = _LOWER[data]
        capitals = np.flatnonzero(folded != data)
        capitals = capitals[~plain[np.searchsorted(starts, capitals, side="right") - 1]]
        folded[capitals] = data[capitals]
        # a plain word's punctuation comes after its letters
        upto = np.concatenate([[0], np.cumsum(tail)])
        word = np.arange(len(starts)) + upto[:-1]
        first, last = np.empty((2, len(starts) + int(upto[-1])), np.int64)
        letters = np.zeros(len(first), bool)
        first[word], last[word], letters[word] = starts, core, plain
        first[word[tail] + 1], last[word[tail] + 1] = core[tail], ends[tail]
        hashes = np.maximum(TextBatch(folded, b.bounds).hash_spans(first, last), 1)
        return first, last, hashes, letters, b.word_bounds + upto[b.word_bounds]

    def encode(self, b: TextBatch) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and n + 1 bounds of the texts in them."""
        starts, ends, hashes, letters, bounds = self._units(b)
        if not len(hashes):
            return np.zeros(0, self.width), np.zeros(b.n + 1, np.int64)
        slots = self._find(hashes)
        missing = np.flatnonzero(self.keys[slots] == 0)
        if len(missing):
            # what is new is learnt; had there been no room, all of this batch is
            new, first = np.unique(hashes[missing], return_index=True)
            if self.known + len(new) > MOST_WORDS:
                self._forget()
                missing = np.arange(len(hashes))
                new, first = np.unique(hashes, return_index=True)
            some = missing[first]
            data = b.data.tobytes()
            self._learn(new, [data[i:j].decode("utf-8", "replace") for i, j in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], letters[some])
            slots = self._find(hashes)
        known = self.place[slots]
        sizes = self.starts[known + 1] - self.starts[known]
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = np.arange(upto[-1]) - np.repeat(upto[:-1] - self.starts[known], sizes)
        return self.ids[at], upto[bounds]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that its words serve all of the worker's tasks."""
    return WordTokenizer(path)


def ragged(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values, one for each pair of bounds."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
