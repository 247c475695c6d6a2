"""Statistics of documents that the quality operators share, vectorised over a TextBatch."""

from __future__ import annotations

import numpy as np

from .textbatch import TextBatch, later_copy, repeated, salted

_BYTES = np.arange(256)


def byte_set(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode("ascii"))] = True
    return table


SYMBOLS = byte_set("#*$%&|<>")
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LOWER = (_BYTES >= 97) & (_BYTES <= 122)
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
WIDE_LEAD = _BYTES >= 0xC0  # first bytes of characters beyond ASCII
LETTER = UPPER | LOWER | WIDE_LEAD
PUNCTUATION = byte_set("!\"'(),-./:;?@[\\]^_`{}~")


def n_symbols(b: TextBatch) -> np.ndarray:
    return b.count_bytes(SYMBOLS)


def line_counts(b: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that are equal to an earlier one of the text."""
    starts, ends, owner, words = b.lines
    full = words > 0
    starts, ends, owner = starts[full], ends[full], owner[full]
    copies = later_copy(salted(b.hash_spans(starts, ends), owner))
    return np.bincount(owner, minlength=b.n), np.bincount(owner[copies], minlength=b.n)


def n_repeat_words(b: TextBatch, hashes: np.ndarray, size: int = 8) -> np.ndarray:
    """Words that lie in a window of `size` words found twice or more in their text."""
    starts, windows = b.windows(hashes, size)
    starts = starts[repeated(salted(windows, b.word_text[starts]))]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(b.word_text[covered], minlength=b.n)


def word_repetition(b: TextBatch, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different words of each text, and how often its most frequent word occurs."""
    keys, first, count = np.unique(salted(hashes, b.word_text), return_index=True, return_counts=True)
    owner = b.word_text[first]
    most = np.zeros(b.n, np.int64)
    np.maximum.at(most, owner, count)
    return np.bincount(owner, minlength=b.n), most


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def n_stuttered(b: TextBatch, hashes: np.ndarray) -> np.ndarray:
    """Words that are equal to the word before them in their text."""
    same = (hashes[1:] == hashes[:-1]) & (b.word_text[1:] == b.word_text[:-1])
    return np.bincount(b.word_text[1:][same], minlength=b.n)


#: Names of the columns of `statistics`.
STATISTICS = (
    "log_words", "mean_word", "symbols", "capitals", "letters", "digits", "punctuation", "wide", "lines_per_word",
    "repeated_lines", "repeated_windows", "different_words", "top_word", "stutter", "long_words", "spaces",
)


def statistics(b: TextBatch) -> np.ndarray:
    """One row of STATISTICS for each text, all finite; an empty text has zeros."""
    hashes = b.word_hashes()
    words, chars = b.n_words, b.word_chars
    different, most = word_repetition(b, hashes)
    lines, copies = line_counts(b)
    starts, ends = b._word_spans
    return np.column_stack([
        np.log1p(words),
        ratio(chars, words),
        ratio(n_symbols(b), chars),
        ratio(b.count_bytes(UPPER), b.count_bytes(LETTER)),
        ratio(b.count_bytes(LETTER), chars),
        ratio(b.count_bytes(DIGIT), chars),
        ratio(b.count_bytes(PUNCTUATION), chars),
        ratio(b.count_bytes(WIDE_LEAD), chars),
        ratio(lines, words),
        ratio(copies, lines),
        ratio(n_repeat_words(b, hashes), words),
        ratio(different, words),
        ratio(most, words),
        ratio(n_stuttered(b, hashes), words),
        ratio(np.bincount(b.word_text[ends - starts > 14], minlength=b.n), words),
        ratio(b.n_chars - chars, b.n_chars),
    ]).astype(np.float64)
