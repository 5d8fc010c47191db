"""Counts over whole texts that the quality operators share, made with numpy in Arrow batches.

Words are runs of bytes that are no ASCII white space.  Equality of words, windows and lines is
equality of 64-bit keys of their bytes.  A null text has no words; nothing here looks at any
column but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chatprep.llm.common import configure, documents, groups
from chatprep.llm.textscan import BLACK, keys, per_document, words

_ODD = np.uint64(0x9FB21C651E98DF25)
_SALT = np.uint64(0x9E3779B97F4A7C15)

# Classes of bytes; each byte has one.
SPACE, BREAK, LOWER, UPPER, DIGIT, SYMBOL, SHOUT, STOP, OTHER, LEAD, FOLLOW = range(11)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = SPACE
_CLASS[10] = BREAK
_CLASS[97:123] = LOWER
_CLASS[65:91] = UPPER
_CLASS[48:58] = DIGIT
_CLASS[[ord(c) for c in "#*$%&|<>"]] = SYMBOL
_CLASS[[ord(c) for c in "!?"]] = SHOUT
_CLASS[[ord(c) for c in ".,;:"]] = STOP
_CLASS[192:] = LEAD
_CLASS[128:192] = FOLLOW

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words",
    "word_length",
    "repeat_share",
    "symbols_per_word",
    "dup_line_share",
    "distinct_share",
    "upper_share",
    "shouts_per_word",
    "stops_per_word",
    "digit_share",
    "words_per_line",
    "beyond_ascii_share",
]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts (long) and ``features`` (array of doubles, as in ``FEATURES``)."""
    configure(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, borders in groups(batch.column("text")):
                counts, features = measure(data, borders)
                flat = pa.array(features.ravel())
                edges = pa.array(np.arange(high - low + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[low:high], *(pa.array(c) for c in counts), pa.ListArray.from_arrays(edges, flat)],
                    ["doc_id", *COUNTS, "features"],
                )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>"
    return documents(docs, id_col, text_col).mapInArrow(make, schema)


def measure(data: np.ndarray, borders: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The counts and the feature rows of the documents in a byte array."""
    n = len(borders) - 1
    salt = np.arange(1, n + 1, dtype=np.uint64) * _SALT
    of_byte = np.repeat(np.arange(n), np.diff(borders)) << 4
    classes = np.bincount(of_byte + _CLASS[data], minlength=16 * n).reshape(n, 16)
    starts, ends = words(data, borders, BLACK)
    edges = per_document(starts, borders)
    n_words = np.diff(edges)
    of_word = np.repeat(np.arange(n), n_words)
    key = keys(data, starts, ends)
    distinct = np.bincount(of_word[np.unique(key + salt[of_word], return_index=True)[1]], minlength=n)
    repeat = np.bincount(of_word[_repeated(key, of_word, salt)], minlength=n)
    n_lines, dup = _lines(data, borders, starts, salt)
    chars = classes[:, LOWER:FOLLOW].sum(1)
    letters = classes[:, LOWER] + classes[:, UPPER]
    counts = [n_words, chars, np.diff(np.concatenate([[0], np.cumsum(_SIGN[data])])[borders]), dup, repeat]
    word, line, char = np.maximum(n_words, 1), np.maximum(n_lines, 1), np.maximum(chars, 1)
    features = np.column_stack(
        [
            np.log1p(n_words),
            chars / word,
            repeat / word,
            classes[:, SYMBOL] / word,
            dup / line,
            distinct / word,
            classes[:, UPPER] / np.maximum(letters, 1),
            classes[:, SHOUT] / word,
            classes[:, STOP] / word,
            classes[:, DIGIT] / char,
            n_words / line,
            classes[:, LEAD] / char,
        ]
    ).astype(np.float64)
    return [c.astype(np.int64) for c in counts], features


_SIGN = np.zeros(256, np.int64)
_SIGN[[ord(c) for c in "#*$%&|<>"]] = 1


def _repeated(key: np.ndarray, of: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """For each word, whether a 3-word window around it stands twice or more in its document."""
    held = np.zeros(len(key), bool)
    if len(key) < 3:
        return held
    window = ((key[:-2] * _ODD + key[1:-1]) * _ODD ^ key[2:] * _SALT) + salt[of[:-2]]
    inside = np.flatnonzero(of[:-2] == of[2:])
    order = inside[np.argsort(window[inside])]
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    at = order[again]
    held[at] = held[at + 1] = held[at + 2] = True
    return held


def _lines(data: np.ndarray, borders: np.ndarray, starts: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier line, per document."""
    n = len(borders) - 1
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([borders[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    if not len(begin):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    end = np.append(begin[1:], len(data))
    end = end - (data[end - 1] == 10)
    held = np.diff(np.append(np.searchsorted(starts, begin), len(starts))) > 0
    begin, end = begin[held], end[held]
    of = np.searchsorted(borders, begin, "right") - 1
    first = np.unique(keys(data, begin, end) + salt[of], return_index=True)[1]
    lines = np.bincount(of, minlength=n)
    return lines, lines - np.bincount(of[first], minlength=n)
