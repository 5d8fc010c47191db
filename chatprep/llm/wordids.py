"""Token ids of whole texts, with each distinct unit of text encoded once per worker.

A unit is a stretch of text that the tokenizer's own rules keep apart from its neighbours, so
the ids of a text are those of its units put together:

* Byte-level BPE (split at ``... ?\\p{L}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``): a piece that
  holds a character which is not white space ends before the next white space, and a piece that
  holds a letter ends before a punctuation mark.
* Lower-casing BPE with word ends: white space only separates, and letters never share a piece
  with punctuation.

Units start at ASCII white space and punctuation, so that composition of characters cannot reach
over a border.  Texts with other kinds of white space, texts that hold the content of an added
token (such as ``<|endoftext|>``, which gets its one id), and tokenizers of any other make, are
encoded whole.  The tokenizers library does all encoding: its model takes a unit that is one
run of letters at once, its whole pipeline, with its default settings, takes the others.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side

import numpy as np
from tokenizers import Tokenizer

from chatprep.llm.textscan import LOWER, SHORT, keys

SLOTS = 19  # a worker remembers up to 2 ** 19 units, each at the place its key names
KEPT_IDS = 1 << 22  # beyond so many ids the memory starts anew

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_FOLDED = LOWER.copy()
_FOLDED[_SPACE] = 32
# First bytes, and whole encodings, of white space beyond ASCII and of controls
# that libraries class differently.
_ODD_FIRST = np.zeros(256, bool)
_ODD_FIRST[[28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD = [chr(c).encode() for c in (28, 29, 30, 31, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

# How byte-level models write bytes: printable ones as they are, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: b for b in _PRINTED}
_SHOWN |= {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _kind(tokenizer: Tokenizer) -> str:
    """Which of the rules above holds, read off the parts of the tokenizer."""
    before, normal = repr(tokenizer.pre_tokenizer), repr(tokenizer.normalizer)
    if before.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in before:
        return "bytes" if normal == "None" else "plain"
    words = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in before and before.count("Split(") == 1
    folds = normal.startswith("Sequence(normalizers=[NFC(), Replace(pattern=Regex(") and normal.endswith("Lowercase()])")
    fixed = all(t.content.isascii() and not t.normalized for t in tokenizer.get_added_tokens_decoder().values())
    return "words" if words and folds and normal.count("(") == 5 and fixed else "plain"


class WordIds:
    """A tokenizer with a memory of units; ``of(path)`` gives the one of this process."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = _kind(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.spelt = [x for x in self.added if x.lstrip(" ").isalpha()]  # may be, or lie in, a run of letters
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(1 << SLOTS, np.uint64)
        self.first = np.zeros(1 << SLOTS, np.int32)
        self.count = np.zeros(1 << SLOTS, np.int32)
        self.ids = np.zeros(1 << 19, np.uint32)
        self.used = 0

    @staticmethod
    @lru_cache(maxsize=4)
    def of(path: str) -> WordIds:
        return WordIds(path)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model, words = self.tokenizer.model, self.kind == "words"
        made: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            letters = text[1:] if text[:1] == " " else text
            if self.kind != "plain" and letters.isalpha() and not any(x in text for x in self.spelt):
                if words:
                    text = letters if letters.isascii() else unicodedata.normalize("NFC", letters)
                    if text.lower() != text or not text.isalpha():
                        rest.append(i)
                        continue
                made[i] = [x.id for x in model.tokenize(text.encode().decode("latin-1").translate(_SHOWN))]
            else:
                rest.append(i)
        whole = self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
        for i, one in zip(rest, whole, strict=True):
            made[i] = one.ids
        counts = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(counts.sum())), counts

    def _units(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        space, start = _SPACE[data], np.zeros(len(data), bool)
        start[1:] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
        cuts = borders[:-1]
        start[cuts[cuts < len(data)]] = True
        return np.flatnonzero(start)

    def encode(self, data: np.ndarray, borders: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each document, each followed by ``end``, and the borders of the documents."""
        whole = self._whole(data, borders)
        if self.kind == "words":  # whole texts stay as they are: their added tokens know upper case
            folded = _FOLDED[data]
            data = np.where(np.repeat(whole, np.diff(borders)), data, folded) if whole.any() else folded
        starts = self._units(data, borders)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        if whole.any():  # one unit for the whole text
            of = np.searchsorted(borders, starts, "right") - 1
            keep = ~whole[of] | (starts == borders[of])
            starts = starts[keep]
            ends = np.append(starts[1:], len(data))
        ids, counts = self._of_units(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(counts)])
        unit = np.searchsorted(starts, borders)
        unit[-1] = len(starts)
        inner = total[unit]
        documents = np.arange(len(borders))
        out = np.full(len(ids) + len(borders) - 1, end, np.uint32)
        out[np.arange(len(ids)) + np.repeat(documents[:-1], np.diff(inner))] = ids
        return out, inner + documents

    def _whole(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The documents that must not be cut."""
        n = len(borders) - 1
        if self.kind == "plain":
            return np.ones(n, bool)
        out = self._marked(data, borders)
        if self.kind == "words":
            return out
        at = np.flatnonzero(_ODD_FIRST[data])
        code = data[at].astype(np.int64)
        second = np.where(at + 1 < len(data), data[np.minimum(at + 1, len(data) - 1)], 0)
        third = np.where(at + 2 < len(data), data[np.minimum(at + 2, len(data) - 1)], 0)
        odd = np.zeros(len(at), bool)
        for form in _ODD:
            same = code == form[0]
            if len(form) > 1:
                same &= second == form[1]
            if len(form) > 2:
                same &= third == form[2]
            odd |= same
        out[np.searchsorted(borders, at[odd], "right") - 1] = True
        return out

    def _marked(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """The documents that hold the content of an added token, in the form that units are cut from."""
        out = np.zeros(len(borders) - 1, bool)
        fold = _FOLDED if self.kind == "words" else np.arange(256, dtype=np.uint8)
        raw = fold[data].tobytes() if self.added else b""
        for content in self.added:
            content = fold[np.frombuffer(content.encode(), np.uint8)].tobytes()
            at = raw.find(content)
            while at >= 0:
                document = int(np.searchsorted(borders, at, "right")) - 1
                inside = at + len(content) <= borders[document + 1]
                out[document] |= inside
                at = raw.find(content, int(borders[document + 1]) if inside else at + 1)
        return out

    def _of_units(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > KEPT_IDS:
            self._forget()
        key = keys(data, starts, ends)
        slot = (key >> np.uint64(64 - SLOTS)).astype(np.int64)
        first, count = self.first[slot], self.count[slot]
        lost = np.flatnonzero((self.known[slot] != key) | (count == 0) | (ends - starts > SHORT))
        if len(lost):
            new, one, back = np.unique(key[lost], return_index=True, return_inverse=True)
            one = lost[one]
            raw = data.tobytes()
            a, b = starts[one].tolist(), ends[one].tolist()
            made, counts = self._encode([raw[x:y].decode("utf-8", "replace") for x, y in zip(a, b, strict=True)])
            if self.used + len(made) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + len(made), np.uint32)])
            self.ids[self.used : self.used + len(made)] = made
            firsts = self.used + np.cumsum(counts) - counts
            self.used += len(made)
            first[lost], count[lost] = firsts[back], counts[back]
            self.known[slot[one]], self.first[slot[one]], self.count[slot[one]] = new, firsts, counts
        total = int(count.sum(dtype=np.int64))
        shift = first - (np.cumsum(count, dtype=np.int64) - count)
        return self.ids[np.repeat(shift, count) + np.arange(total)], count.astype(np.int64)
