"""Exact BPE encoding of many texts with a bounded cache of their units.

A unit is cut where white space follows something else, a place at which neither
of the two pre-tokenizers can have a token across. Equal units therefore have
equal ids wherever they stand, and a text's ids are those of its units in order.
Texts with other kinds of white space than the four plain ones, about which
Unicode versions differ, are encoded whole by the tokenizers library.

For a vocabulary with word ends, texts of Latin-1 characters are cut into the
pre-tokenizer's words here, and only words not met before go to the library's BPE
model, many in one call; the words' ids are told apart by their end marks. All other
texts go by units through the library's whole chain.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -     　]")
UNIT = re.compile(r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+")
#: For byte-level vocabularies units also end between a letter and a common mark, where the pre-tokenizer always cuts: fewer unlike ones.
FINE_UNIT = re.compile(r"[ \t\r\n]*+(?:[^ \t\r\n.,;:!?]++(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])(?=[.,;:!?])|[^ \t\r\n]++)|[ \t\r\n]++")


MOST_CHARS = 12_000_000
#: Texts for which lower-casing and composition are plain and letters are told from others by range.
LATIN = re.compile(r"[\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*\Z")
#: The words of such a text, lower-cased.
WORD = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t\n\r a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class EndedWords:
    """Ids of pre-tokenized lower-case words, for vocabularies whose last token of a word ends in </w>."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.normalizer, self.model.pre_tokenizer = None, WhitespaceSplit()
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        letters = byte_letters()
        self.spell = {chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def learn(self, words: list[str]) -> None:
        table = str.maketrans(self.spell)
        for i in range(0, len(words), 2048):
            some = words[i : i + 2048]
            ids = np.array(self.model.encode(" ".join(some).translate(table), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the vocabulary has no word ends")
            raw, marks = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.known.update(zip(some, [raw[a:b] for a, b in zip(marks, marks[1:], strict=False)], strict=True))

    def encode(self, texts: list[str | None], most: int) -> list[array | None]:
        """Ids of the texts, None for those that this way doesn't cover."""
        if len(self.known) > most or self.chars > MOST_CHARS:
            for word in list(self.known)[: -(-len(self.known) // 2)]:
                self.chars -= len(word)
                del self.known[word]
        get, new, rows = self.known.get, set(), []
        for text in texts:
            if text is None or not LATIN.match(text) or "<|" in text:
                rows.append(None)
                continue
            words = WORD.findall(text.lower())
            found = list(map(get, words))
            gaps = [k for k, x in enumerate(found) if x is None] if None in found else []
            new.update([words[k] for k in gaps])
            rows.append((found, [(k, words[k]) for k in gaps]))
        self.chars += sum(map(len, new))
        self.learn(list(new))
        out: list[array | None] = []
        for row in rows:
            if row is None:
                out.append(None)
                continue
            found, gaps = row
            for k, word in gaps:
                found[k] = self.known[word]
            ids = array("I")
            ids.frombytes(b"".join(found))
            out.append(ids)
        return out


class UnitEncoder:
    """``encode(texts)`` gives an ``array('I')`` of ids for each text.

    ``keep_space``: white space before a word belongs to its unit (byte-level
    vocabularies); else it is dropped. ``most_units`` and ``most_chars`` bound the
    cache; beyond them the older half goes, which costs time only.
    """

    def __init__(self, path: str, keep_space: bool, most_units: int = 600_000, most_chars: int = 12_000_000) -> None:
        from tokenizers import Tokenizer

        self.most_chars, self.chars = most_chars, 0
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.keep_space, self.most = keep_space, most_units
        self.known: dict[str, bytes] = {}
        self._pieces: list[bytes] | None = None
        self._sizes: np.ndarray | None = None
        self.words = None if keep_space else EndedWords(path)

    def library(self, texts: list[str]) -> list[array]:
        return [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, text: str) -> list[str]:
        return UNIT.findall(text) if self.keep_space else text.split()

    def room(self) -> dict[str, bytes]:
        """The cache (unit to its ids as bytes), without its older half if it is full."""
        known = self.known
        if len(known) > self.most or self.chars > self.most_chars:
            for unit in list(known)[: -(-len(known) // 2)]:
                self.chars -= len(unit)
                del known[unit]
        return known

    def add(self, new: list[str]) -> None:
        """Encode units that the cache doesn't hold, in texts of many; units not told apart by their bytes one by one."""
        self.chars += sum(map(len, new))
        if self.keep_space:
            # Before white space that follows something else no token goes across.
            alone = [u for u in new if u[0] not in " \t\r\n" or u[-1] in " \t\r\n"]
            led = [u for u in new if u[0] in " \t\r\n" and u[-1] not in " \t\r\n"]
        else:
            alone, led = new, []
        for i in range(0, len(led), 1024):
            some = led[i : i + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends, upto = np.cumsum([len(u.encode()) for u in some]), np.cumsum(self.sizes[ids])
            at = np.searchsorted(upto, ends)
            if len(ids) == 0 or upto[-1] != ends[-1] or not np.array_equal(upto[at], ends):
                alone = alone + some
                continue
            raw, marks = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
            self.known.update(zip(some, [raw[a:b] for a, b in zip(marks, marks[1:], strict=False)], strict=True))
        for i in range(0, len(alone), 4096):
            some = alone[i : i + 4096]
            for unit, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[unit] = array("I", found.ids).tobytes()

    @property
    def pieces(self) -> list[bytes]:
        """The bytes of each id."""
        if self._pieces is None:
            byte_of = {letter: b for b, letter in byte_letters().items()}
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self._pieces = [b""] * (max(vocab.values(), default=-1) + 1)
            for token, i in vocab.items():
                self._pieces[i] = bytes(byte_of[ch] for ch in token) if all(ch in byte_of for ch in token) else token.encode()
        return self._pieces

    @property
    def sizes(self) -> np.ndarray:
        """Bytes of each id."""
        if self._sizes is None:
            self._sizes = np.array(list(map(len, self.pieces)), np.int64)
        return self._sizes

    def learn(self, units: set[str]) -> dict[str, bytes]:
        """The cache, with all of ``units`` in it."""
        known = self.room()
        self.add([u for u in units if u not in known])
        return known

    def encode(self, texts: list[str]) -> list[array]:
        done = self.words.encode(texts, self.most) if self.words else [None] * len(texts)
        parts = [() if ids is not None else None if ODD_SPACE.search(text) else self.units(text) for text, ids in zip(texts, done, strict=True)]
        known = self.learn({u for units in parts if units for u in units})
        out = []
        for text, units, ids in zip(texts, parts, done, strict=True):
            if ids is not None:
                out.append(ids)
            elif units is None:
                out += self.library([text])
            else:
                ids = array("I")
                ids.frombytes(b"".join(map(known.__getitem__, units)))
                out.append(ids)
        return out


_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder(path: str, keep_space: bool, most_units: int = 600_000) -> UnitEncoder:
    """This worker's encoder; its cache serves all tasks of the worker."""
    key = (path, keep_space, most_units)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(*key)
    return _ENCODERS[key]
