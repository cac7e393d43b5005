"""Operator 1: license scan by fuzzy search for short notices.

The text is lower-cased (A-Z) and cut into words in one pass over its bytes; words
joined by single spaces are the search space. A notice with at most k errors, cut
into k + 1 pieces, leaves at least one piece intact (pigeonhole), so exact hits of
the pieces (one Aho-Corasick pass, which also finds whole notices) locate every
candidate. Around a hit the notice is cut finer, into k + SPARE pieces: SPARE of them
at least are intact in a match, each within k characters of where its start puts it, and
only at starts of which that holds the regex library's bounded-error matching of the
whole notice verifies it and gives its span and number of edits. Words of a match may be
joined to one another or to their neighbours, so words play no part in the search. A notice's telling words, those that tell it from another license, must
stand in the span without an edit. Of overlapping matches the one with the fewest
edits counts, then the longest; every other match overlaps one that counts. Time
is in proportion to the text. There is no shuffle; rows are independent.

Cases: a null text is the empty text (no words, empty labels, score 0, no span), an
empty table gives an empty result. Repeated rows give repeated results, very long
texts are scanned in whole. Extra columns are kept whatever their names; those named
as a result, in any case, are replaced by it.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import map_texts, table

#: Base phrases: exact places, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices (label, words, telling words) for the fuzzy search.
NOTICES = (
    ("mit", "under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person", ""),
    ("apache-2", "apache license version 2", "2"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by", "licensed under cc by 3 0", "cc by 3"),
    ("cc-by", "creative commons attribution 4 0 international", "attribution 4"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-nc-sa", "licensed under cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-nd", "licensed under cc by nc nd", "cc by nc nd"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0"),
    ("gpl", "under the gnu general public license", "gnu"),
    ("lgpl", "gnu lesser general public license", "lesser"),
    ("agpl", "gnu affero general public license", "affero"),
    ("mpl-2", "mozilla public license version 2", "mozilla 2"),
    ("bsd", "under the bsd license", "bsd"),
    ("bsd", "redistribution and use in source and binary forms", ""),
    ("isc", "under the isc license", "isc"),
    ("isc", "permission to use copy modify and or distribute this software", ""),
    ("unlicense", "free and unencumbered software released into the public domain", ""),
    ("all-rights-reserved", "all rights reserved worldwide", "rights reserved"),
)
#: One error for so many characters of a notice, MOST_ERRORS at most.
CHARS_PER_ERROR = 8
MOST_ERRORS = 4
#: Pieces that are intact in every match when a notice is cut for the second test.
SPARE = 3
#: Characters between hits that are looked at together.
NEAR = 400

_WORD_MAP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("edits", T.LongType())]))
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS),
])


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """``text`` cut into k pieces of near-equal length, with their offsets."""
    n = len(text)
    marks = [n * i // k for i in range(k + 1)]
    return [(a, text[a:b]) for a, b in zip(marks, marks[1:], strict=False)]


class Notice:
    def __init__(self, label: str, text: str, telling: str, chars_per_error: int) -> None:
        import regex

        self.label, self.text, self.telling = label, text, telling.split()
        self.errors = min(MOST_ERRORS, len(text) // chars_per_error)
        self.fine = pieces(text, self.errors + SPARE)
        # (?e): an earlier start comes first, and its match is then made as close as it can be.
        self.pattern = regex.compile(rf"(?e)(?:{regex.escape(text, literal_spaces=True)}){{e<={self.errors}}}")

    def starts(self, text: str, low: int, last: int) -> list[int]:
        """The starts from ``low`` to ``last`` at which SPARE pieces stand about where they should."""
        size, k = last + 1 - low, self.errors
        found = np.zeros(max(size, 0), np.int16)
        for left, (offset, piece) in zip(range(len(self.fine), 0, -1), self.fine if size > 0 else (), strict=False):
            stop, places = last + offset + k + len(piece), []
            at = text.find(piece, max(low + offset - k, 0), stop)
            while at >= 0:
                places.append(at)
                at = text.find(piece, at + 1, stop)
            if places:
                shifted = np.array(places) - offset - low
                edges = np.bincount(np.maximum(shifted - k, 0), minlength=size + 1) - np.bincount(np.minimum(shifted + k + 1, size), minlength=size + 1)
                found += np.cumsum(edges[:size]) > 0
            if found.max() + left - 1 < SPARE:
                return []
        return (np.flatnonzero(found >= SPARE) + low).tolist()

    def told(self, text: str, start: int, stop: int) -> bool:
        """The telling words stand in the match, whole and unedited."""
        if not self.telling:
            return True
        a, b = text.rfind(" ", 0, start + 1), text.find(" ", stop - 1)
        words = text[max(a, 0) : b if b >= 0 else len(text)].split()
        return all(w in words for w in self.telling)


class Scanner:
    def __init__(self, notices: Sequence[tuple[str, str, str]] = NOTICES, phrases: dict[str, str] = PHRASES, chars_per_error: int = CHARS_PER_ERROR) -> None:
        import ahocorasick

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = [Notice(*n, chars_per_error) for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for offset, piece in pieces(n.text, n.errors + 1):
                seeds.setdefault(piece, []).append((i, offset))
            seeds.setdefault(n.text, []).append((i, -1))  # the notice as it is
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()

    def candidates(self, text: str) -> tuple[set[tuple[int, int]], dict[int, list[list[int]]]]:
        """Exact places (notice, start), and each notice's windows [first, last possible start] around other hits."""
        exact: set[tuple[int, int]] = set()
        hits: dict[int, list[int]] = {}
        for end, (size, places) in self.seeds.iter(text):
            start = end - size + 1
            for i, offset in places:
                if offset < 0:
                    exact.add((i, start))
                else:
                    hits.setdefault(i, []).append(start - offset)
        windows: dict[int, list[list[int]]] = {}
        for i, starts in hits.items():
            mine = windows.setdefault(i, [])
            for start in sorted(starts):
                if (i, start) in exact:
                    continue
                if mine and start - mine[-1][1] <= NEAR:
                    mine[-1][1] = start
                else:
                    mine.append([start, start])
        return exact, windows

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int]]:
        """Verified matches (start, stop, label, edits) in space-joined words, without overlaps, in order."""
        exact, windows = self.candidates(text)
        found = set()
        for i, start in exact:
            n = self.notices[i]
            if n.told(text, start, start + len(n.text)):
                found.add((0, -len(n.text), start, start + len(n.text), n.label))
        for i, spans in windows.items():
            n = self.notices[i]
            for first, last in spans:
                for at in n.starts(text, max(0, first - n.errors), last + n.errors):
                    if (m := n.pattern.match(text, at, min(len(text), at + len(n.text) + n.errors))) and n.told(text, m.start(), m.end()):
                        found.add((sum(m.fuzzy_counts), m.start() - m.end(), m.start(), m.end(), n.label))
        starts: list[int] = []
        out: list[tuple[int, int, str, int]] = []
        for edits, _, start, stop, label in sorted(found):
            at = bisect.bisect_left(starts, start)
            if (at == 0 or out[at - 1][1] <= start) and (at == len(out) or out[at][0] >= stop):
                starts.insert(at, start)
                out.insert(at, (start, stop, label, edits))
        return out

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_MAP).split()
        joined = b" " + b" ".join(words) + b" "
        places: list[int] = []
        base = set()
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            counted = number = 0
            while at >= 0:
                number += joined.count(b" ", counted, at)
                counted = at
                places.append(number)
                base.add(label)
                at = joined.find(phrase, at + 1)
        labels, spans, score = set(base), [], 1.0 if base else 0.0
        plain = joined.decode("utf-8", "replace")
        counted = number = 0
        for start, stop, label, edits in self.fuzzy(plain):
            labels.add(label)
            a, b = start + (plain[start] == " "), stop - (plain[stop - 1] == " ")
            number += plain.count(" ", counted, a)
            counted = a
            spans.append({"label": label, "first_word": number - 1, "last_word": number - 1 + plain.count(" ", a, b), "edits": edits})
            score = max(score, 1 - edits / (stop - start))
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan(df: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, prefix: str = "", notices: Sequence[tuple[str, str, str]] = NOTICES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, words, edits)."""
    kinds = [to_arrow_type(f.dataType) for f in FIELDS.fields]

    def factory():
        scanner = Scanner(notices)
        return lambda texts: [pa.array(x, k) for x, k in zip(zip(*map(scanner.scan, texts), strict=True), kinds, strict=True)]

    return map_texts(df, text_col, FIELDS, factory, keep, prefix)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES: dict[str, str] = {}
