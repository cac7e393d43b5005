"""Operator 11: phrases whose words stand together more often than by chance.

A text is split into pieces at ``.,;:!?`` and line ends, and a piece into words. Every
place where one to five words follow each other becomes a row (lang, phrase, count);
rows are added up by language and phrase, candidates take the counts of their first
words and of the rest by joins, are scored in decimals, lose to longer candidates of
the same count by an anti-join with the first and last words of those, and are ranked
by a window.

All words become rows. Before rows of more words are made, places that can't reach
``least`` occurrences go. A table of
cells of fixed size counts hashes of words, then of pairs whose words both passed, then
of longer runs whose pairs all passed. A cell holds at least the count of each phrase
in it, so no phrase with ``least`` occurrences is lost, and what else passes goes when
rows are counted; results don't depend on it. Cells are one byte, as tasks needn't
count beyond ``least`` (up to 255; cells then saturate there and pass), and a task's
cells are added up in rounds of FAN tasks. The driver only sees one bit a cell, at most
MOST_CELLS. With more words than cells can tell apart more places pass, up to all.

A task keeps a few bytes a word of a slice of texts; hashes are numpy products over the
bytes. Keys that many rows bear (first words of candidates, languages) are dealt.

Cases: a null text has no words, a null lang is ``und``. Repeated rows count each time;
an empty table gives an empty result. Very long texts and words are whole. Ties are
settled by the phrase's bytes. Extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import col, join_dealt, materialize, prepare, table

#: Bytes of text a cell; the least and most cells of a level.
CELL_BYTES = 64
LEAST_CELLS = 1 << 16
MOST_CELLS = 1 << 25
#: Cells of a row, and tasks whose rows are added up in one group.
BLOCK = 1 << 16
FAN = 64
#: Bytes of a slice of texts; words longer than LONG bytes are hashed on their own.
SLICE = 4_000_000
CHUNK = 1 << 20
LONG = 1 << 16
#: Distinct phrases a task holds before it sends their counts on.
HELD = 300_000

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Lower-cased, with a space for all that stands between words.
_FLAT = bytes(32 if chr(c) in ".,;:!?\n\v\f\r\t" else int(_LOWER[c]) for c in range(256))
#: 0 in a word, 1 between words, 2 between pieces.
_KIND = np.array([2 if chr(c) in ".,;:!?\n\v\f\r" else 1 if chr(c) in " \t" else 0 for c in range(256)], np.uint8)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _STEP
    h = (h ^ (h >> np.uint64(29))) * _STEP
    return h ^ (h >> np.uint64(32))


class _Hasher:
    """64-bit hashes of words: polynomials in an odd base modulo 2^64, by prefix sums over bytes."""

    def __init__(self, base: int):
        size = CHUNK + LONG + 1
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(size, base, np.uint64))
            self.inverse = np.cumprod(np.full(size, pow(base, -1, 2**64), np.uint64))
        self.base = base

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        long = np.flatnonzero(ends - starts > LONG)
        stops = ends.copy()
        stops[long] = starts[long]
        i = 0
        while i < len(starts):
            j = int(np.searchsorted(starts, starts[i] + CHUNK))
            low = starts[i]
            size = int(stops[i:j].max() - low)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((data[low : low + size].astype(np.uint64) + np.uint64(1)) * self.powers[:size], out=sums[1:])
            at = starts[i:j] - low
            out[i:j] = (sums[stops[i:j] - low] - sums[at]) * self.inverse[at]
            i = j
        for k in long:
            out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=self.base.to_bytes(8, "little")).digest(), "little")
        return _mix(out)


class _Words:
    """The words of a slice of texts: where they stand, their pieces, and hashes of runs of them."""

    def __init__(self, data: np.ndarray, heads: np.ndarray, lang: np.ndarray, langs: list[bytes], hashers: tuple[_Hasher, ...]):
        self.texts, self.langs = np.split(data, heads[1:]), lang
        self.data = _LOWER[data]
        kind = _KIND[data]
        inside = kind == 0
        first = np.zeros(len(data) + 1, bool)
        first[heads] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        cuts = np.flatnonzero((kind == 2) | first[:-1])
        self.piece = np.searchsorted(cuts, self.starts, side="right")
        self.lang = lang[np.searchsorted(heads, self.starts, side="right") - 1]
        salt = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in langs], np.uint64)
        salts = salt[self.lang]
        self.words = [_mix(h(self.data, self.starts, self.ends) + salts) for h in hashers]

    def __len__(self) -> int:
        return len(self.starts)

    def runs(self, n: int, which: int = 0) -> np.ndarray:
        """Hashes of the n words from each place on; the last n - 1 places have none."""
        words = self.words[which]
        out = words[: max(len(words) - n + 1, 0)].copy()
        for k in range(1, n):
            out = _mix(out * _STEP + words[k : k + len(out)])
        return out

    def within(self, n: int) -> np.ndarray:
        """Whether the n words from each place on stand in one piece."""
        m = max(len(self) - n + 1, 0)
        return self.piece[:m] == self.piece[n - 1 : n - 1 + m]

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join([self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(at, at + n)])


def _slices(batches: Iterator[pa.RecordBatch], hashers: tuple[_Hasher, ...]) -> Iterator[tuple[_Words, list[bytes]]]:
    """The words of slices of about SLICE bytes; columns are text and lang."""
    for batch in batches:
        text = batch.column(0)
        if not len(text):
            continue
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
        codes = batch.column(1).dictionary_encode()
        langs, lang = [x.encode() for x in codes.dictionary.to_pylist()], codes.indices.to_numpy()
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
            if offsets[j] > offsets[i]:
                # Texts without a byte would share their head with the next one.
                full = np.flatnonzero(offsets[i + 1 : j + 1] > offsets[i:j]) + i
                yield _Words(data[offsets[i] : offsets[j]], offsets[full] - offsets[i], lang[full], langs, hashers), langs
            i = j


def _passing(words: _Words, n: int, bits: dict[int, np.ndarray], shift: np.uint64) -> np.ndarray:
    """Places whose n words stand in one piece, and whose shorter runs are in cells that pass."""
    ok = words.within(n)
    for k in (m for m in (1, 2) if m < n and m in bits):
        good = bits[k][words.runs(k) >> shift]
        for d in range(n - k + 1):
            ok &= good[d : d + len(ok)]
    return np.flatnonzero(ok)


def _cells(levels: tuple[int, ...], bits: Callable[[], dict[int, np.ndarray]], power: int, cap: int) -> Callable:
    """Rows (level, block, part, cells) of a task: its counts of hashes, none beyond ``cap``."""
    shift = np.uint64(64 - power)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashers = bits(), (_Hasher(_BASES[0]),)
        held = {n: np.zeros(1 << power, np.uint8) for n in levels}
        for words, _ in _slices(batches, hashers):
            for n in levels:
                cell, count = np.unique(words.runs(n)[_passing(words, n, known, shift)] >> shift, return_counts=True)
                held[n][cell] = np.minimum(held[n][cell] + count, cap)
        part = TaskContext.get().partitionId()
        for n, cells in held.items():
            blocks = cells.reshape(-1, min(BLOCK, len(cells)))
            used = np.flatnonzero(blocks.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(used), pa.int32()) if i != 1 else pa.array(used, pa.int32()) for i, x in enumerate((n, None, part))] + [pa.array([blocks[b].tobytes() for b in used], pa.binary())],
                names=["level", "block", "part", "cells"],
            )

    return run


def _added(cap: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["cells"].iloc[0]), np.int64)
        for x in rows["cells"]:
            total += np.frombuffer(x, np.uint8)
        return rows.iloc[:1].assign(cells=np.minimum(total, cap).astype(np.uint8).tobytes())

    return add


def _sketch(read: DataFrame, parts: int, levels: tuple[int, ...], known: dict[int, bytes], power: int, least: int) -> dict[int, bytes]:
    """For each level a bit a cell: whether the cell's phrases may have ``least`` occurrences."""
    cap = min(least, 255)
    sent = read.sparkSession.sparkContext.broadcast(known)
    unpacked = lambda: {n: np.unpackbits(np.frombuffer(b, np.uint8)).view(bool) for n, b in sent.value.items()}
    schema = "level int, block int, part int, cells binary"
    made = read.mapInArrow(_cells(levels, unpacked, power, cap), schema)
    while parts > FAN:
        parts = -(-parts // FAN)
        made = made.withColumn("part", (F.col("part") / FAN).cast("int"))
        made = made.groupBy("level", "block", "part").applyInPandas(_added(cap), schema)
    made = made.groupBy("level", "block").applyInPandas(_added(cap), schema)
    bits = {n: np.zeros((1 << power) // 8, np.uint8) for n in levels}
    size = min(BLOCK, 1 << power)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(cells=[np.packbits(np.frombuffer(c, np.uint8) >= cap).tobytes() for c in rows["cells"]])

    # One bit a cell: at most MOST_CELLS / 8 bytes a level.
    for row in made.mapInPandas(packed, schema).toLocalIterator():
        bits[row["level"]][row["block"] * size // 8 : (row["block"] + 1) * size // 8] = np.frombuffer(row["cells"], np.uint8)
    return {n: b.tobytes() for n, b in bits.items()}


def _rows(max_n: int, bits: Callable[[], dict[int, np.ndarray]], power: int) -> Callable:
    """Rows (lang, phrase, n), added up in the task: of all words, and of the longer runs that pass."""
    shift = np.uint64(64 - power)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashers = bits(), tuple(map(_Hasher, _BASES))
        held: dict[bytes, Counter] = {}

        def sent() -> pa.RecordBatch:
            arrays = [pa.array([lang for lang, c in held.items() for _ in c], pa.binary()), pa.array([p for c in held.values() for p in c], pa.binary()), pa.array([n for c in held.values() for n in c.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "n"])

        for words, langs in _slices(batches, hashers):
            for text, k in zip(words.texts, words.langs.tolist(), strict=True):
                held.setdefault(langs[k], Counter()).update(text.tobytes().translate(_FLAT).split())
            for n in range(2, max_n + 1):
                at = _passing(words, n, known, shift)
                h = words.runs(n)[at]
                passed = known[n][h >> shift]
                at, h, other = at[passed], h[passed], words.runs(n, 1)[at[passed]]
                # Two independent hashes tell phrases apart within a slice; beyond it, their bytes do.
                order = np.lexsort((other, h))
                h, other = h[order], other[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (other[1:] != other[:-1])])) if len(h) else order
                for place, count in zip(at[order[new]].tolist(), np.diff(np.append(new, len(h))).tolist(), strict=True):
                    held.setdefault(langs[words.lang[place]], Counter())[words.phrase(place, n)] += count
            if sum(map(len, held.values())) >= HELD:
                yield sent()
        yield sent()

    return run


def frequent(docs: DataFrame, max_n: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``max_n`` words with at least ``least`` occurrences in a language, and each language's words."""
    prepare(docs.sparkSession)
    read = docs.select(F.coalesce(col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.coalesce(col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = read.agg(F.sum(F.length("text"))).first()[0] or 0
    power = int(min(MOST_CELLS, max(LEAST_CELLS, size // CELL_BYTES))).bit_length() - 1
    parts, known = read.rdd.getNumPartitions(), {}
    for levels in ((1,), (2,), tuple(range(3, max_n + 1))):
        if levels and levels[-1] <= max_n:
            known |= _sketch(read, parts, levels, known, power, least)
    sent = read.sparkSession.sparkContext.broadcast(known)
    unpacked = lambda: {n: np.unpackbits(np.frombuffer(b, np.uint8)).view(bool) for n, b in sent.value.items()}
    rows = read.mapInArrow(_rows(max_n, unpacked, power), "lang binary, phrase binary, n long")
    added = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    added = materialize(added.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "phrase")], "n"), "counts")
    phrases = materialize(added.filter(F.col("n") >= least), "phrases")
    return phrases, added.filter(~F.contains("phrase", F.lit(" "))).groupBy("lang").agg(F.sum("n").alias("n"))


def score(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (l * r)) of columns of longs, exactly: products have up to 38 digits."""
    whole = lambda name, digits: F.col(name).cast(f"decimal({digits},0)")
    over, under = F.lit(1000).cast("decimal(4,0)") * (whole(a, 16) * whole(n, 17)), whole(left, 18) * whole(right, 18)
    return F.call_function("div", over, under)


def collocations(docs: DataFrame, max_n: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    counts, words = frequent(docs, max_n, least)
    cut = F.split("phrase", " ")
    candidates = counts.select("lang", "phrase", F.col("n").alias("a"), cut.alias("w")).filter(F.size("w") >= 2)
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    joined = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = materialize(cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest")), "cuts")
    total = cuts.count()
    scored = cuts
    for part, name in (("first", "l"), ("rest", "r")):
        bearers = cuts.groupBy("lang", part).agg(F.count("*").alias("bearers"))
        known = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)).join(bearers, ["lang", part])
        scored = join_dealt(scored, materialize(known, "parts"), ["lang", part], "bearers", total)
    bearers = cuts.groupBy("lang").agg(F.count("*").alias("bearers"))
    scored = join_dealt(scored, materialize(words.join(bearers, "lang"), "words"), ["lang"], "bearers", total)
    scored = scored.withColumn("score", score("a", "n", "l", "r"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    # A longer candidate of the same count has a one-word extension of that count in it.
    longer = candidates.filter(F.size("w") >= 3)
    ends = [longer.select("lang", joined(F.lit(s), F.size("w") - 1).alias("phrase"), "a") for s in (1, 2)]
    best = best.join(ends[0].union(ends[1]).distinct(), ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op11_collocations": op11_collocations}

ORACLES = {
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
totals AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, array_to_string(words[i : i + size - 1], ' ') AS phrase, any_value(size) AS size, count(*) AS a
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, range(1, 6) s(size) WHERE len(words) >= size)
  GROUP BY 1, 2 HAVING count(*) >= 100
),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM grams WHERE size >= 2)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n,
         (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a), k) AS choice
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
),
longer AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[1:size - 1], ' ') AS phrase, a FROM grams WHERE size >= 3
  UNION SELECT lang, array_to_string(string_split(phrase, ' ')[2:], ' '), a FROM grams WHERE size >= 3
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM scored s WHERE choice = 1 AND NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = s.lang AND x.phrase = s.phrase AND x.a = s.a)
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
}
