"""Operator 5: BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the text's bytes cuts chunks where its low bits are zero, so
equal passages give equal chunks wherever they stand. A chunk is encoded once in
a worker, as a text of its own, and its ids are reused for all documents. Then the
joins are repaired: the last tokens of what stands before and the first of the next
chunk are encoded again as one span by the tokenizers library. If the span's first
id is the id that stood at its first token and its last id the one that stood at its
last, the sides agree and the span's ids replace theirs; else the span grows, up to
the whole of both sides, and is encoded again until they agree.

Why agreement is exact: spans begin and end where the pre-tokenizer has a boundary
for sure (white space after something else) or within a run of one kind (letters,
digits, white space, other marks), so its words inside the span are those of the
whole text, cut at the ends at most; and a sequence of tokens is
the BPE encoding of a word if and only if each pair of neighbours is the encoding of
what they spell; every pair of the result stood side by side in one encoding.

Chunks have LEAST to MOST bytes, and all caches are bounded in bytes as well as in
number, so a text without white space takes memory in proportion to its length. To
encode a new chunk its words are looked up among those met before and only new ones
go to the library, which is as exact (see fast_bpe.py) and in budget. The work needs
no shuffle: a lost task is simply run again.

Cases: a null text is encoded as the empty text (no ids, decoded to ""); an empty
table gives an empty result. A chunk with uncommon white space is encoded by the
tokenizers library itself, a text with the vocabulary's special tokens in whole. Repeated rows give
repeated results. Extra columns are kept whatever their names; those named as a
result, in any case, are replaced by it.
"""

from __future__ import annotations

import hashlib
import unicodedata
from array import array
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.llm.common import held, map_texts, table
from quire.llm.fast_bpe import FINE_UNIT, ODD_SPACE, UnitEncoder

WINDOW = 16
MASK = 0x1FF  # a cut at about every 512th byte
LEAST, MOST = 64, 4096
MULTIPLIER = 0x9E3779B1
BLOCK = 1 << 20
GUARD = 2  # tokens of each side that a span has at first
_SPACE = frozenset(b" \t\r\n")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def marks(data: bytes, window: int = WINDOW, mask: int = MASK) -> np.ndarray:
    """Places whose ``window`` bytes before (a power of two) have a polynomial hash with low bits zero."""
    if len(data) <= window:
        return np.zeros(0, np.int64)
    h, width, factor = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1), 1, MULTIPLIER
    while width < window:  # h[i] covers the bytes i .. i + width - 1
        h = h[:-width] * np.uint32(factor) + h[width:]
        width, factor = width * 2, factor * factor & 0xFFFFFFFF
    return np.flatnonzero((h >> np.uint32(11)) & np.uint32(mask) == 0) + window


def cuts(data: bytes, window: int = WINDOW, mask: int = MASK, least: int = LEAST, most: int = MOST) -> list[int]:
    """Where chunks of UTF-8 ``data`` end: at marks, ``least`` to ``most`` bytes apart, never inside a character."""
    out, at, n = [], 0, len(data)
    for base in range(0, n, BLOCK):  # the hash is made by blocks, so that memory is bounded
        low, high = max(0, base - window), min(n, base + BLOCK)
        ends = marks(data[low:high], window, mask) + low
        while at < high:
            k = int(np.searchsorted(ends, at + least))
            end = int(ends[k]) if k < len(ends) else high
            if end - at > most:
                end = at + most
            elif k >= len(ends):
                break
            while end < n and data[end] & 0xC0 == 0x80:
                end -= 1
            if end >= n:
                break
            out.append(end)
            at = end
    return [*out, n] if n else out


def kind(ch: str) -> str:
    """S uncommon white space, L letter, N number, P anything else, as the pre-tokenizer tells them apart; plain white space is told before."""
    if ODD_SPACE.match(ch):
        return "S"
    return "L" if ch.isalpha() else "N" if unicodedata.category(ch)[0] == "N" else "P"


_KINDS = bytes(ord(kind(chr(k))) for k in range(128))
_ODD = ord("S")


def anchor(data: bytes, at: int) -> bool:
    """A span may begin or end here: white space begins, or a run of one kind goes on.

    Not before an apostrophe, which may begin a word of its own, nor before the
    last character of a run of white space, which the next word may take, nor beside
    uncommon white space, which joins such runs.
    """
    b, c = data[at - 1], data[at]
    if c in _SPACE:
        if b < 128 and _KINDS[b] == _ODD or b >= 128 and kind(data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:] or " ") == "S":
            return False
        return b not in _SPACE or at + 1 < len(data) and data[at + 1] in _SPACE
    if b in _SPACE or c & 0xC0 == 0x80 or c == 0x27:
        return False
    if b < 128 and c < 128:
        return _KINDS[b] == _KINDS[c] != _ODD
    before, after = data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:], data[at : at + 4].decode("utf-8", "ignore")[:1]
    return before != "" and after != "" and kind(before) == kind(after) != "S"


class Chunk:
    """A chunk's ids, cut where spans begin and end at first: head and tail are None if it is too short for both."""

    __slots__ = ("ids", "head", "tail")

    def __init__(self, ids: bytes, head: tuple | None, tail: tuple | None) -> None:
        self.ids, self.head, self.tail = ids, head, tail  # head, tail: (bytes of text, tokens)


class ChunkEncoder:
    """Encodes and decodes as the tokenizers library does with a byte-level BPE file."""

    def __init__(self, path: str, most_chunks: int = 40_000, most_spans: int = 100_000) -> None:
        self.path, self.most, self.most_spans = path, most_chunks, most_spans
        self.base = UnitEncoder(path, True)
        self.special = [t.content for t in self.base.tokenizer.get_added_tokens_decoder().values()]
        self.chunks: dict[bytes, Chunk] = {}
        self.spans: dict[bytes, bytes] = {}
        self.reused = self.encoded = self.welds = self.grown = 0
        self._sizes: list[int] | None = None

    def chunk(self, data: bytes, ids: bytes) -> Chunk:
        made = array("I")
        made.frombytes(ids)
        n, size = len(made), self.sizes
        a, at = 0, len(data)
        while a < n - 1:  # backwards to an anchor before GUARD tokens or more
            a += 1
            at -= size[made[-a]]
            if a >= GUARD and at > 0 and anchor(data, at):
                break
        b, to = 0, 0
        while b < n - 1:
            to += size[made[b]]
            b += 1
            if b >= GUARD and to < len(data) and anchor(data, to):
                break
        if a + b >= n or not (0 < at < len(data) and anchor(data, at)) or not (0 < to < len(data) and anchor(data, to)):
            return Chunk(ids, None, None)
        return Chunk(ids, (data[:to], b), (data[at:], a))

    def library(self, spans: list[bytes]) -> None:
        """Encode spans that aren't known yet, in one call."""
        if len(self.spans) + len(spans) > self.most_spans:
            self.spans.clear()
        new = list(dict.fromkeys(s for s in spans if s not in self.spans))
        for s, ids in zip(new, self.base.library([s.decode() for s in new]), strict=True):
            self.spans[s] = ids.tobytes()

    def split(self, texts: Sequence[bytes]) -> list[list[bytes]]:
        """The texts' chunks, all of which are then in the cache."""
        out, fresh = [], {}
        if len(self.chunks) > self.most:
            for c in list(self.chunks)[: len(self.chunks) // 2]:
                del self.chunks[c]
        for data in texts:
            at, parts = 0, []
            for end in cuts(data):
                parts.append(data[at:end])
                at = end
            out.append(parts)
            for c in parts:
                if c in self.chunks or c in fresh:
                    self.reused += 1
                else:
                    self.encoded += 1
                    fresh[c] = FINE_UNIT.findall(c.decode())
        # What stands beside uncommon white space isn't told by units: such a chunk goes to the library.
        odd = [c for c in fresh if ODD_SPACE.search(c.decode())]
        for c, ids in zip(odd, self.base.library([c.decode() for c in odd]), strict=True):
            self.chunks[c] = self.chunk(c, ids.tobytes())
            del fresh[c]
        known = self.base.room()
        found = {c: list(map(known.get, units)) for c, units in fresh.items()}
        gaps = {c: [k for k, ids in enumerate(row) if ids is None] for c, row in found.items() if None in row}
        self.base.add(list(dict.fromkeys(fresh[c][k] for c, ks in gaps.items() for k in ks)))
        for c, ks in gaps.items():
            for k in ks:
                found[c][k] = known[fresh[c][k]]
        for c, row in found.items():
            self.chunks[c] = self.chunk(c, b"".join(row))
        return out

    def encode(self, texts: Sequence[str | None]) -> list[array]:
        texts = [t or "" for t in texts]
        plain = [not any(x in t for x in self.special) for t in texts]
        split = iter(self.split([t.encode() for t, ok in zip(texts, plain, strict=True) if ok]))
        parts = [next(split) if ok else [] for ok in plain]
        get = self.chunks.__getitem__
        self.library([get(x).tail[0] + get(y).head[0] for p in parts for x, y in zip(p, p[1:], strict=False) if get(x).tail and get(y).head])
        return [self.welded(p) if ok else self.base.library([t])[0] for t, ok, p in zip(texts, plain, parts, strict=True)]

    def welded(self, parts: list[bytes]) -> array:
        """The ids of the text that the chunks make up."""
        out, done = array("I"), 0
        last = None  # the chunk at the end of ``out``, if it stands there as it was encoded
        for data in parts:
            c = self.chunks[data]
            if out:
                self.welds += 1
                span = self.spans.get(last.tail[0] + c.head[0]) if last and last.tail and c.head else None
                if span is not None:
                    a, b = last.tail[1], 4 * c.head[1]
                    if span[:4] == last.ids[-4 * a :][:4] and span[-4:] == c.ids[b - 4 : b]:
                        del out[-a:]
                        out.frombytes(span)
                        out.frombytes(c.ids[b:])
                        last, done = c, done + 1
                        continue
                taken = self.weld(out, parts, done, c)
                last = c if c.tail and 4 * (taken + c.tail[1]) <= len(c.ids) else None
            else:
                out.frombytes(c.ids)
                last = c
            done += 1
        return out

    def weld(self, out: array, parts: list[bytes], k: int, c: Chunk) -> int:
        """Append chunk k to ``out``, the ids of the chunks before it, by spans that grow until both sides agree; how many of its ids the span replaced."""
        right, size, reach = array("I"), self.sizes, GUARD
        right.frombytes(c.ids)
        while True:
            # The text that may be needed of the left: enough chunks to hold its last tokens.
            left, first = b"", k
            a = at = 0
            while a < len(out):
                a += 1
                at += size[out[-a]]
                while len(left) < at + 4 and first > 0:
                    first -= 1
                    left = parts[first] + left
                if a >= reach and at < len(left) and anchor(left + parts[k][:4], len(left) - at):
                    break
            if a == len(out):
                at = len(left)
            b = to = 0
            ahead = parts[k] + (parts[k + 1][:4] if k + 1 < len(parts) else b"")
            while b < len(right):
                to += size[right[b]]
                b += 1
                if b >= reach and to < len(parts[k]) and anchor(ahead, to):
                    break
            (span,) = self.base.library([(left[len(left) - at :] + parts[k][:to]).decode()])
            if (a == len(out) or span[0] == out[-a]) and (b == len(right) or span[-1] == right[b - 1]):
                del out[-a:]
                out.extend(span)
                out.extend(right[b:])
                return b
            self.grown += 1
            reach *= 2

    @property
    def sizes(self) -> list[int]:
        """Bytes of each id."""
        if self._sizes is None:
            self._sizes = list(map(len, self.pieces))
        return self._sizes

    @property
    def pieces(self) -> list[bytes]:
        """The bytes of each id."""
        return self.base.pieces

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def chunk_encoder(path: str) -> ChunkEncoder:
    """This worker's encoder, whose chunks serve all its tasks."""
    return held(("bpe_reuse", path), lambda: ChunkEncoder(path))


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, keep: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds ``ids`` array<long>, the token ids of each whole text."""
    path = path or default_path()

    def factory():
        made = chunk_encoder(path)
        return lambda texts: [[x.tolist() for x in made.encode(texts)]]

    return map_texts(df, text_col, T.StructType([T.StructField("ids", T.ArrayType(T.LongType()))]), factory, keep, prefix)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds ``decoded`` string, the text of each array of ids (null: empty); a column of that name is replaced."""
    from pyspark.sql import functions as F

    from quire.llm.common import col, prepare

    prepare(df.sparkSession)
    path = path or default_path()

    @F.pandas_udf("string")
    def text_of(ids):
        made = chunk_encoder(path)
        return ids.map(lambda x: made.decode(x) if x is not None else "")

    return df.select(*[col(c) for c in (df.columns if keep is None else keep) if c.lower() != "decoded"], text_of(col(ids_col).cast("array<long>")).alias("decoded"))


def digests(df: DataFrame, text_col: str = "text", path: str | None = None, keep: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 of each text's encoding and of that encoding's decoding."""
    path = path or default_path()
    fields = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def factory():
        made = chunk_encoder(path)
        digits = [b"%d," % i for i in range(len(made.pieces))]

        def work(texts):
            found = made.encode(texts)
            n, a, b = [], [], []
            for ids in found:
                n.append(len(ids))
                a.append(hashlib.sha256(b"".join(map(digits.__getitem__, ids))[:-1]).hexdigest())
                b.append(hashlib.sha256(made.decode(ids).encode()).hexdigest())
            return n, a, b

        return work

    return map_texts(df, text_col, fields, factory, keep, prefix)


def op5_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), "text", keep=["doc_id"])


QUERIES = {"op5_bpe_chunk_reuse": op5_bpe_chunk_reuse}
ORACLES: dict[str, str] = {}
