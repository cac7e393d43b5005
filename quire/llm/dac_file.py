"""Operator 10: token ids in files of directly addressable codes.

File format (little-endian), one shard of documents in ascending order of id:

    magic "QDAC1\\0\\0\\0", u32 levels, u32 documents, u64 tokens
    document table: i64 doc_id, u64 first token (documents + 1 of the latter)
    for each level: u64 entries n; n bytes, the level's eight bits of each id;
        continuation bitmap of ceil(n / 64) u64 words, bit = the id goes on in
        the next level; rank directory of u32, the ones before each 512 bits

Level k holds bits 8k .. 8k+7 of every id that reaches it. Token p is byte p of
level 0; if its bit is set, it goes on at entry rank1(bitmap, p) of level 1, and so
on: at most four lookups, and no block is decoded.

Documents are dealt by range of doc_id and a hash of the text and sorted (the text
moves once; rows of one id, and copies of a row, may lie in several ranges, so none is a hot
task), then each task encodes its documents and writes its shards to the shared
folder under a temporary name and renames them. Names follow from the partition
alone, so a task that is run again replaces its own files with equal ones; a task
that fails deletes what it had begun. The manifest (one row a shard) is written as
a table; offsets are prefix sums over it. ``Shard.open`` reads a stored shard's
tokens by ranges of bytes, without loading the file.

Cases: a null text is encoded as empty (its end id alone). A null id sorts first
and is stored as the smallest long; read() gives it back as null. Ids must be
integers (else TypeError, before any work). Repeated ids and rows keep all their
rows; rows of equal id are ordered by a hash of their text. An empty table gives no
shard and an empty result. Texts of any length are whole, as one document never
spans shards. Only the id and the text are read, so extra columns can't clash.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import col, integer_ids, materialize, prepare, shared_dir, slices, table
from quire.llm.fast_bpe import encoder

MAGIC = b"QDAC1\0\0\0"
NO_ID = -(2**63)
BLOCK = 512
SHARD_TOKENS = 8_000_000
END_ID = 2


def filesystem(uri: str):
    """pyarrow's file system and path for a URI; other schemes than pyarrow's raise."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def pack_bits(flags: np.ndarray) -> np.ndarray:
    bits = np.packbits(flags, bitorder="little")
    return np.pad(bits, (0, -len(bits) % 8)).view("<u8")


def dump(doc_ids: Sequence[int], counts: Sequence[int], ids: np.ndarray) -> bytes:
    """One shard's file."""
    ids = np.asarray(ids, "<u4")
    starts = np.zeros(len(counts) + 1, "<u8")
    np.cumsum(counts, out=starts[1:])
    levels, rest = [], ids
    while True:
        more = rest > 0xFF
        words = pack_bits(more)
        ones = np.bitwise_count(np.pad(words, (0, -len(words) % (BLOCK // 64)))).reshape(-1, BLOCK // 64).sum(1)
        ranks = np.zeros(len(ones) + 1, "<u4")
        np.cumsum(ones, out=ranks[1:])
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + words.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<IIQ", len(levels), len(counts), len(ids))
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), starts.tobytes(), *levels])


class Shard:
    """Random access to a shard's tokens and documents through ``fetch(at, size)``, which gives bytes of the file."""

    def __init__(self, fetch: Callable[[int, int], bytes]) -> None:
        self.fetch = fetch
        if bytes(fetch(0, 8)) != MAGIC:
            raise ValueError("not a shard of token ids")
        levels, docs, self.n_tokens = struct.unpack("<IIQ", fetch(8, 16))
        self.doc_ids = np.frombuffer(fetch(24, 8 * docs), "<i8")
        self.starts = np.frombuffer(fetch(24 + 8 * docs, 8 * (docs + 1)), "<u8").astype(np.int64)
        at = 24 + 8 * (2 * docs + 1)
        self.levels = []  # where the bytes, the bitmap and the rank directory of each level begin
        for _ in range(levels):
            (n,) = struct.unpack("<Q", fetch(at, 8))
            bits = at + 8 + n
            ranks = bits + 8 * -(-n // 64)
            self.levels.append((at + 8, bits, ranks))
            at = ranks + 4 * (-(-n // BLOCK) + 1)

    @classmethod
    def load(cls, data: bytes) -> Shard:
        view = memoryview(data)
        return cls(lambda at, size: view[at : at + size])

    @classmethod
    def open(cls, uri: str) -> Shard:
        """A stored shard, of which only what is asked for is read."""
        store, path = filesystem(uri)
        file = store.open_input_file(path)
        return cls(lambda at, size: file.read_at(size, at))

    def rank(self, level: int, p: int) -> int:
        """Ones before bit ``p``: the directory's entry and at most one block's popcount."""
        _, bits, ranks = self.levels[level]
        block = p // BLOCK
        (ones,) = struct.unpack("<I", self.fetch(ranks + 4 * block, 4))
        first = block * (BLOCK // 8)
        part = int.from_bytes(self.fetch(bits + first, p // 8 + 1 - first), "little") if p % BLOCK else 0
        return ones + (part & ((1 << p % BLOCK) - 1)).bit_count()

    def token(self, p: int) -> int:
        value = shift = level = 0
        while True:
            low, bits, _ = self.levels[level]
            value |= self.fetch(low + p, 1)[0] << shift
            if not self.fetch(bits + p // 8, 1)[0] >> (p % 8) & 1:
                return value
            p, level, shift = self.rank(level, p), level + 1, shift + 8

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop - 1, addressed directly: one rank a level, then the levels' own order."""
        out = np.zeros(stop - start, "<u4")
        live = np.arange(stop - start)
        for level, (low, bits, _) in enumerate(self.levels):
            if stop <= start:
                break
            out[live] |= np.frombuffer(self.fetch(low + start, stop - start), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            first = start // 8
            flags = np.unpackbits(np.frombuffer(self.fetch(bits + first, -(-stop // 8) - first), np.uint8), bitorder="little")[start - 8 * first :][: stop - start].astype(bool)
            live = live[flags]
            start = self.rank(level, start) if len(live) else 0
            stop = start + len(live)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))


def write(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, folder: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode, write the shards to ``folder`` and return the manifest: part, shard, uri, n_docs, n_tokens."""
    spark = prepare(df.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    folder = folder or f"{shared_dir(spark)}/quire-dac-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(integer_ids(df, id_col).alias("id"), col(text_col).cast("string").alias("text"))
    # Equal rows are told apart by where they were read, so that copies of a row fill many ranges.
    rows = rows.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(n, "id", "h", "at").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, tries = task.partitionId(), task.taskAttemptId()
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        made = encoder(path, False, 1_000_000)
        doc_ids: list[int] = []
        counts: list[int] = []
        ids = array("I")
        rows: list[tuple] = []

        def flush() -> None:
            name = f"part-{part:06d}-{len(rows):06d}.dac"
            begun = f"{root}/.{name}.{tries}"
            try:
                with store.open_output_stream(begun) as out:
                    out.write(dump(doc_ids, counts, np.frombuffer(ids, np.uint32)))
                store.move(begun, f"{root}/{name}")
            except BaseException:
                with contextlib.suppress(OSError):
                    store.delete_file(begun)
                raise
            rows.append((part, len(rows), f"{folder}/{name}", len(counts), sum(counts)))

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in slices(texts):
                for key, found in zip(keys[start:stop], made.encode([t or "" for t in texts[start:stop]]), strict=True):
                    if ids and len(ids) + len(found) + 1 > shard_tokens:
                        flush()
                        doc_ids, counts, ids = [], [], array("I")
                    doc_ids.append(NO_ID if key is None else key)
                    ids.extend(found)
                    ids.append(end_id)
                    counts.append(len(found) + 1)
        if counts:
            flush()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "shard", "uri", "n_docs", "n_tokens"), r, strict=True)) for r in rows])

    return materialize(ordered.mapInArrow(run, "part long, shard long, uri string, n_docs long, n_tokens long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every document from the shards: doc_id, start, n_tokens, ids_crc32, in their order of writing."""
    spark = prepare(manifest.sparkSession)
    before = F.sum("n_tokens").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    shards = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, name = filesystem(uri)
                with store.open_input_stream(name) as stream:
                    shard = Shard.load(stream.read())
                sizes = np.diff(shard.starts)
                crc = [zlib.crc32(shard.document(i).tobytes()) for i in range(len(sizes))]
                key = pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([key, pa.array(base + shard.starts[:-1]), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("uri", "base").repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents")))


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
