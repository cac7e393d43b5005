"""Operator 6: SimHash near-dedup with deletion-variant signatures.

Fingerprints: per bit the majority over the XXH64 (seed 42) of a text's word
shingles. Two fingerprints of 64 bits with at most three differing bits, cut into
two segments of 32, have a segment that differs in at most one bit. Every distinct
fingerprint is indexed under each segment as it is and under the segment's 32
variants with one bit struck out; equality of a key finds every such pair: equal
segments meet under the plain key, segments that differ in bit i under variant i,
where only fingerprints of unlike bit i need comparing. Pairs are verified by the
number of differing bits of the whole fingerprint.

Scale: documents of one fingerprint are one entry, so copies don't multiply. Keys
that may be large are told by counts of plain segments, before the variants are
made, and are dealt over tasks by pairs of blocks of BLOCK; no task or window holds
more than two blocks of a key. A task returns the links' spanning forest, never
all pairs. Components come from distributed min-label rounds, and what belongs to a
fingerprint or component of very many rows is joined without moving these rows
(``join_dealt``). Texts aren't shuffled.

Cases: a null text is empty; a text without words has fingerprint zero, linked
like any other. A text of fewer words than a shingle is one shingle. A null id
keeps its row; it can't be a component's name unless all ids there are null.
Repeated rows keep their number, and of equal ids each row has its own class. Very
long texts are hashed in whole. An empty table gives an empty result. Extra columns
are kept, whatever their names; only one named as the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col, components, free, join_dealt, map_texts, materialize, prepare, table

SHINGLE = 3
MOST_BITS = 3
BLOCK = 8192
MOST_BROADCAST = 200_000  # rows of keys and block numbers


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass")
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = data.translate(words).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), 65536):
        ones += np.unpackbits(raw[i : i + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, prefix: str = "", shingle: int = SHINGLE) -> DataFrame:
    """Adds ``fp`` long: the fingerprint's 64 bits as a signed number."""

    def factory():
        def work(texts):
            found = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
            return [pa.array(found.view(np.int64))]

        return work

    return map_texts(df, text_col, T.StructType([T.StructField("fp", T.LongType())]), factory, keep, prefix)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For links (a, b) among 0 .. n - 1, each one's smallest member reachable."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while True:
        jump = label[label]
        if (jump == label).all():
            return label
        label = jump


def _links(fps: np.ndarray, first: np.ndarray, second: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in fps) of the pairs of first x second with at most ``most`` differing bits."""
    a, b = [], []
    for i in range(0, len(first), 512):
        x, y = np.nonzero(np.bitwise_count(fps[first[i : i + 512], None] ^ fps[None, second]) <= most)
        a.append(first[i + x])
        b.append(second[y])
    return np.concatenate(a), np.concatenate(b)


def _key(value: str, side: str, bit: str) -> Column:
    """A segment's value with one bit struck out (none if ``bit`` is -1), the bit and the segment's side in one number."""
    mask = F.when(F.col(bit) < 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, greatest({bit}, 0))"))
    return F.shiftleft(F.col(value).bitwiseAND(F.bitwise_not(mask)), 8).bitwiseOR((F.col(bit) + 1).cast("long") * 2 + F.col(side).cast("long"))


def variants(fps: DataFrame, fp: str = "fp", bits: int = 32) -> DataFrame:
    """Rows (key, bit, fp): both segments as they are (bit -1) and with each of the first ``bits`` bits struck out."""
    segments = F.array(F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32))
    one = fps.select(fp, F.posexplode(segments).alias("s", "v"))
    one = one.select(fp, "s", "v", F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))).alias("i"))
    bit = F.when(F.col("i") < 0, F.lit(-1)).otherwise(F.col("i") + 32 * F.col("s"))
    return one.select(_key("v", "s", "i").alias("key"), bit.cast("int").alias("bit"), F.col(fp))


def hot_keys(distinct_fps: DataFrame, block: int) -> DataFrame | None:
    """Rows (key, blocks) of the keys that may hold more than ``block`` fingerprints; None if there are none.

    A variant's fingerprints are those of two segments, so counts of the segments
    as they are (two rows a fingerprint, pre-aggregated) tell which keys are large.
    """
    plain = variants(distinct_fps, bits=0).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block // 2)
    plain = materialize(plain, "segments")
    if plain.isEmpty():
        return None
    value, side = F.shiftright("key", 8), F.col("key").bitwiseAND(F.lit(1))
    each = plain.select("n", value.alias("v"), side.alias("s"), F.explode(F.sequence(F.lit(-1), F.lit(31))).alias("i"))
    return each.select(_key("v", "s", "i").alias("key"), "n").groupBy("key").agg(F.ceil((F.sum("n") + block // 2) / block).cast("int").alias("blocks"))


def links(distinct_fps: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprint pairs with at most ``most`` (3 or fewer) differing bits."""
    if not 0 <= most <= 3:
        raise ValueError("two segments cover up to three differing bits")
    prepare(distinct_fps.sparkSession)
    keyed, hot = variants(distinct_fps), hot_keys(distinct_fps, block)
    if hot is None:
        dealt = keyed.select("key", "bit", "fp", *[F.lit(0).alias(c) for c in ("own", "x", "y")])
    else:
        hot = materialize(hot, "hot")
        if hot.count() <= MOST_BROADCAST:
            hot = F.broadcast(hot)
        keyed = keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        keyed = keyed.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = keyed.select("key", "bit", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("key", "bit", "fp", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    # Keys of one fingerprint go before Python sees them; no window holds more than two blocks.
    dealt = dealt.withColumn("n", F.count("*").over(Window.partitionBy("key", "x", "y"))).filter("n > 1").drop("n")
    dealt = dealt.sortWithinPartitions("key", "x", "y", "own", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(bit: int, fps: np.ndarray, own: np.ndarray, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
            fps = fps.view(np.uint64)
            place = np.arange(len(fps))
            if bit < 0:
                pairs = [(place[own == x], place[own == y])]
            else:
                half = (fps >> np.uint64(bit)) & np.uint64(1) == 1
                pairs = [(place[(own == x) & half], place[(own == y) & ~half])]
                if x != y:
                    pairs.append((place[(own == x) & ~half], place[(own == y) & half]))
            found = [_links(fps, a, b, most) for a, b in pairs if len(a) and len(b)]
            if not found:
                return fps[:0].view(np.int64), fps[:0].view(np.int64)
            label = forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), len(fps))
            tied = label != place
            return fps[tied].view(np.int64), fps[label[tied]].view(np.int64)

        def groups(cols: tuple[np.ndarray, ...], last: bool) -> tuple[list, tuple[np.ndarray, ...]]:
            key, bit, fp, own, x, y = cols
            change = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            marks = [0, *change.tolist(), *([len(key)] if last else [])]
            out = []
            sizes = np.diff(marks)
            if len(marks) > 1:
                starts = np.array(marks[:-1])
                two = starts[sizes == 2]  # most keys: a pair, for all of which one step does
                a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
                near = np.bitwise_count(a ^ b) <= most
                out.append((a[near].view(np.int64), b[near].view(np.int64)))
                for s, e in zip(starts[sizes > 2].tolist(), (starts + sizes)[sizes > 2].tolist(), strict=True):
                    out.append(solve(int(bit[s]), fp[s:e], own[s:e], int(x[s]), int(y[s])))
            rest = marks[-1]
            return out, tuple(c[rest:] for c in cols)

        def emit(found: list) -> Iterator[pa.RecordBatch]:
            a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            if len(a):
                pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        rows = 0
        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows >= 100_000:
                found, rest = groups(tuple(map(np.concatenate, zip(*held, strict=True))), False)
                held, rows = [rest], 0
                yield from emit(found)
        if held and sum(len(h[0]) for h in held):
            found, _ = groups(tuple(map(np.concatenate, zip(*held, strict=True))), True)
            yield from emit(found)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def classes(fps: DataFrame, id_col: str, fp_col: str = "fp", most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """``fps`` plus component_id: the smallest id reachable over links of at most ``most`` bits.

    A component_id that is there already, in any case, is replaced.
    """
    low, root, n = "low", "root", "n"
    one = materialize(fps.groupBy(col(fp_col).alias("fp")).agg(F.min(col(id_col)).alias(low), F.count("*").alias(n)), "fps")
    tree = components(links(one.select("fp"), most, block))
    named = materialize(one.join(tree, F.col("fp") == F.col("node"), "left").select("fp", low, n, F.coalesce("component", "fp").alias(root)), "roots")
    lows = materialize(named.groupBy(root).agg(F.min(low).alias("component_id"), F.count("*").alias("size")), "lows")
    total, rows = one.agg(F.count("*"), F.coalesce(F.sum(n), F.lit(0))).first()
    named = materialize(join_dealt(named.drop(low), lows, [root], "size", total).select("fp", n, "component_id"), "classes")
    kept = [c for c in fps.columns if c.lower() != "component_id"]
    base = fps.select(*[col(c) for c in kept])
    key, count = free(base, "fp_", "n_")
    named = named.select(F.col("fp").alias(key), F.col(n).alias(count), "component_id")
    found = join_dealt(base.withColumn(key, col(fp_col)), named, [key], count, rows)
    return found.select(*[col(c) for c in kept], "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = materialize(fingerprints(table(spark, sf_dir, "documents"), keep=["doc_id"]), "simhash")
    return classes(fps, "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
