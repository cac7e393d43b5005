"""Operator 7: quality rules by compression bands, beside counted rules.

Method: zstandard's ratio (bytes to compressed bytes) of the whole document and of
each fixed chunk of CHUNK bytes, the shorter rest at the end included. Repetitive text
and text full of symbols compresses too well, noise too little. What is usual grows
with length, so lengths fall into bands (four to a doubling), each with limits of its
own. They are calibrated on the table itself (``calibrate``): of all distinct texts
that pass the counted rules, a band's median ratio and its spread (the median less
the 16 % quantile), smoothed over neighbouring bands; the limits lie LOW and HIGH
spreads from the median. A document is rejected if its whole ratio leaves its band,
or if more than CHUNK_SHARE of its bytes stand in chunks that leave the band of
their length.

Counted rules: words, code points in words, symbols, repeated lines, and words in
8-word windows that occur twice or more. Windows are compared exactly: a rolling
hash only finds where to compare.

Scale: one pass over the texts measures them; what it leaves (a few numbers a
document and chunk) is kept in a table, from which bands are calibrated and verdicts
taken as column expressions. Copies of a text count once in the bands, by a hash of
the text, whose shuffle has a row of numbers a document. Quantiles are approximate
and pre-aggregated.

Cases: a null text has no words (base_failed). Bands with fewer than LEAST_TEXTS
distinct texts take the limits of the nearest band that has them, beyond the longest
and shortest with the trend of ratios on the side it widens; if none has (small
or empty tables), the fixed BANDS hold. Repeated rows give repeated results; very
long texts are processed in whole, in memory in proportion to their length. Extra
columns are kept whatever their names; those named as a result, in any case, are
replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col, free, map_texts, materialize, table

CHUNK = 4096
CHUNK_SHARE = 0.15
LEVEL = 3
LOW, HIGH = 6.0, 4.0  # spreads from the median to the limits
LEAST_SPREAD = 0.02  # of the median
LEAST_TEXTS = 30
STEPS, MOST_BANDS = 4, 140  # bands to a doubling of length, bands in all
#: Limits where nothing can be calibrated: (bytes up to, lowest and highest ratio).
BANDS = ((150, 0.0, 2.5), (300, 1.05, 3.0), (1000, 1.15, 3.5), (3000, 1.35, 4.0), (10_000, 1.45, 4.5), (None, 1.45, 5.0))
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CHUNKS = T.ArrayType(T.StructType([T.StructField("size", T.IntegerType()), T.StructField("ratio", T.DoubleType())]))
FIELDS = T.StructType([
    *[T.StructField(n, T.LongType()) for n in COUNTS], T.StructField("base_failed", T.BooleanType()), T.StructField("ratio", T.DoubleType()),
    T.StructField("n_bytes", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("chunks", CHUNKS),
])
RESULTS = (*COUNTS, "base_failed", "kept", "ratio", "bad_chunks")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that stand twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    h, width, factor = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15), 1, 0xD6E8FEB86659FD93
    for _ in range(window - 1):
        h = h[:-1] * np.uint64(factor) + ids[width:].astype(np.uint64)
        width += 1
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    first, second = order[:-1][same], order[1:][same]
    if not all((ids[first + k] == ids[second + k]).all() for k in range(window)):  # unlike windows of one hash: count them themselves
        seen: dict[bytes, list[int]] = {}
        for i in range(n):
            seen.setdefault(ids[i : i + window].tobytes(), []).append(i)
        twice = np.array([i for places in seen.values() if len(places) > 1 for i in places], np.int64)
    else:
        twice = np.concatenate([first, second])
    mark = np.zeros(len(words) + 1, np.int64)
    starts = np.zeros(n, bool)
    starts[twice] = True
    places = np.flatnonzero(starts)
    mark[places] += 1  # each place once
    mark[places + window] -= 1
    return int((np.cumsum(mark)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def ratios(data: bytes, compress, chunk: int = CHUNK) -> tuple[float, list[dict]]:
    """The whole ratio (0 for no bytes), and size and ratio of each chunk."""
    if not data:
        return 0.0, []
    whole = len(data) / len(compress(data))
    if len(data) <= chunk:
        return whole, [{"size": len(data), "ratio": whole}]
    parts = (data[i : i + chunk] for i in range(0, len(data), chunk))
    return whole, [{"size": len(p), "ratio": len(p) / len(compress(p))} for p in parts]


def measure(df: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, prefix: str = "", chunk: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """Adds FIELDS: the counts, base_failed, ratio, n_bytes, text_hash and chunks (size, ratio)."""

    def factory():
        import xxhash
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress

        def one(text: str | None) -> tuple:
            text = text or ""
            data = text.encode("utf-8", "surrogatepass")
            words = data.split()
            n = len(words)
            spaces = len(data) - sum(map(len, words))
            symbols = len(data) - len(data.translate(None, SYMBOLS))
            repeated = repeated_words(words)
            failed = n < 20 or 100 * repeated > 30 * n
            return n, len(text) - spaces, symbols, duplicate_lines(text), repeated, failed, *(r := ratios(data, compress, chunk))[:1], len(data), xxhash.xxh64_intdigest(data) - (1 << 63), r[1]

        return lambda texts: list(zip(*map(one, texts), strict=True))

    return map_texts(df, text_col, FIELDS, factory, keep, prefix)


def band(size: Column) -> Column:
    """The band of a length in bytes."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * STEPS), F.lit(MOST_BANDS - 1)).cast("int")


class Limits:
    """Lowest and highest ratio of each band."""

    def __init__(self, low: Sequence[float], high: Sequence[float]) -> None:
        self.low, self.high = list(low), list(high)

    @classmethod
    def fixed(cls, bands=BANDS) -> Limits:
        middle = [2 ** ((k + 0.5) / STEPS) for k in range(MOST_BANDS)]
        found = [next((a, b) for top, a, b in bands if top is None or n < top) for n in middle]
        return cls(*zip(*found, strict=True))

    def inside(self, size: Column, ratio: Column) -> Column:
        at = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), band(size))
        return (size == 0) | ratio.between(at(self.low), at(self.high))


def calibrate(measured: DataFrame, prefix: str = "", low: float = LOW, high: float = HIGH, least: int = LEAST_TEXTS) -> Limits:
    """Limits from the distinct texts of ``measured`` (with FIELDS) that pass the counted rules."""
    c = lambda name: col(prefix + name)
    good = measured.filter(~c("base_failed") & (c("n_bytes") > 0)).select(c("n_bytes").alias("n"), c("ratio").alias("r"), c("text_hash").alias("h"))
    once = good.groupBy("h", "n").agg(F.first("r").alias("r"))
    rows = once.groupBy(band(F.col("n")).alias("band")).agg(F.count("*").alias("texts"), F.percentile_approx("r", F.array(F.lit(0.16), F.lit(0.5)), F.lit(2000)).alias("q")).collect()  # MOST_BANDS rows at most
    known = {r["band"]: (r["q"][1], (r["q"][1] - r["q"][0]) / r["q"][1]) for r in rows if r["texts"] >= least}
    if not known:
        return Limits.fixed()
    first, last = min(known), max(known)
    lows, highs = [], []
    for k in range(MOST_BANDS):
        near = min(known, key=lambda b: (abs(b - k), b))
        middle, spread = known[near][0], max(LEAST_SPREAD, float(np.median([known[b][1] for b in known if abs(b - near) <= 2])))
        # Ratios go on growing with length where no band tells: only the limit on that side follows.
        end = sorted(known)[-6:] if k > last else sorted(known)[:6]
        slope = max(0.0, float(np.polyfit(end, [known[b][0] for b in end], 1)[0])) if len(end) > 1 and not first <= k <= last else 0.0
        lows.append(max(0.0, middle + slope * min(0, k - near)) * max(0.0, 1 - low * spread))
        highs.append((middle + slope * max(0, k - near)) * (1 + high * spread))
    return Limits(lows, highs)


def verdicts(measured: DataFrame, limits: Limits, inner: str = "", prefix: str = "", chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """``measured`` with RESULTS (named by ``prefix``) instead of FIELDS (named by ``inner``)."""
    c = lambda name: col(inner + name)
    bad = F.filter(c("chunks"), lambda x: ~limits.inside(x["size"], x["ratio"]))
    lost = F.aggregate(bad, F.lit(0).cast("long"), lambda total, x: total + x["size"])
    taken = {(inner + f.name).lower() for f in FIELDS.fields} | {(prefix + name).lower() for name in RESULTS}
    (found,) = free(measured, "found")
    made = measured.withColumn(found, F.struct(F.size(bad).cast("long").alias("bad"), lost.alias("lost")))
    kept = ~c("base_failed") & limits.inside(c("n_bytes"), c("ratio")) & (col(found)["lost"] <= c("n_bytes") * F.lit(chunk_share))
    result = {"kept": kept, "bad_chunks": col(found)["bad"]}
    return made.select(*[col(x) for x in measured.columns if x.lower() not in taken], *[(result[n] if n in result else c(n)).alias(prefix + n) for n in RESULTS])


def rules(df: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None, prefix: str = "", limits: Limits | None = None, chunk: int = CHUNK, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """Adds the counts, base_failed, kept, ratio and bad_chunks; without ``limits`` they are calibrated on ``df`` first."""
    if limits is None:
        limits = calibrate(measure(df, text_col, [], chunk=chunk))
    inner = "measured_"
    while any(c.lower().startswith(inner) for c in df.columns):
        inner += "_"
    return verdicts(measure(df, text_col, keep, inner, chunk), limits, inner, prefix, chunk_share)


def op7_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are measured once; the table of numbers serves the bands and the verdicts.
    measured = materialize(measure(table(spark, sf_dir, "documents"), keep=["doc_id"]), "measured")
    return verdicts(measured, calibrate(measured))


QUERIES = {"op7_quality_bands": op7_quality_bands}
ORACLES: dict[str, str] = {}
