"""Operator 13: how far the sources of a language are from one another, term by term.

Terms are runs of letters (A-Z lower-cased, every character beyond ASCII counts as a
letter). A language keeps the terms that at least ``least_docs`` of its documents
hold. In parts per 10^9 and exactly, each (language, source) group and each language
gives every kept term p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)).

Counting: every task adds up its texts' terms by group before anything is shuffled.
Comparing: a language's kept terms are cut into blocks by a hash and its sources into
tiles. Each (tile, tile, block) is a pair of dense int64 matrices, group by term, zero
counts included; all pairs of their rows are compared by broadcasting, which gives
the block's share of the pair matrix, and each group keeps its block's largest
deviations from the language. Spark sums the shares and merges the groups' heaps. A
matrix has about SOURCES x TERMS numbers, however many sources or terms there are, and
a language's blocks go to many tasks, so a language or source with most rows is no
hot spot. The work grows with the pairs of sources, as the result does.

Result rows (lang, source, part, item, value, rank): part ``pair`` has all other
sources of the language by distance, part ``term`` up to ``top`` terms that the group
has more often than its language. Ties go by item in UTF-8 byte order.

Cases: null text, lang and source are ''. A group without a term takes part with
counts of zero; without kept terms every distance is 0 and there are no terms. A
source that is alone in its language has no pairs. Repeated rows count each time. An
empty table gives an empty result. Very long texts are whole. Extra columns aren't
read. Counts are exact up to the range of 64-bit integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import col, join_dealt, materialize, prepare, table

#: Size of a matrix: sources of a tile and terms of a block, about.
SOURCES = 64
TERMS = 1024
#: Distinct (group, term) pairs that a task holds before it sends their counts on.
HELD = 300_000
SCALE = 1_000_000_000
SMOOTH = 5

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of this task's texts; a null term stands for the group itself."""
    held: dict = {}
    size = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(terms) + 1), pa.string()),
                    pa.array([source] * (len(terms) + 1), pa.string()),
                    pa.array([*terms, None], pa.binary()),
                    pa.array([*n.values(), 0], pa.int64()),
                    pa.array([*map(docs.__getitem__, terms), 0], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(_LETTERS).split()
            size -= len(n)
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size >= HELD:
                yield from sent()
                size = 0
    yield from sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """Occurrences and documents by (lang, source, term); a null term for each group."""
    prepare(docs.sparkSession)
    text = F.coalesce(col("text").cast("string"), F.lit("")).cast("binary")
    read = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text.alias("text"))
    parts = read.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def parts_per_billion(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exactly, with a total for each row."""
    over = total[:, None] + SMOOTH * terms
    count = count + SMOOTH
    if over.size and int(over.max()) >= 2**63 // 1000:
        return (1 + SCALE * count.astype(object) // over.astype(object)).astype(np.int64)
    whole, rest = np.divmod(count, over)
    for _ in range(3):  # a long division by thousands, so that no product passes 64 bits
        digit, rest = np.divmod(rest * 1000, over)
        whole = whole * 1000 + digit
    return 1 + whole


def _matrix(rows: pd.DataFrame, names: list, at: dict, terms: pd.Index) -> np.ndarray:
    dense = np.zeros((len(names), len(terms)), np.int64)
    dense[rows["source"].map(at).to_numpy(np.int64), terms.get_indexer(rows["term"])] = rows["n"].to_numpy()
    return dense


def _tile(top: int):
    """Compares two tiles of sources on one block of terms."""

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, first, second, _ = key
        totals, counts = rows[rows["term"].isna()], rows[rows["term"].notna()]
        terms = pd.Index(sorted(counts["term"].unique(), key=str.encode))
        of_lang = counts.drop_duplicates("term").set_index("term")["lang_n"].reindex(terms).to_numpy(np.int64)
        v = int(totals["v"].iloc[0])
        sides, out = {}, []
        for tile in {first, second}:
            mine = totals[totals["tile"] == tile]
            names = sorted(mine["source"], key=str.encode)
            at = {s: k for k, s in enumerate(names)}
            dense = np.pad(_matrix(counts[counts["tile"] == tile], names, at, terms), ((0, 0), (0, 1)))  # and a term with no occurrence
            total = mine.set_index("source")["n"].reindex(names).to_numpy(np.int64)
            sides[tile] = names, dense[:, :-1], parts_per_billion(dense, total, max(v, 1))
        (left, dense, p), (right, _, others) = sides[first], sides[second]
        # Terms of the block that only sources of other tiles have: all here give them the same share.
        unseen = int(totals["size"].iloc[0]) - len(terms)
        for k, name in enumerate(left):
            start = k + 1 if first == second else 0
            far = np.abs(others[start:] - p[k])
            far = far[:, :-1].sum(axis=1) + unseen * far[:, -1]
            out += [(lang, *pair, "pair", int(d)) for x, d in zip(right[start:], far, strict=True) for pair in ((name, x), (x, name))]
        if first == second and len(terms):
            q = parts_per_billion(of_lang[None, :], totals["lang_n"].iloc[:1].to_numpy(np.int64), v)[0]
            for k, name in enumerate(left):
                over = np.flatnonzero((dense[k] > 0) & (p[k, :-1] > q))
                gap = p[k][over] - q[over]
                best = np.argsort(-gap, kind="stable")[:top]  # terms are in byte order
                out += [(lang, name, terms[over[b]], "term", int(gap[b])) for b in best]
        return pd.DataFrame(out, columns=["lang", "source", "item", "part", "value"])

    return compare


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """Rows (lang, source, part, item, value, rank)."""
    counted = materialize(term_counts(docs), "terms")
    of_terms = counted.filter("term is not null").groupBy("lang", "term")
    kept = materialize(of_terms.agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count("*").alias("bearers")).filter(F.col("docs") >= least_docs).drop("docs"), "kept")
    total = kept.agg(F.sum("bearers")).first()[0] or 0
    # The terms of few documents, most of all, go before rows are joined to their language.
    rows = counted.filter("term is not null").drop("docs")
    rows = join_dealt(rows, kept, ["lang", "term"], "bearers", total).withColumn("term", F.col("term").cast("string"))
    rows = materialize(rows, "counts")
    groups = counted.filter("term is null").select("lang", "source")
    groups = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"])
    groups = materialize(groups, "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.sum("n").alias("lang_total"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("bearers").alias("bearers")), "lang", "left").fillna(0, ["v", "bearers"])
    langs = langs.withColumn("tiles", F.ceil(F.col("sources") / SOURCES).cast("int")).withColumn("blocks", F.greatest(F.ceil(F.col("v") / TERMS), F.lit(1)).cast("int"))
    langs = materialize(langs, "langs")

    tile = F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile")
    block = F.pmod(F.xxhash64("term"), "blocks").cast("int")
    full = join_dealt(rows, langs.select("lang", "tiles", "blocks", "v", "bearers"), ["lang"], "bearers", total)
    full = full.select("lang", "source", "term", "n", "lang_n", "v", "tiles", tile, block.alias("block"))
    sizes = join_dealt(kept.select("lang", "term"), langs.select("lang", "blocks", "v"), ["lang"], "v", total).withColumn("term", F.col("term").cast("string"))
    sizes = sizes.groupBy("lang", block.alias("block")).agg(F.count("*").alias("size"))
    heads = join_dealt(groups, langs.drop("bearers"), ["lang"], "sources", groups.count())
    heads = heads.select("lang", "source", F.lit(None).cast("string").alias("term"), "n", F.col("lang_total").alias("lang_n"), "v", "tiles", tile, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    heads = heads.join(sizes, ["lang", "block"], "left").fillna(0, ["size"])
    full = full.withColumn("size", F.lit(None).cast("long"))
    # Each tile meets every tile of its language once; itself, too.
    met = full.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.withColumns({"first": F.least("tile", "other"), "second": F.greatest("tile", "other")})
    made = met.groupBy("lang", "first", "second", "block").applyInPandas(_tile(top), "lang string, source string, item string, part string, value long")
    made = materialize(made, "tiles")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = made.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    best = made.filter("part = 'term'").select("lang", "source", "part", "item", "value")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(best)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_source_divergence": op13_source_divergence}

ORACLES = {
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
l AS (SELECT g.lang, coalesce(any_value(k.v), 0) AS v, coalesce(any_value(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM g) g
      LEFT JOIN (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang) k ON k.lang = g.lang GROUP BY g.lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v) AS q
  FROM s JOIN l ON l.lang = s.lang JOIN kept k ON k.lang = s.lang
  LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
}
