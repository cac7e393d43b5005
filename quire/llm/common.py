"""What several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.session import materialize, shared_dir, ship, table

__all__ = ["col", "components", "crc_mod", "free", "held", "integer_ids", "join_dealt", "map_texts", "materialize", "prepare", "share_of_rows", "shared_dir", "table"]

SLICE_ROWS = 256
SLICE_CHARS = 4_000_000
HOT_ROWS = 50_000


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and keep Arrow batches small enough for very long texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def col(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: What this worker keeps for later tasks: a single thing, that of the operator it last worked for.
_HELD: dict = {}
_USES = [0]


def held(key: tuple, make: Callable[[], object]) -> object:
    """``make()``'s result, kept for this worker's later tasks until a task of another operator comes.

    Stages share workers, so what all of them kept would add up in an executor's memory.
    """
    _USES[0] += 1
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drop what the worker keeps and give its memory back."""
    if _HELD:
        _HELD.clear()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def begun(factory: Callable[[], Callable]) -> Callable:
    """``factory()`` at the start of a task; what the worker keeps for another operator goes."""
    uses = _USES[0]
    work = factory()
    if _USES[0] == uses:
        let_go()
    return work


def integer_ids(df: DataFrame, name: str) -> Column:
    """An integer column as long; other types raise a TypeError before any work is done."""
    kind = df.select(col(name)).schema[0].dataType
    if not (isinstance(kind, T.IntegralType | T.NullType) or isinstance(kind, T.DecimalType) and kind.scale == 0):
        raise TypeError(f"{name} has type {kind.simpleString()}; ids must be integers")
    return col(name).cast("long")


def join_dealt(rows: DataFrame, other: DataFrame, keys: Sequence[str], count: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join in which no key's rows come together in one task.

    ``other`` has each key once and, in ``count``, the number of rows that bear it.
    Keys with more than ``hot_rows`` rows and a thousandth of all ``total`` rows are
    fewer than a thousand and are broadcast, so their rows stay where they are; the
    others are shuffled. Both inputs should be tables or cheap, as they are read twice.
    """
    least = max(hot_rows, total // 1000)
    if total <= least or other.filter(F.col(count) > least).isEmpty():
        return rows.join(other.drop(count), list(keys))
    hot = F.broadcast(other.filter(F.col(count) > least).drop(count))
    near = rows.join(hot, list(keys))
    far = rows.join(hot.select(*[col(k) for k in keys]), list(keys), "left_anti").join(other.filter(F.col(count) <= least).drop(count), list(keys))
    return near.unionByName(far)


def crc_mod(name: str, divisor: int) -> Column:
    """crc32 of a column's decimal text, modulo ``divisor``; a null gives null."""
    return F.crc32(col(name).cast("string").cast("binary")) % divisor


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of at most SLICE_ROWS texts and about SLICE_CHARS characters; a longer text has a range of its own."""
    start = chars = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and (i - start >= SLICE_ROWS or chars + n > SLICE_CHARS):
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    text_col: str,
    fields: T.StructType,
    factory: Callable[[], Callable[[list[str | None]], Sequence]],
    keep: Sequence[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """``df`` with columns computed from whole texts, without a shuffle.

    ``factory`` runs once in a task and returns a function from a list of texts to
    one sequence per field. ``keep`` names the input columns to retain (all if
    None). A result column, named ``prefix`` + field, replaces an input column of
    the same name. Texts of other types are cast to string.
    """
    prepare(df.sparkSession)
    out = T.StructType([T.StructField(prefix + f.name, f.dataType, True) for f in fields.fields])
    taken = {f.name.lower() for f in out.fields}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    # mapInArrow takes plain names only, so columns have numbers on their way.
    source = df.select(*[col(c).alias(f"c{k}") for k, c in enumerate(names)], col(text_col).cast("string").alias("text"))
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begun(factory)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for start, stop in slices(texts):
                made = work(texts[start:stop])
                arrays = [c.slice(start, stop - start) for c in batch.columns[:-1]]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    made = [T.StructField(f"m{k}", f.dataType, True) for k, f in enumerate(out.fields)]
    schema = T.StructType([*source.schema.fields[:-1], *made])
    return source.mapInArrow(run, schema).toDF(*names, *out.names)


def share_of_rows(df: DataFrame, keys: Sequence[str], by: Sequence[str], most: int, groups: DataFrame | None = None) -> DataFrame:
    """About ``most`` rows of each group of ``by``, by a hash of ``keys``; all rows of smaller groups.

    The share of each group comes from its count, so no group is gathered in a
    task, and the choice depends on the keys alone: rows of equal keys are chosen
    together, so ``keys`` should tell rows apart. ``groups`` (``by`` and the count
    as the last column) leaves out all other groups; there must be few of them.
    """
    if groups is None:
        groups = df.groupBy(*[col(c) for c in by]).agg(F.count("*"))
    count = free(df, "n")[0]
    groups = groups.toDF(*by, count)
    scale = 1 << 30
    picked = df.join(F.broadcast(groups), list(by))
    place = F.pmod(F.xxhash64(*[col(k).cast("string") for k in keys], F.lit("share")), F.lit(scale))
    return picked.filter(place.cast("double") * F.col(count) < F.lit(float(most) * scale)).drop(count)


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Connected components of ``edges`` (a, b as long): rows (node, component), the smallest node of each.

    Alternating large-star and small-star rounds. A round takes the minimum over
    each node's neighbours (pre-aggregated before the shuffle) and gives it back to
    the node's edges by ``join_dealt``: the edges of nodes with very many of them
    stay where they are. Each round's edges are written to the shared folder. Nodes
    without an edge don't appear.
    """
    spark = edges.sparkSession
    kept = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = materialize(kept, "edges")
    seen, total = None, kept.count()
    while True:
        both = kept.union(kept.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        low = materialize(low, "low") if 2 * total > hot_rows else low
        large = join_dealt(both, low, ["a"], "n", 2 * total, hot_rows).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # In small-star a node's smaller neighbours and the node itself go to the smallest of them.
        large = materialize(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        low = materialize(low, "low") if 2 * total > hot_rows else low
        down = join_dealt(large, low, ["a"], "n", 2 * total, hot_rows).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = materialize(down.union(low.select("a", "m")).distinct(), "small")
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, total = now, now[0]
    roots = kept.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return spark.createDataFrame([], "node long, component long").union(kept.select("a", "b")).union(roots)
