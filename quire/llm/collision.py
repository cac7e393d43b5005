"""Operator 3: embedding near-dedup by collision-counting projections.

Unit vectors of a label are projected on PROJECTIONS random lines. A projection
holds the others in sorted order, and a query's collisions there are the places in
a window centred on it; two vectors at the least cosine differ by a normal number
of known spread, so the window's width gives the chance of a collision, and the
number of collisions a pair must have is the largest that still finds a pair at
the threshold with probability RECALL (``calibrate``). Pairs that have it are
verified by their cosine in double precision. All lines are sorted, and pairs are
counted from the places in their windows (``near``).

Scale: exact copies of a vector are one entry. A label with more than CELL entries
is halved again and again by further projections, as often as its size asks for.
A cut stands where few entries are, and entries within half a zone of it go to
both sides, so that a near pair stays together on one side at least; the zone's
width keeps the recall lost over all cuts below LOSS (``zone``). Work and shuffle
grow as n to the power of 1.3 to 1.5 of a label's distinct vectors (isotropic
ones; less where they gather in clusters) instead of its square. A cell that stays
larger than CELL is dealt by pairs of blocks; so are cells of lengths of vectors beyond the
MOST_DIMS most frequent ones, which aren't cut. A pair that meets in several cells
counts in the one that takes the lower side of every cut whose zone holds both.
A task returns each entry's number of links and its links' spanning forest, never
pairs. Components come from distributed min-label rounds; rows find their entry by
``join_dealt``, so the copies of a vector stay where they are.

Cases: vectors that are null, zero, of null label or id, or with null or
non-finite components link with nothing and are their own component. Vectors of
unlike length don't link. Repeated rows are vectors of their own and link with each
other. Ids must be integers (else TypeError, before any work); rows of one id with
unlike vectors have their own numbers of links and one component. Only the four
result columns are returned, so extra columns can't clash. Empty tables give empty
results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import col, components, integer_ids, join_dealt, materialize, prepare, table
from quire.llm.simhash import MOST_BROADCAST, forest

COSINE = 0.98
PROJECTIONS = 16
RECALL = 0.9999
WIDTH = 3.0  # half a window, in spreads of a pair at the least cosine
LOSS = 5e-4  # of recall, by all cuts together
CELL = 2048
CUTS = 32  # projections that cells may be cut by
SHRINK = 0.62  # of a cut: the share of the entries on one side
BINS, REACH = 512, 4.0  # of the projections' counts; unit vectors' projections spread about 1
PAIRS = 1 << 20  # window places looked at together
MOST_DIMS = 32  # unlike lengths of vectors for which cuts are made


def calibrate(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The most collisions to ask for so that a pair at the threshold is found with probability ``recall``."""
    p = math.erf(width / math.sqrt(2))
    chance = 0.0
    for need in range(projections, 0, -1):
        chance += math.comb(projections, need) * p**need * (1 - p) ** (projections - need)
        if chance >= recall:
            return need
    return 1


def lines(dim: int, projections: int = PROJECTIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, projections))


def zone(spread: float, density: float, loss: float) -> float:
    """Width around a cut so that a pair ``spread`` apart (normal) stands across it with probability ``loss`` at most.

    Only pairs further apart than the zone is wide can, by the excess over it:
    the chance is the density at the cut times the mean excess.
    """
    if spread <= 0:
        return 0.0
    excess = lambda t: 2 * (math.exp(-t * t / 2) / math.sqrt(2 * math.pi) - t * 0.5 * math.erfc(t / math.sqrt(2)))
    t = 0.0
    while density * spread * excess(t) > loss and t < 8:
        t += 0.05
    return t * spread


def splits(n: int, cell: int = CELL) -> int:
    """Cuts for a label of n entries."""
    return 0 if n <= cell else min(CUTS, math.ceil(math.log(n / cell) / -math.log(SHRINK)))


def choose_cuts(counts: np.ndarray, spread: float, loss: float) -> list[tuple[int, float, float]]:
    """(projection, place, half a zone), best first, from counts (projections x BINS): few in the zone, sides of like size."""
    found = []
    step = 2 * REACH / BINS
    for k, row in enumerate(counts):
        total = row.sum()
        if not total:
            continue
        share = np.concatenate([[0.0], np.cumsum(row) / total])
        best = None
        for i in np.flatnonzero((share > 0.3) & (share < 0.7)):
            density = (share[min(BINS, i + 8)] - share[max(0, i - 8)]) / (16 * step)
            half = max(zone(spread, max(density, 0.25), loss) / 2, 0.0)
            bins = math.ceil(half / step)
            inside = share[min(BINS, i + bins)] - share[max(0, i - bins)]
            worst = max(share[i], 1 - share[i]) + inside / 2
            if best is None or worst < best[0]:
                best = (worst, k, -REACH + i * step, half)
        if best is not None and best[0] < 0.95:
            found.append(best)
    return [b[1:] for b in sorted(found)]


def flat(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of vectors of one length as a matrix of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


class Sorted:
    """Vectors on many lines: each line's order, each vector's place in it, and the windows of queries."""

    def __init__(self, vectors: np.ndarray, rays: np.ndarray) -> None:
        self.at = np.ascontiguousarray((vectors @ rays).T.astype(np.float32))
        self.order = np.argsort(self.at, axis=1, kind="stable")
        self.places = np.empty(self.order.shape, np.int32)
        np.put_along_axis(self.places, self.order, np.arange(self.order.shape[1], dtype=np.int32)[None, :], 1)

    def windows(self, queries: np.ndarray, half: np.float32) -> tuple[np.ndarray, np.ndarray]:
        """First place and end of each query's window on each line; ``queries`` is lines by vectors."""
        low, high = np.empty(queries.shape, np.int32), np.empty(queries.shape, np.int32)
        for d, mine in enumerate(queries):
            line = self.at[d, self.order[d]]
            low[d], high[d] = np.searchsorted(line, mine - half, "left"), np.searchsorted(line, mine + half, "right")
        return low, high


def near(a: np.ndarray, b: np.ndarray, cosine: float, need: int, rays: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of verified pairs of unit vectors a x b.

    Every line holds the vectors of b in order, and each of a has a window on it. A
    pair with ``need`` collisions is missing from k - need windows at most, so it
    stands in one of the first k - need + 1: the places of those windows are the
    pairs to be counted, each from the first window it stands in. On the lines in
    turn a pair's window either holds it or not; pairs that have missed too many go,
    and those with ``need`` collisions are verified.
    """
    half = np.float32(width * math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6)
    k = rays.shape[1]
    lines_of = Sorted(b, rays)
    low, high = lines_of.windows((a @ rays).T.astype(np.float32), half)
    xs, ys = [], []
    for first in range(k - need + 1):
        sizes = (high[first] - low[first]).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        s = 0
        while s < len(a):
            e = max(s + 1, int(np.searchsorted(upto, upto[s] + PAIRS, "right")) - 1)
            x = np.repeat(np.arange(s, e), sizes[s:e])
            y = lines_of.order[first][np.arange(len(x)) - np.repeat(upto[s:e] - upto[s], sizes[s:e]) + np.repeat(low[first, s:e], sizes[s:e])]
            missed = np.full(len(x), first, np.int8)
            for d in [*range(first), *range(first + 1, k)]:
                place = lines_of.places[d][y]
                out = (place < low[d][x]) | (place >= high[d][x])
                if d < first:  # in an earlier window: counted from there
                    x, y, missed = x[out], y[out], missed[out]
                    continue
                missed += out
                if d % 2 or d == k - 1:
                    left = missed <= k - need
                    x, y, missed = x[left], y[left], missed[left]
            for c in range(0, len(x), 50_000):
                ok = np.einsum("ij,ij->i", a[x[c : c + 50_000]], b[y[c : c + 50_000]]) >= cosine
                xs.append(x[c : c + 50_000][ok])
                ys.append(y[c : c + 50_000][ok])
            s = e
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def by_length(batch: pa.RecordBatch, sizes: str = "dim") -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(sizes).to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))


def cut_counts(entries: DataFrame, cuts: int = CUTS) -> DataFrame:
    """Rows (dim, k, bin, n): how the entries lie on each of the cutting lines, pre-aggregated in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in by_length(batch):
                p = units(flat(part.column("v"), dim)) @ lines(dim, cuts, 8)
                at = np.clip(((p + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1) + BINS * np.arange(cuts)
                held = total.setdefault(dim, np.zeros(cuts * BINS, np.int64))
                held += np.bincount(at.ravel(), minlength=cuts * BINS)
        for dim, held in total.items():
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), dim, np.int32)), pa.array(some.astype(np.int32)), pa.array(held[some])], names=["dim", "place", "n"])

    return entries.select("v", "dim").mapInArrow(run, "dim int, place int, n long").groupBy("dim", "place").agg(F.sum("n").alias("n"))


def to_cells(entries: DataFrame, cuts: dict[int, list[tuple[int, float, float]]], columns: list[str]) -> DataFrame:
    """``entries`` (with ``halvings``), each in all its cells: adds cell and both (the cuts whose zones hold it)."""
    fields = [entries.schema[c] for c in columns]
    schema = T.StructType([*fields, T.StructField("cell", T.LongType()), T.StructField("both", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                own = cuts.get(dim, [])
                n, halvings = part.num_rows, np.minimum(part.column("halvings").to_numpy(), len(own))
                row, cell, both = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
                if len(own) and halvings.max(initial=0) > 0:
                    p = units(flat(part.column("v"), dim)) @ lines(dim, CUTS, 8)
                    for i, (k, place, half) in enumerate(own[: int(halvings.max())]):
                        d, bit = p[:, k] - place, np.int64(1 << i)
                        cut = halvings > i
                        twice = cut & (np.abs(d) <= half)
                        both |= np.where(twice, bit, 0)
                        cell |= np.where((cut & (d > half))[row], bit, 0)
                        again = np.flatnonzero(twice[row])
                        row, cell = np.concatenate([row, row[again]]), np.concatenate([cell, cell[again] | bit])
                out = part.select(columns)
                for at in range(0, len(row), 4096):
                    some = row[at : at + 4096]
                    made = out.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array(cell[at : at + 4096]), pa.array(both[some])], names=schema.names)

    return entries.mapInArrow(run, schema)


def link(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, projections: int = PROJECTIONS, recall: float = RECALL, width: float = WIDTH, cell: int = CELL, loss: float = LOSS) -> DataFrame:
    """One row a vector: its id, n_links, component_id and kept."""
    spark = prepare(df.sparkSession)
    need = calibrate(projections, width, recall)
    kind = df.select(col(vector_col)).schema[0].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = df.select(integer_ids(df, id_col).alias("id"), col(label_col).cast("string").alias("label"), col(vector_col).cast("array<float>" if floats else "array<double>").alias("v"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce(good & finite, F.lit(False))
    entries = rows.filter(good).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    entries = materialize(entries.withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("label", "v")), "entries")

    # Labels that don't fit a cell, and how often to halve them.
    sizes = entries.groupBy("label", "dim").agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
    large = materialize(sizes.filter(F.col("n") > cell), "labels")
    few = large.count()
    columns = ["label", "v", "rep", "copies", "dim", "h"]
    if few:
        halvings = F.least(F.ceil(F.log(F.col("n") / cell) / -math.log(SHRINK)), F.lit(CUTS)).cast("int")
        large = large.select("label", "dim", halvings.alias("halvings"))
        marked = entries.join(F.broadcast(large) if few <= MOST_BROADCAST else large, ["label", "dim"], "left").fillna(0, ["halvings"])
        dims = [r[0] for r in large.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_DIMS).collect()]
        most = large.agg(F.max("halvings")).first()[0]
        held = {d: np.zeros(CUTS * BINS) for d in dims}
        for r in cut_counts(entries.filter(F.col("dim").isin(dims))).collect():  # CUTS x BINS numbers a length
            held[r["dim"]][r["place"]] = r["n"]
        spread = math.sqrt(max(0.0, 2 - 2 * cosine))
        cuts = {d: choose_cuts(x.reshape(CUTS, BINS), spread, loss / most) for d, x in held.items()}
        sized = to_cells(marked, cuts, ["label", "dim"]).groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * cell)
        full = materialize(sized.select("label", "dim", "cell", F.ceil(F.col("n") / (2 * cell)).cast("int").alias("blocks")), "cells")
        work = to_cells(marked, cuts, columns)
        many = full.count()
        if many:
            work = work.join(F.broadcast(full) if many <= MOST_BROADCAST else full, ["label", "dim", "cell"], "left").fillna(1, ["blocks"])
            work = work.withColumn("own", F.pmod(F.xxhash64("rep", "h"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            work = work.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
        else:
            work = work.select("*", *[F.lit(0).alias(c) for c in ("own", "x", "y")])
    else:
        work = entries.select("*", *[F.lit(0).cast("long").alias(c) for c in ("cell", "both")], *[F.lit(0).alias(c) for c in ("own", "x", "y")])
    group = ["label", "dim", "cell", "x", "y"]
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = work.select(*group, "own", "both", "rep", "copies", "h", "v").repartition(n_tasks, *group).sortWithinPartitions(*group)

    def solve(part: pa.RecordBatch) -> pa.RecordBatch | None:
        dim, x, y, code = (part.column(c)[0].as_py() for c in ("dim", "x", "y", "cell"))
        own, both, rep, copies, h = (part.column(c).to_numpy() for c in ("own", "both", "rep", "copies", "h"))
        if len(rep) < 2:
            return None
        vectors, rays = units(flat(part.column("v"), dim)), lines(dim, projections)
        first, second = np.flatnonzero(own == x), np.flatnonzero(own == y)
        i, j = near(vectors[first], vectors[second], cosine, need, rays, width)
        a, b = first[i], second[j]
        once = (both[a] & both[b] & code) == 0  # else the pair counts on the lower side of that cut
        if x == y:
            once &= a < b
        a, b = a[once], b[once]
        if not len(a):
            return None
        links = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(rep), np.int64)
        rank[order] = np.arange(len(rep))
        root = rep[order][forest(rank[a], rank[b], len(rep))][rank]
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(h[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["rep", "h", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in group], strict=True))
            marks = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for s, e in zip(marks, marks[1:], strict=False):
                if s == e:
                    continue
                if keys[s] != last:
                    if held and (out := solve(pa.concat_batches(held))) is not None:
                        yield out
                    held, last = [], keys[s]
                held.append(batch.slice(s, e - s))
        if held and (out := solve(pa.concat_batches(held))) is not None:
            yield out

    found = materialize(work.mapInArrow(run, "rep long, h long, links long, root long"), "collisions")
    tree = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    result = entries.select("rep", "h", "label", "v", "copies").join(totals, ["rep", "h"], "left").join(tree, F.col("rep") == F.col("node"), "left")
    result = result.select("label", "v", "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    result = materialize(result, "linked")
    total = result.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    joined = join_dealt(rows.filter(good), result, ["label", "v"], "copies", total).select("id", "n_links", "component_id")
    joined = joined.unionByName(rows.filter(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return joined.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_collision_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_collision_dedup": op3_collision_dedup}
ORACLES: dict[str, str] = {}
