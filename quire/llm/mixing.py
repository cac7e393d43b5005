"""Operator 2: mixing sources to target weights by Pfair scheduling.

The documents of a source, in an order given by a hash of their ids, form blocks of
``block`` documents. Block j of a source with share w has release time floor(j / w)
and deadline ceil((j + 1) / w), counted in blocks of output; in each time slot, of
the released blocks the one with the earliest deadline is emitted, which keeps every
source within less than one block of its share at any time.

There are two rules, and the caller names one; the size of the input never does. With
``own_windows`` every source has windows of its own: earliest deadline first decides
among all of them, and equal deadlines go to the source with more blocks, then by name.
Without, sources of equal weight form a class. Classes are scheduled earliest deadline
first by their summed weights; within a class, blocks j of all its sources stand
in turn, sources with more blocks first, so a source's lag stays below one block
(its turn in the class adds less than what the class's lag leaves of a block), and when
a source has no blocks left the others of its class take its share. When a class (or a
source with windows of its own) has none left a new phase begins, in which the others
share its weight in proportion: every document is emitted exactly once.

Weights are exact fractions (of a float, the decimal number it is written as). A
schedule repeats after as many slots as the whole parts of the phase's classes (or
sources) sum to; only one period is made. A period beyond MOST_PLACES is followed
through instead and written to a table by pieces. There are as many classes as
unlike stated weights, and one more; sources may be any number. The driver holds a
number for each unlike number of blocks that sources of a class have (at most the
root of twice the blocks, as that many unlike numbers add up to the blocks), and the
places of a period.

Each source with windows of its own ends a phase, so beyond FEW_SOURCES of them periods
aren't worth making: the same schedule is followed through block by block and written
to a table. The driver then holds a few numbers a source (no names) and takes a step a
block, and one a phase and unlike weight.

A source's order needs no single task: documents fall into buckets by the leading
bits of their hash, buckets are numbered from counts, and ranks are taken within
(source, bucket), so a source with a third of all rows is dealt over many tasks. The
hash is of the id and, if the rows come from files, of the stretch of a file that a task
reads: rows that share an id fall into as many buckets as there are such stretches.

Cases: null sources are one source of their own (named by None in ``weights``).
Sources without a stated weight have weight 1: by default all sources weigh the
same. Repeated rows have ranks of their own, ties go by the whole row's hash; null
ids are ids like others. Very long texts only pass through. Empty tables give empty
results. Extra columns are kept whatever their names; those named as a result, in
any case, are replaced by it.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
import uuid
from array import array
from collections.abc import Callable, Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import col, free, materialize, prepare, table
from quire.session import delete_on_exit, shared_dir

BLOCK = 16
#: Sources with windows of their own whose phases are kept as periods; of more the same schedule is followed through.
FEW_SOURCES = 256
MOST_PLACES = 1 << 20
CHUNK = 4096  # places in a row of the table of a long period
PIECE = 1 << 18  # blocks that are written to a table at once
MOST_BROADCAST = 400_000  # rows of sources, buckets and numbers


def exact(weights: Sequence[Fraction]) -> list[int]:
    """The least whole numbers in the proportions of ``weights``."""
    common = math.lcm(*[w.denominator for w in weights])
    whole = [int(w * common) for w in weights]
    return [x // math.gcd(*whole) for x in whole]


def slots(parts: list[int], blocks: list[int] | None = None) -> Iterator[int]:
    """Who is served in each slot, earliest deadline first among released blocks: for one period, or until one has emitted its ``blocks``."""
    total = sum(parts)
    ready: list[tuple[int, int]] = []
    later = [(0, i) for i in range(len(parts))]
    heapq.heapify(later)
    done, slot = [0] * len(parts), 0
    while blocks is not None or slot < total:
        while later and later[0][0] <= slot:
            _, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // parts[i]), i))
        _, i = heapq.heappop(ready)
        yield i
        slot += 1
        done[i] += 1
        if blocks is not None and done[i] == blocks[i]:
            return
        heapq.heappush(later, (done[i] * total // parts[i], i))


def followed(blocks: Sequence[int], kinds: Sequence[int], parts: Sequence[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) of every block in turn, if all sources have windows of their own.

    Sources stand in the order that decides between equal deadlines; ``kinds`` are
    their weights' places in ``parts``. In a phase all sources of a weight have the
    same windows and take turns in their order, so a weight's next block stands for all of them.
    """
    left, done, start = list(blocks), [0] * len(blocks), 0
    first, after, before = [-1] * len(parts), [-1] * len(blocks), [-1] * len(blocks)
    last = list(first)
    for i, k in enumerate(kinds):
        if last[k] < 0:
            first[k] = i
        else:
            after[last[k]], before[i] = i, last[k]
        last[k] = i
    total = sum(parts[k] for k in kinds)
    while total:
        ready = [(-(-total // a), i, k, 0) for k, (i, a) in enumerate(zip(first, parts, strict=True)) if i >= 0]
        heapq.heapify(ready)
        later: list[tuple[int, int, int]] = []  # release, weight, round
        slot = 0
        while True:
            while later and later[0][0] <= slot:
                _, k, j = heapq.heappop(later)
                heapq.heappush(ready, (-(-(j + 1) * total // parts[k]), first[k], k, j))
            deadline, i, k, j = ready[0]
            yield i, done[i], start + slot, start + j * total // parts[k], start + deadline
            slot += 1
            done[i] += 1
            left[i] -= 1
            if not left[i]:
                break
            if after[i] >= 0:
                heapq.heapreplace(ready, (deadline, after[i], k, j))
            else:
                heapq.heappop(ready)
                heapq.heappush(later, ((j + 1) * total // parts[k], k, j + 1))
        if before[i] >= 0:
            after[before[i]] = after[i]
        else:
            first[k] = after[i]
        if after[i] >= 0:
            before[after[i]] = before[i]
        start += slot
        total -= parts[k]


class Phase:
    """What classes emit from slot ``start`` on: class -> (first block, parts, places in a period; None if they are in the table)."""

    def __init__(self, start: int, size: int) -> None:
        self.start, self.size, self.of = start, size, {}


def phases(blocks: Sequence[int], weights: Sequence[Fraction], most: int = MOST_PLACES) -> Iterator[Phase | tuple[int, int, int, array]]:
    """The phases in turn; of a phase that doesn't repeat, before it, rows (class, phase, chunk, slots)."""
    left, first, start, number = list(blocks), [0] * len(blocks), 0, 0
    while any(left):
        live = [i for i, n in enumerate(left) if n]
        parts = exact([weights[i] for i in live])
        size, own = sum(parts), [left[i] for i in live]
        phase = Phase(start, size)
        if size <= most:
            places = [array("q") for _ in live]
            for slot, k in enumerate(slots(parts)):
                places[k].append(slot)
            # The phase ends with the slot in which the first class emits its last block.
            end = min(size * ((n - 1) // a) + p[(n - 1) % a] for n, a, p in zip(own, parts, places, strict=True)) + 1
            served = [end // size * a + bisect.bisect_left(p, end % size) for a, p in zip(parts, places, strict=True)]
        else:
            places, served, end, pieces = [None] * len(live), [0] * len(live), 0, [array("q") for _ in live]
            for end, k in enumerate(slots(parts, own), 1):
                pieces[k].append(start + end - 1)
                served[k] += 1
                if len(pieces[k]) == CHUNK:
                    yield live[k], number, (served[k] - 1) // CHUNK, pieces[k]
                    pieces[k] = array("q")
            for k, piece in enumerate(pieces):
                if piece:
                    yield live[k], number, (served[k] - 1) // CHUNK, piece
        for k, i in enumerate(live):
            if served[k]:
                phase.of[i] = (first[i], parts[k], None if places[k] is None else np.array(places[k]))
            first[i] += served[k]
            left[i] -= served[k]
        yield phase
        start += end
        number += 1


class Plan:
    """Places of blocks: rounds of each class (from counts of sources by their number of blocks) and the classes' phases."""

    def __init__(self, counts: Sequence[Mapping[int, int]], weights: Sequence[Fraction], most: int = MOST_PLACES) -> None:
        self.rounds = []  # of each class: ends of stretches of rounds, class blocks before each stretch, sources in it
        for held in counts:
            ends = np.array(sorted(held), np.int64)
            live = np.cumsum(np.array([held[v] for v in ends.tolist()], np.int64)[::-1])[::-1]
            begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            self.rounds.append((ends, begin, np.concatenate([[0], np.cumsum(live * (ends - begin))]).astype(np.int64), live))
        self.blocks = [int(r[2][-1]) for r in self.rounds]
        self.weights = [w * sum(held.values()) for w, held in zip(weights, counts, strict=True)]
        self.most, self.phases = most, []

    def ahead(self, k: int, v: int) -> int:
        """Sources of class k with more than v blocks."""
        ends, _, _, live = self.rounds[k]
        at = int(np.searchsorted(ends, v, "right"))
        return int(live[at]) if at < len(ends) else 0

    def make(self) -> Iterator[tuple[int, int, int, array]]:
        """Make the phases; yields the rows of the table of long periods."""
        for made in phases(self.blocks, self.weights, self.most):
            if isinstance(made, Phase):
                self.phases.append(made)
            else:
                yield made

    def places(self, classes: np.ndarray, j: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
        """Slot (-1: in the table), release, deadline, phase and place in it of block j of the source with ``rank`` in its class."""
        out = np.full((5, len(j)), -1, np.int64)
        for k in np.unique(classes).tolist():
            some = np.flatnonzero(classes == k)
            ends, begin, before, live = self.rounds[k]
            at = np.searchsorted(ends, j[some], "right")
            low = before[at] + (j[some] - begin[at]) * live[at]
            mine = low + rank[some]
            for number, phase in enumerate(self.phases):
                if k not in phase.of:
                    continue
                first, a, held = phase.of[k]
                until = next((p.of[k][0] for p in self.phases[number + 1 :] if k in p.of), self.blocks[k])
                inside = (mine >= first) & (mine < until)
                x, rows = mine[inside] - first, some[inside]
                if held is not None:
                    out[0, rows] = phase.start + phase.size * (x // a) + held[x % a]
                # Whole numbers of any size: parts and their sum may be large.
                opens = np.maximum(low[inside] - first, 0)
                shuts = np.minimum(low[inside] + live[at][inside], until) - first
                out[1, rows] = phase.start + times(opens, phase.size, a, False)
                out[2, rows] = phase.start + times(shuts, phase.size, a, True)
                out[3, rows], out[4, rows] = number, x
        return pd.DataFrame(out.T, columns=["slot", "release", "deadline", "phase", "at"])


def times(n: np.ndarray, size: int, a: int, up: bool) -> np.ndarray:
    """floor or ceil of n * size / a, exactly."""
    if len(n) and int(n.max()) * size >= 1 << 62:
        return np.array([-(-x * size // a) if up else x * size // a for x in n.tolist()], np.int64)
    return -(-n * size // a) if up else n * size // a


def numbered(df: DataFrame, by: Sequence[str], place: str, ties: Sequence, name: str, most: int, groups: int, extra: DataFrame | None = None) -> DataFrame:
    """Adds ``name``, each row's number from 0 within its group in the order of ``place`` (a random long), without a task a group.

    ``most`` is the rows of the largest group, ``groups`` their number. ``extra``
    has a row a group, with columns to add to the group's rows.
    """
    bits = most.bit_length() // 2  # as many buckets as rows in one, about
    while bits and groups << bits > MOST_BROADCAST and most >> bits < 1 << 20:
        bits -= 1
    bucket, before = free(df, "bucket", "before")
    df = df.withColumn(bucket, F.shiftrightunsigned(place, 64 - bits) if bits else F.lit(0).cast("long"))
    # Rows before each bucket of a group: a window over counts, a row a bucket.
    sizes = df.groupBy(*by, bucket).agg(F.count("*").alias(before))
    upto = F.sum(before).over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn(before, F.coalesce(upto, F.lit(0)))
    if extra is not None:
        sizes = sizes.join(extra, list(by))
    rank = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(F.shiftrightunsigned(place, 1), place, *ties)) - 1
    out = df.withColumn(name, rank).join(F.broadcast(sizes) if groups << bits <= MOST_BROADCAST else sizes, [*by, bucket])
    return out.withColumn(name, col(name) + col(before)).drop(bucket, before)


def origin(df: DataFrame) -> list[Column]:
    """The file and the stretch of it that a row was read from; nothing if rows don't come from one table of files."""
    found = [F.input_file_name(), F.input_file_block_start()]
    try:
        df.select(*found)
    except AnalysisException:
        return []
    return found


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str | None, float] | Callable[[Column], Column] | None = None, block: int = BLOCK, prefix: str = "", seed: int = 0, most_places: int = MOST_PLACES, own_windows: bool = False) -> DataFrame:
    """All rows with rank (in the source), block, slot, release, deadline and position.

    ``position`` orders the mixture. release and deadline are slots, from the start
    of the phase in which the block is emitted. ``weights`` maps sources to
    positive numbers, kept exactly, or gives the weight as an expression of the
    source column; a source without one (or with null) has weight 1. With
    ``own_windows`` earliest deadline first decides among sources, else among classes
    of equal weight.
    """
    spark = prepare(df.sparkSession)
    source, place, rank, kind, turn, held = free(df, "source_key", "place", "rank_in", "class", "turn", "held")
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731 - null has a name of its own
    rest = [c for c in df.columns if c not in (id_col, source_col)]
    ties = [F.xxhash64(*[col(c) for c in rest])] if rest and not any("map<" in t or "variant" in t for c, t in df.dtypes if c in rest) else []
    keyed = df.withColumn(source, name(col(source_col))).withColumn(place, F.xxhash64(F.lit(seed), col(id_col).cast("string"), *origin(df)))

    # A row a source: its class, number of blocks and turn in the class.
    sources = keyed.groupBy(source).agg(F.count("*").alias("n"), F.first(col(source_col)).alias("named"))
    if callable(weights):
        sources = sources.withColumn("weight", weights(F.col("named")).cast("string"))
    else:
        named = spark.createDataFrame([("" if s is None else f"={s}", str(w)) for s, w in (weights or {}).items()], f"{source} string, weight string")
        sources = sources.join(F.broadcast(named), source, "left")
    sources = sources.fillna("1", ["weight"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    sources = materialize(sources.select(source, "n", "weight", "blocks"), "sources")
    groups, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    shares: list[Fraction] = []
    counts: list[dict[int, int]] = []
    known: list[tuple[str, int]] = []  # the class of each source, or of each weight
    follow = own_windows and groups > FEW_SOURCES
    by = source if own_windows and not follow else "weight"
    for key, weight, v, c in sources.groupBy(by, F.col("weight").alias("w"), "blocks").count().orderBy(F.desc("blocks"), by).collect():
        share = Fraction(weight)
        if share <= 0:
            raise ValueError("weights must be positive")
        if by == source or share not in shares:
            shares.append(share)
            counts.append({})
        k = len(shares) - 1 if by == source else shares.index(share)
        known.append((key, k))
        counts[k][v] = counts[k].get(v, 0) + c
    sources = sources.join(F.broadcast(spark.createDataFrame(sorted(set(known)), f"{by} string, {kind} int")), by)
    if follow:
        return follow_through(df, keyed, sources, [source, place, rank, kind, turn], ties, block, prefix, most, groups, shares)
    classes = list(range(len(shares)))
    plan = Plan([counts[k] for k in classes], [shares[k] for k in classes], most_places)
    table_of = write_places(spark, plan.make())
    ahead = [(k, v, i, plan.ahead(i, v)) for i, k in enumerate(classes) for v in counts[k]]
    ahead = spark.createDataFrame(ahead, f"{kind} int, blocks long, {held} int, ahead long")
    turned = numbered(sources.withColumn("at", F.xxhash64(source, F.lit("turn"))), [kind, "blocks"], "at", [col(source)], turn, max((c for x in counts for c in x.values()), default=0), sum(map(len, counts)))
    turned = turned.join(F.broadcast(ahead), [kind, "blocks"]).select(source, (col(turn) + F.col("ahead")).alias(turn), col(held).alias(kind))

    ranked = numbered(keyed, [source], place, ties, rank, most, groups, turned)
    sent = spark.sparkContext.broadcast(plan)

    @F.pandas_udf("slot long, release long, deadline long, phase long, at long")
    def placed(k: pd.Series, j: pd.Series, r: pd.Series) -> pd.DataFrame:
        return sent.value.places(k.to_numpy(), j.to_numpy(), r.to_numpy())

    j = F.floor(col(rank) / block).cast("long")
    out = ranked.withColumn(held, placed(col(kind), j, col(turn)))
    slot = col(held)["slot"]
    if table_of is not None:
        k2, p2, c2, s2 = free(out, "k2", "p2", "c2", "s2")
        places = table_of.toDF(k2, p2, c2, s2)
        out = out.join(places, (col(kind) == col(k2)) & (col(held)["phase"] == col(p2)) & (F.floor(col(held)["at"] / CHUNK) == col(c2)), "left")
        slot = F.when(slot >= 0, slot).otherwise(F.get(col(s2), (col(held)["at"] % CHUNK).cast("int")))
    return results(df, out, col(rank), j, slot, col(held)["release"], col(held)["deadline"], block, prefix)


def results(df: DataFrame, out: DataFrame, rank: Column, j: Column, slot: Column, release: Column, deadline: Column, block: int, prefix: str) -> DataFrame:
    """The columns of ``df`` and those that ``mix`` adds."""
    made = {"rank": rank, "block": j, "slot": slot, "release": release, "deadline": deadline, "position": slot * block + rank % block}
    taken = {(prefix + c).lower() for c in made}
    return out.select(*[col(c) for c in df.columns if c.lower() not in taken], *[e.cast("long").alias(prefix + c) for c, e in made.items()])


def follow_through(df: DataFrame, keyed: DataFrame, sources: DataFrame, names: Sequence[str], ties: Sequence, block: int, prefix: str, most: int, groups: int, shares: Sequence[Fraction]) -> DataFrame:
    """The mixture with windows of each source's own by a table of all blocks, which rows join by their source's turn and block."""
    source, place, rank, kind, turn = names
    spark = df.sparkSession
    # A source's turn is its place in the order of blocks and name: its row in a sorted table, after the rows of the parts before.
    rows = materialize(sources.orderBy(F.desc("blocks"), source).select(source, kind, "blocks", F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftright("at", 33).cast("int")
    sizes = sorted(rows.groupBy(part).count().collect())
    ends = itertools.accumulate([n for _, n in sizes], initial=0)
    ends = spark.createDataFrame([(p, n) for (p, _), n in zip(sizes, ends)], "part int, before long")
    turned = rows.join(F.broadcast(ends), part == F.col("part")).select(source, kind, "blocks", (F.col("at").bitwiseAND((1 << 33) - 1) + F.col("before")).alias(turn))
    held = turned.select(turn, kind, "blocks").toArrow()
    order = np.argsort(held[turn].to_numpy())
    blocks, kinds = (held[c].to_numpy()[order].tolist() for c in ("blocks", kind))
    table_of = write_blocks(spark, followed(blocks, kinds, exact(shares)))

    ranked = numbered(keyed, [source], place, ties, rank, most, groups, turned.select(source, turn))
    k2, j2, slot, release, deadline = free(ranked, "k2", "j2", "slot_at", "opens", "shuts")
    j = F.floor(col(rank) / block).cast("long")
    out = ranked.join(table_of.toDF(k2, j2, slot, release, deadline), (col(turn) == col(k2)) & (j == col(j2)))
    return results(df, out, col(rank), j, col(slot), col(release), col(deadline), block, prefix)


def write_blocks(spark: SparkSession, rows: Iterator[tuple[int, int, int, int, int]]) -> DataFrame:
    """The rows of ``followed`` as a table in the shared folder, written by pieces."""
    names = ["k", "j", "slot", "release", "deadline"]
    path = delete_on_exit(spark, f"{shared_dir(spark)}/quire-blocks-{uuid.uuid4().hex}")
    while piece := list(itertools.islice(rows, PIECE)):
        columns = np.array(piece, np.int64).T
        spark.createDataFrame(pa.table(dict(zip(names, columns, strict=True)))).write.mode("append").parquet(path)
    return spark.read.schema(", ".join(f"{c} long" for c in names)).parquet(path)


def write_places(spark: SparkSession, rows: Iterator[tuple[int, int, int, array]]) -> DataFrame | None:
    """The rows as a table in the shared folder, written by pieces; None without rows."""
    path, schema, some, any_ = f"{shared_dir(spark)}/quire-places-{uuid.uuid4().hex}", "k int, p int, c long, s array<long>", [], False

    def put() -> None:
        spark.createDataFrame(some, schema).write.mode("append").parquet(path)
        some.clear()

    for k, p, c, s in rows:
        if not any_:
            delete_on_exit(spark, path)
            any_ = True
        some.append((k, p, c, s.tolist()))
        if len(some) == 64:
            put()
    if some:
        put()
    return spark.read.schema(schema).parquet(path) if any_ else None


def by_number(source: Column) -> Column:
    """Target weights of the registered query: 1 + (the last number in the source's name) mod 5; 1 without a number."""
    digits = F.regexp_extract(source, r"(\d{1,9})\D*$", 1)
    return F.when(digits != "", 1 + digits.cast("long") % 5)


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of a mixture in which sources have the weights of ``by_number``."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), weights=by_number, own_windows=True)


QUERIES = {"op2_pfair_mix": op2_pfair_mix}
ORACLES: dict[str, str] = {}
