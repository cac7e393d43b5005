"""Line diffs between two versions of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import bound, split_lines, split_newline


def positional(old: Column, new: Column) -> Column:
    """array<struct<kind, line>>: line i against line i, without alignment. Null is the empty text."""
    a, b = split_newline(F.coalesce(old, F.lit(""))), split_newline(F.coalesce(new, F.lit("")))

    def compared(pair: Column) -> Column:
        def at(i: Column) -> Column:
            x, y = F.get(pair["a"], i), F.get(pair["b"], i)
            row = lambda kind, line: F.struct(F.lit(kind).alias("kind"), line.alias("line"))
            unlike = F.filter(F.array(row("removed", x), row("added", y)), lambda r: r["line"].isNotNull())
            return F.when(x.eqNullSafe(y), F.array(row("same", x))).otherwise(unlike)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(pair["a"]), F.size(pair["b"])) - 1), at))

    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), compared), F.lit(0))


def positional_rows(df: DataFrame, old: str, new: str, keep: tuple[str, ...]) -> DataFrame:
    """Rows (keep.., ord, kind, line)."""
    return df.select(*keep, F.posexplode(positional(F.col(old), F.col(new))).alias("ord", "d")).select(*keep, "ord", "d.kind", "d.line")


#: Of a new text with so many lines those that are more frequent than a hundredth of it start no match.
FREQUENT_FROM = 200

_INTERVALS = "array<struct<a:int,b:int,c:int,d:int>>"
_BLOCKS = "array<struct<i:int,j:int,k:int>>"


def _upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _lead(flags: Column) -> Column:
    """How many flags are true before the first false one."""
    return F.when(F.array_position(flags, False) > 0, F.array_position(flags, False) - 1).otherwise(F.size(flags)).cast("int")


def _runs(a: Column, b: Column, common: Column) -> Column:
    """array<struct<i, j, k>>: the longest stretches a[i:i+k] = b[j:j+k] without lines that are too common."""
    n, m = F.size(a), F.size(b)

    def alike(i: Column, j: Column) -> Column:
        return (F.get(a, i) == F.get(b, j)) & ~F.get(common, j)

    def of(i: Column) -> Column:
        begins = F.filter(_upto(m), lambda j: alike(i, j) & ~F.when((i > 0) & (j > 0), alike(i - 1, j - 1)).otherwise(False))
        whole = F.transform(begins, lambda j: F.struct(i.alias("i"), j.alias("j"), _lead(F.transform(_upto(F.least(n - i, m - j)), lambda d: alike(i + d, j + d))).alias("k")))
        return F.when(F.array_contains(b, F.get(a, i)), whole).otherwise(F.array().cast(_BLOCKS))

    return F.flatten(F.transform(_upto(n), of)).cast(_BLOCKS)


def matching_blocks(a: Column, b: Column) -> Column:
    """array<struct<i, j, k>>, in order: the longest common stretch of lines, then those to its left and right in turn.

    Of stretches of equal length the first in ``a`` counts, then the first in ``b``.
    The stretches of equal lines are found once; what is open is a stack of intervals,
    and a step clips all stretches to the interval on top.
    """
    n, m = F.size(a), F.size(b)
    frequent = F.transform(b, lambda x: F.size(F.filter(b, lambda y: x == y)) > F.floor(m / 100) + 1)
    common = F.when(m >= FREQUENT_FROM, frequent).otherwise(F.transform(b, lambda x: F.lit(False)))

    def walk(runs: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            def on(top: Column) -> Column:
                def clipped(r: Column) -> Column:
                    skip = F.greatest(top["a"] - r["i"], top["c"] - r["j"], F.lit(0))
                    k = F.least(top["b"] - r["i"], top["d"] - r["j"], r["k"]) - skip
                    return F.struct(k.alias("k"), (-r["i"] - skip).alias("i"), (-r["j"] - skip).alias("j"))

                best = F.array_max(F.filter(F.transform(runs, clipped), lambda c: c["k"] > 0))
                best = F.coalesce(best, F.struct(F.lit(0).alias("k"), (-top["a"]).alias("i"), (-top["c"]).alias("j")))

                def widened(c: Column) -> Column:
                    """Common lines join a match at its ends."""
                    i, j, k = -c["i"], -c["j"], c["k"]
                    back = _lead(F.transform(_upto(F.least(i - top["a"], j - top["c"])), lambda d: F.get(a, i - d - 1) == F.get(b, j - d - 1)))
                    on_ = _lead(F.transform(_upto(F.least(top["b"] - i - k, top["d"] - j - k)), lambda d: F.get(a, i + k + d) == F.get(b, j + k + d)))
                    return F.when(m >= FREQUENT_FROM, F.struct((i - back).alias("i"), (j - back).alias("j"), (k + back + on_).alias("k"))).otherwise(F.struct(i.alias("i"), j.alias("j"), k.alias("k")))

                def split(x: Column) -> Column:
                    left = F.struct(top["a"].alias("a"), x["i"].alias("b"), top["c"].alias("c"), x["j"].alias("d"))
                    right = F.struct((x["i"] + x["k"]).alias("a"), top["b"].alias("b"), (x["j"] + x["k"]).alias("c"), top["d"].alias("d"))
                    more = F.filter(F.array(left, right), lambda v: (v["a"] < v["b"]) & (v["c"] < v["d"]) & (x["k"] > 0)).cast(_INTERVALS)
                    found = F.filter(F.array(x), lambda v: v["k"] > 0).cast(_BLOCKS)
                    rest = F.slice(state["open"], 1, F.size(state["open"]) - 1)
                    return F.struct(F.concat(rest, more).alias("open"), F.concat(state["found"], found).alias("found"))

                return bound(bound(best, widened), split)

            return F.when(F.size(state["open"]) == 0, state).otherwise(bound(F.element_at(state["open"], -1), on))

        begin = F.struct(F.array(F.struct(F.lit(0).alias("a"), n.alias("b"), F.lit(0).alias("c"), m.alias("d"))).cast(_INTERVALS).alias("open"), F.array().cast(_BLOCKS).alias("found"))
        return F.array_sort(F.aggregate(F.sequence(F.lit(0), 2 * F.least(n, m)), begin, step)["found"])

    return bound(bound(common, lambda c: _runs(a, b, c)), walk)


def unified(old: Column, new: Column, context: int = 3) -> Column:
    """Unified diff with three lines of context and empty file names; '' for equal texts. Null is the empty text.

    All in the JVM, by higher-order functions over the lines of a row. Time is in
    proportion to the product of the numbers of lines, and to that of the stretches
    of equal lines and the matches.
    """
    texts = F.struct(split_lines(F.coalesce(old, F.lit(""))).alias("a"), split_lines(F.coalesce(new, F.lit(""))).alias("b"))
    return bound(texts, lambda t: F.when(t["a"] == t["b"], "").otherwise(_formatted(t["a"], t["b"], context)))


def _formatted(a: Column, b: Column, context: int) -> Column:
    n, m = F.size(a), F.size(b)

    def changes(blocks: Column) -> Column:
        """What lies between matches: a[i:e] becomes b[j:f]."""
        ends = F.concat(blocks, F.array(F.struct(n.alias("i"), m.alias("j"), F.lit(0).alias("k"))).cast(_BLOCKS))

        def between(x: Column, k: Column) -> Column:
            before = F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(None))
            start = lambda f: F.coalesce(before[f] + before["k"], F.lit(0))
            return F.struct(start("i").alias("i"), x["i"].alias("e"), start("j").alias("j"), x["j"].alias("f"))

        return F.filter(F.transform(ends, between), lambda c: (c["i"] < c["e"]) | (c["j"] < c["f"]))

    def lines(mark: str, x: Column, start: Column, stop: Column) -> Column:
        return F.transform(F.slice(x, start + 1, stop - start), lambda line: F.concat(F.lit(mark), line))

    def shown(start: Column, stop: Column) -> Column:
        size = stop - start
        return F.when(size == 1, (start + 1).cast("string")).otherwise(F.concat(F.when(size == 0, start).otherwise(start + 1).cast("string"), F.lit(","), size.cast("string")))

    def hunks(cs: Column) -> Column:
        last = F.size(cs) - 1
        apart = lambda k: F.get(cs, k + 1)["i"] - F.get(cs, k)["e"] > 2 * context  # noqa: E731 - the hunk ends after change k
        closes = lambda k: (k == last) | F.coalesce(apart(k), F.lit(False))
        opens = lambda k: (k == 0) | F.coalesce(apart(k - 1), F.lit(False))

        def one(c: Column, k: Column) -> Column:
            lead = F.least(c["i"], F.lit(context))
            trail = lambda x: F.least(n - x["e"], F.lit(context))

            def headed(z: Column) -> Column:
                return F.concat(F.lit("@@ -"), shown(c["i"] - lead, z["e"] + trail(z)), F.lit(" +"), shown(c["j"] - lead, z["f"] + trail(z)), F.lit(" @@"))

            end = F.get(cs, F.get(F.filter(F.sequence(k, last), closes), F.lit(0)))
            above = F.when(opens(k), F.concat(F.array(bound(end, headed)), lines(" ", a, c["i"] - lead, c["i"]))).otherwise(lines(" ", a, F.coalesce(F.get(cs, k - 1)["e"], F.lit(0)), c["i"]))
            below = F.when(closes(k), lines(" ", a, c["e"], c["e"] + trail(c))).otherwise(F.array().cast("array<string>"))
            return F.concat(above, lines("-", a, c["i"], c["e"]), lines("+", b, c["j"], c["f"]), below)

        return F.array_join(F.concat(F.array(F.lit("--- "), F.lit("+++ ")), F.flatten(F.transform(cs, one))), "\n")

    return bound(bound(matching_blocks(a, b), changes), hunks)
