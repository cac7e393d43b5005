"""Unified diffs in expressions against the standard library."""

import difflib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators.diffs import matching_blocks, unified

SCHEMA = "a string, b string"


def library(a, b):
    return "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm=""))


def checked(spark, pairs):
    got = spark.createDataFrame(pairs, SCHEMA).select("a", "b", unified(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert r["d"] == library(r["a"], r["b"]), (r["a"], r["b"])


def edited(rng, size, letters):
    a = [rng.choice(letters) for _ in range(size)]
    b = [x for x in a if rng.random() < 0.85]
    for _ in range(rng.randint(0, 5)):
        b.insert(rng.randint(0, len(b)), rng.choice(letters))
    return "\n".join(a), "\n".join(b)


def test_unified_diffs_of_edited_texts(spark):
    rng = random.Random(11)
    pairs = [edited(rng, rng.randint(0, 40), letters) for letters in ("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz") for _ in range(40)]
    checked(spark, [*pairs, (None, None), (None, "x"), ("x", None), ("", "\n"), ("a\n", "a"), ("a\r\nb", "a\nb"), ("a\x0bb\x1cc", "a\nb"), ("\n\n", "\n")])


def test_too_common_lines_of_long_texts_start_no_match(spark):
    rng = random.Random(5)
    lines = ["", "", "y", *[f"x{k}" for k in range(150)]]
    checked(spark, [edited(rng, size, lines) for size in (190, 199, 200, 201, 205, 230, 260, 320)])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(["a", "b", "", "c d", " a"]), max_size=14).map("\n".join)] * 2), min_size=20, max_size=40))
def test_unified_diffs_of_any_texts(spark, pairs):
    checked(spark, pairs)


def test_matching_blocks(spark):
    row = spark.createDataFrame([(list("abxcd"), list("abcdx"))], "a array<string>, b array<string>").select(matching_blocks(F.col("a"), F.col("b")).alias("m")).first()
    assert [tuple(x) for x in row["m"]] == [(0, 0, 2), (3, 2, 2)]


def test_a_hunk_begins_with_its_first_change(spark):
    # A later change of the hunk, far down in the old text and near the top of the new one, doesn't move its head.
    a, b = "p\nq\nr\ns\nTo.\nz", "n\nTo."
    checked(spark, [(a, b), (b, a), (a + "\n", b + "\n"), ("To.\n" + a, b)])
    assert spark.createDataFrame([(a, b)], SCHEMA).select(unified(F.col("a"), F.col("b"))).first()[0].split("\n")[2] == "@@ -1,6 +1,2 @@"
