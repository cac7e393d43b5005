"""Golden cases and properties of cleanup, sectioning, tags and diffs."""

import difflib
import itertools
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import diffs, structure, tagging

CLEAN = [
    ("1. Purpose\nThe purpose of this manual is clear.", "1. Purpose The purpose of this manual is clear."),
    ("1. Purpose\n\nThe purpose of this manual is clear.", "1. Purpose\n\nThe purpose of this manual is clear."),
    ("Quality Policy\nWe deliver quality to every customer always.", "Quality Policy We deliver quality to every customer always."),
    ("1.1 Purpose\nBody text goes right here now.", "1.1 Purpose\nBody text goes right here now."),
    ("SCOPE\nAll of the staff are covered here.", "SCOPE\nAll of the staff are covered here."),
    ("foo\nbar baz\nqux\nThis is the long closing line.", "foo bar baz qux This is the long closing line."),
    ("foo\nbar", "foo bar"),
    ("Yes.\nno", "Yes.\nno"),
    ("a\r\nb\x0cc d e f g", "a b c d e f g"),
    ("", ""),
    (None, None),
]
SECTIONS = [
    ("preamble line here.\n1. Purpose\nbody one\nbody two\nSCOPE\nQuality Policy\nbody three", [("Introduction", "preamble line here."), ("1. Purpose", "body one\nbody two"), ("Quality Policy", "body three")]),
    ("SCOPE\nPURPOSE", [("T", "SCOPE\nPURPOSE")]),
    (" \n ", [("T", "")]),
    ("1.1 Purpose\nbody", [("Introduction", "1.1 Purpose\nbody")]),
    ("1) Go\nx", [("1) Go", "x")]),
    ("AB\nx", [("Introduction", "AB\nx")]),
    ("ABC\nx", [("ABC", "x")]),
    ("A" * 61 + "\nx", [("A" * 61, "x")]),
    ("A" * 62 + "\nx", [("Introduction", "A" * 62 + "\nx")]),
    ("1. " + "w" * 76 + "\nx", [("1. " + "w" * 76, "x")]),
    ("1. " + "w" * 77 + "\nx", [("Introduction", "1. " + "w" * 77 + "\nx")]),
    ("One Two Three Four Five Six Seven\nx", [("One Two Three Four Five Six Seven", "x")]),
    ("One Two Three Four Five Six Seven Eight\nx", [("Introduction", "One Two Three Four Five Six Seven Eight\nx")]),
    ("A Big Thing\nx", [("Introduction", "A Big Thing\nx")]),
    ("Élan Vital\nx", [("Introduction", "Élan Vital\nx")]),
]


def python_clean(text):
    out, run = [], []
    for line in (x.strip() for x in text.splitlines()):
        heading = line.isupper() or re.match(r"(?i)(chapter|section|article|part|appendix)", line) or re.match(r"\d+(\.\d+)*\s", line)
        if line and not heading and len(line.split()) <= 3 and line[-1] not in ".?!:":
            run.append(line)
            continue
        if run and line and not heading:
            out.append(" ".join([*run, line]))
        else:
            out += ([" ".join(run)] if run else []) + [line]
        run = []
    return "\n".join(out + ([" ".join(run)] if run else [])).strip()


def python_sections(text, title):
    patterns = (r"\d+[\.\)]\s+\w+", r"[A-Z][A-Z\s]{2,60}$", r"[A-Z][a-z]+(\s[A-Z][a-z]+){0,6}$")
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    heads = [len(x) < 80 and any(re.match(p, x) for p in patterns) for x in lines]
    number = list(itertools.accumulate(heads))
    found = []
    for _, group in itertools.groupby(range(len(lines)), number.__getitem__):
        head, *rest = group if heads[(group := list(group))[0]] else (None, *group)
        if rest:
            found.append(("Introduction" if head is None else lines[head], "\n".join(lines[k] for k in rest)))
    return found or [(title, text.strip())]


def run_clean(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in structure.clean(df).orderBy("i").select("cleaned").collect()]


def run_sections(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = structure.split_sections(df, "text", F.lit("T"), ("i",)).orderBy("i", "ord").collect()
    got = {}
    for r in rows:
        assert r["ord"] == len(got.setdefault(r["i"], []))
        got[r["i"]].append((r["subtitle"], r["content"]))
    return [got.get(i) for i in range(len(texts))]


def test_cleanup_golden(spark):
    assert run_clean(spark, [a for a, _ in CLEAN]) == [b for _, b in CLEAN]


def test_sections_golden(spark):
    assert run_sections(spark, [a for a, _ in SECTIONS]) == [b for _, b in SECTIONS]


LINE = st.sampled_from(["", " ", "SCOPE", "foo", "bar baz", "Quality Policy", "1. Purpose", "1.1 Purpose", "15 days of leave", "partial words", "This is a long line of text.", "no", "Yes.", "a\tb", "\x1cx", "École", "ÉCOLE", "1) Go now", "ends:", "x\x85y"])
TEXTS = st.lists(st.builds("\n".join, st.lists(LINE, max_size=9)), min_size=60, max_size=60)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXTS)
def test_cleanup_and_sections_match_plain_python(spark, texts):
    assert run_clean(spark, texts) == [python_clean(t) for t in texts]
    assert run_sections(spark, texts) == [python_sections(t, "T") for t in texts]


def test_text_functions(spark):
    df = spark.createDataFrame([("  a b\x1f", "x/Report.Final.PDF", "a\n\n b")], "s string, f string, t string")
    r = df.select(X.strip(F.col("s")), X.extension(F.col("f")), X.shown_lines(F.col("t")), X.status_label(F.lit("pending")), X.diff_or_note(F.lit("")), X.tag_colour(F.lit("zzz"), {"UNTAGGED": "grey", "POLICY": "red"})).first()
    assert list(r) == ["a b", "pdf", ["a", " b"], "Pending", "No changes detected.", "grey"]
    spaces = [" a", "a\t", "\x1fé ", "é", "  ", "", "a b", "\u2003x\u2003", "~", "\x85"]
    got = spark.createDataFrame(list(enumerate(spaces)), "i int, s string").orderBy("i").select(X.strip(F.col("s")), X.few_words(X.strip(F.col("s")), 1)).collect()
    assert [r[0] for r in got] == [x.strip() for x in spaces] and [r[1] for r in got] == [len(x.split()) == 1 for x in spaces]
    day = spark.sql("select timestamp '2024-03-05 10:00:00' t").select(X.shown_date(F.col("t")), X.status_badge(F.lit("pending"))).first()
    assert list(day) == ["3/5/2024", "PENDING"]


TAGGED = [
    ("", "PROCEDURE"), ("zzz qqq", "PROCEDURE"), ("This procedure must be followed", "PROCEDURE"), ("Quality policy", "RESPONSIBILITY"), ("the", "RESPONSIBILITY"), ("step", "PROCEDURE"),
    ("The manager shall monitor staff", "RESPONSIBILITY"), ("Employees may request medical leave", "POLICY"), ("Click submit to open the application", "PROCEDURE"), ("How to download the document", "WORKING INSTRUCTION"),
]


def test_tags(spark, tmp_path):
    rows = [*TAGGED, *[(text, label) for label, text in tagging.TRAINING]]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, content string")
    assert [r["tag"] for r in tagging.tag(df, untag_blank=False).orderBy("i").collect()] == [b for _, b in rows]
    assert tagging.tag(df).orderBy("i").first()["tag"] == "UNTAGGED"
    scores = df.filter("i = 0").select(tagging.scores(F.col("content"))).first()[0]
    assert scores == pytest.approx([-0.458654, -0.407929, -0.423727, -0.432925], abs=1e-5)
    model = tagging.TagModel.load_or_train(str(tmp_path / "model.json"))
    assert tagging.TagModel.load_or_train(str(tmp_path / "model.json")).weights == model.weights
    assert tagging.accuracy(model) == 1


def test_diffs(spark):
    cases = [("a\nb\n", "a\nc"), ("x", "x\n\ny"), ("a\nb\nc", "a\nx\nc"), ("a", "a"), (None, "q")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, old string, new string")
    got = {}
    for r in diffs.positional_rows(df, "old", "new", ("i",)).orderBy("i", "ord").collect():
        got.setdefault(r["i"], []).append((r["kind"], r["line"]))
    assert got[0] == [("same", "a"), ("removed", "b"), ("added", "c"), ("removed", "")]
    assert got[1] == [("same", "x"), ("added", ""), ("added", "y")]
    for i, (old, new) in enumerate(cases):
        assert "\n".join(x for k, x in got[i] if k != "added") == (old or "")
        assert "\n".join(x for k, x in got[i] if k != "removed") == (new or "")
    unified = [r[0] for r in df.select("i", diffs.unified(F.col("old"), F.col("new")).alias("d")).orderBy("i").select("d").collect()]
    assert unified[2] == "--- \n+++ \n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c"
    assert unified[3] == ""
    assert unified == ["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")) for a, b in cases]
