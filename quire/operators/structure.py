"""Cleanup of extracted text and its division into titled sections.

Both work on one row at a time with higher-order functions: a line's part in the
result depends on itself and its neighbour alone, so nothing is shuffled and a
document of any number of lines costs time in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import bound, few_words, is_upper, split_lines, split_newline, strip

FULL_DOCUMENT = "Full Document"
INTRODUCTION = "Introduction"

# The heading patterns of line cleanup and of sectioning.
NAMED_HEADING = r"(?iu)^(CHAPTER|SECTION|ARTICLE|PART|APPENDIX)"
NUMBERED_HEADING = r"(?U)^\d+(\.\d+)*\s"
SECTION_HEADINGS = (r"(?U)^\d+[\.\)]\s+\w+", r"(?U)^[A-Z][A-Z\s]{2,60}\z", r"(?U)^[A-Z][a-z]+(\s[A-Z][a-z]+){0,6}\z")
SECTION_HEADING_BELOW = 80


def line_class(line: Column) -> Column:
    """B blank, H heading, S short (no more than three words, no closing mark), else L."""
    named = F.substring(line, 1, 8).rlike(NAMED_HEADING)  # no name is longer
    numbered = F.substring(line, 1, 1).rlike(r"(?U)\d") & line.rlike(NUMBERED_HEADING)
    heading = named | numbered | is_upper(line)
    short = ~F.substring(line, -1, 1).isin(".", "?", "!", ":") & few_words(line, 3)
    return F.when(line == "", "B").when(heading, "H").when(short, "S").otherwise("L")


def cleaned(text: Column) -> Column:
    """Text whose runs of short lines are joined with the line that follows.

    A line continues the one before if that is short and itself is neither blank
    nor a heading; it is joined by a space then, by a newline otherwise.
    """
    classed = F.transform(F.transform(split_lines(text), strip), lambda s: F.struct(s.alias("s"), line_class(s).alias("k")))

    def joined(these: Column) -> Column:
        def glue(x: Column, i: Column) -> Column:
            starts = x["k"].isin("B", "H") | (F.get(these, i - 1)["k"] != "S")
            return F.concat(F.when(i == 0, "").when(starts, "\n").otherwise(" "), x["s"])

        return F.array_join(F.transform(these, glue), "")

    return bound(bound(classed, joined), strip)


def clean(df: DataFrame, text_col: str = "text", out: str = "cleaned") -> DataFrame:
    """Adds the cleaned text; null stays null."""
    return df.withColumn(out, cleaned(F.col(text_col)))


def is_section_heading(line: Column) -> Column:
    test = F.lit(False)
    for pattern in SECTION_HEADINGS:
        test = test | line.rlike(pattern)
    return (F.length(line) < SECTION_HEADING_BELOW) & test


def sections_of(text: Column, fallback: Column) -> Column:
    """array<struct<subtitle, content>> of a text's sections.

    Lines are stripped and blank ones dropped, so two newlines in a row can mark
    each heading; splitting there gives the sections. Those without content go. A
    text without any section is one, named by ``fallback``.
    """
    lines = F.filter(F.transform(split_newline(text), strip), lambda x: x != "")
    marked = F.transform(lines, lambda x: F.when(is_section_heading(x), F.concat(F.lit("\n"), x)).otherwise(x))
    parts = F.split(F.concat(F.lit("\n"), F.array_join(marked, "\n")), "\n\n", -1)

    def section(part: Column, i: Column) -> Column:
        first = F.substring_index(part, "\n", 1)
        title = F.when(i == 0, INTRODUCTION).otherwise(first)
        return F.struct(title.alias("subtitle"), F.substring(part, F.length(first) + 2, F.length(part)).alias("content"))

    found = F.filter(F.transform(parts, section), lambda x: x["content"] != "")
    whole = F.array(F.struct(fallback.alias("subtitle"), strip(text).alias("content")))
    return bound(found, lambda x: F.when(F.size(x) == 0, whole).otherwise(x))


def split_sections(df: DataFrame, text_col: str = "text", title: Column | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (keep.., ord, subtitle, content); ``ord`` counts a document's sections from 0. A null text has none."""
    made = df.select(*keep, F.posexplode(sections_of(F.col(text_col), title if title is not None else F.lit(FULL_DOCUMENT))).alias("ord", "section"))
    return made.select(*keep, "ord", F.col("section.subtitle").alias("subtitle"), F.col("section.content").alias("content"))
