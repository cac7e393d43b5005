"""Text functions as column expressions that stay in the JVM.

White space follows Unicode plus the four separator controls U+001C to U+001F, as
in the documents' original tools; Spark's trim() only knows the space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"
_WORD = r"[^\s\x1c-\x1f]"
_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a name inside a lambda stands for a result, not for its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _visible(char: Column) -> Column:
    """A character is printable ASCII."""
    return F.ascii(char).between(33, 126)


def strip(c: Column) -> Column:
    # Most lines begin and end with printable ASCII; only the others are searched.
    clean = _visible(F.substring(c, 1, 1)) & _visible(F.substring(c, -1, 1))
    return F.when(clean, c).otherwise(F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+\z", ""))


def split_lines(c: Column) -> Column:
    """Lines by any line terminator; a final terminator ends the last line, the empty text has none."""
    return bound(F.split(c, _BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def split_newline(c: Column) -> Column:
    return F.split(c, "\n", -1)


def few_words(c: Column, most: int) -> Column:
    """A stripped text has 1 to ``most`` words."""
    return c.rlike(rf"(?U)\A{_WORD}++(?:{_SPACE}++{_WORD}++){{0,{most - 1}}}+\z")


def is_upper(c: Column) -> Column:
    """All cased characters are upper case, and there is one."""
    # A plain small letter rules it out early, as in most lines.
    return ~c.rlike("[a-z]") & c.rlike(r"(?U)\p{Upper}") & ~c.rlike(r"(?U)\p{Lower}|\p{Lt}")


def extension(name: Column) -> Column:
    """What follows the last dot, lower-cased; a name without a dot is its own extension."""
    return F.lower(F.element_at(F.split(name, r"\.", -1), -1))


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def or_na(c: Column) -> Column:
    return F.coalesce(c, F.lit("N/A"))


def status_label(c: Column) -> Column:
    return F.initcap(c)


def status_badge(c: Column) -> Column:
    return F.upper(c)


def shown_date(c: Column, pattern: str = "M/d/yyyy") -> Column:
    """A time as a date for display, in the session's time zone; null stays null."""
    return F.date_format(c, pattern)


def diff_or_note(c: Column) -> Column:
    """The diff, or a note for an empty one."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("No changes detected."))


def shown_lines(c: Column) -> Column:
    """Lines for display: the blank ones are left out."""
    return F.filter(split_newline(c), lambda x: strip(x) != "")


def tag_colour(tag: Column, colours: dict[str, str]) -> Column:
    """The tag's colour, UNTAGGED's for unknown tags."""
    table = F.create_map(*[F.lit(x) for pair in colours.items() for x in pair])
    return F.coalesce(F.try_element_at(table, tag), F.lit(colours["UNTAGGED"]))
