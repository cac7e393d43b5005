"""Writes as pure functions from tables to tables.

Plain files have no row updates: an edit is an event, a table's state is a fold over
its events, and a deletion is an anti join that runs down the foreign keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import diff_or_note, preview, strip
from quire.operators.diffs import unified
from quire.operators.entities import FOREIGN_KEYS, STATUSES
from quire.operators.listings import can_upload
from quire.operators.structure import split_sections
from quire.operators.tagging import UNTAGGED, TagModel, tag
from quire.session import materialize

#: What an edit may change: column and the flag that says it was given.
EDITABLE = (("subtitle", "has_subtitle"), ("content", "has_content"), ("page_number", "has_page"), ("order", "has_order"))


class Rejected(ValueError):
    """A write that the rules refuse."""


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def insert_unique(table: DataFrame, rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows, refused rows): a value that is empty, there already or given earlier (by id) is refused."""
    named = F.coalesce(F.col(column) != "", F.lit(False))
    (rank,) = free(rows, "rank")
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(column).orderBy("id")))
    new = ranked.filter(named & (F.col(rank) == 1)).drop(rank).join(table.select(column), column, "left_anti").select(*rows.columns)
    return append(table, new), rows.join(new.select("id"), "id", "left_anti")


def register_users(users: DataFrame, departments: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New users wait for approval as staff role; an unknown department becomes null."""
    (known,) = free(rows, "known")
    rows = rows.join(departments.select(F.col("id").alias(known)), F.col("department_id") == F.col(known), "left").withColumn("department_id", F.col(known)).drop(known)
    rows = rows.withColumn("is_approved", F.lit(False)).withColumn("role", F.lit("staff"))
    return insert_unique(users, rows, "username")


def create_departments(departments: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return insert_unique(departments, rows, "name")


def approve_user(users: DataFrame, user_id: int) -> DataFrame:
    return users.withColumn("is_approved", F.when(F.col("id") == user_id, True).otherwise(F.col("is_approved")))


def require(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows that have all columns, the others): null and '' count as missing."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def create_sections(sections: DataFrame, rows: DataFrame, model: TagModel | None = None) -> tuple[DataFrame, DataFrame]:
    """New sections get a tag (none for empty content) and version 1; page and order that aren't numbers are null and 0."""
    good, bad = require(rows, "subtitle")
    good = good.withColumn("page_number", F.col("page_number").try_cast("int")).withColumn("order", F.coalesce(F.col("order").try_cast("int"), F.lit(0))).withColumn("version", F.lit(1))
    good = tag(good.withColumn("content", F.coalesce("content", F.lit(""))), untag_blank=False, model=model)
    good = good.withColumn("tag", F.when(F.col("content") == "", UNTAGGED).otherwise(F.col("tag")))
    return append(sections, good), bad


def upload_manuals(manuals: DataFrame, sections: DataFrame, rows: DataFrame, texts: DataFrame, model: TagModel | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manuals, sections, refused rows) after uploads.

    ``rows`` need title, department_id and file. ``texts`` (file, text, error) are the
    cleaned extractions; a manual whose file can't be read or is blank is kept without
    sections. A section's id is a hash of manual and place, so a repeated run gives
    the same ids.
    """
    good, bad = require(rows, "title", "department_id", "file")
    good = good.withColumn("version", F.lit(1))
    found = good.select(F.col("id").alias("manual_id"), "title", "file").join(texts.filter("error is null").select("file", "text"), "file").filter(~blank_content(F.col("text")))
    made = tag(split_sections(found, "text", F.col("title"), ("manual_id",)), model=model)
    made = made.select(F.xxhash64("manual_id", "ord").alias("id"), "manual_id", "subtitle", "content", "tag", F.lit(None).cast("int").alias("page_number"), F.col("ord").alias("order"), F.lit(1).alias("version"))
    return append(manuals, good), append(sections, made), bad


def valid_edits(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, refused edits): an explicit null is for the page number only."""
    ok = F.lit(True)
    for column, flag in EDITABLE:
        if column != "page_number":
            ok = ok & (~F.coalesce(F.col(flag), F.lit(False)) | F.col(column).isNotNull())
    return events.filter(ok), events.filter(~ok)


def fold_edits(sections: DataFrame, events: DataFrame, model: TagModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections after their edits, history rows).

    Every event snapshots the version before it, also if it changes nothing. A key that
    was given replaces the value, null included; others keep it. Content that was
    given is tagged again, blank or not. Versions count up from the section's own.
    Events that ``valid_edits`` refuses are left out.
    """
    events, _ = valid_edits(events)
    start = sections.select(F.col("id").alias("section_id"), F.lit(None).cast("int").alias("seq"), *[F.lit(True).alias(flag) for _, flag in EDITABLE], "subtitle", "content", "page_number", "order", F.lit(None).cast("long").alias("actor"), F.lit(None).cast("timestamp").alias("ts"), F.col("tag").alias("tag"), F.lit(False).alias("retag"), F.col("version").alias("base"))
    asked = events.join(sections.select(F.col("id").alias("section_id")), "section_id", "left_semi")
    asked = tag(asked, untag_blank=False, model=model).withColumn("retag", F.coalesce("has_content", F.lit(False)))
    asked = asked.select("section_id", "seq", *[flag for _, flag in EDITABLE], "subtitle", "content", "page_number", "order", "actor", "ts", "tag", "retag", F.lit(None).cast("int").alias("base"))
    log = start.unionByName(asked)
    order = Window.partitionBy("section_id").orderBy(F.col("seq").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, 0)

    def latest(column: str, given: Column) -> Column:
        return F.last(F.when(given, F.struct(F.col(column).alias("v"))), ignorenulls=True).over(upto)["v"].alias(column)

    states = log.select(
        "section_id", "seq", *[latest(c, F.coalesce(F.col(flag), F.lit(False))) for c, flag in EDITABLE], latest("tag", F.col("retag") | F.col("seq").isNull()),
        (F.first("base").over(upto) + F.row_number().over(order) - 1).alias("version"), F.lead("actor").over(order).alias("edited_by_id"), F.lead("ts").over(order).alias("edited_at"), F.lead("seq").over(order).isNotNull().alias("past"),
    )
    history = states.filter("past").select("section_id", "version", "subtitle", "content", "tag", "edited_by_id", "edited_at")
    now = states.filter("not past").select(F.col("section_id").alias("id"), "subtitle", "content", "tag", "page_number", "order", "version")
    rest = [c for c in sections.columns if c not in now.columns or c == "id"]
    return sections.select(*rest).join(now, "id").select(*sections.columns), history


def bump_manuals(manuals: DataFrame, sections: DataFrame, events: DataFrame) -> DataFrame:
    """A manual's version goes up by the number of edits of its sections; creating and deleting sections don't count."""
    edits = events.select("section_id").join(sections.select(F.col("id").alias("section_id"), "manual_id"), "section_id").groupBy(F.col("manual_id").alias("__m")).agg(F.count("*").alias("__n"))
    found = manuals.join(edits, F.col("id") == F.col("__m"), "left")
    return found.withColumn("version", (F.col("version") + F.coalesce("__n", F.lit(0))).cast("int")).select(*manuals.columns)


def submit_revisions(revisions: DataFrame, sections: DataFrame, uploads: DataFrame) -> DataFrame:
    """Pending revisions from ``uploads`` (id, section_id, submitted_by_id, uploaded_file, text, submitted_at): ``text`` is the cleaned new content."""
    old = sections.select(F.col("id").alias("section_id"), F.col("content").alias("__old"))
    new = uploads.join(old, "section_id").withColumn("diff_text", unified(F.col("__old"), F.col("text")))
    new = new.select("id", "section_id", "submitted_by_id", "uploaded_file", "diff_text", F.lit("pending").alias("status"), "submitted_at", F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit("").alias("reviewer_notes"))
    return append(revisions, new)


def submitted(revisions: DataFrame) -> DataFrame:
    """What submitters see of revisions: the status and the first 500 characters of the diff, or a note if it is empty."""
    return revisions.select("id", "status", preview(diff_or_note(F.col("diff_text")), 500).alias("diff_preview"))


def allowed_uploads(uploads: DataFrame, users: DataFrame, sections: DataFrame, manuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uploads, refused ones): a file is needed, and submitter and manual must be of one department, staff or not."""
    good, bad = require(uploads, "uploaded_file")
    where = sections.select(F.col("id").alias("section_id"), "manual_id").join(manuals.select(F.col("id").alias("manual_id"), F.col("department_id").alias("__md")), "manual_id")
    who = users.select(F.col("id").alias("submitted_by_id"), F.col("department_id").alias("__ud"))
    allowed = good.join(where, "section_id").join(who, "submitted_by_id").filter(can_upload(F.col("__ud"), F.col("__md"))).select("id")
    return good.join(allowed, "id", "left_semi"), bad.unionByName(good.join(allowed, "id", "left_anti"))


def review(revisions: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(revisions with their latest review, refused reviews); ``reviews``: id, seq, status, notes, ts. A revision may be reviewed again."""
    valid = F.coalesce(F.col("status").isin("approved", "rejected"), F.lit(False))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
    latest = reviews.filter(valid).withColumn("__r", last).filter("__r = 1").select(F.col("id").alias("__id"), F.col("status").alias("__status"), F.coalesce("notes", F.lit("")).alias("__notes"), F.col("ts").alias("__ts"))
    found = revisions.join(latest, F.col("id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    for column, new in (("status", "__status"), ("reviewer_notes", "__notes"), ("reviewed_at", "__ts")):
        found = found.withColumn(column, F.when(hit, F.col(new)).otherwise(F.col(column)))
    return found.select(*revisions.columns), reviews.filter(~valid)


def approval_events(reviews: DataFrame, revisions: DataFrame, texts: DataFrame) -> DataFrame:
    """Edit events of approving reviews: the file's text (``texts``: uploaded_file, text, error) replaces the content, by the submitter.

    A file that couldn't be read gives no event; ``failed_approvals`` lists those.
    """
    found = reviews.filter("status = 'approved'").select("id", "seq", "ts").join(revisions.select("id", "section_id", "submitted_by_id", "uploaded_file"), "id").join(texts, "uploaded_file")
    none = F.lit(False)
    return found.filter("error is null and text is not null").select("section_id", "seq", none.alias("has_subtitle"), F.lit(None).cast("string").alias("subtitle"), F.lit(True).alias("has_content"), F.col("text").alias("content"), none.alias("has_page"), F.lit(None).cast("int").alias("page_number"), none.alias("has_order"), F.lit(None).cast("int").alias("order"), F.col("submitted_by_id").alias("actor"), "ts")


def failed_approvals(reviews: DataFrame, revisions: DataFrame, texts: DataFrame) -> DataFrame:
    """Approving reviews that change nothing, as the file couldn't be read, has no text or is gone."""
    known = texts.select("uploaded_file", F.when(F.col("error").isNull() & F.col("text").isNull(), "no text").otherwise(F.col("error")).alias("error"), F.lit(True).alias("__there"))
    found = reviews.filter("status = 'approved'").select("id", "seq").join(revisions.select("id", "uploaded_file"), "id").join(known, "uploaded_file", "left")
    return found.select("id", "seq", F.when(F.col("__there").isNull(), "file not found").otherwise(F.col("error")).alias("error")).filter("error is not null")


def delete(tables: Mapping[str, DataFrame], entity: str, keys: DataFrame) -> dict[str, DataFrame]:
    """All tables after rows of ``entity`` whose id is in ``keys`` (id) go: children cascade or lose the reference."""
    out = dict(tables)
    columns = out[entity].columns
    parents = [(child, column, rule) for child, column, parent, rule in FOREIGN_KEYS if parent == entity and child in out]
    if parents:
        # Several tables ask for the keys: they are worked out once, and only they.
        keys = materialize(out[entity].join(keys.select("id").distinct(), "id", "left_semi").select("id"), "gone")
    out[entity] = out[entity].join(keys.select("id"), "id", "left_anti").select(*columns)
    for child, column, rule in parents:
        columns = out[child].columns
        if rule == "cascade":
            hit = out[child].join(keys, out[child][column] == keys["id"], "left_semi").select("id")
            out = delete(out, child, hit)
        else:
            (gone,) = free(out[child], "gone")
            nulled = out[child].join(keys.select(F.col("id").alias(gone)), F.col(column) == F.col(gone), "left")
            out[child] = nulled.withColumn(column, F.when(F.col(gone).isNull(), F.col(column))).select(*columns)
    return out


def password_problem(password: Column, again: Column) -> Column:
    """What is wrong with a new password, or null."""
    return F.when(~password.eqNullSafe(again), "passwords do not match").when(F.coalesce(F.length(password), F.lit(0)) < 8, "password is shorter than 8 characters")


def check_status(status: str) -> str:
    if status not in STATUSES[1:]:
        raise Rejected(f"status must be one of {STATUSES[1:]}")
    return status


def blank_content(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""
