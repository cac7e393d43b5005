"""The relational read queries. All are one plan over the entities' tables; results with an order carry it in ``pos`` or a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import or_na, preview


class NotFound(LookupError):
    """No row has the key."""


def lookup(df: DataFrame, key: object, column: str = "id") -> DataFrame:
    """The row of a key, or NotFound."""
    found = df.filter(F.col(column) == F.lit(key))
    if found.isEmpty():
        raise NotFound(f"{column} = {key}")
    return found


def children(df: DataFrame, column: str, key: object) -> DataFrame:
    return df.filter(F.col(column) == F.lit(key))


def exists(df: DataFrame, column: str, value: object) -> bool:
    return not df.filter(F.col(column) == F.lit(value)).isEmpty()


def _department_names(departments: DataFrame) -> DataFrame:
    return departments.select(F.col("id").alias("__d"), F.col("name").alias("__department"))


def users(users: DataFrame, departments: DataFrame, approved: bool) -> DataFrame:
    """Pending or approved users with their department or 'N/A'; approved ones with their role."""
    found = users.filter(F.col("is_approved") == F.lit(approved)).join(_department_names(departments), F.col("department_id") == F.col("__d"), "left")
    return found.select("id", "username", "email", *(["role"] if approved else []), or_na(F.col("__department")).alias("department"))


def departments(departments: DataFrame) -> DataFrame:
    return departments.select("id", "name")


def manuals(manuals: DataFrame, departments: DataFrame, users: DataFrame, sections: DataFrame) -> DataFrame:
    """Manuals with names and number of sections, the newest first."""
    counts = sections.groupBy(F.col("manual_id").alias("__m")).agg(F.count("*").alias("__n"))
    people = users.select(F.col("id").alias("__u"), F.col("username").alias("__name"))
    found = manuals.join(_department_names(departments), F.col("department_id") == F.col("__d"), "left").join(people, F.col("uploaded_by_id") == F.col("__u"), "left").join(counts, F.col("id") == F.col("__m"), "left")
    return found.select("id", "title", or_na(F.col("__department")).alias("department"), or_na(F.col("__name")).alias("uploaded_by"), "uploaded_at", "version", F.coalesce("__n", F.lit(0)).alias("sections")).orderBy(F.desc("uploaded_at"), "id")


def can_list(is_staff: Column, department: Column, manual_department: Column) -> Column:
    """Staff read all manuals, others their department's; a null department matches none."""
    return F.coalesce(is_staff, F.lit(False)) | F.coalesce(department == manual_department, F.lit(False))


def can_upload(department: Column, manual_department: Column) -> Column:
    """Revisions go to the own department's manuals only, for staff too."""
    return F.coalesce(department == manual_department, F.lit(False))


def readable(manuals: DataFrame, department_id: int | None, is_staff: bool) -> DataFrame:
    """The manuals one stated reader may list."""
    return manuals.filter(can_list(F.lit(is_staff), F.lit(department_id).cast("long"), F.col("department_id")))


def access_counts(users: DataFrame, manuals: DataFrame) -> DataFrame:
    """For each user the numbers of manuals to list and to revise; counts by department, never user-manual pairs."""
    by = manuals.groupBy(F.col("department_id").alias("__md")).agg(F.count("*").alias("__own"))
    total = manuals.agg(F.count("*").alias("__all"))
    found = users.join(by, F.col("department_id") == F.col("__md"), "left").join(F.broadcast(total))  # one row
    own = F.coalesce("__own", F.lit(0))
    return found.select("id", F.when(F.coalesce("is_staff", F.lit(False)), F.col("__all")).otherwise(own).alias("may_list"), own.alias("may_upload"))


def sections(sections: DataFrame, manuals: DataFrame, departments: DataFrame, manual_id: int, department_id: int | None = None, is_staff: bool = True) -> DataFrame:
    """A manual's sections by order, with the manual's header; none for a reader without access."""
    head = lookup(manuals, manual_id).join(_department_names(departments), F.col("department_id") == F.col("__d"), "left")
    if not is_staff:
        head = head.filter(F.col("department_id") == F.lit(department_id))
    head = head.select(F.col("id").alias("__m"), F.col("title").alias("manual"), F.col("version").alias("manual_version"), or_na(F.col("__department")).alias("department"))
    found = children(sections, "manual_id", manual_id).join(F.broadcast(head), F.col("manual_id") == F.col("__m"))  # one row
    return found.select("manual", "manual_version", "department", "id", "subtitle", "content", preview(F.col("content"), 200).alias("preview"), "tag", "page_number", "order", "version").orderBy("order", "id")


def history(history: DataFrame, sections: DataFrame, users: DataFrame, section_id: int | None = None) -> DataFrame:
    """Versions of sections with the present one last, edited by 'Current'."""
    if section_id is not None:
        lookup(sections, section_id)
        history, sections = children(history, "section_id", section_id), children(sections, "id", section_id)
    people = users.select(F.col("id").alias("__u"), F.col("username").alias("__name"))
    old = history.join(people, F.col("edited_by_id") == F.col("__u"), "left").select("section_id", "version", "subtitle", "content", "tag", or_na(F.col("__name")).alias("edited_by"), "edited_at", F.lit(False).alias("is_current"))
    now = sections.select(F.col("id").alias("section_id"), "version", "subtitle", "content", "tag", F.lit("Current").alias("edited_by"), F.lit(None).cast("timestamp").alias("edited_at"), F.lit(True).alias("is_current"))
    return old.unionByName(now).orderBy("section_id", "is_current", "version")


def previous(versions: DataFrame, by: str = "section_id", order: tuple[str, ...] = ("is_current", "version"), column: str = "content") -> DataFrame:
    """Adds previous_<column>, of the version before; null for the first."""
    return versions.withColumn(f"previous_{column}", F.lag(column).over(Window.partitionBy(by).orderBy(*order)))


def revisions(revisions: DataFrame, sections: DataFrame, manuals: DataFrame, departments: DataFrame, users: DataFrame, status: str | None = None) -> DataFrame:
    """Revisions with their section, manual, department and submitter, the newest first; of one status if that isn't empty."""
    if status:
        revisions = revisions.filter(F.col("status") == status)
    s = sections.select(F.col("id").alias("__s"), "manual_id", F.col("subtitle").alias("section"))
    m = manuals.select(F.col("id").alias("__m"), F.col("title").alias("manual"), "department_id")
    people = users.select(F.col("id").alias("__u"), F.col("username").alias("__name"))
    found = revisions.join(s, F.col("section_id") == F.col("__s")).join(m, F.col("manual_id") == F.col("__m")).join(_department_names(departments), F.col("department_id") == F.col("__d"), "left").join(people, F.col("submitted_by_id") == F.col("__u"), "left")
    return found.select("id", "section", "manual", or_na(F.col("__department")).alias("department"), or_na(F.col("__name")).alias("submitted_by"), "status", preview(F.col("diff_text"), 300).alias("diff_preview"), "submitted_at", "reviewer_notes").orderBy(F.desc("submitted_at"), "id")


def login(users: DataFrame, departments: DataFrame) -> DataFrame:
    """What a login shows of each user: allowed (approved), role, department id and name, null without one."""
    found = users.join(_department_names(departments), F.col("department_id") == F.col("__d"), "left")
    return found.select("id", "username", "role", F.col("department_id"), F.col("__department").alias("department"), F.coalesce("is_approved", F.lit(False)).alias("allowed"))


def admin_list(df: DataFrame, columns: list[str], **facets: object) -> DataFrame:
    """A projection filtered by facets; a facet of None takes rows without a value."""
    for name, value in facets.items():
        c: Column = F.col(name)
        df = df.filter(c.isNull() if value is None else c == F.lit(value))
    return df.select(*columns)
