"""Schemas of the six entities and of the edit log, and upgrades of older files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations.
ROLES = ("admin", "staff")
TAGS = ("POLICY", "PROCEDURE", "RESPONSIBILITY", "WORKING INSTRUCTION", "UNTAGGED")
STATUSES = ("pending", "approved", "rejected")


_KINDS = {"bigint": T.LongType, "int": T.IntegerType, "string": T.StringType, "boolean": T.BooleanType, "timestamp": T.TimestampType}


def _schema(text: str) -> T.StructType:
    fields = [x.split(" ", 2) for x in text.replace("`", "").split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind](), not rest) for name, kind, *rest in fields])


SCHEMAS = {
    "department": _schema("id bigint not null, name string not null, created_at timestamp"),
    "user": _schema("id bigint not null, username string, email string, role string, is_approved boolean, is_staff boolean, is_superuser boolean, is_active boolean, last_login timestamp, date_joined timestamp, first_name string, last_name string, department_id bigint"),
    "manual": _schema("id bigint not null, title string, department_id bigint, uploaded_by_id bigint, file string, uploaded_at timestamp, version int"),
    "section": _schema("id bigint not null, manual_id bigint, subtitle string, content string, tag string, page_number int, `order` int, version int"),
    "section_history": _schema("id bigint not null, section_id bigint, version int, subtitle string, content string, tag string, edited_by_id bigint, edited_at timestamp"),
    "revision": _schema("id bigint not null, section_id bigint, submitted_by_id bigint, uploaded_file string, diff_text string, status string, submitted_at timestamp, reviewed_at timestamp, reviewer_notes string"),
    "edit_event": _schema("section_id bigint, seq int, has_subtitle boolean, subtitle string, has_content boolean, content string, has_page boolean, page_number int, has_order boolean, `order` int, actor bigint, ts timestamp"),
}

#: (child, column, parent, what a parent's deletion does to the child)
FOREIGN_KEYS = (
    ("user", "department_id", "department", "set null"),
    ("manual", "department_id", "department", "cascade"),
    ("manual", "uploaded_by_id", "user", "set null"),
    ("section", "manual_id", "manual", "cascade"),
    ("section_history", "section_id", "section", "cascade"),
    ("section_history", "edited_by_id", "user", "set null"),
    ("revision", "section_id", "section", "cascade"),
    ("revision", "submitted_by_id", "user", "set null"),
)


def upgrade(df: DataFrame, entity: str) -> DataFrame:
    """Rows of an older file in the present schema: missing columns are null, a missing version is 1."""
    out = []
    for field in SCHEMAS[entity].fields:
        c = F.col(f"`{field.name}`").cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        out.append((F.coalesce(c, F.lit(1)) if field.name == "version" else c).alias(field.name))
    return df.select(*out)
