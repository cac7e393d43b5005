"""Who may see what, as SQL table functions with the reader's id as parameter.

``install`` names the tables and makes the functions, callable from ``spark.sql``. A
reader of NULL, or an id that no user has, is anonymous. Permission classes: anyone
(departments), authenticated readers (their department's manuals and sections; staff:
all), the department's own members (manuals whose revisions a reader may upload, staff or
not), and staff (users).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name, result columns and body of each function; the tables are views named quire_<entity>.
FUNCTIONS = {
    "departments_for": ("id BIGINT, name STRING", "SELECT id, name FROM quire_department"),
    "manuals_for": ("id BIGINT, title STRING, department_id BIGINT", "SELECT m.id, m.title, m.department_id FROM quire_manual m JOIN quire_user u ON u.id = reader WHERE u.is_staff OR u.department_id = m.department_id"),
    "sections_for": ("id BIGINT, manual_id BIGINT", "SELECT s.id, s.manual_id FROM quire_section s JOIN quire_manual m ON s.manual_id = m.id JOIN quire_user u ON u.id = reader WHERE u.is_staff OR u.department_id = m.department_id"),
    "uploads_for": ("id BIGINT, title STRING", "SELECT m.id, m.title FROM quire_manual m JOIN quire_user u ON u.id = reader WHERE u.department_id = m.department_id"),
    "users_for": ("id BIGINT, username STRING", "SELECT o.id, o.username FROM quire_user o JOIN quire_user u ON u.id = reader WHERE u.is_staff"),
}


def install(spark: SparkSession, departments: DataFrame, users: DataFrame, manuals: DataFrame, sections: DataFrame) -> None:
    """Make the functions of this session; they read the tables given last."""
    for name, df in (("department", departments), ("user", users), ("manual", manuals), ("section", sections)):
        df.createOrReplaceTempView(f"quire_{name}")
    for name, (columns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(reader BIGINT) RETURNS TABLE ({columns}) RETURN {body}")


def visible(spark: SparkSession, reader: int | None) -> DataFrame:
    """Rows (what, id) of everything that a reader may see or do."""
    who = "CAST(NULL AS BIGINT)" if reader is None else f"{int(reader)}L"
    return spark.sql(" UNION ALL ".join(f"SELECT '{name.removesuffix('_for')}' AS what, id FROM {name}({who})" for name in FUNCTIONS))
