"""Reading and writing the entities' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators.entities import SCHEMAS, upgrade


def read_entity(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    """An entity's Parquet table in its present schema, whatever version wrote it."""
    return upgrade(spark.read.parquet(f"{folder}/{entity}"), entity)


def write_entity(df: DataFrame, folder: str, entity: str, mode: str = "append") -> None:
    df.select(*[f"`{f.name}`" for f in SCHEMAS[entity].fields]).write.mode(mode).parquet(f"{folder}/{entity}")


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text in ``value``, nulls included."""
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
