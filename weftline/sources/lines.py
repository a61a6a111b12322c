"""Rows as lines of JSON: reading with a schema and a reject column, writing compressed, rows as canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REJECT = "_rejected"


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of a folder or file of JSON lines, plain or compressed, in the given schema. A line that is no object of it
    has nulls and its text in ``_rejected``; empty lines are left out."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*fields.fields, T.StructField(REJECT, T.StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("_r")).select("_r.*")


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as gzip-compressed JSON lines, nulls kept."""
    rows.select(row_text(*rows.columns).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def row_text(*columns: str) -> Column:
    """A row as JSON text with its nulls, keys in the order given."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
