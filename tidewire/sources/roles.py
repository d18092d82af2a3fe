"""Role exports: a JSON list of roles with nested attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE_EXPORT = "id string, name string, attributes map<string,string>"


def read_roles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``id, name, attributes``; attribute lists are written as text such as ``[true]``.

    Use ``lines`` (one role per line) for large exports: such files can be split.
    """
    roles = spark.read.schema(ROLE_EXPORT).json(path, multiLine=not lines)

    def as_text(_, value):
        items = F.from_json(value, "array<string>")
        listed = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
        return F.when(value.startswith("["), listed).otherwise(value)

    return roles.withColumn("attributes", F.transform_values("attributes", as_text))
