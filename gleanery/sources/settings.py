"""Settings from the Spark session, and small tables from JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PREFIX = "spark.gleanery."


def setting(spark: SparkSession, name: str, default: float | int | str) -> float | int | str:
    """spark.gleanery.<name> as the type of default; default where it is unset, empty or of another type."""
    found = spark.conf.get(f"{PREFIX}{name}", "")
    try:
        return type(default)(found) if found.strip() else default
    except ValueError:
        return default


def seeded(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """The rows of the array ``name`` in a JSON document, which seeds a demonstration."""
    book = spark.read.option("multiLine", True).schema(f"`{name}` array<struct<{schema}>>").json(path)
    return book.selectExpr(f"inline(`{name}`)")
