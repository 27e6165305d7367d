"""Declared schemas and column lists kept in text files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from groupstats.functions import fixed

LABEL_PREFIX = "hr_"


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small configuration file on any file system Spark reads."""
    return [r["value"].strip() for r in spark.read.text(path).collect()]


def spark_type(name: str) -> T.DataType:
    """Spark type of a declared dtype; ``object`` is text."""
    if name == "object":
        return T.StringType()
    if name.startswith(("int", "uint")):
        return T.LongType() if name.endswith("64") else T.IntegerType()
    if name.startswith("float"):
        return T.DoubleType()
    if name == "bool":
        return T.BooleanType()
    raise ValueError(f"unknown declared type {name}")


def load_schema(
    spark: SparkSession, path: str, allowed_labels: Iterable[str] = tuple(fixed.ALLOWED_LABELS)
) -> T.StructType:
    """Schema from ``name,dtype`` lines, without result columns that are not allowed."""
    allowed = set(allowed_labels)
    fields = []
    for line in filter(None, _lines(spark, path)):
        name, kind = line.split(",")[:2]
        if name.startswith(LABEL_PREFIX) and name not in allowed:
            continue
        fields.append(T.StructField(name, spark_type(kind)))
    return T.StructType(fields)


def load_removes(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of an exclude list; blank lines and ``#`` comments are skipped."""
    return sorted(line for line in _lines(spark, path) if line and not line.startswith("#"))


def load_keeps(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of an include list, every line taken as it is."""
    return sorted(_lines(spark, path))


def codes_and_numbers(schema: T.StructType) -> tuple[Sequence[str], Sequence[str]]:
    """Sorted names of text columns and of all others."""
    codes = sorted(f.name for f in schema if isinstance(f.dataType, T.StringType))
    return codes, sorted(f.name for f in schema if f.name not in set(codes))
