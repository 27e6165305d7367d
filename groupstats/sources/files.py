"""Scans and sinks."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupstats.operators.columns import nan_to_null

#: Texts that stand for a missing value (fixed values: the defaults of the usual CSV readers of data frames).
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)
#: Threads that read the first lines of files.
PROBES = 32


def _layouts(spark: SparkSession, path: str | Sequence[str]) -> dict[str, list[str]]:
    """The files under ``path`` by their first line. Only first lines are read, by a pool of threads."""
    files = spark.read.text(path).inputFiles()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def first_line(name: str) -> str | None:
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        stream = place.getFileSystem(conf).open(place)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        reader = jvm.java.io.BufferedReader(
            jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        )
        try:
            return reader.readLine()
        finally:
            reader.close()

    with ThreadPoolExecutor(PROBES) as pool:
        firsts = list(pool.map(first_line, files))
    layouts: dict[str, list[str]] = {}
    for name, first in zip(files, firsts):
        if first is not None:  # an empty file has no rows
            layouts.setdefault(first, []).append(name)
    return layouts


def _texts(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> Iterator[DataFrame]:
    """The declared columns of every layout as texts, missing ones as NULL, with the file and the record of each row."""
    for first, files in sorted(_layouts(spark, path).items()):
        header = next(csv.reader([first.removeprefix("\ufeff")]))
        if len(set(header)) < len(header):
            raise ValueError(f"repeated columns in {files[0]}")
        missing = [n for n in schema.names if n not in set(header)]
        if missing:
            raise ValueError(f"columns not in {files[0]}: {', '.join(missing)}")
        full = T.StructType([T.StructField(n, T.StringType()) for n in header])
        rows = spark.read.csv(files, header=True, schema=full, enforceSchema=True, emptyValue="")

        def value(name: str) -> Column:
            return F.when(~F.coalesce(F.trim(name), F.lit("")).isin(*MISSING_TEXTS), F.col(f"`{name}`")).alias(name)

        record = F.to_json(F.struct(*[F.col(f"`{n}`") for n in header])).alias("_record")
        yield rows.select(F.col("_metadata.file_path").alias("_file"), record, *map(value, schema.names))


def _parsed(field: T.StructField) -> Column:
    """A text as a value of its declared type, NULL if it is none."""
    text = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return text
    text = F.trim(text)
    if isinstance(field.dataType, T.IntegralType):  # whole numbers may be written with a point
        exact = text.try_cast(T.DecimalType(38, 6))
        return F.when(exact == F.floor(exact), exact.try_cast(field.dataType))
    return text.try_cast(field.dataType)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, rows: int | None = None, bad: str = "fail"
) -> DataFrame:
    """CSV files with headers: the declared columns, by name, with their declared types.

    Every file is read by its own header: files may hold more columns, in another order each; files of one layout are read
    together. The usual markers of missing values (:data:`MISSING_TEXTS`) are NULL in text columns too, and floating NaN is
    NULL, so no operator meets it. A value that is not of the declared type stops the scan (``bad="fail"``) or is NULL
    (``bad="null"``); :func:`bad_values` lists them. ``rows`` limits the scan.
    """
    if bad not in ("fail", "null"):
        raise ValueError("bad is fail or null")

    def value(field: T.StructField) -> Column:
        made, text = _parsed(field), F.col(f"`{field.name}`")
        if bad == "fail" and not isinstance(field.dataType, T.StringType):
            said = F.concat(F.lit(f"column {field.name} in "), F.col("_file"), F.lit(": "), text)
            made = F.when(text.isNotNull() & made.isNull(), F.raise_error(said).cast(field.dataType)).otherwise(made)
        return made.alias(field.name)

    parts = [part.select(*[value(f) for f in schema]) for part in _texts(spark, path, schema)]
    df = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    df = nan_to_null(df)
    return df if rows is None else df.limit(rows)


def bad_values(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """``(file, column, value, record)``: every value that is not of its declared type, with its whole record as JSON."""
    found = []
    for part in _texts(spark, path, schema):
        wrong = [
            F.when(F.col(f"`{f.name}`").isNotNull() & _parsed(f).isNull(), F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("value")))
            for f in schema if not isinstance(f.dataType, T.StringType)
        ]
        listed = F.filter(F.array(*wrong), lambda w: w.isNotNull()) if wrong else F.array().cast("array<struct<column:string,value:string>>")
        found.append(part.select(F.col("_file").alias("file"), F.col("_record").alias("record"), F.inline(listed)))
    if not found:
        return spark.createDataFrame([], "file string, column string, value string, record string")
    return reduce(DataFrame.unionByName, found).select("file", "column", "value", "record")


def read_table(spark: SparkSession, path: str, drop: tuple[str, ...] = ("index",)) -> DataFrame:
    """Columnar table without the index column a writer may have left in it."""
    return spark.read.parquet(path).drop(*drop)


def convert_csv(
    spark: SparkSession, source: str, target: str, schema: T.StructType, partition_by: tuple[str, ...] = ()
) -> None:
    """CSV to Parquet, optionally in one folder per value (such as the year)."""
    read_csv(spark, source, schema).write.partitionBy(*partition_by).parquet(target)


def write_scored(train: DataFrame, test: DataFrame, path: str) -> None:
    """Scored training and test rows in one table with a folder per split."""
    both = train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )
    both.write.partitionBy("split").parquet(path)


def write_sample(df: DataFrame, path: str) -> None:
    """Held-out rows as CSV with a header."""
    df.write.csv(path, header=True)
