"""Column profiles that are kept by part of a table and merged: counts, distinct values, largest value, mean and deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accuracy of a sketch: 2**LG_K cells, a relative standard error of about 1.04 / sqrt(2**LG_K), 0.8 %.
LG_K = 14


def sketch_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """One row per part (values of ``by``) and column, all columns in one scan and one map-side-combined aggregate.

    ``rows``, ``nulls``, ``largest`` (as text for text columns and as a number otherwise), ``mean`` and ``squares`` (sum of
    squared deviations) of numbers, and ``values``, a sketch of the distinct values. A row is as large as a sketch at most,
    whatever the part. Store it with the part: when parts are added, only theirs are made anew.
    """
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "char", "varchar")}

    def cell(c: str):
        number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
        if c in texts:
            text = F.col(c)
        else:
            number = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.max(number).alias("largest"),
            F.max(text).alias("largest_text"),
            F.avg(number).alias("mean"),
            (F.var_pop(number) * F.count(number)).alias("squares"),
            F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias("values"),
        ).alias(f"cell_{columns.index(c)}")

    cells = df.groupBy(*by).agg(*[cell(c) for c in columns])
    return cells.select(*by, F.inline(F.array(*[f"cell_{i}" for i in range(len(columns))])))


def merge_profiles(parts: DataFrame) -> DataFrame:
    """One row per column from the rows of all parts.

    ``distinct_values`` leaves NULL out; it is exact for a few hundred values and an estimate beyond (see ``LG_K``).
    ``mean`` and ``std`` (of the sample) are those of the whole table but for rounding, NULL for text.
    """
    here = F.col("rows") - F.col("nulls")
    mean = F.try_divide(F.sum(F.col("mean") * here), F.sum(F.when(F.col("mean").isNotNull(), here)))
    whole = parts.groupBy("column").agg(mean.alias("_mean"))
    apart = F.col("squares") + here * F.pow(F.col("mean") - F.col("_mean"), 2)
    n = F.sum(here)
    return (
        parts.join(F.broadcast(whole), "column")  # a row per column
        .groupBy("column")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("nulls").alias("nulls"),
            F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct_values"),
            F.max("largest").alias("largest"),
            F.max("largest_text").alias("largest_text"),
            F.first("_mean").alias("mean"),
            F.sqrt(F.try_divide(F.sum(apart), F.nullif(n - 1, F.lit(0)))).alias("std"),
        )
    )
