"""Encodings of code columns: target means, rare folding, labels, one-hot."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groupstats.functions import columns as fc
from groupstats.functions import fixed
from groupstats.operators import pair_tables
from groupstats.operators.columns import encoded_name
from groupstats.session import SMALL_ROWS, setting, stored
from groupstats.skew import Fitted, attach, attach_many, freeze, number_rows

# -------------------------------------------------------------- value counts


def _cells(df: DataFrame, columns: Sequence[str], null_as: str | None = None) -> DataFrame:
    """Long form (column, value) of code columns, kept local to each task."""

    def value(c: str) -> Column:
        text = F.col(c).cast("string")
        return text if null_as is None else F.coalesce(text, F.lit(null_as))

    rows = [F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per code and column, NULL left out; one aggregation for all columns."""
    cells = _cells(df, columns).filter(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column, NULL counted as one of them."""
    counted = _cells(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_rows"))
    return counted.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))


# -------------------------------------------------------------- rare folding


def fit_frequent(df: DataFrame, columns: Sequence[str], at_least: int) -> Fitted:
    """The codes of each column that occur at least so often."""
    counts = value_counts(df, columns).filter(F.col("count") >= at_least)
    return freeze(counts.select("column", "value", F.lit(True).alias("_frequent")))


def _fold(df: DataFrame, columns: Sequence[str], frequent: Fitted, fill: str, fold_null: bool) -> DataFrame:
    found = attach_many(df, frequent, "column", "value", {c: F.col(c).cast("string") for c in columns})

    def folded(c: str) -> Column:
        keep = F.col(f"`_got_{c}`").isNotNull()
        if not fold_null:
            keep = keep | F.col(c).isNull()
        return F.when(keep, F.col(c)).otherwise(F.lit(fill)).alias(c)

    return found.select(*[folded(c) if c in set(columns) else c for c in df.columns])


def fold_others(
    df: DataFrame,
    columns: Sequence[str],
    group: str = "hi_RaceID",
    keep_above: int = fixed.KEEP_ABOVE,
    frequent: Fitted | None = None,
) -> DataFrame:
    """Codes that occur ``keep_above`` times or less, and NULL, become ``others``."""
    columns = [c for c in df.columns if c in set(columns) and c != group]
    frequent = frequent or fit_frequent(df, columns, keep_above + 1)
    return _fold(df, columns, frequent, "others", fold_null=True)


def fold_few(
    df: DataFrame,
    columns: Sequence[str],
    group: str = "hi_RaceID",
    below: int = fixed.FEW_BELOW,
    frequent: Fitted | None = None,
) -> DataFrame:
    """Codes that occur less than ``below`` times become ``few``; NULL stays."""
    columns = [c for c in df.columns if c in set(columns) and c != group]
    frequent = frequent or fit_frequent(df, columns, below)
    return _fold(df, columns, frequent, "few", fold_null=False)


# ------------------------------------------------------------ label encoding


def fit_labels(df: DataFrame, columns: Sequence[str]) -> Fitted:
    """Codes of each column numbered from 0 in alphabetical order, NULL as ``nan``."""
    distinct = _cells(df, columns, null_as="nan").distinct()
    numbered = number_rows(distinct, "column", [F.col("value").asc()], "_number")
    return freeze(numbered.select("column", "value", (F.col("_number") - 1).alias("_label")))


def label_encode(
    df: DataFrame, columns: Sequence[str], labels: Fitted | None = None, kind: str = "int"
) -> DataFrame:
    """Replace codes by their labels; a code not seen in fitting gets NULL.

    ``kind`` is the integer type of the result; use ``long`` for keys with
    more than two billion values.
    """
    columns = [c for c in df.columns if c in set(columns)]
    labels = labels or fit_labels(df, columns)
    codes = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns}
    found = attach_many(df, labels, "column", "value", codes)
    label = lambda c: F.col(f"`_got_{c}`._label").cast(kind).alias(c)
    return found.select(*[label(c) if c in codes else c for c in df.columns])


# ------------------------------------------------------------------- one-hot


def one_hot(df: DataFrame, columns: Sequence[str], max_columns: int = 1000) -> DataFrame:
    """Replace each code column by one 0/1 column per value, named ``<column>_<value>``.

    This widens the schema, so the numbers of values are counted first: code columns with few values come first, and those that would
    bring more than ``max_columns`` columns in all become sparse vectors instead, see :func:`one_hot_vector`.
    """
    columns = [c for c in df.columns if c in set(columns)]
    counts = value_counts(df, columns).select("column", "value")
    sizes = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
    room, narrow = max_columns, []
    for c in sorted(columns, key=lambda c: (sizes.get(c, 0), c)):
        room -= sizes.get(c, 0)
        if room >= 0:
            narrow.append(c)
    found = counts.filter(F.col("column").isin(narrow)).collect() if narrow else []  # at most max_columns
    flags = [
        fc.value_flag(F.col(c).cast("string"), v, "tinyint").alias(f"{c}_{v}")
        for c, v in sorted((r["column"], r["value"]) for r in found)
    ]
    flat = df.select(*[c for c in df.columns if c not in set(narrow)], *flags)
    wide = [c for c in columns if c not in set(narrow)]
    return one_hot_vector(flat, wide) if wide else flat


def one_hot_vector(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each code column by a sparse 0/1 vector ``<column>_vector``."""
    indexer = StringIndexer(
        inputCols=list(columns), outputCols=[f"_{c}_index" for c in columns],
        stringOrderType="alphabetAsc", handleInvalid="keep",
    )
    encoder = OneHotEncoder(
        inputCols=[f"_{c}_index" for c in columns], outputCols=[f"{c}_vector" for c in columns],
        dropLast=False,
    )
    indexed = indexer.fit(df).transform(df)
    return encoder.fit(indexed).transform(indexed).drop(*columns, *[f"_{c}_index" for c in columns])


# ----------------------------------------------------------- target encoding


@dataclass(frozen=True)
class TargetMeans:
    """Per-key target means and row counts, and the means over all rows."""

    table: Fitted
    priors: dict[str, float | None]


def _target_stats(targets: Sequence[str]) -> list[Column]:
    stats = [F.count(F.lit(1)).alias("_n")]
    for t in targets:
        stats += [F.sum(t).alias(f"_sum_{t}"), F.count(t).alias(f"_count_{t}")]
    return stats


def _priors(table: DataFrame, targets: Sequence[str]) -> dict[str, float | None]:
    row = table.agg(
        *[F.try_divide(F.sum(f"_sum_{t}"), F.sum(f"_count_{t}")).alias(t) for t in targets]
    ).first()
    return row.asDict()


def _smoothed(target: str, prior: float | None, k: float, f: float, smoothing: bool) -> Column:
    mean = F.try_divide(F.col(f"_sum_{target}"), F.col(f"_count_{target}"))
    if not smoothing:
        return mean
    weight = fc.logistic((F.col("_n") - k) / f)
    return weight * mean + (1 - weight) * F.lit(prior).cast("double")


def fit_target_means(df: DataFrame, key: str, targets: Sequence[str]) -> TargetMeans:
    """Sums and counts per key; the prior also counts rows without a key."""
    table = freeze(df.groupBy(key).agg(*_target_stats(targets)))
    return TargetMeans(table, _priors(table.rows, targets))


def target_encode(
    df: DataFrame,
    key: str,
    target: str,
    name: str | None = None,
    k: float = fixed.SMOOTHING_ROWS,
    f: float = fixed.SMOOTHING_SCALE,
    smoothing: bool = True,
    fitted: TargetMeans | None = None,
    unseen: str = "drop",
) -> DataFrame:
    """Append the key's target mean, pulled to the overall mean when the key is small.

    The weight of the key mean is ``1 / (1 + exp(-(n - k) / f))``, where ``n``
    counts all rows of the key. Rows without a key drop out. For a table that
    was not fitted on, ``unseen="prior"`` keeps unknown keys at the overall mean.
    """
    fitted = fitted or fit_target_means(df, key, [target])
    prior = fitted.priors[target]
    name = name or f"{key}_te"
    value = _smoothed(target, prior, k, f, smoothing).alias(name)
    table = Fitted(
        fitted.table.rows.filter(F.col(key).isNotNull()).select(key, value), fitted.table.small
    )
    if unseen == "prior":
        joined = attach(df, table, key, "left").withColumn(
            name, F.coalesce(F.col(name), F.lit(prior).cast("double"))
        )
    else:
        joined = attach(df, table, key)
    return joined.select(*df.columns, name)


#: Cells of the looked-up grids for each row that a broadcast table may have: a cell takes 8 bytes a target.
GRID_CELLS = 32
#: Types that go through Arrow and back as they are.
PLAIN = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _fit_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], targets: Sequence[str]) -> DataFrame:
    """(_pair, _key, _entry, _group) with the rows, sums and counts of targets of each pair of values; stored."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    stats = ["_n", *[f"_{kind}_{t}" for t in targets for kind in ("sum", "count")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pair_tables.count_pairs(batches, pairs, targets)

    rows = df.select(*_texts(columns), *[F.col(t).cast("double").alias(t) for t in targets])
    kinds = ", ".join(f"`{s}` {'double' if s.startswith('_sum') else 'long'}" for s in stats)
    counted = rows.mapInArrow(run, f"_pair int, _entry string, _group string, {kinds}")
    key = fc.text_key(F.col("_entry"), F.col("_group"))
    return stored(counted.groupBy("_pair", key.alias("_key"), "_entry", "_group").agg(*[F.sum(s).alias(s) for s in stats]), "fitted")


def _texts(columns: Sequence[str]) -> list[Column]:
    """The parts of :func:`text_key`."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(pair_tables.text(c)) for c in columns]


def encode_pairs(
    df: DataFrame,
    group_codes: Sequence[str] = tuple(fixed.ENCODED_RACE_CODES),
    entry_codes: Sequence[str] = tuple(fixed.ENCODED_ENTRY_CODES),
    targets: Sequence[str] = ("is_place", "margin"),
    k: float = fixed.SMOOTHING_ROWS,
    f: float = fixed.SMOOTHING_SCALE,
    keep: Sequence[str] | None = None,
    finish: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Target-encode every pair of a group code and an entry code.

    Absent columns are skipped. All pairs and targets are fitted in one scan and looked up in another; a row is not multiplied
    by the pairs in either. The smallest pairs are looked up in arrays, as many as have ``GRID_CELLS`` cells for each of the
    ``spark.groupstats.smallRows``, all others by joins. Results are ``<group code>_<entry code>_te_<target>``, next to the
    columns in ``keep`` (all by default). ``finish`` changes each result, such as by rounding; it is worked out once a key.
    """
    pairs = {
        f"{encoded_name(g)}_{encoded_name(e)}_te": (e, g)
        for g in group_codes for e in entry_codes if g in df.columns and e in df.columns
    }
    kept = df.columns if keep is None else list(keep)
    if not pairs:
        return df.select(*kept)
    stems, spark = list(pairs), df.sparkSession
    counted = _fit_pairs(df, list(pairs.values()), targets)
    priors = _priors(counted.filter(F.col("_pair") == 0), targets)
    same_key = Window.partitionBy("_pair", "_key")  # different values can read the same
    stats = counted.columns[4:]
    totals = counted.select(*counted.columns[:4], *[F.sum(s).over(same_key).alias(s) for s in stats])
    value = lambda t: _smoothed(t, priors[t], k, f, True)
    values = [(finish(value(t)) if finish else value(t)).alias(t) for t in targets]
    table = totals.select("_pair", "_key", "_entry", "_group", *values)

    cells = F.approx_count_distinct("_entry") * F.approx_count_distinct("_group")
    sizes = {r["_pair"]: r["cells"] for r in counted.groupBy("_pair").agg(cells.alias("cells")).collect()}  # one row a pair
    room, held, spread = GRID_CELLS * setting(spark, SMALL_ROWS), [], []
    plain = all(isinstance(df.schema[c].dataType, PLAIN) for c in kept)
    for i in sorted(range(len(stems)), key=lambda i: (sizes.get(i, 0), i)):
        room -= sizes.get(i, 0)
        (held if room >= 0 and plain else spread).append(i)
    found = df
    if spread:
        named = F.element_at(F.array(*[F.lit(s) for s in stems]), F.col("_pair") + 1).alias("_pair")
        apart = table.filter(F.col("_pair").isin(spread)).select(named, "_key", *targets).dropDuplicates(["_pair", "_key"])
        keys = {stems[i]: fc.text_key(*[F.col(c) for c in pairs[stems[i]]]) for i in spread}
        found = attach_many(df, Fitted(stored(apart, "pairs"), False), "_pair", "_key", keys, "inner")
    joined = {f"{stems[i]}_{t}": F.col(f"`_got_{stems[i]}`").getField(t).alias(f"{stems[i]}_{t}") for i in spread for t in targets}
    names = [f"{stem}_{t}" for stem in stems for t in targets]
    if not held:
        return found.select(*kept, *[joined[n] for n in names])
    looked_up = {i: pairs[stems[i]] for i in sorted(held)}
    small = table.filter(F.col("_pair").isin(held)).select("_pair", "_entry", "_group", *targets).toArrow()
    grids, there = spark.sparkContext.broadcast(pair_tables.grids(small, looked_up, targets)), set(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pair_tables.find_pairs(batches, grids.value, kept, names, there)

    rows = found.select(*kept, *joined.values(), *_texts(list(dict.fromkeys(c for pair in looked_up.values() for c in pair))))
    # in the order of the results: a step over so many columns would be too long for Java's compiler
    return rows.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(n, T.DoubleType()) for n in names]]))


# ---------------------------------------------------------------- code sizes


def max_codes(frames: Sequence[DataFrame], codes: Sequence[str]) -> DataFrame:
    """Largest label of each code column over several frames, as (column, max_code)."""
    codes = [c for c in codes if any(c in f.columns for f in frames)]
    every = None
    for frame in frames:
        part = frame.select(*[c for c in codes if c in frame.columns])
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    row = every.agg(*[F.max(c).alias(c) for c in codes])
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("long").alias("max_code")) for c in codes
    ]
    return row.select(F.inline(F.array(*cells)))


def embedding_widths(max_code: DataFrame, steps: str = "divided") -> DataFrame:
    """Embedding width of each column from the number of its labels."""
    return max_code.withColumn("width", fc.embedding_width(F.col("max_code") + 1, steps))


# ---------------------------------------------------------------- model input


def model_input(df: DataFrame, numbers: Sequence[str], codes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numbers as one array ``main`` next to each code column."""
    main = F.array(*[F.col(c).cast("double") for c in sorted(numbers)]).alias("main")
    return df.select(*keep, main, *sorted(codes))
