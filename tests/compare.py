"""Row-by-row comparison of a query with its SQL, ignoring order."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(kind: pa.DataType) -> str:
    text = str(kind)
    return text.replace("large_string", "string")


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    """What differs, or None."""
    ours, theirs = sorted(spark_table.column_names), sorted(sql_table.column_names)
    if ours != theirs:
        return f"columns {ours} and {theirs}"
    kinds = [(c, _plain(spark_table.schema.field(c).type), _plain(sql_table.schema.field(c).type)) for c in ours]
    wrong = [k for k in kinds if k[1] != k[2]]
    if wrong:
        return f"types {wrong}"
    if spark_table.num_rows != sql_table.num_rows:
        return f"rows {spark_table.num_rows} and {sql_table.num_rows}"

    def rows(table: pa.Table) -> list:
        columns = [table.column(c).to_pylist() for c in ours]
        return sorted(map(repr, zip(*columns)))

    a, b = rows(spark_table), rows(sql_table)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
