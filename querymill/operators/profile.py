"""Column profiles in one scan of a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.operators.ranking import first_distinct

EXAMPLES_PER_COLUMN = 5
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def null_profile(df: DataFrame, table_name: str) -> DataFrame:
    """Which columns hold a NULL: one aggregate over all columns, then one row per column."""
    flags = df.agg(*[F.max(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return flags.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (col_name, contains_null)").select(
        F.lit(table_name).alias("table_name"), "col_name", F.coalesce("contains_null", F.lit(False)).alias("contains_null")
    )


def _smallest(names: list[str], n: int):
    """Per partition, the n smallest distinct values of every column: far fewer rows to shuffle than all distinct values."""
    schema = pa.schema([("col_name", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, pa.Array] = {}
        for batch in batches:
            for name in names:
                values = pc.unique(batch.column(name).cast(pa.string()))
                if name in kept:
                    values = pc.unique(pa.concat_arrays([kept[name], values]))
                order = pc.array_sort_indices(values, null_placement="at_start")
                kept[name] = values.take(order[:n])
        for name, values in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(values), pa.string()), values], schema=schema)

    return run


def as_text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string").alias(name)


def within(value: Column, max_length: int | None) -> Column:
    """Below the length limit, if there is one."""
    return F.lit(True) if max_length is None else F.length(value) < max_length


def smallest_distinct(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """First ``n`` distinct values of every column by text: ``col_name, value, rn``; NULL sorts first."""
    partial = df.select(*[as_text(c) for c in columns]).mapInArrow(_smallest(columns, n), "col_name string, value string")
    return first_distinct(partial, ["col_name"], "value", n)


def value_examples(df: DataFrame, table_name: str, columns: list[str], n: int = EXAMPLES_PER_COLUMN, max_length: int | None = None) -> DataFrame:
    """Up to ``n`` distinct values per column, *then* without NULL, blank, zero and, with a limit, long ones."""
    numeric = [c for c, t in df.dtypes if t.split("(")[0] in NUMERIC]
    first = smallest_distinct(df, columns, n)
    falsy = (F.col("value") == "") | (F.col("col_name").isin(numeric) & (F.col("value").try_cast("double") == 0))
    return first.filter(F.col("value").isNotNull() & within(F.col("value"), max_length) & ~falsy).select(
        F.lit(table_name).alias("table_name"), "col_name", F.col("rn").alias("ex_no"), "value"
    )


def distinct_values(df: DataFrame, table_name: str, columns: list[str], cap: int | None = None, max_length: int | None = None) -> DataFrame:
    """Values to index: all distinct ones per column, or the first ``cap``, then only non-blank and, with a limit, short ones."""
    if cap is None:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col_name"), as_text(c).alias("value")) for c in columns])).alias("p")
        first = df.select(pairs).select("p.*").distinct()
    else:
        first = smallest_distinct(df, columns, cap)
    return first.filter(F.col("value").isNotNull() & within(F.col("value"), max_length) & F.col("value").rlike(r"\S")).select(
        F.lit(table_name).alias("table_name"), "col_name", "value"
    )
