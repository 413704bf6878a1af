"""Words, lines and staged tables that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
BROADCAST_ROWS = 250_000


def words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def text_key(text: Column) -> Column:
    """Sixteen bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a staged table for broadcast when it has at most this many rows; beyond that the planner shuffles it.

    Counting a staged Parquet table reads its footers only.
    """
    return F.broadcast(table) if table.count() <= rows else table


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``_row``, so that helper columns cannot clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
