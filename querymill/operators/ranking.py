"""Ranks inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_rank(df: DataFrame, keys: list[str], hashed: str, tie: list[str], out: str = "rn", digits: int = 3) -> DataFrame:
    """``row_number() over (partition by keys order by hashed, tie)`` without one task per hot group.

    ``hashed`` is a hex digest, so its first digits cut every group into ordered, even slices. Rows
    are ranked slice by slice and shifted by the rows in the slices before; slices are counted with
    partial sums, and a group has at most 16^digits of them. The join on the slice is left to the planner.
    """
    cut = df.withColumn("_cut", F.substring(F.col(hashed), 1, digits))
    inside = cut.withColumn("_in", F.row_number().over(W.partitionBy(*keys, "_cut").orderBy(hashed, *tie)).cast("long"))
    sizes = cut.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(*keys, "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = inside.join(shift, [*keys, "_cut"])
    return ranked.withColumn(out, F.col("_in") + F.col("_shift")).drop("_cut", "_in", "_shift")


def first_distinct(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The ``n`` smallest distinct values per key, with their rank.

    ``df`` may repeat values. The ranking is done in slices of the value hash first, so that a hot key
    is not ranked in one task.
    """
    values = df.select(*keys, value).distinct().withColumn("_s", F.pmod(F.xxhash64(value), F.lit(64)))
    order = F.col(value).asc_nulls_first()
    sliced = values.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_s").orderBy(order))).filter(F.col("_r") <= n).drop("_r", "_s")
    return sliced.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("long")).filter(F.col("rn") <= n)
