"""JSON corpora and CSV descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


FILE, BLOCK = "_file", "_block"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Files cut behind every closing brace, by all tasks that read their byte ranges: place, text, and what a piece does to quotes and depth.

    ``odd``: it holds an odd number of quotes. ``outside`` and ``inside``: how the depth changes over it and its brace, if it starts outside
    or inside a string.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias("_i"), "value")
    plain = F.regexp_replace("value", r"\\[\s\S]", "")
    less = lambda x, signs: F.length(x) - F.length(F.translate(x, signs, ""))
    code = lambda x: F.regexp_replace(F.regexp_replace(x, r'"[^"]*"', ""), r'"[^"]*$', "")
    change = lambda x: less(x, "[{") - less(x, "]}")
    step = raw.withColumn("_plain", plain)
    step = step.withColumn("odd", (less(F.col("_plain"), '"') % 2).cast("int"))
    return step.select(
        FILE, BLOCK, "_i", "value", "odd",
        (change(code(F.col("_plain"))) + F.col("odd") - 1).alias("outside"),
        (change(code(F.regexp_replace("_plain", r'^[^"]*"?', ""))) - F.col("odd")).alias("inside"),
    )


def read_list(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects of JSON lists, one list a file, in a declared schema. A large file is read by many tasks.

    Where an element ends follows from prefix sums over the pieces between closing braces: of quotes, which tell what is inside
    a string, and of depth. Sums run inside a block and over one row a block; only the pieces of one element are put together. A
    file that is no list raises; an empty list has no rows.
    """
    inside = W.partitionBy(FILE, BLOCK).orderBy("_i")
    before, so_far = inside.rowsBetween(W.unboundedPreceding, -1), inside.rowsBetween(W.unboundedPreceding, 0)
    blocks_before = W.partitionBy(FILE).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    pieces = _pieces(spark, path).withColumn("_odd", zero(F.sum("odd").over(before)) % 2)
    # the depth if the block starts outside a string, and if it starts inside one
    pieces = pieces.withColumn("_a", F.when(F.col("_odd") == 0, F.col("outside")).otherwise(F.col("inside"))).withColumn("_b", F.when(F.col("_odd") == 0, F.col("inside")).otherwise(F.col("outside")))
    totals = pieces.groupBy(FILE, BLOCK).agg((F.sum("odd") % 2).alias("_q"), F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    totals = totals.withColumn("_in", zero(F.sum("_q").over(blocks_before)) % 2).withColumn("_t", F.when(F.col("_in") == 0, F.col("_ta")).otherwise(F.col("_tb")))
    starts = totals.select(FILE, BLOCK, "_in", zero(F.sum("_t").over(blocks_before)).alias("_depth"), F.min(BLOCK).over(W.partitionBy(FILE)).alias("_first"))
    known = pieces.join(starts, [FILE, BLOCK])
    depth = F.col("_depth") + F.when(F.col("_in") == 0, F.sum("_a").over(so_far)).otherwise(F.sum("_b").over(so_far))
    known = known.withColumn("_end", ((depth == 1) & ((F.col("_odd") + F.col("odd") + F.col("_in")) % 2 == 0)).cast("int"))
    known = known.withColumn("_n", zero(F.sum("_end").over(before))).withColumn("_start", (F.col(BLOCK) == F.col("_first")) & (F.row_number().over(inside) == 1))
    ends = known.groupBy(FILE, BLOCK).agg(F.sum("_end").alias("_e")).select(FILE, BLOCK, zero(F.sum("_e").over(blocks_before)).alias("_earlier"))
    wrong = F.col("_start") & ~F.ltrim(F.regexp_replace("value", r"\s", " ")).startswith("[")
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("expected a JSON list in "), F.col(FILE))).cast("string")).otherwise(F.col("value"))
    placed = known.join(ends, [FILE, BLOCK]).select(FILE, (F.col("_earlier") + F.col("_n")).alias("_element"), F.struct(BLOCK, "_i", checked.alias("value")).alias("p"))
    whole = placed.groupBy(FILE, "_element").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["value"]).alias("v"))
    text = F.regexp_replace(F.concat(F.array_join("v", "}"), F.lit("}")), r"^[^{]*", "")
    # what stands behind the last element has no brace of its own
    return whole.select(text.alias("t")).filter(F.col("t").startswith("{")).select(F.from_json("t", schema).alias("r")).select("r.*")


def read_corpus(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """Rows of JSON-list files, or of JSON-lines files, in a declared schema."""
    if not lines:
        return read_list(spark, path, schema)
    return spark.read.schema(schema).option("encoding", "UTF-8").json(path)


def write_corpus(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write as JSON lines or parquet, one file per partition."""
    df.write.mode("overwrite").format(fmt).save(path)


def corpus_union(*dfs: DataFrame) -> DataFrame:
    """All rows of all corpora; a field that one of them lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def read_descriptions(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Column descriptions, one CSV per table named after it, with their line order."""
    names = ("original_column_name", "column_description", "value_description")
    raw = spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).csv(path)
    table = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return raw.select(table.alias("table_name"), F.monotonically_increasing_id().alias("line_no"), *[F.col(n) for n in names])
