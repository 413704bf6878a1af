"""From raw catalogs and tables to schema text with examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.functions.naming import column_comment, indexable, normalize_type, table_comment
from querymill.operators import catalog as cat
from querymill.operators.profile import distinct_values, null_profile, value_examples


def table_names(catalog: DataFrame) -> DataFrame:
    """``db_id, table_idx, table_name, table_comment`` of every original table."""
    original = catalog.select("db_id", F.posexplode("table_names_original").alias("table_idx", "table_name"))
    shown = catalog.select("db_id", F.posexplode("table_names").alias("display_idx", "display"))
    named = original.join(cat.match_display_tables(catalog), ["db_id", "table_idx"], "left").join(shown, ["db_id", "display_idx"], "left")
    display = F.coalesce("display", "table_name")
    return named.select("db_id", F.col("table_idx").cast("long").alias("table_idx"), "table_name", table_comment(F.col("table_name"), display).alias("table_comment"))


def describe_columns(catalog: DataFrame, declared: DataFrame, nulls: DataFrame, descriptions: DataFrame | None = None, null_note: bool = False) -> DataFrame:
    """Catalog columns ready for rendering.

    ``declared(db_id, table_name, col_name, declared_type, is_pk)``, ``nulls(db_id, table_name,
    col_name, contains_null)``; ``descriptions`` as in ``attach_descriptions``. A column without
    description is an error where descriptions are given.
    """
    names = ["db_id", "table_name", "col_name"]
    columns = cat.explode_catalog(catalog).join(declared, names).join(nulls, names, "left").join(cat.match_display_columns(catalog), ["db_id", "global_idx"], "left")
    described = columns.withColumn("column_description", F.lit(None).cast("string")).withColumn("value_description", F.lit(None).cast("string"))
    if descriptions is not None:
        described, missing = cat.attach_descriptions(columns, descriptions)
        if not missing.isEmpty():
            raise ValueError("columns without description")
    note = F.coalesce("contains_null", F.lit(False)) if null_note else None
    comment = column_comment(F.col("col_name"), F.coalesce("display_name", "col_name"), F.col("column_description"), F.col("value_description"), note)
    return described.join(table_names(catalog).select("db_id", "table_name", "table_comment"), ["db_id", "table_name"]).select(
        "db_id", "table_idx", "table_name", "table_comment", "col_idx", "col_name", "declared_type", normalize_type(F.col("declared_type")).alias("type_class"), comment.alias("comment"), "is_pk"
    )


def foreign_keys(catalog: DataFrame) -> DataFrame:
    """Foreign keys with plain names, numbered as in the catalog."""
    plain = lambda c: F.btrim(F.col(c), F.lit('"'))
    return cat.resolve_foreign_keys(catalog).select(
        "db_id", "fk_no", plain("table").alias("table_name"), plain("column").alias("col_name"), F.col("referenced_table").alias("ref_table"), plain("referenced_column").alias("ref_column")
    )


def profile_table(df: DataFrame, db_id: str, table_name: str) -> tuple[DataFrame, DataFrame]:
    """NULL flags and example values of one table: ``(nulls, examples)``."""
    db = F.lit(db_id).alias("db_id")
    return null_profile(df, table_name).select(db, "*"), value_examples(df, table_name, df.columns).select(db, "*")


def indexable_values(df: DataFrame, columns: DataFrame, db_id: str, table_name: str) -> DataFrame | None:
    """Distinct values of a table's text-like columns; None when it has none. Only column names reach the driver."""
    mine = columns.filter((F.col("db_id") == db_id) & (F.col("table_name") == table_name) & indexable(F.col("declared_type")))
    names = [r.col_name for r in mine.select("col_name").collect()]
    return distinct_values(df, table_name, names).select(F.lit(db_id).alias("db_id"), "*") if names else None


def example_lists(examples: DataFrame) -> DataFrame:
    """Example values as one array per column."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ex_no", "value"))), lambda x: x["value"])
    return examples.groupBy("db_id", "table_name", "col_name").agg(ordered.alias("examples"))
