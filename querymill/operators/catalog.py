"""Database catalogs: nested arrays to long tables, display names, keys.

A raw catalog row is one database: ``db_id, table_names, table_names_original`` (string arrays),
``column_names, column_names_original`` (arrays of ``struct<table_idx, name>``) and
``foreign_keys`` (array of ``struct<from_idx, to_idx>`` over column positions). One database's
schema is the largest group here; it is bounded by what a database engine allows in a schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.functions.examples import let
from querymill.functions.naming import name_key


def load_catalog(entries: DataFrame, order: str, db_ids: list[str] | None = None) -> DataFrame:
    """One entry per database, the last one by ``order``; optionally only some databases."""
    wanted = entries if db_ids is None else entries.filter(F.col("db_id").isin(db_ids))
    rest = [c for c in entries.columns if c not in ("db_id", order)]
    last = wanted.groupBy("db_id").agg(F.max_by(F.struct(order, *rest), order).alias("_e"))
    return last.select("db_id", "_e.*")


def list_databases(databases: DataFrame, values: DataFrame) -> DataFrame:
    """Every database with whether it has content to index."""
    content = values.select("db_id").distinct().withColumn("_has", F.lit(True))
    return databases.select("db_id").distinct().join(content, "db_id", "left").select("db_id", F.when(F.col("_has"), "indexed").otherwise("missing").alias("status"))


def explode_catalog(catalog: DataFrame) -> DataFrame:
    """Long columns: ``db_id, table_idx, table_name, global_idx, col_idx, col_name``.

    ``global_idx`` is the position in the catalog's column list, ``col_idx`` restarts in each table.
    """
    columns = catalog.select("db_id", "table_names_original", F.posexplode("column_names_original").alias("global_idx", "c"))
    named = columns.filter("c.table_idx >= 0").select(
        "db_id",
        F.col("c.table_idx").cast("long").alias("table_idx"),
        F.try_element_at("table_names_original", (F.col("c.table_idx") + 1).cast("int")).alias("table_name"),
        F.col("global_idx").cast("long").alias("global_idx"),
        F.col("c.name").alias("col_name"),
    )
    w = W.partitionBy("db_id", "table_idx").orderBy("global_idx")
    return named.withColumn("col_idx", (F.row_number().over(w) - 1).cast("long"))


def display_positions(original: Column, display: Column) -> Column:
    """Per original table the position of its display table, from the two lists of names.

    A display name goes to the first original with an equivalent name, if no other display name
    is equivalent too; everything else keeps its position, as far as there is one.
    """
    keys = lambda names: F.transform(names, name_key)

    def place(k: Column, i: Column, own: Column, shown: Column) -> Column:
        alone = F.size(F.filter(shown, lambda x: x == k)) == 1
        match = F.when((F.array_position(own, k) == i + 1) & alone, F.array_position(shown, k) - 1)
        return F.coalesce(match, F.when(i < F.size(shown), i)).cast("long")

    return let(keys(original), lambda own: let(keys(display), lambda shown: F.transform(own, lambda k, i: place(k, i, own, shown))))


def match_display_tables(catalog: DataFrame) -> DataFrame:
    """Original table position -> display table position, see ``display_positions``."""
    places = catalog.select("db_id", F.posexplode(display_positions(F.col("table_names_original"), F.col("table_names"))).alias("table_idx", "display_idx"))
    return places.select("db_id", F.col("table_idx").cast("long").alias("table_idx"), "display_idx")


def match_display_columns(catalog: DataFrame) -> DataFrame:
    """Display name per original column: ``db_id, global_idx, display_name``.

    By position when both lists agree on the table of every position; else, where a table and
    its display table have equally many columns, by position inside the table; else none. All
    of it happens inside a database's row.
    """
    pairs = F.arrays_zip(F.col("column_names").alias("d"), F.col("column_names_original").alias("o"))
    aligned = F.forall(pairs, lambda p: p["d"]["table_idx"] == p["o"]["table_idx"])
    named = lambda i, c: F.struct(i.cast("long").alias("global_idx"), c["name"].alias("display_name"))
    by_position = F.transform("column_names", lambda c, i: named(i, c))
    mine = lambda t: F.filter(F.transform("column_names_original", lambda c, i: F.when(c["table_idx"] == t, i)), lambda i: i.isNotNull())
    shown = lambda d: F.filter("column_names", lambda c: c["table_idx"] == d)
    fit = lambda own, cols: F.when(F.size(own) == F.size(cols), F.zip_with(own, cols, named)).otherwise(F.slice(by_position, 1, 0))
    by_table = F.flatten(F.transform("places", lambda d, t: let(mine(t), lambda own: let(shown(d), lambda cols: fit(own, cols)))))
    usable = catalog.filter(F.size("column_names") == F.size("column_names_original"))
    placed = usable.withColumn("places", display_positions(F.col("table_names_original"), F.col("table_names")))
    return placed.select("db_id", F.explode(F.when(aligned, by_position).otherwise(by_table)).alias("c")).select("db_id", "c.*")


def resolve_primary_keys(columns: DataFrame) -> DataFrame:
    """Positions of the key columns of every table that has a key."""
    return columns.filter("is_pk").groupBy("db_id", "table_name").agg(F.sort_array(F.collect_list("col_idx")).alias("primary_keys"))


def resolve_foreign_keys(catalog: DataFrame) -> DataFrame:
    """Named foreign keys; positions outside the column list or without a table drop out.

    Names are quoted, except the referenced table.
    """
    columns = explode_catalog(catalog)
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    fks = catalog.select("db_id", F.posexplode("foreign_keys").alias("fk_no", "fk")).select(
        "db_id", F.col("fk_no").cast("long").alias("fk_no"), F.col("fk.from_idx").cast("long").alias("from_idx"), F.col("fk.to_idx").cast("long").alias("to_idx")
    )
    source = columns.select("db_id", F.col("global_idx").alias("from_idx"), quoted("table_name").alias("table"), quoted("col_name").alias("column"))
    target = columns.select("db_id", F.col("global_idx").alias("to_idx"), F.col("table_name").alias("referenced_table"), quoted("col_name").alias("referenced_column"))
    return fks.join(source, ["db_id", "from_idx"]).join(target, ["db_id", "to_idx"]).select("db_id", "fk_no", "table", "column", "referenced_table", "referenced_column")


def attach_descriptions(columns: DataFrame, descriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attach the first description whose trimmed name is the column's; also return the unmatched columns.

    ``descriptions(table_name, line_no, original_column_name, column_description, value_description)``.
    """
    name = F.regexp_replace("original_column_name", r"^\s+|\s+$", "")
    first = descriptions.groupBy("table_name", name.alias("col_name")).agg(F.min_by(F.struct("column_description", "value_description"), "line_no").alias("_d"))
    joined = columns.join(first, ["table_name", "col_name"], "left")
    described = joined.filter("_d is not null").select(*columns.columns, "_d.column_description", "_d.value_description")
    return described, joined.filter("_d is null").select(*columns.columns)
