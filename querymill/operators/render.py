"""Schema text: one CREATE TABLE-like statement per table.

A database's schema is gathered once (see ``nest_catalog``), with the line of every column made there. Datapoints with the same link
share a form: its text is put together once and joined back. What differs per question, the examples of a column, has a slot in
the form's parts and is filled in by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.examples import collapse_identifier_examples, format_examples, let, local_examples, merge_examples
from querymill.operators.links import closed_tables, distinct_forms, linked_dps, nest_catalog, nest_links, with_form
from querymill.session import cut_lineage

DETAILS = ("line", "last")
PARTS = ("code", "note", "place")
NO_TEXTS = "array<string>"
NO_LINK = {"link": "array<struct<table_name:string,col_name:string>>", "linked": NO_TEXTS, "chosen": NO_TEXTS}


def with_details(columns: DataFrame) -> DataFrame:
    """Add what is printed for a column whoever asks: its ``code``, its ``note`` without examples, and its ``line`` with and (``last``) without a comma."""
    code = F.concat(F.lit('    "'), F.col("col_name"), F.lit('" '), F.upper("type_class"))
    note = F.when(F.col("comment") != "", F.concat(F.lit(" -- "), F.col("comment"))).otherwise("")
    known = columns.withColumn("code", code).withColumn("note", note)
    return known.withColumn("line", F.concat("code", F.lit(","), "note", F.lit("\n"))).withColumn("last", F.concat("code", "note", F.lit("\n")))


def place(table_idx: Column | str, col_idx: Column | str) -> Column:
    """One number for a column within its database, in catalog order."""
    return F.shiftleft(F.col(table_idx).cast("long"), 32) + F.col(col_idx)


def example_note(comment: Column, examples: Column) -> Column:
    """Column comment including the example note; empty when there is nothing to say."""
    note = let(examples, lambda e: F.when(F.coalesce(e, F.lit("")) != "", F.concat(F.lit("Value Examples: ["), e, F.lit("]"))))
    return let(F.concat_ws(" | ", F.when(comment != "", comment), note), lambda said: F.when(said != "", F.concat(F.lit(" -- "), said)).otherwise(""))


def _head(t: Column) -> Column:
    return F.concat(F.lit('CREATE TABLE "'), t["table_name"], F.lit('" ('), t["table_comment"], F.lit("\n"))


def _keys(t: Column) -> Column:
    """Key lines of a table, empty without any."""
    return F.array_join(F.concat(F.array(t["pk"]), F.transform(t["fks"], lambda f: f["code"])), ",\n")


def _end(keys: Column) -> Column:
    return F.when(keys != "", F.concat(keys, F.lit("\n);\n"))).otherwise(");\n")


def _comma_less(t: Column, keys: Column) -> Column:
    """Place of the column that has no comma: the last one, unless a primary or foreign key follows."""
    return F.when(keys == "", F.size(t["cols"]) - 1).otherwise(-1)


def statement(t: Column) -> Column:
    """Statement of a nested table. Every column ends in a comma, before its note, unless it is the last one and no key follows."""
    body = lambda n: F.array_join(F.transform(t["cols"], lambda c, i: F.when(i == n, c["last"]).otherwise(c["line"])), "")
    return let(_keys(t), lambda k: F.concat(_head(t), let(_comma_less(t, k), body), _end(k)))


def _header(overview: Column | None = None) -> Column:
    about = F.lit("") if overview is None else F.coalesce(F.concat(F.lit("-- Database overview: "), overview, F.lit("\n")), F.lit(""))
    return F.concat(F.lit("-- Database name: "), F.col("db_id"), F.lit("\n"), about, F.lit("-- Database schema:\n"))


def schema_text(tables: Column, overview: Column | None = None) -> Column:
    """Header and the statements of all nested ``tables``."""
    return F.concat(_header(overview), F.array_join(F.transform(tables, statement), ""))


def schema_parts(tables: Column) -> Column:
    """The text of nested ``tables`` in parts ``struct<text, place>``: a column's note has the column's place, all else null."""
    part = lambda text, where: F.struct(text.alias("text"), where.cast("long").alias("place"))
    fixed = lambda text: part(text, F.lit(None))

    def of(t: Column) -> Column:
        column = lambda n: lambda c, i: F.array(
            fixed(F.concat(F.when(i > 0, "\n").otherwise(""), c["code"], F.when(i == n, "").otherwise(","))), part(c["note"], c["place"])
        )
        close = lambda k: F.concat(F.when(F.size(t["cols"]) > 0, "\n").otherwise(""), _end(k))
        return let(_keys(t), lambda k: F.concat(F.array(fixed(_head(t))), let(_comma_less(t, k), lambda n: F.flatten(F.transform(t["cols"], column(n)))), F.array(fixed(close(k)))))

    return F.concat(F.array(fixed(_header())), F.flatten(F.transform(tables, of)))


def filled(texts: Column, places: Column, notes: Column) -> Column:
    """Parts joined, with ``notes`` (``struct<place, note>`` or null) in the parts of their places; notes of places that are not there are left out.

    The parts between two notes are joined as a whole.
    """
    known = F.transform(F.coalesce(notes, F.expr("cast(array() AS array<struct<place: bigint, note: string>>)")), lambda x: F.struct(F.array_position(places, x["place"]).cast("int").alias("at"), x["note"].alias("note")))
    kept = F.array_sort(F.filter(known, lambda x: x["at"] > 0))
    after = lambda ks, j: F.coalesce(F.get(ks, j - 1)["at"], F.lit(0))

    def piece(ks: Column, j: Column) -> Column:
        stop = F.coalesce(F.get(ks, j)["at"] - 1, F.size(texts))
        return F.concat(F.array_join(F.slice(texts, after(ks, j) + 1, stop - after(ks, j)), ""), F.coalesce(F.get(ks, j)["note"], F.lit("")))

    return let(kept, lambda ks: F.array_join(F.transform(F.sequence(F.lit(0), F.size(ks)), lambda j: piece(ks, j)), ""))


def render_table(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """One statement per table of every database, with everything shown.

    ``columns`` carries ``type_class``, ``comment`` and ``table_comment``.
    """
    tables = nest_catalog(with_details(columns), fks, DETAILS).select("db_id", F.explode("tables").alias("t"))
    return tables.select("db_id", F.col("t.table_name").alias("table_name"), statement(F.col("t")).alias("statement"))


def render_schema(link: DataFrame, columns: DataFrame, fks: DataFrame, overview: DataFrame | None = None, dps: DataFrame | None = None) -> DataFrame:
    """Schema text of every datapoint's closed link; unknown names are not shown. Equal links are rendered once.

    With ``dps(dp_id, db_id)``, datapoints without a link show the whole schema.
    """
    schemas = nest_catalog(with_details(columns), fks, DETAILS)
    about = None
    if overview is not None:
        schemas = schemas.join(overview.select("db_id", "overview"), "db_id", "left")
        about = F.col("overview")
    dps = with_form(linked_dps(link, dps))
    forms = closed_tables(distinct_forms(dps).join(schemas, "db_id")).select("db_id", "form", schema_text(F.col("tables"), about).alias("schema_text"))
    return dps.select("dp_id", "db_id", "form").join(forms, ["db_id", "form"]).select("dp_id", "db_id", "schema_text")


def nest_retrieved(retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Retrieved values ``(keys, rn, value)`` as one array per ``keys``, nearest first."""
    found = F.sort_array(F.collect_list(F.struct("rn", "value")))
    return retrieved.groupBy(*keys).agg(F.transform(found, lambda r: r["value"]).alias("found"))


def schema_input(dataset: DataFrame, columns: DataFrame, fks: DataFrame, static: DataFrame, retrieved: DataFrame, link: DataFrame | None = None) -> DataFrame:
    """Schema text per question, with retrieved and static examples: of the closed ``link``, or whole without one.

    ``dataset(dp_id, db_id, ...)``, ``static(db_id, table_name, col_name, examples array)``,
    ``retrieved(dp_id, table_name, col_name, rn, value)``. Every distinct link of a database is rendered once, with the static
    examples; a question's own examples go into the slots of their columns. A database without catalog raises when its row is read.
    """
    none = F.array().cast(NO_TEXTS)
    noted = lambda found: example_note(F.col("comment"), format_examples(collapse_identifier_examples(merge_examples(found, F.col("examples"))), F.col("type_class")))
    known = columns.join(static, ["db_id", "table_name", "col_name"], "left").withColumn("examples", F.coalesce("examples", none)).withColumn("place", place("table_idx", "col_idx"))
    # read for the schemas and for the questions' own examples; what ranking the examples has shuffled is gone before schemas are gathered
    known = cut_lineage(known)
    schemas = nest_catalog(with_details(known).withColumn("note", noted(none)), fks, PARTS)
    wanted = dataset.select("db_id").distinct().select("db_id", F.lit("").alias("form"), *[F.lit(None).cast(kind).alias(name) for name, kind in NO_LINK.items()])
    asked = dataset.withColumn("form", F.lit(""))
    if link is not None:
        dps = with_form(nest_links(link))
        wanted = wanted.unionByName(distinct_forms(dps))
        asked = dataset.join(dps.select("dp_id", "db_id", "form"), ["dp_id", "db_id"], "left").withColumn("form", F.coalesce("form", F.lit("")))
    parts = closed_tables(wanted.join(schemas, "db_id")).select("db_id", "form", schema_parts(F.col("tables")).alias("p"))
    forms = parts.select("db_id", "form", F.transform("p", lambda x: x["text"]).alias("texts"), F.transform("p", lambda x: x["place"]).alias("places"))
    mine = nest_retrieved(retrieved, ["dp_id", "table_name", "col_name"]).join(dataset.select("dp_id", "db_id").distinct(), "dp_id").join(known.select("db_id", "table_name", "col_name", "place", "comment", "type_class", "examples"), ["db_id", "table_name", "col_name"])
    notes = mine.groupBy("dp_id", "db_id").agg(F.collect_list(F.struct("place", noted(F.col("found")).alias("note"))).alias("notes"))
    missing = F.raise_error(F.concat(F.lit("no catalog for database "), F.col("db_id"))).cast("string")
    # forms come last: a whole schema's parts are never shuffled once per question
    joined = asked.join(notes, ["dp_id", "db_id"], "left").join(forms, ["db_id", "form"], "left")
    text = F.when(F.col("texts").isNull(), missing).otherwise(filled(F.col("texts"), F.col("places"), F.col("notes")))
    return joined.select(*dataset.columns, text.alias("schema_text"))


def local_context(targets: DataFrame, columns: DataFrame, fks: DataFrame, static: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Table statement without examples and the examples of one column.

    ``targets(dp_id, db_id, table_name, col_name)``. Statements are made once per table.
    """
    none = F.array().cast(NO_TEXTS)
    texts = render_table(columns, fks).withColumnRenamed("statement", "table_text")
    details = columns.select("db_id", "table_name", "col_name", "type_class").join(static, ["db_id", "table_name", "col_name"], "left")
    found = nest_retrieved(retrieved, ["dp_id", "table_name", "col_name"])
    full = targets.join(details, ["db_id", "table_name", "col_name"]).join(texts, ["db_id", "table_name"]).join(found, ["dp_id", "table_name", "col_name"], "left")
    block = local_examples(F.col("col_name"), F.coalesce("found", none), F.coalesce("examples", none), F.col("type_class"))
    return full.select("dp_id", "db_id", "table_name", "col_name", "table_text", block.alias("example_text"))
