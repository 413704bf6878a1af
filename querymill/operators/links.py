"""Links: which tables and columns a question needs.

Links and catalogs are long: ``link(dp_id, db_id, table_name, col_name)``, ``columns(db_id,
table_idx, table_name, col_idx, col_name, is_pk, ...)`` and ``fks(db_id, fk_no, table_name,
col_name, ref_table, ref_column)``.

Work on them is one pattern: gather each datapoint's link and each database's schema into one
row, join the two on ``db_id``, and compute inside the row. Both rows are bounded by the width
of a schema, however many datapoints ask about a database. The join is left to the planner: it
broadcasts the schemas while they are small and splits a hot database's datapoints otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.answers import link_malformed, parse_link_json
from querymill.functions.examples import let
from querymill.session import cut_lineage

LINK = ["dp_id", "db_id", "table_name", "col_name"]
SEPARATOR = "\u001f"


def column_key(table: Column | str, col: Column | str) -> Column:
    """One text for a column, ignoring case."""
    return F.concat_ws(SEPARATOR, F.lower(table), F.lower(col))


def fk_code() -> Column:
    return F.concat(F.lit('    FOREIGN KEY ("'), F.col("col_name"), F.lit('") REFERENCES '), F.col("ref_table"), F.lit('("'), F.col("ref_column"), F.lit('")'))


def rows_of(df: DataFrame, keep: list[str], items: Column, name: str = "c") -> DataFrame:
    """``keep`` and a row for each of ``items``, without null ones.

    A plain explode lets the planner infer that the array is not empty; it would make the array once more to test that, in the join below.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def never_broadcast(catalog: DataFrame) -> DataFrame:
    """A side of a join that grows with the databases is sorted and merged.

    A staged catalog repeats few names, so its files are many times smaller than its rows: by their size the planner would send millions of columns through the driver.
    """
    return catalog.hint("merge")


def nest_catalog(columns: DataFrame, fks: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per database: ``tables`` in catalog order.

    A table is ``struct<table_idx, table_name, t, table_comment, cols, fks>`` with ``t`` its
    lower-case name and ``pk`` the text of its primary key, if it has one; a column ``struct<col_idx, col_name, k, is_pk, is_key, extra...>``
    with ``k`` its key and ``is_key`` for members of primary or foreign keys; a foreign key ``struct<fk_no,
    col_name, r, code>`` with ``r`` the lower-case name of the referenced table.
    """
    comment = F.min("table_comment") if "table_comment" in columns.columns else F.lit("")
    col = F.struct("col_idx", "col_name", column_key("table_name", "col_name").alias("k"), "is_pk", *extra)
    per_table = columns.groupBy("db_id", "table_idx", "table_name").agg(F.sort_array(F.collect_list(col)).alias("cols"), comment.alias("table_comment"))
    ref = F.struct("fk_no", "col_name", F.lower("ref_table").alias("r"), fk_code().alias("code"))
    per_fk = fks.groupBy("db_id", "table_name").agg(F.sort_array(F.collect_list(ref)).alias("fks"))
    joined = per_table.join(never_broadcast(per_fk), ["db_id", "table_name"], "left").withColumn("fks", F.coalesce("fks", F.array().cast(per_fk.schema["fks"].dataType)))
    in_fk = F.transform("fks", lambda f: f["col_name"])
    flagged = joined.withColumn("_in", in_fk).withColumn("cols", F.transform("cols", lambda c: c.withField("is_key", c["is_pk"] | F.array_contains(F.col("_in"), c["col_name"]))))
    members = F.array_join(F.transform(F.filter("cols", lambda c: c["is_pk"]), lambda c: F.concat(F.lit('"'), c["col_name"], F.lit('"'))), ", ")
    flagged = flagged.withColumn("pk", members).withColumn("pk", F.when(F.col("pk") != "", F.concat(F.lit("    PRIMARY KEY ("), F.col("pk"), F.lit(")"))))
    table = F.struct("table_idx", "table_name", F.lower("table_name").alias("t"), "table_comment", "pk", "cols", "fks")
    return flagged.groupBy("db_id").agg(F.sort_array(F.collect_list(table)).alias("tables"))


def nest_links(links: DataFrame) -> DataFrame:
    """One row per datapoint: ``link`` as ``struct<table_name, col_name>``, ``linked`` column keys and ``chosen`` lower-case tables.

    Only the link is gathered; the keys and tables are made from it in its row.
    """
    nested = links.groupBy("dp_id", "db_id").agg(F.sort_array(F.collect_set(F.struct("table_name", "col_name"))).alias("link"))
    linked = F.array_distinct(F.transform("link", lambda c: column_key(c["table_name"], c["col_name"])))
    chosen = F.array_compact(F.array_distinct(F.transform("link", lambda c: F.lower(c["table_name"]))))
    return nested.withColumns({"linked": linked, "chosen": chosen})


def linked_dps(link: DataFrame, dps: DataFrame | None) -> DataFrame:
    """Nested links; with ``dps`` also the datapoints that have none, whose ``linked`` and ``chosen`` are null: all of the schema."""
    nested = nest_links(link)
    if dps is None:
        return nested
    empty = F.array().cast(nested.schema["link"].dataType)
    return dps.select("dp_id", "db_id").distinct().join(nested, ["dp_id", "db_id"], "left").withColumn("link", F.coalesce("link", empty))


def with_form(dps: DataFrame) -> DataFrame:
    """Nested links with ``form``, a fingerprint of the link as it is spelled; all of the schema is a form of its own."""
    spelled = F.transform("link", lambda c: F.concat_ws(SEPARATOR, c["table_name"], c["col_name"]))
    return dps.withColumn("form", F.when(F.col("linked").isNull(), "").otherwise(F.md5(F.array_join(spelled, "\n"))))


def distinct_forms(dps: DataFrame) -> DataFrame:
    """One row per database and form: what depends on a link alone is made here and joined back by ``db_id, form``."""
    return dps.select("db_id", "form", "link", "linked", "chosen").dropDuplicates(["db_id", "form"])


def is_chosen(t: Column) -> Column:
    """Without a link everything is chosen."""
    return F.coalesce(F.array_contains(F.col("chosen"), t), F.lit(True))


def is_linked(k: Column) -> Column:
    return F.coalesce(F.array_contains(F.col("linked"), k), F.lit(True))


def filter_chosen(dps: DataFrame, columns: DataFrame, link: DataFrame) -> DataFrame:
    """Catalog columns a datapoint has chosen, ignoring case; without a link everything is chosen.

    Linked columns meet the catalog's as rows; only datapoints without a link are joined with a whole schema.
    """
    chosen = link.select("dp_id", F.col("db_id").alias("_of"), column_key("table_name", "col_name").alias("k")).repartition("dp_id").distinct()
    # read for the linked ones and for the others: links are read once
    wanted = cut_lineage(dps.select("dp_id", "db_id").join(chosen, "dp_id", "left").select("dp_id", "db_id", "k"))
    known = columns.select("db_id", column_key("table_name", "col_name").alias("k"), "table_name", "col_name")
    linked = wanted.join(never_broadcast(known), ["db_id", "k"]).select(LINK)
    schemas = columns.groupBy("db_id").agg(F.collect_list(F.struct("table_name", "col_name")).alias("cols"))
    whole = wanted.filter(F.col("k").isNull()).join(never_broadcast(schemas), "db_id")
    return linked.unionAll(rows_of(whole, ["dp_id", "db_id"], F.col("cols")).select("dp_id", "db_id", "c.table_name", "c.col_name"))


def closed_tables(dps: DataFrame) -> DataFrame:
    """Reduce ``tables`` to the chosen ones, each with the columns and foreign keys to show.

    ``dps`` is a nested link joined with a nested catalog. A foreign key is kept when its
    referenced table is chosen; a column is shown when it is linked, part of the primary key or
    part of a kept foreign key.
    """
    kept = dps.withColumn(
        "tables", F.transform(F.filter("tables", lambda t: is_chosen(t["t"])), lambda t: t.withField("fks", F.filter(t["fks"], lambda f: is_chosen(f["r"]))))
    )

    def shown(t: Column) -> Column:
        in_fk = lambda c: F.exists(t["fks"], lambda f: f["col_name"] == c["col_name"])
        # a table's columns are compared with the linked keys of its own
        mine = let(F.concat(t["t"], F.lit(SEPARATOR)), lambda start: F.filter("linked", lambda k: k.startswith(start)))
        return let(mine, lambda ks: F.filter(t["cols"], lambda c: c["is_pk"] | F.coalesce(F.array_contains(ks, c["k"]), F.lit(True)) | (c["is_key"] & in_fk(c))))

    return kept.withColumn("tables", F.transform("tables", lambda t: t.withField("cols", shown(t))))


def close_link(link: DataFrame, columns: DataFrame, fks: DataFrame, dps: DataFrame | None = None) -> DataFrame:
    """Add the key columns of chosen tables and the foreign keys between chosen tables.

    Known names take the catalog's spelling; unknown ones stay as they are. With ``dps(dp_id, db_id)``,
    datapoints without a link get the whole schema.

    Linked columns meet the catalog's as rows, which takes no comparison with the rest of the schema; of the schema,
    a datapoint's row needs its tables' keys only.
    """
    pair = lambda t, c: F.struct(t.alias("table_name"), c.alias("col_name"))
    pairs = lambda t, cs: F.transform(cs, lambda c: pair(t["table_name"], c["col_name"]))
    known = columns.select("db_id", column_key("table_name", "col_name").alias("k"), F.struct("table_name", "col_name").alias("known"))
    met = link.select(*LINK, column_key("table_name", "col_name").alias("k")).join(never_broadcast(known), ["db_id", "k"], "left")
    item = F.struct(F.lower("table_name").alias("t"), F.col("known").isNotNull().alias("is_known"), F.coalesce("known", F.struct("table_name", "col_name")).alias("c"))
    nested = met.groupBy("dp_id", "db_id").agg(F.collect_set(item).alias("link"))
    if dps is not None:
        nested = dps.select("dp_id", "db_id").distinct().join(nested, ["dp_id", "db_id"], "left")
    nested = nested.withColumn("chosen", F.array_compact(F.array_distinct(F.transform("link", lambda x: x["t"]))))

    def keys(t: Column) -> Column:
        others = F.filter(t["cols"], lambda c: c["is_key"] & ~c["is_pk"])
        refs = lambda c: F.transform(F.filter(t["fks"], lambda f: f["col_name"] == c["col_name"]), lambda f: f["r"])
        by_ref = F.transform(others, lambda c: F.struct(refs(c).alias("refs"), pair(t["table_name"], c["col_name"]).alias("c")))
        return F.struct(t["t"].alias("t"), t["table_name"].alias("table_name"), pairs(t, F.filter(t["cols"], lambda c: c["is_pk"])).alias("pk"), by_ref.alias("fks"))

    whole = F.array_distinct(F.flatten(F.transform("tables", lambda t: pairs(t, t["cols"]))))
    schemas = nest_catalog(columns, fks).select("db_id", F.transform("tables", keys).alias("tables"), whole.alias("whole"))
    full = nested.join(schemas, "db_id", "left")
    full = full.withColumn("tables", F.coalesce("tables", F.array().cast(schemas.schema["tables"].dataType)))
    # an unknown column of a known table goes to the table's own spelling
    own = lambda x: F.coalesce(F.get(F.filter("tables", lambda t: t["t"] == x["t"]), F.lit(0))["table_name"], x["c"]["table_name"])
    spelled = F.transform("link", lambda x: F.when(x["is_known"], x["c"]).otherwise(pair(own(x), x["c"]["col_name"])))
    kept = lambda t: F.transform(F.filter(t["fks"], lambda f: F.arrays_overlap(f["refs"], "chosen")), lambda f: f["c"])
    added = F.flatten(F.transform(F.filter("tables", lambda t: is_chosen(t["t"])), lambda t: F.concat(t["pk"], kept(t))))
    rows = F.when(F.col("link").isNull(), F.col("whole")).otherwise(F.array_distinct(F.concat(spelled, added)))
    return rows_of(full, ["dp_id", "db_id"], rows).select("dp_id", "db_id", "c.table_name", "c.col_name")


def match_table_names(predicted: DataFrame, columns: DataFrame) -> DataFrame:
    """Predicted table names in the catalog's spelling; names without a match stay."""
    known = columns.select("db_id", F.lower("table_name").alias("_t"), F.col("table_name").alias("_known")).distinct()
    joined = predicted.withColumn("_t", F.lower("table_name")).join(known, ["db_id", "_t"], "left")
    return joined.select("dp_id", "db_id", F.coalesce("_known", "table_name").alias("table_name"), "col_name").distinct()


def columns_to_judge(link: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """Non-key columns of linked tables that are not linked yet."""
    have = link.groupBy("dp_id", "db_id", "table_name").agg(F.collect_set("col_name").alias("have"))
    return rows_of(have.join(free_columns(columns, fks), ["db_id", "table_name"]), ["dp_id", "db_id", "table_name"], F.array_except("free", "have"), "col_name")


def free_columns(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """Per table the sorted names of its columns outside primary and foreign keys."""
    in_fk = fks.groupBy("db_id", "table_name").agg(F.collect_set("col_name").alias("_in"))
    rest = columns.filter(~F.col("is_pk")).groupBy("db_id", "table_name").agg(F.sort_array(F.collect_set("col_name")).alias("free"))
    none = F.array().cast("array<string>")
    return rest.join(in_fk, ["db_id", "table_name"], "left").select("db_id", "table_name", F.array_except("free", F.coalesce("_in", none)).alias("free"))


def merge_judgements(link: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Add the columns judged useful, each once. ``verdicts(dp_id, db_id, table_name, col_name, useful)``."""
    return link.select(LINK).unionByName(verdicts.filter("useful").select(LINK)).distinct()


def predicted_links(predictions: DataFrame, text: str = "text") -> DataFrame:
    """Long link from answers ``(dp_id, db_id, text)``."""
    tables = predictions.select("dp_id", "db_id", F.explode(parse_link_json(F.col(text))).alias("table_name", "cols"))
    return tables.select("dp_id", "db_id", "table_name", F.explode(F.array_distinct("cols")).alias("col_name"))


def guard_malformed(dps: DataFrame, known: DataFrame, text: str, schema: Column) -> DataFrame:
    """Empty schema text for datapoints with a malformed link or an unknown database. ``known(db_id)``."""
    has = known.select("db_id").distinct().withColumn("_known", F.lit(True))
    usable = F.coalesce("_known", F.lit(False)) & ~link_malformed(F.col(text))
    return dps.join(has, "db_id", "left").select("dp_id", "db_id", F.when(usable, schema).otherwise("").alias("schema_text"))


def _json_string(name: Column) -> Column:
    """Name as a JSON string."""
    escaped = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def in_catalog_order(tables: Column, pairs: Column) -> Column:
    """``pairs`` (``struct<table_name, col_name>``) in the order of the nested ``tables``, unknown ones last by name."""
    pair = lambda t, c: F.struct(t["table_name"].alias("table_name"), c["col_name"].alias("col_name"))
    names = lambda t: F.transform(F.filter(pairs, lambda p: p["table_name"] == t["table_name"]), lambda p: p["col_name"])
    # a table's columns are compared with the names of its own pairs, and only hits become pairs
    known = F.flatten(F.transform(tables, lambda t: F.transform(let(names(t), lambda own: F.filter(t["cols"], lambda c: F.array_contains(own, c["col_name"]))), lambda c: pair(t, c))))
    return F.array_union(known, F.sort_array(pairs))


def link_text(pairs: Column) -> Column:
    """Ordered ``pairs`` as fenced JSON text: tables in order of appearance, each with its columns in order."""

    def entry(name: Column) -> Column:
        cols = F.transform(F.filter(pairs, lambda p: p["table_name"] == name), lambda p: F.concat(F.lit("    "), _json_string(p["col_name"])))
        return F.concat(F.lit("  "), _json_string(name), F.lit(": [\n"), F.array_join(cols, ",\n"), F.lit("\n  ]"))

    names = F.array_distinct(F.transform(pairs, lambda p: p["table_name"]))
    return F.concat(F.lit("```json\n{\n"), F.array_join(F.transform(names, entry), ",\n"), F.lit("\n}\n```"))


def linearize_link(link: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """Link of every datapoint as fenced JSON text.

    Linked columns get their places in the catalog as rows, so no row holds a schema; unknown ones come last, by name.
    """
    places = columns.groupBy("db_id", "table_name", "col_name").agg(F.min(F.struct("table_idx", "col_idx")).alias("at"))
    placed = link.select(LINK).join(places, ["db_id", "table_name", "col_name"], "left")
    item = F.struct(F.col("at").isNull().alias("unknown"), F.col("at.table_idx").alias("table_idx"), "table_name", F.col("at.col_idx").alias("col_idx"), "col_name")
    ordered = placed.groupBy("dp_id", "db_id").agg(F.sort_array(F.collect_set(item)).alias("link"))
    return ordered.select("dp_id", "db_id", link_text(F.col("link")).alias("linearized"))
