"""Checks of sources, catalog, profiles, value index and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.functions import examples, naming, prompts
from querymill.operators import catalog, links, profile, render, retrieval
from querymill.registry.base import INPUTS, Source, check
from querymill.session import scratch_path
from querymill.sources import corpus


# ------------------------------------------------------------------ sources
@check("S1_corpus_round_trip", "SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n, md5(text) AS digest FROM documents")
def _(s):
    # half of the corpus as JSON lines, half as JSON lists of a thousand, one list a file
    path, lists = scratch_path(s.spark, "corpus"), scratch_path(s.spark, "corpus-lists")
    docs = s["documents"].select("doc_id", "lang", "source", "text")
    corpus.write_corpus(docs.filter("doc_id % 2 = 0"), path)
    rows = docs.filter("doc_id % 2 = 1").groupBy(F.floor(F.col("doc_id") / 2000).alias("f")).agg(F.concat(F.lit("["), F.concat_ws(",\n ", F.collect_list(F.to_json(F.struct("doc_id", "lang", "source", "text")))), F.lit("]")).alias("value"))
    rows.repartition("f").sortWithinPartitions("f").select("f", "value").write.partitionBy("f").text(lists)
    schema = "doc_id long, lang string, source string, text string"
    back = corpus.read_corpus(s.spark, path, schema, lines=True).unionByName(corpus.read_corpus(s.spark, lists, schema))
    return back.select("doc_id", "lang", "source", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@check(
    "S2_corpus_union",
    """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS STRING) AS origin FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier""",
)
def _(s):
    a = s["customer"].select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = s["supplier"].select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("origin"))
    return corpus.corpus_union(a, b)


INPUTS["i_entries"] = "SELECT doc_id AS position, source AS db_id, lang, md5(text) AS payload FROM documents"


@check(
    "S3_load_catalog",
    "SELECT db_id, position, lang, payload FROM (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY position DESC) AS rn FROM i_entries) WHERE rn = 1",
)
def _(s):
    return catalog.load_catalog(s["i_entries"], "position")


@check(
    "S4_attach_descriptions",
    """
f AS (SELECT table_name, trim(original_column_name) AS col_name, column_description, value_description, row_number() OVER (PARTITION BY table_name, trim(original_column_name) ORDER BY line_no) AS rn FROM i_descriptions)
SELECT c.db_id, c.table_name, c.col_name, column_description, value_description, f.rn IS NOT NULL AS described
FROM i_columns c LEFT JOIN f ON c.table_name = f.table_name AND c.col_name = f.col_name AND rn = 1""",
)
def _(s):
    described, missing = catalog.attach_descriptions(s["i_columns"].select("db_id", "table_name", "col_name"), s["i_descriptions"])
    return described.withColumn("described", F.lit(True)).unionByName(missing.withColumn("described", F.lit(False)), allowMissingColumns=True)


@check("S5_list_databases", "SELECT DISTINCT d.doc_id AS db_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'indexed' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(s):
    return catalog.list_databases(s["documents"].select(F.col("doc_id").alias("db_id")), s["labels"].select(F.col("doc_id").alias("db_id")))


# ------------------------------------------------------------------ catalog
def raw_catalog(s: Source) -> DataFrame:
    """Nested catalog of every database, as the catalog files have it."""
    g = s["i_globals"]
    names = lambda order, name: F.transform(F.sort_array(F.collect_set(F.struct(order, name))), lambda x: x[name])
    star = F.array(F.struct(F.lit(-1).alias("table_idx"), F.lit("*").alias("name")))

    def listed(*order: str, idx: str, name: str):
        items = F.sort_array(F.collect_list(F.struct(*order, F.struct(F.col(idx).cast("int").alias("table_idx"), F.col(name).alias("name")).alias("c"))))
        return F.concat(star, F.transform(items, lambda x: x["c"]))

    cols = g.groupBy("db_id").agg(
        names("table_idx", "table_name").alias("table_names_original"),
        names("display_idx", "table_display").alias("table_names"),
        listed("global_idx", idx="table_idx", name="col_name").alias("column_names_original"),
        listed("display_idx", "col_idx", idx="display_idx", name="display_name").alias("column_names"),
    )
    ref = g.select("db_id", F.col("table_name").alias("ref_table"), F.col("col_name").alias("ref_column"), F.col("global_idx").cast("int").alias("to_idx"))
    fks = s["i_fks"].join(ref, ["db_id", "ref_table", "ref_column"])
    pairs = F.sort_array(F.collect_list(F.struct(F.col("global_idx").cast("int").alias("from_idx"), "to_idx")))
    stray = F.array(F.struct(F.lit(9999).alias("from_idx"), F.lit(1).alias("to_idx")), F.struct(F.lit(0).alias("from_idx"), F.lit(1).alias("to_idx")))
    return cols.join(fks.groupBy("db_id").agg(F.concat(pairs, stray).alias("foreign_keys")), "db_id", "left").withColumn("foreign_keys", F.coalesce("foreign_keys", stray))


@check("P1_explode_catalog", "SELECT db_id, table_idx, table_name, global_idx, col_idx, col_name FROM i_globals")
def _(s):
    return catalog.explode_catalog(raw_catalog(s))


INPUTS["i_types"] = """
SELECT p_partkey, CASE p_partkey % 20 WHEN 0 THEN 'VARCHAR' WHEN 1 THEN 'Int' WHEN 2 THEN 'double precision' WHEN 3 THEN 'DateTime' WHEN 4 THEN 'interval' WHEN 5 THEN 'CHARACTER' WHEN 6 THEN 'json'
  WHEN 7 THEN 'numeric' WHEN 8 THEN 'point' WHEN 9 THEN 'bool' WHEN 10 THEN 'clob' WHEN 11 THEN 'blob' WHEN 12 THEN 'NUMBER' WHEN 13 THEN 'float' WHEN 14 THEN 'year' WHEN 15 THEN 'bit'
  WHEN 16 THEN 'timestamp' WHEN 17 THEN 'String' WHEN 18 THEN 'Real' ELSE '' END || CASE WHEN p_partkey % 20 = 19 THEN '' ELSE '(' || CAST(p_size AS STRING) || ')' END AS declared_type
FROM part"""


@check(
    "P2_normalize_type",
    """
r AS (SELECT * FROM (VALUES (0, 'character', 'text'), (1, 'int', 'integer'), (2, 'real', 'real'), (3, 'double', 'real'), (4, 'float', 'real'), (5, 'numeric', 'numeric'), (6, 'decimal', 'numeric'), (7, 'num', 'numeric'),
  (8, 'year', 'integer'), (9, 'bit', 'integer'), (10, 'bool', 'boolean'), (12, 'date', 'time'), (13, 'time', 'time'), (14, 'char', 'text'), (18, 'text', 'text'), (19, 'clob', 'text'), (20, 'blob', 'blob'), (21, 'string', 'text'), (23, 'json', 'jsonb')) v(o, k, c))
SELECT p_partkey, declared_type, coalesce(arg_min(c, o), 'others') AS type_class FROM i_types LEFT JOIN r ON contains(lower(declared_type), k) GROUP BY 1, 2""",
)
def _(s):
    return s["i_types"].select("p_partkey", "declared_type", naming.normalize_type(F.col("declared_type")).alias("type_class"))


@check("P3_names_equivalent", "SELECT db_id, table_name, col_name, regexp_replace(lower(col_name), '[ _`]', '', 'g') = regexp_replace(lower(display_name), '[ _`]', '', 'g') AS same FROM i_columns")
def _(s):
    return s["i_columns"].select("db_id", "table_name", "col_name", naming.names_equivalent(F.col("col_name"), F.col("display_name")).alias("same"))


TABLE_MAP = """
k AS (SELECT *, replace(replace(lower(table_name), ' ', ''), '_', '') AS ok, replace(replace(lower(table_display), ' ', ''), '_', '') AS dk FROM i_tables),
u AS (SELECT db_id, dk, min(display_idx) AS m FROM k GROUP BY 1, 2 HAVING count(*) = 1),
tmap AS (SELECT k.db_id, k.table_idx, CASE WHEN u.m IS NOT NULL AND row_number() OVER (PARTITION BY k.db_id, k.ok ORDER BY k.table_idx) = 1 THEN u.m ELSE k.table_idx END AS display_idx
  FROM k LEFT JOIN u ON k.db_id = u.db_id AND k.ok = u.dk)
"""


@check("P4_match_display_tables", TABLE_MAP + "SELECT db_id, table_idx, CAST(display_idx AS BIGINT) AS display_idx FROM tmap")
def _(s):
    return catalog.match_display_tables(raw_catalog(s))


@check(
    "P5_match_display_columns",
    TABLE_MAP
    + """,
d AS (SELECT db_id, display_idx, display_name, row_number() OVER (PARTITION BY db_id ORDER BY display_idx, col_idx) AS pos, row_number() OVER (PARTITION BY db_id, display_idx ORDER BY col_idx) AS place, count(*) OVER (PARTITION BY db_id, display_idx) AS size FROM i_globals),
o AS (SELECT db_id, table_idx, global_idx AS pos, col_idx + 1 AS place, count(*) OVER (PARTITION BY db_id, table_idx) AS size FROM i_globals),
al AS (SELECT o.db_id, bool_and(o.table_idx = d.display_idx) AS aligned FROM o JOIN d ON o.db_id = d.db_id AND o.pos = d.pos GROUP BY 1)
SELECT o.db_id, CAST(o.pos AS BIGINT) AS global_idx, d.display_name FROM o JOIN al ON o.db_id = al.db_id JOIN d ON o.db_id = d.db_id AND o.pos = d.pos WHERE aligned
UNION ALL SELECT db_id, 0, '*' FROM al WHERE aligned
UNION ALL SELECT o.db_id, o.pos, d.display_name FROM o JOIN al ON o.db_id = al.db_id JOIN tmap m ON o.db_id = m.db_id AND o.table_idx = m.table_idx
  JOIN d ON d.db_id = o.db_id AND d.display_idx = m.display_idx AND d.place = o.place AND d.size = o.size WHERE NOT aligned""",
)
def _(s):
    return catalog.match_display_columns(raw_catalog(s))


INPUTS["i_nulls"] = "SELECT l_orderkey, nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus, nullif(l_discount, 0.05) AS l_discount, l_shipdate, nullif(l_quantity, 77) AS l_quantity FROM lineitem"


@check(
    "P6_null_profile",
    "SELECT 'lineitem' AS table_name, name AS col_name, hit AS contains_null FROM (SELECT "
    + ", ".join(f"bool_or({c} IS NULL) AS {c}" for c in ("l_orderkey", "l_returnflag", "l_linestatus", "l_discount", "l_shipdate", "l_quantity"))
    + " FROM i_nulls) UNPIVOT (hit FOR name IN (l_orderkey, l_returnflag, l_linestatus, l_discount, l_shipdate, l_quantity))",
)
def _(s):
    return profile.null_profile(s["i_nulls"], "lineitem")


@check("P7_resolve_primary_keys", "SELECT db_id, table_name, string_agg(col_idx, ',' ORDER BY col_idx) AS primary_keys FROM i_columns WHERE is_pk GROUP BY 1, 2")
def _(s):
    return catalog.resolve_primary_keys(s["i_columns"]).withColumn("primary_keys", F.array_join(F.col("primary_keys").cast("array<string>"), ","))


@check(
    "P8_resolve_foreign_keys",
    """SELECT db_id, '"' || table_name || '"' AS "table", '"' || col_name || '"' AS "column", ref_table AS referenced_table, '"' || ref_column || '"' AS referenced_column FROM i_fks""",
)
def _(s):
    return catalog.resolve_foreign_keys(raw_catalog(s)).drop("fk_no")


INPUTS["i_profiled"] = """
SELECT l_orderkey, l_linenumber % 3 AS digit, nullif(l_returnflag, 'A') AS flag, CASE WHEN l_linestatus = 'F' THEN '' ELSE l_linestatus END AS status, p_name, repeat(p_brand, 20) AS long_name, CAST(l_discount AS DECIMAL(10,2)) AS discount
FROM lineitem JOIN part ON l_partkey = p_partkey"""
PROFILED = ["l_orderkey", "digit", "flag", "status", "p_name", "long_name", "discount"]
UNPIVOTED = (
    "v AS (" + " UNION ".join(f"SELECT '{c}' AS col_name, CAST({c} AS STRING) AS value FROM i_profiled" for c in PROFILED) + "),\n"
    "w AS (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY value NULLS FIRST) AS rn FROM v)\n"
)


@check(
    "P9_value_examples",
    UNPIVOTED
    + """SELECT 'lineitem' AS table_name, col_name, rn AS ex_no, value FROM w
WHERE rn <= 5 AND value <> '' AND NOT (col_name IN ('l_orderkey', 'digit', 'discount') AND TRY_CAST(value AS DOUBLE) = 0)""",
)
def _(s):
    return profile.value_examples(s["i_profiled"], "lineitem", PROFILED)


@check(
    "P10_clean_description",
    r"""
t AS (SELECT doc_id, regexp_replace(chr(13) || ' ' || text || chr(10), '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g') AS x FROM documents),
u AS (SELECT doc_id, replace(replace(replace(replace(x, chr(13), ''), chr(10), ' '), 'commonsense evidence:', ''), 'Commonsense evidence:', '') AS x FROM t)
SELECT doc_id, regexp_replace(regexp_replace(x, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g'), ' {2,}', ' ', 'g') AS line FROM u""",
)
def _(s):
    text = F.concat(F.lit("\r "), F.col("text"), F.lit("\n"))
    return s["documents"].select("doc_id", naming.clean_description(text).alias("line"))


INPUTS["i_described"] = """
SELECT c.db_id, c.table_name, c.col_name, c.display_name, c.contains_null, d.column_description, d.value_description
FROM i_columns c JOIN (SELECT table_name, trim(original_column_name) AS col_name, column_description, value_description,
    row_number() OVER (PARTITION BY table_name, trim(original_column_name) ORDER BY line_no) AS rn FROM i_descriptions) AS d
  ON c.table_name = d.table_name AND c.col_name = d.col_name AND d.rn = 1"""


@check(
    "P11_column_comment",
    """
d AS (SELECT *, regexp_replace(trim(replace(replace(trim(column_description), chr(10), ' '), 'commonsense evidence:', '')), ' +', ' ', 'g') AS cd, trim(value_description) AS vd FROM i_described),
k AS (SELECT *, regexp_replace(lower(col_name), '[ _]', '', 'g') AS kn, regexp_replace(lower(display_name), '[ _]', '', 'g') AS kd, regexp_replace(lower(cd), '[ _]', '', 'g') AS kc, regexp_replace(lower(vd), '[ _]', '', 'g') AS kv FROM d),
p AS (SELECT *, concat_ws(' | ', CASE WHEN kn <> kd THEN 'Column Meaning: ' || display_name END, CASE WHEN cd <> '' AND kc <> kn AND kc <> kd THEN 'Column Description: ' || cd END,
  CASE WHEN vd <> '' AND kv <> kn AND kv <> kd AND kv <> coalesce(kc, '') THEN 'Value Description: ' || vd END) AS plain FROM k)
SELECT db_id, table_name, col_name, plain, plain || CASE WHEN plain = '' THEN '' ELSE ' | ' END || 'Contains NULL: ' || CASE WHEN contains_null THEN 'True' ELSE 'False' END AS comment FROM p""",
)
def _(s):
    args = [F.col(c) for c in ("col_name", "display_name", "column_description", "value_description")]
    return s["i_described"].select(
        "db_id", "table_name", "col_name", naming.column_comment(*args, None).alias("plain"), naming.column_comment(*args, F.col("contains_null")).alias("comment")
    )


@check("P12_table_comment", "SELECT db_id, table_name, CASE WHEN table_display LIKE 'the %' THEN ' -- Table Description: ' || table_display ELSE '' END AS comment FROM i_tables")
def _(s):
    return s["i_tables"].select("db_id", "table_name", naming.table_comment(F.col("table_name"), F.col("table_display")).alias("comment"))


# ------------------------------------------------------------------ value index
@check("V1_indexable_columns", "SELECT p_partkey, declared_type FROM i_types WHERE regexp_matches(upper(declared_type), 'TEXT|CHAR|DATE')")
def _(s):
    return s["i_types"].filter(naming.indexable(F.col("declared_type")))


@check("V2_distinct_values", UNPIVOTED + "SELECT 'lineitem' AS table_name, col_name, value FROM v WHERE trim(value) <> ''")
def _(s):
    return profile.distinct_values(s["i_profiled"], "lineitem", PROFILED)


INPUTS["i_values"] = "SELECT 'sales' AS db_id, 'customer' AS table_name, lower(c_mktsegment) AS col_name, CAST(c_custkey AS STRING) AS value FROM customer"


@check(
    "V3_build_value_index",
    "v AS (SELECT CAST(vec_id % 400 AS STRING) AS value, min(embedding) AS embedding FROM embeddings GROUP BY 1) SELECT db_id, table_name, col_name, value, CAST(coalesce(len(embedding), 0) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 6) AS first_dim FROM i_values LEFT JOIN v USING (value)",
)
def _(s):
    # some values have several vectors, others none
    vectors = s["embeddings"].select((F.col("vec_id") % 400).cast("string").alias("value"), "embedding")
    path = scratch_path(s.spark, "value-index")
    retrieval.write_value_index(retrieval.build_value_index(s["i_values"], vectors), path)
    names = ["db_id", "table_name", "col_name", "value"]
    index = s.spark.read.parquet(path).select(*names, F.size("embedding").cast("long").alias("dims"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first_dim"))
    rest = retrieval.values_without_vector(s["i_values"], vectors)
    return index.unionByName(rest.select(*names, F.lit(0).cast("long").alias("dims"), F.lit(None).cast("double").alias("first_dim")))


@check(
    "V4_nearest_values",
    """
d AS (SELECT q.vec_id AS dp_id, 'label_' || v.label AS col_name, 'v' || v.vec_id AS value, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) ** 2, 9) AS distance FROM embeddings q JOIN embeddings v ON q.label % 2 = v.label % 2),
r AS (SELECT *, row_number() OVER (PARTITION BY dp_id, col_name ORDER BY distance, value) AS rn FROM d)
SELECT dp_id, 'embeddings' AS table_name, col_name, rn, value, round(distance, 5) AS distance FROM r WHERE rn <= 3""",
)
def _(s):
    e = s["embeddings"]
    db = F.concat(F.lit("vec_"), F.col("label") % 2).alias("db_id")
    queries = e.select(F.col("vec_id").alias("dp_id"), db, "embedding")
    index = e.select(
        db, F.lit("embeddings").alias("table_name"), F.concat(F.lit("label_"), "label").alias("col_name"), F.concat(F.lit("v"), "vec_id").alias("value"), "embedding"
    )
    return retrieval.nearest_values(queries, index).withColumn("distance", F.round("distance", 5))


INPUTS["i_example_lists"] = """
SELECT page_id, {ARRAY(}split_part(url, '?', 1), repeat(url, 3), CAST(page_id % 5 AS STRING)) AS found, {ARRAY(}CASE WHEN page_id % 7 = 3 THEN '[' || CAST(page_id AS STRING) || ', "x"]' ELSE CAST(page_id % 5 AS STRING) END, CAST(page_id AS STRING) || '.50', split_part(url, '/', 3), ' ' || url || ' ') AS static,
  CASE page_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'time' WHEN 2 THEN 'numeric' WHEN 3 THEN 'integer' WHEN 4 THEN 'jsonb' ELSE 'others' END AS type_class, page_id % 3 AS k FROM pages"""
MERGED = """
s AS (SELECT *, found AS short FROM i_example_lists),
m AS (SELECT *, list_concat(short, list_slice(list_filter(static, lambda v: NOT list_contains(short, v)), 1, 4 - len(short))) AS merged FROM s)
"""


@check("V5_merge_examples", MERGED + "SELECT page_id, array_to_string(merged, '|') AS merged FROM m")
def _(s):
    return s["i_example_lists"].select("page_id", F.array_join(examples.merge_examples(F.col("found"), F.col("static")), "|").alias("merged"))


INPUTS["i_first_examples"] = """
SELECT doc_id, {ARRAY(}CASE doc_id % 4 WHEN 0 THEN 'user.' || CAST(doc_id AS STRING) || '@mail.example.org' WHEN 1 THEN 'https://' || source WHEN 2 THEN text ELSE 'me@home' END, lang, source) AS examples FROM documents"""


@check(
    "V6_collapse_identifier_examples",
    r"""SELECT doc_id, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, '|')) AS digest FROM (SELECT doc_id, CASE WHEN regexp_matches(examples[1], '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$')
  OR starts_with(examples[1], 'http://') OR starts_with(examples[1], 'https://') THEN examples[1:1] ELSE examples END AS x FROM i_first_examples)""",
)
def _(s):
    kept = s["i_first_examples"].select("doc_id", examples.collapse_identifier_examples(F.col("examples")).alias("x"))
    return kept.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "|")).alias("digest"))


FORMATTED = r"""CASE WHEN type_class IN ('text', 'time') OR (type_class <> 'boolean' AND NOT coalesce(regexp_matches(x[1], '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'), true)) THEN array_to_string(list_transform(x, lambda v: '''' || trim(v) || ''''), ', ')
  WHEN type_class = 'numeric' THEN array_to_string(list_transform(x, lambda v: coalesce(CAST(TRY_CAST(v AS DOUBLE) AS STRING), v)), ', ') ELSE array_to_string(x, ', ') END"""


@check(
    "V7_local_examples",
    MERGED
    + f""",
l AS (SELECT page_id, type_class, list_concat(short, list_filter(static, lambda v: NOT list_contains(short, v))) AS x FROM m)
SELECT page_id, '[Column Value Examples]' || chr(10) || 'We want to know if the column named ''url'' is useful to answer the question, here are some example values of this column:' || chr(10) || {FORMATTED} AS block FROM l""",
)
def _(s):
    return s["i_example_lists"].select("page_id", examples.local_examples(F.lit("url"), F.col("found"), F.col("static"), F.col("type_class")).alias("block"))


@check("V8_format_examples", f"SELECT page_id, {FORMATTED} AS shown FROM (SELECT page_id, type_class, static AS x FROM i_example_lists)")
def _(s):
    return s["i_example_lists"].select("page_id", examples.format_examples(F.col("static"), F.col("type_class")).alias("shown"))


# ------------------------------------------------------------------ link closure and rendering
def static_examples(s: Source) -> DataFrame:
    values = F.transform(F.sort_array(F.collect_list(F.struct("ex_no", "value"))), lambda x: x["value"])
    return s["i_examples"].groupBy("db_id", "table_name", "col_name").agg(values.alias("examples"))


# the link of every question, in lower case for some and missing for others, with an unknown column
INPUTS["i_given"] = """
SELECT dp_id, db_id, table_name, CASE WHEN dp_id % 3 = 0 THEN lower(col_name) ELSE col_name END AS col_name FROM i_links WHERE dp_id % 7 <> 0
UNION ALL SELECT dp_id, db_id, 'SMALL', 'invented' FROM i_dps WHERE dp_id % 5 = 0"""


@check(
    "R1_filter_chosen",
    """SELECT DISTINCT g.dp_id, g.db_id, c.table_name, c.col_name FROM i_given g JOIN i_columns c ON g.db_id = c.db_id AND lower(g.table_name) = lower(c.table_name) AND lower(g.col_name) = lower(c.col_name)
UNION ALL SELECT d.dp_id, d.db_id, c.table_name, c.col_name FROM i_dps d JOIN i_columns c ON d.db_id = c.db_id WHERE d.dp_id NOT IN (SELECT dp_id FROM i_given)""",
)
def _(s):
    s.shared("i_columns")
    return links.filter_chosen(s["i_dps"], s["i_columns"], s["i_given"])


CLOSED = """
given AS (SELECT * FROM i_given UNION ALL SELECT d.dp_id, d.db_id, c.table_name, c.col_name FROM i_dps d JOIN i_columns c ON d.db_id = c.db_id WHERE d.dp_id NOT IN (SELECT dp_id FROM i_given)),
tb AS (SELECT DISTINCT dp_id, db_id, table_name FROM given),
fk AS (SELECT t.dp_id, t.db_id, f.table_name, f.col_name, f.fk_no, f.ref_table, f.ref_column FROM tb t JOIN i_fks f ON t.db_id = f.db_id AND t.table_name = f.table_name JOIN tb r ON r.dp_id = t.dp_id AND r.table_name = f.ref_table),
closed AS (
  SELECT g.dp_id, g.db_id, g.table_name, coalesce(c.col_name, g.col_name) AS col_name FROM given g LEFT JOIN i_columns c ON g.db_id = c.db_id AND g.table_name = c.table_name AND lower(g.col_name) = lower(c.col_name)
  UNION SELECT t.dp_id, t.db_id, t.table_name, c.col_name FROM tb t JOIN i_columns c ON t.db_id = c.db_id AND t.table_name = c.table_name WHERE c.is_pk
  UNION SELECT dp_id, db_id, table_name, col_name FROM fk)
"""


@check("R2_close_link", CLOSED + "SELECT dp_id, db_id, table_name, col_name FROM closed")
def _(s):
    s.shared("i_columns")
    return links.close_link(s["i_given"], s["i_columns"], s["i_fks"], dps=s["i_dps"])


def rendered(keys: str, shown: str, fks: str) -> str:
    """CTE ``stmt`` with one statement per key and table, from CTEs of shown columns and foreign keys."""
    return f"""
fkl AS (SELECT {keys}, table_name, string_agg('    FOREIGN KEY ("' || col_name || '") REFERENCES ' || ref_table || '("' || ref_column || '")', ',' || chr(10) ORDER BY fk_no) AS fk_text FROM {fks} GROUP BY ALL),
pkl AS (SELECT {keys}, table_name, '    PRIMARY KEY (' || string_agg('"' || col_name || '"', ', ' ORDER BY col_idx) || ')' AS pk_text FROM {shown} WHERE is_pk GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY {keys}, table_name ORDER BY col_idx DESC) = 1 AS is_last FROM {shown}),
ln AS (SELECT n.*, concat_ws(',' || chr(10), pk_text, fk_text) AS keys_text FROM num n LEFT JOIN pkl USING ({keys}, table_name) LEFT JOIN fkl USING ({keys}, table_name)),
stmt AS (SELECT {keys}, table_idx, table_name, 'CREATE TABLE "' || table_name || '" (' || any_value(table_comment) || chr(10)
    || string_agg('    "' || col_name || '" ' || upper(type_class) || CASE WHEN is_last AND keys_text = '' THEN '' ELSE ',' END || CASE WHEN comment = '' THEN '' ELSE ' ' || comment END || chr(10), '' ORDER BY col_idx)
    || CASE WHEN any_value(keys_text) = '' THEN '' ELSE any_value(keys_text) || chr(10) END || ');' || chr(10) AS statement
  FROM ln GROUP BY {keys}, table_idx, table_name)
"""


NOTED = """
noted AS (SELECT db_id, table_idx, table_name, table_comment, col_idx, col_name, type_class, is_pk, CASE WHEN comment = '' THEN '' ELSE '-- ' || comment END AS comment FROM i_defs)
"""


@check("R3_render_table", NOTED + "," + rendered("db_id", "noted", "i_fks") + "SELECT db_id, table_name, statement FROM stmt")
def _(s):
    return render.render_table(s["i_defs"], s["i_fks"])


HEADER = "'-- Database name: ' || db_id || chr(10) || '-- Database schema:' || chr(10) || string_agg(statement, '' ORDER BY table_idx)"
LINK_TEXT = (
    CLOSED
    + ","
    + NOTED
    + """,
shown AS (SELECT c.dp_id, n.* FROM closed c JOIN noted n ON c.db_id = n.db_id AND c.table_name = n.table_name AND c.col_name = n.col_name),
"""
    + rendered("dp_id, db_id", "shown", "fk")
)


@check("R4_render_schema", LINK_TEXT + f"SELECT dp_id, db_id, {HEADER} AS schema_text FROM stmt GROUP BY 1, 2")
def _(s):
    s.shared("i_columns")
    return render.render_schema(s["i_given"], s["i_defs"], s["i_fks"], dps=s["i_dps"])


EXAMPLE_LISTS = """
st AS (SELECT db_id, table_name, col_name, list(value ORDER BY ex_no) AS static FROM i_examples GROUP BY ALL),
dy AS (SELECT dp_id, table_name, col_name, list(value ORDER BY rn) AS short FROM i_retrieved GROUP BY ALL)
"""


def noted_texts(shown: str, fks: str) -> str:
    """Digests of schema texts with examples, from CTEs or tables of shown columns per question and of foreign keys."""
    return (
        EXAMPLE_LISTS
        + f""",
a AS (SELECT d.*, coalesce(short, []) AS short, coalesce(static, []) AS static FROM {shown} d
  LEFT JOIN st ON st.db_id = d.db_id AND st.table_name = d.table_name AND st.col_name = d.col_name LEFT JOIN dy ON dy.dp_id = d.dp_id AND dy.table_name = d.table_name AND dy.col_name = d.col_name),
mg AS (SELECT *, list_concat(short, list_slice(list_filter(static, lambda v: NOT list_contains(short, v)), 1, 4 - len(short))) AS merged FROM a),
co AS (SELECT *, CASE WHEN starts_with(merged[1], 'http://') THEN merged[1:1] ELSE merged END AS x FROM mg),
nt AS (SELECT * EXCLUDE (comment), CASE WHEN len(x) = 0 AND comment = '' THEN '' ELSE '-- ' || concat_ws(' | ', nullif(comment, ''), CASE WHEN len(x) > 0 THEN 'Value Examples: [' || {FORMATTED} || ']' END) END AS comment FROM co),
"""
        + rendered("dp_id, db_id", "nt", fks)
        + f"""
SELECT dp_id, db_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM (SELECT dp_id, db_id, {HEADER} AS t FROM stmt GROUP BY 1, 2)"""
    )


@check(
    "R5_schema_input",
    "asked AS (SELECT a.dp_id, d.* FROM i_asks a JOIN i_defs d ON a.db_id = d.db_id), fkd AS (SELECT a.dp_id, f.* FROM i_asks a JOIN i_fks f ON a.db_id = f.db_id)," + noted_texts("asked", "fkd"),
)
def _(s):
    s.shared("i_columns", "i_asks", "i_retrieved")
    return digested(render.schema_input(s["i_asks"], s["i_defs"], s["i_fks"], static_examples(s), s["i_retrieved"]))


def digested(texts: DataFrame) -> DataFrame:
    return texts.select("dp_id", "db_id", F.md5("schema_text").alias("digest"), F.length("schema_text").cast("long").alias("n"))


# what a question has retrieved is its link; some questions have none
INPUTS["i_asked_link"] = "SELECT DISTINCT dp_id, db_id, table_name, lower(col_name) AS col_name FROM i_retrieved WHERE dp_id % 4 <> 0"


@check(
    "R5_schema_input_of_link",
    CLOSED.replace("i_given", "i_asked_link").replace("i_dps", "i_asks")
    + ", asked AS (SELECT c.dp_id, d.* FROM closed c JOIN i_defs d ON c.db_id = d.db_id AND c.table_name = d.table_name AND c.col_name = d.col_name),"
    + noted_texts("asked", "fk"),
)
def _(s):
    s.shared("i_columns", "i_asks", "i_retrieved")
    return digested(render.schema_input(s["i_asks"], s["i_defs"], s["i_fks"], static_examples(s), s["i_retrieved"], s["i_asked_link"]))


@check(
    "R6_local_context",
    NOTED
    + ","
    + rendered("db_id", "noted", "i_fks")
    + ","
    + EXAMPLE_LISTS
    + f""",
t AS (SELECT DISTINCT r.dp_id, r.db_id, r.table_name, r.col_name FROM i_retrieved r),
x AS (SELECT t.*, d.type_class, statement, list_concat(coalesce(short, []), list_filter(coalesce(static, []), lambda v: NOT list_contains(coalesce(short, []), v))) AS x FROM t
  JOIN i_defs d ON t.db_id = d.db_id AND t.table_name = d.table_name AND t.col_name = d.col_name JOIN stmt ON stmt.db_id = t.db_id AND stmt.table_name = t.table_name
  LEFT JOIN st ON st.db_id = t.db_id AND st.table_name = t.table_name AND st.col_name = t.col_name LEFT JOIN dy ON dy.dp_id = t.dp_id AND dy.table_name = t.table_name AND dy.col_name = t.col_name)
SELECT dp_id, db_id, table_name, col_name, statement AS table_text, '[Column Value Examples]' || chr(10) || 'We want to know if the column named ''' || col_name
  || ''' is useful to answer the question, here are some example values of this column:' || chr(10) || {FORMATTED} AS example_text FROM x""",
)
def _(s):
    s.shared("i_columns", "i_retrieved")
    targets = s["i_retrieved"].select("dp_id", "db_id", "table_name", "col_name").distinct()
    return render.local_context(targets, s["i_defs"], s["i_fks"], static_examples(s), s["i_retrieved"])


@check(
    "R7_question_text",
    """SELECT dp_id, CASE WHEN dp_id % 3 = 0 THEN 'full ' || question WHEN dp_id % 3 = 1 THEN evidence || '?' ELSE question END AS question_text FROM i_dps WHERE dp_id % 3 <> 1 OR trim(coalesce(evidence, '')) <> ''
UNION ALL SELECT dp_id, question FROM i_dps WHERE dp_id % 3 = 1 AND trim(coalesce(evidence, '')) = ''""",
)
def _(s):
    full = F.when(F.col("dp_id") % 3 == 0, F.concat(F.lit("full "), "question")).when(F.col("dp_id") % 3 == 1, F.lit("  "))
    refined = F.when(F.col("dp_id") % 3 == 1, F.concat("evidence", F.lit("?")))
    return s["i_dps"].select("dp_id", prompts.question_text(full, refined, F.col("question")).alias("question_text"))


@check("R8_question_with_evidence", "SELECT dp_id, question || CASE WHEN length(trim(coalesce(evidence, ''))) >= 5 THEN chr(10) || '(hint: ' || trim(evidence) || ')' ELSE '' END AS question_text FROM i_dps")
def _(s):
    return s["i_dps"].select("dp_id", prompts.question_with_evidence(F.col("question"), F.col("evidence")).alias("question_text"))
