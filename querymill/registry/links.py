"""Checks of SQL-workload analysis and of predicted links."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.functions import sqltext
from querymill.operators import links, select, workload
from querymill.registry import inputs  # noqa: F401
from querymill.registry.base import INPUTS, check
from querymill.session import cut_lineage

# ------------------------------------------------------------------ workload
FILTERED = """
kept AS (SELECT * FROM i_workload WHERE NOT (contains(lower(sql), ' join ') AND NOT contains(lower(sql), 'on') AND NOT contains(lower(sql), 'using'))
  AND db_id IN (SELECT db_id FROM i_fks))
"""


@check("L1_filter_workload", FILTERED + "SELECT dp_id, db_id, sql FROM kept")
def _(s):
    return workload.filter_workload(s["i_workload"], s["i_fks"]).select("dp_id", "db_id", "sql")


# documents as SQL comments and literals, statements of all kinds around them
INPUTS["i_texts"] = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'select ''' || replace(text, '''', '''''') || ''' as order  from order where a = ''order by'' Order  By "order" ; ;'
  WHEN 1 THEN '/* ' || replace(text, '*/', '* /') || ' */ with q as (' || chr(10) || ' select x -- from y' || chr(10) || 'from t) select * from q'
  ELSE 'select a,b from (select max(b) b, a from t group by a) -- ' || replace(text, chr(10), ' ') || chr(10) || 'order by a' END AS sql FROM documents"""
KEYWORD_LIST = ", ".join(f"'{k}'" for k in sqltext.KEYWORDS)
TOKEN_RE = r"""''(?:''''|[^''])*''|"[^"]*"|--[^\n]*|/\*(?s:.)*?\*/|[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]"""


@check(
    "L2_canonical_sql",
    rf"""
t AS (SELECT doc_id, regexp_extract_all(sql, '{TOKEN_RE}') AS w FROM i_texts),
u AS (SELECT doc_id, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^(?:--|/\*|\s)') THEN ' ' WHEN lower(x) IN ({KEYWORD_LIST}) THEN upper(x) ELSE x END), '') AS x FROM t)
SELECT doc_id, regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '[; ]+$', '') || ';' AS sql FROM u""",
)
def _(s):
    return s["i_texts"].select("doc_id", sqltext.canonical_sql(F.col("sql")).alias("sql"))


# the links that each template of i_workload has, as stated by the template
PARTS = "parts AS (SELECT dp_id, db_id, lower(split_part(lo, '|', 1)) AS t1, lower(split_part(lo, '|', 2)) AS c1, lower(split_part(hi, '|', 1)) AS t2, lower(split_part(hi, '|', 2)) AS c2 FROM i_dps)"
FOUND = f"""
{PARTS},
found AS (
  SELECT dp_id, db_id, t1 AS tbl, c1 AS col, true AS known FROM parts WHERE dp_id % 9 IN (0, 2, 3, 4, 5, 6, 7)
  UNION SELECT dp_id, db_id, t2, c2, true FROM parts WHERE dp_id % 9 IN (0, 4)
  UNION SELECT dp_id, db_id, t1, 'bogus', false FROM parts WHERE dp_id % 9 = 2
  UNION SELECT dp_id, db_id, t1, NULL, true FROM parts
  UNION SELECT dp_id, db_id, t2, NULL, true FROM parts WHERE dp_id % 9 IN (0, 4, 7))
"""
# stars, output names, branches of set operations, names of WITH, quoted names, and aliases that stand for another table in an inner scope
INPUTS["i_scoped"] = """
SELECT -1 - dp_id AS dp_id, db_id, CASE dp_id % 12
  WHEN 6 THEN 'SELECT ' || c1 || ' FROM ' || t1 || ' UNION SELECT ' || c2 || ' FROM ' || t2
  WHEN 7 THEN '(SELECT x.' || c1 || ' FROM ' || t1 || ' x) UNION ALL SELECT x.' || c2 || ' FROM ' || t2 || ' x ORDER BY 1'
  WHEN 8 THEN 'SELECT count(*) ' || c1 || ' FROM ' || t1 || ' GROUP BY 1 + 1 ORDER BY ' || c1
  WHEN 9 THEN 'SELECT z.' || c2 || ', y.' || c1 || ' FROM (' || t1 || ' y JOIN ' || t2 || ' z ON (y.' || c1 || ' = z.' || c2 || ')) WHERE ((y.' || c1 || ' > 0))'
  WHEN 10 THEN 'WITH ' || t1 || ' AS (SELECT ' || c1 || ' FROM ' || t1 || ') SELECT ' || t1 || '.' || c1 || ' FROM ' || t1 || ' ORDER BY ' || c1
  WHEN 11 THEN 'SELECT "' || c1 || '" kept, ''x'' ' || c2 || ' FROM `' || t1 || '` ORDER BY ' || c2
  WHEN 0 THEN 'SELECT * FROM ' || t1 || ' WHERE 1 = 1'
  WHEN 1 THEN 'SELECT a.* FROM ' || t1 || ' AS a, ' || t2 || ' b WHERE b.' || c2 || ' = 1'
  WHEN 2 THEN 'SELECT count(*) AS ' || c1 || ' FROM ' || t1 || ' ORDER BY ' || c1
  WHEN 3 THEN 'SELECT x.' || c1 || ' FROM ' || t1 || ' x WHERE x.' || c1 || ' IN (SELECT max(x.' || c2 || ') FROM ' || t2 || ' x WHERE (x.' || c2 || ' > 1)) AND x.' || c1 || ' > 0'
  WHEN 4 THEN 'SELECT s.' || c2 || ' FROM (SELECT q.* FROM ' || t2 || ' q) s'
  ELSE 'SELECT * FROM (SELECT ' || c1 || ' FROM ' || t1 || ') s JOIN ' || t2 || ' ON 1 = 1' END AS sql
FROM (SELECT dp_id, db_id, split_part(lo, '|', 1) AS t1, split_part(lo, '|', 2) AS c1, split_part(hi, '|', 1) AS t2, split_part(hi, '|', 2) AS c2 FROM i_dps) AS d"""
SCOPED = """,
every AS (SELECT p.*, 'first' AS side, lower(c.col_name) AS col FROM parts p JOIN i_columns c ON p.db_id = c.db_id AND p.t1 = lower(c.table_name)
  UNION ALL SELECT p.*, 'second', lower(c.col_name) FROM parts p JOIN i_columns c ON p.db_id = c.db_id AND p.t2 = lower(c.table_name)),
scoped AS (
  SELECT -1 - dp_id AS dp_id, db_id, t1 AS tbl, col, true AS known FROM every WHERE side = 'first' AND dp_id % 12 IN (0, 1)
  UNION SELECT -1 - dp_id, db_id, t2, col, true FROM every WHERE side = 'second' AND dp_id % 12 IN (4, 5)
  UNION SELECT -1 - dp_id, db_id, t1, c1, true FROM parts WHERE dp_id % 12 IN (3, 5, 6, 7, 9, 10, 11)
  UNION SELECT -1 - dp_id, db_id, t2, c2, true FROM parts WHERE dp_id % 12 IN (1, 3, 6, 7, 9)
  UNION SELECT -1 - dp_id, db_id, t1, NULL, true FROM parts WHERE dp_id % 12 <> 4
  UNION SELECT -1 - dp_id, db_id, t2, NULL, true FROM parts WHERE dp_id % 12 IN (1, 3, 4, 5, 6, 7, 9))
"""


@check("L3_link_columns", FOUND + SCOPED + "SELECT dp_id, db_id, tbl AS table_name, col AS col_name, known FROM found UNION ALL SELECT * FROM scoped")
def _(s):
    s.shared("i_dps")
    return workload.link_columns(s["i_workload"].select("dp_id", "db_id", "sql").unionByName(s["i_scoped"]), s["i_columns"])


VALID = (
    FOUND.replace("found AS (", "stated AS (")
    + SCOPED
    + """,
found AS (SELECT * FROM stated UNION ALL SELECT * FROM scoped),
ok AS (SELECT * FROM found WHERE dp_id NOT IN (SELECT dp_id FROM found WHERE NOT known)),
base AS (SELECT o.dp_id, o.db_id, c.table_name, c.col_name, c.col_idx, c.is_pk FROM ok o JOIN i_columns c ON o.db_id = c.db_id AND o.tbl = lower(c.table_name) AND o.col = lower(c.col_name)
  UNION SELECT o.dp_id, o.db_id, c.table_name, c.col_name, c.col_idx, c.is_pk FROM ok o JOIN i_columns c ON o.db_id = c.db_id AND o.tbl = lower(c.table_name) WHERE o.col IS NULL AND c.is_pk),
valid AS (SELECT * FROM base UNION SELECT o.dp_id, o.db_id, c.table_name, c.col_name, c.col_idx, c.is_pk FROM ok o JOIN i_columns c ON o.db_id = c.db_id AND o.tbl = lower(c.table_name) WHERE o.col IS NULL AND o.dp_id NOT IN (SELECT dp_id FROM base))
"""
)


@check("L4_validate_link", VALID + "SELECT dp_id, db_id, table_name, col_name, col_idx, is_pk FROM valid UNION ALL SELECT DISTINCT dp_id, db_id, 'rejected', NULL, NULL, NULL FROM found WHERE NOT known")
def _(s):
    found = workload.link_columns(s["i_workload"].select("dp_id", "db_id", "sql").unionByName(s["i_scoped"]), s["i_columns"])
    kept, rejected = workload.validate_link(found, s["i_columns"])
    return kept.unionByName(rejected.withColumn("table_name", F.lit("rejected")), allowMissingColumns=True)


LINEAR = """
lin AS (SELECT dp_id, db_id, '```json' || chr(10) || '{' || chr(10) || string_agg('  "' || table_name || '": [' || chr(10) || cols || chr(10) || '  ]', ',' || chr(10) ORDER BY table_idx) || chr(10) || '}' || chr(10) || '```' AS linearized
  FROM (SELECT l.dp_id, l.db_id, l.table_name, min(c.table_idx) AS table_idx, string_agg('    "' || l.col_name || '"', ',' || chr(10) ORDER BY c.col_idx) AS cols
    FROM i_links l JOIN i_columns c ON l.db_id = c.db_id AND l.table_name = c.table_name AND l.col_name = c.col_name GROUP BY 1, 2, 3) GROUP BY 1, 2)
"""


@check("L5_linearize_link", LINEAR + "SELECT dp_id, db_id, linearized FROM lin")
def _(s):
    return links.linearize_link(s["i_links"], s["i_columns"], s["i_fks"])


@check(
    "L6_reasoning_path",
    r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'CTE' ELSE 'Subquery' END AS path FROM i_texts
UNION ALL SELECT dp_id, CASE dp_id % 9 WHEN 3 THEN 'CTE' WHEN 4 THEN 'Subquery' ELSE 'Normal' END FROM i_workload""",
)
def _(s):
    both = s["i_texts"].unionByName(s["i_workload"].select(F.col("dp_id").alias("doc_id"), "sql"))
    return both.select("doc_id", sqltext.reasoning_path(F.col("sql")).alias("path"))


RESERVED_RE = r"""(?i)''(?:''''|[^''])*''|"[^"]*"|ORDER\s+BY|[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"""


@check(
    "L7_quote_reserved",
    rf"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(sql, '{RESERVED_RE}'), lambda x: CASE WHEN lower(x) = 'order' THEN '"order"' ELSE x END), '') AS sql
FROM (SELECT doc_id, sql FROM i_texts UNION ALL SELECT dp_id, sql FROM i_workload)""",
)
def _(s):
    both = s["i_texts"].unionByName(s["i_workload"].select(F.col("dp_id").alias("doc_id"), "sql"))
    return both.select("doc_id", sqltext.quote_reserved(F.col("sql")).alias("sql"))


# ------------------------------------------------------------------ predicted links
# answers of a linking model: fenced or bare JSON, trailing commas, malformed values, no JSON at all
INPUTS["i_predictions"] = """
SELECT dp_id, db_id, lo, hi, CASE dp_id % 6
  WHEN 0 THEN 'The link:' || chr(10) || '```json' || chr(10) || '{"' || lower(t1) || '": ["' || c1 || '", "made_up"],' || chr(10) || '}' || chr(10) || '``` as asked {}'
  WHEN 1 THEN 'It is {"' || t1 || '": ["' || c1 || '",], "' || upper(t2) || '": ["' || c2 || '" , ] , }.'
  WHEN 2 THEN '{"' || t1 || '": "' || c1 || '"}'
  WHEN 3 THEN 'no idea'
  WHEN 4 THEN '["' || t1 || '"]'
  ELSE '{"Nowhere": ["' || c1 || '"], "' || t1 || '": []}' END AS text
FROM (SELECT dp_id, db_id, lo, hi, split_part(lo, '|', 1) AS t1, split_part(lo, '|', 2) AS c1, split_part(hi, '|', 1) AS t2, split_part(hi, '|', 2) AS c2 FROM i_dps) AS d"""
PREDICTED = """
p AS (SELECT dp_id, db_id, split_part(lo, '|', 1) AS t1, split_part(lo, '|', 2) AS c1, split_part(hi, '|', 1) AS t2, split_part(hi, '|', 2) AS c2, dp_id % 6 AS k FROM i_dps),
plink AS (SELECT dp_id, db_id, lower(t1) AS table_name, c1 AS col_name FROM p WHERE k = 0 UNION SELECT dp_id, db_id, lower(t1), 'made_up' FROM p WHERE k = 0
  UNION SELECT dp_id, db_id, t1, c1 FROM p WHERE k = 1 AND t1 <> t2 UNION SELECT dp_id, db_id, t2, c2 FROM p WHERE k = 1 UNION SELECT dp_id, db_id, 'Nowhere', c1 FROM p WHERE k = 5)
"""


@check("X14_parse_link_json", PREDICTED + "SELECT dp_id, db_id, table_name, col_name FROM plink")
def _(s):
    return links.predicted_links(s["i_predictions"])


@check(
    "X15_match_table_names",
    PREDICTED
    + """SELECT DISTINCT l.dp_id, l.db_id, coalesce(c.table_name, l.table_name) AS table_name, l.col_name FROM plink l
LEFT JOIN (SELECT DISTINCT db_id, table_name FROM i_columns) c ON l.db_id = c.db_id AND lower(l.table_name) = lower(c.table_name)""",
)
def _(s):
    return links.match_table_names(links.predicted_links(s["i_predictions"]), s["i_columns"])


KEYED = """
keyed AS (SELECT c.*, c.is_pk OR EXISTS (SELECT 1 FROM i_fks f WHERE f.db_id = c.db_id AND f.table_name = c.table_name AND f.col_name = c.col_name) AS is_key FROM i_columns c)
"""
TO_JUDGE = (
    KEYED
    + """,
judge AS (SELECT t.dp_id, t.db_id, c.table_name, c.col_name FROM (SELECT DISTINCT dp_id, db_id, table_name FROM i_links) t JOIN keyed c ON t.db_id = c.db_id AND t.table_name = c.table_name
  WHERE NOT c.is_key AND NOT EXISTS (SELECT 1 FROM i_links l WHERE l.dp_id = t.dp_id AND l.table_name = c.table_name AND l.col_name = c.col_name))
"""
)


@check("X16_columns_to_judge", TO_JUDGE + "SELECT dp_id, db_id, table_name, col_name FROM judge")
def _(s):
    return links.columns_to_judge(s["i_links"], s["i_columns"], s["i_fks"])


@check(
    "X17_merge_judgements",
    TO_JUDGE + "SELECT dp_id, db_id, table_name, col_name FROM i_links UNION SELECT dp_id, db_id, table_name, col_name FROM judge WHERE substr(md5(dp_id || col_name), 1, 1) < '4'",
)
def _(s):
    s.shared("i_columns")
    judged = links.columns_to_judge(s["i_links"], s["i_columns"], s["i_fks"])
    return links.merge_judgements(s["i_links"], judged.withColumn("useful", F.substring(F.md5(F.concat(F.col("dp_id").cast("string"), "col_name")), 1, 1) < "4"))


@check("X18_guard_malformed", "SELECT dp_id, db_id, CASE WHEN dp_id % 6 <> 2 AND db_id IN (SELECT db_id FROM i_fks WHERE ref_table = 'LARGE') THEN 'schema of ' || db_id ELSE '' END AS schema_text FROM i_dps")
def _(s):
    known = s["i_fks"].filter("ref_table = 'LARGE'")
    return links.guard_malformed(s["i_predictions"], known, "text", F.concat(F.lit("schema of "), "db_id"))


@check("X19_ordered_output", "SELECT dp_id, nullif(db_id, 'db_5') AS db_id, question, CAST(rank() OVER (ORDER BY coalesce(nullif(db_id, 'db_5'), ''), coalesce(question, '')) - 1 AS BIGINT) AS placed FROM i_dps")
def _(s):
    ordered = select.ordered_output(s["i_dps"].select("dp_id", F.nullif("db_id", F.lit("db_5")).alias("db_id"), "question"))
    # the place a row has in the sorted output: its partition's rows before, and its own place there
    at = ordered.select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    at = cut_lineage(at)
    before = at.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("i") - F.shiftleft(F.col("p").cast("long"), 33)
    # rows with equal keys may stand in any order: the first place of them all
    ties = W.partitionBy(F.coalesce("db_id", F.lit("")), F.coalesce("question", F.lit("")))
    return at.join(before, "p").withColumn("placed", place).select("dp_id", "db_id", "question", F.min("placed").over(ties).alias("placed"))
