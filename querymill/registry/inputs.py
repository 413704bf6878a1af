"""Inputs of the checks: SQL over the given tables, read by Spark and by the oracle engine alike.

Every supplier is one database; the types of the parts it ships are its tables, the brands are
their columns. Every (supplier, quantity, return flag) is one question whose link is what its
line items touch. Events, line items and orders stand in for candidates and their results.
"""

from __future__ import annotations

from querymill.registry.base import INPUTS

INPUTS.update(
    # ---- databases, tables and columns
    i_lines="""
SELECT l_suppkey, l_quantity, l_returnflag, p_type, p_brand, p_name, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey""",
    i_columns="""
SELECT db_id, table_name, col_name, table_idx, col_idx, global_idx, brand, declared_type, col_idx = 0 AND table_name <> 'MEDIUM' AS is_pk, n_lines % 3 = 0 AS contains_null,
  CASE WHEN brand % 3 = 0 THEN lower(replace(col_name, '_', ' ')) WHEN brand % 3 = 1 THEN 'code of ' || col_name ELSE col_name END AS display_name,
  CASE WHEN table_idx % 2 = 0 THEN 'the ' || lower(table_name) || ' list' ELSE lower(table_name) || '_' END AS table_display,
  CASE WHEN CAST(substr(db_id, 4) AS INT) % 2 = 1 THEN max(table_idx) OVER (PARTITION BY db_id) - table_idx ELSE table_idx END AS display_idx
FROM (
  SELECT db_id, table_name, col_name, n_lines, CAST(substr(col_name, 7) AS INT) AS brand,
    CAST(dense_rank() OVER (PARTITION BY db_id ORDER BY table_name) - 1 AS BIGINT) AS table_idx,
    CAST(row_number() OVER (PARTITION BY db_id, table_name ORDER BY col_name) - 1 AS BIGINT) AS col_idx,
    CAST(row_number() OVER (PARTITION BY db_id ORDER BY table_name, col_name) AS BIGINT) AS global_idx,
    CASE CAST(substr(col_name, 7) AS INT) % 8 WHEN 0 THEN 'varchar(20)' WHEN 1 THEN 'bigint' WHEN 2 THEN 'double precision'
      WHEN 3 THEN 'datetime' WHEN 4 THEN 'decimal(10,2)' WHEN 5 THEN 'character(1)' WHEN 6 THEN 'json' ELSE '' END AS declared_type
  FROM (SELECT 'db_' || CAST(l_suppkey AS STRING) AS db_id, p_type AS table_name, replace(p_brand, '#', '_') AS col_name, n_lines
    FROM (SELECT l_suppkey, p_type, p_brand, count(*) AS n_lines FROM i_lines GROUP BY l_suppkey, p_type, p_brand) AS c) AS g
) AS o""",
    i_fks="""
SELECT db_id, table_name, col_idx AS fk_no, col_name, ref_table, ref_column, global_idx FROM (
  SELECT db_id, table_name, col_idx, col_name, brand, global_idx,
    CASE table_name WHEN 'ECONOMY' THEN 'LARGE' WHEN 'LARGE' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'PROMO' WHEN 'PROMO' THEN 'SMALL' WHEN 'SMALL' THEN 'STANDARD' ELSE 'ECONOMY' END AS ref_table,
    CASE table_name WHEN 'ECONOMY' THEN first_large WHEN 'LARGE' THEN first_medium WHEN 'MEDIUM' THEN first_promo WHEN 'PROMO' THEN first_small WHEN 'SMALL' THEN first_standard ELSE first_economy END AS ref_column
  FROM (SELECT db_id, table_name, col_idx, col_name, brand, global_idx,
      min(CASE WHEN table_name = 'ECONOMY' THEN col_name END) OVER (PARTITION BY db_id) AS first_economy,
      min(CASE WHEN table_name = 'LARGE' THEN col_name END) OVER (PARTITION BY db_id) AS first_large,
      min(CASE WHEN table_name = 'MEDIUM' THEN col_name END) OVER (PARTITION BY db_id) AS first_medium,
      min(CASE WHEN table_name = 'PROMO' THEN col_name END) OVER (PARTITION BY db_id) AS first_promo,
      min(CASE WHEN table_name = 'SMALL' THEN col_name END) OVER (PARTITION BY db_id) AS first_small,
      min(CASE WHEN table_name = 'STANDARD' THEN col_name END) OVER (PARTITION BY db_id) AS first_standard
    FROM i_columns) AS f) AS r
WHERE ref_column IS NOT NULL AND (col_idx = 1 OR (col_idx = 4 AND brand % 2 = 0))""",
    i_tables="""
SELECT DISTINCT db_id, table_idx, table_name, table_display, display_idx FROM i_columns""",
    i_globals="""
SELECT * FROM i_columns""",
    i_descriptions="""
SELECT 'ORIG' AS origin, p_partkey AS line_no, p_type AS table_name, CASE WHEN p_brand = 'Brand#7' THEN 'other' ELSE ' ' || replace(p_brand, '#', '_') || ' ' END AS original_column_name,
  CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN lower(replace(p_brand, '#', ' ')) ELSE ' commonsense evidence: ' || p_name || chr(10) || ' of  the ' || p_type END AS column_description,
  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN p_name || ' of the ' || p_type ELSE 'see ' || p_name END AS value_description
FROM part""",
    i_defs="""
SELECT db_id, table_idx, table_name, CASE WHEN table_idx % 2 = 0 THEN ' -- Table Description: ' || table_display ELSE '' END AS table_comment, col_idx, col_name, is_pk,
  CASE brand % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'integer' WHEN 2 THEN 'real' WHEN 3 THEN 'time' WHEN 4 THEN 'numeric' WHEN 5 THEN 'text' WHEN 6 THEN 'jsonb' ELSE 'others' END AS type_class,
  CASE WHEN brand % 3 = 1 THEN 'Column Meaning: ' || display_name ELSE '' END AS comment
FROM i_columns""",
    i_examples="""
SELECT db_id, table_name, col_name, ex_no, value FROM (
  SELECT db_id, table_name, col_name, value, CAST(row_number() OVER (PARTITION BY db_id, table_name, col_name ORDER BY value) AS BIGINT) AS ex_no
  FROM (SELECT 'db_' || CAST(l_suppkey AS STRING) AS db_id, p_type AS table_name, replace(p_brand, '#', '_') AS col_name, value
    FROM (SELECT DISTINCT l_suppkey, p_type, p_brand, CASE WHEN CAST(substr(p_brand, 7) AS INT) % 8 = 4 THEN CAST(p_partkey AS STRING) || '.50' ELSE p_name END AS value FROM i_lines) AS c) AS d) AS r
WHERE ex_no <= 5""",
    # ---- one question per customer against the first supplier it bought from
    i_asks="""
SELECT o_custkey AS dp_id, 'db_' || CAST(min(l_suppkey) AS STRING) AS db_id, CAST(count(*) AS BIGINT) AS n_lines
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey""",
    i_retrieved="""
SELECT dp_id, db_id, table_name, col_name, rn, value FROM (
  SELECT dp_id, db_id, table_name, col_name, value, CAST(row_number() OVER (PARTITION BY dp_id, table_name, col_name ORDER BY value DESC) AS BIGINT) AS rn
  FROM (SELECT DISTINCT a.dp_id, a.db_id, p_type AS table_name, replace(p_brand, '#', '_') AS col_name,
      CASE WHEN CAST(substr(p_brand, 7) AS INT) % 8 = 4 THEN CAST(p_partkey AS STRING) || '.25' WHEN p_size % 7 = 0 THEN repeat(p_name, 14) WHEN p_size % 7 = 1 THEN 'http://x.y/' || p_name ELSE p_name END AS value
    FROM i_asks a JOIN orders ON o_custkey = a.dp_id JOIN lineitem ON o_orderkey = l_orderkey AND a.db_id = 'db_' || CAST(l_suppkey AS STRING) JOIN part ON l_partkey = p_partkey) AS d) AS r
WHERE rn <= 3""",
    # ---- questions and their links
    i_dps="""
SELECT CAST(l_suppkey * 1000 + CAST(l_quantity AS INT) * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS dp_id, 'db_' || CAST(l_suppkey AS STRING) AS db_id,
  'Which ' || word1 || ' or ' || word2 || '?' AS question,
  CASE l_returnflag WHEN 'A' THEN ' refers to ' || word1 || ' ' WHEN 'N' THEN ' abc ' ELSE NULL END AS evidence,
  replace(lo, '#', '_') AS lo, replace(hi, '#', '_') AS hi
FROM (SELECT l_suppkey, l_quantity, l_returnflag, min(p_name) AS word1, max(p_name) AS word2, min(p_type || '|' || p_brand) AS lo, max(p_type || '|' || p_brand) AS hi
  FROM i_lines GROUP BY l_suppkey, l_quantity, l_returnflag) AS g""",
    i_links="""
SELECT CAST(l_suppkey * 1000 + CAST(l_quantity AS INT) * 10 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS dp_id, 'db_' || CAST(l_suppkey AS STRING) AS db_id,
  p_type AS table_name, replace(p_brand, '#', '_') AS col_name
FROM (SELECT DISTINCT l_suppkey, l_quantity, l_returnflag, p_type, p_brand FROM i_lines) AS d""",
    i_workload="""
SELECT dp_id, db_id, question, evidence, CASE dp_id % 9
  WHEN 0 THEN 'SELECT a.' || c1 || ', b.' || c2 || ' FROM ' || t1 || ' AS a JOIN ' || t2 || ' b ON a.' || c1 || ' = b.' || c2 || ' WHERE a.' || c1 || ' = ''' || c2 || ''''
  WHEN 1 THEN 'select count(*) from ' || t1
  WHEN 2 THEN 'SELECT lower(x.' || c1 || ') FROM ' || t1 || ' AS x WHERE x.bogus = 3'
  WHEN 3 THEN 'WITH w AS (SELECT ' || lower(c1) || ' FROM ' || t1 || ') SELECT ' || c1 || ' FROM w;'
  WHEN 4 THEN 'SELECT ' || c1 || ' FROM ' || t1 || ' WHERE ' || c1 || ' IN (SELECT ' || c2 || ' FROM ' || t2 || ')'
  WHEN 5 THEN 'SELECT o.' || c1 || ' FROM ' || lower(t1) || ' o, order WHERE order.note = ''order by me'' ORDER  BY o.' || c1
  WHEN 6 THEN 'select  ' || c1 || ' -- pick ' || c2 || chr(10) || ' from   ' || t1 || ' /* in order */ group by "' || c1 || '" ;'
  WHEN 7 THEN 'SELECT ' || t1 || '.' || c1 || ' FROM ' || t1 || ' join ' || t2
  ELSE 'SELECT ref_company_types.kind FROM ref_company_types, ' || t1 END AS sql
FROM (SELECT dp_id, db_id, question, evidence, split_part(lo, '|', 1) AS t1, split_part(lo, '|', 2) AS c1, split_part(hi, '|', 1) AS t2, split_part(hi, '|', 2) AS c2 FROM i_dps) AS d""",
    # ---- executed candidates: one datapoint per supplier, 28 candidates, candidate 0 is gold
    i_execs="""
SELECT DISTINCT dp_id, cand_id, cand_id = 0 AS is_gold,
  CASE WHEN cand_id = 0 AND dp_id % 10 = 3 THEN 'error' WHEN cand_id > 0 AND (dp_id + cand_id) % 7 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN cand_id = 0 AND dp_id % 10 = 3 THEN 'Execution error: gold' WHEN cand_id > 0 AND (dp_id + cand_id) % 7 = 0 THEN 'Query timed out after 30 seconds.' END AS error,
  CASE WHEN cand_id % 9 = 8 THEN ' ' WHEN cand_id % 2 = 0 THEN 'SELECT  flag FROM lineitem where k=' || CAST(cand_id % 5 AS STRING) ELSE 'select flag from lineitem WHERE k=' || CAST(cand_id % 5 AS STRING) || ' ;' END AS sql
FROM (SELECT l_suppkey AS dp_id, CAST((l_linenumber - 1) * 4 + l_orderkey % 4 AS BIGINT) AS cand_id FROM lineitem) AS c""",
    i_results="""
SELECT dp_id, cand_id, CAST(row_number() OVER (PARTITION BY dp_id, cand_id ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS row_no,
  CASE WHEN (dp_id + 2 * cand_id) % 11 = 5 THEN {ARRAY(}CAST(NULL AS STRING), CAST(NULL AS STRING))
    ELSE {ARRAY(}CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END, CAST(l_orderkey % 2 AS STRING) || CASE WHEN cand_id % 3 = 2 THEN '.0' ELSE '' END) END AS cells
FROM (SELECT l_suppkey AS dp_id, CAST((l_linenumber - 1) * 4 + l_orderkey % 4 AS BIGINT) AS cand_id, l_orderkey, l_partkey, l_quantity, l_extendedprice, l_returnflag FROM lineitem) AS c
WHERE (dp_id * 3 + cand_id) % 9 <> 1 AND NOT (cand_id = 0 AND dp_id % 10 = 3) AND NOT (cand_id > 0 AND (dp_id + cand_id) % 7 = 0)""",
    # ---- votes: one datapoint per user, one candidate per event, gold = the user's first event
    i_votes="""
SELECT user_id AS dp_id, event_id AS cand_id, 'SELECT ' || CAST(event_id % 7 AS STRING) || ' -- ' || event_type AS sql, md5(event_type) AS fingerprint,
  event_id = min(event_id) OVER (PARTITION BY user_id) AS is_gold, event_type, value
FROM events""",
    i_gold="""
SELECT dp_id, cand_id, sql, fingerprint FROM i_votes WHERE is_gold""",
    # ---- attempts: one datapoint per customer, path and attempt number from the orders
    i_attempts="""
SELECT dp_id, path, CAST(row_number() OVER (PARTITION BY dp_id, path ORDER BY o_orderkey) - 1 AS BIGINT) AS attempt_no, sql, is_equal FROM (
  SELECT o_custkey AS dp_id, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'CTE' ELSE 'Subquery' END AS path,
    CASE WHEN o_orderpriority = '5-LOW' THEN ' ' WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN NULL ELSE 'SELECT ' || CAST(o_orderkey AS STRING) END AS sql,
    o_orderstatus = 'F' AS is_equal FROM orders) AS a""",
    i_rounds="""
SELECT o_custkey AS dp_id, o_orderkey AS cand_id, o_orderkey % 4 AS round, o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AS valid FROM orders""",
    i_round_dps="""
SELECT c_custkey AS dp_id, 'prepared ' || c_name AS schema_text, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'full ' || c_mktsegment END AS fallback_schema FROM customer""",
    # ---- preference pairs and judgements
    i_members="""
SELECT dp_id, cand_id AS member_id, CASE WHEN cand_id % 6 = 0 THEN '' ELSE sql END AS sql, event_type IN ('click', 'view') AS is_correct FROM i_votes""",
    i_pairs="""
SELECT event_id AS pair_id, 'Compare ' || event_type AS prompt, 'SELECT ' || CAST(event_id AS STRING) AS sql1, 'SELECT ' || CAST(user_id AS STRING) AS sql2,
  CASE WHEN event_id % 2 = 0 THEN 'SQL1' ELSE 'SQL2' END AS winner FROM events""",
    i_answers="""
SELECT event_id AS pair_id, 1 AS stage, 'first look ' || props || '  ' AS analysis, CASE WHEN value < 5 THEN 'sql1' WHEN value < 10 THEN 'SQL2' ELSE '' END AS final_choice FROM events WHERE event_type <> 'error'
UNION ALL
SELECT event_id, 2, 'second look ' || props || chr(10), CASE WHEN user_id % 3 = 0 THEN 'SQL1' WHEN user_id % 3 = 1 THEN 'sql2' ELSE 'neither' END FROM events""",
    # ---- generated texts
    i_generations="""
SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN 'thinking [SQL Query Answer] ```sql' || chr(10) || 'SELECT ''' || replace(text, '''', ' ') || '''  FROM t ;' || chr(10) || '```'
  WHEN 1 THEN ' [N/A] '
  WHEN 2 THEN '[SQL Query Answer][N/A]'
  WHEN 3 THEN ';select  1; '
  WHEN 4 THEN '   '
  ELSE text END AS text FROM documents""",
)
