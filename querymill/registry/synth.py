"""Checks of training-set synthesis."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from querymill.functions import prompts
from querymill.operators import pairs, synth
from querymill.registry import inputs  # noqa: F401
from querymill.registry.base import INPUTS, Source, check
from querymill.registry.catalog import HEADER, NOTED, rendered
from querymill.registry.links import KEYED, LINEAR
from querymill.session import cut_lineage

U = "(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0)"


def u(key: str) -> str:
    return U.format(key)


# ------------------------------------------------------------------ noise
NOISE_TABLES = (
    KEYED
    + f""",
dp AS (SELECT DISTINCT dp_id, db_id FROM i_links),
outs AS (SELECT d.dp_id, d.db_id, t.table_name, row_number() OVER (PARTITION BY d.dp_id ORDER BY md5('42|t|' || d.dp_id || '|' || t.table_name)) AS rn
  FROM dp d JOIN (SELECT DISTINCT db_id, table_name FROM i_columns) t ON d.db_id = t.db_id WHERE NOT EXISTS (SELECT 1 FROM i_links l WHERE l.dp_id = d.dp_id AND l.table_name = t.table_name)),
adt AS (SELECT dp_id, db_id, table_name, 2 + floor({u("'42|m|' || dp_id || '|' || table_name")} * 3) AS m FROM outs WHERE rn <= floor({u("'42|n|' || dp_id")} * 3)),
adc AS (SELECT a.dp_id, a.db_id, a.table_name, c.col_name, c.is_pk, m, row_number() OVER (PARTITION BY a.dp_id, a.table_name, c.is_pk ORDER BY md5('42|c|' || a.dp_id || '|' || a.table_name || '|' || c.col_name)) AS rn
  FROM adt a JOIN i_columns c ON a.db_id = c.db_id AND a.table_name = c.table_name),
added AS (SELECT dp_id, db_id, table_name, col_name FROM adc WHERE is_pk OR rn <= m)
"""
)


@check("T1_noise_tables", NOISE_TABLES + "SELECT dp_id, db_id, table_name, col_name FROM added")
def _(s):
    s.shared("i_columns")
    return synth.noise_tables(s["i_links"], s["i_columns"], s["i_fks"])


BRIDGE = (
    NOISE_TABLES
    + """,
bridge AS (SELECT DISTINCT l.dp_id, l.db_id, f.table_name, f.col_name FROM i_links l JOIN i_fks f ON l.db_id = f.db_id AND l.table_name = f.table_name
  JOIN added a ON a.dp_id = l.dp_id AND a.table_name = f.ref_table WHERE NOT EXISTS (SELECT 1 FROM i_links x WHERE x.dp_id = l.dp_id AND x.table_name = f.table_name AND x.col_name = f.col_name))
"""
)


@check("T2_noise_fk_bridge", BRIDGE + "SELECT dp_id, db_id, table_name, col_name FROM bridge")
def _(s):
    s.shared("i_columns")
    added = synth.noise_tables(s["i_links"], s["i_columns"], s["i_fks"])
    return synth.noise_fk_bridge(s["i_links"], added, s["i_fks"])


def noise_cols(current: str) -> str:
    return f"""
lt AS (SELECT DISTINCT dp_id, db_id, table_name FROM i_links WHERE {u("'42|p|' || dp_id || '|' || table_name")} <= 0.5),
nc AS (SELECT t.dp_id, t.db_id, c.table_name, c.col_name, row_number() OVER (PARTITION BY t.dp_id, c.table_name ORDER BY md5('42|x|' || t.dp_id || '|' || c.table_name || '|' || c.col_name)) AS rn
  FROM lt t JOIN keyed c ON t.db_id = c.db_id AND t.table_name = c.table_name WHERE NOT c.is_key AND NOT EXISTS (SELECT 1 FROM {current} l WHERE l.dp_id = t.dp_id AND l.table_name = c.table_name AND l.col_name = c.col_name)),
ncols AS (SELECT dp_id, db_id, table_name, col_name FROM nc WHERE rn <= 1 + floor({u("'42|k|' || dp_id || '|' || table_name")} * 2))
"""


@check("T3_noise_columns", KEYED + "," + noise_cols("i_links") + "SELECT dp_id, db_id, table_name, col_name FROM ncols")
def _(s):
    s.shared("i_columns")
    return synth.noise_columns(s["i_links"], s["i_columns"], s["i_fks"])


SAMPLES = (
    KEYED
    + """,
dp AS (SELECT DISTINCT dp_id, db_id FROM i_links),
pool AS (SELECT d.dp_id, d.db_id, c.table_name, c.col_name, EXISTS (SELECT 1 FROM i_links l WHERE l.dp_id = d.dp_id AND l.table_name = c.table_name AND l.col_name = c.col_name) AS pos,
    EXISTS (SELECT 1 FROM i_links l WHERE l.dp_id = d.dp_id AND l.table_name = c.table_name) AS near FROM dp d JOIN keyed c ON d.db_id = c.db_id WHERE NOT c.is_key),
np AS (SELECT dp_id, count(*) AS n FROM pool WHERE pos GROUP BY 1),
neg AS (SELECT p.*, n, row_number() OVER (PARTITION BY p.dp_id ORDER BY near DESC, md5('42|' || p.dp_id || '|' || lower(table_name) || chr(31) || lower(col_name))) AS rn FROM pool p JOIN np ON p.dp_id = np.dp_id WHERE NOT pos),
samples AS (SELECT dp_id, db_id, table_name, col_name, 'True' AS label, '' AS neg_type FROM pool WHERE pos
  UNION ALL SELECT dp_id, db_id, table_name, col_name, 'False', CASE WHEN near THEN 'hard' ELSE 'easy' END FROM neg WHERE rn <= ceil(3.0 * n))
"""
)


@check("T4_column_samples", SAMPLES + "SELECT dp_id, db_id, table_name, col_name, label, neg_type FROM samples")
def _(s):
    return synth.column_samples(s["i_links"], s["i_columns"], s["i_fks"])


@check(
    "T5_generation_stats",
    SAMPLES
    + """,
kn AS (SELECT DISTINCT db_id FROM i_columns WHERE db_id NOT LIKE '%7')
SELECT (SELECT count(*) FROM samples WHERE db_id IN (FROM kn)) AS produced, (SELECT count(*) FROM dp WHERE db_id NOT IN (FROM kn)) AS skipped_no_ir,
  (SELECT count(*) FROM dp WHERE db_id IN (FROM kn) AND dp_id NOT IN (SELECT dp_id FROM np)) AS skipped_no_positive""",
)
def _(s):
    known = s["i_columns"].filter(~F.col("db_id").like("%7"))
    seen = Observation()
    cut_lineage(synth.column_samples(s["i_links"], known, s["i_fks"], seen=seen))
    return synth.generation_stats(s["i_dps"], known, seen)


NOISED = (
    BRIDGE
    + """,
nbase AS (SELECT dp_id, db_id, table_name, col_name FROM i_links UNION SELECT * FROM added UNION SELECT * FROM bridge),
"""
    + noise_cols("nbase")
    + """,
noised AS (SELECT * FROM nbase UNION SELECT * FROM ncols),
ntb AS (SELECT DISTINCT dp_id, db_id, table_name FROM noised),
nfk AS (SELECT t.dp_id, t.db_id, f.table_name, f.col_name, f.fk_no, f.ref_table, f.ref_column FROM ntb t JOIN i_fks f ON t.db_id = f.db_id AND t.table_name = f.table_name JOIN ntb r ON r.dp_id = t.dp_id AND r.table_name = f.ref_table),
nclosed AS (SELECT * FROM noised UNION SELECT t.dp_id, t.db_id, t.table_name, c.col_name FROM ntb t JOIN i_columns c ON t.db_id = c.db_id AND t.table_name = c.table_name WHERE c.is_pk UNION SELECT dp_id, db_id, table_name, col_name FROM nfk),
"""
    + NOTED
    + """,
nshown AS (SELECT c.dp_id, n.* FROM nclosed c JOIN noted n ON c.db_id = n.db_id AND c.table_name = n.table_name AND c.col_name = n.col_name),
"""
    + rendered("dp_id, db_id", "nshown", "nfk")
)


@check("T6_noised_schema", NOISED + f"SELECT dp_id, db_id, md5({HEADER}) AS digest FROM stmt GROUP BY 1, 2")
def _(s):
    return synth.noised_schema(s["i_dps"], s["i_links"], s["i_defs"], s["i_fks"]).select("dp_id", "db_id", F.md5("schema_text").alias("digest"))


# ------------------------------------------------------------------ split and corrupted links
def split_sql(table: str, group: str, seed: int, tol: str) -> str:
    """Trials one by one, until one fits."""
    return f"""
cnt AS (SELECT {group} AS g, count(*) AS n FROM {table} GROUP BY 1),
tot AS (SELECT CAST(floor(count(*) * 0.3) AS INT) AS take, sum(n) AS total FROM cnt),
tr AS (SELECT 0 AS trial, CAST(-1 AS BIGINT) AS s
  UNION ALL SELECT t, CAST(sum(n) AS BIGINT) FROM (
    SELECT trial + 1 AS t, n, take, row_number() OVER (ORDER BY md5('{seed}|' || (trial + 1) || '|' || g), g) AS rn FROM tr, cnt, tot WHERE trial < 1000 AND (trial = 0 OR abs(s - total * 0.3) > total * {tol}))
  WHERE rn <= take GROUP BY t),
win AS (SELECT coalesce(min(trial), 1001) AS trial FROM tr, tot WHERE trial > 0 AND abs(s - total * 0.3) <= total * {tol}),
split AS (SELECT g, n, trial, CASE WHEN rn <= take THEN 'A' ELSE 'B' END AS side FROM (SELECT g, n, trial, row_number() OVER (ORDER BY md5('{seed}|' || trial || '|' || g), g) AS rn FROM cnt, win), tot)
"""


@check("T7_group_split", "RECURSIVE " + split_sql("lineitem", "l_suppkey", 7, "0.0002") + "SELECT g AS l_suppkey, n AS n_rows, CAST(trial AS BIGINT) AS trial, side FROM split")
def _(s):
    return synth.group_split(s["lineitem"], "l_suppkey", tol=0.0002, seed=7)


DROP_COLUMN = (
    KEYED
    + f""",
lk AS (SELECT l.*, c.is_key FROM i_links l JOIN keyed c ON l.db_id = c.db_id AND l.table_name = c.table_name AND l.col_name = c.col_name),
sm AS (SELECT lk.*, sample_no, count(*) FILTER (WHERE NOT is_key) OVER (PARTITION BY dp_id, sample_no) AS pool,
  row_number() OVER (PARTITION BY dp_id, sample_no, is_key ORDER BY md5('42|d|' || dp_id || '|' || sample_no || '|' || table_name || '|' || col_name)) AS rn FROM lk, range(1, 4) r(sample_no)),
dropc AS (SELECT dp_id, db_id, sample_no, table_name, col_name FROM sm WHERE pool > 0 AND (is_key OR rn > CASE WHEN pool = 1 OR {u("'42|n|' || dp_id || '|' || sample_no")} < 0.7 THEN 1 ELSE 2 END))
"""
)


@check("T8_drop_column_negatives", DROP_COLUMN + "SELECT dp_id, db_id, sample_no, table_name, col_name FROM dropc")
def _(s):
    return synth.drop_column_negatives(s["i_links"], s["i_columns"], s["i_fks"])


DROP_TABLE = """
dt AS (SELECT dp_id, table_name AS dropped_table FROM (SELECT DISTINCT dp_id, table_name FROM i_links) QUALIFY count(*) OVER (PARTITION BY dp_id) > 1),
dropt AS (SELECT l.dp_id, l.db_id, dropped_table, l.table_name, l.col_name FROM i_links l JOIN dt ON l.dp_id = dt.dp_id WHERE l.table_name <> dropped_table
  AND NOT EXISTS (SELECT 1 FROM i_fks f WHERE f.db_id = l.db_id AND f.table_name = l.table_name AND f.col_name = l.col_name AND f.ref_table = dropped_table))
"""


@check("T9_drop_table_negatives", DROP_TABLE + "SELECT dp_id, db_id, dropped_table, table_name, col_name FROM dropt")
def _(s):
    return synth.drop_table_negatives(s["i_links"], s["i_columns"], s["i_fks"])


TRAIN = (
    "RECURSIVE "
    + DROP_COLUMN
    + ","
    + DROP_TABLE
    + ","
    + split_sql("i_dps", "db_id", 42, "0.02")
    + ","
    + LINEAR
    + """,
bad AS (SELECT dp_id, db_id, 'DELETE_COLUMN' AS mess_type, CAST(sample_no AS STRING) AS variant, table_name, col_name FROM dropc UNION ALL SELECT dp_id, db_id, 'DELETE_TABLE', dropped_table, table_name, col_name FROM dropt),
blin AS (SELECT dp_id, db_id, mess_type, variant, '```json' || chr(10) || '{' || chr(10) || string_agg('  "' || table_name || '": [' || chr(10) || cols || chr(10) || '  ]', ',' || chr(10) ORDER BY table_idx) || chr(10) || '}' || chr(10) || '```' AS rejected_text
  FROM (SELECT l.dp_id, l.db_id, mess_type, variant, l.table_name, min(c.table_idx) AS table_idx, string_agg('    "' || l.col_name || '"', ',' || chr(10) ORDER BY c.col_idx) AS cols
    FROM bad l JOIN i_columns c ON l.db_id = c.db_id AND l.table_name = c.table_name AND l.col_name = c.col_name GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4),
train AS (SELECT lin.dp_id, lin.db_id, 'SFT' AS train_type, CAST(NULL AS STRING) AS mess_type, CAST(NULL AS STRING) AS variant, linearized AS link_text, CAST(NULL AS STRING) AS rejected_text FROM lin JOIN split ON lin.db_id = split.g WHERE side = 'B'
  UNION ALL SELECT b.dp_id, b.db_id, 'DPO', mess_type, variant, linearized, rejected_text FROM blin b JOIN lin ON b.dp_id = lin.dp_id JOIN split ON b.db_id = split.g WHERE side = 'A')
"""
)


def train(s: Source):
    split = synth.group_split(s["i_dps"], "db_id")
    return synth.assemble_train(s["i_links"], split, s["i_columns"], s["i_fks"])


@check("T10_assemble_train", TRAIN + "SELECT dp_id, db_id, train_type, mess_type, variant, link_text, rejected_text FROM train")
def _(s):
    return train(s)


# ------------------------------------------------------------------ training rows
INPUTS["i_labelled"] = "SELECT d.doc_id, d.text AS prompt, CASE WHEN l.quality = 1 THEN 'True' ELSE 'False' END AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


@check("T11_classification_pairs", "SELECT doc_id, prompt AS the_input, '[Judgement]' || label AS the_output FROM i_labelled")
def _(s):
    return synth.classification_pairs(s["i_labelled"])


INPUTS["i_variants"] = """
SELECT o_orderkey AS dp_id, CASE WHEN o_custkey % 17 = 0 THEN '' ELSE 'schema ' || o_orderpriority END AS schema_text, CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE 'question ' || CAST(o_custkey AS STRING) END AS question,
  'SELECT ' || CAST(o_orderkey AS STRING) AS Normal, CASE o_orderstatus WHEN 'F' THEN '<|wrong SQL|>' WHEN 'O' THEN '' ELSE 'WITH q AS (SELECT 1) SELECT * FROM q' END AS CTE,
  CASE o_orderkey % 3 WHEN 0 THEN '<|unsuited|>' WHEN 1 THEN NULL ELSE 'SELECT * FROM (SELECT 1)' END AS Subquery FROM orders"""


@check(
    "T12_path_instances",
    """
l AS (SELECT dp_id, schema_text, question, 'Normal' AS reasoning_path, Normal AS q FROM i_variants UNION ALL SELECT dp_id, schema_text, question, 'CTE', CTE FROM i_variants UNION ALL SELECT dp_id, schema_text, question, 'Subquery', Subquery FROM i_variants)
SELECT dp_id, schema_text, question, reasoning_path, CASE WHEN q LIKE '<|%' THEN '[N/A]' ELSE q END AS query FROM l WHERE q <> '' AND schema_text <> '' AND question IS NOT NULL""",
)
def _(s):
    return synth.path_instances(s["i_variants"])


@check("T13_length_filter", r"SELECT doc_id, n_chars FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) + len(regexp_extract_all(source, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) <= 300")
def _(s):
    return synth.length_filter(s["documents"], F.col("text"), [F.col("source")], 300).select("doc_id", "n_chars")


@check(
    "T14_build_prompt",
    """SELECT conv_id, turn, 'user' AS first_role, 'Schema:' || chr(10) || text || chr(10) || 'Question: [' || upper(role) || '] {schema} ' || role || '!' AS user_text, 'assistant' AS second_role, '[SQL Query Answer]SELECT ' || turn AS answer_text FROM conversations""",
)
def _(s):
    question = F.concat(F.lit("{schema} "), F.col("role"))
    chat = prompts.build_prompt(
        "Schema:\n{schema}\nQuestion: {question}!",
        prompts.RESPONSE_MARKERS["sql"],
        F.concat(F.lit("SELECT "), F.col("turn").cast("string")),
        schema=F.col("text"),
        question=prompts.controlled(F.col("role"), question),
    )
    turns = s["conversations"].select("conv_id", "turn", chat.alias("m"))
    return turns.select(
        "conv_id", "turn", F.col("m")[0]["role"].alias("first_role"), F.col("m")[0]["content"].alias("user_text"), F.col("m")[1]["role"].alias("second_role"), F.col("m")[1]["content"].alias("answer_text")
    )


@check(
    "T15_preference_triples",
    TRAIN
    + r""",
q AS (SELECT t.*, 'Link ' || db_id || ' for ' || question AS prompt FROM train t JOIN i_dps USING (dp_id, db_id) WHERE rejected_text IS NOT NULL),
n AS (SELECT *, len(regexp_extract_all(prompt, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS np, len(regexp_extract_all(link_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS nc, len(regexp_extract_all(rejected_text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS nr FROM q)
SELECT dp_id, variant, mess_type, prompt, link_text AS chosen, rejected_text AS rejected FROM n WHERE np + nc < 60 AND np + nr < 60""",
)
def _(s):
    rows = train(s).join(s["i_dps"].select("dp_id", "question"), "dp_id")
    prompt = prompts.fill("Link {db} for {question}", db=F.col("db_id"), question=F.col("question"))
    return synth.preference_triples(rows, prompt, "link_text", "rejected_text", max_length=60)


INPUTS["i_selector"] = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Compare ' || props END AS instruction_content, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'said ' || event_type END AS output_content,
  'Old ' || props AS instruction, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type || ' wins  ' || chr(10) END AS analysis, CASE event_id % 4 WHEN 0 THEN ' sql1 ' WHEN 1 THEN 'SQL2' WHEN 2 THEN 'sql3' END AS final_choice FROM events"""


@check(
    "T16_normalize_selector",
    r"""SELECT event_id, instruction_content AS input_prompt, output_content AS output_label FROM i_selector WHERE event_id % 3 = 0 AND event_id % 6 <> 0
UNION ALL SELECT event_id, instruction, regexp_replace(analysis, '\s+$', '') || chr(10) || '\box{' || upper(trim(final_choice)) || '}' FROM i_selector WHERE NOT (event_id % 3 = 0 AND event_id % 6 <> 0) AND analysis <> '' AND event_id % 4 IN (0, 1)""",
)
def _(s):
    return pairs.require_rows(pairs.normalize_selector(s["i_selector"]), "no usable selector row")


@check("T17_seeded_shuffle", "SELECT conv_id, turn, role, md5('42|' || conv_id || '|' || turn) AS shuffle_key FROM conversations")
def _(s):
    return synth.seeded_shuffle(s["conversations"].select("conv_id", "turn", "role"), ["conv_id", "turn"])
