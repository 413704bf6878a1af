"""Checks of result-set operators and of the choice among candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import answers, sqltext
from querymill.functions.seeded import draw
from querymill.operators import execute, pairs, results, rounds, select
from querymill.registry.base import INPUTS, Source, check

# ------------------------------------------------------------------ keys of result sets, as SQL
DIGESTS = """
digests AS (
  SELECT dp_id, cand_id, md5(array_to_string(list_transform(cells, lambda c: coalesce(CAST(length(c) AS STRING) || ':' || c, 'N')), ',')) AS d FROM i_results),
"""
SUMS = """md5(concat_ws('|', CAST(count(*) AS STRING), CAST(sum(CAST(CAST('0x' || substr(d, 1, 15) AS BIGINT) AS HUGEINT)) AS STRING),
    CAST(sum(CAST(CAST('0x' || substr(d, 16, 15) AS BIGINT) AS HUGEINT)) AS STRING), CAST(sum(CAST('0x' || substr(d, 31, 2) AS BIGINT)) AS STRING)))"""
SET_KEYS = (
    DIGESTS
    + f"""
set_keys AS (
  SELECT e.*, coalesce(k.fingerprint, md5('0|0|0|0')) AS fingerprint, coalesce(k.n_rows, 0) AS n_rows
  FROM i_execs e LEFT JOIN (SELECT dp_id, cand_id, count(*) AS n_rows, {SUMS} AS fingerprint FROM (SELECT DISTINCT * FROM digests) GROUP BY 1, 2) k
    ON e.dp_id = k.dp_id AND e.cand_id = k.cand_id WHERE e.status = 'success')
"""
)


def _keyed(s: Source):
    return results.result_fingerprint(s["i_execs"], s["i_results"])


@check(
    "E1_clean_sql",
    r"""
t AS (SELECT doc_id, CASE WHEN instr(text, '[SQL Query Answer]') > 0 THEN substr(text, instr(text, '[SQL Query Answer]') + 18) ELSE text END AS x FROM i_generations),
u AS (SELECT doc_id, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM t),
v AS (SELECT doc_id, x, CASE WHEN regexp_matches(x, '(?s)```sql\s*(.*?)\s*```') THEN regexp_extract(x, '(?s)```sql\s*(.*?)\s*```', 1) ELSE x END AS y FROM u)
SELECT doc_id, CASE WHEN x = '[N/A]' THEN x ELSE trim(trim(regexp_replace(y, '\s+', ' ', 'g'), ' '), ';') END AS sql FROM v""",
)
def _(s):
    return s["i_generations"].select("doc_id", sqltext.clean_sql(F.col("text")).alias("sql"))


# one row per nation with one of four statement texts, two of them queries
INPUTS["i_statements"] = """
SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS dp_id, CAST(n_nationkey % 4 AS BIGINT) AS cand_id, n_nationkey % 4 = 0 AS is_gold, CASE n_nationkey % 4
  WHEN 0 THEN 'SELECT l_returnflag, count(*) FROM lineitem WHERE l_linestatus = ''' || l_linestatus || ''' GROUP BY l_returnflag;'
  WHEN 1 THEN 'SELECT no_such_column FROM lineitem'
  WHEN 2 THEN 'DROP TABLE lineitem'
  ELSE 'WITH w AS (SELECT p_type, max(p_size) m FROM part GROUP BY p_type) SELECT * FROM w ORDER BY m' END AS sql
FROM (SELECT n_nationkey, (SELECT max(l_linestatus) FROM lineitem) AS l_linestatus FROM nation) AS m"""


@check(
    "E2_run_candidates",
    """
SELECT dp_id, cand_id, status, n_rows, total FROM (
  SELECT dp_id, cand_id, CASE WHEN dp_id % 4 IN (1, 2) THEN 'error' ELSE 'success' END AS status,
    CASE dp_id % 4 WHEN 0 THEN (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_linestatus = (SELECT max(l_linestatus) FROM lineitem))
      WHEN 3 THEN (SELECT count(DISTINCT p_type) FROM part) ELSE 0 END AS n_rows,
    CAST(CASE dp_id % 4 WHEN 0 THEN (SELECT count(*) FROM lineitem WHERE l_linestatus = (SELECT max(l_linestatus) FROM lineitem))
      WHEN 3 THEN (SELECT sum(m) FROM (SELECT max(p_size) m FROM part GROUP BY p_type)) ELSE 0 END AS BIGINT) AS total
  FROM i_statements)""",
)
def _(s):
    for table in ("lineitem", "part"):
        s[table].createOrReplaceTempView(table)
    execs, rows = execute.run_candidates(s.spark, s["i_statements"])
    sums = rows.groupBy("stmt_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("cells")[1].cast("long")).alias("total"))
    return execs.join(sums, "stmt_id", "left").select(
        "dp_id", "cand_id", "status", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("total", F.lit(0)).alias("total")
    )


@check("E3_result_fingerprint", SET_KEYS + "SELECT dp_id, cand_id, n_rows, fingerprint FROM set_keys")
def _(s):
    return _keyed(s).select("dp_id", "cand_id", "n_rows", "fingerprint")


@check(
    "E4_results_equal_bag",
    """
bags AS (SELECT e.dp_id, e.cand_id, e.is_gold, coalesce(b.bag, '') AS bag FROM i_execs e LEFT JOIN
  (SELECT dp_id, cand_id, string_agg(r, chr(30) ORDER BY r) AS bag FROM (SELECT dp_id, cand_id, array_to_string(list_transform(cells, lambda c: coalesce(c, 'NULL')), ',') AS r FROM i_results) GROUP BY 1, 2) b
  ON e.dp_id = b.dp_id AND e.cand_id = b.cand_id WHERE e.status = 'success')
SELECT c.dp_id, c.cand_id, c.bag = g.bag AS equal_bag FROM bags c JOIN bags g ON c.dp_id = g.dp_id AND g.is_gold WHERE NOT c.is_gold""",
)
def _(s):
    return results.results_equal_bag(s["i_execs"], s["i_results"])


@check(
    "E5_results_equal_set",
    """
sets AS (SELECT e.dp_id, e.cand_id, e.is_gold, coalesce(b.rows, []) AS rows FROM i_execs e LEFT JOIN
  (SELECT dp_id, cand_id, list_sort(list(DISTINCT r)) AS rows FROM (SELECT dp_id, cand_id, coalesce(cells[1], 'NULL') || ',' || coalesce(CASE WHEN cand_id % 5 = 4 THEN 'text ' || cells[2] ELSE CAST(TRY_CAST(cells[2] AS DOUBLE) AS STRING) END, 'NULL') AS r FROM i_results) GROUP BY 1, 2) b
  ON e.dp_id = b.dp_id AND e.cand_id = b.cand_id WHERE e.status = 'success')
SELECT c.dp_id, c.cand_id, c.rows = g.rows AS equal_set FROM sets c JOIN sets g ON c.dp_id = g.dp_id AND g.is_gold WHERE NOT c.is_gold""",
)
def _(s):
    # some candidates return the number as text
    second = F.when(F.col("cand_id") % 5 == 4, "text").otherwise("number")
    return results.results_equal_set(s["i_execs"], s["i_results"].withColumn("types", F.array(F.lit("text"), second)))


@check(
    "E6_empty_or_all_null",
    """
SELECT e.dp_id, e.cand_id, count(c) = 0 AS no_result FROM i_execs e
LEFT JOIN (SELECT dp_id, cand_id, unnest(cells) AS c FROM i_results) r ON e.dp_id = r.dp_id AND e.cand_id = r.cand_id
WHERE e.status = 'success' GROUP BY 1, 2""",
)
def _(s):
    return results.empty_or_all_null(s["i_execs"], s["i_results"]).select("dp_id", "cand_id", "no_result")


BUCKETS = (
    SET_KEYS
    + """,
buckets AS (
  SELECT dp_id, fingerprint, canonical, min(cand_id) AS cand_id, arg_min(sql, cand_id) AS sql, count(*) AS n_cands FROM (
    SELECT *, replace(replace(replace(replace(regexp_replace(replace(trim(sql), '  ', ' '), '[ ;]+$', ''), 'select', 'SELECT'), 'from', 'FROM'), 'where', 'WHERE'), 'is null', 'IS NULL') || ';' AS canonical
    FROM set_keys WHERE NOT is_gold AND trim(sql) <> '')
  GROUP BY 1, 2, 3)
"""
)


@check("E7_bucketize", BUCKETS + "SELECT dp_id, fingerprint, canonical, cand_id, sql, n_cands FROM buckets")
def _(s):
    return results.bucketize(_keyed(s))


@check(
    "E8_split_buckets",
    BUCKETS
    + """,
g AS (SELECT dp_id, sql AS gold_sql, fingerprint AS gold FROM set_keys WHERE is_gold),
l AS (SELECT b.dp_id, b.fingerprint, b.cand_id, b.sql, b.fingerprint = g.gold AS is_correct FROM buckets b JOIN g ON b.dp_id = g.dp_id),
sides AS (SELECT dp_id, bool_or(is_correct) AS has_correct FROM l GROUP BY 1 HAVING bool_or(NOT is_correct))
SELECT l.dp_id, fingerprint, cand_id, sql, is_correct FROM l JOIN sides ON l.dp_id = sides.dp_id
UNION ALL SELECT g.dp_id, gold, NULL, gold_sql, true FROM g JOIN sides ON g.dp_id = sides.dp_id WHERE NOT has_correct""",
)
def _(s):
    gold = _keyed(s).filter("is_gold")
    return results.split_buckets(results.bucketize(_keyed(s)), gold)


INPUTS["i_variant_dps"] = """
SELECT c_custkey AS dp_id, CASE c_nationkey % 3 WHEN 0 THEN 'Normal' WHEN 1 THEN 'CTE' ELSE 'Subquery' END AS gold_path,
  'SELECT ''' || c_name || '''' AS gold_sql, c_acctbal >= 1000 AS gold_ok FROM customer"""


@check(
    "E9_validate_variants",
    """
a AS (SELECT *, coalesce(trim(sql), '') = '' AS blank FROM i_attempts WHERE attempt_no <= 2),
b AS (SELECT *, coalesce(bool_or(blank) OVER (PARTITION BY dp_id, path ORDER BY attempt_no), false) AS stopped FROM a),
h AS (SELECT dp_id, path, arg_min(sql, attempt_no) FILTER (WHERE is_equal AND NOT stopped) AS hit, coalesce(bool_or(attempt_no = 0 AND NOT blank), false) AS proposed FROM b GROUP BY 1, 2),
p AS (SELECT d.*, unnest(['Normal', 'CTE', 'Subquery']) AS path FROM i_variant_dps d)
SELECT p.dp_id, p.path, CASE WHEN NOT gold_ok THEN '<|wrong SQL|>' WHEN p.path = gold_path THEN gold_sql WHEN NOT coalesce(proposed, false) THEN '<|unsuited|>' WHEN hit IS NOT NULL THEN hit ELSE '<|wrong SQL|>' END AS sql
FROM p LEFT JOIN h ON p.dp_id = h.dp_id AND p.path = h.path""",
)
def _(s):
    return results.validate_variants(s["i_variant_dps"], s["i_attempts"])


@check(
    "E10_preview_result",
    """
n AS (SELECT dp_id, cand_id, count(*) AS n FROM i_results GROUP BY 1, 2),
t AS (SELECT dp_id, cand_id, row_no, '(' || array_to_string(list_transform(cells, lambda c: CASE WHEN c IS NULL THEN 'None' WHEN regexp_matches(c, '^[0-9.]+$') THEN c ELSE '''' || c || '''' END), ', ') || ')' AS r FROM i_results WHERE row_no < 5),
h AS (SELECT dp_id, cand_id, string_agg(CASE WHEN length(r) > 8 THEN substr(r, 1, 8) || '...' ELSE r END, chr(10) ORDER BY row_no) AS lines FROM t GROUP BY 1, 2)
SELECT e.dp_id, e.cand_id, CASE WHEN e.status <> 'success' THEN e.error WHEN n.n IS NULL THEN 'Execution result is empty.'
  ELSE 'Execution result contains ' || n.n || ' rows' || CASE WHEN n.n > 5 THEN ' (displaying the first 5 rows)' ELSE '' END || ':' || chr(10) || lines END AS preview
FROM i_execs e LEFT JOIN n ON e.dp_id = n.dp_id AND e.cand_id = n.cand_id LEFT JOIN h ON e.dp_id = h.dp_id AND e.cand_id = h.cand_id""",
)
def _(s):
    return results.preview_result(s["i_execs"], s["i_results"], n=5, width=8)


# ------------------------------------------------------------------ votes
VOTES = """
dps AS (SELECT DISTINCT dp_id FROM i_votes),
cand AS (SELECT * FROM i_votes WHERE NOT is_gold),
cnt AS (SELECT dp_id, fingerprint, count(*) AS votes FROM cand GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dp_id ORDER BY votes DESC, fingerprint) AS rk FROM cnt),
picked AS (SELECT *, row_number() OVER (PARTITION BY dp_id, fingerprint ORDER BY md5('42|' || dp_id || '|' || cand_id)) AS pk FROM cand),
choice AS (SELECT d.dp_id, r.fingerprint, coalesce(r.votes, 0) AS votes, p.cand_id, coalesce(p.sql, '@NO_SQL') AS sql FROM dps d LEFT JOIN ranked r ON d.dp_id = r.dp_id AND rk = 1
  LEFT JOIN picked p ON r.dp_id = p.dp_id AND r.fingerprint = p.fingerprint AND p.pk = 1)
""".replace("@NO_SQL", select.NO_SQL.replace("'", "''"))


def candidates(s: Source):
    return s["i_votes"].filter("not is_gold")


def vote(s: Source):
    return select.majority_vote(s["i_votes"].select("dp_id").distinct(), candidates(s))


@check("X1_majority_vote", VOTES + "SELECT dp_id, fingerprint, votes, cand_id, sql FROM choice")
def _(s):
    return vote(s)


@check(
    "X2_topk_hits",
    VOTES
    + """
SELECT g.dp_id, coalesce(rk <= 1, false) AS top1, coalesce(rk <= 2, false) AS top2, coalesce(rk <= 3, false) AS top3
FROM i_gold g LEFT JOIN ranked r ON g.dp_id = r.dp_id AND g.fingerprint = r.fingerprint""",
)
def _(s):
    return select.topk_hits(select.vote_counts(candidates(s)), s["i_gold"])


ACCURACY = (
    VOTES
    + """,
acc AS (SELECT c.dp_id, coalesce(c.fingerprint = g.fingerprint, false) AS execution_correct,
    EXISTS (SELECT 1 FROM i_votes v WHERE v.dp_id = c.dp_id AND NOT v.is_gold AND v.fingerprint = g.fingerprint) AS recalled
  FROM choice c JOIN i_gold g ON c.dp_id = g.dp_id)
"""
)


def accuracy(s: Source):
    return select.execution_accuracy(vote(s), s["i_votes"])


@check("X3_execution_accuracy", ACCURACY + "SELECT dp_id, execution_correct, recalled FROM acc")
def _(s):
    return accuracy(s)


@check(
    "X4_materialize_buckets",
    VOTES
    + """,
m AS (SELECT DISTINCT dp_id, fingerprint, sql FROM cand),
f AS (SELECT dp_id, fingerprint, min(sql) AS first_sql FROM m GROUP BY 1, 2)
SELECT m.dp_id, r.rk AS bucket_rank, r.votes, m.sql, m.sql = f.first_sql AS is_representative
FROM m JOIN ranked r ON m.dp_id = r.dp_id AND m.fingerprint = r.fingerprint JOIN f ON m.dp_id = f.dp_id AND m.fingerprint = f.fingerprint""",
)
def _(s):
    return select.materialize_buckets(candidates(s))


FALLBACK = """
hits AS (SELECT dp_id, min(round) AS solved FROM i_rounds WHERE valid GROUP BY 1),
used AS (SELECT r.dp_id, r.round, r.cand_id, r.valid FROM i_rounds r JOIN i_round_dps d ON r.dp_id = d.dp_id LEFT JOIN hits h ON r.dp_id = h.dp_id
  WHERE r.round = 0 OR (d.fallback_schema <> '' AND r.round <= coalesce(h.solved, 3)))
"""


def fallback(s: Source):
    table = s["i_rounds"]
    made = lambda n, open_dps: table.filter(F.col("round") == n).join(open_dps, "dp_id", "left_semi")
    return rounds.fallback_rounds(s["i_round_dps"], table.filter("round = 0"), made)


@check("X5_fallback_rounds", FALLBACK + "SELECT dp_id, round, cand_id, valid FROM used")
def _(s):
    return fallback(s)


@check(
    "X6_effective_schema",
    FALLBACK
    + """
SELECT d.dp_id, CASE WHEN EXISTS (SELECT 1 FROM used u WHERE u.dp_id = d.dp_id AND u.round > 0) THEN fallback_schema ELSE schema_text END AS schema_text FROM i_round_dps d""",
)
def _(s):
    return select.effective_schema(s["i_round_dps"], fallback(s))


@check(
    "X7_report",
    ACCURACY
    + """,
per AS (SELECT a.*, a.dp_id % 4 <> 0 AS gold_ok, coalesce(rk <= 1, false) AS top1, coalesce(rk <= 2, false) AS top2, coalesce(rk <= 3, false) AS top3
  FROM acc a JOIN i_gold g ON a.dp_id = g.dp_id LEFT JOIN ranked r ON g.dp_id = r.dp_id AND g.fingerprint = r.fingerprint)
SELECT count(*) AS total, round(100.0::double * count_if(execution_correct) / count(*), 6) AS ex_pct, round(100.0::double * count_if(recalled) / count(*), 6) AS recall_pct,
  CAST(count_if(gold_ok) AS BIGINT) AS gold_executable, round(100.0::double * count_if(top1 AND gold_ok) / count_if(gold_ok), 6) AS top1_pct,
  round(100.0::double * count_if(top2 AND gold_ok) / count_if(gold_ok), 6) AS top2_pct, round(100.0::double * count_if(top3 AND gold_ok) / count_if(gold_ok), 6) AS top3_pct FROM per""",
)
def _(s):
    hits = select.topk_hits(select.vote_counts(candidates(s)), s["i_gold"])
    return select.report(accuracy(s).join(hits, "dp_id").withColumn("gold_ok", F.col("dp_id") % 4 != 0))


INPUTS["i_history"] = "SELECT user_id AS series, event_id AS run_no, CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE round(value, 0) END AS score FROM events"


@check(
    "X8_best_run",
    """
h AS (SELECT series, run_no, score, max(score) OVER (PARTITION BY series ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM i_history)
SELECT series, run_no, CAST(score AS DOUBLE) AS score, CAST(greatest(score, coalesce(earlier, 0), 0) AS DOUBLE) AS best_score, earlier IS NULL OR score > earlier AS snapshot FROM h""",
)
def _(s):
    history = s["i_history"].withColumn("score", F.col("score").cast("double"))
    return select.best_run(history, ["series"], slice_runs=1000)


PAIRED = """
d AS (SELECT *, row_number() OVER (PARTITION BY dp_id, is_correct ORDER BY md5('42|' || dp_id || '|' || member_id)) AS rn FROM i_members),
k AS (SELECT g.dp_id, g.member_id AS gm, g.sql AS gs, b.member_id AS bm, b.sql AS bs, row_number() OVER (PARTITION BY g.dp_id ORDER BY g.rn) AS pair_no
  FROM d g JOIN d b ON g.dp_id = b.dp_id AND g.rn = b.rn AND g.is_correct AND NOT b.is_correct WHERE g.sql <> '' AND b.sql <> ''),
c AS (SELECT *, CAST('0x' || substr(md5('42-side|' || dp_id || '|' || pair_no), 1, 8) AS BIGINT) / 4294967296.0 < 0.5 AS first FROM k WHERE pair_no <= 3)
"""


@check(
    "X9_preference_pairs",
    PAIRED
    + """
SELECT dp_id, pair_no, CASE WHEN first THEN gs ELSE bs END AS sql1, CASE WHEN first THEN bs ELSE gs END AS sql2,
  CASE WHEN first THEN gm ELSE bm END AS member1, CASE WHEN first THEN bm ELSE gm END AS member2, CASE WHEN first THEN 'SQL1' ELSE 'SQL2' END AS winner FROM c""",
)
def _(s):
    return pairs.preference_pairs(s["i_members"])


@check(
    "X10_two_stage_accept",
    r"""
j AS (SELECT p.*, a.analysis AS a1, a.final_choice AS c1, b.analysis AS a2, b.final_choice AS c2 FROM i_pairs p JOIN i_answers a ON p.pair_id = a.pair_id AND a.stage = 1 LEFT JOIN i_answers b ON p.pair_id = b.pair_id AND b.stage = 2),
k AS (SELECT *, CASE WHEN lower(c1) = lower(winner) THEN 1 WHEN lower(c2) = lower(winner) THEN 2 END AS st FROM j)
SELECT pair_id, prompt, CAST(st AS BIGINT) AS star_stage, winner AS final_choice, CASE winner WHEN 'SQL1' THEN sql1 ELSE sql2 END AS chosen_sql, CASE winner WHEN 'SQL1' THEN sql2 ELSE sql1 END AS rejected_sql,
  regexp_replace(CASE st WHEN 1 THEN a1 ELSE a2 END, '\s+$', '') || chr(10) || '\box{' || winner || '}' AS output_content FROM k WHERE st IS NOT NULL""",
)
def _(s):
    return pairs.two_stage_accept(s["i_pairs"], s["i_answers"])


@check(
    "X11_tournament",
    r"""
RECURSIVE walk AS (
  SELECT 0 AS n, dp_id, cand_id, value, event_type AS result_key FROM i_votes WHERE NOT is_gold
  UNION ALL
  SELECT n, dp_id, win.cand_id, win.value, win.result_key FROM (
    SELECT n, dp_id, CASE WHEN cnt = 1 THEN a WHEN a.result_key = b.result_key THEN CASE WHEN coin < 0.5 THEN a ELSE b END
        WHEN a.value > b.value OR (a.value = b.value AND a.cand_id < b.cand_id) THEN a ELSE b END AS win
    FROM (SELECT n, dp_id, slot, count(*) AS cnt, min_by(c, rn) AS a, max_by(c, rn) AS b,
        CAST('0x' || substr(md5('42|' || n || '-coin|' || dp_id || '|' || slot), 1, 8) AS BIGINT) / 4294967296.0 AS coin
      FROM (SELECT n, dp_id, c, rn, (rn - 1) // 2 AS slot FROM (
          SELECT n + 1 AS n, dp_id, {'cand_id': cand_id, 'value': value, 'result_key': result_key} AS c,
            row_number() OVER (PARTITION BY dp_id ORDER BY md5('42|' || (n + 1) || '|' || dp_id || '|' || cand_id)) AS rn
          FROM walk WHERE n < 12))
      GROUP BY n, dp_id, slot)))
SELECT d.dp_id, cand_id, result_key FROM (SELECT DISTINCT dp_id FROM i_votes) d LEFT JOIN (SELECT * FROM walk WHERE n = (SELECT CAST(ceil(log2(max(c))) AS INT) FROM (SELECT count(*) AS c FROM i_votes WHERE NOT is_gold GROUP BY dp_id))) w ON d.dp_id = w.dp_id""",
)
def _(s):
    def judge(p):
        a, b = F.col("a"), F.col("b")
        first = (a["value"] > b["value"]) | ((a["value"] == b["value"]) & (a["cand_id"] < b["cand_id"]))
        return p.select("dp_id", "slot", F.when(first, F.lit("so \\box{SQL1}")).otherwise(F.lit("so \\box{SQL2}")).alias("answer"))

    votes = s["i_votes"]
    cands = candidates(s).select("dp_id", "cand_id", "sql", F.col("event_type").alias("result_key"), "value")
    return rounds.tournament(votes.select("dp_id").distinct(), cands, judge).select("dp_id", "cand_id", "result_key")


INPUTS["i_choices"] = """
SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' ' || chr(92) || 'box{SQL1}' WHEN 1 THEN ' ' || chr(92) || 'box{SQL2}'
  WHEN 2 THEN ' ' || chr(92) || 'box{SQL1} or ' || chr(92) || 'box{SQL2}, TRUE' ELSE ' True' END AS text FROM documents"""


@check(
    "X12_parse_boxed_choice",
    r"""
c AS (SELECT doc_id, contains(text, '\box{SQL1}') AS one, contains(text, '\box{SQL2}') AS two, CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM i_choices)
SELECT doc_id, CASE WHEN one AND NOT two THEN 'SQL1' WHEN two AND NOT one THEN 'SQL2' WHEN u < 0.5 THEN 'SQL1' ELSE 'SQL2' END AS choice FROM c""",
)
def _(s):
    return s["i_choices"].select("doc_id", answers.parse_boxed_choice(F.col("text"), draw(42, "doc_id")).alias("choice"))


@check("X13_parse_boolean", "SELECT doc_id, contains(lower(text), 'true') AS useful FROM i_choices")
def _(s):
    return s["i_choices"].select("doc_id", answers.parse_boolean(F.col("text")).alias("useful"))
