"""Edge rows of result sets, votes, pairs and rounds."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from querymill.operators import execute, pairs, ranking, results, rounds, select

EXECS = "dp_id long, cand_id long, is_gold boolean, status string, error string, sql string"
ROWS = "dp_id long, cand_id long, row_no long, cells array<string>"


def frames(spark, sets):
    """One datapoint, candidate i with the rows sets[i]; candidate 0 is gold."""
    execs = spark.createDataFrame([(1, i, i == 0, "success", None, f"SELECT {i}") for i in range(len(sets))], EXECS)
    rows = [(1, i, n * 10, list(r)) for i, s in enumerate(sets) for n, r in enumerate(s)]
    return execs, spark.createDataFrame(rows, ROWS)


def keys(df):
    return {r.cand_id: r.fingerprint for r in df.collect()}


def test_set_key_ignores_order_and_repeats_but_not_null_text(spark):
    execs, rows = frames(spark, [[("a", "1"), ("b", "2")], [("b", "2"), ("a", "1"), ("a", "1")], [("a", None)], [("a", "None")], [], [("a1", "")], [("a", "1")]])
    k = keys(results.result_fingerprint(execs, rows))
    assert k[0] == k[1]
    assert len({k[i] for i in (0, 2, 3, 4, 5, 6)}) == 6


def test_bag_counts_repeats(spark):
    execs, rows = frames(spark, [[("a",), ("a",)], [("a",)], [("a",), ("a",)]])
    equal = {r.cand_id: r.equal_bag for r in results.results_equal_bag(execs, rows).collect()}
    assert equal == {1: False, 2: True}


def test_value_equality_of_numbers(spark):
    execs, rows = frames(spark, [[("1", "x")], [("1.0", "x")], [("01", "x")], [("1.5", "x")], [("1e0", "x")], [("9007199254740993", "x")], [("9007199254740992", "x")]])
    equal = {r.cand_id: r.equal_set for r in results.results_equal_set(execs, rows).collect()}
    assert equal == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}
    k = keys(results.value_fingerprint(execs, rows))
    assert k[5] != k[6]


def test_text_is_no_number_where_types_are_known(spark):
    execs = spark.createDataFrame([(1, c, "s", "success", c == 0) for c in range(3)], "dp_id long, cand_id long, sql string, status string, is_gold boolean")
    rows = [(1, 0, 0, ["1", None], ["number", "text"]), (1, 1, 0, ["1", None], ["text", "text"]), (1, 2, 0, ["1.0", None], ["number", None])]
    found = spark.createDataFrame(rows, "dp_id long, cand_id long, row_no long, cells array<string>, types array<string>")
    assert {r.cand_id: r.equal_set for r in results.results_equal_set(execs, found).collect()} == {1: False, 2: True}
    assert {r.cand_id: r.equal_set for r in results.results_equal_set(execs, found.drop("types")).collect()} == {1: True, 2: True}


def test_failed_gold_leaves_nothing_to_compare(spark):
    execs, rows = frames(spark, [[("a",)], [("a",)]])
    failed = execs.withColumn("status", F.when(F.col("is_gold"), "error").otherwise("success"))
    assert results.results_equal_set(failed, rows).count() == 0


def test_empty_or_all_null(spark):
    execs, rows = frames(spark, [[], [(None, None)], [(None, "0")]])
    got = {r.cand_id: r.no_result for r in results.empty_or_all_null(execs, rows).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_row_limit_counts_returned_rows(spark):
    execs, rows = frames(spark, [[("g",)], [("a",)] * 5, [("a",)] * 3])
    buckets = results.bucketize(results.result_fingerprint(execs, rows), max_rows=5).collect()
    assert [b.cand_id for b in buckets] == [2]


def test_gold_stands_in_for_a_missing_correct_bucket(spark):
    execs, rows = frames(spark, [[("g",)], [("a",)], [("b",)]])
    keyed = results.result_fingerprint(execs, rows)
    got = {(r.cand_id, r.sql, r.is_correct) for r in results.split_buckets(results.bucketize(keyed), keyed.filter("is_gold")).collect()}
    assert got == {(1, "SELECT 1", False), (2, "SELECT 2", False), (None, "SELECT 0", True)}


def test_preview(spark):
    execs, rows = frames(spark, [[("x" * 600,)], [(str(i), None) for i in range(7)], []])
    got = {r.cand_id: r.preview for r in results.preview_result(execs, rows).collect()}
    assert got[0] == "Execution result contains 1 rows:\n('" + "x" * 510 + "..."
    assert got[1].startswith("Execution result contains 7 rows (displaying the first 5 rows):\n(0, None)\n(1, None)")
    assert got[1].count("\n") == 5
    assert got[2] == "Execution result is empty."


def test_preview_spells_cells(spark):
    """Text is quoted as a row of text prints, numbers are bare; kinds of cells decide where they are known."""
    execs, rows = frames(spark, [[("it's", "a\"b'c", "x\\y\n")], [("1",), ("1.5",), ("1.0E16",), ("",)]])
    said = lambda df: {r.cand_id: r.preview.split("\n", 1)[1] for r in results.preview_result(execs, df).collect()}
    plain = said(rows)
    assert plain[0] == str(("it's", "a\"b'c", "x\\y\n"))
    assert plain[1] == "(1,)\n(1.5,)\n(1.0E16,)\n('',)"
    typed = said(rows.withColumn("types", F.transform("cells", lambda c: F.lit("text"))))
    assert typed[1] == "\n".join(str((x,)) for x in ("1", "1.5", "1.0E16", ""))


def test_group_rank_splits_hot_groups_exactly(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("g"), "id", F.md5(F.col("id").cast("string")).alias("h"))
    want = df.withColumn("rn", F.row_number().over(W.partitionBy("g").orderBy("h", "id")).cast("long"))
    got = ranking.group_rank(df, ["g"], "h", ["id"])
    assert got.select("g", "id", "rn").exceptAll(want.select("g", "id", "rn")).isEmpty()
    assert got.count() == 5000


def test_first_distinct_in_slices(spark):
    df = spark.range(9000).select(F.lit("c").alias("k"), F.format_string("%05d", F.col("id") % 3000).alias("v")).union(spark.createDataFrame([("c", None)], "k string, v string"))
    got = ranking.first_distinct(df, ["k"], "v", 1500).collect()
    assert sorted((r.rn, r.v) for r in got) == [(1, None)] + [(i + 2, f"{i:05d}") for i in range(1499)]


def test_best_run_in_slices(spark):
    history = spark.createDataFrame([("a", i, float(s)) for i, s in enumerate([0, 0, 3, 3, 2, 5, 1, 6, 6])], "series string, run_no long, score double")
    got = sorted((r.run_no, r.best_score, r.snapshot) for r in select.best_run(history, ["series"], slice_runs=2).collect())
    assert [g[1] for g in got] == [0, 0, 3, 3, 3, 5, 5, 6, 6]
    assert [g[0] for g in got if g[2]] == [0, 2, 5, 7]


def test_vote_without_candidates(spark):
    dps = spark.createDataFrame([(1,), (2,)], "dp_id long")
    keyed = spark.createDataFrame([(1, 5, "SELECT 5", "f")], "dp_id long, cand_id long, sql string, fingerprint string")
    got = {r.dp_id: (r.cand_id, r.sql) for r in select.majority_vote(dps, keyed).collect()}
    assert got == {1: (5, "SELECT 5"), 2: (None, select.NO_SQL)}


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "dp_id long, execution_correct boolean, recalled boolean, gold_ok boolean, top1 boolean, top2 boolean, top3 boolean")
    row = select.report(empty).first()
    assert (row.total, row.ex_pct, row.top1_pct) == (0, 0.0, 0.0)


def test_pairs_use_every_member_once(spark):
    rows = [(dp, i, "" if i % 5 == 0 else f"SELECT {i}", i % 3 == 0) for dp in (1, 2) for i in range(40)]
    got = pairs.preference_pairs(spark.createDataFrame(rows, "dp_id long, member_id long, sql string, is_correct boolean")).collect()
    assert len(got) == 6
    for dp in (1, 2):
        used = [m for r in got if r.dp_id == dp for m in (r.member1, r.member2)]
        assert len(used) == len(set(used)) == 6
    for r in got:
        good = r.member1 if r.winner == "SQL1" else r.member2
        assert good % 3 == 0 and r.sql1 and r.sql2


def test_selector_rows_are_required(spark):
    empty = spark.createDataFrame([], "id long, instruction_content string, output_content string, instruction string, analysis string, final_choice string")
    with pytest.raises(ValueError):
        pairs.require_rows(pairs.normalize_selector(empty), "no usable selector row")


def highest(p):
    first = F.col("a")["cand_id"] > F.col("b")["cand_id"]
    return p.select("dp_id", "slot", F.when(first, F.lit("\\box{SQL1}")).otherwise(F.lit("\\box{SQL2}")).alias("answer"))


def test_tournament_sizes(spark):
    dps = spark.range(0, 7).withColumnRenamed("id", "dp_id")
    rows = [(n, i, f"SELECT {i}", f"r{i}") for n in range(1, 7) for i in range(n)]
    cands = spark.createDataFrame(rows, "dp_id long, cand_id long, sql string, result_key string")
    got = {r.dp_id: (r.cand_id, r.sql) for r in rounds.tournament(dps, cands, highest).collect()}
    assert got.pop(0) == (None, rounds.NO_CANDIDATE)
    assert got == {n: (n - 1, f"SELECT {n - 1}") for n in range(1, 7)}


def test_equal_results_skip_the_judge(spark):
    seen = []

    def judge(p):
        seen.append(p.count())
        return highest(p)

    cands = spark.createDataFrame([(1, i, f"SELECT {i}", "same") for i in range(5)], "dp_id long, cand_id long, sql string, result_key string")
    got = rounds.tournament(spark.range(1, 2).withColumnRenamed("id", "dp_id"), cands, judge).collect()
    assert seen == [0, 0, 0] and got[0].cand_id in range(5)


def test_fallback_stops_when_solved(spark):
    asked = []
    dps = spark.createDataFrame([(1, "s"), (2, "s"), (3, "")], "dp_id long, fallback_schema string")
    first = spark.createDataFrame([(1, 10, False), (3, 30, False)], "dp_id long, cand_id long, valid boolean")

    def again(n, open_dps):
        asked.append((n, sorted(r.dp_id for r in open_dps.collect())))
        return open_dps.select("dp_id", (F.col("dp_id") * 10 + n).alias("cand_id"), (F.col("dp_id") <= n).alias("valid"))

    got = sorted((r.dp_id, r.round) for r in rounds.fallback_rounds(dps, first, again).collect())
    assert asked == [(1, [1, 2]), (2, [2])]
    assert got == [(1, 0), (1, 1), (2, 1), (2, 2), (3, 0)]


def test_run_candidates_is_read_only_and_limited(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    texts = [
        "SELECT id FROM numbers WHERE id < 3;",
        "select id from numbers where id < 3",
        "WITH w AS (SELECT 1 AS a) SELECT * FROM w",
        "DROP VIEW numbers",
        "SELECT 1) AS x; DROP VIEW numbers; SELECT * FROM (SELECT 1",
        "  ",
        None,
        "SELECT id, id FROM numbers LIMIT 0",
        "SELECT assert_true(id < 3) FROM numbers",
    ]
    execs = spark.createDataFrame([(1, i, t, i == 0) for i, t in enumerate(texts)], "dp_id long, cand_id long, sql string, is_gold boolean")
    done, rows = execute.run_candidates(spark, execs)
    status = {r.cand_id: r.status for r in done.collect()}
    assert [status[i] for i in range(9)] == ["success"] * 3 + ["error"] * 4 + ["success", "error"]
    k = keys(results.result_fingerprint(done, rows, keys=["stmt_id"]))
    assert k[0] == k[1] != k[2]
    assert spark.table("numbers").count() == 10


def test_run_candidates_time_limit(spark):
    slow = "SELECT count(*) FROM range(400000000) a WHERE md5(cast(id AS string)) = 'x'"
    execs = spark.createDataFrame([(1, 0, slow, True)], "dp_id long, cand_id long, sql string, is_gold boolean")
    done, _ = execute.run_candidates(spark, execs, time_limit=3)
    row = done.first()
    assert (row.status, row.error) == ("error", "Query timed out after 3 seconds.")


def test_separators_and_long_numbers_do_not_collide(spark):
    df = spark.createDataFrame([(["a\x1fb", "c"],), (["a", "b\x1fc"],), ([None, "c"],), (["N", "c"],), (["1:a", ""],), (["1", ":a"],)], "cells array<string>")
    assert df.select(results.row_digest(F.col("cells"))).distinct().count() == 6
    one, two = "9" * 40 + "1", "9" * 40 + "2"
    got = [r[0] for r in spark.createDataFrame([(one,), ("+00" + one + ".0",), (two,), ("-0.0",), ("1.0",)], "c string").select(results.numeric_cell(F.col("c"))).collect()]
    assert got == [one, one, two, "0", "1"]
