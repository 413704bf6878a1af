"""What keeps the work of queries whole, and in proportion to their input."""

import hashlib
import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from querymill import session
from querymill.operators import links, rounds, workload
from querymill.registry.base import QUERIES, Source

FOLDER = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["T1_noise_tables", "T2_noise_fk_bridge", "T3_noise_columns", "T4_column_samples", "X16_columns_to_judge", "R1_filter_chosen", "L3_link_columns", "T8_drop_column_negatives", "T9_drop_table_negatives"])
def test_arrays_are_not_made_again_in_a_join(spark, name):
    """A join or a filter below an explode must not hold the lambdas that make the exploded array."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.split("\n")]
    assert not [line[:200] for line in lines if line.startswith(("Join", "Filter")) and "lambdafunction" in line]


def test_foreign_keys_of_every_database(spark):
    got = QUERIES["P8_resolve_foreign_keys"](spark, SMALL).select("db_id").distinct()
    assert got.filter(F.col("db_id").like("%9")).count() > 0


def played(dp, cands, seed=42):
    """Knock-out of (id, result) by plain loops: a new order by md5 in every round, the larger id wins."""
    digest = lambda *parts: hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    n = 0
    while len(cands) > 1:
        n += 1
        order = sorted(cands, key=lambda c: (digest(seed, n, dp, c[0]), c[0]))
        cands = []
        for slot in range(0, len(order), 2):
            a, b = order[slot], order[min(slot + 1, len(order) - 1)]
            if a[1] == b[1]:
                cands.append(a if int(digest(f"{seed}|{n}-coin", dp, slot // 2)[:8], 16) / 4294967296 < 0.5 else b)
            else:
                cands.append(max(a, b))
    return cands[0][0]


@pytest.mark.parametrize("one_task", [65_536, 4])
def test_tournament_shuffles_every_round(spark, monkeypatch, one_task):
    monkeypatch.setattr(rounds, "ONE_TASK", one_task)
    entrants = {dp: [(i, f"r{i * 7 % 3}") for i in range(5 + dp)] for dp in range(30)}
    rows = [(dp, i, f"SELECT {i}", r) for dp, cands in entrants.items() for i, r in cands]

    def judge(p):
        return p.select("dp_id", "slot", F.when(F.col("a")["cand_id"] > F.col("b")["cand_id"], "\\box{SQL1}").otherwise("\\box{SQL2}").alias("answer"))

    got = rounds.tournament(spark.range(30).withColumnRenamed("id", "dp_id"), spark.createDataFrame(rows, "dp_id long, cand_id long, sql string, result_key string"), judge)
    assert {r.dp_id: r.cand_id for r in got.collect()} == {dp: played(dp, cands) for dp, cands in entrants.items()}


def test_rejected_texts_are_not_made_again_by_filters(spark):
    plan = QUERIES["T15_preference_triples"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    lines = [line.lstrip(" :+-") for line in plan.split("\n")]
    assert not [line[:200] for line in lines if line.startswith(("Join", "Filter")) and "json" in line]


def test_statements_are_read_once_for_kept_and_rejected(spark):
    plan = QUERIES["L4_validate_link"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_shared_inputs_are_made_once(spark):
    s = Source(spark, FOLDER)
    fks, columns = s["i_fks"].collect(), s["i_columns"].collect()
    s.shared("i_columns")
    assert not any("lineitem" in f for name in ("i_columns", "i_fks", "i_defs") for f in s[name].inputFiles())
    assert sorted(s["i_fks"].collect()) == sorted(fks) and sorted(s["i_columns"].collect()) == sorted(columns)


def scans(df, column="l_orderkey"):
    """Reads of the table with this column in the optimized plan."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return sum("Relation [" in line and f"{column}#" in line for line in lines)


def test_linked_columns_are_chosen_as_rows(spark):
    """R1: no datapoint is compared with the columns it has not linked, and links are read once."""
    df = QUERIES["R1_filter_chosen"](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and scans(df) == 0


def test_chosen_columns_of_odd_links(spark):
    columns = spark.createDataFrame([("d", t, c) for t in ("A", "a", "B") for c in ("X", "y")], "db_id string, table_name string, col_name string")
    link = spark.createDataFrame([(1, "d", "a", "x"), (1, "d", "A", "X"), (1, "d", None, "x"), (2, "d", "b", None), (4, "d", "B", "Y")], "dp_id long, db_id string, table_name string, col_name string")
    dps = spark.createDataFrame([(1, "d"), (2, "d"), (3, "d"), (3, "none")], "dp_id long, db_id string")
    got = sorted((r.dp_id, r.table_name, r.col_name) for r in links.filter_chosen(dps, columns, link).collect())
    assert got == [(1, "A", "X"), (1, "a", "X"), *((3, t, c) for t in ("A", "B", "a") for c in ("X", "y"))]


def small_catalog(spark):
    """Links, columns, foreign keys and datapoints that the planner knows to be small."""
    ids = spark.range(4)
    columns = ids.selectExpr("concat('d', id % 1) AS db_id", "0L AS table_idx", "'T' AS table_name", "id AS col_idx", "concat('C', id) AS col_name", "id = 0 AS is_pk")
    fks = ids.filter("id = 1").selectExpr("concat('d', id % 1) AS db_id", "'T' AS table_name", "0L AS fk_no", "'C1' AS col_name", "'T' AS ref_table", "'C0' AS ref_column")
    link = ids.filter("id = 2").selectExpr("id AS dp_id", "concat('d', id % 1) AS db_id", "'t' AS table_name", "'c2' AS col_name")
    return link, columns, fks, ids.selectExpr("id AS dp_id", "concat('d', id % 1) AS db_id").filter("dp_id IN (2, 3)")


def test_chosen_columns_do_not_pass_through_the_driver(spark):
    """R1: neither a catalog's columns nor its schemas are broadcast, however small the planner takes them to be."""
    link, columns, _, dps = small_catalog(spark)
    df = links.filter_chosen(dps, columns, link)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    assert sorted((r.dp_id, r.table_name, r.col_name) for r in df.collect()) == [(2, "T", "C2"), *((3, "T", f"C{i}") for i in range(4))]


def test_closing_a_link_sends_no_catalog_through_the_driver(spark):
    """R2: neither a catalog's columns nor its foreign keys are broadcast."""
    link, columns, fks, dps = small_catalog(spark)
    df = links.close_link(link, columns, fks, dps=dps)
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert sum("rightHint=(strategy=merge)" in line for line in joins) == 2
    assert sorted((r.dp_id, r.col_name) for r in df.collect()) == [(2, "C0"), (2, "C1"), (2, "C2"), *((3, f"C{i}") for i in range(4))]


def test_a_link_is_gathered_once_to_be_closed(spark):
    """R2: one gathering of the links, and no comparison of linked keys with the columns of a schema."""
    plan = QUERIES["R2_close_link"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_set(") == 1 and "startswith" not in plan.lower()


def test_gathered_links_are_one_set(spark):
    """R4: keys and tables of a link are made from it, not gathered beside it."""
    rows = [(1, "d", "A", "x"), (1, "d", "a", "X"), (1, "d", "B", "y"), (1, "d", None, "z")]
    df = links.nest_links(spark.createDataFrame(rows, "dp_id long, db_id string, table_name string, col_name string"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("collect_set(") == 1
    got = df.first()
    assert len(got.link) == 4 and sorted(got.chosen) == ["a", "b"] and sorted(got.linked) == sorted([f"a{links.SEPARATOR}x", f"b{links.SEPARATOR}y", "z"])


def test_a_link_is_put_in_order_without_its_schema(spark):
    """L5: no row holds a database's schema."""
    df = QUERIES["L5_linearize_link"](spark, FOLDER)
    assert "is_pk" not in df._jdf.queryExecution().optimizedPlan().toString() and scans(df) == 2


@pytest.mark.parametrize("name", ["T1_noise_tables", "T3_noise_columns"])
def test_noise_reads_line_items_once_beside_the_staged_columns(spark, name):
    """T1, T3: only the links are made from line items in the query itself."""
    assert scans(QUERIES[name](spark, FOLDER)) == 1


def test_schema_input_reads_staged_inputs_and_shuffles_no_schema_per_question(spark):
    """R5: a question meets the parts of its schema in the last join, after its own notes."""
    df = QUERIES["R5_schema_input"](spark, FOLDER)
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert scans(df) == 0 and "dp_id" not in joins[0] and "dp_id" in joins[1]


def test_staging_leaves_no_shuffle_files(spark):
    """What a staged table has shuffled is gone with its job, and the session's setting is as it was."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b for b in manager.getAllBlocks().mkString("|").split("|") if b.startswith("shuffle_")}
    before = shuffled()
    for kept in (None, "false"):
        if kept:
            spark.conf.set(session.CLEANUP_KEY, kept)
        staged = session.cut_lineage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
        assert spark.conf.get(session.CLEANUP_KEY, None) == kept
        until = time.monotonic() + 20
        while shuffled() - before and time.monotonic() < until:
            time.sleep(0.1)
        assert not shuffled() - before and staged.count() == 10
        before = shuffled()
    spark.conf.unset(session.CLEANUP_KEY)


def test_schema_input_of_links_reads_line_items_once(spark):
    """R5 with a link: columns, questions, retrieved values and static examples are staged."""
    assert scans(QUERIES["R5_schema_input_of_link"](spark, FOLDER)) == 0


def test_statements_are_read_outside_column_expressions(spark):
    """L3: no fold over tokens is left to lambdas, and questions are made once."""
    df = QUERIES["L3_link_columns"](spark, FOLDER)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "MapInArrow" in plan and scans(df) == 1


def test_names_of_a_database_are_read_once_for_its_statements(monkeypatch):
    """L3: also when databases take turns; equal results with and without names at hand."""
    loaded, loads = [], json.loads
    monkeypatch.setattr(workload.json, "loads", lambda text: loaded.append(text) or loads(text))
    names = ['{"a":["x"]}', '{"b":["x"]}']
    tokens = [["select", "x", "from", "a", ",", "b"], None, []]
    columns = [list(range(6)), [f"d{i % 2}" for i in range(6)], [tokens[i % 3] for i in range(6)], [names[i % 2] for i in range(6)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dp_id", "db_id", "w", "names"])
    hits = lambda: sorted((tuple(r.values()) for b in workload._touching(iter([batch, batch.slice(3)])) for r in b.to_pylist()), key=str)
    got = hits()
    assert len(loaded) == 2
    assert set(got) == {(0, "d0", "a", None, True), (0, "d0", "a", "x", True), (3, "d1", "b", None, True), (3, "d1", "b", "x", True)} and len(got) == 6
    monkeypatch.setattr(workload, "KEPT_CHARS", 1)
    assert hits() == got
