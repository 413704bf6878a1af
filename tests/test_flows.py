"""End-to-end flows over small databases."""

import pytest
from pyspark.sql import functions as F

from querymill.operators import links, render, retrieval
from querymill.plans import evaluation, linking, preparation, training

CATALOG = (
    "db_id string, table_names array<string>, table_names_original array<string>, column_names array<struct<table_idx:int,name:string>>, "
    "column_names_original array<struct<table_idx:int,name:string>>, foreign_keys array<struct<from_idx:int,to_idx:int>>"
)


@pytest.fixture(scope="module")
def pets(spark):
    names = [(-1, "*"), (0, "oid"), (0, "full_name"), (1, "pid"), (1, "oid"), (1, "kind")]
    shown = [(-1, "*"), (0, "owner id"), (0, "full name"), (1, "pid"), (1, "oid"), (1, "sort of pet")]
    raw = spark.createDataFrame([("pets", ["owners", "animals"], ["owners", "pets"], shown, names, [(4, 1), (77, 1)])], CATALOG)
    types = [("owners", "oid", "int", True), ("owners", "full_name", "varchar(20)", False), ("pets", "pid", "int", True), ("pets", "oid", "int", False), ("pets", "kind", "text", False)]
    declared = spark.createDataFrame([("pets", *t) for t in types], "db_id string, table_name string, col_name string, declared_type string, is_pk boolean")
    spark.createDataFrame([(1, "Ann Lee"), (2, "Bo")], "oid int, full_name string").createOrReplaceTempView("owners")
    spark.createDataFrame([(1, 1, "cat"), (2, 1, "dog"), (3, 2, "cat"), (4, None, None)], "pid int, oid int, kind string").createOrReplaceTempView("pets")
    return raw, declared


def test_preparation(spark, pets):
    raw, declared = pets
    parts = [preparation.profile_table(spark.table(t), "pets", t) for t in ("owners", "pets")]
    nulls, examples = parts[0][0].unionByName(parts[1][0]), parts[0][1].unionByName(parts[1][1])
    columns = preparation.describe_columns(raw, declared, nulls, null_note=True)
    fks = preparation.foreign_keys(raw)
    values = preparation.indexable_values(spark.table("pets"), columns, "pets", "pets")
    assert sorted(r.value for r in values.collect()) == ["cat", "dog"]
    vectors = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.0, 1.0])], "value string, embedding array<float>")
    asks = spark.createDataFrame([(7, "pets", [0.1, 0.9])], "dp_id long, db_id string, embedding array<float>")
    near = retrieval.nearest_values(asks, retrieval.build_value_index(values, vectors))
    text = render.schema_input(asks.drop("embedding"), columns, fks, preparation.example_lists(examples), near).first().schema_text
    assert text == (
        "-- Database name: pets\n-- Database schema:\n"
        'CREATE TABLE "owners" (\n    "oid" INTEGER, -- Column Meaning: owner id | Contains NULL: False | Value Examples: [1, 2]\n'
        "    \"full_name\" TEXT, -- Contains NULL: False | Value Examples: ['Ann Lee', 'Bo']\n    PRIMARY KEY (\"oid\")\n);\n"
        'CREATE TABLE "pets" ( -- Table Description: animals\n    "pid" INTEGER, -- Contains NULL: False | Value Examples: [1, 2, 3, 4]\n'
        '    "oid" INTEGER, -- Contains NULL: True | Value Examples: [1, 2]\n'
        "    \"kind\" TEXT, -- Column Meaning: sort of pet | Contains NULL: True | Value Examples: ['dog', 'cat']\n"
        '    PRIMARY KEY ("pid"),\n    FOREIGN KEY ("oid") REFERENCES owners("oid")\n);\n'
    )


def test_linking(spark, pets):
    raw, declared = pets
    nulls = declared.select("db_id", "table_name", "col_name", F.lit(False).alias("contains_null"))
    columns, fks = preparation.describe_columns(raw, declared, nulls), preparation.foreign_keys(raw)
    dps = spark.createDataFrame([(i, "pets" if i < 4 else "gone") for i in range(5)], "dp_id long, db_id string")
    texts = ['{"PETS": ["pid"]}', '{"owners": "oid"}', "{}", '{"pets": []}', '{"pets": ["pid"]}']
    answers = spark.createDataFrame([(i, "pets" if i < 4 else "gone", t) for i, t in enumerate(texts) if i != 3], "dp_id long, db_id string, text string")
    static = spark.createDataFrame([("pets", "pets", "kind", ["cat"])], "db_id string, table_name string, col_name string, examples array<string>")
    found = spark.createDataFrame([(0, "pets", "kind", 1, "dog")], "dp_id long, table_name string, col_name string, rn long, value string")
    closed = linking.answered_links(dps, answers, columns, fks)
    asked = links.columns_to_judge(closed.filter("dp_id = 0"), columns, fks)
    assert [r.col_name for r in asked.collect()] == ["kind"]
    got = {r.dp_id: r.schema_text for r in linking.linked_schemas(dps, answers, asked.withColumn("useful", F.lit(True)), columns, fks, static, found).collect()}
    assert got[0] == (
        '-- Database name: pets\n-- Database schema:\nCREATE TABLE "pets" ( -- Table Description: animals\n    "pid" INTEGER,\n'
        "    \"kind\" TEXT, -- Column Meaning: sort of pet | Value Examples: ['dog', 'cat']\n    PRIMARY KEY (\"pid\")\n);\n"
    )
    assert got[1] == "" and got[4] == ""
    assert '"owners"' in got[2] and '"pets"' in got[2]


def test_training(spark, pets):
    raw, declared = pets
    nulls = declared.select("db_id", "table_name", "col_name", F.lit(False).alias("contains_null"))
    columns, fks = preparation.describe_columns(raw, declared, nulls), preparation.foreign_keys(raw)
    sqls = [
        "select o.full_name from owners o join pets p on o.oid = p.oid where p.kind = 'cat'",
        "select kind from pets",
        "select p.nothing from pets p",
        "select owners.oid from owners join pets",
    ]
    work = spark.createDataFrame([(i, "pets", f"q{i}", " because ", s) for i, s in enumerate(sqls)], "dp_id long, db_id string, question string, evidence string, sql string")
    sets = training.training_sets(work, columns, fks, ratio=1.0, tol=0.0)
    assert sorted(r.dp_id for r in sets.datapoints.collect()) == [0, 1]
    assert [r.dp_id for r in sets.rejected.collect()] == [2]
    row = sets.datapoints.filter("dp_id = 1").first()
    assert row.link_text == '```json\n{\n  "pets": [\n    "pid",\n    "kind"\n  ]\n}\n```'
    assert (row.sql, row.question) == ("SELECT kind FROM pets;", "q1\n(hint: because)")
    kinds = {(r.dp_id, r.mess_type) for r in sets.train.collect()}
    assert kinds == {(0, "DELETE_COLUMN"), (0, "DELETE_TABLE"), (1, "DELETE_COLUMN")}
    assert sets.stats.first().skipped_no_ir == 0
    assert all('CREATE TABLE "pets"' in r.schema_text for r in sets.schemas.collect())


def test_evaluation(spark, pets):
    dps = spark.createDataFrame([(1, "", "SELECT kind FROM pets WHERE oid = 1"), (2, "", "SELECT nope FROM pets"), (3, "", "SELECT 1 WHERE false")], "dp_id long, db_id string, gold_sql string")
    texts = [
        (1, 0, "[SQL Query Answer]```sql\nSELECT kind FROM pets WHERE pid < 3;\n```"),
        (1, 1, "SELECT kind FROM pets WHERE pid IN (2, 1)"),
        (1, 2, "SELECT 1.0"),
        (1, 3, "[N/A]"),
        (1, 4, "SELECT broken FROM"),
        (2, 0, "SELECT 1"),
        (3, 0, "  "),
    ]
    made = spark.createDataFrame([(d, "", c, t) for d, c, t in texts], "dp_id long, db_id string, cand_id long, text string")
    done = evaluation.evaluate(spark, dps, made)
    got = {r.dp_id: (r.execution_correct, r.recalled, r.gold_ok, r.top1) for r in done.per_dp.collect()}
    assert got == {1: (True, True, True, True), 2: (False, False, False, False), 3: (False, False, True, False)}
    row = done.report.first()
    assert (row.total, row.gold_executable, row.top1_pct) == (3, 2, 50.0)
    assert abs(row.ex_pct - 100 / 3) < 1e-5

    def judge(p):
        good = F.col("a")["sql"].contains("pid")
        return p.select("dp_id", "slot", F.when(good, F.lit("\\box{SQL1}")).otherwise(F.lit("\\box{SQL2}")).alias("answer"))

    chosen, scored = evaluation.rerank(dps, done, judge)
    assert "pid" in {r.dp_id: r.sql for r in chosen.collect()}[1]
    assert {r.dp_id: r.execution_correct for r in scored.collect()} == {1: True, 2: False, 3: False}


EXECS = "dp_id long, cand_id long, sql string, status string, error string, is_gold boolean"
ROWS = "dp_id long, cand_id long, row_no long, cells array<string>, types array<string>"


def ran(spark, statements):
    """(dp_id, cand_id, is_gold, rows or None for an error) -> (execs, rows)."""
    kind = lambda v: None if v is None else "text" if isinstance(v, str) else "number"
    execs = [(d, c, f"SELECT {c}", "error" if r is None else "success", "no" if r is None else None, g) for d, c, g, r in statements]
    rows = [(d, c, i, [None if v is None else str(v) for v in x], [kind(v) for v in x]) for d, c, _, r in statements for i, x in enumerate(r or [])]
    return spark.createDataFrame(execs, EXECS), spark.createDataFrame(rows, ROWS)


def test_evaluation_with_fallback(spark):
    dps = spark.createDataFrame([(1, "s1", "f1"), (2, "s2", "f2"), (3, "s3", ""), (4, "s4", "f4")], "dp_id long, schema_text string, fallback_schema string")
    first = ran(spark, [
        (1, 0, True, [(1,)]), (1, 1, False, [(1.0,)]), (2, 0, True, [("1",)]), (2, 1, False, [(None,)]), (3, 0, True, [(5,)]), (3, 1, False, None),
        (4, 0, True, [(7,)]), (4, 1, False, []),
    ])
    asked = []

    def again(n, open_dps):
        asked.append(sorted(r.dp_id for r in open_dps.collect()))
        if n == 1:
            return ran(spark, [(2, 10, False, [(1,)]), (4, 10, False, None)])
        return ran(spark, [(4, 20, False, [(7,)]), (4, 21, False, [(7,)])])

    done = evaluation.evaluate_rounds(dps, first, again, spark.createDataFrame([(1, 10.0), (2, 60.0)], "run_no long, score double"))
    assert asked == [[2, 4], [4]]
    got = {r.dp_id: (r.execution_correct, r.gold_ok) for r in done.evaluation.per_dp.collect()}
    # the number 1 is not gold's text '1'
    assert got == {1: (True, True), 2: (False, True), 3: (False, True), 4: (True, True)}
    assert {r.dp_id: r.schema_text for r in done.schemas.collect()} == {1: "s1", 2: "f2", 3: "s3", 4: "f4"}
    assert [(r.run_no, r.score, r.best_score, r.snapshot) for r in done.history.orderBy("run_no").collect()] == [(1, 10.0, 10.0, True), (2, 60.0, 60.0, True), (3, 50.0, 60.0, False)]
    alone = evaluation.evaluate_rounds(dps, first, again, rounds=0)
    assert {(r.run_no, r.snapshot) for r in alone.history.collect()} == {(1, True)} and alone.rounds.count() == 4


def test_pairs_and_judgements(spark):
    dps = spark.createDataFrame([(1, "s1", "q1"), (2, "s2", "q2"), (3, "s3", "q3")], "dp_id long, schema_text string, question string")
    execs, rows = ran(spark, [
        (1, 0, True, [("a",)]), (1, 1, False, [("a",)]), (1, 2, False, [("b",)]), (1, 3, False, [("b",)]), (1, 4, False, None),
        (2, 0, True, [(1,)]), (2, 1, False, [(2,)]), (3, 0, True, None), (3, 1, False, [(2,)]),
    ])
    pairs = training.comparison_pairs(dps, execs, rows)
    got = {r.dp_id: r for r in pairs.collect()}
    assert set(got) == {1, 2}
    sides = lambda r: {(r.sql1, r.result1), (r.sql2, r.result2)}
    text = lambda x: f"Execution result contains 1 rows:\n({x},)"
    assert ("SELECT 1", text("'a'")) in sides(got[1]) and sides(got[2]) == {("SELECT 0", text("1")), ("SELECT 1", text("2"))}
    assert "q1" in got[1].prompt and text("'a'") in got[1].prompt
    other = {"SQL1": "SQL2", "SQL2": "SQL1"}
    answers = [("1-1", 1, "see ", other[got[1].winner]), ("1-1", 2, "hint ", got[1].winner), ("2-1", 1, "no", other[got[2].winner])]
    kept = training.selector_rows(pairs, spark.createDataFrame(answers, "pair_id string, stage long, analysis string, final_choice string")).collect()
    assert [(r.pair_id, r.star_stage, r.output_label) for r in kept] == [("1-1", 2, f"hint\n\\box{{{got[1].winner}}}")]
    assert kept[0].input_prompt == got[1].prompt


def test_variants(spark):
    dps = spark.createDataFrame([(1, "s", "q", "Normal", "SELECT gold"), (2, "s", "q", "CTE", "SELECT gold")], "dp_id long, schema_text string, question string, gold_path string, gold_sql string")
    execs, rows = ran(spark, [(1, 0, True, [("a",), ("a",)]), (1, 1, False, [("a",)]), (1, 2, False, [("a",), ("a",)]), (1, 3, False, [("b",)]), (2, 0, True, None)])
    attempts = [(1, "CTE", 0, 1, "WITH one"), (1, "CTE", 1, 2, "WITH two"), (1, "Subquery", 0, 3, "SELECT three"), (2, "Normal", 0, 9, "SELECT x")]
    made = training.variant_rows(dps, spark.createDataFrame(attempts, "dp_id long, path string, attempt_no long, cand_id long, sql string"), execs, rows)
    got = {(r.dp_id, r.reasoning_path): r.query for r in made.collect()}
    assert got == {(1, "Normal"): "SELECT gold", (1, "CTE"): "WITH two", (1, "Subquery"): "[N/A]", (2, "Normal"): "[N/A]", (2, "CTE"): "[N/A]", (2, "Subquery"): "[N/A]"}
