"""Sources, profiles, retrieval, links and synthesis on hand-written frames."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.functions import seeded
from querymill.operators import catalog, links, profile, render, retrieval, synth, workload
from querymill.sources import corpus

COLUMNS = "db_id string, table_idx long, table_name string, table_comment string, col_idx long, col_name string, type_class string, comment string, is_pk boolean"
FKS = "db_id string, fk_no long, table_name string, col_name string, ref_table string, ref_column string"
LINK = "dp_id long, db_id string, table_name string, col_name string"


@pytest.fixture(scope="module")
def shop(spark):
    """shop: Customer(id pk, Name, city), Orders(oid pk, cust -> Customer.id, day, note), Log(line, text)."""
    spec = {"Customer": ["id", "Name", "city"], "Orders": ["oid", "cust", "day", "note"], "Log": ["line", "text"]}
    keys = {("Customer", "id"), ("Orders", "oid")}
    rows = [("shop", ti, t, "", ci, c, "text", "", (t, c) in keys) for ti, (t, cols) in enumerate(spec.items()) for ci, c in enumerate(cols)]
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([("shop", 0, "Orders", "cust", "Customer", "id")], FKS)


def link_set(df):
    return {(r.dp_id, r.table_name, r.col_name) for r in df.collect()}


def test_json_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"q": "é", "n": 1}, {"q": "x"}], ensure_ascii=False, indent=2), encoding="utf-8")
    got = corpus.read_corpus(spark, str(tmp_path), "q string, n long").collect()
    assert sorted((r.q, r.n) for r in got) == [("x", None), ("é", 1)]
    (tmp_path / "b.json").write_text('{"q": 1}')
    with pytest.raises(Exception, match="expected a JSON list"):
        corpus.read_corpus(spark, str(tmp_path), "q string").collect()


@pytest.mark.parametrize("indent", [None, 1])
def test_one_list_is_read_by_many_tasks(spark, tmp_path, indent):
    """Braces, quotes and backslashes in strings, nested values, and borders of byte ranges anywhere."""
    rng = np.random.default_rng(4)
    bits = ["}", "{", "]", "[", '"', "\\", "\\\\", "é😀", ",", " ", "\n", "x" * 30, '"}],[{"']
    text = lambda: "".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 9)))
    rows = [{"n": i, "q": text(), "deep": {"a": [{"b": text()}, {"b": None}], "c": {}}} for i in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False, indent=indent), encoding="utf-8")
    (tmp_path / "b.json").write_text(" [ ]\n")
    (tmp_path / "c.json").write_text('[{"n": 1000, "q": "\\u007d"}]')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert corpus._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        got = corpus.read_corpus(spark, str(tmp_path), "n long, q string, deep struct<a: array<struct<b: string>>>").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(r["n"], r["q"], [x["b"] for x in r["deep"]["a"]]) for r in rows] + [(1000, "}", None)]
    assert sorted((r.n, r.q, r.deep and [x.b for x in r.deep.a]) for r in got) == want


def test_csv_descriptions(spark, tmp_path):
    (tmp_path / "users.csv").write_bytes("original_column_name,column_description,value_description\n id ,\"the\nkey\",\nname,é,x\n".encode("latin-1"))
    got = {r.original_column_name: (r.table_name, r.column_description, r.value_description) for r in corpus.read_descriptions(spark, str(tmp_path), "ISO-8859-1").collect()}
    assert {k.strip(): v for k, v in got.items()} == {"id": ("users", "the\nkey", None), "name": ("users", "é", "x")}


def test_display_names_with_duplicates(spark):
    raw = spark.createDataFrame(
        [("d", ["big one", "other", "rest"], ["rest", "Big_One", "bigone", "extra"])], "db_id string, table_names array<string>, table_names_original array<string>"
    )
    got = {r.table_idx: r.display_idx for r in catalog.match_display_tables(raw).collect()}
    # rest and the first of the two equivalent names match; the second one keeps its position; the last has none
    assert got == {0: 2, 1: 0, 2: 2, 3: None}


def test_value_examples_filter_after_the_cut(spark):
    df = spark.createDataFrame([(i, None if i == 0 else ("", "a" * 90, "b", "c", "d", "e")[i - 1]) for i in range(7)], "n int, s string")
    got = sorted((r.col_name, r.ex_no, r.value) for r in profile.value_examples(df, "t", ["n", "s"], max_length=80).collect())
    assert got == [("n", i + 1, str(i)) for i in range(1, 5)] + [("s", 4, "b"), ("s", 5, "c")]


def test_long_values_keep_their_place(spark):
    texts = ["ab", "ab" + "c" * 50, "ab" + "c" * 51, "abd", "aba", "ab" + "c" * 50 + "x"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.value for r in profile.distinct_values(df, "t", ["s"], cap=5, max_length=20).collect()}
    assert got == {"ab", "aba"}  # three long ones sort before "abd" and use up the cap


def test_nearest_values_in_shards(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 7)
    monkeypatch.setattr(retrieval, "INDEX_ROWS", 11)
    rng = np.random.default_rng(0)
    q = rng.normal(size=(40, 5)).astype("float32")
    v = rng.normal(size=(90, 5)).astype("float32")
    v[50] = v[10]  # a tie
    dbs, cols = ["hot" if i % 4 else "cold" for i in range(40)], [f"c{i % 3}" for i in range(90)]
    queries = spark.createDataFrame([(i, dbs[i], q[i].tolist()) for i in range(40)], "dp_id long, db_id string, embedding array<float>")
    index = spark.createDataFrame([("hot", "t", cols[i], f"v{i:02d}", v[i].tolist()) for i in range(90)], "db_id string, table_name string, col_name string, value string, embedding array<float>")
    got = {}
    for r in retrieval.nearest_values(queries, index).collect():
        got.setdefault((r.dp_id, r.col_name), {})[r.rn] = r.value
    want = {}
    for i in range(40):
        if dbs[i] == "hot":
            d = ((q[i].astype(float) - v.astype(float)) ** 2).sum(1).round(9)
            for c in set(cols):
                mine = sorted((d[j], f"v{j:02d}") for j in range(90) if cols[j] == c)[:3]
                want[i, c] = {n + 1: name for n, (_, name) in enumerate(mine)}
    assert got == want


def test_draw_start(spark):
    row = spark.range(7, 8).select(seeded.draw("42|x", "id", F.lit("t"), F.lit("c")).alias("a"), F.md5(F.concat(seeded.draw_start("42|x", "id", F.lit("t")), F.lit("c"))).alias("b")).first()
    assert row.a == row.b


def test_close_link(spark, shop):
    columns, fks = shop
    given = spark.createDataFrame([(1, "shop", "customer", "NAME"), (1, "shop", "orders", "ghost"), (2, "shop", "Orders", "day"), (3, "shop", "Nowhere", "x")], LINK)
    closed = links.close_link(given, columns, fks)
    want = {
        (1, "Customer", "Name"), (1, "Customer", "id"), (1, "Orders", "oid"), (1, "Orders", "cust"), (1, "Orders", "ghost"),
        (2, "Orders", "day"), (2, "Orders", "oid"), (3, "Nowhere", "x"),
    }
    assert link_set(closed) == want
    assert link_set(links.close_link(closed, columns, fks)) == want


def test_statement_commas(spark, shop):
    columns, fks = shop
    noted = columns.withColumn("comment", F.when(F.col("col_name") == "note", "free text").otherwise(""))
    got = {r.table_name: r.statement for r in render.render_table(noted, fks).collect()}
    assert got["Log"] == 'CREATE TABLE "Log" (\n    "line" TEXT,\n    "text" TEXT\n);\n'
    assert got["Orders"] == (
        'CREATE TABLE "Orders" (\n    "oid" TEXT,\n    "cust" TEXT,\n    "day" TEXT,\n    "note" TEXT, -- free text\n'
        '    PRIMARY KEY ("oid"),\n    FOREIGN KEY ("cust") REFERENCES Customer("id")\n);\n'
    )


def test_schema_text_of_a_link(spark, shop):
    columns, fks = shop
    link = spark.createDataFrame([(1, "shop", "Orders", "day")], LINK)
    overview = spark.createDataFrame([("shop", "A shop.")], "db_id string, overview string")
    text = render.render_schema(link, columns, fks, overview).first().schema_text
    assert text == '-- Database name: shop\n-- Database overview: A shop.\n-- Database schema:\nCREATE TABLE "Orders" (\n    "oid" TEXT,\n    "day" TEXT,\n    PRIMARY KEY ("oid")\n);\n'


def test_schema_input_needs_a_catalog(spark, shop):
    columns, fks = shop
    static = spark.createDataFrame([("shop", "Log", "text", ["a", "b"])], "db_id string, table_name string, col_name string, examples array<string>")
    found = spark.createDataFrame([(1, "Log", "text", 1, "z")], "dp_id long, table_name string, col_name string, rn long, value string")
    asks = spark.createDataFrame([(1, "shop")], "dp_id long, db_id string")
    text = render.schema_input(asks, columns, fks, static, found).first().schema_text
    assert "    \"text\" TEXT -- Value Examples: ['z', 'a', 'b']\n);\n" in text
    with pytest.raises(Exception, match="no catalog for database gone"):
        render.schema_input(asks.withColumn("db_id", F.lit("gone")), columns, fks, static, found).collect()


SQLS = {
    1: "SELECT c.Name, count(*) FROM Customer AS c JOIN orders o ON c.id = o.cust WHERE o.note = 'city' GROUP BY c.name",
    2: "SELECT day FROM Orders, Customer WHERE city = 'x'",
    3: "SELECT o.ghost FROM Orders o",
    4: "SELECT count(*) FROM Log",
    5: "SELECT count(*) FROM Customer",
    6: "WITH w AS (SELECT line FROM Log) SELECT w.line FROM w",
}


def test_links_of_statements(spark, shop):
    columns, _ = shop
    work = spark.createDataFrame([(k, "shop", v) for k, v in SQLS.items()], "dp_id long, db_id string, sql string")
    good, rejected = workload.validate_link(workload.link_columns(work, columns), columns)
    assert [r.dp_id for r in rejected.collect()] == [3]
    got = link_set(good)
    pick = lambda n: {(t, c) for d, t, c in got if d == n}
    assert pick(1) == {("Customer", "Name"), ("Customer", "id"), ("Orders", "oid"), ("Orders", "cust"), ("Orders", "note")}
    assert pick(2) == {("Orders", "day"), ("Orders", "oid"), ("Customer", "city"), ("Customer", "id")}
    assert pick(4) == {("Log", "line"), ("Log", "text")}
    assert pick(5) == {("Customer", "id")}
    assert pick(6) == {("Log", "line")}


def test_column_samples_fall_back_to_far_tables(spark, shop):
    columns, fks = shop
    link = spark.createDataFrame([(1, "shop", "customer", "name"), (2, "shop", "Customer", "id")], LINK)
    got = [(r.dp_id, r.table_name, r.col_name, r.label, r.neg_type) for r in synth.column_samples(link, columns, fks).collect()]
    assert {g[0] for g in got} == {1}
    assert (1, "Customer", "Name", "True", "") in got and (1, "Customer", "city", "False", "hard") in got
    assert len([g for g in got if g[4] == "easy"]) == 2 and len(got) == 4


def test_corrupted_links(spark, shop):
    columns, fks = shop
    link = spark.createDataFrame([(1, "shop", "Orders", "cust"), (1, "shop", "Customer", "id"), (2, "shop", "Log", "text"), (3, "shop", "Orders", "day"), (3, "shop", "Orders", "oid")], LINK)
    by_table = {(r.dp_id, r.dropped_table, r.table_name, r.col_name) for r in synth.drop_table_negatives(link, columns, fks).collect()}
    assert by_table == {(1, "Customer", "Orders", "cust"), (1, "Orders", "Customer", "id")} - {(1, "Customer", "Orders", "cust")}
    by_col = {(r.dp_id, r.sample_no, r.col_name) for r in synth.drop_column_negatives(link, columns, fks).collect()}
    assert by_col == {(3, n, "oid") for n in (1, 2, 3)}


def test_noise_keeps_the_link(spark, shop):
    columns, fks = shop
    link = spark.createDataFrame([(n, "shop", "Orders", "day") for n in range(200)], LINK)
    noisy = link_set(synth.noised_link(link, columns, fks))
    assert {(n, "Orders", "day") for n in range(200)} <= noisy
    with_customer = {n for n, t, _ in noisy if t == "Customer"}
    assert 60 < len(with_customer) < 140
    assert {n for n, t, c in noisy if (t, c) == ("Orders", "cust")} == with_customer
    assert 60 < len({n for n, t, c in noisy if (t, c) == ("Orders", "note")}) < 140


def test_pivots_spare_visits(spark):
    """Values around a few centres: the result is that of all pairs, with a fraction of the visits."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (12, 4))
    point = lambda i: (centres[i % 12] + rng.normal(0, 0.3, 4)).tolist()
    index = [("d", "t", f"c{i % 2}", f"v{i}", point(i // 2)) for i in range(400)] + [("d", "t", "c0", "same", centres[0].tolist())] * 3 + [("d", "t", "few", "one", point(1)), ("d", "t", "few", "none", None)]
    queries = [(i, "d", point(i)) for i in range(40)]
    seen = []
    got = retrieval.nearest_values(
        spark.createDataFrame(queries, "dp_id long, db_id string, embedding array<double>"),
        spark.createDataFrame(index, "db_id string, table_name string, col_name string, value string, embedding array<double>"),
        rows=10,
        visits=lambda v: seen.append((v.count(), v.select("db_id", "table_name", "col_name", "cell").distinct().count())),
    ).collect()
    want = set()
    for dp, _, q in queries:
        for col in ("c0", "c1", "few"):
            near = sorted((round(float(((np.array(x[4]) - q) ** 2).sum()), 9), x[3]) for x in index if x[2] == col and x[4] is not None)[:3]
            want |= {(dp, col, n, v) for n, (_, v) in enumerate(near, 1)}
    assert {(r["dp_id"], r["col_name"], r["rn"], r["value"]) for r in got} == want
    made, cells = seen[0]
    assert cells > 20 and made < 0.5 * len(queries) * cells


def test_group_split(spark):
    rows = spark.range(1000).select((F.col("id") % 20).alias("g"))
    got = synth.group_split(rows, "g", ratio=0.3, tol=0.02).collect()
    assert sum(r.n_rows for r in got if r.side == "A") == 300 and len(got) == 20
    hot = spark.range(1000).select(F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("g"))
    never = synth.group_split(hot, "g", ratio=0.3, tol=0.0, trials=20).collect()
    assert {r.trial for r in never} == {21} and len([r for r in never if r.side == "A"]) == 30
    assert {r.side for r in synth.group_split(hot, "g", ratio=0.0, trials=3).collect()} == {"B"}


def test_length_limits(spark):
    df = spark.createDataFrame([("a b", "c", "d e")], "p string, x string, y string")
    keep = lambda n, strict: synth.length_filter(df, F.col("p"), [F.col("x"), F.col("y")], n, strict).count()
    assert (keep(4, False), keep(4, True), keep(5, True), keep(3, False)) == (1, 0, 1, 0)


def test_stars_and_output_names(spark):
    from querymill.operators.workload import link_columns

    columns = spark.createDataFrame([("d", t, c) for t, cs in (("t", "abi"), ("u", "ci")) for c in cs], "db_id string, table_name string, col_name string")
    texts = [
        "SELECT * FROM t JOIN u ON t.i = u.i WHERE c = 1",
        "SELECT x.* FROM t AS x, u WHERE c * 2 = 1",
        "SELECT count(*) AS c FROM t, u ORDER BY c",
        "SELECT a AS a FROM t ORDER BY a",
    ]
    work = spark.createDataFrame([(i, "d", s) for i, s in enumerate(texts)], "dp_id long, db_id string, sql string")
    got = {}
    for r in link_columns(work, columns).filter("col_name IS NOT NULL").collect():
        got.setdefault(r.dp_id, set()).add(f"{r.table_name}.{r.col_name}")
    assert got[0] == {"t.a", "t.b", "t.i", "u.c", "u.i"}
    assert got[1] == {"t.a", "t.b", "t.i", "u.c"}
    assert 2 not in got
    assert got[3] == {"t.a"}


def test_names_belong_to_the_innermost_scope(spark):
    columns = spark.createDataFrame([("d", t, c) for t, cs in (("t", "abi"), ("u", "ci")) for c in cs], "db_id string, table_name string, col_name string")
    texts = [
        "SELECT x.c FROM u x WHERE x.i IN (SELECT max(x.a) FROM t x WHERE (x.b = 1)) AND x.c > 0",
        "SELECT i FROM u WHERE EXISTS (SELECT 1 FROM t y WHERE y.a = u.c)",
        "SELECT * FROM (SELECT i FROM t) s JOIN u ON 1 = 1",
        "SELECT s.k FROM (SELECT q.* FROM t q) s",
        "SELECT x.a) FROM t x",
    ]
    work = spark.createDataFrame([(i, "d", s) for i, s in enumerate(texts)], "dp_id long, db_id string, sql string")
    got = {}
    for r in workload.link_columns(work, columns).filter("col_name IS NOT NULL").collect():
        assert r.known
        got.setdefault(r.dp_id, set()).add(f"{r.table_name}.{r.col_name}")
    assert got[0] == {"u.c", "u.i", "t.a", "t.b"}
    assert got[1] == {"u.i", "t.a", "u.c"}
    assert got[2] == {"t.i", "u.c", "u.i"}
    assert got[3] == {"t.a", "t.b", "t.i"}
    assert got[4] == {"t.a"}


def test_values_and_their_vectors(spark):
    values = spark.createDataFrame([("a",), ("b",), ("c",)], "value string")
    vectors = spark.createDataFrame([("a", [2.0]), ("a", [1.0]), ("b", [3.0])], "value string, embedding array<float>")
    assert sorted((r.value, r.embedding) for r in retrieval.build_value_index(values, vectors).collect()) == [("a", [1.0]), ("b", [3.0])]
    assert [r.value for r in retrieval.values_without_vector(values, vectors).collect()] == ["c"]


def touched(spark, texts):
    columns = spark.createDataFrame([("d", t, c) for t, cs in (("t", ("a", "b", "i")), ("u", ("a", "b", "c", "i")), ("order", ("note",)), ("two words", ("first col",))) for c in cs], "db_id string, table_name string, col_name string")
    work = spark.createDataFrame([(i, "d", s) for i, s in enumerate(texts)], "dp_id long, db_id string, sql string")
    got = {i: set() for i in range(len(texts))}
    for r in workload.link_columns(work, columns).filter("col_name IS NOT NULL").collect():
        got[r.dp_id].add(f"{r.table_name}.{r.col_name}" + ("" if r.known else "?"))
    return got


STATED = {
    "SELECT a FROM t UNION SELECT a FROM u": {"t.a", "u.a"},
    "SELECT x.a FROM t x UNION SELECT x.c FROM u x": {"t.a", "u.c"},
    "(SELECT a FROM t WHERE b = 1) EXCEPT (SELECT c FROM u)": {"t.a", "t.b", "u.c"},
    "SELECT count(*) c FROM t, u ORDER BY c": set(),
    "SELECT count(*) c FROM t, u WHERE c = 1 ORDER BY c": {"u.c"},
    "SELECT t.a b, 'x' c FROM t, u ORDER BY b, c": {"t.a"},
    "SELECT t.a FROM (t JOIN u ON (t.i = u.i)) WHERE c > f(t.b, u.b)": {"t.a", "t.b", "t.i", "u.i", "u.c", "u.b"},
    "SELECT c FROM t JOIN u USING (i)": {"u.c", "t.i", "u.i"},
    "SELECT x.a FROM t AS x JOIN u y ON x.i = y.i, order WHERE order.note = 'a' ORDER BY y.c": {"t.a", "t.i", "u.i", "u.c", "order.note"},
    "WITH t AS (SELECT a FROM t) SELECT t.a, c FROM t, u": {"t.a", "u.c"},
    "WITH w AS (SELECT a FROM t), u AS (SELECT b AS c FROM t) SELECT c FROM u": {"t.a", "t.b"},
    "WITH RECURSIVE t(a) AS (SELECT i FROM u UNION ALL SELECT a FROM t) SELECT a FROM t": {"u.i"},
    "SELECT c FROM u WHERE i IN (SELECT c FROM (SELECT b AS c FROM t) s)": {"u.c", "u.i", "t.b"},
    "SELECT c FROM u WHERE EXISTS (SELECT 1 FROM t WHERE t.a = c)": {"u.c", "t.a"},
    'SELECT "first col" k FROM `two words` WHERE "First Col" = 1': {"two words.first col"},
    "SELECT sum(a) OVER (PARTITION BY b ORDER BY i) s FROM t GROUP BY a HAVING s > 1": {"t.a", "t.b", "t.i"},
    "SELECT CASE WHEN a = 'it''s' THEN b END AS i FROM t ORDER BY i DESC LIMIT 3": {"t.a", "t.b"},
    "SELECT cast(a AS real), date '2020-01-01' FROM t WHERE a IS DISTINCT FROM b": {"t.a", "t.b"},
    "SELECT x.ghost FROM t x UNION SELECT x.c FROM u x": {"t.ghost?", "u.c"},
    "SELECT DISTINCT x.* FROM t x, (SELECT c FROM u) y": {"t.a", "t.b", "t.i", "u.c"},
    "SELECT x.a FROM u x WHERE x.i IN (SELECT x.b FROM (SELECT b FROM t) x)": {"u.a", "u.i", "t.b"},
    "": set(),
    "))) FROM ((": set(),
}


def test_scopes_of_statements(spark):
    got = touched(spark, list(STATED))
    assert {s: got[i] for i, s in enumerate(STATED)} == STATED


def test_long_statements_are_linear(spark):
    deep = "SELECT a FROM t WHERE " + "(" * 150 + "b = 1" + ")" * 150 + " AND a IN (" + ", ".join("(1)" for _ in range(500)) + ")"
    wide = " UNION ".join("SELECT x.a FROM t x WHERE (x.b = 1)" for _ in range(80))
    assert list(touched(spark, [deep, wide]).values()) == [{"t.a", "t.b"}] * 2
