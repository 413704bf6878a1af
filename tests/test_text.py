"""Column expressions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from querymill.functions import answers, examples, naming, prompts, sqltext
from querymill.functions.seeded import draw, uniform_int, unit


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x"))
    return row.first().x


@pytest.mark.parametrize(
    ("declared", "want"),
    [("interval", "integer"), ("Point", "integer"), ("timestamp", "time"), ("CHARACTER VARYING(3)", "text"), ("double precision", "real"), ("", "others"), (None, "others"), ("NUMBER(3)", "numeric"), ("json", "jsonb")],
)
def test_types(spark, declared, want):
    assert one(spark, naming.normalize_type(F.col("t").cast("string")), t=declared) == want


def test_unknown_type_raises(spark):
    with pytest.raises(Exception, match="unknown declared type"):
        one(spark, naming.normalize_type(F.col("t")), t="geometry")


def test_description(spark):
    assert one(spark, naming.clean_description(F.col("t")), t="  commonsense evidence:\r\n a  b\n\nc ") == "a b c"


def test_comment_skips_what_is_said(spark):
    args = dict(n="user_id", d="User ID", c="the user", v="The User")
    cols = [F.col(k) for k in args]
    assert one(spark, naming.column_comment(*cols, None), **args) == "Column Description: the user"
    assert one(spark, naming.column_comment(*cols, F.lit(True)), **args) == "Column Description: the user | Contains NULL: True"


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select * from order where order.id = 1", 'select * from "order" where "order".id = 1'),
        ("select 'order', \"order\" from t ORDER   BY x", "select 'order', \"order\" from t ORDER   BY x"),
        ("select 'it''s order' from Order", "select 'it''s order' from \"order\""),
        ("select orders, reorder, order_id from t order by order", 'select orders, reorder, order_id from t order by "order"'),
        ("select 'open order", "select 'open \"order\""),
        ("", ""),
    ],
)
def test_quote_reserved(spark, sql, want):
    assert one(spark, sqltext.quote_reserved(F.col("s")), s=sql) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("bla [SQL Query Answer] ```sql\nSELECT 1\n  FROM t;\n``` bye", "SELECT 1 FROM t"),
        ("```sql SELECT 1 ```", "SELECT 1"),
        (" [N/A] ", "[N/A]"),
        ("[SQL Query Answer]", ""),
        (";; SELECT ';' ;", " SELECT ';' "),
        ("```sql ``` x", ""),
    ],
)
def test_clean_sql(spark, text, want):
    assert one(spark, sqltext.clean_sql(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select a -- x\n from  t;; ", "SELECT a FROM t;"),
        ("SELECT 'select  x' FROM t", "SELECT 'select x' FROM t;"),
        ("/* a */ select b", "SELECT b;"),
    ],
)
def test_canonical(spark, sql, want):
    assert one(spark, sqltext.canonical_sql(F.col("s")), s=sql) == want


@pytest.mark.parametrize(
    ("sql", "want"),
    [("with a as (select 1) select * from a", "CTE"), ("select (select 1)", "Subquery"), ("select '(select 1)' from t", "Normal"), ("-- with\nselect 1", "Normal")],
)
def test_paths(spark, sql, want):
    assert one(spark, sqltext.reasoning_path(F.col("s")), s=sql) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('```json\n{"a": ["x", "y",],}\n``` {"b": []}', {"a": ["x", "y"]}),
        ('so {"a": ["x"]} ok', {"a": ["x"]}),
        ('{"a": ["x"], "a": ["y"]}', {"a": ["y"]}),
        ('{"a": "x"}', {}),
        ("[1]", {}),
        ("{broken", {}),
        ("", {}),
    ],
)
def test_link_json(spark, text, want):
    assert one(spark, answers.parse_link_json(F.col("t")), t=text) == want


def test_malformed_links(spark):
    assert one(spark, answers.link_malformed(F.col("t")), t='{"a": "x"}') is True
    assert one(spark, answers.link_malformed(F.col("t")), t='{"a": ["x"]}') is False


def test_boxed_choice_coin(spark):
    df = spark.range(2000).select(answers.parse_boxed_choice(F.lit("none"), draw(1, "id")).alias("c"))
    heads = df.filter("c = 'SQL1'").count()
    assert 900 < heads < 1100


def test_draws(spark):
    row = spark.range(20000).select(unit(draw(1, "id")).alias("u"), uniform_int(draw(2, "id"), 2, 4).alias("k")).agg(F.min("u"), F.max("u"), F.avg("u"), F.min("k"), F.max("k"), F.count_if(F.col("k") == 3)).first()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.01
    assert (row[3], row[4]) == (2, 4) and abs(row[5] / 20000 - 1 / 3) < 0.02


def test_examples(spark):
    lists = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    assert one(spark, examples.merge_examples(lists("a", "b" * 100, "c"), lists("a", "d", "e", "f"), max_length=100)) == ["a", "c", "d", "e"]
    assert one(spark, examples.merge_examples(lists("a", "b", "c", "d", "e"), lists("x"))) == ["a", "b", "c", "d", "e"]
    assert one(spark, examples.collapse_identifier_examples(lists("me@x.org", "b"))) == ["me@x.org"]
    assert one(spark, examples.collapse_identifier_examples(lists(None, "b"))) == [None, "b"]
    assert one(spark, examples.collapse_identifier_examples(lists())) == []
    assert one(spark, examples.format_examples(lists(" a ", "b"), F.lit("text"))) == "'a', 'b'"
    assert one(spark, examples.format_examples(lists("1.50", "2"), F.lit("numeric"))) == "1.5, 2.0"
    assert one(spark, examples.local_examples(F.lit("c"), lists(), lists(), F.lit("text"))) == ""


def test_fill_does_not_scan_fields(spark):
    assert one(spark, prompts.fill("{a}-{b}-{a}{x}", a=F.lit("{b}"), b=F.lit("B"))) == "{b}-B-{b}{x}"


def test_questions(spark):
    assert one(spark, prompts.question_with_evidence(F.lit("q"), F.lit(" 1234 "))) == "q"
    assert one(spark, prompts.question_with_evidence(F.lit("q"), F.lit(" 12345 "))) == "q\n(hint: 12345)"
    with pytest.raises(Exception, match="no question text"):
        one(spark, prompts.question_text(F.lit(" "), F.lit(None).cast("string"), F.lit("")))


def test_float_text(spark):
    from querymill.functions.examples import float_text

    cells = ["12345678.50", "10000000", "-98765432101.25", "1e15", "7", "0.5", "x", "1234567.0", "1e300"]
    got = [r[0] for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i").select(float_text(F.col("c"))).collect()]
    assert got == ["12345678.5", "10000000.0", "-98765432101.25", "1000000000000000.0", "7.0", "0.5", "x", "1234567.0", "1.0E300"]
