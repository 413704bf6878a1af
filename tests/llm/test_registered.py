"""The registered queries and the pipeline over their whole tables, against SQL or plain Python."""

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from querymill.llm import decontam, quality, tokencount
from querymill.llm.oracles import ORACLES
from querymill.llm.queries import QUERIES

from .test_copies import classes, cleaned
from .test_native import em, targets, tokens, words

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations", "benchmark")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as from '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else repr(value)


def test_one_query_an_operator():
    assert [sum(name.startswith(f"op{n}_") for name in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(ORACLES) < set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in places) for row in rel.fetchall())


def test_repeated_answers(spark, tmp_path):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, 3, "assistant", "lost"), (2, 3, "assistant", "lost too")]
    turns += [(3, 0, "user", "q"), (3, None, "assistant", "x"), (3, None, "assistant", "y")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.sql(ORACLES["op7_tool_calls"])
    columns = [c for c in rel.columns if c != "json"]
    key = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    found = QUERIES["op7_tool_calls"](spark, str(tmp_path)).select(*columns, "json").collect()
    assert key(r[:-1] for r in found) == key(rel.select(*columns).fetchall())
    want = rel.filter("json IS NOT NULL").select(*columns, "json").fetchall()
    assert len(want) >= 6 and key(r for r in found if r["call_id"] is not None) == key(r for r in want if r[columns.index("call_id")] is not None)


def test_token_query(spark, documents):
    encode = tokencount.encoder(tokencount.VOCABULARY).encode_ordinary
    want = {r["doc_id"]: len(encode(r["text"] or "")) for r in documents.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op8_token_counts"](spark, FOLDER).collect()} == want


def test_language_query(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, FOLDER).collect()}
    rows = {r["doc_id"]: r for r in documents.collect()}
    assert got.keys() == rows.keys()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [d for d, r in got.items() if r["held_out"] and any(c.isalpha() for c in rows[d]["text"] or "")]
    assert sum(got[d]["lang_pred"] == rows[d]["lang"] for d in held) >= 0.95 * len(held)


def good(rows):
    """Rows that pass the base rules and that the fitted rules call good."""
    facts = {}
    for d, t in rows:
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(grams)
        lines = [x for x in (t or "").split("\n") if words(x)]
        facts[d] = {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in quality.SYMBOLS for c in t or ""), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len({i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}), "n_letters": sum(c.isalpha() for c in t or ""), "n_capitals": sum(c.isupper() for c in t or ""),
        }
    con = duckdb.connect()

    def votes(f):
        given = ", ".join(f"{v} AS {k}" for k, v in f.items())
        rules = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {fine} THEN 1 ELSE 0 END" for bad, fine in quality.RULES.values())
        return con.execute(f"SELECT {rules} FROM (SELECT {given})").fetchone()

    failed = lambda f: f["n_words"] < 10 or 100 * f["n_repeat_words"] > 20 * f["n_words"]
    cast = {d: (votes(f), failed(f)) for d, f in facts.items()}
    sure = em(Counter(cast.values()))
    return [(d, t) for d, t in rows if sure[cast[d]] >= 0.5]


def leaks(text, items):
    """As test_native.leaked, but only along the diagonals on which enough tokens agree."""
    at = defaultdict(list)
    d = tokens(text)
    for i, x in enumerate(d):
        at[x].append(i)
    for t in items:
        if len(t) < decontam.SPAN:
            continue
        size = min(decontam.OVERLAP, len(t))
        least = size - size * decontam.MISSES // decontam.OVERLAP
        shifts = Counter(i - j for j, x in enumerate(t) for i in at[x])
        for shift, n in shifts.items():
            if n >= least:
                same = [0 <= shift + j < len(d) and d[shift + j] == x for j, x in enumerate(t)]
                if any(sum(same[i : i + size]) >= least for i in range(len(t) - size + 1)):
                    return True
    return False


def test_pipeline(spark, documents):
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    start = len(rows)
    rows = good(rows)
    rows = [(d, c) for (d, t), c in zip(rows, cleaned(rows, [0] * len(rows))) if c == t or words(c)]
    rows = [(d, t) for (d, t), (c, _) in zip(rows, classes(rows)) if c == d]
    items = [tokens(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not leaks(t, items)]
    assert 0.3 * start < len(rows) < start
    sizes = defaultdict(int)
    for d, t in rows:
        sizes[source[d]] += len(words(t))
    want = targets(sizes)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["size"], r["source"]) for r in got) == sorted((d, len(words(t)), source[d]) for d, t in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_stages_keep_columns(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, FOLDER)
            assert name == "mix_sources" or out.dtypes == docs.dtypes
            assert out.count() <= docs.count()
            assert docs is none or out.filter(F.length("doc_id") > 0).count() > 0
