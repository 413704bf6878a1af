"""Archives, languages, tool calls and token counts against plain Python and round trips."""

import hashlib
import json
import random
from base64 import b32encode

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.llm.queries import QUERIES
from querymill.llm import language, tokencount, toolcalls, warc

PAGES = "page_id long, url string, html string, captured string"


@pytest.fixture(scope="module")
def pages(spark):
    at = F.date_format(F.timestamp_seconds(F.col("page_id") % 7), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html", at.alias("captured"))
    same = "<p>same\r\n\r\nWARC/1.1\r\n</p>"
    odd = [(9001, "http://a.example/x\r\ny", same, "t1"), (9003, "http://a.example/x", same, "t0"), (9002, None, same, None), (9004, "http://[bad", None, "t"), (9005, "u", "", "t"), (None, "u", "", "t"), (None, "v", "ü" * 20000, "t"), (9001, "z", same, "t9")]
    return given.union(spark.createDataFrame(odd, PAGES))


def test_archives(pages):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    first = {}
    for p, b in rows:
        if p is not None:
            first[b] = min(first.get(b, p), p)
    want = []
    for p, b in rows:
        later = b in first and p != first[b]
        want.append((p, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if later else "response", first[b] if later else None))
    index = warc.archived(pages)
    got = index.collect()
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    keys = [warc.order_key((r["urlkey"], r["captured"], r["page_id"])) for r in got]
    assert keys == sorted(keys)


def test_small_payloads_are_not_revisits(spark, pages):
    got = warc.archived(pages.filter("page_id > 9000"), least=1000).collect()
    assert {r["record_type"] for r in got} == {"response"}


def test_no_pages(pages):
    assert warc.archived(pages.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [[], [0], [5], [3, 0, 7], [1] * 9, [0, 0, 4, 100]])
def test_loser_tree(sizes):
    rng = random.Random(len(sizes))
    runs = [sorted([(rng.choice("abc"), "t", rng.choice([None, 1, 2])) for _ in range(n)], key=warc.order_key) for n in sizes]
    assert list(map(warc.order_key, warc.loser_tree(runs))) == sorted(warc.order_key(x) for r in runs for x in r)


def test_records_by_length_only():
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n"))


def brute_marginals(emit, first, moves, start):
    """Posteriors of a short chain by summing over all paths."""
    n, k = emit.shape
    post, total = np.zeros((n, k)), 0.0
    for code in range(k**n):
        path = [code // k**i % k for i in range(n)]
        s = sum(emit[i, y] + (start[y] if first[i] else moves[path[i - 1], y]) for i, y in enumerate(path))
        total += np.exp(s)
        for i, y in enumerate(path):
            post[i, y] += np.exp(s)
    return post / total


def test_forward_backward(monkeypatch):
    rng = np.random.default_rng(3)
    first = np.array([1, 0, 0, 1, 0, 0, 0, 1], bool)
    emit, moves, start = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    for width in (2, 3, 64):
        monkeypatch.setattr(language, "WIDTH", width)
        post, expected = language.posteriors(emit, first, moves, start)
        assert np.allclose(post, brute_marginals(emit, first, moves, start))
        assert expected.sum() == pytest.approx(5)


def test_words_and_owners():
    w = language.read(["Ab c1d", "", "x-Über"])
    assert w.sizes.tolist() == [2, 1, 1, 1, 4]
    assert w.owner.tolist() == [0, 0, 0, 2, 2]
    assert w.first.tolist() == [True, False, False, True, False]
    alone = language.read(["x-Über"])
    assert (alone.by_word == w.by_word[3:]).all() and (alone.by_letter == w.by_letter[4:]).all()


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return language.train(docs)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_mixed_text(spark, model):
    docs = {r["lang"]: r["text"].split()[:40] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 600").orderBy("doc_id").collect()}
    text = [*docs["en"], *docs["de"]]
    post, w = language.label([" ".join(text)], model)
    names = [model.langs[i] for i in post.argmax(axis=1)]
    half = len(names) // 2
    assert sum(x == "en" for x in names[: half - 8]) > 0.8 * (half - 8)
    assert sum(x == "de" for x in names[half + 8 :]) > 0.8 * (len(names) - half - 8)


def test_languages_of_odd_texts(odd, none, model):
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count()
    texts = [r["text"] for r in odd.collect()]
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not any(c.isalpha() for c in t or "") for t in texts)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.train(none) is None
    assert language.identify(none, None).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd, None).collect()} == {"und"}


def test_long_text_equals_its_words(model):
    text = " ".join(["the of erthing"] * 5000)
    post, w = language.label([text], model)
    assert len(post) == 15000 and np.allclose(post.sum(axis=1), 1)


CALLS = "conv_id long, call_id string, position long, name string, arguments string, parents array<string>"
RESULTS = "conv_id long, call_id string, position long, content string"
SCHEMAS = "name string, field string, kind string, required boolean"


@pytest.fixture(scope="module")
def chat(spark):
    calls = [
        (1, "a", 0, "f", '{ "y": [1, {"d":1,"c":2}], "x": 1 }', None),
        (1, "b", 1, "f", '{"x": "1"}', ["a"]),
        (2, "a", 0, "f", '{"x": 2}', ["b"]),
        (2, "b", 1, "f", '{"x": 3, "é\\"q": 1}', ["c", "zz"]),
        (2, "c", 2, "g", "{}", []),
        (3, "p", 0, "f", "[1]", ["q"]),
        (3, "q", 1, "f", "not", ["p"]),
        (3, "r", 2, "f", None, ["q"]),
        (3, "s", 3, "h", '{"x":1}', None),
        (4, None, 0, None, '{"x":1,"x":2}', None),
        (1, "b", 5, "f", '{"x": 7.0}', None),
    ]
    results = [(1, "a", 3, "later"), (1, "a", 2, 'say "hi"\n'), (2, "c", 3, None), (9, "zz", 0, "lost"), (4, None, 1, "null id")]
    schemas = [("f", "x", "integer", True), ("f", "y", "array", False), ("g", "z", "string", True)]
    return spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(schemas, SCHEMAS)


def test_tool_calls(chat):
    got = {(r["conv_id"], r["call_id"], r["position"]): r for r in toolcalls.linked(*chat).collect()}
    assert len(got) == 13
    say = lambda k: got[k]["problems"]
    assert say((1, "a", 0)) == [] and got[(1, "a", 0)]["valid"]
    assert say((1, "b", 1)) == ["type of x"] and say((1, "b", 5)) == ["type of x"]
    assert say((2, "b", 1)) == ['unknown é"q']
    assert say((2, "c", 2)) == ["missing z"]
    assert say((3, "p", 0)) == ["no JSON object", "cycle"] and say((3, "q", 1)) == ["no JSON object", "cycle"] and "cycle" in say((3, "r", 2))
    assert say((3, "s", 3)) == ["no schema"]
    assert say((4, None, 0)) == ["no JSON object"]
    assert [got[(2, c, p)]["level"] for c, p in (("c", 2), ("b", 1), ("a", 0))] == [0, 1, 2]
    status = {k: r["status"] for k, r in got.items()}
    assert status[(1, "a", 0)] == "linked" and status[(1, "b", 1)] == "unanswered" and status[(9, "zz", 0)] == "orphan" and status[(4, None, 1)] == "orphan"
    row = got[(1, "a", 0)]["json"]
    assert row == '{"arguments":{"x":1,"y":[1,{"c":2,"d":1}]},"id":"a","name":"f","result":"say \\"hi\\"\\n"}'
    assert all(json.loads(r["json"]) is not None for r in got.values())


def test_every_result_stays(spark, chat):
    calls, _, schemas = chat
    results = [(1, "a", 3, "later"), (1, "a", 2, "first"), (1, "a", 3, "later"), (1, "zz", 4, "p"), (1, "zz", 5, "q"), (4, None, 1, "x"), (4, None, 2, "y"), (None, "a", 3, "z"), (None, "a", 3, "z")]
    got = toolcalls.linked(calls, spark.createDataFrame(results, RESULTS), schemas).collect()
    answers = {(r["call_id"], r["position"]): [tuple(x) for x in r["results"]] for r in got if r["conv_id"] == 1 and r["status"] != "orphan"}
    assert answers == {("a", 0): [(2, "first"), (3, "later"), (3, "later")], ("b", 1): [], ("b", 5): []}
    lost = [(r["conv_id"], r["call_id"], r["position"], *(x["content"] for x in r["results"]), json.loads(r["json"])["result"]) for r in got if r["status"] == "orphan"]
    assert sorted(lost, key=str) == sorted([(c, i, p, t, t) for c, i, p, t in results[3:]], key=str)
    assert len(got) == 11 + 6


def test_no_calls(chat):
    assert toolcalls.linked(*[t.limit(0) for t in chat]).count() == 0


@pytest.mark.parametrize("size", [7, 64, 65536])
def test_token_counts(odd, documents, size):
    docs = odd.select("doc_id", "text").union(documents.filter("length(text) < 4000").select("doc_id", "text"))
    encode = tokencount.encoder(tokencount.VOCABULARY).encode_ordinary
    want = sorted((str(r["doc_id"]), len(encode(r["text"] or ""))) for r in docs.collect())
    got = tokencount.count_tokens(tokencount.write_tokens(docs.repartition(3), size=size))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == want


def test_no_tokens(none):
    assert tokencount.count_tokens(tokencount.write_tokens(none)).count() == 0


def chain(spark, edges, calls):
    rows = [(1, c, p, "f", "{}", [a for a, b in edges if b == c]) for c, p in calls]
    table = spark.createDataFrame(rows, "conv_id long, call_id string, position long, name string, arguments string, parents array<string>")
    return {r["call_id"]: (r["level"], r["cyclic"]) for r in toolcalls.levels(table).collect()}


@pytest.mark.parametrize("forward", [True, False])
def test_levels_of_a_deep_chain(spark, forward):
    """A call waits for the two before it: a thousand levels, whatever the order of positions."""
    n = 1000
    edges = [(f"c{i - d}", f"c{i}") for i in range(n) for d in (1, 2) if i >= d]
    got = chain(spark, edges, [(f"c{i}", i if forward else n - i) for i in range(n)])
    assert got == {f"c{i}": (i, False) for i in range(n)}


def test_levels_of_any_graph(spark):
    """Longest ways over random edges, cycles, what lies behind them, unknown parents and repeated calls."""
    rng = random.Random(9)
    edges = [(f"a{i}", f"a{j}") for j in range(24) for i in rng.sample(range(j), min(j, rng.choice((0, 1, 1, 2, 3))))]
    edges += [("x", "y"), ("y", "z"), ("z", "x"), ("x", "v"), ("y", "v"), ("z", "v"), ("v", "w"), ("a0", "x"), ("x", "z"), ("z", "y"), ("y", "x"), ("a1", "y"), ("a1", "z"), ("s", "s"), ("nowhere", "a0")]
    names = [f"a{i}" for i in range(24)] + ["x", "y", "z", "v", "w", "s", "alone"]
    rng.shuffle(names)
    level = {}
    for j in range(24):
        level[f"a{j}"] = max((level[a] + 1 for a, b in edges if b == f"a{j}" and a in level), default=0)
    want = {k: (v, False) for k, v in level.items()} | {k: (0, True) for k in "xyzvws"} | {"alone": (0, False)}
    assert chain(spark, edges, [(c, i) for i, c in enumerate(names)] + [("a3", 99)]) == want


def test_very_long_payload(spark):
    """Payloads of megabytes, one of them repeated, come back whole."""
    long = "<p>é</p>" * 400_000
    rows = [(1, "http://a.b/x", long, "2024-01-01T00:00:00Z"), (2, "http://a.b/y", long, "2024-01-02T00:00:00Z"), (3, "http://a.b/z", None, "2024-01-03T00:00:00Z")]
    got = {r["page_id"]: r for r in warc.archived(spark.createDataFrame(rows, PAGES)).collect()}
    digest = b32encode(hashlib.sha1(long.encode()).digest()).decode()
    assert {k: (r["payload_bytes"], r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: (len(long.encode()), "response", None), 2: (len(long.encode()), "revisit", 1), 3: (0, "response", None)}
    assert got[1]["payload_digest"] == got[2]["payload_digest"] == digest


def test_registered_calls_have_levels_and_problems(spark):
    rows = QUERIES["op7_tool_calls"](spark, "/root/testdata/sf0.001").collect()
    assert max(r["level"] for r in rows) >= 3 and len({r["problems"] for r in rows}) >= 5
