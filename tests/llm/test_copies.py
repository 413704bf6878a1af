"""Near copies and repeated lines against plain Python."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from querymill.llm import jaccard, lines
from querymill.llm.components import components

from .test_native import both, words


def grams(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """Row numbers -> (least id of the class, links to other texts), all pairs of different texts."""
    texts = sorted({tuple(words(t)) for _, t in rows if words(t)})
    sets = [grams(" ".join(t)) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    place = {t: k for k, t in enumerate(texts)}
    ids = defaultdict(list)
    for d, t in rows:
        if words(t) and d is not None:
            ids[find(place[tuple(words(t))])].append(d)
    return [((d, 0) if not words(t) else (min(ids[find(place[tuple(words(t))])]), links[place[tuple(words(t))]])) for d, t in rows]


def test_classes(odd, documents):
    docs = both(odd, documents).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = sorted((str(d), *map(str, c)) for (d, _), c in zip(rows, classes(rows)))
    got = sorted((str(r["doc_id"]), str(r["class_id"]), str(r["n_links"])) for r in jaccard.classed(docs).collect())
    assert got == want


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 8)
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.when(i == F.col("id") % 60, F.concat(F.lit("x"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("w"), i.cast("string")))))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = [tuple(r) for r in docs.collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classed(docs).collect()}
    assert got == {d: c for (d, _), c in zip(rows, classes(rows))}


def test_one_of_each_class_stays(odd, none):
    kept = jaccard.keep_one(odd)
    assert kept.dtypes == odd.dtypes
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = {(d, " ".join(words(t))) for (d, t), (c, _) in zip(rows, classes(rows)) if d == c}
    got = [(r["doc_id"], " ".join(words(r["text"]))) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert jaccard.keep_one(none).count() == 0


def test_bands_reach_the_recall():
    b = jaccard.bands_for(0.8, 6, 0.999)
    assert 1 - (1 - 0.8**6) ** b >= 0.999 > 1 - (1 - 0.8**6) ** (b - 1)


def test_grams_of_many_texts_equal_those_of_one():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 40).astype(np.uint64)
    starts = np.array([0, 0, 3, 8, 30, 40])
    g, begin = jaccard.grams(values, starts)
    for i in range(5):
        alone, _ = jaccard.grams(values[starts[i] : starts[i + 1]], np.array([0, starts[i + 1] - starts[i]]))
        assert (alone == g[begin[i] : begin[i + 1]]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 100), (7, 7), (200, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 100: 50, 200: 50}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def cleaned(rows, th):
    """The rule with loops: lines by (id, hash of text, position), gone if equal to or one word from an earlier line."""
    order = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for (d, t), h in zip(rows, th):
        for p, x in enumerate((t or "").split("\n")):
            w = tuple(words(x))
            if w:
                first[w] = min(first.get(w, (2**64, 0, 0)), (order(d), h, p))
    long = [w for w in first if len(w) >= lines.LEAST]
    near = set()
    for a in long:
        for b in long:
            if first[b] < first[a] and abs(len(a) - len(b)) <= 1 and apart(a, b):
                near.add(a)
    out = []
    for (d, t), h in zip(rows, th):
        if t is None:
            out.append(None)
            continue
        keep = [x for p, x in enumerate(t.split("\n")) if not words(x) or ((order(d), h, p) == first[tuple(words(x))] and tuple(words(x)) not in near)]
        out.append("\n".join(keep))
    return out


def test_lines(odd, documents):
    docs = both(odd, documents.filter("length(text) < 6000")).select("doc_id", "text")
    seen = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()
    want = cleaned([(r["doc_id"], r["text"]) for r in seen], [r["th"] for r in seen])
    got = lines.deduped(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["clean"])) for r in got) == sorted((str(r["doc_id"]), str(t)) for r, t in zip(seen, want))
    assert sum(r["n_near"] for r in got) >= 2


def test_near_lines(spark):
    base = [f"w{i}" for i in range(10)]
    rows = [
        (1, " ".join(base)),
        (2, " ".join(base[:4] + ["x"] + base[5:])),
        (3, " ".join(base[:9])),
        (4, " ".join(base[:3] + ["y"] + base[3:])),
        (5, " ".join(base[:2] + ["p"] + base[3:6] + ["q"] + base[7:])),
        (6, " ".join(base[:7])),
    ]
    got = {r["doc_id"]: r["n_near"] for r in lines.deduped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}


def test_dropped_lines_keep_columns(odd, none):
    out = lines.drop_lines(odd)
    assert out.dtypes == odd.dtypes
    got = out.filter("n_chars IS NOT NULL AND text IS NOT NULL AND doc_id > 5").select("doc_id", "text", "n_chars").collect()
    assert got and all(len(r["text"]) == r["n_chars"] for r in got)
    assert lines.drop_lines(none).count() == 0
