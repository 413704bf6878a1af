"""Spelling variants, token alignment and sketches against plain Python."""

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.llm import alignment, sketches, spelling
from querymill.llm.queries import QUERIES

from .test_native import both, words

FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows, drop=199, least=5):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % drop else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least}
    around = {w: [x for x in n if x != w and abs(len(x) - len(w)) <= 1 and near(x, w)] for w in n}
    form = {}
    for w, xs in around.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(around[w]), n.get(form[w])))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling(spark, odd, documents):
    docs = both(odd, documents).select("doc_id", "text")
    want = spelled([tuple(r) for r in docs.collect()])
    got = sorted(tuple(r[c] for c in COLUMNS) for r in spelling.variants(docs).collect())
    assert got == want and sum(r[1] is not None for r in got) >= 3


def test_spelling_chains_and_blocks(spark):
    """Dense words of few letters, long words, chains of forms; small blocks give the same."""
    rng = random.Random(5)
    vocab = {"".join(rng.choice("abé") for _ in range(rng.choice((6, 6, 7, 8)))) for _ in range(300)} | {"x" * 4000, "x" * 3999, "aaaaaa", "aaaaaaa", "aaaaaab"}
    rows = [(1, " ".join([w] * (5 ** rng.choice((1, 1, 2, 3))))) for w in sorted(vocab)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = spelled(rows)
    assert any(r[2] not in (r[0], r[1]) for r in want)
    for block in (20_000, 7):
        assert sorted(tuple(r[c] for c in COLUMNS) for r in spelling.variants(docs, block=block).collect()) == want


def test_acceptor_is_minimal():
    a = spelling.Acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert len(a.arcs) == 5 and sorted(spelling.common(a, a.start, a, a.start)) == ["tap", "taps", "top", "tops"]


def test_spelling_of_nothing(none, odd):
    assert spelling.variants(none).count() == 0
    assert spelling.variants(odd.filter("text IS NULL")).count() == 0


def test_spelling_query(spark, documents):
    want = spelled([tuple(r) for r in documents.select("doc_id", "text").collect()])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_spelling_variants"](spark, FOLDER).collect()) == want


@pytest.fixture(scope="module")
def plain_tokens():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=alignment.VOCABULARY_B)
    letters = alignment.byte_letters()

    def encode(text):
        xs = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        ys = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            ys.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        return xs, ys

    return encode


def covered(tokens):
    end, out = 0, []
    for i, x in tokens:
        out.append((end, end + len(x), i))
        end += len(x)
    return out


def brute(rows, encode):
    facts, links = [], []
    for d, t in rows:
        a, b = encode(t) if t else ([], [])
        want = (" " + t).encode() if t else b""
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        a, b = covered(a), covered(b)
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        inside = lambda side, low, high: ",".join(str(i) for s, e, i in side[bisect_left(side, (low,)) : bisect_left(side, (high,))])
        said = ";".join(f"{inside(a, low, high)}|{inside(b, low, high)}" for low, high in zip([0, *cuts], cuts))
        mine, ends = [], [e for _, e, _ in b]
        for s, e, i in a:
            mine += [(i, j) for s2, _, j in b[bisect_right(ends, s) : bisect_left(ends, e) + 1] if s2 < e]
        facts.append((d, len(a), len(b), len(cuts), said))
        links.append(mine)
    count = Counter(p for mine in links for p in mine)
    best = defaultdict(int)
    for (i, j), c in count.items():
        best[j] = max(best[j], c)
    return [
        (d, na, nb, ng, len(mine), sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), hashlib.sha256(said.encode()).hexdigest() if na else "")
        for (d, na, nb, ng, said), mine in zip(facts, links)
    ]


ODD = ["<|endoftext|> and </s> <s> <unk>", "<0x41> ▁ x", "日本語 テスト 😀👩‍👩‍👧", "  two  spaces\n\n\ttab ", "𝒳𝓎 ٣٤ ﬁ é", "a\u0000b", "x" * 9000, " " * 3000 + "y", "don't 'S we'll"]


def key(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 3000])
def test_alignment(spark, odd, documents, plain_tokens, chunk):
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = both(odd, documents.filter("length(text) < 3000").limit(60)).select("doc_id", "text").unionByName(more)
    rows = [tuple(r) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.align(docs, chunk=chunk).collect()
    assert key(got) == key(brute(rows, plain_tokens))


def test_alignment_of_nothing(none, odd):
    assert alignment.align(none).count() == 0
    blank = alignment.align(odd.filter("text IS NULL OR text = ''")).collect()
    assert blank and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in blank)


def test_group_labels_double_over_long_chains():
    """Tokens that never end together but at the end are one group."""
    a, b = np.array([2] * 1000), np.array([1] + [2] * 999 + [1])
    of_a, of_b = alignment.group_labels(np.cumsum(a), np.cumsum(b), np.repeat(np.arange(1000), a), np.repeat(np.arange(1001), b))
    assert set(of_a) == set(of_b) == {1000}


def test_packed_links():
    lengths = np.array([0, 3, 0, 2, 1, 0])
    which = np.array([7, 2, 2, 9, 0, 5])
    back = alignment.unpacked_links(alignment.packed_links(which, lengths), lengths)
    assert back.tolist() == [2, 2, 7, 0, 9, 5]
    assert alignment.unpacked_links(b"", np.array([0, 0])).tolist() == []


def test_alignment_query(spark, documents, plain_tokens):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert key(QUERIES["op12_align_tokens"](spark, FOLDER).collect()) == key(brute(rows, plain_tokens))


def sets_of(text):
    w = words((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def joined(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = least.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), comp, d == comp))
    return out


def test_sketches(odd, documents):
    docs = both(odd, documents).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert key(sketches.components_of(docs).collect()) == key(joined(rows))


def edited(rng, w, times):
    w = list(w)
    for _ in range(times):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("block", [sketches.BLOCK, 5])
def test_sketches_of_copies_chains_and_templates(spark, block):
    """Copies with a few edits, chains that only neighbours link, texts that share a passage but are different, short texts."""
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, base = [], say(150)
    texts += [base] + [edited(rng, base, rng.choice((1, 2, 3, 4, 5))) for _ in range(60)]
    link = say(200)
    for _ in range(40):
        texts.append(list(link))
        link = edited(rng, link, 4)
    passage = say(90)
    texts += [passage + say(rng.choice((15, 25, 40))) for _ in range(40)]
    for n in (3, 4, 5, 9, 20, 51, 52, 64, 70, 80):
        short = say(n)
        texts += [short, short + say(1), short[1:], short[: n // 2] + say(1) + short[n // 2 + 1 :]]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert key(sketches.components_of(docs, block=block).collect()) == key(joined(rows))


def test_sketches_lose_little():
    c = sketches.least_shared()
    rng = np.random.default_rng(1)
    shared = rng.hypergeometric(800, 200, sketches.KEPT, 200_000)
    assert c <= shared.min() and 20 <= c <= 40


def test_sketches_of_nothing(none):
    assert sketches.components_of(none).count() == 0


def test_shared_counts():
    left, right = [np.array([1, 5, 9]), np.array([], np.int64)], [np.array([9, 5]), np.array([2])]
    assert sketches.shared_counts(left, right).tolist() == [[2, 0], [0, 0]]
    assert (sketches.shared_counts(left + right) - np.diag([3, 0, 2, 1]))[:3, :3].tolist() == [[-1, 0, 2], [0, 0, 0], [2, 0, 0]]
    assert sketches.shared_counts(right, width=1)[0, 1] == 0


def test_least_roots():
    linked = np.zeros((6, 6), bool)
    for i, j in ((0, 3), (3, 4), (1, 5)):
        linked[i, j] = linked[j, i] = True
    assert sketches.least_roots(linked).tolist() == [0, 1, 2, 0, 0, 1]


def test_other_columns_do_not_matter(odd):
    """Columns with names of helpers change nothing."""
    docs = odd.withColumn("v", F.lit(1)).withColumn("word", F.lit("x")).withColumn("chunk", F.lit(2)).withColumn("kept", F.lit(3))
    for run in (spelling.variants, alignment.align, sketches.components_of):
        assert key(run(docs).collect()) == key(run(docs.select("doc_id", "text")).collect())
