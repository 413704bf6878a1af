"""Spelling variants by finite-state composition.

The vocabulary is an acceptor; composed with a transducer that makes one edit and with the acceptor again, it
accepts the pairs of words that are one edit apart. The machine is cut at its initial states: two words with one
edit share the first half of the shorter one, or all of it behind the first half. A part is the words behind one
such half, read forwards or backwards; it holds only words of two lengths, builds their minimal acceptors and lists the pairs that
the composition accepts. Parts beyond a bound are cut into blocks that meet two by two, so no pair is lost.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.runs import runs
from querymill.llm.text import broadcast_if_small, staged

#: Fixed value: letters of a word.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_COUNT, RATIO, DROP = 6, 5, 5, 199
#: Words of a part that one task composes at a time.
BLOCK = 20_000
FOUND = "word string, n_near long, n long, form string"


def lowered(text: Column) -> Column:
    """Only A to Z in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def occurrences(docs: DataFrame, drop: int = DROP) -> DataFrame:
    """docs (doc_id, text) -> a row ``word`` for every run of letters, some with one letter deleted as its checksum says.

    Null texts have none; a null id counts as an empty one.
    """
    run = F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(LETTERS), F.lit(0))).alias("run")
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    found = found.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, chars: int = LEAST_CHARS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words with at least so many code points and occurrences."""
    return words.filter(F.length("word") >= chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


def parts(vocab: DataFrame, chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(part, lo, hi, is_short, tail, word, n, blk): every word in the parts of its length and of the length below.

    ``tail`` is what the part leaves open of the word, backwards in parts that share an end.
    """
    size = F.length("word")

    def views(least: Column, short: bool) -> list[Column]:
        half = F.floor(least / 2).cast("int")
        head = F.struct(F.concat(least, F.lit("<"), F.substring(F.col("word"), F.lit(1), half)).alias("part"), F.lit(short).alias("is_short"), F.substring(F.col("word"), half + 1, size).alias("tail"))
        end = F.struct(
            F.concat(least, F.lit(">"), F.substring(F.col("word"), size - least + half + 1, size)).alias("part"), F.lit(short).alias("is_short"),
            F.reverse(F.substring(F.col("word"), F.lit(1), size - least + half)).alias("tail"),
        )
        return [head, end]

    seen = F.when(size > chars, F.array(*views(size, True), *views(size - 1, False))).otherwise(F.array(*views(size, True)))
    rows = vocab.select("word", "n", F.explode(seen).alias("v")).select("v.*", "word", "n")
    hot = staged(rows.groupBy("part").agg(F.count("*").alias("c")).filter(F.col("c") > block).select("part", F.ceil(F.col("c") / block).cast("int").alias("many")), "hot-parts")
    cut = rows.join(broadcast_if_small(hot), "part", "left").withColumn("blk", F.pmod(F.xxhash64("word"), F.coalesce("many", F.lit(1))).cast("int"))
    met = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.coalesce("many", F.lit(1)) - 1)))
    return met.select("part", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "is_short", "tail", "word", "n", "blk")


class Acceptor:
    """Minimal deterministic acceptor of a sorted list of different texts: equal right languages are one state."""

    def __init__(self, texts: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def state(final: bool, arcs: dict[str, int]) -> int:
            key = (final, *arcs.items())
            if key not in known:
                known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return known[key]

        # the path of the last text: per depth [is final, arcs so far]; states below a fork are closed
        path: list[list] = [[False, {}]]
        last = ""
        for text in texts:
            same = 0
            for a, b in zip(last, text):
                if a != b:
                    break
                same += 1
            while len(path) > same + 1:
                final, arcs = path.pop()
                path[-1][1][last[len(path) - 1]] = state(final, arcs)
            path.extend([False, {}] for _ in text[same:])
            path[-1][0] = True
            last = text
        while len(path) > 1:
            final, arcs = path.pop()
            path[-1][1][last[len(path) - 1]] = state(final, arcs)
        self.start = state(*path[0])


def common(a: Acceptor, p: int, b: Acceptor, q: int) -> Iterator[str]:
    """Texts that lead from p to an end of a and from q to an end of b: the composition after its edit."""
    stack = [(p, q, "")]
    while stack:
        p, q, said = stack.pop()
        if a.final[p] and b.final[q]:
            yield said
        there = b.arcs[q]
        for c, to in a.arcs[p].items():
            if c in there:
                stack.append((to, there[c], said + c))


def replaced(a: Acceptor, b: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs (u of a, v of b) with one letter replaced; each pair once, if a is b in one direction only."""
    stack = [(a.start, b.start, "")]
    while stack:
        p, q, said = stack.pop()
        left, right = a.arcs[p], b.arcs[q]
        for c, to in left.items():
            if c in right:
                stack.append((to, right[c], said + c))
            for d, other in right.items():
                if c < d or (c > d and a is not b):
                    for rest in common(a, to, b, other):
                        yield said + c + rest, said + d + rest


def inserted(a: Acceptor, b: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs (u of a, v of b) where v has one letter more; a letter that repeats counts as inserted at its last place."""
    stack = [(a.start, b.start, "")]
    while stack:
        p, q, said = stack.pop()
        left, right = a.arcs[p], b.arcs[q]
        for d, other in right.items():
            for rest in common(a, p, b, other):
                if not rest.startswith(d):
                    yield said + rest, said + d + rest
        for c, to in left.items():
            if c in right:
                stack.append((to, right[c], said + c))


def composer() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted parts -> what each word's near words in a part come to (FOUND): their number, and the best by n, then by spelling."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in runs(batches, 3):
            firsts = rows.column(0).to_pylist()
            los, his, shorts, tails, words, counts, blocks = (rows.column(i).to_pylist() for i in range(1, 8))
            out: list[tuple[str, int, int, str]] = []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if high - low > 1:
                    out += one_part(firsts[low], los[low] == his[low], shorts[low:high], tails[low:high], words[low:high], counts[low:high], [b == los[low] for b in blocks[low:high]])
            if out:
                w, k, n, f = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(f, pa.string())], ["word", "n_near", "n", "form"])

    return compose


def one_part(part: str, whole: bool, shorts: list[bool], tails: list[str], words: list[str], counts: list[int], is_low: list[bool]) -> list[tuple[str, int, int, str]]:
    """Near words inside a part; of two blocks, only pairs across them."""
    size, backwards = (int(part.split("<")[0]), False) if "<" in part else (int(part.split(">")[0]), True)
    half = size // 2
    sides: dict[tuple[bool, bool], dict[str, int]] = {}
    for i, tail in enumerate(tails):
        sides.setdefault((shorts[i], whole or is_low[i]), {})[tail] = i
    made = {k: Acceptor(sorted(v)) for k, v in sides.items()}
    best: dict[int, list] = {}

    def pair(i: int, j: int) -> None:
        # what shares its first half is found forwards already
        if backwards and words[i][:half] == words[j][:half]:
            return
        for x, y in ((i, j), (j, i)):
            have = best.get(x)
            if have is None:
                best[x] = [1, counts[y], words[y]]
            else:
                have[0] += 1
                if counts[y] > have[1] or (counts[y] == have[1] and words[y] < have[2]):
                    have[1:] = counts[y], words[y]

    one, two = sides.get((True, True)), sides.get((True, whole))
    if one and two:
        for u, v in replaced(made[True, True], made[True, whole]):
            pair(one[u], two[v])
    for low in (True,) if whole else (True, False):
        short, long = sides.get((True, low)), sides.get((False, whole or not low))
        if short and long:
            for u, v in inserted(made[True, low], made[False, whole or not low]):
                pair(short[u], long[v])
    return [(words[i], *found) for i, found in best.items()]


def near_words(vocab: DataFrame, chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """vocab (word, n) -> (word, n_near, form_n, form) of words with near words: how many, and the one of largest n (ties: smallest)."""
    placed = parts(vocab, chars, block).repartition("part", "lo", "hi").sortWithinPartitions("part", "lo", "hi")
    found = placed.mapInArrow(composer(), FOUND)
    best = F.min(F.struct((-F.col("n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): the last word that forms lead to, by doubling. Forms must not go in circles."""
    now = staged(forms.select("word", F.col("form").alias("to"), F.lit(True).alias("moved")), "forms")
    while not now.filter("moved").isEmpty():
        then = now.select(F.col("word").alias("at"), F.col("to").alias("next"))
        now = staged(now.join(then, F.col("to") == F.col("at"), "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
    return now.select("word", F.col("to").alias("root"))


def variants(docs: DataFrame, ratio: int = RATIO, chars: int = LEAST_CHARS, count: int = LEAST_COUNT, drop: int = DROP, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) -> word, form, root, n, n_near, form_n; other columns do not matter.

    A word's form is its near word of largest n if that is at least ``ratio`` times its own; every form has a larger n, so
    roots exist. Repeated rows count as often as they stand. No texts, no rows.
    """
    vocab = staged(vocabulary(occurrences(docs, drop), chars, count), "vocabulary")
    near = near_words(vocab, chars, block).withColumnRenamed("word", "w")
    taken = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    full = vocab.join(near, F.col("word") == F.col("w"), "left").select(
        "word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n")
    )
    full = staged(full, "near-words")
    last = roots(full.filter("form IS NOT NULL")).withColumnRenamed("word", "w")
    return full.join(last, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
