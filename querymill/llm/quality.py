"""Quality by weak supervision: rules vote good, bad or abstain, EM estimates how often each is right.

Features come from array functions inside the row, so a document of any length stays in its own row and
nothing about it is shuffled. Documents reach the model as counts of vote patterns: with J rules there are
at most 2 * 3^J patterns, whatever the corpus, so EM runs on a bounded table inside one SQL expression. Documents that fail
the base rules are the bad ones known beforehand; they anchor the class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.examples import let
from querymill.llm.text import packed, staged, words

WINDOW = 5
#: Symbol characters of the base rules.
SYMBOLS = "#*$%&|<>"
#: Limits of each rule: bad beyond the first, good within the second, no vote between.
RULES = {
    "length": ("n_words < 20", "n_words >= 50"),
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0"),
    "repeats": ("n_repeat_words > 0.2 * n_words", "n_repeat_words <= 0.05 * n_words"),
    "capitals": ("n_capitals > 0.5 * n_letters", "n_capitals <= 0.2 * n_letters"),
    "letters": ("n_letters < 0.6 * word_chars", "n_letters >= 0.75 * word_chars"),
    "word_size": ("word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 2.5 * n_words AND 12 * n_words"),
}
STEPS = 25
#: Share of good documents, and how often a rule says bad, nothing and good of a good and of a bad document, before any are seen; these count as
#: PSEUDO documents of each class.
PRIOR, PSEUDO = 0.8, 0.1
ON_GOOD, ON_BAD = (0.005, 0.1, 0.895), (0.25, 0.2, 0.55)
PARTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")


def features(docs: DataFrame) -> DataFrame:
    """docs with the columns of PARTS. Its text column is ``text``; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in docs.columns]
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    step = docs.select(*kept, words(text).alias("_w"), lines.alias("_lines"))
    step = step.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_hw"),
    )
    n = F.size("_hw")
    window = lambda i: F.xxhash64(*[F.get("_hw", i + k) for k in range(WINDOW)])
    step = step.withColumn("_h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    paired = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    step = step.withColumn("_m", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), paired)).drop("_hw", "_h")
    at = lambda k: F.get("_m", k)
    twice = lambda k: F.coalesce(at(k)["h"] == at(k - 1)["h"], F.lit(False)) | F.coalesce(at(k)["h"] == at(k + 1)["h"], F.lit(False))
    found = F.filter(F.sequence(F.lit(0), F.size("_m") - 1), twice)
    step = step.withColumn("_p", F.sort_array(F.transform(found, lambda k: at(k)["p"]))).drop("_m")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    grown = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return step.withColumn("n_repeat_words", F.coalesce(F.aggregate("_p", start, grown, lambda a: a["n"]), F.lit(0).cast("long"))).drop("_p")


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def votes() -> Column:
    """One number a rule: 1 good, -1 bad, 0 abstains; a document without words gets bad votes only by length."""
    return F.array(*[F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for bad, good in RULES.values()])


def posteriors(patterns: DataFrame, steps: int = STEPS) -> DataFrame:
    """(votes, base_failed, n) -> (votes, base_failed, p_good), by EM over what each rule says of good and of bad documents, and the share of good ones.

    Rules are independent given the class; each has rates of its own for both classes, so that abstaining tells something
    too. Documents with base_failed are bad for certain: they name the classes, which so cannot change places. The table
    has at most 2 * 3^J rows.
    """
    j = len(RULES)
    said = lambda r, i: F.get(r["votes"], F.floor(i / 3).cast("int")) == i % 3 - 1
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda t, r: t + f(r))
    places = F.sequence(F.lit(0), F.lit(3 * j - 1))
    log_odds = lambda s, v: F.log(s["prior"] / (1 - s["prior"])) + F.aggregate(
        F.transform(v, lambda x, k: F.log(F.get(s["good"], 3 * k + x + 1) / F.get(s["bad"], 3 * k + x + 1))), F.lit(0.0), lambda t, x: t + x
    )
    sure = lambda s, r: F.when(r["base_failed"], 0.0).otherwise(1 / (1 + F.exp(-log_odds(s, r["votes"]))))
    weighed = lambda s: F.transform("pats", lambda r: F.struct(r["votes"].alias("votes"), r["base_failed"].alias("base_failed"), r["n"].cast("double").alias("n"), sure(s, r).alias("q")))

    def fitted(a: Column, share: Callable[[Column], Column], start: tuple) -> Column:
        first = F.array(*[F.lit(x) for x in start * j])
        mass = let(total(a, lambda r: share(r) * r["n"]), lambda all_: F.transform(places, lambda i: (total(a, lambda r: F.when(said(r, i), share(r) * r["n"]).otherwise(0.0)) + PSEUDO * F.get(first, i)) / (all_ + PSEUDO)))
        return mass

    prior = lambda a: (total(a, lambda r: r["q"] * r["n"]) + PSEUDO * PRIOR) / (total(a, lambda r: r["n"]) + PSEUDO)
    state = lambda p, good, bad, post: F.struct(p.alias("prior"), good.alias("good"), bad.alias("bad"), post.alias("post"))
    none = F.expr("cast(array() AS array<struct<votes: array<int>, base_failed: boolean, n: double, q: double>>)")
    start = state(F.lit(PRIOR), F.array(*[F.lit(x) for x in ON_GOOD * j]), F.array(*[F.lit(x) for x in ON_BAD * j]), none)
    # odd steps weigh the patterns, even steps fit the parameters
    step = lambda s, i: state(
        F.when(i % 2 == 1, s["prior"]).otherwise(prior(s["post"])),
        F.when(i % 2 == 1, s["good"]).otherwise(fitted(s["post"], lambda r: r["q"], ON_GOOD)),
        F.when(i % 2 == 1, s["bad"]).otherwise(fitted(s["post"], lambda r: 1 - r["q"], ON_BAD)),
        F.when(i % 2 == 1, weighed(s)).otherwise(s["post"]),
    )
    done = F.aggregate(F.sequence(F.lit(1), F.lit(2 * steps + 1)), start, step, lambda s: s["post"])
    gathered = patterns.agg(F.collect_list(F.struct("votes", "base_failed", "n")).alias("pats"))
    return gathered.select(F.explode(done).alias("r")).select(F.col("r.votes").alias("votes"), F.col("r.base_failed").alias("base_failed"), F.col("r.q").alias("p_good"))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with features, base_failed, votes, p_good and kept (false if base_failed, else p_good >= threshold).

    Null texts count as empty: no words, base_failed. Equal rows get equal verdicts; an empty table stays
    empty. The features are staged once, so texts are read once.
    """
    return judged_features(features(docs), threshold)


def judged_features(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """As judged(), from the table of features(), which may lack the texts by now."""
    found = staged(found.withColumn("base_failed", base_failed()).withColumn("votes", votes()), "quality")
    fitted = staged(posteriors(found.groupBy("votes", "base_failed").agg(F.count("*").alias("n"))), "quality-model")
    # at most 2 * 3^J rows, whatever the corpus
    scored = found.join(F.broadcast(fitted), ["votes", "base_failed"], "left")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with their own columns only."""
    rows = packed(docs).withColumn("text", F.col("_row.text"))
    return judged(rows, threshold).filter("kept").select("_row.*")
