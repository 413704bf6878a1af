"""Benchmark decontamination by spaced seeds.

A mask keeps some positions of a span of tokens and ignores the others, so a seed survives a substituted
token at an ignored position. Seeds of documents meet seeds of benchmark items by hash; every hit names
a diagonal, along which document and item are compared token by token, tolerating substitutions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.text import broadcast_if_small, packed, staged, text_key, tokens

MASKS = ("110111011", "111010111")
SPAN = len(MASKS[0])
#: With this one beside MASKS, every stretch of SPAN to OVERLAP tokens that the verifier accepts holds a seed, wherever its misses are.
SHORT = "111101"
OVERLAP, MISSES = 13, 2


def whole(size: int) -> str:
    """The mask of an item of fewer than SPAN tokens: all of it."""
    return "1" * size


def seeds(hashed: Column, masks: tuple[str, ...]) -> Column:
    """Hashes of all masks at all positions: the k-th mask at position i stands at i * len(masks) + k, null where it passes the end."""
    n, least = F.size(hashed), min(len(m) for m in masks)
    one = lambda i, m: F.when(i + len(m) <= n, F.xxhash64(*[F.get(hashed, i + k) for k, c in enumerate(m) if c == "1"], F.lit(m)))
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - least, F.lit(0))), lambda i: F.array(*[one(i, m) for m in masks]))
    return F.when(n >= least, F.flatten(every)).otherwise(F.array().cast("array<bigint>"))


def seeded(texts: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """texts (key, text) -> a row a seed: key, seed, at (position of its span).

    The outer form keeps the optimizer from testing the size of the array below, which would compute it twice;
    texts without seeds give a null seed, which joins nothing.
    """
    hashed = texts.select("key", tokens(F.col("text")).alias("t")).select("key", F.transform("t", lambda x: F.xxhash64(x)).alias("hw"))
    rows = hashed.select("key", seeds(F.col("hw"), masks).alias("s")).select("key", F.posexplode_outer("s").alias("p", "seed"))
    return rows.select("key", "seed", F.floor(F.col("p") / len(masks)).cast("int").alias("at"))


def overlaps(doc: Column, item: Column, shift: Column) -> Column:
    """True if some stretch of the item (OVERLAP tokens, or all if it has fewer) lies in the document at this shift with at most MISSES substitutions, MISSES * n / OVERLAP for items of n tokens from SPAN to OVERLAP, and none for shorter ones."""
    same = F.transform(item, lambda x, j: F.when(F.get(doc, shift + j) == x, 1).otherwise(0))
    size = F.least(F.lit(OVERLAP), F.size(item))
    misses = F.when(F.col("_size") < SPAN, 0).otherwise(F.floor(F.col("_size") * MISSES / OVERLAP))
    enough = lambda i: F.aggregate(F.slice("_same", i, F.col("_size")), F.lit(0), lambda a, x: a + x) >= F.col("_size") - misses
    return F.struct(same.alias("same"), size.alias("size")), F.exists(F.sequence(F.lit(1), F.size("_same") - F.col("_size") + 1), enough)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, items): texts of docs that hold a benchmark passage, by text_key, and the item ids, sorted.

    docs: text; benchmark: item_id, text. Items of fewer than SPAN tokens are searched as a whole, without substitutions;
    items without tokens leak nowhere. Null texts are empty. Copies of a text are verified once. Items with null id count, but leave no id in the list.
    """
    items = staged(benchmark.select("item_id", text_key(F.col("text")).alias("ikey"), F.coalesce("text", F.lit("")).alias("itext")), "items")
    texts = items.select(F.col("ikey").alias("key"), F.col("itext").alias("text")).distinct()
    sizes = F.size(tokens(F.col("text")))
    short = sorted(r["n"] for r in texts.select(sizes.alias("n")).distinct().filter(F.col("n").between(1, SPAN - 1)).collect())
    masks = (*MASKS, SHORT)
    parts = [seeded(texts.filter(sizes >= SPAN), masks)] + [seeded(texts.filter(sizes == n), (whole(n),)) for n in short]
    every = reduce(DataFrame.union, parts).filter("seed IS NOT NULL")
    wanted = staged(every.select(F.col("key").alias("ikey"), "seed", F.col("at").alias("item_at")).distinct(), "item-seeds")
    own = docs.select(text_key(F.col("text")).alias("key"), F.col("text"))
    hits = seeded(own, (*masks, *map(whole, short))).join(broadcast_if_small(wanted), "seed")
    shifts = staged(hits.select("key", "ikey", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    held = broadcast_if_small(staged(shifts.select("key").distinct(), "hit-texts"))
    full = own.join(held, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("key", tokens(F.col("text")).alias("doc"))
    item_tokens = texts.select(F.col("key").alias("ikey"), tokens(F.col("text")).alias("item"))
    both = shifts.join(full, "key").join(item_tokens, "ikey")
    facts, verdict = overlaps(F.col("doc"), F.col("item"), F.col("shift"))
    checked = both.select("key", "ikey", facts.alias("f")).select("key", "ikey", F.col("f.same").alias("_same"), F.col("f.size").alias("_size"))
    found = checked.filter(verdict).select("key", "ikey").distinct()
    named = found.join(items.select("ikey", "item_id").distinct(), "ikey").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return staged(named, "leaks")


def marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with ``items``: ids of the benchmark items it leaks, null if none."""
    found = broadcast_if_small(leaks(docs.select("text"), benchmark)).withColumnRenamed("key", "_key")
    return docs.withColumn("_own", text_key(F.col("text"))).join(found, F.col("_own") == F.col("_key"), "left").drop("_own", "_key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak nothing, with their own columns only."""
    rows = packed(docs).withColumn("text", F.col("_row.text"))
    found = broadcast_if_small(leaks(docs.select("text"), benchmark))
    return rows.withColumn("key", text_key(F.col("text"))).join(found, "key", "left_anti").select("_row.*")
