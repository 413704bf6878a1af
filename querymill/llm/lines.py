"""Line dedup across documents: a line goes if an equal or nearly equal line stands earlier.

Lines are compared by their words. Equal lines meet by hash. Lines of at least ``least`` words also go for
one inserted, deleted or replaced word, found by deletion neighbourhoods: every line emits the hash of
itself without each word. A replaced word leaves equal variants at the same place, a deleted word makes a
variant equal to the shorter line, so both kinds are settled by minima over groups of equal hashes,
without pairs inside a group. To keep the number of variants low, a coarse neighbourhood (lines without
their first or second half) first selects the distinct lines that can have a neighbour at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.text import broadcast_if_small, packed, staged, words

LEAST = 8
#: Odd base of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
PLACE = ("ord", "th", "pos")


def line_array(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def order_key(doc_id: Column) -> Column:
    """Null ids come last."""
    return F.coalesce(doc_id, F.lit(2**63 - 1))


def placed_lines(docs: DataFrame, *more: Column) -> DataFrame:
    """docs (doc_id, text) -> a row a line that has words: ord, th (hash of the text), pos, w (words)."""
    each = docs.select(order_key(F.col("doc_id")).alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.posexplode_outer(line_array(F.col("text"))).alias("pos", "line"), *more)
    return each.select("ord", "th", "pos", words(F.col("line")).alias("w")).filter(F.size("w") > 0)


def half_keys(w: Column) -> Column:
    """Keys of a line without its second and without its first half; lines one word apart share one of them."""
    n = F.size(w)
    m, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    key = lambda k: [F.xxhash64(F.lit("head"), F.slice(w, 1, k)), F.xxhash64(F.lit("tail"), F.slice(w, n - k + 1, k))]
    return F.array_distinct(F.array(*key(m), *key(less)))


def place() -> Column:
    return F.struct(*PLACE)


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ord, th, pos, hw: hashes of words) -> (v, cut, ord, th, pos): the line without word ``cut``, and whole (cut -1)."""
    base, inverse = np.uint64(BASE), np.uint64(INVERSE)
    for batch in batches:
        column = batch.column(3)
        values = np.asarray(column.values).view(np.uint64)
        starts = np.asarray(column.offsets)
        for i in range(batch.num_rows):
            x = values[starts[i] : starts[i + 1]]
            n = len(x)
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base)])) if n > 1 else np.ones(n, np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers, dtype=np.uint64)])
            without = sums[:-1] + (sums[-1] - sums[1:]) * inverse
            v = np.concatenate([sums[-1:], without])
            v ^= v >> np.uint64(29)
            same = [pa.array(np.full(n + 1, batch.column(k)[i].as_py(), np.int64 if k < 2 else np.int32)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(np.arange(-1, n, dtype=np.int32)), *same], ["v", "cut", *PLACE])


def near_lines(lines: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Distinct lines that stand one word from an earlier distinct line: (ord, th, pos) of their first place."""
    first = lines.filter(F.col("n") >= least).groupBy("h1", "h2").agg(F.min(F.struct(*PLACE, "keys")).alias("f"))
    coarse = first.select("h1", F.explode("f.keys").alias("key"))
    shared = staged(coarse.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key"), "line-halves")
    chosen = first.select("f.ord", "f.th", "f.pos", F.explode("f.keys").alias("key")).join(broadcast_if_small(shared), "key", "left_semi")
    chosen = staged(chosen.groupBy("ord", "th").agg(F.collect_set("pos").alias("at")).select(F.col("ord").alias("o"), F.col("th").alias("t"), "at"), "line-chosen")
    keyed = docs.select("doc_id", "text").withColumn("ord", order_key(F.col("doc_id"))).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    held = keyed.join(broadcast_if_small(chosen), (F.col("ord") == F.col("o")) & (F.col("th") == F.col("t")))
    texts = held.select("ord", "th", F.explode("at").alias("pos"), line_array(F.col("text")).alias("all")).select("ord", "th", "pos", words(F.get("all", F.col("pos"))).alias("w"))
    texts = staged(texts.dropDuplicates(list(PLACE)), "line-words")
    rows = texts.select(*PLACE, F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    every = staged(rows.mapInArrow(variants, "v long, cut int, ord long, th long, pos int"), "line-variants")
    met = every.groupBy("v").agg(F.min(place()).alias("a"), F.max(place()).alias("b")).filter("a <> b").select("v")
    close = staged(every.join(broadcast_if_small(staged(met, "line-met")), "v"), "line-close")
    # a replaced word: equal variants cut at the same place, all but the earliest go
    cut = close.filter("cut >= 0")
    twins = cut.join(cut.groupBy("v", "cut").agg(F.min(place()).alias("by")), ["v", "cut"]).select(place().alias("x"), "by")
    # a deleted word: a whole line against the variants equal to it, each side goes if the other is earlier
    whole = close.filter("cut < 0").select("v", place().alias("whole"))
    longer = cut.join(whole, "v").select(place().alias("x"), F.col("whole").alias("by"))
    shorter = whole.join(cut.groupBy("v").agg(F.min(place()).alias("by")), "v").select(F.col("whole").alias("x"), "by")
    pairs = twins.union(longer).union(shorter).filter(F.col("by") < F.col("x")).distinct()
    own = texts.select(place().alias("x"), F.col("w").alias("wx"))
    other = texts.select(place().alias("by"), F.col("w").alias("wy"))
    checked = pairs.join(own, "x").join(other, "by").filter(one_word_apart(F.col("wx"), F.col("wy")))
    return checked.select("x.*").distinct()


def one_word_apart(a: Column, b: Column) -> Column:
    """Edit distance over words is at most 1: equal but for one place, found from the first difference."""
    n = F.least(F.size(a), F.size(b))
    differ = F.filter(F.arrays_zip(a.alias("p"), b.alias("q")), lambda z: ~z["p"].eqNullSafe(z["q"]))
    at = F.when(F.size(differ) == 0, n).otherwise(F.array_position(F.zip_with(a, b, lambda p, q: p.eqNullSafe(q)), False).cast("int") - 1)
    rest = lambda w, k: F.slice(w, at + 1 + k, F.greatest(F.size(w) - at - k, F.lit(0)))
    same = (F.size(a) == F.size(b)) & (rest(a, 1) == rest(b, 1))
    return same | ((F.size(a) == F.size(b) + 1) & (rest(a, 1) == rest(b, 0))) | ((F.size(b) == F.size(a) + 1) & (rest(a, 0) == rest(b, 1)))


def dropped_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(ord, th, exact, near): positions of the lines to drop, for each document that loses any; staged."""
    each = placed_lines(docs.select("doc_id", "text"))
    lines = staged(
        each.select("ord", "th", "pos", F.size("w").alias("n"), F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("line"), "w").alias("h2"), F.when(F.size("w") >= least, half_keys(F.col("w"))).alias("keys")),
        "lines",
    )
    seen = lines.groupBy("h1", "h2").agg(F.min(place()).alias("a"), F.max(place()).alias("b")).filter("a <> b")
    again = broadcast_if_small(staged(seen.select("h1", "h2", F.col("a").alias("first")), "line-repeats"))
    exact = lines.join(again, ["h1", "h2"]).filter(place() > F.col("first")).select(*PLACE, F.lit(True).alias("equal"))
    near = near_lines(lines, docs, least).select(*PLACE, F.lit(False).alias("equal"))
    by_doc = exact.union(near).distinct().groupBy("ord", "th")
    lists = by_doc.agg(F.collect_list(F.when(F.col("equal"), F.col("pos"))).alias("exact"), F.collect_list(F.when(~F.col("equal"), F.col("pos"))).alias("near"))
    return staged(lists.select(F.col("ord").alias("_o"), F.col("th").alias("_t"), "exact", "near"), "line-drops")


def deduped(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs (doc_id, text, any others) with clean (the text without repeated lines), n_lines, n_exact and n_near.

    Order is by doc_id (null last), then a hash of the text, then the line's position. Rows that repeat doc_id and text
    tie and lose the same lines. Lines without words stay. Null texts stay null. Lines of fewer than
    ``least`` words go for equal lines only.
    """
    drops = broadcast_if_small(dropped_lines(docs, least))
    keyed = docs.withColumn("_ord", order_key(F.col("doc_id"))).withColumn("_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(drops, (F.col("_ord") == F.col("_o")) & (F.col("_th") == F.col("_t")), "left").withColumn("_all", line_array(F.col("text")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), F.concat("exact", "near"))
    joined = joined.withColumn("_stay", F.when(F.col("exact").isNotNull(), stay))
    clean = F.when(F.col("_stay").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_stay", lambda i: F.get("_all", i)), "\n"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    counts = [count("_all").alias("n_lines"), F.when(F.col("exact").isNull(), 0).otherwise(count("exact")).cast("long").alias("n_exact"), F.when(F.col("near").isNull(), 0).otherwise(count("near")).cast("long").alias("n_near")]
    return joined.select(*docs.columns, clean.alias("clean"), *counts)


def drop_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs without repeated lines; n_chars follows the text. Documents that lose all their words go."""
    rows = packed(docs).withColumn("doc_id", F.col("_row.doc_id")).withColumn("text", F.col("_row.text"))
    found = deduped(rows, least)
    changed = (F.col("n_exact") + F.col("n_near")) > 0
    found = found.filter(~changed | (F.size(words(F.col("clean"))) > 0))
    new = {"text": F.col("clean"), "n_chars": F.when(changed, F.length("clean").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if new.get(c) is not None else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
