"""Mix sources to target weights by weighted sampling without replacement.

Every document draws the key -ln(u) / weight (Efraimidis and Spirakis), u from an md5 of seed, id and
text, so reruns agree. A source first passes through whole epochs; the rest of its target goes to its
documents in the order of the keys, until the prefix sum of sizes reaches the budget. The document
on the border gives its first words only, so that targets are met exactly.

A source may hold any share of the rows: its keys are cut into slices, sizes are summed per slice, and
only the rows of one slice are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.llm.text import staged, words

#: Weights by the code-point order of sources, repeating.
CYCLE = (5.0, 2.0, 1.0)
SLICES = 4096


def letter_share(text: Column) -> Column:
    """Share of letters among all characters, at least 0.01: a cheap quality weight."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.01), F.coalesce(F.try_divide(letters, F.length(text)), F.lit(0.0)))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1] out of 52 bits of an md5."""
    head = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])), 1, 13)
    return (F.conv(head, 16, 10).cast("long") + 1) / F.lit(float(2**52))


def cycled_weights(sources: DataFrame) -> DataFrame:
    """A weight for each source: CYCLE by code point, null last. One row a source, so one task orders them."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    at = F.row_number().over(order)
    chosen = F.lit(CYCLE[2])
    for i in (0, 1):
        chosen = F.when(at % 3 == i + 1, CYCLE[i]).otherwise(chosen)
    return sources.withColumn("share", chosen)


def water_targets(sources: DataFrame, budget: float, ceiling: float) -> DataFrame:
    """Targets of sources (source, source_size, share): shares of budget x all sizes, none above ceiling x its size.

    In the order of ceiling / share the full sources form a prefix: a source is full if the level that
    the later ones would reach is at least its own. The others get share x level.
    """
    total = Window.partitionBy()
    before = Window.orderBy("ratio", "source_size", "share", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(ceiling))
    level = (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_shares") - F.coalesce(F.sum("share").over(before), F.lit(0.0)))
    ranked = (
        sources.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("share"))
        .withColumn("all_words", F.sum("source_size").over(total) * F.lit(float(budget)))
        .withColumn("all_shares", F.sum("share").over(total))
        .withColumn("full", F.col("ratio") <= level)
    )
    open_words = F.col("all_words") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(total)
    open_shares = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("share"))).over(total)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.try_divide(F.col("share") * open_words, open_shares)))
    return ranked.select("source", "source_size", "share", target.alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, weights_of=cycled_weights, budget: float = 1.5, ceiling: float = 2.0, seed: str = "mix") -> DataFrame:
    """Manifest of the mix: doc_id, source, size, source_size, target, epochs, taken.

    docs: doc_id, text, source. weight: quality weight of a row, above 0 (default: letter_share).
    Null texts and texts without words have size 0 and give nothing. A null source is a source of its own,
    weighted last. Rows that repeat a doc_id and text are separate rows; which of them comes
    first does not change the table of results. An empty table gives an empty manifest.
    """
    text = F.col("text")
    quality = F.greatest(F.lit(1e-6), F.coalesce(weight if weight is not None else letter_share(text), F.lit(1e-6)))
    rows = staged(
        docs.select("doc_id", "source", F.size(words(text)).cast("long").alias("size"), quality.alias("quality"), uniform(seed, F.col("doc_id"), F.md5(F.coalesce(text, F.lit("")))).alias("u")),
        "mix-rows",
    ).withColumn("key", -F.log("u") / F.col("quality"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("quality").alias("usual"))
    targets = water_targets(weights_of(sizes.select("source", "source_size")), budget, ceiling)
    plan = staged(
        targets.join(sizes.select(F.col("source").alias("s"), "usual"), F.col("source").eqNullSafe(F.col("s")), "left")
        .drop("s")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")),
        "mix-plan",
    )
    named = plan.withColumnRenamed("source", "p_source")
    keyed = rows.join(named, F.col("source").eqNullSafe(F.col("p_source")), "left").withColumn(
        "slice", F.floor((1 - F.exp(-F.col("key") * F.col("usual"))) * SLICES)
    )
    sums = keyed.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("slice_size").over(upto), F.lit(0)).alias("start"))
    placed = keyed.join(starts, (F.col("slice") == F.col("s_slice")) & F.col("source").eqNullSafe(F.col("s_source")), "left")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - before))
    taken = F.col("epochs") * F.col("size") + part
    return placed.select("doc_id", "source", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"))
