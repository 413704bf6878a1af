"""Iterative operators. Each round is one Spark job over all datapoints at once; the driver only counts rounds."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.functions.answers import parse_boxed_choice
from querymill.functions.seeded import draw, unit
from querymill.operators.ranking import group_rank
from querymill.session import cut_lineage

# Fixed value: statement chosen when a datapoint has no candidate.
NO_CANDIDATE = "SELECT 'ERROR: No candidates left'"


def fallback_rounds(dps: DataFrame, first: DataFrame, next_round: Callable[[int, DataFrame], DataFrame], rounds: int = 3) -> DataFrame:
    """Retry datapoints without a valid result, at most ``rounds`` times.

    ``dps(dp_id, fallback_schema)``; ``first`` and every ``next_round(round, open_dps)`` give
    ``(dp_id, cand_id, valid)``. Datapoints without fallback schema are blocked. Returns all
    candidates with the round that made them.
    """
    seen = cut_lineage(first.select("dp_id", F.lit(0).cast("long").alias("round"), "cand_id", "valid"))
    open_dps = dps.filter(F.coalesce("fallback_schema", F.lit("")) != "").select("dp_id")
    latest = seen
    for n in range(1, rounds + 1):
        solved = latest.filter("valid").select("dp_id").distinct()
        open_dps = cut_lineage(open_dps.join(solved, "dp_id", "left_anti"))
        if open_dps.isEmpty():
            break
        made = next_round(n, open_dps).select("dp_id", F.lit(n).cast("long").alias("round"), "cand_id", "valid")
        latest = cut_lineage(made)
        seen = seen.unionByName(latest)
    return seen


#: Candidates of a datapoint that one task puts in order; larger fields are ranked in slices.
ONE_TASK = 65_536


def tournament(dps: DataFrame, candidates: DataFrame, judge: Callable[[DataFrame], DataFrame], seed: int = 42) -> DataFrame:
    """Knock-out among the candidates of every datapoint until one is left.

    ``candidates(dp_id, cand_id, sql, result_key, *more)``. Every round puts all candidates left in a seeded order of its own, drawn
    per candidate, and neighbours meet; the odd one gets a bye; equal results are settled by a
    seeded coin without the judge. ``judge(pairs)`` gets ``(dp_id, slot, a, b)`` and returns
    ``(dp_id, slot, answer)``. Each round halves the field, so there are log2 rounds, and each writes its pairs once.
    """
    fields = [c for c in candidates.columns if c != "dp_id"]
    state = candidates.select("dp_id", F.struct(*fields).alias("c"))
    left = largest = candidates.groupBy("dp_id").count().agg(F.max("count")).first()[0] or 0
    for n in range(1, math.ceil(math.log2(largest)) + 1 if largest > 1 else 1):
        keyed = state.withColumn("cand_id", F.col("c.cand_id")).withColumn("_d", draw(f"{seed}|{n}", "dp_id", "cand_id"))
        if left > ONE_TASK:
            placed = group_rank(keyed, ["dp_id"], "_d", ["cand_id"])
        else:
            placed = keyed.withColumn("rn", F.row_number().over(W.partitionBy("dp_id").orderBy("_d", "cand_id")))
        left = math.ceil(left / 2)
        slots = placed.withColumn("slot", F.floor((F.col("rn") - 1) / 2))
        pairs = slots.groupBy("dp_id", "slot").agg(F.min_by("c", "rn").alias("a"), F.max_by("c", "rn").alias("b"), F.count(F.lit(1)).alias("_n"))
        # judged and joined again below: written here, the only cut of a round
        pairs = cut_lineage(pairs.withColumn("_equal", F.coalesce(F.col("a.result_key") == F.col("b.result_key"), F.lit(False))))
        answers = judge(pairs.filter((F.col("_n") == 2) & ~F.col("_equal")).select("dp_id", "slot", "a", "b"))
        coin = draw(f"{seed}|{n}-coin", "dp_id", "slot")
        choice = F.when(F.col("_equal"), F.when(unit(coin) < 0.5, F.lit("SQL1")).otherwise(F.lit("SQL2"))).otherwise(parse_boxed_choice(F.col("answer"), coin))
        winner = F.when(F.col("_n") == 1, F.col("a")).when(choice == "SQL1", F.col("a")).otherwise(F.col("b"))
        state = pairs.join(answers, ["dp_id", "slot"], "left").select("dp_id", winner.alias("c"))
    return dps.join(state, "dp_id", "left").select(
        "dp_id", F.col("c.cand_id").alias("cand_id"), F.coalesce("c.sql", F.lit(NO_CANDIDATE)).alias("sql"), F.col("c.result_key").alias("result_key")
    )
