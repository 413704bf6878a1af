"""Choosing among candidates and scoring the choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.functions.seeded import draw
from querymill.operators.ranking import group_rank
from querymill.operators.results import KEYS, against_gold

# Fixed value: statement chosen when nothing ran.
NO_SQL = "SELECT 'ERROR: No valid SQL was generated or executed successfully';"


def vote_counts(keyed: DataFrame, seed: int = 42) -> DataFrame:
    """Buckets of ``keyed(dp_id, cand_id, sql, fingerprint)`` with votes and a seeded member.

    Both aggregates combine before the shuffle, whatever the size of a bucket.
    """
    pick = F.min(F.struct(draw(seed, "dp_id", "cand_id").alias("_d"), "cand_id", "sql")).alias("_pick")
    return keyed.groupBy("dp_id", "fingerprint").agg(F.count(F.lit(1)).alias("votes"), pick)


def majority_vote(dps: DataFrame, keyed: DataFrame, seed: int = 42) -> DataFrame:
    """The bucket with most candidates (ties: smaller key) and one seeded statement from it."""
    best = F.min_by(F.struct("fingerprint", "votes", "_pick"), F.struct(-F.col("votes"), F.col("fingerprint")))
    won = vote_counts(keyed, seed).groupBy("dp_id").agg(best.alias("_w"))
    return dps.join(won, "dp_id", "left").select(
        "dp_id",
        F.col("_w.fingerprint").alias("fingerprint"),
        F.coalesce("_w.votes", F.lit(0)).alias("votes"),
        F.col("_w._pick.cand_id").alias("cand_id"),
        F.coalesce("_w._pick.sql", F.lit(NO_SQL)).alias("sql"),
    )


def topk_hits(votes: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Is gold's key among the first k buckets? Counts the buckets ahead of gold's instead of sorting all."""
    g = gold.select("dp_id", F.col("fingerprint").alias("_gold"))
    own = votes.join(g, "dp_id").filter(F.col("fingerprint") == F.col("_gold")).select("dp_id", "_gold", F.col("votes").alias("_votes"))
    ahead = F.sum(F.when((F.col("votes") > F.col("_votes")) | ((F.col("votes") == F.col("_votes")) & (F.col("fingerprint") < F.col("_gold"))), 1).otherwise(0))
    rank = votes.join(own, "dp_id").groupBy("dp_id").agg((ahead + 1).alias("gold_rank"))
    hits = [F.coalesce(F.col("gold_rank") <= k, F.lit(False)).alias(f"top{k}") for k in ks]
    return g.join(rank, "dp_id", "left").select("dp_id", *hits)


def execution_accuracy(choice: DataFrame, keyed: DataFrame) -> DataFrame:
    """Per datapoint: does the chosen candidate equal gold, and does any candidate?

    ``choice(dp_id, cand_id)``; ``keyed`` carries gold and candidates. A datapoint whose gold
    failed, or without a choice, is incorrect.
    """
    scored = against_gold(keyed, "_equal").select(*KEYS, "_equal")
    chosen = choice.select("dp_id", F.col("cand_id").alias("_chosen"))
    per_dp = scored.join(chosen, "dp_id").groupBy("dp_id").agg(
        F.bool_or(F.col("_equal") & (F.col("cand_id") == F.col("_chosen"))).alias("execution_correct"), F.bool_or("_equal").alias("recalled")
    )
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("execution_correct", "recalled")]
    return choice.select("dp_id").join(per_dp, "dp_id", "left").select("dp_id", *flags)


def materialize_buckets(keyed: DataFrame) -> DataFrame:
    """Distinct statements per bucket in order, buckets by size.

    Long form: one row per statement with the bucket's rank and the statement's place, so that
    no bucket is gathered into one value. The first statement's result represents the bucket.
    """
    members = keyed.groupBy("dp_id", "fingerprint", "sql").agg(F.count(F.lit(1)).alias("_n"), F.min("cand_id").alias("cand_id"))
    sizes = members.groupBy("dp_id", "fingerprint").agg(F.sum("_n").alias("votes"), F.min("sql").alias("first_sql"))
    # rank by votes first: a datapoint with n candidates has fewer than sqrt(2n) + 1 different vote counts
    level = sizes.groupBy("dp_id", "votes").agg(F.count(F.lit(1)).alias("_n"))
    larger = W.partitionBy("dp_id").orderBy(F.desc("votes")).rowsBetween(W.unboundedPreceding, -1)
    level = level.select("dp_id", "votes", F.coalesce(F.sum("_n").over(larger), F.lit(0)).alias("_ahead"))
    ranked = group_rank(sizes, ["dp_id", "votes"], "fingerprint", [], out="_rn").join(level, ["dp_id", "votes"])
    ranked = ranked.withColumn("bucket_rank", F.col("_ahead") + F.col("_rn"))
    return members.join(ranked, ["dp_id", "fingerprint"]).select(
        "dp_id", "bucket_rank", "votes", "sql", (F.col("sql") == F.col("first_sql")).alias("is_representative")
    )


def report(per_dp: DataFrame) -> DataFrame:
    """Totals and percentages in one aggregate; zero-safe.

    ``per_dp(dp_id, execution_correct, recalled, gold_ok, top1, top2, top3)``.
    """
    share = lambda flag, base: F.round(F.coalesce(100.0 * F.try_divide(F.count_if(flag), base), F.lit(0.0)), 6)
    total, usable = F.count(F.lit(1)), F.count_if("gold_ok")
    hits = [share(F.col(f"top{k}") & F.col("gold_ok"), usable).alias(f"top{k}_pct") for k in (1, 2, 3)]
    return per_dp.agg(
        total.alias("total"),
        share(F.col("execution_correct"), total).alias("ex_pct"),
        share(F.col("recalled"), total).alias("recall_pct"),
        usable.alias("gold_executable"),
        *hits,
    )


def best_run(history: DataFrame, keys: list[str], slice_runs: int = 1_000_000) -> DataFrame:
    """Best score so far per run, and whether the run's snapshot replaces the kept one.

    The record starts at 0; a snapshot is kept on a strict improvement, or when there is none yet.
    A long history is walked in slices of run numbers, each starting from the best of the slices before.
    """
    cut = history.select(*keys, "run_no", "score", F.floor(F.col("run_no") / slice_runs).alias("_s"))
    tops = cut.groupBy(*keys, "_s").agg(F.max("score").alias("_top"))
    before = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*keys, "_s", F.max("_top").over(before).alias("_carried"))
    w = W.partitionBy(*keys, "_s").orderBy("run_no")
    inside = cut.withColumn("_inside", F.max("score").over(w.rowsBetween(W.unboundedPreceding, -1)))
    walked = inside.join(carried, [*keys, "_s"])
    earlier = F.greatest(F.col("_inside"), F.col("_carried"))
    record = F.greatest(F.coalesce(earlier, F.lit(0.0)), F.lit(0.0))
    return walked.select(*keys, "run_no", "score", F.greatest(record, "score").alias("best_score"), ((F.col("score") > record) | earlier.isNull()).alias("snapshot"))


def effective_schema(dps: DataFrame, execs: DataFrame) -> DataFrame:
    """Datapoints with a fallback candidate carry the fallback schema from then on."""
    used = execs.filter(F.col("round") > 0).groupBy("dp_id").agg(F.lit(True).alias("_fell_back"))
    switch = F.col("_fell_back").isNotNull() & (F.coalesce("fallback_schema", F.lit("")) != "")
    return dps.join(used, "dp_id", "left").select("dp_id", F.when(switch, F.col("fallback_schema")).otherwise(F.col("schema_text")).alias("schema_text"))


def ordered_output(df: DataFrame) -> DataFrame:
    """Sort by database and question, missing ones first."""
    return df.orderBy(F.coalesce("db_id", F.lit("")), F.coalesce("question", F.lit("")))
