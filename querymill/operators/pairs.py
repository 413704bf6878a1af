"""Preference pairs of correct and incorrect statements, and the judgements on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.functions.seeded import draw, unit
from querymill.operators.ranking import group_rank


def preference_pairs(members: DataFrame, max_pairs: int = 3, seed: int = 42) -> DataFrame:
    """Pair correct with incorrect statements without replacement, at most ``max_pairs`` per datapoint.

    ``members(dp_id, member_id, sql, is_correct)``. Both sides are put in a seeded order and
    joined place by place, so no statement meets more than one partner. A blank statement uses
    up its partner. Which side comes first is a seeded coin.
    """
    keyed = members.withColumn("_d", draw(seed, "dp_id", "member_id"))
    placed = group_rank(keyed, ["dp_id", "is_correct"], "_d", ["member_id"])
    side = lambda flag, name: placed.filter(F.col("is_correct") == flag).select(
        "dp_id", "rn", F.struct("member_id", "sql").alias(name)
    )
    pairs = side(True, "good").join(side(False, "bad"), ["dp_id", "rn"])
    usable = pairs.filter((F.coalesce(F.col("good.sql"), F.lit("")) != "") & (F.coalesce(F.col("bad.sql"), F.lit("")) != ""))
    first = W.partitionBy("dp_id").orderBy("rn")
    kept = usable.withColumn("pair_no", F.row_number().over(first).cast("long")).filter(F.col("pair_no") <= max_pairs)
    good_first = unit(draw(f"{seed}-side", "dp_id", "pair_no")) < 0.5
    return kept.select(
        "dp_id",
        "pair_no",
        F.when(good_first, F.col("good.sql")).otherwise(F.col("bad.sql")).alias("sql1"),
        F.when(good_first, F.col("bad.sql")).otherwise(F.col("good.sql")).alias("sql2"),
        F.when(good_first, F.col("good.member_id")).otherwise(F.col("bad.member_id")).alias("member1"),
        F.when(good_first, F.col("bad.member_id")).otherwise(F.col("good.member_id")).alias("member2"),
        F.when(good_first, F.lit("SQL1")).otherwise(F.lit("SQL2")).alias("winner"),
    )


def boxed_output(analysis, choice):
    """Analysis followed by the boxed choice on its own line."""
    return F.concat(F.regexp_replace(analysis, r"\s+$", ""), F.lit("\n\\box{"), choice, F.lit("}"))


def two_stage_accept(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Keep a judgement that names the known winner: from stage 1, else from the hinted stage 2.

    ``pairs(pair_id, prompt, sql1, sql2, winner)`` with the hint-free prompt, ``answers(pair_id,
    stage, analysis, final_choice)``. A pair without a readable stage-1 answer is discarded.
    """
    stage = lambda n: answers.filter(F.col("stage") == n).select("pair_id", F.struct("analysis", "final_choice").alias(f"s{n}"))
    right = lambda n: F.coalesce(F.lower(F.col(f"s{n}.final_choice")) == F.lower("winner"), F.lit(False))
    judged = pairs.join(stage(1), "pair_id").join(stage(2), "pair_id", "left")
    kept = judged.withColumn("star_stage", F.when(right(1), F.lit(1)).when(right(2), F.lit(2)).cast("long")).filter("star_stage is not null")
    analysis = F.when(F.col("star_stage") == 1, F.col("s1.analysis")).otherwise(F.col("s2.analysis"))
    choice = F.upper(F.trim(F.when(F.col("star_stage") == 1, F.col("s1.final_choice")).otherwise(F.col("s2.final_choice"))))
    one_wins = F.upper("winner") == "SQL1"
    return kept.select(
        "pair_id",
        "prompt",
        "star_stage",
        choice.alias("final_choice"),
        F.when(one_wins, F.col("sql1")).otherwise(F.col("sql2")).alias("chosen_sql"),
        F.when(one_wins, F.col("sql2")).otherwise(F.col("sql1")).alias("rejected_sql"),
        boxed_output(analysis, choice).alias("output_content"),
    )


def normalize_selector(rows: DataFrame) -> DataFrame:
    """Training rows of the comparer from the current or the older field names; others are dropped.

    Callers that need at least one row pass the result through ``require_rows``.
    """
    present = lambda *names: [F.coalesce(F.col(n), F.lit("")) != "" for n in names]
    current = present("instruction_content", "output_content")
    older = present("instruction", "analysis", "final_choice")
    choice = F.upper(F.trim("final_choice"))
    is_current = current[0] & current[1]
    is_older = older[0] & older[1] & older[2] & choice.isin("SQL1", "SQL2")
    return rows.withColumn("_current", is_current).filter(F.col("_current") | is_older).select(
        *[c for c in rows.columns if c not in ("instruction_content", "output_content", "instruction", "analysis", "final_choice")],
        F.when(F.col("_current"), F.col("instruction_content")).otherwise(F.col("instruction")).alias("input_prompt"),
        F.when(F.col("_current"), F.col("output_content")).otherwise(boxed_output(F.col("analysis"), choice)).alias("output_label"),
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail on an empty frame."""
    if df.isEmpty():
        raise ValueError(message)
    return df
