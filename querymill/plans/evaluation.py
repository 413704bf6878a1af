"""From generated answers to a vote, a rerank and a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.sqltext import NA_TOKEN, clean_sql, quote_reserved
from querymill.operators import results, select
from querymill.operators.execute import run_candidates
from querymill.operators.rounds import fallback_rounds, tournament

GOLD = -1
STATEMENT = ["stmt_id"]


def candidates(generations: DataFrame) -> DataFrame:
    """Statements in generated texts ``(dp_id, db_id, cand_id, text)``; blanks and refusals drop out."""
    sql = quote_reserved(clean_sql(F.col("text")))
    rows = generations.select("dp_id", "db_id", "cand_id", sql.alias("sql"), F.lit(False).alias("is_gold"))
    return rows.filter((F.trim("sql") != "") & (F.col("sql") != NA_TOKEN))


@dataclass
class Evaluation:
    execs: DataFrame
    rows: DataFrame
    keyed: DataFrame
    choice: DataFrame
    per_dp: DataFrame
    report: DataFrame


def score(dps: DataFrame, execs: DataFrame, rows: DataFrame, keys: list[str] = results.KEYS, seed: int = 42) -> Evaluation:
    """Vote and score statements that have run: ``execs`` and ``rows`` as in ``operators.results``, gold among them."""
    keyed = results.result_fingerprint(execs, rows, keys=keys)
    values = results.value_fingerprint(execs, rows, keys=keys)
    made, known = keyed.filter("not is_gold"), keyed.filter("is_gold")
    choice = select.majority_vote(dps.select("dp_id"), made, seed)
    hits = select.topk_hits(select.vote_counts(made, seed), known)
    flags = dps.select("dp_id").join(known.select("dp_id", F.lit(True).alias("gold_ok")), "dp_id", "left").join(hits, "dp_id", "left")
    scored = select.execution_accuracy(choice, values).join(flags, "dp_id")
    per_dp = scored.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("gold_ok", "top1", "top2", "top3")})
    return Evaluation(execs, rows, keyed, choice, per_dp, select.report(per_dp))


def evaluate(spark: SparkSession, dps: DataFrame, generations: DataFrame, time_limit: float = 100.0, seed: int = 42) -> Evaluation:
    """Run gold and generated statements, vote, and score. ``dps(dp_id, db_id, gold_sql)``."""
    gold = dps.select("dp_id", "db_id", F.lit(GOLD).cast("long").alias("cand_id"), F.col("gold_sql").alias("sql"), F.lit(True).alias("is_gold"))
    execs, rows = run_candidates(spark, candidates(generations).unionByName(gold), time_limit)
    return score(dps, execs, rows, STATEMENT, seed)


@dataclass
class FallbackEvaluation:
    evaluation: Evaluation
    rounds: DataFrame
    schemas: DataFrame
    history: DataFrame


def validity(execs: DataFrame, rows: DataFrame) -> DataFrame:
    """``dp_id, cand_id, valid`` of generated statements: they ran and returned more than NULL cells."""
    empty = results.empty_or_all_null(execs, rows).select("dp_id", "cand_id", "no_result")
    made = execs.filter("not is_gold").select("dp_id", "cand_id")
    return made.join(empty, ["dp_id", "cand_id"], "left").select("dp_id", "cand_id", (~F.coalesce("no_result", F.lit(True))).alias("valid"))


def evaluate_rounds(
    dps: DataFrame, first: tuple[DataFrame, DataFrame], next_round: Callable[[int, DataFrame], tuple[DataFrame, DataFrame]], history: DataFrame | None = None, rounds: int = 3, seed: int = 42
) -> FallbackEvaluation:
    """Score with fallback: datapoints without a valid result are asked again on their fallback schema, at most ``rounds`` times.

    ``dps(dp_id, schema_text, fallback_schema)``; ``first`` is (execs, rows) of the first answers and of gold,
    ``next_round(round, open_dps)`` gives those of the next ones, with ``cand_id`` numbers of their own. Typed cells (``types`` in rows) keep
    text and numbers apart in the score. Also returned: the round of every candidate, the schema that a datapoint carries
    afterwards, and the ``history(run_no, score)`` of runs with this one, its best score and whether its snapshot is to be kept.
    """
    made = [first]

    def again(n: int, open_dps: DataFrame) -> DataFrame:
        made.append(next_round(n, open_dps))
        return validity(*made[-1])

    tried = fallback_rounds(dps, validity(*first), again, rounds)
    execs, rows = made[0]
    for more_execs, more_rows in made[1:]:
        execs, rows = execs.unionByName(more_execs, allowMissingColumns=True), rows.unionByName(more_rows, allowMissingColumns=True)
    done = score(dps, execs, rows, seed=seed)
    schemas = select.effective_schema(dps, tried)
    mine = done.report.select(F.lit(1).cast("long").alias("run_no"), F.col("ex_pct").alias("score"))
    if history is not None:
        last = history.agg(F.coalesce(F.max("run_no"), F.lit(0)).alias("_last"))
        # one row on either side
        numbered = mine.join(F.broadcast(last), F.lit(True)).select((F.col("_last") + 1).cast("long").alias("run_no"), "score")
        mine = history.select(F.col("run_no").cast("long").alias("run_no"), "score").unionByName(numbered)
    return FallbackEvaluation(done, tried, schemas, select.best_run(mine, []))


def rerank(dps: DataFrame, done: Evaluation, judge: Callable[[DataFrame], DataFrame], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Tournament among the distinct statements of every datapoint, and its accuracy."""
    values = results.value_fingerprint(done.execs, done.rows, keys=STATEMENT)
    entrants = values.filter("not is_gold").groupBy("dp_id", "sql").agg(F.min(F.struct("cand_id", "fingerprint")).alias("_m"))
    entrants = entrants.select("dp_id", "_m.cand_id", "sql", F.col("_m.fingerprint").alias("result_key"))
    chosen = tournament(dps.select("dp_id"), entrants, judge, seed)
    return chosen, select.execution_accuracy(chosen, values)
