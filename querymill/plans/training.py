"""From a SQL workload to training sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from querymill.functions.prompts import PATHS, fill, question_with_evidence
from querymill.functions.sqltext import canonical_sql
from querymill.operators import results, synth
from querymill.operators.links import linearize_link
from querymill.operators.pairs import normalize_selector, preference_pairs, two_stage_accept
from querymill.operators.workload import filter_workload, link_columns, validate_link
from querymill.session import cut_lineage


@dataclass
class TrainingSets:
    datapoints: DataFrame
    links: DataFrame
    rejected: DataFrame
    samples: DataFrame
    stats: DataFrame
    schemas: DataFrame
    split: DataFrame
    train: DataFrame


def training_sets(workload: DataFrame, columns: DataFrame, fks: DataFrame, ratio: float = 0.3, tol: float = 0.02, seed: int = 42) -> TrainingSets:
    """Link, label, add noise, split and corrupt a workload ``(dp_id, db_id, question, evidence, sql)``.

    The links feed everything after them, so they are written once to the shared folder; so are the samples, which are counted while they are written.
    """
    kept = filter_workload(workload, columns)
    links, rejected = validate_link(link_columns(kept, columns), columns)
    links = cut_lineage(links.select("dp_id", "db_id", "table_name", "col_name"))
    text = linearize_link(links, columns, fks)
    dps = kept.join(text, ["dp_id", "db_id"]).select(
        "dp_id", "db_id", question_with_evidence(F.col("question"), F.col("evidence")).alias("question"), canonical_sql(F.col("sql")).alias("sql"), F.col("linearized").alias("link_text")
    )
    seen = Observation()
    samples = cut_lineage(synth.column_samples(links, columns, fks, seed=seed, seen=seen))
    split = synth.group_split(dps, "db_id", ratio, tol, seed=seed)
    return TrainingSets(
        datapoints=dps,
        links=links,
        rejected=rejected,
        samples=samples,
        stats=synth.generation_stats(dps, columns, seen),
        schemas=synth.noised_schema(dps, links, columns, fks, seed),
        split=split,
        train=synth.assemble_train(links, split, columns, fks, seed=seed),
    )


def bucket_pairs(members: DataFrame, max_pairs: int = 3, seed: int = 42) -> DataFrame:
    """Preference pairs from labelled bucket members (see ``split_buckets``); a stand-in gold statement has member -1."""
    rows = members.select("dp_id", F.coalesce("cand_id", F.lit(-1)).alias("member_id"), "sql", "is_correct")
    return preference_pairs(rows, max_pairs, seed)


PAIR_PROMPT = "Schema:\n{schema}\nQuestion: {question}\n[SQL1]\n{sql1}\n[Result1]\n{result1}\n[SQL2]\n{sql2}\n[Result2]\n{result2}"


def comparison_pairs(dps: DataFrame, execs: DataFrame, rows: DataFrame, max_pairs: int = 3, max_rows: int | None = None, template: str = PAIR_PROMPT, seed: int = 42) -> DataFrame:
    """From results to pairs for the comparer: buckets, their sides, pairs, and a prompt with both statements' previews.

    ``dps(dp_id, schema_text, question)``; ``execs`` and ``rows`` as in ``operators.results``, gold among them. A datapoint whose gold
    failed, or without a wrong bucket, has no pair.
    """
    keyed = results.result_fingerprint(execs, rows)
    gold = keyed.filter("is_gold")
    members = results.split_buckets(results.bucketize(keyed, max_rows), gold.select("dp_id", "sql", "fingerprint"))
    pairs = bucket_pairs(members, max_pairs, seed)
    shown = results.preview_result(execs, rows).join(execs.select("dp_id", "cand_id", "is_gold"), ["dp_id", "cand_id"])
    # the stand-in of a gold statement that no candidate equals
    shown = shown.select("dp_id", "cand_id", "preview").union(shown.filter("is_gold").select("dp_id", F.lit(-1).cast("long"), "preview")).dropDuplicates(["dp_id", "cand_id"])
    side = lambda n: shown.select("dp_id", F.col("cand_id").alias(f"member{n}"), F.col("preview").alias(f"result{n}"))
    full = pairs.join(side(1), ["dp_id", "member1"]).join(side(2), ["dp_id", "member2"]).join(dps.select("dp_id", "schema_text", "question"), "dp_id")
    prompt = fill(template, schema=F.col("schema_text"), question=F.col("question"), **{c: F.col(c) for c in ("sql1", "result1", "sql2", "result2")})
    return full.select(F.concat_ws("-", "dp_id", "pair_no").alias("pair_id"), "dp_id", prompt.alias("prompt"), "sql1", "sql2", "result1", "result2", "winner")


def selector_rows(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Training rows of the comparer from pairs and their judgements ``(pair_id, stage, analysis, final_choice)``."""
    kept = two_stage_accept(pairs, answers)
    return normalize_selector(kept.select("*", F.col("prompt").alias("instruction_content"), *[F.lit(None).cast("string").alias(c) for c in ("instruction", "analysis")]))


def variant_rows(dps: DataFrame, attempts: DataFrame, execs: DataFrame, rows: DataFrame, max_corrections: int = 2) -> DataFrame:
    """Training rows of one statement per reasoning path: the first attempt whose result is gold's, as a bag.

    ``dps(dp_id, schema_text, question, gold_path, gold_sql)``, ``attempts(dp_id, path, attempt_no, cand_id, sql)``; ``execs`` and
    ``rows`` hold the attempts' results and gold's.
    """
    equal = results.results_equal_bag(execs, rows).select("dp_id", "cand_id", F.col("equal_bag").alias("is_equal"))
    tried = attempts.join(equal, ["dp_id", "cand_id"], "left").withColumn("is_equal", F.coalesce("is_equal", F.lit(False)))
    ran = execs.filter("is_gold AND status = 'success'").select("dp_id", F.lit(True).alias("gold_ok")).distinct()
    known = dps.join(ran, "dp_id", "left").withColumn("gold_ok", F.coalesce("gold_ok", F.lit(False)))
    verdicts = results.validate_variants(known.select("dp_id", "gold_path", "gold_sql", "gold_ok"), tried, max_corrections)
    paths = verdicts.groupBy("dp_id").pivot("path", list(PATHS)).agg(F.first("sql"))
    return synth.path_instances(dps.select("dp_id", "schema_text", "question").join(paths, "dp_id"))
