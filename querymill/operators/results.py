"""Result sets of candidate queries: keys, equality, buckets and previews.

``execs(dp_id, cand_id, sql, status, is_gold)`` holds one row per executed statement and
``results(dp_id, cand_id, row_no, cells)`` one row per result row. Result sets are never
gathered into one value: every key below is a sum over row digests, which Spark adds up
before the shuffle, so one huge result set costs no more than many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.functions.examples import NUMBER, float_text, let
from querymill.functions.sqltext import canonical_sql

KEYS = ["dp_id", "cand_id"]


def numeric_cell(cell: Column) -> Column:
    """Text of a cell that is equal for equal numbers: 1, 1.0 and 01 agree; other text stays."""
    plain = cell.rlike(r"^(0|-?[1-9][0-9]*)$") | ~cell.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    # whole numbers of any length keep all their digits
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, r"\.0*$", ""), r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    whole = F.when(bare == "-0", F.lit("0")).otherwise(bare)
    flat = lambda n: F.when((n == F.floor(n)) & (F.abs(n) < F.lit(9.0e15)), n.cast("long").cast("string")).otherwise(n.cast("string"))
    number = let(cell.try_cast("double"), flat)
    return F.when(F.coalesce(plain, F.lit(True)), cell).when(cell.rlike(r"^[+-]?[0-9]+(\.0*)?$"), whole).otherwise(F.coalesce(number, cell))


def row_digest(cells: Column) -> Column:
    """md5 of a row's cells, each with its length, so that no text can stand for two cells or for NULL."""
    return F.md5(F.array_join(F.transform(cells, lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("N"))), ","))


def _keyed(rows: DataFrame, keys: list[str], as_set: bool) -> DataFrame:
    """``keys`` -> md5 of (row count, digest sums) of rows with ``_digest``; repeats count once for a set."""
    same = rows.groupBy(*keys, "_digest").agg(F.count(F.lit(1)).alias("_times"))
    weight = F.lit(1) if as_set else F.col("_times")
    piece = lambda start, n=15: F.sum(F.conv(F.substring("_digest", start, n), 16, 10).cast("decimal(19,0)") * weight.cast("decimal(12,0)"))
    sums = same.groupBy(*keys).agg(F.sum(weight).alias("n_rows"), F.sum("_times").alias("n_returned"), piece(1).alias("_a"), piece(16).alias("_b"), piece(31, 2).alias("_c"))
    text = F.concat_ws("|", *[F.col(c).cast("decimal(38,0)").cast("string") for c in ("n_rows", "_a", "_b", "_c")])
    return sums.select(*keys, "n_rows", "n_returned", F.md5(text).alias("fingerprint"))


def _over_execs(execs: DataFrame, keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Every successful statement has a key, also with no row."""
    joined = execs.filter(F.col("status") == "success").join(keyed, keys, "left")
    return joined.withColumn("fingerprint", F.coalesce("fingerprint", F.md5(F.lit("0|0|0|0")))).withColumns(
        {"n_rows": F.coalesce("n_rows", F.lit(0)), "n_returned": F.coalesce("n_returned", F.lit(0))}
    )


def result_fingerprint(execs: DataFrame, results: DataFrame, cells: Column | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Key of the *set* of rows: order and repeats do not count, an empty set is a key.

    With ``keys=["stmt_id"]`` results hold the rows of each distinct statement once, and every
    candidate with that statement gets its key.
    """
    rows = results.select(*keys, row_digest(F.col("cells") if cells is None else cells).alias("_digest"))
    return _over_execs(execs, _keyed(rows, keys, as_set=True), keys)


def bag_fingerprint(execs: DataFrame, results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Key of the *multiset* of rows: repeats count."""
    return _over_execs(execs, _keyed(results.select(*keys, row_digest(F.col("cells")).alias("_digest")), keys, as_set=False), keys)


def value_fingerprint(execs: DataFrame, results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Key of the set of rows with equal numbers taken as equal (1 = 1.0).

    Where results carry ``types`` (array, 'number' or anything else per cell), text never equals a number; else
    every cell that reads as a number is one.
    """
    cells = F.transform("cells", numeric_cell)
    if "types" in results.columns:
        cells = F.zip_with("cells", "types", lambda c, t: F.when(F.coalesce(t == "number", F.lit(False)), numeric_cell(c)).otherwise(F.concat(F.lit("'"), c)))
    return result_fingerprint(execs, results, cells, keys)


def against_gold(keyed: DataFrame, out: str) -> DataFrame:
    """Compare each candidate's key with the key of its datapoint's gold statement.

    Datapoints whose gold failed have no gold key and drop out.
    """
    gold = keyed.filter("is_gold").select("dp_id", F.col("fingerprint").alias("_gold"))
    return keyed.filter("not is_gold").join(gold, "dp_id").withColumn(out, F.col("fingerprint") == F.col("_gold")).drop("_gold")


def results_equal_bag(execs: DataFrame, results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return against_gold(bag_fingerprint(execs, results, keys), "equal_bag").select(*KEYS, "equal_bag")


def results_equal_set(execs: DataFrame, results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return against_gold(value_fingerprint(execs, results, keys), "equal_set").select(*KEYS, "equal_set")


def empty_or_all_null(execs: DataFrame, results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """True where a statement returned nothing but NULL cells, or nothing at all."""
    rows = results.groupBy(*keys).agg(F.every(F.forall("cells", lambda c: c.isNull())).alias("no_result"))
    return execs.filter(F.col("status") == "success").join(rows, keys, "left").withColumn("no_result", F.coalesce("no_result", F.lit(True)))


def bucketize(keyed: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Candidates of ``result_fingerprint`` with the same result set; per bucket the first of each canonical SQL.

    With ``max_rows``, results of that many returned rows or more are left out. The first is found by a partial
    minimum, so a bucket of any size is combined before the shuffle. ``n_cands`` counts the
    candidates a kept statement stands for.
    """
    small = keyed.filter(~F.col("is_gold") & (F.trim("sql") != ""))
    if max_rows is not None:
        small = small.filter(F.col("n_returned") < max_rows)
    members = small.groupBy("dp_id", "fingerprint", canonical_sql(F.col("sql")).alias("canonical"))
    first = members.agg(F.min(F.struct("cand_id", "sql")).alias("_first"), F.count(F.lit(1)).alias("n_cands"))
    return first.select("dp_id", "fingerprint", "canonical", F.col("_first.cand_id").alias("cand_id"), F.col("_first.sql").alias("sql"), "n_cands")


def split_buckets(buckets: DataFrame, gold: DataFrame) -> DataFrame:
    """Label bucket members correct or incorrect against gold ``(dp_id, sql, fingerprint)``.

    Without a matching bucket the gold statement itself is the correct side; datapoints that
    miss one of the two sides are left out.
    """
    gold = gold.select("dp_id", F.col("sql").alias("_gold_sql"), F.col("fingerprint").alias("_gold"))
    labelled = buckets.select("dp_id", "fingerprint", "cand_id", "sql").join(gold, "dp_id").withColumn("is_correct", F.col("fingerprint") == F.col("_gold"))
    sides = labelled.groupBy("dp_id").agg(F.bool_or("is_correct").alias("_has_correct"), F.bool_or(~F.col("is_correct")).alias("_has_incorrect"))
    both = sides.filter("_has_incorrect")
    stand_in = gold.join(both.filter("not _has_correct"), "dp_id").select(
        "dp_id", F.col("_gold").alias("fingerprint"), F.lit(None).cast("long").alias("cand_id"), F.col("_gold_sql").alias("sql"), F.lit(True).alias("is_correct")
    )
    kept = labelled.join(both.select("dp_id"), "dp_id", "left_semi")
    return kept.select("dp_id", "fingerprint", "cand_id", "sql", "is_correct").unionByName(stand_in)


def validate_variants(dps: DataFrame, attempts: DataFrame, max_corrections: int = 2, wrong: str = "<|wrong SQL|>", unsuited: str = "<|unsuited|>") -> DataFrame:
    """One verdict per datapoint and reasoning path.

    ``dps(dp_id, gold_path, gold_sql, gold_ok)`` and ``attempts(dp_id, path, attempt_no, sql,
    is_equal)``; attempt 0 is the proposed statement, later ones are corrections. The walk stops
    at the first equal result, at a blank proposal or at a missing correction.
    """
    paths = F.explode(F.array(*[F.lit(p) for p in ("Normal", "CTE", "Subquery")])).alias("path")
    blank = F.coalesce(F.trim("sql"), F.lit("")) == ""
    tried = attempts.filter(F.col("attempt_no") <= max_corrections)
    state = tried.groupBy("dp_id", "path").agg(
        F.min(F.when(blank, F.col("attempt_no"))).alias("_stop"),
        F.min(F.when(F.col("is_equal") & ~blank, F.struct("attempt_no", "sql"))).alias("_hit"),
        F.bool_or(F.when(F.col("attempt_no") == 0, ~blank)).alias("_proposed"),
    )
    hit = F.col("_hit").isNotNull() & (F.col("_stop").isNull() | (F.col("_hit.attempt_no") < F.col("_stop")))
    verdict = (
        F.when(~F.col("gold_ok"), F.lit(wrong))
        .when(F.col("path") == F.col("gold_path"), F.col("gold_sql"))
        .when(~F.coalesce(F.col("_proposed"), F.lit(False)), F.lit(unsuited))
        .when(hit, F.col("_hit.sql"))
        .otherwise(F.lit(wrong))
    )
    return dps.select("*", paths).join(state, ["dp_id", "path"], "left").select("dp_id", "path", verdict.alias("sql"))


def cell_literal(cell: Column, kind: Column) -> Column:
    """A cell as a row of the reference's engine prints it: None, bare numbers, quoted text with escapes.

    Without a kind, a cell that reads as a number is one. Text stands in single quotes, in double ones if it holds single ones only.
    """
    escaped = cell
    for raw, said in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(said))
    double = cell.contains("'") & ~cell.contains('"')
    text = F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    number = F.when(cell.rlike("[.eE]"), float_text(cell)).otherwise(cell)
    return F.when(cell.isNull(), "None").when(F.coalesce(kind == "number", cell.rlike(NUMBER)), number).otherwise(text)


def preview_result(execs: DataFrame, results: DataFrame, n: int = 5, width: int = 512, keys: list[str] = KEYS) -> DataFrame:
    """Bounded text of each result: row count and the first ``n`` rows, each cut to ``width`` characters.

    Cells are spelled by ``cell_literal``, by their ``types`` if results carry these. Spark limits every group to its first n rows before the shuffle; the others are only counted.
    """
    kinds = F.col("types") if "types" in results.columns else F.transform("cells", lambda c: F.lit(None).cast("string"))
    spelled = F.array_join(F.zip_with("cells", kinds, cell_literal), ", ")
    row = F.concat(F.lit("("), spelled, F.when(F.size("cells") == 1, ",").otherwise(""), F.lit(")"))
    shown = F.when(F.length(row) > width, F.concat(F.substring(row, 1, width), F.lit("..."))).otherwise(row)
    first = results.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("row_no"))).filter(F.col("_rn") <= n)
    head = first.select(*keys, F.struct("_rn", shown.alias("text")).alias("_r")).groupBy(*keys).agg(F.sort_array(F.collect_list("_r")).alias("_head"))
    body = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).join(head, keys)
    more = F.when(F.col("n_rows") > n, F.lit(f" (displaying the first {n} rows)")).otherwise("")
    lines = F.array_join(F.transform("_head", lambda r: r["text"]), "\n")
    text = F.concat(F.lit("Execution result contains "), F.col("n_rows").cast("string"), F.lit(" rows"), more, F.lit(":\n"), lines)
    said = F.when(F.col("status") != "success", F.col("error")).otherwise(F.coalesce(text, F.lit("Execution result is empty.")))
    return execs.join(body, keys, "left").select(*KEYS, said.alias("preview"))
