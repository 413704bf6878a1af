"""Running candidate statements read-only on Spark tables."""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cache
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.session import scratch_path

BATCH = 1000
STATUS = "stmt_id string, status string, error string"
ROWS = "stmt_id string, row_no long, cells array<string>"


def _run_one(spark: SparkSession, stmt_id: str, sql: str, path: str, time_limit: float) -> tuple[str, str, str | None]:
    if not sql:
        return stmt_id, "error", "Empty query."
    tag = f"candidate-{uuid.uuid4().hex}"
    timed_out = threading.Event()
    context = spark.sparkContext
    context.setInterruptOnCancel(True)

    def stop() -> None:
        timed_out.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(time_limit, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        # inside a FROM clause only a query parses: no command, insert or second statement gets through
        rows = spark.sql(f"SELECT * FROM (\n{sql}\n) AS candidate")
        width = len(rows.columns)
        cells = F.array(*[F.col(f"c{i}").cast("string") for i in range(width)])
        numbered = rows.toDF(*[f"c{i}" for i in range(width)]).select(F.monotonically_increasing_id().alias("row_no"), cells.alias("cells"))
        # a folder of its own: jobs that run at the same time must not share an output folder
        numbered.write.mode("overwrite").parquet(f"{path}/stmt_id={stmt_id}")
        return stmt_id, "success", None
    except Exception as exc:  # any failure of the statement is its result
        if timed_out.is_set():
            return stmt_id, "error", f"Query timed out after {time_limit:g} seconds."
        return stmt_id, "error", f"Execution error: {type(exc).__name__}"
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def run_candidates(spark: SparkSession, execs: DataFrame, time_limit: float = 100.0, parallel: int = 8) -> tuple[DataFrame, DataFrame]:
    """Run every *distinct* statement of ``execs(dp_id, cand_id, sql, is_gold[, db_id])`` once.

    With a ``db_id`` column a statement runs in the database of that name, else in the session's.
    Returns ``(execs, results)``: execs with ``stmt_id``, ``status`` and ``error``, results as
    ``(stmt_id, row_no, cells)``, so that a statement many candidates share is kept once. Rows go
    from the executors to the shared folder; the driver streams the distinct statement texts, has
    ``parallel`` of them running at a time, and writes their status to the same folder batch by
    batch. Statements must end in a query result: blank text and anything that is not a query is
    an error.
    """
    path, status_path = scratch_path(spark, "results"), scratch_path(spark, "status")
    text = F.coalesce(F.trim(F.regexp_replace("sql", r"[;\s]+$", "")), F.lit(""))
    db = F.coalesce("db_id", F.lit("")) if "db_id" in execs.columns else F.lit("")
    stated = execs.withColumn("stmt_id", F.md5(F.concat_ws("\u001f", db, text)))
    texts = execs.select(db.alias("db"), text.alias("sql"), F.md5(F.concat_ws("\u001f", db, text)).alias("stmt_id")).distinct()
    spark.createDataFrame([], "row_no long, cells array<string>").write.parquet(f"{path}/stmt_id=none")
    spark.createDataFrame([], STATUS).write.parquet(status_path)

    @cache
    def session(name: str) -> SparkSession:
        own = spark.newSession()
        own.catalog.setCurrentDatabase(name)
        return own

    def run(row) -> tuple[str, str, str | None]:
        try:
            where = session(row.db) if row.db else spark
        except Exception:
            return row.stmt_id, "error", f"Execution error: no database {row.db}"
        return _run_one(where, row.stmt_id, row.sql, path, time_limit)

    statements = texts.toLocalIterator()
    with ThreadPoolExecutor(parallel) as pool:
        while batch := list(islice(statements, BATCH)):
            spark.createDataFrame(list(pool.map(run, batch)), STATUS).write.mode("append").parquet(status_path)
    done = stated.join(spark.read.schema(STATUS).parquet(status_path), "stmt_id", "left")
    return done, spark.read.schema(ROWS).parquet(path)
