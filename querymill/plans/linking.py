"""From the answers of a linking model to the schema text of every question. Answers and verdicts come in as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.operators import links
from querymill.operators.render import schema_input


def answered_links(dps: DataFrame, answers: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """Closed link of every datapoint from ``answers(dp_id, db_id, text)``; without a usable answer the whole schema."""
    named = links.match_table_names(links.predicted_links(answers), columns)
    return links.close_link(named, columns, fks, dps)


def linked_schemas(dps: DataFrame, answers: DataFrame, verdicts: DataFrame, columns: DataFrame, fks: DataFrame, static: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Final ``schema_text`` per datapoint: the closed link with the columns judged useful, and their examples.

    ``verdicts(dp_id, db_id, table_name, col_name, useful)`` are given on what ``links.columns_to_judge`` asks about
    ``answered_links``. Malformed or missing answers, and databases without catalog, give an empty text.
    """
    link = links.merge_judgements(answered_links(dps, answers, columns, fks), verdicts)
    known = columns.select("db_id").distinct()
    texts = schema_input(dps.select("dp_id", "db_id").join(known, "db_id", "left_semi"), columns, fks, static, retrieved, link)
    said = dps.select("dp_id", "db_id").join(answers.select("dp_id", "text"), "dp_id", "left").join(texts.select("dp_id", "schema_text"), "dp_id", "left")
    return links.guard_malformed(said, known, "text", F.col("schema_text"))
