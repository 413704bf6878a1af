"""The queries of this subpackage: each runs an operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.llm import alignment, decontam, jaccard, language, lines, mixing, quality, secrets, sketches, spelling, tokencount, toolcalls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.findings(docs, secrets.update_ledger(docs))
    base = [r.kind for r in secrets.BASE]
    spelled = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["name"] == kind)).cast("long").alias(f"n_{kind}")
    based = F.filter("spans", lambda x: x["name"].isin(base))
    return found.select("doc_id", *[of(k) for k in base], F.sha2(spelled(based).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    found = quality.features(docs).drop("text")
    return quality.judged_features(found).select("doc_id", *kept, F.round("p_good", 6).alias("p_good"))


@query
def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard.classed(docs).select("doc_id", "class_id", "copies", "n_links")


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = lines.deduped(docs)
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.length("clean").cast("long").alias("clean_chars"), F.md5(F.col("clean").cast("binary")).alias("clean_md5"))


@query
def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.marked(docs, table(spark, folder, "benchmark").select("item_id", "text"))
    return found.select("doc_id", F.col("items").isNotNull().alias("leaked"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"))


@query
def op2_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    captured = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pages = table(spark, folder, "pages").select("page_id", "url", "html", captured.alias("captured"))
    return warc.archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.identify(docs.select("doc_id", "text"), language.train(docs))


@query
def op7_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn that is not the assistant's calls for an answer; the assistant's turn answers the turn before it.

    A call waits for the calls of the two turns before it. Some arguments, by the length of the text, lack a field, have one of a wrong
    type, or are no object. A row a call and result; a turn without number has no id and links to nothing.
    """
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    name_of = lambda t: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    turn = F.col("turn")
    size = F.length("text")
    spoken = F.when(F.coalesce(size, F.lit(0)) % 7 != 0, F.col("text")).alias("text")
    typed = F.to_json(F.struct(turn.alias("turn"), spoken, size.alias("chars")))
    mistyped = F.to_json(F.struct(turn.alias("turn"), spoken, size.cast("string").alias("chars")))
    arguments = F.when(size % 11 == 0, F.to_json(F.array(turn))).when(size % 5 == 0, mistyped).otherwise(typed)
    is_answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = turns.filter(~is_answer).select(
        "conv_id", name_of(turn).alias("call_id"), turn.alias("position"), F.when(F.col("role") == "system", "instruct").otherwise("ask").alias("name"),
        arguments.alias("arguments"), F.array(name_of(turn - 2), name_of(turn - 1)).alias("parents"),
    )
    results = turns.filter(is_answer).select("conv_id", name_of(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOLS, "name string, field string, kind string, required boolean")
    found = toolcalls.linked(calls, results, schemas).withColumn("result", F.explode_outer("results"))
    json = toolcalls.spelled(F.col("arguments"), F.col("call_id"), F.col("name"), F.col("result.content"))
    return found.select("conv_id", "call_id", "position", "level", "status", F.array_join("problems", "; ").alias("problems"), "valid", json.alias("json"))


@query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(tokencount.write_tokens(table(spark, folder, "documents").select("doc_id", "text")))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op12_align_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op13_bottom_k_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return sketches.components_of(table(spark, folder, "documents").select("doc_id", "text"))


#: Schemas of the two tools that op7 reads conversations as; instruct asks for a field that turns lack.
TOOLS = [
    ("ask", "turn", "integer", True),
    ("ask", "text", "string", True),
    ("ask", "chars", "integer", False),
    ("instruct", "turn", "integer", True),
    ("instruct", "text", "string", True),
    ("instruct", "scope", "string", True),
]
