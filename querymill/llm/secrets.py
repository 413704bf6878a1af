"""Secret scans over an incremental ledger of blobs.

Every version of a file is addressed by the SHA-256 of its text. The ledger holds, per blob, which rule
versions have scanned it and what they found. A run scans only pairs of blob and rule version that
the ledger lacks, and joins findings back to all paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.llm.text import staged


@dataclass(frozen=True)
class Rule:
    """A kind of secret. At least ``least`` characters of the match's ``group`` are needed."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in their order; the runs of access and hex are whole ones, so the length is in the pattern.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, "AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, "[0-9a-f]{32,}", 0, 32),
)
#: Kinds that this library adds.
ADDED = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
)
SPANS = "array<struct<start: int, kind: int, end: int, name: string>>"
#: Spans of the ledger also hold the key of the rule that found them.
FOUND = "array<struct<start: int, kind: int, end: int, name: string, rule: string>>"
LEDGER = f"sha string, scanned array<string>, spans {FOUND}"


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def spans_of(rule: Rule, order: int, matches: Column, pieces: Column, groups: Column) -> Column:
    """Spans in code points, from the matches and from the pieces of text between them."""
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(None).cast(FOUND).alias("out"))
    empty = F.array().cast(FOUND)

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + F.length(F.get(pieces, s["k"]))
        end = start + F.length(m)
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), F.lit(rule.kind).alias("name"), F.lit(rule.key).alias("rule")))
        long_enough = F.length(F.get(groups, s["k"])) >= rule.least
        out = F.when(long_enough, F.concat(F.coalesce(s["out"], empty), span)).otherwise(s["out"])
        return F.struct(end.alias("at"), (s["k"] + 1).alias("k"), out.alias("out"))

    return F.aggregate(matches, state, step, lambda s: F.coalesce(s["out"], empty))


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs (sha, text, todo: keys of rules) -> ledger rows."""
    df = blobs
    for i, rule in enumerate(rules):
        wanted = F.array_contains("todo", rule.key) & F.col("text").rlike(rule.pattern)
        df = df.withColumn(f"_m{i}", F.when(wanted, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))))
        df = df.withColumn(f"_g{i}", F.when(wanted, F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))) if rule.group else F.col(f"_m{i}"))
        df = df.withColumn(f"_p{i}", F.when(wanted, F.split("text", rule.pattern, -1)))
    found = [F.coalesce(spans_of(r, i, F.col(f"_m{i}"), F.col(f"_p{i}"), F.col(f"_g{i}")), F.array().cast(FOUND)) for i, r in enumerate(rules)]
    return df.select("sha", F.col("todo").alias("scanned"), F.concat(*found).alias("spans"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """Ledger rows that this run adds, staged: for every blob of versions (text), the rule versions not yet in the ledger.

    Null texts are the empty blob. Copies of a blob are reduced to one row on the map side.
    """
    wanted = F.array(*[F.lit(r.key) for r in rules])
    texts = versions.select(address(F.col("text")).alias("sha"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = texts.groupBy("sha").agg(F.first("text").alias("text"))
    if ledger is None:
        pending = blobs.withColumn("todo", wanted)
    else:
        seen = ledger.select("sha", F.explode("scanned").alias("k")).groupBy("sha").agg(F.collect_set("k").alias("seen"))
        todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        pending = blobs.join(seen, "sha", "left").withColumn("todo", todo).filter(F.size("todo") > 0)
    return staged(scan(pending.select("sha", "text", "todo"), rules), "ledger")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """versions with ``spans`` (start, kind, end, name), sorted by start and kind, for the current rule versions.

    Spans of other versions are left out, also if the same run scanned a current rule. Kind numbers follow the order
    of rules. A blob whose rules were scanned in several runs has several ledger rows, as many as rule versions at most.
    """
    order = {r.kind: i for i, r in enumerate(rules)}
    place = F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))])
    valid = F.array(*[F.lit(r.key) for r in rules])
    hits = (
        ledger.filter((F.size("spans") > 0) & (F.size(F.array_intersect("scanned", valid)) > 0))
        .select(F.col("sha").alias("_sha"), F.explode("spans").alias("x"))
        .filter(F.array_contains(valid, F.col("x.rule")))
        .groupBy("_sha")
        .agg(F.array_sort(F.collect_set(F.struct(F.col("x.start").alias("start"), place[F.col("x.name")].alias("kind"), F.col("x.end").alias("end"), F.col("x.name").alias("name")))).alias("spans"))
    )
    addressed = versions.withColumn("_address", address(F.col("text")))
    joined = addressed.join(hits, F.col("_address") == F.col("_sha"), "left")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS))).drop("_address", "_sha")
