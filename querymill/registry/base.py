"""Registration of checks.

An *input* is a SQL text over the given tables that both engines read alike; the operator under
test is DataFrame code on one side and hand-written SQL on the other. Tokens in braces stand for
the few spellings that differ between the engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from querymill.session import cut_lineage

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIALECT = {
    "spark": {"{ARRAY(}": "array(", "{INT}": "BIGINT"},
    "oracle": {"{ARRAY(}": "list_value(", "{INT}": "BIGINT"},
}
INPUTS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass
class Source:
    """Tables and inputs of one data folder as DataFrames."""

    spark: SparkSession
    folder: str
    staged: dict[str, DataFrame] = field(default_factory=dict)

    def shared(self, *names: str) -> Source:
        """Inputs that a query reads several times, itself or through other inputs, are made once and staged; each after those it needs."""
        for name in names:
            self.staged[name] = cut_lineage(self[name])
        return self

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.staged:
            return self.staged[name]
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        self._views(INPUTS[name])
        return self.spark.sql(dialect(INPUTS[name], "spark"))

    def sql(self, text: str) -> DataFrame:
        self._views(text)
        return self.spark.sql(dialect(text, "spark"))

    def _views(self, text: str) -> None:
        for table in TABLES:
            if re.search(rf"\b{table}\b", text):
                self[table].createOrReplaceTempView(table)
        for dep in used(text):
            self[dep].createOrReplaceTempView(dep)


def dialect(text: str, engine: str) -> str:
    for token, spelling in DIALECT[engine].items():
        text = text.replace(token, spelling)
    return text


def used(text: str) -> list[str]:
    """Inputs named in a text."""
    return [name for name in INPUTS if re.search(rf"\b{name}\b", text)]


def closure(text: str) -> list[str]:
    """Inputs named in a text, directly or through other inputs, each after those it needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in used(INPUTS[name]):
                visit(dep)
            order.append(name)

    for name in used(text):
        visit(name)
    return order


def oracle_text(body: str) -> str:
    """Full SQL of an oracle: the inputs it names as CTEs, then its own CTEs or its SELECT."""
    ctes = [f"{name} AS (\n{INPUTS[name].strip()}\n)" for name in closure(body)]
    body = body.strip()
    own = not body.upper().startswith("SELECT")
    start = "WITH "
    if body.startswith("RECURSIVE "):
        start, body = "WITH RECURSIVE ", body[len("RECURSIVE ") :]
    if not ctes:
        return dialect((start if own else "") + body, "oracle")
    return dialect(start + ",\n".join(ctes) + (",\n" if own else "\n") + body, "oracle")


def check(name: str, oracle: str | None = None):
    """Register a query ``fn(source) -> DataFrame`` and its oracle body."""

    def wrap(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Source(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
