"""Reading model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.examples import let
from querymill.functions.seeded import unit

# The two choices of a comparison.
BOX = {"SQL1": r"\box{SQL1}", "SQL2": r"\box{SQL2}"}


def parse_boxed_choice(text: Column, hashed: Column) -> Column:
    """``SQL1`` or ``SQL2`` when exactly one is boxed, else a seeded coin."""
    one = F.coalesce(text.contains(BOX["SQL1"]), F.lit(False))
    two = F.coalesce(text.contains(BOX["SQL2"]), F.lit(False))
    coin = F.when(unit(hashed) < 0.5, F.lit("SQL1")).otherwise(F.lit("SQL2"))
    return F.when(one & ~two, F.lit("SQL1")).when(two & ~one, F.lit("SQL2")).otherwise(coin)


def parse_boolean(text: Column) -> Column:
    return F.coalesce(F.lower(text).contains("true"), F.lit(False))


def link_json(text: Column) -> Column:
    """JSON object text in an answer: fenced block first, else the outermost braces; trailing commas dropped."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.regexp_replace(F.when(fenced != "", fenced).otherwise(braces), r",\s*([}\]])", "$1")


def parse_link_json(text: Column) -> Column:
    """Map table -> columns; anything that is not an object of lists is an empty map. A repeated key has its last value."""
    entries = F.map_entries(F.from_json(link_json(text), "map<string,array<string>>"))
    last = lambda es: F.filter(es, lambda e, i: ~F.exists(F.slice(es, i + 2, F.size(es)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(let(F.coalesce(entries, F.array().cast("array<struct<key:string,value:array<string>>>")), last))


def link_malformed(text: Column) -> Column:
    """True when the answer holds an object one of whose values is not a list."""
    raw = F.from_json(link_json(text), "map<string,string>")
    return F.coalesce(F.exists(F.map_values(raw), lambda v: v.isNull() | ~v.startswith("[")), F.lit(False))
