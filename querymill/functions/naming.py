"""Declared types, display names and column descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Substring of a declared type -> class, first match in this order wins.
TYPE_CLASSES = (
    ("int", "integer"),
    ("real", "real"),
    ("double", "real"),
    ("float", "real"),
    ("numeric", "numeric"),
    ("decimal", "numeric"),
    ("num", "numeric"),
    ("year", "integer"),
    ("bit", "integer"),
    ("bool", "boolean"),
    ("boolean", "boolean"),
    ("date", "time"),
    ("time", "time"),
    ("char", "text"),
    ("nchar", "text"),
    ("varchar", "text"),
    ("nvarchar", "text"),
    ("text", "text"),
    ("clob", "text"),
    ("blob", "blob"),
    ("string", "text"),
    ("jsonb", "jsonb"),
    ("json", "jsonb"),
)
INDEXABLE = "TEXT|CHAR|DATE"
# Unicode white space.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normalize_type(declared: Column) -> Column:
    """Class of a declared SQL type; empty -> ``others``; an unknown type raises."""
    low = F.lower(declared)
    rules = reduce(
        lambda acc, rule: acc.when(low.contains(rule[0]), F.lit(rule[1])),
        TYPE_CLASSES,
        F.when(F.coalesce(declared, F.lit("")) == "", F.lit("others")).when(low.contains("character"), F.lit("text")),
    )
    return rules.otherwise(F.raise_error(F.concat(F.lit("unknown declared type: "), declared)).cast("string"))


def indexable(declared: Column) -> Column:
    """Columns whose values are worth retrieving: text-like and dates."""
    return F.upper(declared).rlike(INDEXABLE)


def name_key(name: Column) -> Column:
    """Name without case, spaces, underscores and backticks."""
    return F.translate(F.lower(name), " _`", "")


def names_equivalent(a: Column, b: Column) -> Column:
    return name_key(a) == name_key(b)


def strip(text: Column) -> Column:
    """Strip all Unicode white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def clean_description(text: Column) -> Column:
    """One line, without the evidence prefixes and without runs of spaces."""
    line = F.translate(strip(text), "\n\r", " ")
    line = F.replace(F.replace(line, F.lit("commonsense evidence:"), F.lit("")), F.lit("Commonsense evidence:"), F.lit(""))
    return F.regexp_replace(strip(line), " {2,}", " ")


def column_comment(name: Column, display: Column, description: Column, value_description: Column, contains_null: Column | None) -> Column:
    """``Column Meaning | Column Description | Value Description | Contains NULL``.

    A part that says the same as the name or as an earlier part is left out; without
    ``contains_null`` the NULL note is left out too.
    """
    desc, values = clean_description(description), clean_description(value_description)

    def new(part: Column, *earlier: Column) -> Column:
        seen = reduce(lambda acc, e: acc | F.coalesce(names_equivalent(part, e), F.lit(False)), earlier, F.lit(False))
        return (part != "") & ~seen

    parts = [
        F.when(~names_equivalent(name, display), F.concat(F.lit("Column Meaning: "), display)),
        F.when(new(desc, name, display), F.concat(F.lit("Column Description: "), desc)),
        F.when(new(values, name, display, desc), F.concat(F.lit("Value Description: "), values)),
    ]
    if contains_null is not None:
        parts.append(F.concat(F.lit("Contains NULL: "), F.when(contains_null, "True").otherwise("False")))
    return F.concat_ws(" | ", *parts)


def table_comment(name: Column, display: Column) -> Column:
    return F.when(~names_equivalent(name, display), F.concat(F.lit(" -- Table Description: "), display)).otherwise("")
