"""SQL text as data: tokens found by one regular expression, rewritten by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words written in upper case in canonical SQL.
KEYWORDS = (
    "all and any as asc avg between by case cast coalesce collate count cross current_date "
    "current_time current_timestamp desc distinct else end escape except exists false filter first "
    "following for from full glob group having if ifnull in inner intersect into is isnull join "
    "last lateral left like limit max min natural not notnull null nullif nulls offset on or order "
    "outer over partition preceding range recursive regexp right row rows select set some sum then "
    "ties to true unbounded union unique using values when where window with within without"
).split()
# Answer marker and refusal token of the SQL generator.
SQL_MARKER = "[SQL Query Answer]"
NA_TOKEN = "[N/A]"

WORD = r"[\p{L}\p{N}_]+"
SYMBOL = r"[^\p{L}\p{N}_\s]"
# A literal with a doubled quote reads as two literals side by side, which rewrites to the same
# text. Every alternative is a plain loop: long literals and comments need no regex recursion.
TOKENS = rf"""'[^']*'|"[^"]*"|--[^\n]*|/\*[\s\S]*?\*/|{WORD}|\s+|{SYMBOL}"""
RESERVED_TOKENS = rf"""(?i)'[^']*'|"[^"]*"|ORDER\s+BY|{WORD}|[^\p{{L}}\p{{N}}_'"]+|['"]"""
NOT_CODE = r"""("[^"]*")|'[^']*'|--[^\n]*|/\*[\s\S]*?\*/"""
BLANK_TOKEN = r"^(?:--|/\*|\s)"


def tokens(sql: Column, pattern: str = TOKENS) -> Column:
    return F.regexp_extract_all(sql, F.lit(pattern), F.lit(0))


def collapse(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_sql(sql: Column) -> Column:
    """Upper-case keywords outside literals, no comments, single spaces, exactly one ``;`` at the end."""
    words = F.transform(
        tokens(sql),
        lambda t: F.when(t.rlike(BLANK_TOKEN), F.lit(" ")).when(F.lower(t).isin(KEYWORDS), F.upper(t)).otherwise(t),
    )
    return F.concat(F.regexp_replace(collapse(F.array_join(words, "")), r"[; ]+$", ""), F.lit(";"))


def without_literals(sql: Column) -> Column:
    """SQL with comments and string literals blanked and quoted names bare, so that only code is read as code."""
    return F.replace(F.regexp_replace(sql, NOT_CODE, " $1 "), F.lit('"'), F.lit(""))


def quote_reserved(sql: Column, word: str = "order") -> Column:
    """Quote the bare identifier ``word``, leaving literals, quoted names and ORDER BY alone."""
    words = F.transform(tokens(sql, RESERVED_TOKENS), lambda t: F.when(F.lower(t) == word, F.lit(f'"{word}"')).otherwise(t))
    return F.array_join(words, "")


def reasoning_path(sql: Column) -> Column:
    """CTE before Subquery before Normal."""
    code = without_literals(sql)
    return (
        F.when(code.rlike(r"(?i)^\s*with\b"), F.lit("CTE"))
        .when(code.rlike(r"(?i)\(\s*select\b"), F.lit("Subquery"))
        .otherwise(F.lit("Normal"))
    )


def clean_sql(text: Column, marker: str = SQL_MARKER, na_tokens: tuple[str, ...] = (NA_TOKEN,)) -> Column:
    """SQL in a generated answer: after the marker, inside the fence if there is one, on one line, no outer ``;``."""
    at = F.instr(text, marker)
    answer = F.regexp_replace(F.when(at > 0, F.substr(text, at + F.lit(len(marker)))).otherwise(text), r"^\s+|\s+$", "")
    fence = F.lit(r"(?s)```sql\s*(.*?)\s*```")
    inner = F.when(F.regexp_like(answer, fence), F.regexp_extract(answer, r"(?s)```sql\s*(.*?)\s*```", 1)).otherwise(answer)
    return F.when(answer.isin(*na_tokens), answer).otherwise(F.regexp_replace(collapse(inner), "^;+|;+$", ""))


def estimated_tokens(*texts: Column) -> Column:
    """Token estimate of a prompt: words and single symbols."""
    return sum((F.size(F.regexp_extract_all(t, F.lit(rf"{WORD}|{SYMBOL}"), F.lit(0))).cast("long") for t in texts), F.lit(0).cast("long"))
