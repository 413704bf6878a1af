"""Example values of a column: merging, thinning and quoting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an identifier whose first example says enough.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
URL_STARTS = ("http://", "https://")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Fixed value: header of the example block of a column judgement.
LOCAL_HEADER = (
    "[Column Value Examples]\nWe want to know if the column named '%s' is useful to answer the question, "
    "here are some example values of this column:\n%s"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def below(values: Column, max_length: int | None) -> Column:
    return values if max_length is None else F.filter(values, lambda v: F.length(v) < max_length)


def merge_examples(retrieved: Column, static: Column, cap: int = 4, max_length: int | None = None) -> Column:
    """Retrieved values, below a length limit if there is one, filled up to ``cap`` with static values not among them."""
    short = below(retrieved, max_length)
    return let(short, lambda s: F.concat(s, F.slice(F.array_except(static, s), F.lit(1), F.greatest(F.lit(cap) - F.size(s), F.lit(0)))))


def collapse_identifier_examples(examples: Column) -> Column:
    """Only the first value when it is an e-mail address or a URL."""

    def single(first: Column) -> Column:
        return F.coalesce(first.rlike(EMAIL) | first.startswith(URL_STARTS[0]) | first.startswith(URL_STARTS[1]), F.lit(False))

    return let(examples, lambda e: F.when(let(F.try_element_at(e, F.lit(1)), single), F.slice(e, 1, 1)).otherwise(e))


def float_text(v: Column) -> Column:
    """A number as a float prints it, without exponent from 0.001 up to 1e16; other text stays."""
    plain = lambda d: F.when((F.abs(d) >= 1e7) & (F.abs(d) < 1e16), _decimal(d)).otherwise(d.cast("string"))
    return F.coalesce(let(v.try_cast("double"), plain), v)


def _decimal(d: Column) -> Column:
    """Digits of a double of 1e7 or more: its shortest text with the point moved."""
    digits = F.regexp_replace(F.regexp_extract(d.cast("string"), r"^-?([0-9.]+)", 1), r"\.", "")
    places = F.regexp_extract(d.cast("string"), r"E([0-9]+)$", 1).cast("int") + 1
    whole = F.rpad(F.substring(digits, F.lit(1), places), places, F.lit("0"))
    rest = F.substring(digits, places + 1, F.length(digits))
    shown = F.when(F.coalesce(F.regexp_replace(rest, "0+$", ""), F.lit("")) == "", F.lit("0")).otherwise(rest)
    return F.concat(F.when(d < 0, "-").otherwise(""), whole, F.lit("."), shown)


def format_examples(examples: Column, type_class: Column) -> Column:
    """Comma list, spelled as its first value asks: quoted and trimmed if that is text or a time, float text for numeric, plain for other numbers.

    Values come as text. They are text in a text or time column, and in any other but a boolean one when the first of them is no number.
    """
    number = F.coalesce(F.get(examples, F.lit(0)).rlike(NUMBER), F.lit(True))
    quoted = F.transform(examples, lambda v: F.concat(F.lit("'"), F.trim(v), F.lit("'")))
    floats = F.transform(examples, float_text)
    return (
        F.when(type_class.isin("text", "time") | ((type_class != "boolean") & ~number), F.array_join(quoted, ", "))
        .when(type_class == "numeric", F.array_join(floats, ", "))
        .otherwise(F.array_join(examples, ", "))
    )


def local_examples(column: Column, retrieved: Column, static: Column, type_class: Column, max_length: int | None = None) -> Column:
    """All examples of one column, each once, below the fixed header; empty without examples."""
    short = below(retrieved, max_length)
    block = lambda v: F.when(F.size(v) == 0, F.lit("")).otherwise(F.format_string(LOCAL_HEADER, column, format_examples(v, type_class)))
    return let(F.array_distinct(F.concat(short, static)), block)
