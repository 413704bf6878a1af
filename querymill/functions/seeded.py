"""Reproducible randomness: every draw is a function of a seed and the row's own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Hexadecimal digits of a draw.
DRAW_DIGITS = 32


def draw(seed: int | str, *keys: Column | str) -> Column:
    """md5 of ``seed|key|key``: a uniform sort key that is the same on every engine and every retry."""
    parts = [F.lit(str(seed))]
    for key in keys:
        parts += [F.lit("|"), (F.col(key) if isinstance(key, str) else key).cast("string")]
    return F.md5(F.concat(*parts))


def draw_start(seed: int | str, *keys: Column | str) -> Column:
    """What a draw of these keys and one more hashes before that last key: ``md5(concat(draw_start(seed, a), b))`` is ``draw(seed, a, b)``."""
    return F.concat(F.lit(f"{seed}|"), *[x for key in keys for x in ((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("|"))])


def unit(hashed: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of a draw."""
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_int(hashed: Column, low: int, high: int) -> Column:
    """Uniform integer in [low, high]."""
    return (F.lit(low) + F.floor(unit(hashed) * F.lit(high - low + 1))).cast("long")
