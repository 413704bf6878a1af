"""SQL workloads: which rows to keep and which columns each statement touches.

Statements are read as token lists; nothing here parses SQL. One fold over the tokens carries a stack of levels, one for every open
parenthesis: the scope (one for every SELECT, so branches of a set operation have scopes of their own) and the clause it is in.
Every name gets the levels around it; a name belongs to the innermost scope that has a source for it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querymill.functions.sqltext import KEYWORDS, SYMBOL, WORD
from querymill.operators.links import column_key, is_chosen, is_linked, rows_of
from querymill.session import cut_lineage

CODE = rf"""'[^']*'|"[^"]*"|`[^`]*`|--[^\n]*|/\*[\s\S]*?\*/|{WORD}|{SYMBOL}"""
SET_OPERATORS = ("union", "intersect", "except")
#: Clauses of a level, and what else a token can be to the fold.
WITH, SELECT, FROM, ON, WHERE, ORDER, USING, PAREN, CLOSE, BRANCH, COMMA, NAME, STAR = range(13)


def filter_workload(workload: DataFrame, databases: DataFrame, bad_texts: tuple[str, ...] = (), bad_dbs: tuple[str, ...] = ()) -> DataFrame:
    """Drop statements and databases that the caller names as bad, joins without ON or USING, and unknown databases."""
    low = F.lower("sql")
    bare_join = low.contains(" join ") & ~low.contains("on") & ~low.contains("using")
    kept = workload.filter(~bare_join & ~F.col("db_id").isin(*bad_dbs))
    for text in bad_texts:
        kept = kept.filter(~low.contains(text))
    return kept.join(databases.select("db_id").distinct(), "db_id", "left_semi")


def code_tokens(sql: Column) -> Column:
    """Tokens in lower case without comments; a literal is ``'``, a quoted name is its text behind ``"``."""
    found = F.filter(F.regexp_extract_all(sql, F.lit(CODE), F.lit(0)), lambda t: ~t.startswith("--") & ~t.startswith("/*"))
    quoted = lambda t: F.concat(F.lit('"'), F.lower(F.substring(t, F.lit(2), F.length(t) - 2)))
    return F.transform(found, lambda t: F.when(t.startswith("'"), F.lit("'")).when((F.length(t) > 1) & t.rlike('^["`]'), quoted(t)).otherwise(F.lower(t)))


#: Kinds by token; what follows or stands before some of them makes them another kind, or a name, see ``scoped_names``.
SPECIAL = {
    "(": PAREN, ")": CLOSE, ",": COMMA, "*": STAR, "select": SELECT, "from": FROM, "join": FROM, "on": ON, "using": USING,
    "where": WHERE, "limit": WHERE, "having": ORDER, **dict.fromkeys(SET_OPERATORS, BRANCH),
}
BEFORE_BY = {"group": WHERE, "order": ORDER}
RESERVED = frozenset(KEYWORDS)
NO_NAMES = RESERVED - {"order"}
ENDS = frozenset((")", "'", "end", "null", "true", "false"))
STOPS = frozenset((",", "from", ")", "", ";", *SET_OPERATORS))
#: A token list has this many empty tokens around it, so that neighbours need no bounds.
MARGIN = 3


def bare(token: str) -> str:
    return token[1:] if token[:1] == '"' else token


def _is_word(t: str) -> bool:
    return t != "" and t not in RESERVED and (t[0].isalpha() or t[0] in '"_' or category(t[0])[0] == "N")


def scoped_names(w: list[str]) -> list[tuple[int, int, tuple[tuple[int, int, bool], ...]]]:
    """Names, stars and closed subqueries of a token list in its margin, each as place, kind and the levels around it.

    A level is (scope, clause, inner); ``inner`` tells a parenthesis that opens no query, which stays in the scope around it.
    """
    levels, fresh, seen = ((0, WITH, False),), 1, []
    for i in range(MARGIN, len(w) - MARGIN):
        t = w[i]
        kind = SPECIAL.get(t)
        if kind is None:
            after = w[i + 1]
            if after == "by" and t in BEFORE_BY:
                kind = BEFORE_BY[t]
            # neither qualifiers nor functions; a name of WITH may have a list of columns
            elif after == "." or not (t[0].isalpha() or t[0] in '"_') or (t in NO_NAMES and w[i - 1] != ".") or (after == "(" and w[i - 1] not in ("with", "recursive", ",")):
                continue
            else:
                seen.append((i, NAME, levels))
                continue
        top = levels[-1]
        if kind == STAR:
            seen.append((i, kind, levels))
        elif kind == PAREN:
            if w[i + 1] in ("select", "with"):
                levels, fresh = (*levels, (fresh, WITH, False)), fresh + 1
            else:
                levels = (*levels, (top[0], top[1], True))
        elif kind == CLOSE:
            if len(levels) > 1:
                levels = levels[:-1]
                if not top[2]:
                    seen.append((i, kind, levels))
        elif kind == BRANCH:
            levels, fresh = (*levels[:-1], (fresh, WITH, False)), fresh + 1
        elif kind == COMMA:
            if top[1] in (ON, USING) and not top[2]:
                levels = (*levels[:-1], (top[0], FROM, False))
        elif t != "from" or w[i - 1] != "distinct":
            levels = (*levels[:-1], (top[0], kind, top[2]))
    return seen


class Place(NamedTuple):
    """A name, star or closed subquery of a statement: token, qualifier, its scope and clause, scopes and levels around it."""

    i: int
    n: str
    q: str
    scope: int
    clause: int
    scopes: tuple[int, ...]
    levels: tuple[tuple[int, int, bool], ...]


def touched(tokens: list[str], names: dict[str, set[str]]) -> set[tuple[str, str | None, bool]]:
    """``(table_name, col_name, known)`` of one statement, from its tokens and the columns of its database's tables; see ``link_columns``."""
    margin = [""] * MARGIN
    w = [*margin, *tokens, *margin]
    withs, froms, outputs, refs, stars = [], [], [], [], []
    around_it, scopes = None, ()
    for i, kind, levels in scoped_names(w):
        if levels is not around_it:
            around_it, scopes = levels, tuple([y[0] for y in levels])
        before, after, (scope, clause, inner) = w[i - 1], w[i + 1], levels[-1]
        x = Place(i, bare(w[i]), bare(w[i - 2]) if before == "." else "", scope, clause, scopes, levels)
        if kind == STAR:
            if before in (".", ",", "select", "distinct", "all"):
                stars.append(x)
        elif kind == CLOSE:
            if clause == FROM:
                froms.append((x, False))
        elif clause == FROM:
            if (w[i - 3] if before == "." else before) in ("from", "join", ",", "(") and after not in (".", "("):
                froms.append((x, True))
        elif clause == WITH:
            if not inner and before in ("with", "recursive", ","):
                withs.append(x)
        else:
            in_list = clause == SELECT and not inner
            stops = after in STOPS
            if in_list and stops:
                outputs.append(x)
            # where an expression can end, a further name is what it is called
            renames = before == "as" or (in_list and stops and before != "." and (before in ENDS or _is_word(before)))
            if not renames and after not in (".", "(", "'"):
                refs.append(x)

    def own(m: Place, c: Place) -> bool:
        """Inside its own body a name of WITH is the table, unless it is recursive."""
        inside = (c.scope, WITH, False) in m.levels
        return inside and "recursive" not in tokens and not any(d.scope == c.scope and c.i < d.i < m.i for d in withs)

    def is_base(m: Place) -> bool:
        return m.n in names and all(own(m, c) for c in withs if c.n == m.n and c.i < m.i and c.scope in m.scopes)

    sources = {}
    for m, is_table in froms:
        called = w[m.i + 2] if w[m.i + 1] == "as" else w[m.i + 1]
        alias = bare(called) if _is_word(called) else m.n if is_table else ""
        sources[m.n if is_table and is_base(m) else "", alias, m.scope] = None

    def around(x: Place, cond: Callable[[str, str], bool]) -> tuple[set[str], int | None]:
        """Tables and scope of the innermost scope around a name with a source that meets the condition; scopes inside have larger numbers."""
        met = [(t, scope) for t, a, scope in sources if scope in x.scopes and cond(t, a)]
        top = max((scope for _, scope in met), default=None)
        return {t for t, scope in met if scope == top and t != ""}, top

    found = {(t, None, True) for t, _, _ in sources if t != ""}
    for r in refs:
        if r.q != "":
            found |= {(t, r.n, r.n in names[t]) for t in around(r, lambda t, a: a == r.q)[0]}
        elif r.clause != ORDER or not any(o.n == r.n and o.scope == r.scope for o in outputs):
            tables, top = around(r, lambda t, a: r.n in names.get(t, ()))
            hidden = top != r.scope and any(o.n == r.n and o.scope != r.scope and r.scope in o.scopes for o in outputs)
            if not hidden and (len(tables) == 1 or r.clause == USING):
                found |= {(t, r.n, True) for t in tables}
    for x in stars:
        tables = {t for t, _, scope in sources if scope == x.scope and t != ""} if x.q == "" else around(x, lambda t, a: a == x.q)[0]
        found |= {(t, c, True) for t in tables for c in names[t]}
    return found


#: Characters of catalog texts whose tables a task keeps at hand.
KEPT_CHARS = 1 << 24


def _touching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dp_id, db_id, w, names) of statements -> their hits. A database's names are read once while it is at hand, not once a statement."""
    held: dict[str, dict[str, set[str]]] = {}
    chars, last, tables = 0, None, {}
    for batch in batches:
        at, out = [], []
        words, ends = batch.column(2).values.to_numpy(zero_copy_only=False).tolist(), batch.column(2).offsets.tolist()
        # equal texts share a code; databases come in any order
        codes = batch.column(3).dictionary_encode()
        texts = codes.dictionary.to_pylist()
        for i, code in enumerate(codes.indices.to_pylist()):
            text = texts[code]
            if text is not last:
                if text not in held:
                    chars = chars + len(text) if chars < KEPT_CHARS else held.clear() or len(text)
                    held[text] = {t: set(cols) for t, cols in json.loads(text).items()}
                last, tables = text, held[text]
            hits = touched(words[ends[i] : ends[i + 1]], tables)
            at += [i] * len(hits)
            out += hits
        taken = pa.array(at, pa.int64())
        kinds = (pa.string(), pa.string(), pa.bool_())
        hits = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 3, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *hits], ["dp_id", "db_id", "table_name", "col_name", "known"])


def link_columns(workload: DataFrame, columns: DataFrame) -> DataFrame:
    """What each statement touches: ``dp_id, db_id, table_name, col_name, known``, all in lower case.

    Sources are the names of a FROM clause and its subqueries; a source is a table when the catalog has it and no WITH in sight
    names it. ``alias.column`` belongs to the source of that alias in the innermost scope with one, and is not ``known`` when that table lacks it.
    A bare column counts when exactly one table of the innermost scope with any has it; the columns of USING belong to
    all tables of their scope. Output names, with AS or without, are no columns, nor are they in ORDER BY and HAVING; what a
    subquery puts out hides columns of outer scopes. A star of a select list stands for all columns of its alias's
    table, or of all tables of its scope. A touched table also has a row without column.

    A statement is matched against its database's names inside one row: one join, no pairs. Tokens and names are made by
    Spark; the names travel as one text, which a task reads once for the statements of a database that follow each other.
    """
    per_table = columns.groupBy("db_id", F.lower("table_name").alias("t")).agg(F.collect_set(F.lower("col_name")).alias("cols"))
    names = per_table.groupBy("db_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("t", "cols")))).alias("names"))
    rows = workload.select("dp_id", "db_id", code_tokens(F.col("sql")).alias("w")).join(names, "db_id").select("dp_id", "db_id", "w", "names")
    kinds = "table_name string, col_name string, known boolean"
    return rows.mapInArrow(_touching, StructType([*rows.schema.fields[:2], *StructType.fromDDL(kinds).fields]))


def validate_link(found: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links from ``link_columns`` in the catalog's spelling and order, and the rejected datapoints.

    A datapoint with an unknown column is rejected. Key columns of touched tables are added; a
    datapoint left without any column gets all columns of its tables.
    """
    per_dp = found.groupBy("dp_id", "db_id").agg(
        F.every("known").alias("ok"),
        F.collect_set("table_name").alias("chosen"),
        F.collect_set(F.when(F.col("col_name").isNotNull(), column_key("table_name", "col_name"))).alias("linked"),
    )
    # read for the good ones and for the rejected ones: the statements are read once
    per_dp = cut_lineage(per_dp)
    item = F.struct(F.lower("table_name").alias("t"), column_key("table_name", "col_name").alias("k"), "table_name", "col_name", "col_idx", "is_pk")
    schemas = columns.groupBy("db_id").agg(F.collect_list(item).alias("cols"))
    good = per_dp.filter("ok").join(schemas, "db_id")
    good = good.withColumn("mine", F.filter("cols", lambda c: is_chosen(c["t"])))
    good = good.withColumn("link", F.filter("mine", lambda c: c["is_pk"] | is_linked(c["k"])))
    rows = rows_of(good, ["dp_id", "db_id"], F.when(F.size("link") > 0, F.col("link")).otherwise(F.col("mine")))
    return rows.select("dp_id", "db_id", "c.table_name", "c.col_name", "c.col_idx", "c.is_pk"), per_dp.filter("not ok").select("dp_id", "db_id")
