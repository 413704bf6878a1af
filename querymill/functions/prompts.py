"""Prompt texts and chat messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# First words of the answer in each task, and the reasoning paths.
RESPONSE_MARKERS = {"link": "[Schema Linking Result]", "judge": "[Judgement]", "sql": "[SQL Query Answer]"}
PATHS = ("Normal", "CTE", "Subquery")

# Default wording; every function takes its own template.
TEMPLATES = {
    "link": "List the tables and columns that answer the question, as a JSON object.\n{schema}\nQuestion: {question}\n",
    "sql": "Write one SQL query that answers the question.\n{schema}\nQuestion: {question}\n",
    "judge": "Is column {column} of this table needed for the question? True or False.\n{schema}\nQuestion: {question}\n{examples}\n",
    "compare": "Which query answers the question?\n{schema}\nQuestion: {question}\nSQL1: {sql1}\n{result1}\nSQL2: {sql2}\n{result2}\n",
}


def fill(template: str, **fields: Column) -> Column:
    """Put columns in the place of ``{name}`` marks. Field texts are never scanned for marks."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + name + "}"), name) for name in fields if "{" + name + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(fields[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def controlled(path: Column, question: Column) -> Column:
    """``[PATH] question``."""
    return F.concat(F.lit("["), F.upper(path), F.lit("] "), question)


def messages(prompt: Column, answer: Column) -> Column:
    """User and assistant turns."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("user", prompt), turn("assistant", answer))


def build_prompt(template: str, marker: str, answer: Column | None = None, **fields: Column) -> Column:
    """Chat messages of a task: the filled template and the marker followed by the answer, if known."""
    said = F.lit(marker) if answer is None else F.concat(F.lit(marker), answer)
    return messages(fill(template, **fields), said)


def question_text(question_with_evidence: Column, question_refine: Column, question: Column) -> Column:
    """First question text that is not blank; a row without any raises."""
    present = [F.when(F.trim(c) != "", c) for c in (question_with_evidence, question_refine, question)]
    return reduce(lambda a, b: F.coalesce(a, b), present + [F.raise_error(F.lit("no question text")).cast("string")])


def question_with_evidence(question: Column, evidence: Column) -> Column:
    """Append the hint when it has at least 5 characters."""
    hint = F.trim(F.coalesce(evidence, F.lit("")))
    return F.when(F.length(hint) >= 5, F.concat(question, F.lit("\n(hint: "), hint, F.lit(")"))).otherwise(question)
