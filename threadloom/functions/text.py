"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.tokens import words


def word_count(text: Column) -> Column:
    return F.size(words(text))


def epoch_seconds(when: Column) -> Column:
    """Seconds since 1970 with fraction, of a timestamp or its text."""
    return F.unix_micros(F.to_timestamp(when)) / 1e6


def joined_with(*parts: Column, by: str) -> Column:
    """Concatenation; null if a part is null."""
    out: list[Column] = []
    for p in parts:
        out += [F.lit(by), p] if out else [p]
    return F.concat(*out)


def title_and_text(title: Column, text: Column) -> Column:
    return joined_with(title, text, by=" - ")


def with_summary(text: Column, summary: Column) -> Column:
    return joined_with(text, summary, by=" - Summary: ")


def any_of(text: Column, entities: Iterable[str]) -> Column:
    """Whether one of the entities is a substring; false without entities."""
    return reduce(lambda a, b: a | b, [text.contains(e) for e in entities], F.lit(False))


def lines(text: Column) -> Column:
    """Non-empty lines."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def exploded_lines(df: DataFrame, column: str, name: str = "line") -> DataFrame:
    return df.select("*", F.explode(lines(F.col(column))).alias(name))


def file_extension(path: Column) -> Column:
    """From the last dot of the last path part on; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def cross_prompts(templates: Sequence[str], subjects: DataFrame, perspectives: DataFrame) -> DataFrame:
    """(subject, perspective, prompt) of every template (two %s) with every pair."""
    pairs = subjects.select("subject").crossJoin(perspectives.select("perspective"))
    made = F.array(*[F.format_string(t, "subject", "perspective") for t in templates])
    return pairs.select("subject", "perspective", F.explode(made).alias("prompt"))


def rst_content(text: Column) -> Column:
    """Struct of what an RST page declares: section titles, function and class directives, and code by its preceding line."""
    sections = F.regexp_extract_all(text, F.lit(r"(?m)^([^\n]+)\n[=\-~^]{3,}[ ]*$"), F.lit(1))
    code_names = F.regexp_extract_all(text, F.lit(r"(?s)([^\n]+)\n\s*\.\. code(?:-block)?:: ?\w*\n\n(.*?)(?=\n\S|\z)"), F.lit(1))
    code = F.regexp_extract_all(text, F.lit(r"(?s)([^\n]+)\n\s*\.\. code(?:-block)?:: ?\w*\n\n(.*?)(?=\n\S|\z)"), F.lit(2))
    # a repeated heading keeps its last code
    pairs = F.arrays_zip(code_names.alias("name"), code.alias("code"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["name"] == p["name"]))
    return F.struct(
        sections.alias("sections"),
        F.regexp_extract_all(text, F.lit(r"\.\. (?:auto|py:)?function:: *([^\s(]+)"), F.lit(1)).alias("functions"),
        F.regexp_extract_all(text, F.lit(r"\.\. (?:auto|py:)?class:: *([^\s(]+)"), F.lit(1)).alias("classes"),
        F.map_from_entries(last).alias("code"),
    )


def python_blocks(text: Column) -> Column:
    """Longest runs of lines that parse as Python, and what lies between (kind: python, text)."""
    import ast

    def parses(source: str) -> bool:
        try:
            return bool(ast.parse(source).body)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False

    def split(value: str | None) -> list[dict] | None:
        if value is None:
            return None
        rows, out, at = value.split("\n"), [], 0
        while at < len(rows):
            stop = next((e for e in range(len(rows), at, -1) if rows[at].strip() and parses("\n".join(rows[at:e]))), None)
            kind = "text" if stop is None else "python"
            stop = stop or at + 1
            if out and kind == "text" == out[-1]["kind"]:
                out[-1]["last_line"] = stop - 1
            else:
                out.append({"first_line": at, "last_line": stop - 1, "kind": kind})
            at = stop
        return out

    @F.pandas_udf("array<struct<first_line: int, last_line: int, kind: string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(split)

    return run(text)
