"""Command lines: splitting into words as a shell does, and rendering. Splitting keeps state from one character to the next, so it runs in Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def split_words(line: str) -> list[str]:
    """Words of a line: quotes group, a backslash takes the next character as it is, except inside single quotes."""
    words: list[str] = []
    now, quote, open_ = [], "", False
    chars = iter(line)
    for c in chars:
        if c == "\\" and quote != "'":
            now.append(next(chars, "\\"))
            open_ = True
        elif quote:
            if c == quote:
                quote = ""
            else:
                now.append(c)
        elif c in "'\"":
            quote, open_ = c, True
        elif c.isspace():
            if open_:
                words.append("".join(now))
                now, open_ = [], False
        else:
            now.append(c)
            open_ = True
    return [*words, "".join(now)] if open_ else words


def words(line: Column) -> Column:
    """array<string> of the words of each command line; null stays null."""

    @F.pandas_udf("array<string>")
    def split(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: split_words(x) if isinstance(x, str) else None)

    return split(line)


def rendered(args: Column) -> Column:
    """Words joined by blanks, those with white space in double quotes."""
    return F.array_join(F.transform(args, lambda a: F.when(a.rlike(r"\s"), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)), " ")


def filled(text: Column, values: dict[str, str]) -> Column:
    """{name} replaced for known names only."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.lit(value))
    return text


def label(args: Column) -> Column:
    """How a command is called in reports: its first word without ./ before it."""
    first = F.regexp_replace(F.get(args, F.lit(0)), r"^(\./)+", "")
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("command"))
