"""Functions in source files: where they begin and end. A stack of braces over tokens, so it runs in Python, batch by batch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|=>|[A-Za-z_$][\w$]*|\n|[^\s\w$]""", re.S)
_BINDING, _MODIFIERS = {"const", "let", "var"}, {"export", "default", "async"}


def _tokens(text: str) -> Iterator[tuple[str, int]]:
    """Words and signs outside comments and strings, with their lines; line feeds too, and "" for a string."""
    line = 1
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token == "\n":
            yield token, line
        elif token[0] in "\"'`":
            yield "", line
        elif not token.startswith(("//", "/*")):
            yield token, line
        line += token.count("\n")


def _is_function(tokens: list[tuple[str, int]], i: int) -> bool:
    """Whether the value that begins at i is a function: by its keyword, or an arrow after one name or a list in parentheses."""
    word = lambda k: tokens[k][0] if k < len(tokens) else ""
    i += word(i) == "async"
    if word(i) == "(":
        depth = 0
        while i < len(tokens):
            depth += (word(i) == "(") - (word(i) == ")")
            i += 1
            if not depth:
                break
        return word(i) == "=>"
    return word(i) == "function" or word(i + 1) == "=>"


def functions_in(text: str) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of each declared function, in one pass.

    A declaration stands first in its line: function and a name, or a name that is bound to a function.
    It ends with the brace that closes its first one; without a brace, with the first line that ends
    in a semicolon. Functions that are still open at the end of the text end there.
    """
    tokens = list(_tokens(text))
    found: list[list] = []
    open_: list[list] = []  # entry, depth where it began, whether its first brace was seen
    depth, fresh, last = 0, True, text.count("\n") + 1
    for i, (token, line) in enumerate(tokens):
        if token == "\n":
            if i and tokens[i - 1][0] == ";":
                for entry in [e for e in open_ if not e[2]]:
                    entry[0][2] = line
                    open_.remove(entry)
            fresh = True
            continue
        if fresh and token not in _MODIFIERS:
            fresh, name = False, None
            word = lambda k: tokens[k][0] if k < len(tokens) else ""
            if token == "function":
                at = i + 1 + (word(i + 1) == "*")
                name = word(at) if word(at + 1) == "(" else None
            elif token in _BINDING and word(i + 2) == "=" and _is_function(tokens, i + 3):
                name = word(i + 1)
            if name:
                found.append([name, line, last])
                open_.append([found[-1], depth, False])
        if token == "{":
            for entry in open_:
                entry[2] = True
            depth += 1
        elif token == "}":
            depth -= 1
            while open_ and open_[-1][2] and depth <= open_[-1][1]:
                open_.pop()[0][2] = line
    if tokens and tokens[-1][0] == ";":
        for entry in [e for e in open_ if not e[2]]:
            entry[0][2] = tokens[-1][1]
    return [tuple(f) for f in found]


def extract_functions(files: DataFrame) -> DataFrame:
    """path, name, start_line, end_line, lines for files (path, text). Null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, name, a, b, b - a + 1) for p, t in zip(pdf["path"], pdf["text"], strict=True) if isinstance(t, str) for name, a, b in functions_in(t)]
            yield pd.DataFrame(rows, columns=["path", "name", "start_line", "end_line", "lines"])

    return files.select("path", "text").mapInPandas(run, "path string, name string, start_line int, end_line int, lines int")
