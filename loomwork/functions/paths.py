"""Column functions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parse


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def ancestors(path: Column) -> Column:
    """All enclosing directories of a relative path, outermost first, itself left out."""
    parts = segments(path)
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: (i > 0) & (i < F.size(parts))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def within(root: str, path: Column) -> Column:
    """Whether the path is the root or lies under it; a sibling that merely begins alike doesn't."""
    bare = root.rstrip("/")
    return (path == bare) | path.startswith(bare + "/") if bare else path.startswith("/")


def in_scope(path: Column, scope: list[str]) -> Column:
    """Equal to a listed path or under a listed directory; an empty scope holds everything."""
    if not scope:
        return F.lit(True)
    held = within(scope[0], path)
    for s in scope[1:]:
        held = held | within(s, path)
    return held


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; blank without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def joined(folder: Column, relative: Column) -> Column:
    """The path that a relative one means in a folder."""
    return parse.resolved(F.when(folder == "", "_").otherwise(F.concat(folder, F.lit("/_"))), relative)


def side(path: Column) -> Column:
    """The first segment of a path of several; blank for a file at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise("")
