"""Column parsers of the line and text formats that version control, test runners and manifests write."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(line: Column, pattern: str, group: int, name: str) -> Column:
    return F.regexp_extract(line, pattern, group).alias(name)


def tree_entry(line: Column) -> Column:
    """struct<mode, type, sha, path> of a line of a recursive tree listing; null for others."""
    pattern = r"^(\d+)\s+(\w+)\s+([0-9a-f]+)\t(.*)$"
    return F.when(line.rlike(pattern), F.struct(*[_field(line, pattern, i + 1, n) for i, n in enumerate(("mode", "type", "sha", "path"))]))


def remote_entry(line: Column) -> Column:
    """struct<name, url, kind> of a line of remotes, kind being fetch or push."""
    pattern = r"^(\S+)\s+(\S+)\s+\((fetch|push)\)\s*$"
    return F.when(line.rlike(pattern), F.struct(*[_field(line, pattern, i + 1, n) for i, n in enumerate(("name", "url", "kind"))]))


def grep_hit(line: Column) -> Column:
    """struct<file, line, text> of a line of search hits; a file name holds no colon."""
    pattern = r"^([^:]+):(\d+):(.*)$"
    return F.when(line.rlike(pattern), F.struct(_field(line, pattern, 1, "file"), F.regexp_extract(line, pattern, 2).try_cast("int").alias("line"), F.trim(F.regexp_extract(line, pattern, 3)).alias("text")))


def mode_change(line: Column) -> Column:
    """The path of a line that says that nothing but a file's mode has changed; null for others."""
    return F.nullif(F.trim(F.regexp_extract(line, r"^ mode change \d+ => \d+ (.+)$", 1)), F.lit(""))


def tree_blobs(trees: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, path, sha and size of the blobs in trees given as JSON. A truncated tree has none: half a tree is no tree."""
    whole = F.from_json(text, "truncated boolean, tree array<struct<path:string,type:string,sha:string,size:long>>")
    entries = trees.select(*keep, whole.alias("_t")).filter(~F.coalesce("_t.truncated", F.lit(False))).select(*keep, F.explode("_t.tree").alias("e"))
    return entries.filter("e.type = 'blob'").select(*keep, "e.path", "e.sha", F.coalesce("e.size", F.lit(0)).alias("size"))


# Manifests that hold a project's version, in the order in which they are looked for.
MANIFESTS = ("package.json", "pyproject.toml", "Cargo.toml", "composer.json", "setup.cfg")


def manifest_version(file: Column, text: Column) -> Column:
    """The version that a manifest states, by its format; blank where it states none."""
    quoted = F.regexp_extract(text, r"""(?m)^\s*version\s*=\s*["']([^"']+)["']""", 1)
    bare = F.regexp_extract(text, r"(?m)^\s*version\s*=\s*([^\s#]+)", 1)
    stated = F.when(file.endswith(".json"), F.get_json_object(text, "$.version")).when(file.endswith(".toml"), quoted).when(file == "setup.cfg", bare)
    return F.trim(F.coalesce(stated, F.lit("")))


def project_version(files: DataFrame, project: str, file: str = "file", text: str = "text") -> DataFrame:
    """project, source and version: of the manifests that a project has, the first in order decides, even if it states none."""
    place = F.array_position(F.array(*[F.lit(m) for m in MANIFESTS]), F.col(file))
    found = files.filter(place > 0).groupBy(project).agg(F.min_by(F.struct(file, text), place).alias("_m"))
    return found.select(project, F.col(f"_m.{file}").alias("source"), manifest_version(F.col(f"_m.{file}"), F.col(f"_m.{text}")).alias("version"))


def key_values(text: Column, bullet: str = "- ") -> Column:
    """map<string, string> of the lines "- key: value" of a text; ordinary and full-width colons part them, the last of one key counts."""
    pattern = re.escape(bullet) + r"([^：:]+)[：:](.*)"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s.rlike("^" + pattern + "$"))
    pairs = F.transform(lines, lambda s: F.struct(F.trim(F.regexp_extract(s, "^" + pattern + "$", 1)).alias("k"), F.trim(F.regexp_extract(s, "^" + pattern + "$", 2)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def tool_map(value: Column) -> Column:
    """map<string, string> of "name=version / name=version"; parts without = are left out."""
    parts = F.filter(F.split(value, " / "), lambda p: F.contains(p, F.lit("=")) & (F.trim(F.get(F.split(p, "="), F.lit(0))) != ""))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.get(F.split(p, "="), F.lit(0))), F.trim(F.get(F.split(p, "="), F.lit(1))))))


def tap_counters(output: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """keep, key and total of the counter lines "# key n" of test outputs, summed over all of them."""
    pattern = r"(?m)^# (\w+) (\d+)"
    lines = output.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("l"))
    return lines.groupBy(*keep, F.regexp_extract("l", pattern, 1).alias("key")).agg(F.sum(F.regexp_extract("l", pattern, 2).cast("long")).alias("total"))


# Fixed value: a version's form in running text.
def version_mention(text: Column) -> Column:
    """The first three-part version in a text, without its v, that stands as a word; blank if there is none."""
    return F.regexp_extract(text, r"\bv?(\d+\.\d+\.\d+)\b", 1)


# The forms of a relative import.
IMPORTS = (
    r"""from\s+['"](\.[^'"]+)['"]""",
    r"""import\s*\(\s*['"](\.[^'"]+)['"]\s*\)""",
    r"""require\(\s*['"](\.[^'"]+)['"]\s*\)""",
)


def relative_imports(text: Column) -> Column:
    """array<string> of the distinct relative paths that a source text imports."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(form), F.lit(1)) for form in IMPORTS])
    return F.array_distinct(found)


def import_edges(files: DataFrame, endings: tuple[str, ...] = ("", ".js", ".mjs", "/index.js", "/index.mjs")) -> DataFrame:
    """(src, dst) of files (path, text) that import each other: of the endings that lead to a file, the first counts."""
    specs = files.select(F.col("path").alias("src"), F.explode(relative_imports(F.col("text"))).alias("spec"))
    tried = specs.select("src", "spec", F.posexplode(F.array(*[resolved(F.col("src"), F.concat("spec", F.lit(e))) for e in endings])).alias("i", "dst"))
    # as large as the files: not to be sent through the driver, whatever its size is taken for
    found = tried.join(files.select(F.col("path").alias("dst")).hint("merge"), "dst", "left_semi")
    return found.groupBy("src", "spec").agg(F.min_by("dst", "i").alias("dst")).select("src", "dst").distinct()


def resolved(file: Column, relative: Column) -> Column:
    """The path that a relative one means in a file's directory, with . and .. followed."""
    parts = F.concat(F.slice(F.split(file, "/"), F.lit(1), F.greatest(F.size(F.split(file, "/")) - 1, F.lit(0))), F.split(relative, "/"))
    step = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


# How a source text lists its flags.
def entry_flags(source: Column) -> Column:
    """array<string> of the flags in a source text's list of known ones."""
    listed = F.regexp_extract(source, r"(?s)const KNOWN_FLAGS = \[(.*?)\];", 1)
    return F.regexp_extract_all(listed, F.lit("'(--[a-z0-9-]+)'"), F.lit(1))


def registry_prefix(url: Column) -> Column:
    """//host/path/ of a registry's url, before which its token is kept; blank where it is none."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)"
    path = F.regexp_replace(F.regexp_extract(url, pattern, 2), "/?$", "")
    return F.when(url.rlike(pattern), F.concat(F.lit("//"), F.lower(F.regexp_extract(url, pattern, 1)), path, F.lit("/"))).otherwise("")


def registry_url(url: Column, default: str) -> Column:
    """A registry's url without its last slash; the default where it is blank or no url."""
    bare = F.trim(F.coalesce(url, F.lit("")))
    return F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]+"), F.regexp_replace(bare, "/$", "")).otherwise(default)


def escaped_pattern(text: Column) -> Column:
    """The text with a backslash before each character that means something in a regular expression."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def front_matter_name(text: Column) -> Column:
    """The name that a document's front matter gives; null without one."""
    head = F.regexp_extract(text, r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, r"(?m)^name:\s*(.+)$", 1), "^['\"]|['\"]$", "")), F.lit(""))


# Directories that only one machine has, and what a path in a hook looks like.
MACHINE_PATH = r"^/(?:volume\d+|home|Users|Volumes|mnt|opt/[^/]+/target)\b"
_PATHS = r"""(?:^|[\s'"`=])(/[A-Za-z0-9._\-/]{3,})"""


def hook_faults(hooks: DataFrame, existing: DataFrame) -> DataFrame:
    """name and fault of executable hooks (name, executable, text): interpreter, path, or null for sound ones.

    A hook is broken if its absolute interpreter isn't in existing (path), or else if it names an
    absolute path of one machine that isn't.
    """
    live = hooks.filter("executable")
    interpreter = F.regexp_extract("text", r"^#!\s*(\S+)", 1)
    named = F.concat(F.array(F.struct(F.lit("interpreter").alias("fault"), interpreter.alias("path"))), F.transform(F.regexp_extract_all("text", F.lit(_PATHS), F.lit(1)), lambda p: F.struct(F.lit("path").alias("fault"), p.alias("path"))))
    wanted = live.select("name", F.explode(named).alias("n")).select("name", "n.fault", "n.path")
    wanted = wanted.filter(F.when(F.col("fault") == "interpreter", F.startswith("path", F.lit("/"))).otherwise(F.col("path").rlike(MACHINE_PATH)))
    # an interpreter comes before a path in the alphabet as well
    broken = wanted.join(existing.select("path").distinct(), "path", "left_anti").groupBy("name").agg(F.min("fault").alias("fault"))
    return live.select("name").join(broken, "name", "left")


def ignore_additions(existing: DataFrame, baseline: list[str], custom: DataFrame) -> DataFrame:
    """repo, line and kind of the lines that ignore lists (repo, line) lack: the baseline's, with or without a last slash, and custom ones (repo, line)."""
    have = existing.select("repo", F.trim("line").alias("line")).distinct()
    repos = existing.select("repo").unionByName(custom.select("repo")).distinct()
    wanted = repos.select("repo", F.explode(F.array(*[F.lit(b) for b in baseline])).alias("line"))
    bare = have.select("repo", F.regexp_replace("line", "/$", "").alias("bare")).distinct()
    base = wanted.withColumn("bare", F.regexp_replace("line", "/$", "")).join(bare, ["repo", "bare"], "left_anti").select("repo", "line", F.lit("baseline").alias("kind"))
    own = custom.select("repo", F.trim("line").alias("line")).filter("line <> ''").distinct().join(have, ["repo", "line"], "left_anti")
    return base.unionByName(own.select("repo", "line", F.lit("custom").alias("kind")))
