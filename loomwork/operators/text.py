"""Line-level text scanning: sensitive fields, exemption markers, occurrence reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Families of sensitive fields, in the order in which they are tried: name, keys, least length of a value.
SENSITIVE_KEYS = [
    ("cookie", ["cookie", "cookies"], 4),
    ("device", ["device_id", "device-id", "deviceid", "device_name", "device-info", "machine_id", "machine-id", "hardware_id", "hardware-id", "imei", "serial_number", "serial-number"], 2),
    ("username", ["username", "user_name", "user-name", "login_name", "login-name"], 2),
    ("password", ["password", "passwd", "pass_word", "pass-word", "pwd"], 3),
    ("token/secret", ["api_key", "api-key", "apikey", "api_secret", "api-secret", "access_key", "access-key", "auth_token", "auth-token", "refresh_token", "refresh-token", "secret_key", "secret-key", "client_secret", "client-secret"], 6),
]
# Literals that stand for a secret and are none, lines that give examples, and file names that are secrets by themselves.
PLACEHOLDER = r"(?i)^(your[-_ ]?[a-z]+|xxx+\.?\.?|example|changeme|dummy|sample|demo|placeholder|<[^>]+>|\$\{?[A-Z_][A-Z0-9_]*}?|process\.env\.[A-Z_]+|env\.[A-Z_]+|undefined|null|true|false)$"
EXAMPLE_LINE = r"(?i)(例如|举例|示例|样例|演示|比如|fake|sample|demo|example|illustration)"
SENSITIVE_NAMES = [".env", ".env.local", "github-token", "id_rsa", "id_ed25519", "id_ecdsa", "*.pem", "*.key"]


def lines_of(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, line_no from 1 and line, a row for each line."""
    return rows.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


_LITERAL = r"""^(?:"([^"]*)"|'([^']*)'|`([^`]*)`)\s*[,;)\]}\s]*$"""


def quoted_value(line: Column, keys: list[str]) -> Column:
    """The trimmed quoted literal that a key is set to at the end of the line; null where it is no plain literal."""
    clean = F.regexp_replace(line, r"^[#;/*\s]+", "")
    raw = F.trim(F.regexp_extract(clean, r"(?i)(?:^|[^A-Za-z0-9_])(?:" + "|".join(keys) + r")\s*[:=]\s*(.*)$", 1))
    return F.when(raw.rlike(_LITERAL), F.trim(F.concat(*[F.regexp_extract(raw, _LITERAL, i) for i in (1, 2, 3)])))


def _family(values: list[Column]) -> Column:
    """The first family of SENSITIVE_KEYS whose literal on a line, of those given in their order, may be real."""
    out = F.lit(None).cast("string")
    for (name, _, least), value in reversed(list(zip(SENSITIVE_KEYS, values, strict=True))):
        real = (F.length(value) >= least) & ~value.rlike(r"\+|\$\{|[\x{4e00}-\x{9fff}]") & ~value.rlike(PLACEHOLDER)
        out = F.when(F.coalesce(real, F.lit(False)), name).otherwise(out)
    return out


def sensitive_field(line: Column, marker: str = "skip-sensitive") -> Column:
    """The first family of SENSITIVE_KEYS that the line sets to a literal that may be real; null for exempt and example lines."""
    exempt = line.rlike(f"(?i){marker}") | line.rlike(EXAMPLE_LINE)
    return F.when(~exempt, _family([quoted_value(line, keys) for _, keys, _ in SENSITIVE_KEYS]))


def sensitive_lines(rows: DataFrame, key: str, text: str, marker: str = "skip-sensitive") -> DataFrame:
    """key, line_no and field of every line that sets a sensitive field."""
    lines = lines_of(rows, text, key).filter(F.col("line").rlike("[:=]") & ~F.col("line").rlike(f"(?i){marker}") & ~F.col("line").rlike(EXAMPLE_LINE))
    # literals are columns of their own, so that each is made once
    values = [quoted_value(F.col("line"), keys).alias(f"_v{i}") for i, (_, keys, _) in enumerate(SENSITIVE_KEYS)]
    found = lines.select(key, "line_no", *values)
    return found.select(key, "line_no", _family([F.col(f"_v{i}") for i in range(len(values))]).alias("field")).filter("field IS NOT NULL")


def sensitive_name(path: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a file's name is one of SENSITIVE_NAMES, or of more: the names under which a user's own tools keep tokens."""
    every = [*SENSITIVE_NAMES, *more]
    name = F.element_at(F.split(path, "/"), -1)
    out = name.isin([n for n in every if not n.startswith("*")])
    for n in every:
        if n.startswith("*"):
            out = out | name.endswith(n[1:])
    return out


# Endings of files that aren't read as text.
BINARY = r"(?i)\.(png|jpe?g|gif|webp|bmp|ico|svg|zip|7z|rar|gz|tar|xz|pdf|exe|dll|so|dylib|bin|woff2?|ttf|otf|mp[34]|ogg|wav|flac|db|sqlite)$"


def sensitive_files(files: DataFrame, path: str = "path", text: str = "text", marker: str = "skip-sensitive", most: int = 512 * 1024, more_names: tuple[str, ...] = ()) -> DataFrame:
    """path and fields of the files that hold something sensitive: "filename" alone where the name says it, else the families in the order of their first lines.

    Files over `most` bytes, binary ones, and those whose first three lines carry the marker are left out.
    """
    named = F.coalesce(sensitive_name(F.col(path), more_names), F.lit(False))
    by_name = files.filter(named).select(path, F.array(F.lit("filename")).alias("fields"))
    head = F.substring_index(F.coalesce(F.col(text), F.lit("")), "\n", 3)
    read = files.filter(~named & ~F.col(path).rlike(BINARY) & (F.octet_length(text) <= most) & ~F.col(text).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") & ~head.rlike(f"(?i){marker}"))
    first = sensitive_lines(read, path, text, marker).groupBy(path, "field").agg(F.min("line_no").alias("line_no"))
    # as many fields as there are families at most
    fields = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "field"))), lambda x: x["field"])
    return by_name.unionByName(first.groupBy(path).agg(fields.alias("fields")))


# Rules that files of a kind may break on purpose: paths of the kind, words of the rules.
CATEGORIES = [
    (r"(^|/)test/", ["residue", "console-log", "sync-fs", "empty-catch", "performance"]),
    (r"(^|/)(scripts/|cli\.mjs$)", ["residue", "console-log", "sync-fs"]),
]


def category_exempt(file: Column, rule: Column, kind: Column) -> Column:
    """Whether a file's path and a word of the finding's rule or kind exempt it by category."""
    target = F.lower(F.concat_ws(" ", F.coalesce(rule, F.lit("")), F.coalesce(kind, F.lit(""))))
    out = F.lit(False)
    for pattern, words in CATEGORIES:
        out = out | (F.coalesce(file.cast("string"), F.lit("")).rlike(pattern) & target.rlike("|".join(words)))
    return out


# What each exemption marker covers: kinds, words that a rule must hold, words that it mustn't, whether a line may carry it.
SECURITY_WORDS = ["security", "credential", "credref", "credfile", "secret", "password", "hardcoded"]
STYLE_WORDS = ["min-length", "max-lines", "max-complexity", "max-depth", "min-occurrences", "repeated-string"]
MARKERS = [
    ("sensitive", ["[FUNC]", "credential-file", "credential-ref", "path-regex", "regex", "semantic"], SECURITY_WORDS, ["regex", "semantic"], [], True),
    ("size", ["binary", "large-file"], [], [], [], False),
    ("func-length", ["func-lines"], [], [], [], True),
    ("complexity", ["max-complexity", "max-depth"], [], [], [], True),
    ("syntax", ["syntax", "json-parse", "yaml-parse"], [], [], [], False),
    ("quality", ["func-lines", "empty-catch", "sync-fs", "magic-number-smart", "blacklist", "comment-density", "file-health", "button-bind", "scope-collision", "semantic", "dataflow", "duplicate-const", "repeated-string", "regex"], [], [], SECURITY_WORDS, False),
    ("residue", ["regex"], ["debugger", "todo", "console", "io-risk", "client-node-builtin-require"], ["regex"], [], True),
    ("style", ["regex", "min-occurrences", "min-length", "max-lines", "max-complexity", "max-depth", "repeated-string"], STYLE_WORDS, ["regex"], [], False),
    ("i18n", ["regex"], ["i18n"], ["regex"], [], True),
]
_MARKER_SCHEMA = "ord int, marker string, kinds array<string>, words array<string>, word_kinds array<string>, not_words array<string>, on_line boolean"


def markers(spark, prefix: str = "skip-") -> DataFrame:
    return spark.createDataFrame([(i, prefix + m[0], *m[1:]) for i, m in enumerate(MARKERS)], _MARKER_SCHEMA)


def covers(kind: Column, rule: Column) -> Column:
    """Whether a marker's row covers a finding of this kind and rule."""
    r = F.lower(F.coalesce(rule, F.lit("")))
    wanted = F.exists("words", lambda w: F.contains(r, w))
    unwanted = F.exists("not_words", lambda w: F.contains(r, w))
    by_word = F.when(F.array_contains("word_kinds", kind), wanted).when(kind == "regex", ~unwanted).otherwise(F.lit(True))
    return F.array_contains("kinds", kind) & by_word


def exempt(findings: DataFrame, files: DataFrame, catalogue: DataFrame, file: str = "file", line: str = "line", text: str = "text") -> DataFrame:
    """findings (id, file, line, kind, rule) with exempt: by category, or a covering marker stands in the file's first three lines or, if it may, on the line.

    Texts meet the places of findings once, and leave with their head and the one line.
    """
    rows = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    head, here = F.array_join(F.slice(rows, 1, 3), "\n"), F.coalesce(F.get(rows, F.col("_line") - 1), F.lit(""))
    places = findings.select(file, F.col(line).alias("_line")).distinct()
    read = places.join(files.select(file, text), file).select(F.col(file).alias("_file"), "_line", head.alias("_head"), here.alias("_here"))
    joined = findings.join(read, (F.col(file) == F.col("_file")) & F.col(line).eqNullSafe(F.col("_line")), "left").join(F.broadcast(catalogue), covers(F.col("kind"), F.col("rule")), "left")
    hit = F.contains("_head", F.col("marker")) | (F.col("on_line") & F.contains("_here", F.col("marker"))) | category_exempt(F.col(file), F.col("rule"), F.col("kind"))
    return joined.groupBy(*findings.columns).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("exempt"))


def hint(findings: DataFrame, catalogue: DataFrame, last: str) -> DataFrame:
    """findings with hint: the first marker that covers each, the general one (last) after all others."""
    joined = findings.join(F.broadcast(catalogue), covers(F.col("kind"), F.col("rule")), "left")
    place = F.when(F.col("marker") == last, 1_000).otherwise(F.col("ord"))
    return joined.groupBy(*findings.columns).agg(F.min_by("marker", place).alias("hint"))
