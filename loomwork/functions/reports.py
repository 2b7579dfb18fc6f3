"""Shapes of reports and settings: credential and module checks, digests over files, outcomes in words, overlays of settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _given(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


# What a reason says of bad credentials, what an application's id looks like, which entries are for browsers.
_BAD_CREDENTIALS = r"(?i)Bad credentials|credential|401\b"
_CLIENT_ID = r"^[A-Za-z0-9._-]{8,120}$"
_BROWSER = r"(?i)(^|/)client(/|\.js)?(/|$)|browser"


def bad_credentials(reason: Column) -> Column:
    return F.coalesce(reason, F.lit("")).rlike(_BAD_CREDENTIALS)


def client_id(value: Column) -> Column:
    """Whether a value can be the id of an authorised application."""
    return F.trim(F.coalesce(value, F.lit(""))).rlike(_CLIENT_ID)


def browser_entry(key: Column) -> Column:
    """Whether a package's entry is meant for browsers."""
    return F.regexp_replace(key, r"^\./", "").rlike(_BROWSER)


def module_target(target: Column) -> Column:
    """Whether an export's target can be imported: a directory, a module by its ending, or nothing stated."""
    ending = F.lower(F.regexp_extract(target, r"(\.[^./]*)$", 1))
    return F.coalesce(F.endswith(target, F.lit("/")) | ending.isin(".js", ".mjs", ".cjs"), F.lit(True))


def closure_key(path: str, text: str, head: str) -> Column:
    """Aggregate: the digest of head and of the files of a group, each by path and text, in the order of their paths. Groups are closures of one file, so their files are few."""
    files = F.transform(F.array_sort(F.collect_list(F.struct(path, text))), lambda f: F.concat(f[path], F.lit("\n"), F.coalesce(f[text], F.lit("<missing>")), F.lit("\n")))
    return F.sha2(F.concat(F.lit(head), F.array_join(files, "")), 256)


def push_outcome(ok: Column, dry_run: Column, pushed: Column, committed: Column, verified: Column, error: Column, blocked: Column) -> Column:
    """struct<status, detail> of a push: failures before trials before what was verified."""
    outcome = lambda status, detail: F.struct(F.lit(status).alias("status"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    done, failed = "completed", "failed"
    why = F.coalesce(error, F.when(blocked, "blocked").otherwise("unfinished"))
    out = (
        F.when(~F.coalesce(ok, F.lit(True)), outcome(failed, why))
        .when(dry_run, outcome(done, "dry run"))
        .when(pushed & (verified == F.lit(False)), outcome(failed, "remote not updated"))
        .when(pushed & verified.isNull(), outcome(done, "pushed, not verified"))
        .when(pushed & ~committed, outcome(done, "pushed earlier commits"))
        .when(pushed, outcome(done, "pushed and verified"))
        .when(~committed, outcome(done, "no changes"))
    )
    return out.otherwise(outcome(done, "committed, not pushed"))


def clone_outcome(ok: Column, canceled: Column, error: Column) -> Column:
    failed = ~F.coalesce(ok, F.lit(True)) | _given(error)
    status = F.when(failed | canceled, "failed").otherwise("completed")
    return F.struct(status.alias("status"), F.when(failed, F.coalesce(error, F.lit("unknown"))).when(canceled, "canceled").otherwise("cloned").alias("detail"))


def patched(current: Column, patch: Column, allowed: list[str] | None = None, least: float | None = None, most: float | None = None) -> Column:
    """A setting after a patch: unknown words and blanks leave it as it is, numbers are held between their ends."""
    new = F.when(patch.isin(*allowed), patch) if allowed else patch
    if least is not None:
        new = F.greatest(new, F.lit(least))
    if most is not None:
        new = F.least(new, F.lit(most))
    return F.coalesce(F.when(patch.isNotNull(), new), current)


def credential(state: Column) -> Column:
    """struct<valid, login, checked, timeout> of a stored check (valid, login, checked_at, timeout), blanks and nulls made plain."""
    yes = lambda f: F.coalesce(state[f], F.lit(False))
    return F.struct(yes("valid").alias("valid"), F.coalesce(state["login"], F.lit("")).alias("login"), _given(state["checked_at"]).alias("checked"), yes("timeout").alias("timeout"))


def account_verdict(token: Column, ssh: Column) -> Column:
    """ok where both credentials hold, warn where one does, else err."""
    a, b = F.coalesce(token, F.lit(False)), F.coalesce(ssh, F.lit(False))
    return F.when(a & b, "ok").when(a | b, "warn").otherwise("err")


def parameter_types(params: Column) -> Column:
    """map<string, struct<type, description>> of an array<struct<flag, type, desc>>: types other than boolean and array are strings."""
    kind = lambda p: F.when(p["type"].isin("array", "boolean"), p["type"]).otherwise("string")
    return F.map_from_entries(F.transform(params, lambda p: F.struct(p["flag"], F.struct(kind(p).alias("type"), F.coalesce(p["desc"], F.lit("")).alias("description")))))


def scan_line(name: Column, branch: Column, changed: Column, ahead: Column) -> Column:
    """A repository in a list: a full mark where something is uncommitted or unpushed."""
    dirty, front = F.coalesce(changed, F.lit(0)), F.coalesce(ahead, F.lit(0))
    mark = F.when((dirty > 0) | (front > 0), "* ").otherwise("- ")
    parts = F.concat_ws("  ", F.concat(mark, name), F.concat(F.lit("["), F.coalesce(F.nullif(branch, F.lit("")), F.lit("(empty)")), F.lit("]")), F.when(dirty > 0, F.concat(F.lit("uncommitted "), dirty.cast("string"))), F.when(front > 0, F.concat(F.lit("unpushed "), front.cast("string"))))
    return F.concat(F.lit("  "), parts)


def rewrite_line(name: Column, skipped: Column, reason: Column, branches: Column) -> Column:
    """A repository in a report of rewritten identities, of array<struct<branch, hits, pushed>>; no secret can enter it."""
    one = lambda b: F.concat(b["branch"], F.when(b["hits"] == 0, "=none").otherwise(F.concat(F.lit("="), b["hits"].cast("string"), F.when(b["pushed"], " pushed").otherwise(""))))
    return F.when(skipped, F.concat(F.lit("- "), name, F.lit(": skipped, "), reason)).otherwise(F.concat(F.lit("- "), name, F.lit(": "), F.array_join(F.transform(branches, one), ", ")))


def preview(items: Column, most: int) -> Column:
    """The first items, one a line, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), "\n"), F.when(more > 0, F.concat(F.lit("\n+"), more.cast("string"))).otherwise(""))
