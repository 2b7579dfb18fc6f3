"""Projections of service records: issues, pull requests, commits, runs, packages, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _given(c: Column) -> Column:
    """Blank counts as missing."""
    return F.nullif(F.trim(c), F.lit(""))


def issues(items: DataFrame) -> DataFrame:
    """True issues of (number, title, state, user, labels, comments, created_at, updated_at, pull_request): label objects become names."""
    names = F.transform("labels", lambda x: x["name"])
    return items.filter(F.col("pull_request").isNull()).select("number", "title", "state", F.col("user.login").alias("user"), names.alias("labels"), "comments", "created_at", "updated_at")


def pulls(items: DataFrame) -> DataFrame:
    return items.select("number", "title", "state", "draft", F.col("merged_at").isNotNull().alias("merged"), F.col("user.login").alias("user"), F.col("head.ref").alias("head"), F.col("base.ref").alias("base"))


def short_commits(commits: DataFrame) -> DataFrame:
    """sha of eight characters and the first line of the message."""
    return commits.select(F.left("sha", F.lit(8)).alias("sha"), F.get(F.split("message", "\n"), F.lit(0)).alias("title"))


def branch_heads(commits: DataFrame, n: int = 3) -> DataFrame:
    """The newest n commits: sha of seven characters, title and date; rows without a sha are left out."""
    known = commits.filter(_given(F.col("sha")).isNotNull())
    return known.orderBy(F.desc("date"), "sha").limit(n).select(F.left("sha", F.lit(7)).alias("sha"), F.get(F.split("message", "\n"), F.lit(0)).alias("title"), "date")


def run_names(runs: DataFrame) -> DataFrame:
    """Runs of a commit with a name: its own, the title, or run and its id."""
    name = F.coalesce(_given(F.col("name")), _given(F.col("display_title")), F.concat(F.lit("run "), F.col("id").cast("string")))
    return runs.select("id", name.alias("name"), "status", "conclusion", "html_url", "event", "head_sha")


def cloud_repositories(repos: DataFrame) -> DataFrame:
    return repos.select("name", "full_name", F.when(F.col("private"), "private").otherwise("public").alias("visibility"), "default_branch", "pushed_at", F.left(F.coalesce("description", F.lit("")), F.lit(120)).alias("description"))


def commit_people(commits: DataFrame) -> DataFrame:
    """Author and committer; a missing committer is the author."""
    field = lambda who, f: F.coalesce(_given(F.col(f"committer.{f}")), F.col(f"author.{f}")) if who == "committer" else F.col(f"author.{f}")
    return commits.select("sha", *[field(w, f).alias(f"{w}_{f}") for w in ("author", "committer") for f in ("name", "email", "date")])


def quota(resources: DataFrame) -> DataFrame:
    """limit, used, remaining and the time of reset of each resource."""
    return resources.select("resource", "limit", "used", "remaining", F.timestamp_seconds("reset").alias("reset_at"))


def page_size(asked: Column, most: int = 100, default: int = 30) -> Column:
    return F.least(F.greatest(F.coalesce(asked, F.lit(default)), F.lit(1)), F.lit(most))


def total_length(content_range: Column, content_length: Column) -> Column:
    """Bytes of a whole download, from the range header before the length header."""
    return F.coalesce(F.nullif(F.regexp_extract(content_range, r"/(\d+)$", 1), F.lit("")).try_cast("bigint"), content_length.try_cast("bigint"))


def normalised(status: Column, data: Column, message: Column) -> Column:
    """struct<ok, data, error> of a response."""
    ok = status.between(200, 299)
    return F.struct(ok.alias("ok"), F.when(ok, data).alias("data"), F.when(~ok, F.coalesce(message, F.concat(F.lit("HTTP "), status.cast("string")))).alias("error"))


def without_secrets(config: DataFrame, secrets: list[str]) -> DataFrame:
    """The columns of secrets replaced by whether they are set."""
    return config.select(*[(_given(F.col(c)).isNotNull()).alias(f"has_{c}") if c in secrets else F.col(c) for c in config.columns])
