"""Commit history as tables: commits (sha, author, email, timestamp), changes (sha, path, insertions, deletions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.functions.ids import short_sha
from chromatid.operators import fill

# Paths that hold a design system's own files.
DESIGN_PATHS = r"(^|/)(tokens?|theme|themes|styles?|design-system|components?|ui)(/|\.)|\.(css|scss|less)$|tailwind\.config\."


def developers(commits: DataFrame) -> DataFrame:
    """(developer_id, email, name, commits, first_at, last_at), by lower-case email; the name is that of the first commit."""
    by = commits.groupBy(F.lower("email").alias("email")).agg(
        F.min_by("author", F.struct("timestamp", "sha")).alias("name"), F.count(F.lit(1)).alias("commits"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")
    )
    return by.withColumn("developer_id", short_sha(F.col("email")))


def authored(commits: DataFrame) -> DataFrame:
    """(src, dst): edges from developers to their commits."""
    return commits.select(short_sha(F.lower("email")).alias("src"), F.col("sha").alias("dst"))


def change_status(insertions: Column, deletions: Column) -> Column:
    """added, deleted or modified, by line counts alone."""
    return F.when((insertions > 0) & (deletions == 0), "added").when((insertions == 0) & (deletions > 0), "deleted").otherwise("modified")


def design_history(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits that touch design files."""
    return commits.join(changes.where(F.col("path").rlike(DESIGN_PATHS)).select("sha").distinct(), "sha", "left_semi")


def file_history(commits: DataFrame, changes: DataFrame, path: str, limit: int = 50) -> DataFrame:
    """The last commits of one file."""
    return commits.join(changes.where(F.col("path") == path).select("sha").distinct(), "sha", "left_semi").orderBy(F.desc("timestamp"), "sha").limit(limit)


def active_since(people: DataFrame, commits: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Developers (email) with a commit in the last days."""
    recent = commits.where(F.col("timestamp") >= now - F.make_dt_interval(F.lit(days))).select(F.lower("email").alias("email")).distinct()
    return people.join(recent, "email", "left_semi")


def blame(lines: DataFrame, segment: int = fill.SEGMENT) -> DataFrame:
    """(path, line, sha, author, email, authored, text) of annotated files as rows (path, n, text), n being a row's place: the porcelain format, with or without headers on every line.

    A header names the commit and the line that the rows behind it belong to, up to the next one; it is carried to them over segments of the file. What a commit says of
    itself is said once or often, so it is gathered by commit and file. Rows before any header are left out.
    """
    header = F.when(F.col("text").rlike("^[0-9a-f]{40} [0-9]+ [0-9]+"), F.struct(F.substring("text", 1, 40).alias("sha"), F.split("text", " ")[2].cast("int").alias("line")))
    rows = fill.carried(lines.select("path", "n", "text", header.alias("head")), "path", "n", "head", segment).where("head is not null")
    said = {"author": "^author (.*)$", "email": "^author-mail <?([^>]*)>?$", "authored": "^author-time ([0-9]+)$"}
    told = rows.where(F.col("text").rlike("^author(-mail|-time)? ")).groupBy("path", F.col("head.sha").alias("sha"))
    told = told.agg(*[F.max(F.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1))).alias(c) for c, p in said.items()])
    content = rows.where(F.col("text").startswith("\t")).select("path", "head.line", "head.sha", F.substring("text", 2, 1 << 30).alias("text"))
    out = content.join(told, ["path", "sha"], "left")
    return out.select("path", "line", "sha", "author", "email", F.timestamp_seconds(F.col("authored").cast("long")).alias("authored"), "text")
