"""Filters, overrides and verdicts over drift signals (id, type, severity, entity_name, location, seq, ...)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.functions.strings import glob_regex
from chromatid.schemas import SEVERITIES, severity_rank


def min_severity(signals: DataFrame, least: str) -> DataFrame:
    return signals.where(severity_rank(F.col("severity")) >= SEVERITIES.index(least))


def of_type(signals: DataFrame, kind: str) -> DataFrame:
    return signals.where(F.col("type") == kind)


def override_severity(signals: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Severity by type where overrides has the type."""
    if not overrides:
        return signals
    by_type = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    return signals.withColumn("severity", F.coalesce(by_type[F.col("type")], "severity"))


def ignore(signals: DataFrame, rules: list[tuple[str, str | None]]) -> DataFrame:
    """Drops signals that a rule (type, pattern of the entity name or None) fits; a pattern that doesn't compile drops nothing."""
    for kind, pattern in rules:
        fits = F.col("type") == kind
        if pattern is not None:
            try:
                re.compile(pattern)
            except re.error:
                continue
            fits = fits & F.coalesce(F.col("entity_name").rlike(pattern), F.lit(False))
        signals = signals.where(~fits)
    return signals


def new_since(signals: DataFrame, baseline: DataFrame) -> DataFrame:
    """Signals whose id isn't in the baseline; ids needn't be unique on either side."""
    return signals.join(baseline.select("id").distinct(), "id", "left_anti")


def suppressed_by(signals: DataFrame, baseline: DataFrame) -> DataFrame:
    return signals.join(baseline.select("id").distinct(), "id", "left_semi")


def staged(signals: DataFrame, files: DataFrame) -> DataFrame:
    """Signals without a location, or in one of files (path): equal, or one path the end of the other.

    Paths meet on their last segment, so this is an equi-join with a condition, not a loop over pairs.
    """
    file = F.regexp_replace(F.col("location"), r":\d+(:\d+)?$", "")
    last = lambda c: F.substring_index(c, "/", -1)
    f = files.select(F.col("path").alias("_path"), last(F.col("path")).alias("_last")).distinct()
    s = signals.withColumn("_file", file)
    near = (last(F.col("_file")) == F.col("_last")) & (F.col("_file").endswith(F.col("_path")) | F.col("_path").endswith(F.col("_file")))
    return s.where("location is not null").join(f, near, "left_semi").unionByName(s.where("location is null")).drop("_file")


def by_severity(signals: DataFrame) -> DataFrame:
    """Most severe first, then in input order."""
    return signals.orderBy(severity_rank(F.col("severity")).desc(), "seq")


def matches_globs(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether any include glob (if there are any) and no exclude glob fits: all of the path, its end after a /, or a directory above."""

    def fits(glob: str) -> Column:
        body = glob_regex(glob, escape=True)[1:-1]
        return path.rlike(f"^(.*/)?{body}(/.*)?$")

    kept = F.lit(True)
    if include:
        kept = F.lit(False)
        for g in include:
            kept = kept | fits(g)
    for g in exclude:
        kept = kept & ~fits(g)
    return kept


def active_intents(signals: DataFrame, intents: DataFrame, now: Column) -> DataFrame:
    """Signals that an active, unexpired intent (drift_id, status, expires_at) decides on."""
    live = intents.where((F.col("status") == "active") & (F.col("expires_at").isNull() | (now <= F.col("expires_at"))))
    return signals.join(live.select(F.col("drift_id").alias("id")).distinct(), "id", "left_semi")


def summary(signals: DataFrame) -> DataFrame:
    """One row: total and count by severity."""
    return signals.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in reversed(SEVERITIES)])


def any_at_least(signals: DataFrame, severity: str) -> DataFrame:
    """One row: whether any signal is that severe."""
    return signals.agg(F.coalesce(F.bool_or(severity_rank(F.col("severity")) >= SEVERITIES.index(severity)), F.lit(False)).alias("exceeds"))


def exit_code(fail_on: str, max_drift: int | None = None, max_critical: int | None = None, max_warning: int | None = None) -> Column:
    """1 or 0 over a summary row: limits first, then whether anything is as severe as fail_on (or none)."""
    over = F.lit(False)
    for column, limit in (("total", max_drift), ("critical", max_critical), ("warning", max_warning)):
        if limit is not None:
            over = over | (F.col(column) > limit)
    if fail_on != "none":
        for s in SEVERITIES[SEVERITIES.index(fail_on) :]:
            over = over | (F.col(s) > 0)
    return F.when(over, 1).otherwise(0)


def fix_problem(path: Column, line: Column, column: Column, original: Column, replacement: Column) -> Column:
    """Why a fix can't be applied, or null."""
    return (
        F.when(path.isNull() | (path == "") | path.contains("\0"), "invalid path")
        .when(line.isNull() | (line < 1), "invalid line")
        .when(column.isNull() | (column < 1), "invalid column")
        .when(original == replacement, "no change")
    )
