"""From signals to a verdict: overrides, filters, ignore rules, baseline, grouping, summary."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatid.operators import filters, grouping


@dataclass
class Options:
    overrides: dict[str, str] = field(default_factory=dict)
    min_severity: str = "info"
    kind: str | None = None
    ignore: list[tuple[str, str | None]] = field(default_factory=list)
    min_group_size: int = 2
    path_globs: list[str] = field(default_factory=list)


def select(signals: DataFrame, options: Options, baseline: DataFrame | None = None) -> DataFrame:
    """The signals that count: severities are overridden before they are filtered, and the baseline comes last."""
    s = filters.min_severity(filters.override_severity(signals, options.overrides), options.min_severity)
    if options.kind:
        s = filters.of_type(s, options.kind)
    s = filters.ignore(s, options.ignore)
    return s if baseline is None else filters.new_since(s, baseline)


def grouped(signals: DataFrame, options: Options, baseline: DataFrame | None = None) -> DataFrame:
    """Groups of the signals that count (see grouping.groups)."""
    s = select(signals, options, baseline)
    return grouping.groups(grouping.assign(s, options.min_group_size, grouping.keys(options.path_globs)))


def verdict(signals: DataFrame, options: Options, fail_on: str = "critical", baseline: DataFrame | None = None, **limits: int) -> DataFrame:
    """One row: counts by severity and the exit code."""
    return filters.summary(select(signals, options, baseline)).withColumn("exit_code", filters.exit_code(fail_on, **limits).cast("int"))
