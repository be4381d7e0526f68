"""Reports as rows of text, and edits to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatid.operators import filters
from chromatid.schemas import severity_rank


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def markdown(signals: DataFrame) -> DataFrame:
    """(value) of a Markdown list of signals (severity, type, entity_name, message, seq), most severe first."""
    line = F.format_string("- **%s** %s `%s`: %s", "severity", "type", "entity_name", "message")
    return filters.by_severity(signals).select(line.alias("value"))


def worst_first(signals: DataFrame, k: int = 10) -> DataFrame:
    return signals.orderBy(severity_rank(F.col("severity")).desc(), "seq").limit(k)


def apply_fixes(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, line, text) of files' lines (path, line, text) with fixes (path, line, column, original, replacement) made from the right to the left.

    A fix whose original isn't at its column is made at the first place it is found from there, else at its first place on the line, else not at all.
    A line's fixes are few; they fold over the line's text.
    """
    by = fixes.groupBy("path", "line").agg(F.sort_array(F.collect_list(F.struct("column", "original", "replacement")), asc=False).alias("all"))

    both = lines.join(by, ["path", "line"], "left")
    folded = F.expr(
        "aggregate(all, text, (t, f) -> CASE"
        " WHEN locate(f.original, t, f.column) > 0 THEN overlay(t placing f.replacement from locate(f.original, t, f.column) for char_length(f.original))"
        " WHEN locate(f.original, t) > 0 THEN overlay(t placing f.replacement from locate(f.original, t) for char_length(f.original)) ELSE t END)"
    )
    return both.select("path", "line", F.coalesce(folded, "text").alias("text"))
