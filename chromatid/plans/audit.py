"""From source text to hard-coded values, their health, and a token vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromatid.operators import aggregate, tokenize
from chromatid.sources import extract


def values(files: DataFrame) -> DataFrame:
    """(category, value, file, scope, seq) of CSS files and of markup's styles (path, content)."""
    css = files.where(F.col("path").rlike(r"\.(css|scss|less)$")).select("path", "content")
    markup = extract.style_text(files.where(~F.col("path").rlike(r"\.(css|scss|less)$")))
    v = extract.css_values(css.unionByName(markup))
    kind = F.when(F.col("category") == "font-size", "typography").when(F.col("category") == "sizing", "spacing").otherwise(F.col("category"))
    return v.select(kind.alias("category"), "value", F.col("path").alias("file"), F.col("category").alias("scope"), F.col("pos").cast("long").alias("seq"))


def report(files: DataFrame) -> DataFrame:
    """The health row of the files' values."""
    return aggregate.health(values(files).where(F.col("category").isin("color", "spacing", "typography", "radius")))


def vocabulary(files: DataFrame) -> DataFrame:
    """(scope, name, value, n, orphan): colors, spacings and radii as tokens."""
    v = values(files)
    out = tokenize.color_tokens(tokenize.color_clusters(v.where("scope = 'color'")))
    sizes = tokenize.size_clusters(v.where("scope in ('spacing', 'sizing', 'font-size')"))
    out = out.unionByName(tokenize.size_tokens(sizes))
    radii = tokenize.radius_tokens(tokenize.size_clusters(v.where("scope = 'radius'")))
    return out.unionByName(radii).unionByName(tokenize.breakpoint_tokens(v.where("scope = 'breakpoint'")))
