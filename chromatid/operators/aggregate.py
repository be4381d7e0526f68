"""Counts, shares and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatid.functions import strings
from chromatid.schemas import severity_name, severity_rank


def _round(x: Column) -> Column:
    """Half up, for values of 0 and more or less alike."""
    return F.floor(x + 0.5)


def audit_categories(values: DataFrame) -> DataFrame:
    """(category, unique_count, total_usages) of values (category, value, file): counted by value first, so no category is one group."""
    by_value = values.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))
    return by_value.groupBy("category").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("n").alias("total_usages"))


def audit_top_values(values: DataFrame, k: int = 10) -> DataFrame:
    """(category, value, n, rank): each category's most common values; ties by value."""
    by_value = values.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("category").orderBy(F.desc("n"), "value")
    return by_value.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def audit_worst_files(values: DataFrame, k: int = 10) -> DataFrame:
    """(file, issue_count) of the k files with most values; ties by file."""
    return values.groupBy("file").agg(F.count(F.lit(1)).alias("issue_count")).orderBy(F.desc("issue_count"), "file").limit(k)


def health(values: DataFrame, close_matches: DataFrame | None = None) -> DataFrame:
    """One row (unique_values, total_usages, files_affected, score): 100 less 3 a distinct value, 1 a file, 0.5 an issue over 5 of the ten worst files, and 5 a close match."""
    totals = audit_categories(values).agg(
        F.coalesce(F.sum("unique_count"), F.lit(0)).alias("unique_values"), F.coalesce(F.sum("total_usages"), F.lit(0)).alias("total_usages")
    )
    by_file = values.groupBy("file").agg(F.count(F.lit(1)).alias("issue_count"))
    files = by_file.agg(F.count(F.lit(1)).alias("files_affected"))
    extra = audit_worst_files(values).agg(F.coalesce(F.sum(F.greatest(F.col("issue_count") - 5, F.lit(0))), F.lit(0)).alias("over"))
    close = close_matches.agg(F.count(F.lit(1)).alias("close")) if close_matches is not None else values.sparkSession.range(1).select(F.lit(0).alias("close"))
    raw = 100 - F.col("unique_values") * 3 - F.col("files_affected") - F.col("over") * 0.5 - F.col("close") * 5
    score = F.when(F.col("unique_values") == 0, F.lit(100)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), _round(raw)))).cast("int")
    one = totals.crossJoin(files).crossJoin(extra).crossJoin(close)  # one row each
    return one.select("unique_values", "total_usages", "files_affected", score.alias("score"))


def naming_patterns(components: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(pattern, n, share, dominant): the commonest pattern is dominant if its share is over the threshold."""
    by = components.groupBy(strings.naming_pattern(F.col("name")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    by = by.withColumn("share", F.col("n") / F.sum("n").over(whole))
    return by.withColumn("dominant", (F.col("share") > threshold) & (F.col("n") == F.max("n").over(whole)))


def naming_outliers(components: DataFrame, threshold: float = 0.6, least: int = 3, least_share: float = 0.1) -> DataFrame:
    """(id, name, pattern, dominant_pattern, percent) of components that differ from a dominant pattern of at least max(least, share) names."""
    by = naming_patterns(components, threshold)
    total = by.agg(F.sum("n").alias("total"))
    top = by.where("dominant").select(F.col("pattern").alias("dominant_pattern"), "n", "share").crossJoin(total)  # one row at most
    top = top.where(F.col("n") >= F.greatest(F.lit(float(least)), F.col("total") * least_share))
    c = components.select("id", "name", strings.naming_pattern(F.col("name")).alias("pattern"))
    found = c.join(F.broadcast(top), F.col("pattern") != F.col("dominant_pattern"))
    return found.select("id", "name", "pattern", "dominant_pattern", _round(F.col("share") * 100).cast("int").alias("percent"))


def prop_type_stats(props: DataFrame) -> DataFrame:
    """(prop, type, n, examples) of props (component, prop, type, seq): examples are the first three components by seq."""
    p = props.select(F.lower("prop").alias("prop"), "type", "component", "seq")
    order = Window.partitionBy("prop", "type").orderBy("seq")
    first = p.withColumn("k", F.row_number().over(order)).where("k <= 3").groupBy("prop", "type").agg(F.array_sort(F.collect_list(F.struct("k", "component"))).alias("e"))
    n = p.groupBy("prop", "type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return n.join(first, ["prop", "type"]).select("prop", "type", "n", "first_seq", F.transform("e", lambda x: x["component"]).alias("examples"))


def prop_type_conflicts(props: DataFrame, least: int = 3, share: float = 0.7) -> DataFrame:
    """(component, prop, type, dominant_type, seq) of props whose type isn't their name's dominant one (of at least ``share`` of at least ``least`` uses)."""
    p = props.select(F.lower("prop").alias("prop"), "type", "component", "seq")
    by = p.groupBy("prop", "type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    total = by.groupBy("prop").agg(F.sum("n").alias("total"), F.max_by(F.struct("type", "n"), F.struct("n", -F.col("first_seq"))).alias("top"))
    top = total.where((F.col("total") >= least) & (F.col("top.n") / F.col("total") >= share)).select("prop", F.col("top.type").alias("dominant_type"))
    return p.join(top, "prop").where("type <> dominant_type").select("component", "prop", "type", "dominant_type", "seq")


def handler_outliers(props: DataFrame, least: int = 5, percent: int = 70) -> DataFrame:
    """(component, prop, prefix, percent) of click and press handlers without the prefix (on or handle) that most of them have."""
    h = props.where(F.lower("prop").rlike("click|press"))
    prefix = F.when(F.col("prop").startswith("on"), "on").when(F.col("prop").startswith("handle"), "handle")
    by = h.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    total = by.agg(
        F.sum("n").alias("total"), F.max_by(F.struct("prefix", "n"), F.when(F.col("prefix").isNotNull(), F.struct("n", -F.col("first_seq")))).alias("top")
    ).select("total", "top.prefix", _round(F.col("top.n") / F.col("total") * 100).cast("int").alias("percent"))
    top = total.where((F.col("total") >= least) & (F.col("percent") >= percent)).select("prefix", "percent")
    return h.join(F.broadcast(top), ~F.col("prop").startswith(F.col("prefix"))).select("component", "prop", "prefix", "percent")


def class_patterns(occurrences: DataFrame, least: int = 2, tight: bool = False) -> DataFrame:
    """(pattern, n, files) of class strings (classes, file, line) that occur at least so often, sorted classes taken as one pattern."""
    pattern = strings.tight_class_pattern(F.col("classes")) if tight else strings.class_pattern(F.col("classes"))
    by = occurrences.withColumn("pattern", pattern).where("pattern <> ''").groupBy("pattern", "file").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("pattern").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files")).where(F.col("n") >= least)


def class_duplicates(occurrences: DataFrame, classes: int = 3, files: int = 2) -> DataFrame:
    """(pattern, n, files) of patterns of at least so many classes in at least so many files."""
    return class_patterns(occurrences, 1).where((F.size(F.split("pattern", " ")) >= classes) & (F.col("files") >= files))


def repeat_mistakes(signals: DataFrame, threshold: int = 2) -> DataFrame:
    """(type, component, n, files, severity, example) of types that a component has at least so often.

    The component is the entity name unless that has a / or a full stop; then the stem of the location's file; severity is the highest.
    """
    file = F.split_part(F.col("location"), F.lit(":"), F.lit(1))
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(file, "/", -1), r"\.(tsx?|jsx?|vue|svelte)$", ""), r"\.(component|spec|test|stories)$", "")
    plain = F.col("entity_name").isNotNull() & (F.col("entity_name") != "") & ~F.col("entity_name").rlike(r"[/.]")
    name = F.when(plain, F.col("entity_name")).otherwise(F.coalesce(F.nullif(stem, F.lit("")), F.nullif(F.col("entity_name"), F.lit("")), F.lit("unknown")))
    s = signals.withColumn("component", name).withColumn("file", F.nullif(file, F.lit(""))).withColumn("rank", severity_rank(F.col("severity")))
    by_file = s.groupBy("type", "component", "file").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("rank"), F.min(F.struct("seq", "id")).alias("first"))
    by = by_file.groupBy("type", "component").agg(
        F.sum("n").alias("n"), F.count("file").alias("files"), severity_name(F.max("rank")).alias("severity"), F.min("first").alias("first")
    )
    return by.where(F.col("n") >= threshold).select("type", "component", "n", "files", "severity", F.col("first.id").alias("example"))


def framework_sprawl(frameworks: DataFrame, ui: list[str]) -> DataFrame:
    """One row (frameworks, n) if more than one UI framework is in use."""
    return frameworks.where(F.col("name").isin(ui)).agg(F.array_sort(F.collect_set("name")).alias("frameworks")).withColumn("n", F.size("frameworks")).where("n > 1")


def maturity_score(tokenization: Column, colors: Column, spacings: Column, contributors: Column) -> Column:
    """0.4 of the tokenization per cent, and 0.2 each of bands by distinct colors, distinct spacings, and team size."""
    color = F.when(colors <= 8, 100).when(colors <= 16, 75).when(colors <= 32, 50).when(colors <= 64, 25).otherwise(0)
    spacing = F.when(spacings <= 8, 100).when(spacings <= 16, 75).when(spacings <= 32, 50).otherwise(25)
    team = F.when(contributors <= 3, 50).when(tokenization >= 50, 100).otherwise(25)
    return _round(tokenization * 0.4 + color * 0.2 + spacing * 0.2 + team * 0.2).cast("int")


def maturity_level(score: Column) -> Column:
    return F.when(score >= 80, "optimized").when(score >= 60, "managed").when(score >= 40, "defined").when(score >= 20, "emerging").otherwise("none")


def report_score(tokens: Column, drifts: Column) -> Column:
    """Up to 50 for tokens, 5 each, and up to 50 less 2 a drift signal."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.least(F.lit(50), tokens * 5) + 50 - F.least(F.lit(50), drifts * 2))).cast("int")


def baseline(signals: DataFrame) -> DataFrame:
    """(id, type, severity, n): what a baseline keeps of signals; the first type and severity of an id by seq."""
    return signals.groupBy("id").agg(F.min_by(F.struct("type", "severity"), "seq").alias("x"), F.count(F.lit(1)).alias("n")).select("id", "x.type", "x.severity", "n")
