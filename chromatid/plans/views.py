"""What reports and context files show, as rows: (section, rank, name, value), a few rows a section however large the tables are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatid.schemas import severity_rank

# Rows that a view shows of each section; health in per cent from which a component is healthy, and under which it needs attention or is critical.
SHOWN = {"type": 5, "team": 5, "healthy": 4, "attention": 4, "critical": 2, "component": 3, "action": 3}
HEALTHY, ATTENTION, CRITICAL = 90, 70, 50


def _top(rows: DataFrame, section: str | Column, order: list[Column]) -> DataFrame:
    """The first rows (name, value) of each section by order."""
    named = rows.withColumn("section", F.lit(section) if isinstance(section, str) else section)
    most = F.element_at(F.create_map(*[F.lit(x) for pair in SHOWN.items() for x in pair]), F.col("section"))
    place = F.row_number().over(Window.partitionBy("section").orderBy(*order))
    ranked = named.withColumn("rank", place).where(F.col("rank") <= max(SHOWN.values())).where(F.col("rank") <= most)
    return ranked.select("section", "rank", "name", F.col("value").cast("string").alias("value"))


def _listed(row: DataFrame, section: str, values: dict[str, Column]) -> DataFrame:
    """One row's values, named and in order."""
    each = [F.struct(F.lit(k + 1).alias("rank"), F.lit(n).alias("name"), v.alias("value")) for k, (n, v) in enumerate(values.items())]
    return row.select(F.explode(F.array(*each)).alias("c")).select(F.lit(section).alias("section"), "c.rank", "c.name", "c.value")


def health(signals: DataFrame, uses: DataFrame) -> DataFrame:
    """(name, health, category): the share of a component's uses (name, uses) that no signal (entity_name) speaks against, in whole per cent."""
    drift = signals.groupBy(F.col("entity_name").alias("name")).agg(F.count(F.lit(1)).alias("drift"))
    share = F.floor(100 * F.greatest(F.lit(0), F.col("uses") - F.coalesce("drift", F.lit(0))) / F.col("uses") + 0.5).cast("int")
    rows = uses.where("uses > 0").join(drift, "name", "left").select("name", share.alias("health"))
    kind = F.when(F.col("health") >= HEALTHY, "healthy").when(F.col("health") < CRITICAL, "critical").when(F.col("health") < ATTENTION, "attention").otherwise("fair")
    return rows.withColumn("category", kind)


def team_dashboard(signals: DataFrame, owners: DataFrame, uses: DataFrame) -> DataFrame:
    """Rows of a team's dashboard: the commonest types of signals and teams (owners: entity_name, team) with most of them, and the best and worst components of each category."""
    by = [F.desc("value"), F.col("name")]
    types = _top(signals.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("value")), "type", by)
    teams = signals.join(owners.dropDuplicates(["entity_name"]), "entity_name").groupBy(F.col("team").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    rated = health(signals, uses).where(F.col("category") != "fair").withColumn("value", F.col("health"))
    order = [F.when(F.col("category") == "healthy", -F.col("health")).otherwise(F.col("health")), F.col("name")]
    return types.union(_top(teams, "team", by)).union(_top(rated, F.col("category"), order))


def developer_brief(signals: DataFrame, changed: DataFrame, author: str) -> DataFrame:
    """Rows of a developer's brief: how many files and components they changed (path, component, author), the first components with clean or drift, the first signals
    (severity, entity_name, message, seq) against those, most severe first, and signals a changed component, theirs and everybody's."""
    mine = changed.where(F.col("author") == author)
    counts = mine.agg(F.countDistinct("path").alias("files"), F.countDistinct("component").alias("components"))
    changes = _listed(counts, "changes", {n: F.col(n).cast("string") for n in ("files", "components")})
    names = mine.select(F.col("component").alias("name")).distinct()
    against = signals.groupBy(F.col("entity_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rows = names.join(against, "name", "left").withColumn("value", F.when(F.col("n").isNull(), "clean").otherwise("drift"))
    parts = _top(rows, "component", [F.col("name")])
    own = signals.join(names.withColumnRenamed("name", "entity_name"), "entity_name", "left_semi").select(F.col("entity_name").alias("name"), F.col("message").alias("value"), "severity", "seq")
    actions = _top(own, "action", [severity_rank(F.col("severity")).desc(), F.col("seq"), F.col("value")])
    each = changed.select("author", F.col("component").alias("name")).distinct().join(against, "name", "left").groupBy("author").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.count(F.lit(1)).alias("of"))
    rates = each.agg(
        F.round(F.sum(F.when(F.col("author") == author, F.col("n"))) / F.sum(F.when(F.col("author") == author, F.col("of"))), 4).alias("own"), F.round(F.sum("n") / F.sum("of"), 4).alias("team")
    )
    return changes.union(parts).union(actions).union(_listed(rates, "rate", {n: F.format_string("%.4f", n) for n in ("own", "team")}))


def context_lines(components: DataFrame, tokens: DataFrame, signals: DataFrame, shown: int = 20) -> DataFrame:
    """(section, rank, line) of a context file for those who write code against the system: components (framework, name) by framework, tokens (category, name, value) by
    category, and what signals (type) warn of, the commonest first; ``shown`` names a line at most."""

    def listed(rows: DataFrame, section: str, key: str, text: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy("name"))
        few = rows.withColumn("_k", place).where(F.col("_k") <= shown).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", text.alias("text")))).alias("all"))
        counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
        line = F.concat(F.lit("- **"), F.col(key), F.lit("**: "), F.array_join(F.transform("all", lambda x: x["text"]), ", "), F.when(F.col("n") > shown, F.format_string(" and %d more", F.col("n") - shown)).otherwise(""))
        few = few.join(counts, F.col(key) == F.col("_key"))
        return few.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(key)).alias("rank"), line.alias("line"))

    named = listed(components.select("framework", "name").distinct(), "components", "framework", F.concat(F.lit("`"), F.col("name"), F.lit("`")))
    valued = listed(tokens.select("category", "name", "value").dropDuplicates(["category", "name"]), "tokens", "category", F.concat(F.lit("`"), F.col("name"), F.lit("` ("), F.col("value"), F.lit(")")))
    warned = signals.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    warned = warned.select(F.lit("avoid").alias("section"), F.row_number().over(Window.orderBy(F.desc("n"), "type")).alias("rank"), F.format_string("- %s (%d found)", "type", "n").alias("line"))
    return named.union(valued).union(warned)


def off_convention(names: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Names (kind, name) that don't fit the regular expression which options give for their kind; kinds without one fit."""
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in patterns.items() for x in pair]), F.col("kind")) if patterns else F.lit(None).cast("string")
    return names.withColumn("expected", wanted).where("expected is not null AND NOT name RLIKE expected")


def repository(refs: DataFrame) -> DataFrame:
    """(root, branch, remote) of repositories' own files (root, path, content): the branch that HEAD is on (HEAD where it is on none) and the URL that origin is fetched from."""
    head = F.regexp_replace(F.when(F.col("path") == "HEAD", F.col("content")), r"^\s+|\s+$", "")
    branch = F.when(head.startswith("ref: refs/heads/"), F.substring(head, 17, 1 << 20)).when(head != "", "HEAD")
    section = F.regexp_extract("content", r'(?m)^\[remote "origin"\][^\[]*?^\s*url\s*=\s*(\S+)', 1)
    remote = F.when(F.col("path") == "config", F.nullif(section, F.lit("")))
    return refs.groupBy("root").agg(F.max(branch).alias("branch"), F.max(remote).alias("remote"))
