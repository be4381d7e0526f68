"""Every query by name: an operator on its binding, and the SQL that gives the same rows in DuckDB (none for queries that SQL can't express)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromatid import bindings as b
from chromatid.functions import colors, ids, spacing, strings
from chromatid.operators import aggregate, compare, detect, filters, graph, grouping, match, search, styles, tokenize
from chromatid.plans import drift
from chromatid.schemas import DRIFT_TYPES
from chromatid.sources import extract, history
from chromatid.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
            sql_ = sql.replace("RECURSIVE ", "")
            ORACLE_SQL[f.__name__] = (f"WITH {recursive}{', '.join(ctes)}" + (", " if ctes and sql_.startswith("+") else " ") + sql_.lstrip("+")) if ctes else sql_
        return f

    return keep


# Audits.
@query("SELECT category, count(DISTINCT value) AS unique_count, count(*) AS total_usages FROM audit_values GROUP BY category", b.AUDIT_VALUES)
def audit_categories(spark, d):
    return aggregate.audit_categories(b.audit_values(spark, d))


@query(
    "SELECT * FROM (SELECT category, value, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, value)::INT AS rank"
    " FROM (SELECT category, value, count(*) AS n FROM audit_values GROUP BY ALL)) WHERE rank <= 10",
    b.AUDIT_VALUES,
)
def audit_top_values(spark, d):
    return aggregate.audit_top_values(b.audit_values(spark, d))


@query("SELECT file, count(*) AS issue_count FROM audit_values GROUP BY file ORDER BY issue_count DESC, file LIMIT 10", b.AUDIT_VALUES)
def audit_worst_files(spark, d):
    return aggregate.audit_worst_files(b.audit_values(spark, d))


_HEALTH = """+u AS (SELECT count(*) AS unique_values, sum(n)::BIGINT AS total_usages FROM (SELECT category, value, count(*) AS n FROM audit_values GROUP BY ALL)),
f AS (SELECT file, count(*) AS n FROM audit_values GROUP BY file), w AS (SELECT sum(greatest(n - 5, 0)) AS over FROM (SELECT n FROM f ORDER BY n DESC, file LIMIT 10))
SELECT unique_values, total_usages, (SELECT count(*) FROM f) AS files_affected,
  greatest(0, least(100, floor(100 - 3 * unique_values - (SELECT count(*) FROM f) - over * 0.5 + 0.5)))::INT AS score FROM u, w"""


@query(_HEALTH, b.AUDIT_VALUES)
def audit_health(spark, d):
    return aggregate.health(b.audit_values(spark, d))


# Signals: filters and verdicts.
@query("SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM signals", b.SIGNALS)
def drift_summary(spark, d):
    return filters.summary(b.signals(spark, d))


@query("SELECT type, severity, count(*) AS n FROM signals GROUP BY ALL", b.SIGNALS)
def drift_by_type(spark, d):
    return b.signals(spark, d).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT *, CASE WHEN total > 1000000 OR critical > 0 OR warning > 0 THEN 1 ELSE 0 END::INT AS exit_code FROM (SELECT count(*) AS total,"
    " count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning, count(*) FILTER (WHERE severity = 'info') AS info FROM signals)",
    b.SIGNALS,
)
def ci_verdict(spark, d):
    return filters.summary(b.signals(spark, d)).withColumn("exit_code", filters.exit_code("warning", max_drift=1000000).cast("int"))


_OVERRIDES = {"hardcoded-value": "critical", "orphaned-token": "warning"}


@query("SELECT id, type, CASE type WHEN 'hardcoded-value' THEN 'critical' WHEN 'orphaned-token' THEN 'warning' ELSE severity END AS severity FROM signals", b.SIGNALS)
def severity_override(spark, d):
    return filters.override_severity(b.signals(spark, d), _OVERRIDES).select("id", "type", "severity")


@query("SELECT id, severity FROM signals WHERE severity IN ('warning', 'critical')", b.SIGNALS)
def severity_filter(spark, d):
    return filters.min_severity(b.signals(spark, d), "warning").select("id", "severity")


@query("SELECT id, type FROM signals WHERE type = 'value-divergence'", b.SIGNALS)
def type_filter(spark, d):
    return filters.of_type(b.signals(spark, d), "value-divergence").select("id", "type")


@query("SELECT id FROM signals WHERE NOT (type = 'hardcoded-value' AND regexp_matches(entity_name, 'User1\\d$')) AND type <> 'orphaned-token'", b.SIGNALS)
def ignore_rules(spark, d):
    rules = [("hardcoded-value", r"User1\d$"), ("orphaned-token", None), ("value-divergence", "(")]
    return filters.ignore(b.signals(spark, d), rules).select("id")


def _baseline(spark, d):
    return b.signals(spark, d).where("detected_at < timestamp'2024-01-11'").select("id")


@query("SELECT id, type FROM signals WHERE ts >= '2024-01-11'", b.SIGNALS)
def baseline_new(spark, d):
    return filters.new_since(b.signals(spark, d), _baseline(spark, d)).select("id", "type")


@query("SELECT id, type FROM signals WHERE ts < '2024-01-11'", b.SIGNALS)
def baseline_suppressed(spark, d):
    return filters.suppressed_by(b.signals(spark, d), _baseline(spark, d)).select("id", "type")


@query("SELECT id, type, severity, 1::BIGINT AS n FROM signals", b.SIGNALS)
def baseline_create(spark, d):
    return aggregate.baseline(b.signals(spark, d))


@query("SELECT id FROM signals WHERE regexp_replace(location, ':\\d+$', '') IN ('src/1/view.tsx', 'index.tsx')", b.SIGNALS)
def staged_filter(spark, d):
    files = spark.createDataFrame([("repo/src/1/view.tsx",), ("index.tsx",), ("other/view.tsx",)], "path string")
    return filters.staged(b.signals(spark, d), files).select("id")


@query("SELECT id, severity, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END DESC, seq)::INT AS place FROM signals QUALIFY place <= 10", b.SIGNALS)
def top_issues(spark, d):
    top = filters.by_severity(b.signals(spark, d)).limit(10)
    from pyspark.sql import Window

    from chromatid.schemas import severity_rank

    return top.select("id", "severity", F.row_number().over(Window.orderBy(severity_rank(F.col("severity")).desc(), "seq")).alias("place"))


# Grouping.
def _group_sql(min_size: int, source: str = "signals") -> str:
    out, left = [], source
    columns = {
        "value": "CASE WHEN type = 'hardcoded-value' THEN 'value:' || actual END",
        "suggestion": "'suggestion:' || token",
        "path": "CASE WHEN contains(location, '/') THEN 'path:' || regexp_replace(location, '/[^/]*$', '') END",
        "entity": "'entity:' || entity_id",
    }
    for n, (name, key) in enumerate(columns.items()):
        out.append(f"k{n} AS (SELECT *, {key} AS k FROM {left})")
        out.append(f"g{n} AS (SELECT k FROM k{n} WHERE k IS NOT NULL GROUP BY k HAVING count(*) >= {min_size})")
        out.append(f"a{n} AS (SELECT *, '{name}' AS strategy FROM k{n} WHERE k IN (SELECT k FROM g{n}))")
        out.append(f"l{n} AS (SELECT * EXCLUDE (k) FROM k{n} WHERE k IS NULL OR k NOT IN (SELECT k FROM g{n}))")
        left = f"l{n}"
    parts = " UNION ALL ".join(f"SELECT strategy, k AS key, id, seq, severity FROM a{n}" for n in range(4))
    return "+" + ", ".join(out) + f", assigned AS ({parts})"


_GROUPS = (
    " SELECT strategy, key, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning,"
    " count(*) FILTER (WHERE severity = 'info') AS info, arg_min(id, seq) AS first_id FROM assigned GROUP BY strategy, key"
)


@query(_group_sql(60) + _GROUPS, b.SIGNALS)
def drift_groups(spark, d):
    return grouping.groups(grouping.assign(b.signals(spark, d), 60)).drop("group_id")


@query(
    _group_sql(60) + ", one AS (SELECT (SELECT count(*) FROM signals) AS signals, (SELECT count(*) FROM (SELECT DISTINCT strategy, key FROM assigned)) AS groups, (SELECT count(*) FROM l3) AS ungrouped)"
    " SELECT *, signals / (groups + ungrouped) AS ratio FROM one",
    b.SIGNALS,
)
def drift_reduction(spark, d):
    return grouping.reduction(grouping.assign(b.signals(spark, d), 60))


_PIPELINE = drift.Options(overrides=_OVERRIDES, min_severity="warning", ignore=[("accessibility-conflict", r"User\d$")], min_group_size=20)


@query(
    "+counted AS (SELECT * REPLACE (CASE type WHEN 'hardcoded-value' THEN 'critical' WHEN 'orphaned-token' THEN 'warning' ELSE severity END AS severity) FROM signals),"
    " chosen AS (SELECT * FROM counted WHERE severity IN ('warning', 'critical') AND NOT (type = 'accessibility-conflict' AND regexp_matches(entity_name, 'User\\d$')) AND ts >= '2024-01-11'), "
    + _group_sql(20, "chosen").lstrip("+") + _GROUPS,
    b.SIGNALS,
)
def drift_pipeline(spark, d):
    return drift.grouped(b.signals(spark, d), _PIPELINE, _baseline(spark, d)).drop("group_id")


@query(
    "SELECT type, component, n, files, severity, example FROM (SELECT type, entity_name AS component, count(*) AS n, count(DISTINCT string_split(location, ':')[1]) AS files,"
    " arg_max(severity, CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS severity, arg_min(id, seq) AS example FROM signals GROUP BY type, entity_name) WHERE n >= 5",
    b.SIGNALS,
)
def repeat_mistakes(spark, d):
    return aggregate.repeat_mistakes(b.signals(spark, d), 5)


@query("SELECT string_split(location, ':')[1] AS file, count(*) AS n FROM signals GROUP BY ALL HAVING count(*) >= 3", b.SIGNALS)
def repeat_offenders(spark, d):
    return graph.repeat_offenders(b.signals(spark, d))


@query("SELECT type, severity, label FROM (VALUES " + ", ".join(f"('{k}', '{s}', '{n}')" for k, (s, n) in DRIFT_TYPES.items()) + ") t(type, severity, label)")
def drift_types(spark, d):
    return spark.createDataFrame([(k, s, n) for k, (s, n) in DRIFT_TYPES.items()], "type string, severity string, label string")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, type, severity, count(*) AS n FROM signals GROUP BY ALL", b.SIGNALS)
def daily_snapshots(spark, d):
    return incremental.daily_counts(b.signals(spark, d)).withColumn("day", F.col("day").cast("timestamp_ntz"))


# Names, props, classes.
_PATTERN = """CASE WHEN regexp_full_match(name, '[A-Z][a-zA-Z0-9]*') THEN 'PascalCase' WHEN regexp_full_match(name, '[a-z][a-zA-Z0-9]*') THEN 'camelCase'
  WHEN regexp_full_match(name, '[a-z][a-z0-9-]*') THEN 'kebab-case' WHEN regexp_full_match(name, '[a-z][a-z0-9_]*') THEN 'snake_case' ELSE 'other' END"""


@query(
    f"+p AS (SELECT {_PATTERN} AS pattern, count(*) AS n FROM named GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share FROM p)"
    " SELECT pattern, n, share, share > 0.6 AND n = max(n) OVER () AS dominant FROM s",
    b.NAMED_COMPONENTS,
)
def naming_patterns(spark, d):
    return aggregate.naming_patterns(b.named_components(spark, d))


@query(
    f"+p AS (SELECT id, name, {_PATTERN} AS pattern FROM named), s AS (SELECT pattern, count(*) AS n, count(*) / (SELECT count(*) FROM p) AS share FROM p GROUP BY 1),"
    " t AS (SELECT pattern AS dominant_pattern, floor(share * 100 + 0.5)::INT AS percent FROM s WHERE share > 0.6 AND n >= 3)"
    " SELECT id, name, pattern, dominant_pattern, percent FROM p, t WHERE pattern <> dominant_pattern",
    b.NAMED_COMPONENTS,
)
def naming_outliers(spark, d):
    return aggregate.naming_outliers(b.named_components(spark, d))


@query(
    "SELECT lower(prop) AS prop, type, count(*) AS n, min(seq) AS first_seq, array_to_string((list(component ORDER BY seq))[1:3], ',') AS examples FROM props GROUP BY 1, 2",
    b.COMPONENT_PROPS,
)
def prop_type_stats(spark, d):
    return aggregate.prop_type_stats(b.component_props(spark, d)).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query(
    "+c AS (SELECT lower(prop) AS prop, type, count(*) AS n, min(seq) AS f FROM props GROUP BY 1, 2), t AS (SELECT prop, sum(n) AS total, arg_max(type, n * 1000000000 - f) AS dominant_type, max(n) AS m FROM c GROUP BY 1)"
    " SELECT p.component, lower(p.prop) AS prop, p.type, t.dominant_type, p.seq FROM props p JOIN t ON lower(p.prop) = t.prop WHERE total >= 3 AND m / total >= 0.3 AND p.type <> dominant_type",
    b.COMPONENT_PROPS,
)
def prop_type_conflicts(spark, d):
    return aggregate.prop_type_conflicts(b.component_props(spark, d), share=0.3)


_CLASSES = "array_to_string(list_sort(list_filter(regexp_split_to_array(trim(classes), '\\s+'), lambda c: c <> '')), ' ')"


@query(f"SELECT pattern, count(*) AS n, count(DISTINCT file) AS files FROM (SELECT {_CLASSES} AS pattern, file FROM class_strings) WHERE pattern <> '' GROUP BY 1 HAVING count(*) >= 2", b.CLASS_STRINGS)
def class_patterns(spark, d):
    return aggregate.class_patterns(b.class_strings(spark, d))


@query(
    f"SELECT pattern, count(*) AS n, count(DISTINCT file) AS files FROM (SELECT {_CLASSES} AS pattern, file FROM class_strings) WHERE pattern <> ''"
    " GROUP BY 1 HAVING count(DISTINCT file) >= 2 AND len(string_split(pattern, ' ')) >= 3",
    b.CLASS_STRINGS,
)
def class_duplicates(spark, d):
    return aggregate.class_duplicates(b.class_strings(spark, d))


_SIZED = "'p-' || p_size || ' m-' || (p_partkey % 7) || ' text-' || CASE p_partkey % 3 WHEN 0 THEN 'sm' WHEN 1 THEN 'lg' ELSE 'body' END || ' flex'"


@query(
    f"+o AS (SELECT {_SIZED} AS classes, p_brand AS file, CASE WHEN p_partkey % 3 = 2 THEN 'flex text-body {{m}} {{p}}' ELSE 'flex {{m}} {{p}} {{text}}' END AS pattern FROM part)"
    " SELECT pattern, count(*) AS n, count(DISTINCT file) AS files FROM o GROUP BY 1",
    "unused AS (SELECT 1)",
)
def class_patterns_tight(spark, d):
    size = F.when(F.col("p_partkey") % 3 == 0, "sm").when(F.col("p_partkey") % 3 == 1, "lg").otherwise("body")
    text = F.concat(F.lit("p-"), F.col("p_size").cast("string"), F.lit(" m-"), (F.col("p_partkey") % 7).cast("string"), F.lit(" text-"), size, F.lit(" flex"))
    o = b.table(spark, d, "part").select(text.alias("classes"), F.col("p_brand").alias("file"), F.lit(1).alias("line"))
    return aggregate.class_patterns(o, tight=True)


@query(
    "SELECT name, lower(regexp_replace(regexp_replace(name, '(?i)(New|V\\d+|Old)$', ''), '\\d+$', '')) AS base, regexp_matches(name, '(?i)(New|V\\d+|Old)$') AS version FROM named",
    b.NAMED_COMPONENTS,
)
def base_names(spark, d):
    return b.named_components(spark, d).select("name", strings.base_name(F.col("name")).alias("base"), strings.has_version_suffix(F.col("name")).alias("version"))


# Matching.
def _halves(spark, d):
    c = b.components(spark, d)
    return c.where("framework < 'Brand#2'"), c.where("framework >= 'Brand#2'")


_KEY = "regexp_replace(regexp_replace(lower(name), '[-_\\s]', '', 'g'), 'component$', '')"
_EXACT = f"""+s AS (SELECT {_KEY} AS k, arg_min(id, seq) AS source_id FROM components WHERE framework < 'Brand#2' GROUP BY 1),
t AS (SELECT {_KEY} AS k, arg_max(id, seq) AS target_id FROM components WHERE framework >= 'Brand#2' GROUP BY 1), m AS (SELECT source_id, target_id FROM s JOIN t USING (k))"""


@query(_EXACT + " SELECT * FROM m", b.COMPONENTS)
def component_exact_match(spark, d):
    return match.exact_components(*_halves(spark, d))


@query(_EXACT + " SELECT id, name FROM components WHERE framework < 'Brand#2' AND id NOT IN (SELECT source_id FROM m)", b.COMPONENTS)
def component_orphans(spark, d):
    s, t = _halves(spark, d)
    return match.orphans(s, match.exact_components(s, t), "source_id").select("id", "name")


def _shaped(spark, d):
    """Suppliers and customers as components of two sides; their nation is a prop and a variant."""

    def side(table, k):
        nation = F.concat(F.lit("nation"), F.col(f"{k}_nationkey").cast("string"))
        key = F.col(f"{k}_{'supp' if k == 's' else 'cust'}key")
        return b.table(spark, d, table).select(
            key.alias("seq"), F.concat(F.lit(k), key.cast("string")).alias("id"), F.col(f"{k}_name").alias("name"), F.array(nation, F.lit(k)).alias("props"), F.array(nation).alias("variants"),
            F.array().cast("array<string>").alias("dependencies"),
        )

    return side("supplier", "s"), side("customer", "c")


_SHAPED = """pairs AS (SELECT 's' || s_suppkey AS source_id, 'c' || c_custkey AS target_id,
  0.4 * (1 - levenshtein(lower(s_name), lower(c_name)) / greatest(length(s_name), length(c_name)))
  + CASE WHEN s_nationkey = c_nationkey THEN 0.3 / 3 + 0.2 ELSE 0 END AS score FROM supplier, customer)"""


@query("SELECT source_id, target_id, round(score, 6) AS score FROM pairs WHERE score >= 0.55", _SHAPED)
def component_similarity(spark, d):
    return match.component_scores(*_shaped(spark, d), least=0.55).select("source_id", "target_id", F.round("score", 6).alias("score"))


@query()
def component_fuzzy_match(spark, d):
    return match.fuzzy_components(*_shaped(spark, d), least=0.55).withColumn("score", F.round("score", 6))


@query(
    "+s AS (SELECT component, lower(prop) AS k, arg_max(type, seq) AS ty, arg_max(required, seq) AS r, arg_max(prop, seq) AS p FROM props WHERE day < '1998-01-01' GROUP BY 1, 2),"
    " t AS (SELECT component, lower(prop) AS k, arg_max(type, seq) AS ty, arg_max(prop, seq) AS p FROM props WHERE day >= '1998-01-01' GROUP BY 1, 2),"
    " x AS (SELECT component, coalesce(s.p, t.p) AS prop, CASE WHEN t.p IS NULL THEN 'missing in target' WHEN s.p IS NULL THEN 'missing in source' WHEN s.ty <> t.ty THEN 'type' END AS difference,"
    " s.ty AS source_type, t.ty AS target_type, s.r AS r FROM s FULL JOIN t USING (component, k))"
    " SELECT component, prop, difference, source_type, target_type, CASE WHEN difference = 'type' OR (difference = 'missing in target' AND r) THEN 'warning' ELSE 'info' END AS severity FROM x WHERE difference IS NOT NULL",
    b.COMPONENT_PROPS,
)
def prop_differences(spark, d):
    p = b.component_props(spark, d)
    return match.prop_differences(p.where("day < timestamp'1998-01-01'"), p.where("day >= timestamp'1998-01-01'"))


_TKEY = "regexp_replace(lower(name), '[-_\\s.]', '', 'g')"


@query(
    f"+s AS (SELECT id, {_TKEY} AS k, value_key AS v FROM design), c AS (SELECT {_TKEY} AS k, arg_min(id, seq) AS tid, arg_min(value_key, seq) AS v FROM code GROUP BY 1),"
    " m AS (SELECT s.id, c.tid AS target_id, CASE WHEN c.tid IS NULL THEN 'orphaned source' WHEN s.v = c.v THEN 'equal' ELSE 'divergence' END AS result FROM s LEFT JOIN c USING (k))"
    " SELECT * FROM m UNION ALL SELECT NULL, id, 'orphaned target' FROM code WHERE id NOT IN (SELECT target_id FROM m WHERE target_id IS NOT NULL)",
    b.TOKENS,
)
def token_diff(spark, d):
    return match.token_diff(b.design_tokens(spark, d), b.code_tokens(spark, d))


_DOTTED = "translate(lower({}), '-_', '..')"


@query(
    "+m1 AS (SELECT a.id AS design_id, c.id AS code_id, 'exact' AS kind, a.value_key <> c.value_key AS drift FROM (SELECT * FROM design QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq) = 1) a"
    " JOIN (SELECT * FROM code QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq DESC) = 1) c USING (name)),"
    " m2 AS (SELECT a.id AS design_id, c.id AS code_id, 'value' AS kind, false AS drift FROM (SELECT *, row_number() OVER (PARTITION BY value_key ORDER BY seq) AS n FROM design WHERE id NOT IN (SELECT design_id FROM m1)) a"
    " JOIN (SELECT *, row_number() OVER (PARTITION BY value_key ORDER BY seq) AS n FROM code WHERE id NOT IN (SELECT code_id FROM m1)) c USING (value_key, n)),"
    " m12 AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),"
    f" m3 AS (SELECT a.id AS design_id, c.id AS code_id, 'fuzzy' AS kind, a.value_key <> c.value_key AS drift FROM (SELECT *, {_DOTTED.format('name')} AS k, row_number() OVER (PARTITION BY {_DOTTED.format('name')} ORDER BY seq) AS n"
    f" FROM design WHERE id NOT IN (SELECT design_id FROM m12)) a JOIN (SELECT *, {_DOTTED.format('name')} AS k, row_number() OVER (PARTITION BY {_DOTTED.format('name')} ORDER BY seq) AS n FROM code WHERE id NOT IN (SELECT code_id FROM m12)) c USING (k, n))"
    " SELECT * FROM m12 UNION ALL SELECT * FROM m3",
    b.TOKENS,
)
def token_match(spark, d):
    return match.token_match(b.design_tokens(spark, d), b.code_tokens(spark, d))


@query(
    "+h AS (SELECT value, token, seq, list_sum([CASE WHEN value[i] <> hex[i] THEN 1 ELSE 0 END FOR i IN [2, 3, 4, 5, 6, 7]])::DOUBLE AS distance FROM vt WHERE value NOT IN (SELECT hex FROM color_tokens))"
    " SELECT value, arg_min(token, distance * 1000000 + seq) AS token, min(distance) AS distance FROM h WHERE distance BETWEEN 1 AND 5 GROUP BY value",
    b.COLORS,
)
def close_matches(spark, d):
    t = b.color_tokens(spark, d)
    near = match.close_matches(b.color_values(spark, d), t.select(F.col("hex").alias("token"), "seq"), "color")
    names = t.select(F.col("hex").alias("token"), F.col("token").alias("name"))
    return near.join(names, "token").select("value", F.col("name").alias("token"), "distance")


@query(
    "SELECT value, token, round(confidence, 6) AS confidence, rank FROM (SELECT value, token, 1 - d / 441.67 AS confidence, row_number() OVER (PARTITION BY value ORDER BY 1 - d / 441.67 DESC, token)::INT AS rank FROM vt WHERE 1 - d / 441.67 >= 0.8) WHERE rank <= 3",
    b.COLORS,
)
def color_suggestions(spark, d):
    return match.color_suggestions(b.color_values(spark, d), b.color_tokens(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(
    "+x AS (SELECT DISTINCT value, v.px AS v, token, t.px AS t FROM spacing_values v, spacing_tokens t), c AS (SELECT value, token, 1 - abs(v - t) / greatest(v, t, 1) AS confidence FROM x)"
    " SELECT value, token, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY value ORDER BY confidence DESC, token)::INT AS rank FROM c WHERE confidence >= 0.9 QUALIFY rank <= 3",
    b.SPACINGS,
)
def spacing_suggestions(spark, d):
    return match.spacing_suggestions(b.spacing_values(spark, d), b.spacing_tokens(spark)).withColumn("confidence", F.round("confidence", 6))


_SCORE = "CASE WHEN d = 0 THEN 100 WHEN p <= 5 THEN 98 - p WHEN p <= 15 THEN greatest(70, 90 - 2 * p) WHEN p <= 30 THEN greatest(40, 70 - p) ELSE 20 END::DOUBLE"


@query(
    f"+s AS (SELECT value, token, seq, {_SCORE} AS score FROM (SELECT *, d / 441.0 * 100 AS p FROM vt)), r AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY score DESC, seq) AS k FROM s WHERE score >= 40)"
    " SELECT value, token, round(score, 6) AS score, CASE WHEN score >= 100 THEN 'exact' WHEN score >= 95 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS level FROM r WHERE k = 1",
    b.COLORS,
)
def best_fix_token(spark, d):
    return match.best_fix_colors(b.color_values(spark, d), b.color_tokens(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "+x AS (SELECT DISTINCT value, v.px AS v, token, t.px AS t FROM spacing_values v, spacing_tokens t), y AS (SELECT *, abs(v - t) AS a, abs(v - t) / greatest(v, t, 1) * 100 AS p FROM x)"
    " SELECT value, token, round(CASE WHEN a = 0 THEN 100 WHEN a <= 1 THEN 98 WHEN a <= 2 THEN 95 WHEN p <= 10 THEN greatest(70, 90 - p) WHEN p <= 25 THEN greatest(40, 70 - p) ELSE 20 END::DOUBLE, 6) AS score FROM y WHERE a <= 2 OR p <= 25",
    b.SPACINGS,
)
def spacing_confidence(spark, d):
    return match.best_fix_lengths(b.spacing_values(spark, d), b.spacing_tokens(spark)).withColumn("score", F.round("score", 6))


@query("SELECT id, name FROM components WHERE id NOT IN (SELECT 'part:' || l_partkey FROM lineitem WHERE l_quantity >= 45)", b.COMPONENTS)
def unused_components(spark, d):
    uses = b.table(spark, d, "lineitem").where("l_quantity >= 45").groupBy(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return match.unused(b.components(spark, d), uses).select("id", "name")


@query(
    "+n AS (SELECT *, lower(regexp_replace(regexp_replace(name, '(?i)(New|V\\d+|Old)$', ''), '\\d+$', '')) AS base, regexp_matches(name, '(?i)(New|V\\d+|Old)$') AS version FROM named),"
    " s AS (SELECT base, count(*) AS n, bool_or(version) AS hit, arg_min(version, seq) AS fv, arg_min(id, seq) AS fid FROM n GROUP BY 1),"
    " m AS (SELECT n.*, fv, fid FROM n JOIN s USING (base) WHERE s.n > 1 AND hit AND length(base) >= 3)"
    " SELECT fid AS group_id, id AS member_id FROM m WHERE fv UNION ALL SELECT id, id FROM m WHERE NOT fv AND NOT version"
    " UNION ALL SELECT a.id, c.id FROM m a JOIN m c USING (base) WHERE NOT a.fv AND NOT a.version AND c.version",
    b.NAMED_COMPONENTS,
)
def duplicate_groups(spark, d):
    return match.duplicate_groups(b.named_components(spark, d))


_LINEAR = "CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_LUM = f"0.2126 * ({_LINEAR.format('r')}) + 0.7152 * ({_LINEAR.format('g')}) + 0.0722 * ({_LINEAR.format('b')})"


@query(
    f"+l AS (SELECT DISTINCT scope, value, seq % 2 AS k, {_LUM} AS l FROM color_values JOIN vc USING (value))"
    " SELECT a.scope AS component, a.value AS foreground, c.value AS background, round((greatest(a.l, c.l) + 0.05) / (least(a.l, c.l) + 0.05), 6) AS ratio FROM l a JOIN l c USING (scope)"
    " WHERE a.k = 0 AND c.k = 1 AND (greatest(a.l, c.l) + 0.05) / (least(a.l, c.l) + 0.05) < 4.5",
    b.COLORS,
)
def contrast_pairs(spark, d):
    c = b.color_values(spark, d)
    styles = c.select(F.col("scope").alias("component"), F.when(F.col("seq") % 2 == 0, "color").otherwise("background").alias("property"), "value")
    # What round() gives for ratios, without writing each as a decimal.
    return match.contrast_pairs(styles).withColumn("ratio", F.floor(F.col("ratio") * 1e6 + 0.5) / 1e6)


@query("SELECT a.name, a.id AS a_id, c.id AS b_id FROM components a JOIN components c ON a.name = c.name AND a.seq < c.seq", b.COMPONENTS)
def variant_pairs(spark, d):
    return match.variant_pairs(b.components(spark, d))


# Vocabularies.
@query(
    "+p AS (SELECT scope, floor(px + 0.5)::BIGINT AS px, count(*) AS n FROM spacing_values GROUP BY ALL)"
    " SELECT scope, CASE WHEN k > 7 THEN 'breakpoint-orphan-' || (k - 7) ELSE 'breakpoint-' || ['xs', 'sm', 'md', 'lg', 'xl', '2xl', '3xl'][k] END AS name, px || 'px' AS value, n, k > 7 AS orphan"
    " FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY px) AS k FROM p WHERE px > 0)",
    b.SPACINGS,
)
def breakpoint_tokens(spark, d):
    return tokenize.breakpoint_tokens(b.spacing_values(spark, d))


@query(
    "+p AS (SELECT scope, list(p_size) AS v FROM (SELECT p_brand AS scope, p_size FROM part) GROUP BY 1),"
    " h AS (SELECT scope, [len(list_filter(v, lambda x: x % q = 0)) FOR q IN [4, 8, 5, 6, 10]] AS h FROM p),"
    " g AS (SELECT scope, [4, 8, 5, 6, 10][list_position(h, list_max(h))] AS base FROM h)"
    " SELECT scope, base, array_to_string(list_filter([base * i FOR i IN range(1, 17)], lambda x: x <= 128)[1:10], ',') AS scale FROM g",
    "unused AS (SELECT 1)",
)
def spacing_scale(spark, d):
    v = b.table(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_size").alias("px"))
    return tokenize.spacing_scale(v).withColumn("scale", F.array_join(F.transform("scale", lambda x: x.cast("string")), ","))


@query()
def color_vocabulary(spark, d):
    return tokenize.color_tokens(tokenize.color_clusters(b.color_values(spark, d)))


@query()
def spacing_vocabulary(spark, d):
    return tokenize.size_tokens(tokenize.size_clusters(b.spacing_values(spark, d)))


@query()
def radius_vocabulary(spark, d):
    return tokenize.radius_tokens(tokenize.size_clusters(b.spacing_values(spark, d)))


@query()
def suggested_palette(spark, d):
    return tokenize.palette(b.color_values(spark, d))


@query()
def vocabulary_coverage(spark, d):
    v = b.spacing_values(spark, d)
    return tokenize.coverage(tokenize.size_tokens(tokenize.size_clusters(v)), v)


# Graphs.
@query("SELECT dst, count(*) AS n, count(DISTINCT src) AS sources FROM edges WHERE type = 'USES' GROUP BY dst", b.GRAPH)
def token_usages(spark, d):
    return graph.usages(b.graph_edges(spark, d))


@query("SELECT id, name FROM nodes WHERE type = 'Token' AND id NOT IN (SELECT dst FROM edges JOIN supplier ON src = 's' || s_suppkey WHERE type = 'USES' AND s_acctbal > 9000)", b.GRAPH)
def unused_graph_tokens(spark, d):
    rich = b.table(spark, d, "supplier").where("s_acctbal > 9000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"))
    e = b.graph_edges(spark, d).join(rich, "src", "left_semi")
    return graph.without_in(b.graph_nodes(spark, d), e, "Token", "USES").select("id", "name")


@query("SELECT id FROM nodes WHERE type = 'Commit' AND id NOT IN (SELECT src FROM edges WHERE type = 'CHANGED')", b.GRAPH)
def idle_commits(spark, d):
    return graph.without_out(b.graph_nodes(spark, d), b.graph_edges(spark, d), "Commit", "CHANGED").select("id")


@query(
    "SELECT entity, author, commits, last, row_number() OVER (PARTITION BY entity ORDER BY commits DESC, f)::INT AS rank FROM (SELECT e.dst AS entity, n.author, count(*) AS commits, max(n.ts) AS last, min(n.seq) AS f"
    " FROM edges e JOIN nodes n ON e.src = n.id WHERE e.type = 'CHANGED' GROUP BY 1, 2)",
    b.GRAPH,
)
def ownership(spark, d):
    changed = b.table(spark, d, "lineitem").count()
    return graph.ownership(b.graph_nodes(spark, d), b.graph_edges(spark, d), changed).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("SELECT n.id, u.n FROM nodes n JOIN (SELECT dst, count(*) AS n FROM edges WHERE type = 'USES' GROUP BY 1) u ON n.id = u.dst WHERE n.type = 'Token' AND n.name LIKE '\\_%' ESCAPE '\\'", b.GRAPH)
def deprecated_usages(spark, d):
    return graph.deprecated_usages(b.graph_nodes(spark, d), b.graph_edges(spark, d))


@query(
    "SELECT (SELECT count(*) FROM nodes WHERE type = 'Token' AND id IN (SELECT dst FROM edges WHERE type = 'USES')) / (SELECT count(*) FROM nodes WHERE type = 'Token') AS token_coverage,"
    " 0.0::DOUBLE AS test_coverage, 0.0::DOUBLE AS story_coverage, 1.0::DOUBLE AS component_coverage",
    b.GRAPH,
)
def coverage(spark, d):
    return graph.coverage(b.graph_nodes(spark, d), b.graph_edges(spark, d))


@query("SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type", b.GRAPH)
def graph_stats(spark, d):
    return graph.stats(b.graph_nodes(spark, d), b.graph_edges(spark, d))


@query(
    "+c AS (SELECT src AS commit, dst AS file FROM edges WHERE type = 'CHANGED'), i AS (SELECT DISTINCT 'pr' || (o_orderkey // 10) AS pr, 'o' || o_orderkey AS commit FROM orders)"
    " SELECT DISTINCT pr, file FROM i JOIN c USING (commit)",
    b.GRAPH,
)
def pr_files(spark, d):
    o = b.table(spark, d, "orders")
    inc = o.select(F.lit("INCLUDES").alias("type"), F.concat(F.lit("pr"), F.floor(F.col("o_orderkey") / 10).cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    return graph.pr_files(b.graph_edges(spark, d).unionByName(inc))


@query(
    "+a AS (SELECT event_id AS drift, 's' || (event_id % 50) AS entity FROM events), h AS (SELECT a.drift, d.src AS developer, substr(c.src, 2)::BIGINT AS c_seq FROM a JOIN edges c ON c.type = 'CHANGED' AND c.dst = a.entity"
    " JOIN edges d ON d.type = 'AUTHORED' AND d.dst = c.src) SELECT drift, arg_min(developer, c_seq) AS developer FROM h GROUP BY drift",
    b.GRAPH,
)
def drift_author(spark, d):
    e = b.graph_edges(spark, d).withColumn("seq", F.when(F.col("type") == "CHANGED", F.substring("src", 2, 20).cast("long")).otherwise(F.lit(0).cast("long")))
    a = b.table(spark, d, "events").select(F.lit("AFFECTS").alias("type"), F.col("event_id").cast("string").alias("src"), F.concat(F.lit("s"), (F.col("event_id") % 50).cast("string")).alias("dst"), F.col("event_id").alias("seq"))
    return graph.drift_authors(e.unionByName(a)).withColumn("drift", F.col("drift").cast("long"))


_IMPACT = """+reach(start, id, distance) AS (SELECT s, s, 0 FROM (SELECT p_partkey AS s FROM part WHERE p_partkey % 50 = 0) UNION ALL
  SELECT r.start, i.src, r.distance + 1 FROM reach r JOIN imports i ON i.dst = r.id WHERE r.distance <= 3), best AS (SELECT start, id, min(distance)::INT AS distance FROM reach GROUP BY 1, 2)"""


def _starts(spark, d):
    """Every part whose key is divisible by 50."""
    return b.table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id"))


@query("RECURSIVE " + _IMPACT + " SELECT * FROM best WHERE distance > 0", b.IMPORT_EDGES)
def impact_analysis(spark, d):
    return graph.impact(b.import_edges(spark, d), _starts(spark, d))


@query(
    "RECURSIVE " + _IMPACT + " SELECT start, count(*) FILTER (WHERE distance = 1) AS direct, count(*) FILTER (WHERE distance > 1) AS transitive, count(*) FILTER (WHERE id % 2 = 0) AS files,"
    " count(*) FILTER (WHERE id % 2 = 1) AS components, CASE WHEN count(*) > 20 THEN 'high' WHEN count(*) > 5 THEN 'medium' ELSE 'low' END AS risk FROM best WHERE distance > 0 GROUP BY start",
    b.IMPORT_EDGES,
)
def impact_summary(spark, d):
    n = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "File").otherwise("Component").alias("type"))
    return graph.impact_summary(graph.impact(b.import_edges(spark, d), _starts(spark, d)), n)


_REACH = "r(src, dst) AS (SELECT src, dst FROM looped UNION SELECT r.src, e.dst FROM r JOIN looped e ON e.src = r.dst WHERE e.dst // 24 = r.src // 24)"
#: Imports lead to smaller ids, so a cycle stays within a ring of looped_edges(), and a ring within 24 ids.
_RINGS = _REACH + ", scc AS (SELECT a.src AS id, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"


@query("RECURSIVE +" + _RINGS + " SELECT id, component FROM scc", b.LOOPED_EDGES)
def dependency_cycle_nodes(spark, d):
    return graph.cycle_nodes(b.looped_edges(spark, d))


@query(
    "RECURSIVE +" + _RINGS + ", p(c, path, tail) AS (SELECT component, [component], component FROM scc WHERE id = component UNION ALL SELECT c, list_append(path, e.dst), e.dst"
    " FROM p JOIN looped e ON e.src = p.tail JOIN scc ON scc.id = e.dst AND scc.component = c WHERE NOT list_contains(path, e.dst)),"
    " q AS (SELECT c, path, row_number() OVER (PARTITION BY c ORDER BY len(path), list_reverse(path)) AS n FROM p JOIN looped e ON e.src = p.tail AND e.dst = p.c)"
    " SELECT array_to_string(path, '>') AS cycle, len(path)::INT AS length FROM q WHERE n = 1",
    b.LOOPED_EDGES,
)
def dependency_cycles(spark, d):
    return graph.component_cycles(b.looped_edges(spark, d))


@query("SELECT src, dst FROM imports", b.IMPORT_EDGES)
def dependency_graph(spark, d):
    return b.import_edges(spark, d).select("src", "dst").distinct()


# History and snapshots.
@query("SELECT lower(email) AS email, arg_min(author, (ts, sha)) AS name, count(*) AS commits, min(ts) AS first_at, max(ts) AS last_at, substr(sha256(lower(email)), 1, 16) AS developer_id FROM commits GROUP BY 1", b.COMMITS)
def developers(spark, d):
    return history.developers(b.commits(spark, d)).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


@query("SELECT DISTINCT lower(email) AS email FROM commits WHERE ts >= (SELECT max(ts) FROM commits) - INTERVAL 90 DAY", b.COMMITS)
def active_contributors(spark, d):
    c = b.commits(spark, d)
    now = F.lit(c.agg(F.max("timestamp")).first()[0])
    return history.active_since(history.developers(c), c, now).select("email")


_SNAPS = """snap AS (SELECT user_id || ':' || floor(value)::BIGINT AS id, ts < '2024-01-16' AS early, count(*) AS n FROM events GROUP BY ALL)"""


@query(
    "SELECT coalesce(x.id, y.id) AS id, CASE WHEN x.id IS NULL THEN 'added' WHEN y.id IS NULL THEN 'removed' ELSE 'modified' END AS change"
    " FROM (SELECT * FROM snap WHERE early) x FULL JOIN (SELECT * FROM snap WHERE NOT early) y ON x.id = y.id WHERE x.id IS NULL OR y.id IS NULL OR x.n <> y.n",
    _SNAPS,
)
def scan_diff(spark, d):
    e = b.table(spark, d, "events")
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.floor("value").cast("long").cast("string")).alias("id")
    s = e.groupBy(key, (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("early")).agg(F.count(F.lit(1)).alias("n"))
    return compare.diff(s.where("early"), s.where("not early"), ["n"])


@query("SELECT page_id, (unnest(regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1))) AS href FROM pages")
def page_links(spark, d):
    return extract.links(b.table(spark, d, "pages")).select("page_id", "href")


@query(
    "+f AS (SELECT c_custkey AS id, 'import {A, B as C} from ''@org/pkg' || (c_custkey % 7) || '/x'';' || chr(10) || 'import D from ''./mod' || (c_custkey % 5) || ''';' || chr(10) || 'import ''side' || (c_custkey % 3) || ''';' AS content FROM customer)"
    " SELECT '@org/pkg' || (id % 7) AS package, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT 'side' || (id % 3), count(*) FROM f GROUP BY 1",
    "unused AS (SELECT 1)",
)
def package_names(spark, d):
    return extract.packages(extract.imports(_sources(spark, d)))


def _sources(spark, d):
    k = F.col("c_custkey")
    text = F.concat(
        F.lit("import {A, B as C} from '@org/pkg"), (k % 7).cast("string"), F.lit("/x';\nimport D from './mod"), (k % 5).cast("string"), F.lit("';\nimport 'side"), (k % 3).cast("string"), F.lit("';"),
    )
    return b.table(spark, d, "customer").select(F.concat(F.lit("src/f"), k.cast("string"), F.lit(".ts")).alias("path"), text.alias("content"))


@query(
    "SELECT 'src/f' || c_custkey || '.ts' AS path, kind, module, external, names FROM customer, LATERAL (VALUES ('named', '@org/pkg' || (c_custkey % 7) || '/x', true, 'A,B'),"
    " ('default', './mod' || (c_custkey % 5), false, 'D'), ('side-effect', 'side' || (c_custkey % 3), true, '')) t(kind, module, external, names)"
)
def import_edges(spark, d):
    return extract.imports(_sources(spark, d)).withColumn("names", F.array_join("names", ","))


# Scalars.
@query(
    "SELECT value, saturation, lightness FROM (SELECT DISTINCT value, round(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END, 6) AS saturation, round((r + g + b) / 3.0 / 255, 6) AS lightness FROM vc)",
    b.COLORS,
)
def color_measures(spark, d):
    v = b.color_values(spark, d).select("value").distinct()
    return v.select("value", F.round(colors.saturation(F.col("value")), 6).alias("saturation"), F.round(colors.lightness(F.col("value")), 6).alias("lightness"))


@query(
    "RECURSIVE +t AS (SELECT DISTINCT p_name AS name FROM part), h(name, i, h) AS (SELECT name, 0, 0::BIGINT FROM t UNION ALL SELECT name, i + 1,"
    " ((h * 31 + ascii(name[i + 1]) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 FROM h WHERE i < length(name))"
    " SELECT name, h AS hash, lower(to_hex(abs(h))) AS hex FROM h WHERE i = length(name)",
    "unused AS (SELECT 1)",
)
def rolling_hashes(spark, d):
    n = b.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return n.select("name", ids.rolling_hash(F.col("name")).alias("hash"), ids.hash_hex(F.col("name")).alias("hex"))


@query("SELECT DISTINCT a.p_name AS a, c.p_name AS b, round(1 - levenshtein(a.p_name, c.p_name) / greatest(length(a.p_name), length(c.p_name)), 6) AS similarity FROM part a JOIN part c ON a.p_brand = c.p_brand AND a.p_size = c.p_size WHERE a.p_name < c.p_name")
def name_similarity(spark, d):
    p = b.table(spark, d, "part")
    # Names that share a brand and a size: each name once there, and each pair once before it is compared.
    a, c = (p.select(F.col("p_name").alias(n), "p_brand", "p_size").distinct() for n in "ab")
    pairs = a.join(c, ["p_brand", "p_size"]).where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", F.round(strings.similarity(F.col("a"), F.col("b")), 6).alias("similarity")).distinct()


# Detectors.
@query(
    f"+p AS (SELECT id, name, {_PATTERN} AS pattern FROM named), s AS (SELECT pattern, count(*) AS n, count(*) / (SELECT count(*) FROM p) AS share FROM p GROUP BY 1), t AS (SELECT pattern AS dp FROM s WHERE share > 0.6 AND n >= 3)"
    " SELECT 'drift:naming-inconsistency:' || id AS id, 'naming-inconsistency' AS type, 'info' AS severity, id AS entity_id, name AS entity_name, dp AS detail FROM p, t WHERE pattern <> dp",
    b.NAMED_COMPONENTS,
)
def detect_naming(spark, d):
    return detect.naming(b.named_components(spark, d)).drop("location", "message")


@query("SELECT 'drift:unused-component:' || id AS id, 'unused-component' AS type, 'warning' AS severity, name AS entity_name FROM components WHERE id NOT IN (SELECT 'part:' || l_partkey FROM lineitem WHERE l_quantity >= 45)", b.COMPONENTS)
def detect_unused(spark, d):
    uses = b.table(spark, d, "lineitem").where("l_quantity >= 45").groupBy(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return detect.unused(b.components(spark, d), uses).select("id", "type", "severity", "entity_name")


@query(
    "+v AS (SELECT p_brand AS component, CASE WHEN p_partkey % 2 = 0 THEN 'color' ELSE 'size' END AS g, p_size::VARCHAR AS value FROM part)"
    " SELECT 'drift:hardcoded-value:' || component || ':' || g AS id, CASE g WHEN 'color' THEN 'warning' ELSE 'info' END AS severity, array_to_string(list_sort(list(DISTINCT value)), ', ') AS detail FROM v GROUP BY component, g",
    "unused AS (SELECT 1)",
)
def detect_hardcoded(spark, d):
    v = b.table(spark, d, "part").select(F.col("p_brand").alias("component"), F.when(F.col("p_partkey") % 2 == 0, "color").otherwise("spacing").alias("kind"), F.col("p_size").cast("string").alias("value"))
    return detect.hardcoded(v).select("id", "severity", "detail")


# Searches, examples and styles.
@query(
    "SELECT DISTINCT name, round(CASE WHEN lower(name) = 'small ring' THEN 100 WHEN contains(lower(name), 'small ring') OR contains('small ring', lower(name)) THEN 70 + 50 * least(length(name), 10) / greatest(length(name), 10)"
    " WHEN contains(lower(name), 'small') AND contains(lower(name), 'ring') THEN 80 WHEN contains(lower(name), 'small') OR contains(lower(name), 'ring') THEN 65 ELSE 0 END, 6) AS score"
    " FROM components WHERE contains(lower(name), 'small') OR contains(lower(name), 'ring')",
    b.COMPONENTS,
)
def search_components(spark, d):
    return search.by_name(b.components(spark, d), "small ring").select("name", F.round("score", 6).alias("score")).distinct()


@query("SELECT token AS id, floor((1 - sqrt(((5 - r) * (5 - r) + (16 - g) * (16 - g) + (16 - b) * (16 - b))::DOUBLE) / 441.67) * 100 + 0.5)::DOUBLE AS score FROM tc WHERE floor((1 - sqrt(((5 - r) * (5 - r) + (16 - g) * (16 - g) + (16 - b) * (16 - b))::DOUBLE) / 441.67) * 100 + 0.5) >= 80", b.COLORS)
def search_tokens_by_color(spark, d):
    return search.tokens_by_color(b.color_tokens(spark, d).withColumnRenamed("token", "id"), "051010").select("id", "score")


_CONTEXT = "CASE WHEN p_type < 'M' THEN 'production' WHEN p_type < 'S' THEN 'example' ELSE 'test' END"


def _in_context(spark, d):
    context = F.when(F.col("p_type") < "M", "production").when(F.col("p_type") < "S", "example").otherwise("test")
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), context.alias("context"))


@query(f"SELECT p.p_partkey AS production_id, e.p_partkey AS example_id FROM part p JOIN part e ON lower(p.p_name) = lower(e.p_name) AND {_CONTEXT.replace('p_type', 'p.p_type')} = 'production' AND {_CONTEXT.replace('p_type', 'e.p_type')} = 'example'")
def related_examples(spark, d):
    return search.related_examples(_in_context(spark, d))


@query(
    f"+c AS (SELECT lower(p_name) AS name, {_CONTEXT} AS context FROM part), g AS (SELECT name, bool_or(context = 'production') AS p, bool_or(context = 'example') AS e FROM c GROUP BY 1)"
    " SELECT count(*) FILTER (WHERE p AND e) AS with_example, count(*) FILTER (WHERE p AND NOT e) AS without_example, count(*) FILTER (WHERE e AND NOT p) AS example_only,"
    " floor(count(*) FILTER (WHERE p AND e) * 100 / count(*) FILTER (WHERE p) + 0.5)::INT AS percent FROM g",
    "unused AS (SELECT 1)",
)
def example_coverage(spark, d):
    return detect.example_coverage(_in_context(spark, d))


@query(
    "SELECT severity, NULL AS type, NULL AS file, count(*) AS n FROM signals GROUP BY severity UNION ALL SELECT NULL, type, NULL, count(*) FROM signals GROUP BY type"
    " UNION ALL SELECT NULL, NULL, string_split(location, ':')[1] AS f, count(*) FROM signals GROUP BY f",
    b.SIGNALS,
)
def upload_counts(spark, d):
    return search.upload_counts(b.signals(spark, d))


@query(
    "+v AS (SELECT p_name AS component, p_brand AS file, 'size' AS type, (p_size % 3)::VARCHAR AS key, p_type AS classes FROM part),"
    " s AS (SELECT component FROM v GROUP BY 1 HAVING count(DISTINCT file) >= 2)"
    " SELECT component, type, key, array_to_string(list_sort(list(DISTINCT classes)), '|') AS values, count(DISTINCT file)::INT AS files FROM v WHERE component IN (SELECT component FROM s) GROUP BY 1, 2, 3 HAVING count(DISTINCT classes) > 1",
    "unused AS (SELECT 1)",
)
def variant_inconsistencies(spark, d):
    v = b.table(spark, d, "part").select(F.col("p_name").alias("component"), F.col("p_brand").alias("file"), F.lit("size").alias("type"), (F.col("p_size") % 3).cast("string").alias("key"), F.col("p_type").alias("classes"))
    return styles.variant_inconsistencies(v).withColumn("values", F.array_join("values", "|"))


@query(
    "+s AS (SELECT i * 16 AS px FROM range(1, 30) t(i)), v AS (SELECT DISTINCT value, px FROM spacing_values) SELECT s.px AS px, count(*) AS n FROM s JOIN v ON abs(v.px - s.px) <= 2 GROUP BY s.px",
    b.SPACINGS,
)
def replaced_lengths(spark, d):
    return styles.replaced_lengths(b.spacing_values(spark, d), spark.range(1, 30).select((F.col("id") * 16).alias("px")))


@query("SELECT p.hex AS color, count(DISTINCT v.value) AS n FROM tc p, vc v WHERE sqrt(((v.r - p.r) * (v.r - p.r) + (v.g - p.g) * (v.g - p.g) + (v.b - p.b) * (v.b - p.b))::DOUBLE) < 30 GROUP BY 1", b.COLORS)
def replaced_colors(spark, d):
    p = b.color_tokens(spark, d).select(F.col("hex").alias("color"))
    return styles.replaced_colors(b.color_values(spark, d), p)
