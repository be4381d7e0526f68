"""Queries of operators over files, documents and plain functions: their inputs are made from ``part``'s and ``orders``' keys by expressions that Spark and DuckDB share."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromatid import bindings as b
from chromatid.functions import colors, strings
from chromatid.operators import aggregate, compare, detect, filters, fixes, graph, search, styles, tokenize
from chromatid.queries import query
from chromatid.sinks import reports
from chromatid.sources import components, extract, files, history, markup, tokens_json


class View:
    """A table of expressions over one of the test tables, for both engines."""

    def __init__(self, view: str, table: str, where: str = "true", /, **columns: str):
        self.table, self.columns, self.where = table, columns, where
        self.sql = f"{view} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table} WHERE {where})"

    def __call__(self, spark: SparkSession, d: str) -> DataFrame:
        return b.table(spark, d, self.table).where(self.where).selectExpr(*[f"{e} AS {c}" for c, e in self.columns.items()])


K = "p_partkey"
NL = "chr(10)"


def hex6(e: str) -> str:
    return f"lpad(lower(hex({e})), 6, '0')"


def pick(e: str, *texts: str) -> str:
    return f"CASE {e} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts[:-1])) + f" ELSE {texts[-1]} END"


# Files: discovery, statistics, caches, scans.
CODE = View(
    "code", "part", k=K, path=f"'src/d' || ({K} % 5) || '/Comp' || {K} || {pick(K, repr('.test.tsx'), repr('.vue'), repr('.tsx'))}",
    content=f"""'import {{ Button }} from "@ui/kit";' || {NL} || 'export function Comp' || {K} || '() {{' || {NL} || '  const [a] = useState(' || {K} || '); useEffect(load); useState(1);'
  || {NL} || '  return <Button size="lg" tone={{c}} key="k"><Card.Body title="t" /><Icon' || ({K} % 4) || ' /><Button size="sm" /></Button>;' || {NL} || '}}'""",
)
GLOBS = ["src/d1/*.tsx", "src/**/*.vue", "lib/**"]
_STATS = (
    "SELECT 'src/d1/*.tsx' AS pattern, count(*) FILTER (WHERE path LIKE 'src/d1/%.tsx') AS n FROM code UNION ALL"
    " SELECT 'src/**/*.vue', count(*) FILTER (WHERE path LIKE '%.vue') FROM code UNION ALL SELECT 'lib/**', 0 FROM range(1)"
)


@query("SELECT path FROM code WHERE path LIKE '%.tsx' AND path NOT LIKE '%.test.tsx'", CODE.sql)
def discovered_files(spark, d):
    return files.discover(CODE(spark, d).select("path"), ["src/**/*.tsx"], files.excludes())


@query(_STATS, CODE.sql)
def file_pattern_stats(spark, d):
    return files.pattern_stats(CODE(spark, d), GLOBS)


@query("SELECT 'PATTERN_NO_MATCH' AS code, 'lib/**' AS detail FROM range(1) UNION ALL SELECT 'LARGE_FILE_COUNT', count(*)::VARCHAR FROM code HAVING count(*) > 1000", CODE.sql)
def scan_warnings(spark, d):
    return files.scan_warnings(CODE(spark, d), GLOBS)


WANTED = View("wanted", "part", path=f"'src/d' || ({K} % 7) || '/Comp' || {K} || '.tsx'")


@query("SELECT path FROM wanted WHERE path NOT IN (SELECT path FROM code)", CODE.sql, WANTED.sql)
def missing_files(spark, d):
    return files.missing_paths(WANTED(spark, d), CODE(spark, d))


@query("SELECT path FROM code WHERE k % 2 = 0 OR k % 3 = 0", CODE.sql)
def changed_files(spark, d):
    c = CODE(spark, d)
    return files.changed_files(c.where("k % 2 = 0"), c.where("k % 3 = 0"), c.where("k % 6 = 0"))


@query("SELECT path, k % 3 <> 0 AND k % 7 <= k % 10 AND k % 5 <> 0 AS hit, CASE WHEN k % 3 <> 0 AND k % 7 <= k % 10 AND k % 5 <> 0 THEN 'r' || k END AS result FROM code", CODE.sql)
def cached_scan(spark, d):
    c = CODE(spark, d)
    cache = c.where("k % 3 <> 0").selectExpr("path", "CAST(k % 10 AS DOUBLE) AS cached_mtime", "'r' || k AS result")
    return files.cache_split(c.selectExpr("path", "CAST(k % 7 AS DOUBLE) AS mtime"), cache, c.where("k % 5 = 0")).select("path", "hit", "result")


@query("SELECT path, CASE WHEN k % 2 = 0 THEN 'new' ELSE 'old' END AS result FROM code WHERE k % 2 = 0 OR k % 3 <> 0", CODE.sql)
def merged_cache(spark, d):
    c = CODE(spark, d)
    return files.merge_cache(c.where("k % 3 <> 0").selectExpr("path", "'old' AS result"), c.where("k % 2 = 0").selectExpr("path", "'new' AS result"))


@query("SELECT k, CASE WHEN k <= 10 THEN least(k, 5) WHEN k <= 100 THEN 10 WHEN k <= 500 THEN 20 ELSE least(ceil(k / 20), 50) END::INT AS tasks FROM code", CODE.sql)
def scan_concurrency(spark, d):
    return CODE(spark, d).select("k", files.concurrency(F.col("k")).alias("tasks"))


def _parse(path: str, content: str) -> Iterator[tuple]:
    if "Icon3" in content:
        raise ValueError("no Icon3")
    for name in re.findall(r"function (\w+)", content):
        yield name, len(path)


@query("SELECT path, 'Comp' || k AS name, length(path)::INT AS size FROM code WHERE k % 4 <> 3", CODE.sql)
def scan_items(spark, d):
    return files.scan(CODE(spark, d), _parse, "name string, size int")[0]


@query("SELECT path, 'PARSE_ERROR' AS code, 'ValueError: no Icon3' AS message FROM code WHERE k % 4 = 3", CODE.sql)
def scan_errors(spark, d):
    return files.scan(CODE(spark, d), _parse, "name string, size int")[1]


# Components in source text.
@query("SELECT path, 'Comp' || k AS name, 0 AS pos FROM code", CODE.sql)
def declared_react(spark, d):
    return components.declared(CODE(spark, d), "react")


@query("SELECT path, 'Comp' || k AS name, 0 AS pos FROM code WHERE path LIKE '%.vue'", CODE.sql)
def declared_vue(spark, d):
    return components.declared(CODE(spark, d), "vue")


OTHERS = View(
    "others", "part", path=f"'f' || {K}",
    content=pick(K, f"'<script>export let size' || {K} || ' = 1;</script>'", f"'@Component({{ selector: 1 }})' || {NL} || 'export class Part' || {K} || ' {{}}'", f"'@customElement(\"part-' || {K} || '\") class X {{}}'").replace("{{", "{").replace("}}", "}"),
)


@query("SELECT path, 'Part' || substr(path, 2) AS name FROM others WHERE substr(path, 2)::INT % 3 = 1", OTHERS.sql)
def declared_angular(spark, d):
    return components.declared(OTHERS(spark, d), "angular").select("path", "name")


@query("SELECT path, 'part-' || substr(path, 2) AS name FROM others WHERE substr(path, 2)::INT % 3 = 2", OTHERS.sql)
def declared_elements(spark, d):
    return components.declared(OTHERS(spark, d), "lit").select("path", "name")


@query("SELECT path, unnest(['Button', 'Card.Body', 'Icon' || (k % 4)]) AS name, unnest([2, 1, 1])::BIGINT AS n FROM code", CODE.sql)
def component_dependencies(spark, d):
    return components.dependencies(CODE(spark, d))


@query("SELECT path, unnest(['Button', 'Button', 'Card.Body']) AS component, unnest(['size', 'tone', 'title']) AS prop FROM code", CODE.sql)
def jsx_props(spark, d):
    return components.jsx_props(CODE(spark, d))


@query("SELECT 'useState' AS hook, 2 * count(*) AS n, count(*) AS files FROM code UNION ALL SELECT 'useEffect', count(*), count(*) FROM code", CODE.sql)
def hook_stats(spark, d):
    return components.hooks(CODE(spark, d))


MEMBERS = View("members", "part", path=f"'f' || CAST(floor({K} / 3) AS BIGINT)", name=pick(K, "'Menu'", "'MenuItem'", "'MenuTrigger'"))


@query("SELECT path, 'Menu' AS root, name AS member FROM members WHERE name <> 'Menu' AND path IN (SELECT path FROM members GROUP BY path HAVING count(*) = 3)", MEMBERS.sql)
def compound_groups(spark, d):
    return components.compounds(MEMBERS(spark, d)).select("path", "root", "member")


ENTRIES = View("entries", "part", id=f"'b' || ({K} % 20) || '--s' || {K}", title=f"'Forms/B' || ({K} % 20)", name=f"'S' || {K}", type=pick(K, "'docs'", "'story'", "'story'"), seq=K)


@query("SELECT lower(replace(title, '/', '-')) AS key, arg_min(id, seq) AS id, string_agg(name, ',' ORDER BY seq) AS stories FROM entries WHERE type <> 'docs' GROUP BY 1", ENTRIES.sql)
def story_index(spark, d):
    return components.story_index(ENTRIES(spark, d)).withColumn("stories", F.array_join("stories", ","))


HEIRS = View("heirs", "part", name=f"'N' || ({K} % 50)", parent=f"'N' || (({K} + 1) % 50)", prop=f"CASE WHEN {K} % 4 = 0 THEN '' ELSE 'p' || ({K} % 9) END", seq=K)


@query(
    "+p AS (SELECT name AS n, arg_max(prop, seq) AS inherited FROM heirs WHERE prop <> '' GROUP BY 1) SELECT name, seq, CASE WHEN prop = '' THEN coalesce(inherited, '') ELSE prop END AS props"
    " FROM heirs LEFT JOIN p ON parent = n",
    HEIRS.sql,
)
def inherited_props(spark, d):
    c = HEIRS(spark, d).withColumnRenamed("parent", "extends").withColumn("props", F.filter(F.split("prop", ","), lambda p: p != ""))
    return components.inherit_props(c).select("name", "seq", F.array_join("props", ",").alias("props"))


# Token files.
TREES = View(
    "trees", "part", path=f"'t' || {K} || '.json'", k=K,
    content=f"""'{{"color": {{"c{{k}}": {{"$value": "#' || {hex6(f'{K} * 7919')} || '", "$type": "color"}}}}, "gap": {{"s": {{"$value": "' || ({K} % 40) || 'px", "$type": "dimension"}}}}' || CASE WHEN {K} % 9 = 0 THEN '' ELSE '}}' END""",
)


@query(
    f"SELECT path, 'color.c{{k}}' AS name, '#' || {hex6('k * 7919')} AS value, 'color' AS type, 'color' AS category, 'dtcg' AS format FROM trees WHERE k % 9 <> 0"
    " UNION ALL SELECT path, 'gap.s', (k % 40) || 'px', 'dimension', 'spacing', 'dtcg' FROM trees WHERE k % 9 <> 0",
    TREES.sql,
)
def token_files(spark, d):
    return tokens_json.read(TREES(spark, d))[0].drop("description")


@query("SELECT path, 'PARSE_ERROR' AS code FROM trees WHERE k % 9 = 0", TREES.sql)
def token_file_errors(spark, d):
    return tokens_json.read(TREES(spark, d))[1].select("path", "code")


LISTS = View("lists", "part", path=f"'tokens/' || {pick(K, repr('colors'), repr('radii'), repr('things'))} || '.json'", k=K, content=f"'[\"a' || {K} || '\", 3, \"b\"]'")


@query(
    "SELECT path, unnest(['a' || k, 'b']) AS name, CASE k % 3 WHEN 0 THEN 'color' WHEN 1 THEN 'border' ELSE 'other' END AS category FROM lists", LISTS.sql
)
def token_lists(spark, d):
    return tokens_json.read_lists(LISTS(spark, d))[0].select("path", "name", "category")


# Style text.
CSS = View("css", "part", path=f"'a' || {K} || '.css'", k=K, content=f"'.b {{ color: #' || {hex6(f'({K} % 40) * 7919')} || '; padding: ' || ({K} % 30) || 'px ' || ({K} % 5) || 'rem; margin: var(--m); }}'".replace("{{", "{").replace("}}", "}"))
_CSS_VALUES = (
    f"v AS (SELECT k, path, 'color' AS property, '#' || {hex6('(k % 40) * 7919')} AS value, 'color' AS category FROM css UNION ALL"
    " SELECT k, path, 'padding', unnest([(k % 30) || 'px', (k % 5) || 'rem']), 'spacing' FROM css)"
)


@query("SELECT path, property, value, category FROM v", CSS.sql, _CSS_VALUES)
def css_values(spark, d):
    return extract.css_values(CSS(spark, d)).select("path", "property", "value", "category")


@query("SELECT value, n, rank FROM (SELECT value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(k))::INT AS rank FROM v WHERE category = 'color' GROUP BY 1) WHERE rank <= 20", CSS.sql, _CSS_VALUES)
def css_top_colors(spark, d):
    v = extract.css_values(CSS(spark, d)).withColumn("seq", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    return styles.top_values(v, "color")


@query("SELECT value, count(*) AS n FROM (SELECT (600 + p_partkey % 3 * 100) || 'px' AS value FROM part) GROUP BY 1")
def css_breakpoints(spark, d):
    v = View("m", "part", path=f"'m' || {K}", content=f"'@media (min-width: ' || (600 + {K} % 3 * 100) || 'px) {{ .a {{ top: 0 }} }}'".replace("{{", "{").replace("}}", "}"))(spark, d)
    return extract.css_values(v).where("category = 'breakpoint'").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "+c AS (SELECT count(DISTINCT value) FILTER (WHERE category = 'color') AS unique_colors, count(DISTINCT value) FILTER (WHERE category = 'spacing') AS unique_spacing, count(*) AS hardcoded_usage FROM v),"
    " e AS (SELECT 3 * count(*) AS declarations, count(*) AS variable_usage FROM css)"
    " SELECT unique_colors, unique_spacing, hardcoded_usage, 0 AS unique_fonts, declarations, variable_usage, floor(variable_usage * 100 / (variable_usage + hardcoded_usage) + 0.5)::INT AS tokenization FROM c, e",
    CSS.sql, _CSS_VALUES,
)
def css_summary(spark, d):
    c = CSS(spark, d)
    declarations = c.select(F.explode(F.regexp_extract_all("content", F.lit(r"[a-z-]+:\s*([^;{}]+)"), F.lit(1))).alias("value"))
    return styles.css_summary(extract.css_values(c), declarations)


@query("SELECT path, unnest(['.a{x:' || k || '}', 'x{color:red}']) AS content FROM html", "html AS (SELECT p_partkey AS k, 'h' || p_partkey AS path FROM part)")
def style_blocks(spark, d):
    v = View("h", "part", path=f"'h' || {K}", content=f"'<style>.a{{x:' || {K} || '}}</style><p style=\"color:red\">t</p><!-- <style>no</style> --><script>var s = \"<style>n</style>\"</script>'".replace("{{", "{").replace("}}", "}"))
    return extract.style_text(v(spark, d))


@query("SELECT 'v' || p_partkey AS path, unnest(['--brand', '$gap']) AS name, unnest(['#' || p_partkey, (p_partkey % 9) || 'px']) AS value FROM part")
def css_variables(spark, d):
    v = View("v", "part", path=f"'v' || {K}", content=f"':root {{ --brand: #' || {K} || '; }}' || {NL} || '$gap: ' || ({K} % 9) || 'px;' || {NL} || '.x {{ --brand: late; }}'".replace("{{", "{").replace("}}", "}"))
    return extract.css_variables(v(spark, d))


@query("SELECT 'c' || p_partkey AS path, unnest([0, 1]) AS pos, unnest(['a b' || p_partkey, 'c']) AS classes FROM part")
def class_attributes(spark, d):
    return extract.classes(View("v", "part", path=f"'c' || {K}", content=f"'<i class=\"a b' || {K} || '\"></i><i className=\"c\"/>'")(spark, d))


@query(
    "SELECT 'u' || p_partkey AS path, unnest([1, 1, 2]) AS line, unnest(['css-var', 'hex', 'arbitrary']) AS kind, unnest(['--t' || (p_partkey % 9), '#' || lpad(lower(hex(p_partkey * 7919)), 6, '0'), 'p-[' || (p_partkey % 9) || 'px]']) AS name FROM part"
)
def token_usage_lines(spark, d):
    v = View("v", "part", path=f"'u' || {K}", content=f"'a {{ x: var(--t' || ({K} % 9) || '); y: #' || {hex6(f'{K} * 7919')} || ' }}' || {NL} || 'p-[' || ({K} % 9) || 'px] // #fff' || {NL} || '/* $no */'".replace("{{", "{").replace("}}", "}"))
    return extract.usages(v(spark, d))


# Style in markup and code.
ARBITRARY = View("arb", "part", path=f"'x' || {K}", k=K, content=f"'<p className=\"p-[' || ({K} % 40) || 'px] md:bg-[#' || {hex6(f'{K} * 7919')} || '] w-(--sz)\"/>'")


@query(
    f"SELECT path, 1 AS line, unnest(['p-[' || (k % 40) || 'px]', 'md:bg-[#' || {hex6('k * 7919')} || ']', 'w-(--sz)']) AS full_class, unnest(['p', 'bg', 'w']) AS utility,"
    f" unnest([(k % 40) || 'px', '#' || {hex6('k * 7919')}, '--sz']) AS value, unnest(['spacing', 'color', 'size']) AS kind FROM arb",
    ARBITRARY.sql,
)
def arbitrary_values(spark, d):
    return markup.arbitrary_values(ARBITRARY(spark, d))


@query("SELECT path AS entity_name, unnest(['spacing', 'color', 'size']) AS kind, unnest(['info', 'warning', 'info']) AS severity FROM arb", ARBITRARY.sql)
def arbitrary_signals(spark, d):
    s = styles.arbitrary_signals(markup.arbitrary_values(ARBITRARY(spark, d)))
    return s.select("entity_name", F.regexp_extract("message", r"arbitrary (\w+) values", 1).alias("kind"), "severity")


@query("SELECT 'y' || p_partkey AS path, 2 AS line, 'p-2 m-' || p_partkey AS classes FROM part")
def apply_directives(spark, d):
    v = View("v", "part", path=f"'y' || {K}", content=f"'.a {{' || {NL} || '@apply p-2' || {NL} || '   m-' || {K} || '; }}'".replace("{{", "{").replace("}}", "}"))
    return markup.apply_directives(v(spark, d))


@query("SELECT 's' || p_partkey AS path, 'cn' AS helper, unnest(['a', 'b', 'c' || (p_partkey % 9)]) AS class, 1::BIGINT AS n FROM part")
def static_classes(spark, d):
    return markup.static_classes(View("v", "part", path=f"'s' || {K}", content=f"'cn(\"a b\", x && \"c' || ({K} % 9) || '\")'")(spark, d))


@query("SELECT 'd' || p_partkey AS path, 1 AS line, 'p-* m-' || p_partkey AS pattern FROM part")
def dynamic_classes(spark, d):
    return markup.dynamic_classes(View("v", "part", path=f"'d' || {K}", content=f"'<i className={{`p-' || '$' || '{{a}} m-' || {K} || '`}}/>'".replace("{{", "{").replace("}}", "}"))(spark, d))


@query("SELECT 'z' || p_partkey AS path, unnest(['data', 'aria', 'group', 'peer']) AS kind, unnest(['state=s' || (p_partkey % 3), 'checked', 'hover', 'focus']) AS state, 1::BIGINT AS n FROM part")
def state_classes(spark, d):
    return markup.state_classes(View("v", "part", path=f"'z' || {K}", content=f"'data-[state=s' || ({K} % 3) || ']:p-1 aria-checked:m-1 group-hover:x peer-focus:y'")(spark, d))


INLINE = View("inl", "part", path=f"'i' || {K}", k=K, content=f"'<p' || {NL} || ' style={{{{ paddingTop: ' || ({K} % 50) || ', color: \"#' || {hex6(f'{K} * 7919')} || '\" }}}}/>'")
_INLINE = f"s AS (SELECT path, 2 AS line, unnest(['padding-top', 'color']) AS property, unnest([(k % 50) || 'px', '#' || {hex6('k * 7919')}]) AS value FROM inl)"


@query("SELECT path, line, property, value FROM s", INLINE.sql, _INLINE)
def inline_styles(spark, d):
    return markup.inline_styles(INLINE(spark, d))


@query("SELECT path, line, property, value, CASE property WHEN 'color' THEN 'color-value' ELSE 'spacing-value' END AS type FROM s", INLINE.sql, _INLINE)
def raw_signals(spark, d):
    return markup.raw_signals(markup.inline_styles(INLINE(spark, d))).select("path", "line", "property", "value", "type")


@query("SELECT CASE property WHEN 'color' THEN 'color-value' ELSE 'spacing-value' END AS type, count(*) AS n FROM s GROUP BY 1", INLINE.sql, _INLINE)
def raw_signal_stats(spark, d):
    return markup.signal_stats(markup.raw_signals(markup.inline_styles(INLINE(spark, d))))


ROUTES = View("routed", "part", k=K, path=f"'app/' || {pick(K, f"'(shop)/item' || {K}", f"'blog/[slug' || {K} || ']'", f"'x' || {K}")} || '/page.tsx'", content=pick(K, "'''use client'''", "'x'").replace("'''use client'''", "'\"use client\"'"))


@query(
    "SELECT path, CASE k % 3 WHEN 0 THEN '/item' || k WHEN 1 THEN '/blog/[slug' || k || ']' ELSE '/x' || k END AS route, 'page' AS kind, CASE WHEN k % 3 = 0 THEN 'shop' END AS \"group\","
    " k % 3 = 1 AS dynamic, k % 2 = 0 AS client FROM routed",
    ROUTES.sql,
)
def app_routes(spark, d):
    return markup.routes(ROUTES(spark, d))


@query("SELECT 'S' || p_partkey || '.stories.tsx' AS path, 'UI/B' || p_partkey AS title, 'B' AS component, 'One,Two' || p_partkey AS stories FROM part")
def story_files(spark, d):
    v = View("v", "part", path=f"'S' || {K} || '.stories.tsx'", content=f"'export default {{ title: \"UI/B' || {K} || '\", component: B }};' || {NL} || 'export const One = 1;' || {NL} || 'export const Two' || {K} || ' = 2;'".replace("{{", "{").replace("}}", "}"))
    return markup.stories(v(spark, d)).withColumn("stories", F.array_join("stories", ","))


@query("SELECT 'v/user-card' || p_partkey || '.blade.php' AS path, 'UserCard' || p_partkey AS name, 'base,parts/p' || (p_partkey % 5) AS dependencies FROM part")
def template_components(spark, d):
    v = View("v", "part", path=f"'v/user-card' || {K} || '.blade.php'", content=f"'@extends(\"base\") @include(\"parts/p' || ({K} % 5) || '\") @include(\"base\")'")
    return markup.template_components(v(spark, d)).withColumn("dependencies", F.array_join("dependencies", ","))


DESIGN = View(
    "design_files", "part", path=f"'g' || {K}", k=K,
    content=f"""'{{"document": {{"children": [{{"name": "Components", "children": [{{"id": "n' || {K} || '", "name": "Btn", "type": "COMPONENT_SET", "componentPropertyDefinitions":
  {{"Size": {{"variantOptions": ["a"' || CASE WHEN {K} % 2 = 0 THEN ', "b"' ELSE '' END || ']}}, "key": {{}}}}, "children": [{{"id": "m' || {K} || '", "name": "One", "type": "COMPONENT"}}]}}]}}]}}}}'""",
)


@query("SELECT path, unnest(['n' || k, 'm' || k]) AS id, unnest(['Btn', 'Btn/One']) AS hierarchy, unnest([NULL, 'n' || k]) AS set_id, unnest([1, 0])::INT AS children FROM design_files", DESIGN.sql)
def design_nodes(spark, d):
    return markup.design_nodes(DESIGN(spark, d))[0].select("path", "id", "hierarchy", "set_id", "children")


@query("SELECT 'n' || k AS id, 'reserved name' AS problem FROM design_files UNION ALL SELECT 'n' || k, 'single option' FROM design_files WHERE k % 2 = 1", DESIGN.sql)
def design_problems(spark, d):
    return markup.design_problems(markup.design_nodes(DESIGN(spark, d))[0])


# History.
CHANGES = View("changes", "orders", sha="o_orderkey", path=pick("o_orderkey", "'src/tokens/a.json'", "'src/app.ts'", "'styles/x.css'", "'lib/y.py'"))


@query("SELECT sha FROM commits WHERE sha % 4 IN (0, 2)", b.COMMITS)
def design_history(spark, d):
    return history.design_history(b.commits(spark, d), CHANGES(spark, d)).select("sha")


@query("SELECT sha FROM commits WHERE sha % 4 = 1 ORDER BY ts DESC, sha LIMIT 50", b.COMMITS)
def file_history(spark, d):
    return history.file_history(b.commits(spark, d), CHANGES(spark, d), "src/app.ts").select("sha")


@query("SELECT substr(sha256(lower(email)), 1, 16) AS src, sha AS dst FROM commits", b.COMMITS)
def authored_edges(spark, d):
    return history.authored(b.commits(spark, d))


@query("SELECT CASE WHEN i > 0 AND r = 0 THEN 'added' WHEN i = 0 AND r > 0 THEN 'deleted' ELSE 'modified' END AS status, count(*) AS n FROM (SELECT l_orderkey % 3 AS i, l_linenumber % 2 AS r FROM lineitem) GROUP BY 1")
def change_statuses(spark, d):
    s = b.table(spark, d, "lineitem").select(history.change_status(F.col("l_orderkey") % 3, F.col("l_linenumber") % 2).alias("status"))
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Reports and fixes.
@query("SELECT '{\"k\":' || p_partkey || ',\"name\":\"' || p_name || '\"}' AS value FROM part")
def json_report(spark, d):
    return reports.json_lines(View("v", "part", k=K, name="p_name")(spark, d))


SIG = View("sig", "part", seq=K, id=f"'s' || {K}", severity=pick(K, "'critical'", "'warning'", "'info'"), type=f"'t' || ({K} % 4)", entity_name=f"'E' || {K}", message=f"'m' || {K}", location=f"'f' || ({K} % 9) || '.ts:' || {K}")


@query("SELECT '- **' || severity || '** ' || type || ' `' || entity_name || '`: ' || message AS value FROM sig", SIG.sql)
def markdown_report(spark, d):
    return reports.markdown(SIG(spark, d))


@query("SELECT id, severity FROM sig ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, seq LIMIT 10", SIG.sql)
def worst_signals(spark, d):
    return reports.worst_first(SIG(spark, d)).select("id", "severity")


LINES = View("lines", "part", path=f"'p' || ({K} % 50)", line=K, text="'a #fff b #000 #fff'")


@query("SELECT path, line, CASE WHEN line % 3 = 0 THEN 'a var(--w) b var(--k) #fff' ELSE text END AS text FROM lines", LINES.sql)
def applied_fixes(spark, d):
    rows = LINES(spark, d).where("line % 3 = 0").selectExpr("path", "line", "explode(array(struct(3 AS column, '#fff' AS original, 'var(--w)' AS replacement), struct(10 AS column, '#000' AS original, 'var(--k)' AS replacement))) AS x")
    return reports.apply_fixes(LINES(spark, d), rows.select("path", "line", "x.*"))


FIXES = View("fixes", "part", seq=K, confidence=pick(K, "'low'", "'exact'", "'high'", "'medium'", "'exact'"), type=pick(K, "'hardcoded-color'", "'hardcoded-spacing'"), file=f"'f' || ({K} % 97) || '.ts'")


@query(
    "SELECT 'total' AS kind, 'all' AS key, count(*) AS n FROM fixes UNION ALL SELECT 'total', 'high confidence', count(*) FROM fixes WHERE confidence IN ('exact', 'high')"
    " UNION ALL SELECT 'confidence', confidence, count(*) FROM fixes GROUP BY confidence UNION ALL SELECT 'type', type, count(*) FROM fixes GROUP BY type",
    FIXES.sql,
)
def fix_summary(spark, d):
    return fixes.summary(FIXES(spark, d))


@query(
    "SELECT seq, row_number() OVER (ORDER BY CASE confidence WHEN 'exact' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, file, seq) AS place FROM fixes WHERE seq <= 97", FIXES.sql
)
def fix_order(spark, d):
    top = fixes.in_order(FIXES(spark, d).where("seq <= 97"))  # one report's fixes
    return top.select("seq").withColumn("place", F.monotonically_increasing_id()).select("seq", F.expr("row_number() OVER (ORDER BY place)").cast("long").alias("place"))


@query("SELECT seq, CASE WHEN seq % 5 = 0 THEN 'invalid path' WHEN seq % 4 = 0 THEN 'invalid line' WHEN seq % 3 = 0 THEN 'invalid column' WHEN seq % 2 = 0 THEN 'no change' END AS problem FROM fixes", FIXES.sql)
def fix_problems(spark, d):
    s = F.col("seq")
    problem = filters.fix_problem(F.when(s % 5 == 0, "").otherwise("a.ts"), F.when(s % 4 != 0, s), F.when(s % 3 == 0, 0).otherwise(1), F.lit("a"), F.when(s % 2 == 0, "a").otherwise("b"))
    return FIXES(spark, d).select("seq", problem.alias("problem"))


MESSAGES = View("messages", "part", k=K, actual=pick(K, f"'a' || {K}", "''", "''", "''", "''"), message=pick(K, "'x #fff'", "'color #a1b2c3 and 3px'", "'is rgba(1, 2, 3, 0.5) here'", "'gap 12.5px'", "'none'"))


@query("SELECT k, CASE k % 5 WHEN 0 THEN 'a' || k WHEN 1 THEN '#a1b2c3' WHEN 2 THEN 'rgba(1, 2, 3, 0.5)' WHEN 3 THEN '12.5px' END AS value FROM messages", MESSAGES.sql)
def found_values(spark, d):
    return MESSAGES(spark, d).select("k", strings.hardcoded_value(F.col("actual"), F.col("message")).alias("value"))


# Filters.
@query("SELECT bool_or(severity = 'critical') AS exceeds FROM sig", SIG.sql)
def any_critical(spark, d):
    return filters.any_at_least(SIG(spark, d), "critical")


@query("SELECT id FROM sig WHERE seq % 2 = 0 AND (seq % 3 = 0 OR seq % 10 >= 5)", SIG.sql)
def active_intents(spark, d):
    s = SIG(spark, d)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("seq") % 10).cast("int")).cast("timestamp")
    intents = s.select(F.col("id").alias("drift_id"), F.when(F.col("seq") % 2 == 0, "active").otherwise("done").alias("status"), F.when(F.col("seq") % 3 != 0, day).alias("expires_at"))
    return filters.active_intents(s, intents, F.lit("2024-01-06").cast("timestamp")).select("id")


@query("SELECT path FROM code WHERE (path LIKE '%.tsx' OR path LIKE 'src/d2/%') AND path NOT LIKE '%.test.tsx'", CODE.sql)
def glob_matches(spark, d):
    return CODE(spark, d).where(filters.matches_globs(F.col("path"), ["**/*.tsx", "src/d2/*"], ["*.test.tsx"])).select("path")


@query("SELECT path FROM code WHERE path LIKE '%.tsx' OR path LIKE '%.vue'", CODE.sql)
def scannable_files(spark, d):
    return CODE(spark, d).where(strings.is_scannable(F.col("path"))).select("path")


HEADS = View("heads", "part", k=K, content=pick(K, "'// AUTO-generated'", "'/* @generated */'", "'/* @Generated */'", "repeat(' ', 495) || 'do not edit'", "'// lint-disable x'"))


@query("SELECT k, k % 5 IN (0, 1) AS generated, k % 5 = 4 AS ignored FROM heads", HEADS.sql)
def marked_files(spark, d):
    c = F.col("content")
    return HEADS(spark, d).select("k", strings.is_generated(c).alias("generated"), strings.ignore_marked(c, "lint").alias("ignored"))


STYLED = View("styled", "part", k=K, prop=pick(K, "'background-color'", "'backgroundColor'", "'Gap'", "'fontSize'", "'fontFamily'"), value=pick(f"CAST(floor({K} / 5) AS BIGINT)", "'#fff'", "'12px'", "'var(--x)'", "'9pt'"))


@query(
    "SELECT k, CASE WHEN v = 0 AND k % 5 <= 1 THEN 'color' WHEN v = 1 AND k % 5 = 2 THEN 'spacing' WHEN v IN (1, 3) AND k % 5 = 3 THEN 'fontSize' END AS kind FROM (SELECT k, (k // 5) % 4 AS v FROM styled)",
    STYLED.sql,
)
def hardcoded_types(spark, d):
    return STYLED(spark, d).select("k", strings.hardcoded_type(F.col("prop"), F.col("value")).alias("kind"))


# Searches.
PARTS = View("parts", "part", id=K, name=f"'Comp' || ({K} % 60)", prop=pick(K, "'size'", "'onSize'", "'color'"), variant=pick(K, "'small'", "'big'"), category=pick(K, "'Color'", "'spacing'", "'font'"))


def _parts(spark, d):
    return PARTS(spark, d).withColumns({"props": F.array("prop"), "variants": F.array("variant")})


@query("SELECT id, CASE WHEN prop = 'size' THEN 100.0 ELSE 80.0 END::DOUBLE AS score FROM parts WHERE prop <> 'color'", PARTS.sql)
def search_by_prop(spark, d):
    return search.by_prop(_parts(spark, d), "Size").select("id", "score")


@query("SELECT id, (CASE WHEN prop <> 'color' THEN 30 ELSE 0 END)::DOUBLE AS score FROM parts WHERE prop <> 'color'", PARTS.sql)
def search_by_pattern(spark, d):
    return search.by_pattern(_parts(spark, d), "size").select("id", "score")


@query("SELECT id, 100.0::DOUBLE AS score FROM parts WHERE category = 'Color'", PARTS.sql)
def search_by_category(spark, d):
    return search.tokens_by_category(PARTS(spark, d), "COLOR").select("id", "score")


PATHS = View("paths", "part", k=K, path=pick(K, "'src/examples/A.tsx'", "'src/A.stories.tsx'", "'src/__tests__/A.tsx'", "'src/A.spec.ts'", "''", "'src/A.tsx'"))


@query("SELECT k, CASE k % 6 WHEN 0 THEN 'example' WHEN 1 THEN 'example' WHEN 2 THEN 'test' WHEN 3 THEN 'test' WHEN 4 THEN 'unknown' ELSE 'production' END AS context FROM paths", PATHS.sql)
def component_contexts(spark, d):
    return PATHS(spark, d).select("k", search.component_context(F.col("path")).alias("context"))


SHOWN = View("shown", "part", id=K, name=f"'C' || CAST(floor({K} / 2) AS BIGINT)", context=pick(K, "'production'", "'example'"), prop=pick(K, "'a'", "'B'"))


@query("SELECT id, 'b' AS missing FROM shown WHERE context = 'production' AND name IN (SELECT name FROM shown WHERE context = 'example')", SHOWN.sql)
def example_only_props(spark, d):
    c = SHOWN(spark, d).withColumn("props", F.array("prop"))
    return search.example_only(c).withColumn("missing", F.array_join("missing", ","))


@query("SELECT 'a' || p_partkey || '.ts' AS path, 'src/m' || (p_partkey % 7) || '/index.ts' AS target FROM part")
def file_importers(spark, d):
    i = View("i", "part", path=f"'a' || {K} || '.ts'", module=f"'../m' || ({K} % 7) || '/index'")(spark, d)
    return search.importers(i, View("t", "part", "p_partkey <= 7", target=f"'src/m' || ({K} % 7) || '/index.ts'")(spark, d))


@query("SELECT 'G' || floor(p_partkey / 5)::BIGINT AS parent, count(*) AS n, string_agg('G' || floor(p_partkey / 5)::BIGINT || '/v' || p_partkey, ',' ORDER BY 'G' || floor(p_partkey / 5)::BIGINT || '/v' || p_partkey) AS names FROM part GROUP BY 1 HAVING count(*) >= 2")
def potential_variants(spark, d):
    return search.potential_variants(View("v", "part", name=f"'G' || CAST(floor({K} / 5) AS BIGINT) || '/v' || {K}")(spark, d)).withColumn("names", F.array_join("names", ","))


@query("SELECT p_partkey AS id, (1 + p_partkey % 3) * (1 + p_partkey % 4) AS expected, p_partkey % 7 AS actual, p_partkey % 7 < (1 + p_partkey % 3) * (1 + p_partkey % 4) AS incomplete, false AS excessive FROM part")
def variant_matrix(spark, d):
    c = b.table(spark, d, "part").select(F.col(K).alias("id"), F.array(F.array_repeat(F.lit("x"), (F.col(K) % 3 + 1).cast("int")), F.array_repeat(F.lit("y"), (F.col(K) % 4 + 1).cast("int"))).alias("options"), (F.col(K) % 7).alias("children"))
    return search.variant_matrix(c)


@query("SELECT p_partkey AS k, p_partkey % 3 <> 1 AS in_order FROM part")
def size_orders(spark, d):
    o = F.split(F.when(F.col(K) % 3 == 0, "sm,lg,odd,XL").when(F.col(K) % 3 == 1, "lg,sm").otherwise("a,b"), ",")
    return b.table(spark, d, "part").select(F.col(K).alias("k"), search.sizes_in_order(o).alias("in_order"))


# Detectors and scores.
@query("SELECT 'deprecated-pattern' AS type, name AS entity_name, 'Component \"' || name || '\" is marked as deprecated' AS message FROM parts WHERE id % 9 = 0", PARTS.sql)
def deprecated_components(spark, d):
    c = PARTS(spark, d).withColumns({"deprecated": F.col("id") % 9 == 0, "reason": F.lit("old")})
    return detect.deprecated(c).select("type", "entity_name", "message")


HANDLERS = View("handlers", "part", component=K, prop=pick(K, "'onClick'", "'onPress'", "'onClickAway'", "'handleClick'", "'size'"), type="'f'", required="false", seq=K)


@query("SELECT component, prop, 'on' AS prefix, floor(100 * count(*) FILTER (WHERE prop LIKE 'on%') OVER () / count(*) OVER () + 0.5)::INT AS percent FROM handlers WHERE prop <> 'size' QUALIFY prop NOT LIKE 'on%'", HANDLERS.sql)
def handler_outliers(spark, d):
    return aggregate.handler_outliers(HANDLERS(spark, d))


@query("SELECT id, unnest(['no label', 'low contrast']) AS detail FROM (SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 3 <> 0)")
def accessibility_issues(spark, d):
    c = b.table(spark, d, "part").select(
        F.col(K).alias("id"), F.when(F.col(K) % 2 == 0, "IconButton").otherwise("Grid").alias("name"), F.array(F.when(F.col(K) % 3 == 0, "ariaLabel").otherwise("size")).alias("props"),
        F.array(F.lit("no label"), F.lit("low contrast")).alias("issues"),
    )
    return detect.accessibility(c).select(F.col("entity_id").cast("long").alias("id"), "detail")


@query("SELECT p_partkey AS k, CASE WHEN r >= 7 THEN 'AAA' WHEN r >= 4.5 THEN 'AA' WHEN r >= 3 THEN 'AA-large' ELSE 'fail' END AS level FROM (SELECT p_partkey, (p_partkey % 90) / 10.0 AS r FROM part)")
def contrast_levels(spark, d):
    return b.table(spark, d, "part").select(F.col(K).alias("k"), detect.contrast_level((F.col(K) % 90) / 10.0).alias("level"))


@query("SELECT 'react,vue' AS frameworks, 2 AS n FROM range(1)")
def framework_sprawl(spark, d):
    names = View("v", "part", name=pick(K, "'react'", "'vue'", "'express'"))(spark, d)
    return aggregate.framework_sprawl(names, ["react", "vue", "svelte"]).withColumn("frameworks", F.array_join("frameworks", ","))


@query(
    "SELECT k, s AS score, CASE WHEN s >= 80 THEN 'optimized' WHEN s >= 60 THEN 'managed' WHEN s >= 40 THEN 'defined' WHEN s >= 20 THEN 'emerging' ELSE 'none' END AS level,"
    " greatest(0, least(100, least(50, k % 20 * 5) + 50 - least(50, k % 40 * 2)))::INT AS report FROM (SELECT p_partkey AS k, floor(p_partkey % 101 * 0.4 + CASE WHEN p_partkey % 80 <= 8 THEN 100 WHEN p_partkey % 80 <= 16 THEN 75 WHEN p_partkey % 80 <= 32 THEN 50"
    " WHEN p_partkey % 80 <= 64 THEN 25 ELSE 0 END * 0.2 + CASE WHEN p_partkey % 40 <= 8 THEN 100 WHEN p_partkey % 40 <= 16 THEN 75 WHEN p_partkey % 40 <= 32 THEN 50 ELSE 25 END * 0.2"
    " + CASE WHEN p_partkey % 6 <= 3 THEN 50 WHEN p_partkey % 101 >= 50 THEN 100 ELSE 25 END * 0.2 + 0.5)::INT AS s FROM part)"
)
def maturity_scores(spark, d):
    k = F.col(K)
    s = aggregate.maturity_score(k % 101, k % 80, k % 40, k % 6)
    return b.table(spark, d, "part").select(k.alias("k"), s.alias("score"), aggregate.maturity_level(s).alias("level"), aggregate.report_score(k % 20, k % 40).alias("report"))


# Class strings and helpers.
UTILITY = View("util", "part", k=K, file=f"'f' || ({K} % 30)", line=K, classes=pick(K, "'flex items-center justify-between p-2'", "'hover:a hover:b x'", "'bg-primary text-muted-foreground'", "'flex items-center'"))


@query(
    "SELECT 'flex-center' AS kind, 'flex items-center justify-between' AS pattern, count(*) AS n, count(DISTINCT file) AS files FROM util WHERE k % 4 = 0"
    " UNION ALL SELECT 'hover-effect', 'hover:a hover:b', count(*), count(DISTINCT file) FROM util WHERE k % 4 = 1",
    UTILITY.sql,
)
def extractable_patterns(spark, d):
    return styles.extractable(UTILITY(spark, d))


@query(
    "SELECT token, count(*) AS n, count(DISTINCT file)::INT AS files, c AS examples FROM (SELECT file, unnest(['primary', 'muted-foreground']) AS token, unnest(['bg-primary', 'text-muted-foreground']) AS c FROM util WHERE k % 4 = 2) GROUP BY token, c",
    UTILITY.sql,
)
def semantic_token_uses(spark, d):
    return styles.semantic_tokens(UTILITY(spark, d)).withColumn("examples", F.array_join("examples", ","))


HELPERS = View("helpers", "part", path=f"'h' || {K}", content=pick(K, "'x = getColor(1); spacing(2)'", "'useTheme()'", "'plain'"), k=K)


@query(
    "SELECT name, category, min(path) AS path FROM (SELECT path, unnest(['getColor', 'spacing()']) AS name, unnest(['color', 'spacing']) AS category FROM helpers WHERE k % 3 = 0"
    " UNION ALL SELECT path, 'useTheme', 'generic' FROM helpers WHERE k % 3 = 1) GROUP BY ALL",
    HELPERS.sql,
)
def token_helpers(spark, d):
    return styles.utilities(HELPERS(spark, d))


HARD = View("hard", "part", component=f"'C' || ({K} % 90)", kind=pick(K, "'color'", "'spacing'", "'fontSize'", "'shadow'", "'other'"), property="'p'", value=f"'v' || {K}")
_CATEGORY = "CASE kind WHEN 'spacing' THEN 'spacing' WHEN 'fontSize' THEN 'spacing' WHEN 'color' THEN 'color' WHEN 'shadow' THEN 'shadow' END"


@query(f"SELECT {_CATEGORY} AS category, count(*) AS n, count(DISTINCT component) AS components FROM hard WHERE kind <> 'other' GROUP BY 1", HARD.sql)
def helper_summary(spark, d):
    return styles.utility_summary(HARD(spark, d))


@query(f"SELECT component AS entity_name, CASE WHEN kind = 'color' THEN 'getColor' ELSE 'spacing()' END AS detail, count(*) AS n FROM hard WHERE {_CATEGORY} IN ('color', 'spacing') GROUP BY ALL", HARD.sql)
def helper_signals(spark, d):
    s = styles.utility_signals(HARD(spark, d), styles.utilities(HELPERS(spark, d)))
    return s.groupBy("entity_name", "detail").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT px, count(DISTINCT value) AS n FROM (SELECT DISTINCT (p_partkey % 70) || 'px' AS value, (p_partkey % 70)::DOUBLE AS v FROM part), (SELECT unnest([4, 8, 16, 32]) AS px) WHERE abs(v - px) <= 2 GROUP BY px"
)
def replaced_lengths(spark, d):
    values = View("v", "part", value=f"({K} % 70) || 'px'")(spark, d)
    return styles.replaced_lengths(values, spark.createDataFrame([(x,) for x in (4, 8, 16, 32)], "px int"))


# Graph.
@query("SELECT id FROM nodes WHERE type = 'Commit' AND id NOT IN (SELECT src FROM edges WHERE type = 'CHANGED')", b.GRAPH)
def commits_without_changes(spark, d):
    return graph.without_out(b.graph_nodes(spark, d), b.graph_edges(spark, d), "Commit", "CHANGED").select("id")


@query("SELECT dst, count(*) AS n, count(DISTINCT src) AS sources FROM edges WHERE type = 'CHANGED' GROUP BY dst", b.GRAPH)
def renderers(spark, d):
    return graph.usages(b.graph_edges(spark, d), "CHANGED")


@query("SELECT 0 AS part, '  \"' || id || '\" [label=\"' || name || '\"];' AS line FROM nodes UNION ALL SELECT 1, '  \"' || src || '\" -> \"' || dst || '\" [label=\"' || type || '\"];' FROM edges", b.GRAPH)
def graph_dot(spark, d):
    return graph.dot(b.graph_nodes(spark, d), b.graph_edges(spark, d))


@query("SELECT src, dst, type FROM edges", b.GRAPH)
def graph_round_trip(spark, d):
    return graph.from_cytoscape(graph.cytoscape(b.graph_nodes(spark, d), b.graph_edges(spark, d).withColumn("id", F.concat_ws(">", "type", "src", "dst"))))[1].select("src", "dst", "type")


FLAGS = View("flags", "part", type=pick(K, "'DRIFTS_FROM'", "'FLAGGED_IN'", "'USES'"), src=f"'n' || {K}", dst=f"'pr:' || ({K} % 11)", expected=f"'e' || {K}", actual=f"'a' || {K}")


@query("SELECT src AS token, expected, actual FROM flags WHERE type = 'DRIFTS_FROM'", FLAGS.sql)
def drifting_tokens(spark, d):
    return graph.drifting_tokens(FLAGS(spark, d))


@query("SELECT CASE dst WHEN 'pr:3' THEN '3' ELSE dst END AS pr, src AS drift FROM flags WHERE type = 'FLAGGED_IN' AND dst IN ('pr:3', 'pr:5')", FLAGS.sql)
def drift_in_pr(spark, d):
    return graph.drift_in_pr(FLAGS(spark, d), spark.createDataFrame([("3",), ("pr:5",)], "pr string"))


BUILD = View("raw_nodes", "part", id=f"'n' || ({K} % 90)", name=f"'x' || {K}", seq=K)
LINKS = View("raw_edges", "part", id=f"'e' || ({K} % 300)", src=f"'n' || ({K} % 90)", dst=f"'n' || ({K} % 100)", seq=K)


@query("SELECT id, arg_min(src, seq) AS src, arg_min(dst, seq) AS dst FROM raw_edges WHERE src <> dst AND dst IN (SELECT id FROM raw_nodes) GROUP BY id", BUILD.sql, LINKS.sql)
def built_edges(spark, d):
    return graph.build(BUILD(spark, d), LINKS(spark, d))[1].select("id", "src", "dst")


# Names, places, colors and lengths.
NAMES = View("names", "part", k=K, name=pick(K, f"'IUser' || {K}", f"'BaseCard-' || {K}", f"'AppView'", f"'icon_{{x}}'", "'Inner'"))


@query("SELECT k, CASE k % 5 WHEN 0 THEN 'user' || k WHEN 1 THEN 'card' || k WHEN 2 THEN 'app' WHEN 3 THEN 'icon{x}' ELSE 'inner' END AS key FROM names", NAMES.sql.replace("{{", "{").replace("}}", "}"))
def comparison_keys(spark, d):
    return NAMES(spark, d).select("k", strings.comparison_key(F.col("name")).alias("key"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN '--x' || p_partkey WHEN 1 THEN '--color-brand-main' ELSE '--font-size' || p_partkey END AS v FROM part")
def css_variable_names(spark, d):
    v = View("v", "part", k=K, name=pick(K, f"'--x' || {K}", "'color.brandMain'", f"'fontSize' || {K}"))(spark, d)
    return v.select("k", strings.css_variable(F.col("name")).alias("v"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 < 2 THEN 'a:b' || p_partkey || '.ts' END AS file, CASE WHEN p_partkey % 3 < 2 THEN p_partkey END::INT AS line, CASE WHEN p_partkey % 3 = 1 THEN 7 END AS col FROM part")
def location_parts(spark, d):
    v = View("v", "part", k=K, at=pick(K, f"'a:b' || {K} || '.ts:' || {K}", f"'a:b' || {K} || '.ts:' || {K} || ':7'", "'nowhere'"))(spark, d)
    return v.withColumn("x", strings.location_parts(F.col("at"))).select("k", "x.file", "x.line", F.col("x.column").alias("col"))


@query("SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'ocean' WHEN 1 THEN 'dark' WHEN 2 THEN 'v1' WHEN 3 THEN 'new' WHEN 4 THEN 'acme' END AS variant FROM part")
def variant_names(spark, d):
    v = View("v", "part", k=K, path=pick(K, "'registry/ocean/ui/a.tsx'", "'src/themes/dark/a.tsx'", "'variant/v1/x'", "'styles/new/registry/old/other/x'", "'src/brand/acme/a'", "'src/a.tsx'"))(spark, d)
    return v.select("k", strings.variant_name(F.col("path")).alias("variant"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN p_partkey + 0.5 WHEN 1 THEN p_partkey WHEN 2 THEN 2 ELSE 0 END::DOUBLE AS value, CASE p_partkey % 4 WHEN 2 THEN 'rem' ELSE 'px' END AS unit FROM part")
def dimensions(spark, d):
    v = View("v", "part", k=K, text=pick(K, f"{K} || '.5px'", f"'' || {K}", "'2rem'", "'auto'"))(spark, d)
    return v.select("k", strings.dimension(F.col("text")).alias("x")).select("k", "x.*")


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '#ff0000' WHEN 1 THEN '#0000ff' WHEN 2 THEN '#808080' ELSE '#bfff00' END AS hex FROM part")
def hsl_colors(spark, d):
    v = View("v", "part", k=K, h=pick(K, "0", "240", "0", "75"), s=pick(K, "100", "100", "0", "100"), l="50")(spark, d)
    return v.select("k", colors.hsl_hex(F.col("h").cast("double"), F.col("s").cast("double"), F.col("l").cast("double")).alias("hex"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN '#ff0000' WHEN 1 THEN '#aabbcc' WHEN 2 THEN '#010203' ELSE NULL END AS hex FROM part")
def normal_colors(spark, d):
    v = View("v", "part", k=K, c=pick(K, "'Red'", "'#ABC'", "'rgba(1, 2, 3, 0.5)'", "'12px'"))(spark, d)
    return v.select("k", colors.normal_color(F.col("c"), "suggestion").alias("hex"))


@query(
    "+d AS (SELECT DISTINCT 'b' || (p_partkey % 70) AS key FROM part), c AS (SELECT DISTINCT 'b' || (p_partkey % 90 + 20) AS key FROM part)"
    " SELECT coalesce(d.key, c.key) AS key, CASE WHEN d.key IS NOT NULL AND c.key IS NOT NULL THEN 'matched' WHEN c.key IS NULL THEN 'design only' ELSE 'code only' END AS side FROM d FULL JOIN c ON d.key = c.key",
    "unused AS (SELECT 1)",
)
def design_orphans(spark, d):
    return compare.name_report(View("v", "part", name=f"'B ' || ({K} % 70)")(spark, d), View("w", "part", name=f"'b-' || ({K} % 90 + 20)")(spark, d))


# Vocabularies.
VOCABULARY = View("vocabulary", "part", scope=f"'s' || ({K} % 20)", name=f"'color-' || {K}", value=f"'#' || {hex6(f'{K} * 7919')}")


@query("SELECT scope, ':root {' || chr(10) || string_agg('  --' || name || ': ' || value || ';', chr(10) ORDER BY name) || chr(10) || '}' || chr(10) AS css FROM vocabulary GROUP BY scope", VOCABULARY.sql)
def css_output(spark, d):
    return tokenize.css(VOCABULARY(spark, d))


@query("SELECT scope, '{\"theme\":{\"extend\":{\"colors\":{' || string_agg('\"' || name || '\":\"' || value || '\"', ',' ORDER BY name) || '}}}}' AS theme FROM vocabulary GROUP BY scope", VOCABULARY.sql)
def tailwind_output(spark, d):
    return tokenize.tailwind(VOCABULARY(spark, d))


@query("SELECT p_partkey AS k, (p_partkey % 50) || 'px' AS value FROM part WHERE p_partkey % 50 NOT IN (16, 32)")
def sizes_without_breakpoints(spark, d):
    v = View("v", "part", k=K, value=f"({K} % 50) || 'px'")(spark, d)
    return tokenize.without_breakpoints(v, spark.createDataFrame([("1rem",), ("32px",)], "value string"))


@query("SELECT 's' || (p_partkey % 9) AS scope, CASE WHEN p_partkey % 9 < 4 THEN 8 END AS base, CASE WHEN p_partkey % 9 < 4 THEN '8,16,24,32,40,48,56,64,72,80' ELSE '4,8,12,16,24,32,48,64' END AS scale FROM part GROUP BY ALL")
def default_scales(spark, d):
    v = View("v", "part", scope=f"'s' || ({K} % 9)", px=f"CASE WHEN {K} % 9 < 4 THEN {K} * 8 + CASE {K} % 27 WHEN 1 THEN 4 ELSE 0 END END")(spark, d)
    s = tokenize.spacing_scale(v.where("px IS NULL OR px % 8 = 0"))
    return s.select("scope", F.when(F.col("base").isNotNull(), 8).alias("base"), F.array_join(F.when(F.col("base") == 4, F.transform("scale", lambda x: x * 2)).otherwise(F.col("scale")), ",").alias("scale"))


VARIANTS = View("vp", "part", name=f"'N' || CAST(floor({K} / 2) AS BIGINT)", id=K, prop=pick(K, "'Size'", "'size'"), type=pick(K, "'string'", "'number'"), required="false", seq=K)


@query(
    "+p AS (SELECT a.name, a.id AS a_id, b.id AS b_id FROM vp a JOIN vp b ON a.name = b.name AND a.seq < b.seq)"
    " SELECT name, a_id, b_id, unnest(['size', 'v' || (a_id % 3), 'v' || (b_id % 3), 'gap']) AS field, unnest(['prop-type', 'variant-missing', 'variant-missing', 'style-value']) AS difference,"
    " unnest(['warning', 'info', 'info', 'warning']) AS severity FROM p",
    VARIANTS.sql,
)
def variant_differences(spark, d):
    v = VARIANTS(spark, d)
    return detect.variant_differences(v, v.select("id", F.concat(F.lit("V"), (F.col("id") % 3).cast("string")).alias("variant")), v.select("id", F.lit("gap").alias("property"), F.col("id").cast("string").alias("value"), "seq"))
