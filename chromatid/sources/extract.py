"""Text to rows: imports, links, CSS values, utility classes, token usages. Regular expressions inside Spark, exploded; no Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.functions import strings

# Forms of imports, as (kind, pattern, group of the names or 0, group of the module).
_NAME, _FROM = r"[a-zA-Z_$][a-zA-Z0-9_$]*", r"['\"]([^'\"]+)['\"]"
IMPORTS = (
    ("default", rf"import\s+({_NAME})\s+from\s+{_FROM}", 1, 2),
    ("named", rf"import\s*\{{([^}}]+)\}}\s*from\s*{_FROM}", 1, 2),
    ("namespace", rf"import\s*\*\s*as\s+({_NAME})\s+from\s+{_FROM}", 1, 2),
    ("side-effect", rf"import\s+{_FROM}", 0, 1),
    ("mixed", rf"import\s+({_NAME}\s*,\s*\{{[^}}]+)\}}\s*from\s*{_FROM}", 1, 2),
    ("dynamic", rf"import\s*\(\s*{_FROM}\s*\)", 0, 1),
    ("require", rf"require\s*\(\s*{_FROM}\s*\)", 0, 1),
    ("re-export", rf"export\s*\{{([^}}]+)\}}\s*from\s*{_FROM}", 1, 2),
    ("re-export-all", rf"export\s*\*\s*from\s*{_FROM}", 0, 1),
)
# Files that an import without an extension may mean, in order.
EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js")
# CSS properties by category.
COLOR_PROPERTIES = (
    "color background background-color border border-color border-top-color border-right-color border-bottom-color border-left-color outline-color fill stroke caret-color"
    " text-decoration-color box-shadow"
).split()
SPACING_PROPERTIES = (
    "margin margin-top margin-right margin-bottom margin-left padding padding-top padding-right padding-bottom padding-left gap row-gap column-gap"
).split()
SIZING_PROPERTIES = "width height min-width max-width min-height max-height".split()
POSITION_PROPERTIES = "top right bottom left inset".split()
RADIUS_PROPERTIES = "border-radius border-top-left-radius border-top-right-radius border-bottom-left-radius border-bottom-right-radius".split()
# Usages of tokens and hard-coded values, by kind.
USAGES = {
    "css-var": r"var\(\s*(--[a-zA-Z0-9_-]+)",
    "scss-var": r"(\$[a-zA-Z_][a-zA-Z0-9_-]*)",
    "hex": r"(#(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3})\b)",
    "rgb": r"(rgba?\([^)]+\))",
    "hsl": r"(hsla?\([^)]+\))",
    "arbitrary": r"\b([a-z][a-z-]*-\[[^\]\s]+\])",
}


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def imports(files: DataFrame) -> DataFrame:
    """(path, kind, names, module, external) of the imports in files (path, content), one row each."""

    def form(kind: str, pattern: str, names: int, module: int) -> Column:
        modules = _all(F.col("content"), pattern, module)
        of = _all(F.col("content"), pattern, names) if names else F.transform(modules, lambda m: F.lit(""))
        return F.transform(F.arrays_zip(of.alias("n"), modules.alias("m")), lambda x: F.struct(F.lit(kind).alias("kind"), x["n"].alias("names"), x["m"].alias("module")))

    forms = [form(*i) for i in IMPORTS]
    rows = files.select("path", F.explode(F.concat(*forms)).alias("x")).select("path", "x.*")
    return rows.withColumn("names", import_names(F.col("names"))).withColumn("external", ~F.col("module").rlike("^[./]"))


def import_names(clause: Column) -> Column:
    """The imported names of a clause: split at commas, without aliases and braces."""
    parts = F.transform(F.split(F.regexp_replace(clause, r"[{}]", ""), ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"\s+as\s+.*$", "")))
    return F.filter(parts, lambda p: p != "")


def links(pages: DataFrame, column: str = "html") -> DataFrame:
    """(page_id, href) of the links in pages, in page order (pos)."""
    return pages.select("page_id", F.posexplode(_all(F.col(column), r'<a\s[^>]*?href="([^"]*)"', 1)).alias("pos", "href"))


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def _clean(path: Column) -> Column:
    """A path without . and .. segments."""
    return F.array_join(
        F.aggregate(
            F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".")),
            F.array().cast("array<string>"),
            lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
        ),
        "/",
    )


def resolve(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, target): relative imports with the file they mean, by the first extension that gives one."""
    e = edges.where("not external").select("path", "module").distinct()
    base = _clean(F.concat_ws("/", _folder(F.col("path")), "module"))
    tries = e.withColumn("base", base).select("path", "module", F.posexplode(F.array(*[F.concat("base", F.lit(x)) for x in EXTENSIONS])).alias("pos", "target"))
    met = tries.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return met.groupBy("path", "module").agg(F.min_by("target", "pos").alias("target"))


def packages(edges: DataFrame) -> DataFrame:
    """(package, n) of external imports."""
    return edges.where("external").groupBy(strings.package_name(F.col("module")).alias("package")).agg(F.count(F.lit(1)).alias("n"))


def css_category(prop: Column) -> Column:
    return (
        F.when(prop.isin(COLOR_PROPERTIES), "color")
        .when(prop.isin(SPACING_PROPERTIES + POSITION_PROPERTIES), "spacing")
        .when(prop.isin(SIZING_PROPERTIES), "sizing")
        .when(prop == "font-size", "font-size")
        .when(prop.isin(RADIUS_PROPERTIES), "radius")
        .when(prop == "font-family", "font-family")
        .otherwise("other")
    )


def css_values(files: DataFrame) -> DataFrame:
    """(path, pos, property, value, raw, category) of CSS text (path, content): colors, lengths, and breakpoints of media queries; var() and calc() values are left out."""
    text = F.col("content")
    pattern = r"(?i)([a-z-]+)\s*:\s*([^;{}]+)"
    pairs = F.arrays_zip(_all(text, pattern, 1).alias("p"), _all(text, pattern, 2).alias("v"))
    d = files.select("path", F.posexplode(pairs).alias("pos", "x")).select("path", "pos", F.lower(F.trim("x.p")).alias("property"), F.trim("x.v").alias("raw"))
    d = d.where(~F.col("raw").rlike(r"^(var|calc)\(") & (F.col("raw") != "")).withColumn("category", css_category(F.col("property"))).where("category <> 'other'")
    raw = F.col("raw")
    found = F.concat(
        F.transform(_all(raw, r"(?i)(#(?:[0-9a-f]{8}|[0-9a-f]{6}|[0-9a-f]{3,4})\b)", 1), F.lower),
        F.transform(_all(raw, r"(?i)(rgba?\s*\([^)]+\))", 1), lambda c: F.regexp_replace(F.lower(c), r"\s+", "")),
        F.transform(_all(raw, r"(?i)((?:hsla?|oklch)\s*\([^)]+\))", 1), F.lower),
    )
    from chromatid.functions.colors import NAMED_COLORS

    named = F.filter(F.split(F.lower(raw), r"\s+"), lambda w: w.isin(list(NAMED_COLORS)))
    color = F.when(F.size(found) > 0, found).otherwise(named)
    numbers = F.transform(_all(raw, r"(?i)(-?\d*\.?\d+(?:px|rem|em|%|vh|vw|ch|ex|vmin|vmax))", 1), F.lower)
    lengths = F.when((F.size(numbers) == 0) & raw.rlike(r"\b0\b"), F.array(F.lit("0"))).otherwise(numbers)
    d = d.withColumn("value", F.explode(F.when(F.col("category") == "color", color).otherwise(lengths)))
    media = _all(text, r"(?i)(@media[^{]*\{)", 1)
    widths = r"(?i)(?:min|max)-width\s*:\s*(\d+(?:\.\d+)?(?:px|rem|em))"
    m = files.select("path", F.posexplode(media).alias("pos", "raw")).withColumn("value", F.explode(_all(F.col("raw"), widths, 1)))
    m = m.select("path", "pos", F.lit("width").alias("property"), F.lower("value").alias("value"), "raw", F.lit("breakpoint").alias("category"))
    return m.unionByName(d.select("path", "pos", "property", "value", "raw", "category"))


def style_text(files: DataFrame) -> DataFrame:
    """(path, content): the CSS in markup's style blocks and style attributes, comments and scripts left out."""
    bare = F.regexp_replace("content", r"(?s)<!--.*?-->|<script\b.*?</script>", "")
    css = F.concat(_all(bare, r"(?is)<style\b[^>]*>(.*?)</style>", 1), F.transform(_all(bare, r"(?i)\sstyle=\"([^\"]*)\"", 1), lambda s: F.concat(F.lit("x{"), s, F.lit("}"))))
    return files.select("path", F.explode(css).alias("content"))


def usages(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(path, line, kind, name) of token usages and hard-coded values in files, outside comments; with known (name), of these names only."""
    text = F.regexp_replace("content", r"(?s)/\*.*?\*/", "")
    lines = files.select("path", F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"(?<!:)//.*$", ""))

    def form(kind: str, pattern: str) -> Column:
        return F.transform(_all(F.col("line"), pattern, 1), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    forms = [form(k, p) for k, p in USAGES.items()]
    found = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.concat(*forms)).alias("x")).select("path", "line", "x.*")
    return found if known is None else found.join(known.select(F.lower("name").alias("_n")).distinct(), F.lower("name") == F.col("_n"), "left_semi")


def classes(files: DataFrame) -> DataFrame:
    """(path, pos, classes) of class attributes."""
    return files.select("path", F.posexplode(_all(F.col("content"), r"\bclass(?:Name)?=\"([^\"]*)\"", 1)).alias("pos", "classes"))


def css_variables(files: DataFrame) -> DataFrame:
    """(path, name, value) of CSS and SCSS variables that files define; the first definition of a name in a file counts."""
    forms = F.concat(
        *[
            F.transform(F.arrays_zip(_all(F.col("content"), p, 1).alias("n"), _all(F.col("content"), p, 2).alias("v")), lambda x: F.struct(x["n"].alias("name"), F.trim(x["v"]).alias("value")))
            for p in (r"(--[a-zA-Z0-9_-]+)\s*:\s*([^;}]+)", r"(?m)^\s*(\$[a-zA-Z0-9_-]+)\s*:\s*([^;]+)")
        ]
    )
    rows = files.select("path", F.posexplode(forms).alias("pos", "x")).select("path", "pos", "x.*")
    return rows.groupBy("path", "name").agg(F.min_by("value", "pos").alias("value"))
