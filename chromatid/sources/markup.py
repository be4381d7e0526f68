"""Style in markup and code: inline objects and bindings, utility classes, directives, routes, stories, design files, raw signals.

Files are (path, content). Most are regular expressions inside Spark; what may run over several lines or needs balanced braces is found in Python, over the whole
content, at the line it begins on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.functions import ids
from chromatid.sources import files as files_

# Utilities that take arbitrary values, by the type of what they set. A utility of several types is told apart by its value.
FAMILIES = {
    "color": "text bg border fill stroke from via to accent caret decoration shadow",
    "spacing": "p px py pt pr pb pl ps pe m mx my mt mr mb ml ms me gap gap-x gap-y space-x space-y inset inset-x inset-y top right bottom left scroll-m scroll-p",
    "size": "w h min-w max-w min-h max-h size",
    "grid": "grid-cols grid-rows cols rows auto-cols auto-rows",
    "timing": "duration delay transition ease",
    "border": "rounded rounded-t rounded-r rounded-b rounded-l rounded-tl rounded-tr rounded-bl rounded-br ring divide-x divide-y outline outline-offset border-t border-r border-b border-l border-x border-y",
    "layout": "aspect z basis grow shrink order columns object",
    "transform": "translate-x translate-y rotate scale scale-x scale-y skew-x skew-y origin",
    "filter": "blur brightness contrast saturate hue-rotate invert sepia grayscale backdrop-blur backdrop-brightness backdrop-contrast backdrop-saturate drop-shadow",
    "typography": "leading tracking font underline-offset indent line-clamp list",
    "visual": "opacity content will-change cursor",
}
# Raw signal types by CSS property, in kebab case.
SIGNAL_TYPES = {
    "color-value": "color background-color background border-color fill stroke outline-color caret-color",
    "spacing-value": "margin margin-top margin-right margin-bottom margin-left padding padding-top padding-right padding-bottom padding-left gap row-gap column-gap top right bottom left width height",
    "font-size": "font-size",
    "font-family": "font-family",
    "font-weight": "font-weight",
    "radius-value": "border-radius",
    "shadow-value": "box-shadow",
}
# Helpers that join class strings, and special files of routed applications.
CLASS_HELPERS = "cn|clsx|classNames|cx|cva|twMerge"
ROUTE_FILES = "page|layout|loading|error|not-found|template|route|default"


def _all(text: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


_CODE = re.compile(r"""//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`|[{}]""", re.S)
_IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_OPENINGS = {
    "styles": re.compile(r"""style=\{\s*\{|:style="\s*\{|\[ngStyle\]="\s*\{"""),
    "classes": re.compile(r"class(?:Name)?=\{\s*`"),
    "apply": re.compile(r"@apply\s+([^;}]+)"),
}


def _block(text: str, at: int) -> tuple[str, int] | None:
    """What stands between a brace that opened before at and the one that closes it, without comments, and where it ends."""
    out, depth, start = [], 1, at
    while m := _CODE.search(text, at):
        at = m.end()
        if m[0][:2] in ("//", "/*"):
            out.append(text[start : m.start()])
            start = at
        elif m[0] == "`":
            if (inner := _template(text, at)) is None:
                return None
            at = inner[1]
        elif m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return "".join([*out, text[start : m.start()]]), at
    return None


def _template(text: str, at: int) -> tuple[str, int] | None:
    """A template literal that opened before at, with ``*`` for what is filled in, and where it ends."""
    out = []
    while m := _IN_TEMPLATE.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "`":
            return "".join(out), at
        if m[0] == "${":
            if (inner := _block(text, at)) is None:
                return None
            at = inner[1]
        out.append("*" if m[0] == "${" else m[0])
    return None


def _found(kind: str, text: str) -> Iterator[tuple[int, str]]:
    line, at = 1, 0
    for m in _OPENINGS[kind].finditer(text):
        line, at = line + text.count("\n", at, m.start()), m.start()
        if kind == "apply":
            yield line, m[1]
        elif kind == "styles":
            if inner := _block(text, m.end()):
                yield line, inner[0]
        elif (inner := _template(text, m.end())) and text.count("${", m.end(), inner[1]) and re.compile(r"\s*\}").match(text, inner[1]):
            yield line, inner[0]


def _spans(files: DataFrame, kind: str) -> DataFrame:
    """(path, line, text) of style objects, templates of classes or @apply lists, over any number of lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) if c is not None for n, t in _found(kind, c)]
            yield pd.DataFrame(rows, columns=["path", "line", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, line int, text string")


def _joined(text: str) -> Column:
    """Lines as one, with a space between."""
    return F.trim(F.regexp_replace(text, r"\s*\n\s*", " "))


def arbitrary_kind(utility: Column, value: Column) -> Column:
    """What an arbitrary value sets: by its utility, and for those of several types by the value."""
    length = value.rlike(r"^-?\d*\.?\d+(px|rem|em)$")
    kind = F.when((utility == "text") & length, "typography").when(utility.isin("border", "stroke") & length, "border").when((utility == "shadow") & value.rlike(r"^-?\d"), "visual")
    for name, utilities in FAMILIES.items():
        kind = kind.when(utility.isin(utilities.split()), name)
    return kind.otherwise("other")


def arbitrary_values(files: DataFrame) -> DataFrame:
    """(path, line, full_class, utility, value, kind) of classes with arbitrary values, once a line: ``md:p-[13px]``, ``bg-[#fff]/50``, ``w-(--x)``, ``[color:red]``."""
    prefix = r"(?:(?:@(?:min|max)-\[[^\]]+\]|@?[a-z][a-z-]*(?:\[[^\]]+\])?|\[&[^\]]+\]):)*"
    pattern = rf"(?<![\w\-\[])({prefix}(?:-?[a-z][a-z-]*-(?:\[[^\]\s]+\](?:/\d+)?|\(--[\w-]+\))|\[-{{0,2}}[a-z][\w-]*:[^\]\s]+\]))(?![:\w])"
    found = _lines(files).select("path", "line", F.explode(F.array_distinct(_all("text", pattern, 1))).alias("full_class"))
    bare = F.regexp_replace("full_class", rf"^{prefix}(?=-?[a-z\[])", "")
    found = found.withColumn("bare", bare).withColumn("utility", F.regexp_extract("bare", r"^-?([a-z][a-z-]*)-[\[(]", 1))
    inner = F.regexp_extract("bare", r"[\[(]([^\])]*(?:\)[^\])]*)*)[\])](?:/\d+)?$", 1)
    value = F.when(F.col("bare").startswith("["), inner).otherwise(F.regexp_replace(inner, "^(color|length|size):", ""))
    kind = F.when(F.col("bare").startswith("["), "css-property").when(inner.startswith("color:"), "color").otherwise(arbitrary_kind(F.col("utility"), value))
    return found.select("path", "line", "full_class", "utility", value.alias("value"), kind.alias("kind"))


def apply_directives(files: DataFrame) -> DataFrame:
    """(path, line, classes) of @apply directives."""
    return _spans(files, "apply").select("path", "line", _joined("text").alias("classes"))


def static_classes(files: DataFrame) -> DataFrame:
    """(path, helper, class, n): quoted classes in calls of class helpers."""
    calls = F.arrays_zip(_all("content", rf"\b({CLASS_HELPERS})\(((?:[^()]|\([^()]*\))*)\)", 1).alias("h"), _all("content", rf"\b({CLASS_HELPERS})\(((?:[^()]|\([^()]*\))*)\)", 2).alias("b"))
    rows = files.select("path", F.explode(calls).alias("x")).select("path", F.col("x.h").alias("helper"), F.explode(_all("x.b", r"""["'`]([^"'`$]*)["'`]""", 1)).alias("text"))
    rows = rows.select("path", "helper", F.explode(F.filter(F.split("text", r"\s+"), lambda c: c != "")).alias("class"))
    return rows.groupBy("path", "helper", "class").agg(F.count(F.lit(1)).alias("n"))


def dynamic_classes(files: DataFrame) -> DataFrame:
    """(path, line, pattern) of template literals in class attributes, with ``*`` for what is filled in."""
    return _spans(files, "classes").select("path", "line", _joined("text").alias("pattern")).distinct()


def state_classes(files: DataFrame) -> DataFrame:
    """(path, kind, state, n): classes that depend on data attributes, aria states, groups and peers."""
    forms = {"data": r"\bdata-\[([^\]]+)\]:", "aria": r"\baria-([a-z]+|\[[^\]]+\]):", "group": r"\bgroup-([a-z-]+(?:\[[^\]]+\])?):", "peer": r"\bpeer-([a-z-]+(?:\[[^\]]+\])?):"}

    def form(kind: str, pattern: str) -> Column:
        return F.transform(_all("content", pattern, 1), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("state")))

    rows = files.select("path", F.explode(F.concat(*[form(k, p) for k, p in forms.items()])).alias("x")).select("path", "x.*")
    return rows.groupBy("path", "kind", "state").agg(F.count(F.lit(1)).alias("n"))


def inline_styles(files: DataFrame) -> DataFrame:
    """(path, line, property, value) of style objects (``style={{…}}``, ``:style="{…}"``, ``[ngStyle]="{…}"``) and style bindings (``[style.x.px]="…"``); properties in kebab case."""
    pair = r"""['"]?([a-zA-Z-]+)['"]?\s*:\s*(?:'([^']*)'|"([^"]*)"|(-?\d+(?:\.\d+)?))"""
    body = _spans(files, "styles").withColumnRenamed("text", "body")
    parts = F.arrays_zip(*[_all("body", pair, i).alias(n) for i, n in ((1, "p"), (2, "a"), (3, "b"), (4, "n"))])
    o = body.select("path", "line", F.explode(parts).alias("x"))
    px = F.when(F.col("x.n") != "", F.concat("x.n", F.lit("px")))
    o = o.select("path", "line", _kebab(F.col("x.p")).alias("property"), F.coalesce(F.nullif("x.a", F.lit("")), F.nullif("x.b", F.lit("")), px).alias("value")).where("value is not null")
    binding = r"""\[style\.([a-zA-Z-]+)((?:\.[a-z%]+)?)\]="'?([^'"]+)'?\""""
    b = _lines(files).select("path", "line", F.explode(F.arrays_zip(*[_all("text", binding, i).alias(n) for i, n in ((1, "p"), (2, "u"), (3, "v"))])).alias("x"))
    b = b.select("path", "line", _kebab(F.col("x.p")).alias("property"), F.concat("x.v", F.regexp_replace("x.u", r"^\.", "")).alias("value"))
    return o.unionByName(b)


def raw_signals(styles: DataFrame, normalized: bool = True) -> DataFrame:
    """(id, type, value, path, line, property) of hard-coded style values (path, line, property, value), first of an id; token references give none.

    Properties without a type are told by their value: a color, else a length. With ``normalized`` off, property names are taken as they
    are, so that names in another case than kebab go by their value.
    """
    p = _kebab(F.col("property")) if normalized else F.col("property")
    kind = None
    for name, properties in SIGNAL_TYPES.items():
        hit = p.isin(properties.split())
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    color = F.col("value").rlike(r"(?i)^(#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})|(rgb|hsl)a?\(.*\)|oklch\(.*\))$")
    length = F.col("value").rlike(r"(?i)^-?\d*\.?\d+(px|rem|em|%|vh|vw)$")
    kind = F.coalesce(kind, F.when(color, "color-value").when(length, "spacing-value"))
    fits = F.when(kind == "color-value", color).when(kind.isin("spacing-value", "font-size"), length).otherwise(F.lit(True))
    s = styles.where(~F.col("value").rlike(r"var\(--|theme\.|tokens\.|\$")).withColumn("type", kind).where(F.col("type").isNotNull() & fits)
    s = s.withColumn("id", ids.signal_id(F.col("type"), F.col("path"), F.col("line"), F.col("value")))
    return s.groupBy("id").agg(F.min(F.struct("type", "value", "path", "line", "property")).alias("s")).select("id", "s.*")


def signal_stats(signals: DataFrame) -> DataFrame:
    """(type, n) of raw signals, each id once."""
    return signals.groupBy("type").agg(F.countDistinct("id").alias("n"))


def routes(files: DataFrame) -> DataFrame:
    """(path, route, kind, group, dynamic, client) of an application's routed files: groups in parentheses aren't part of the route; ``client`` is the directive."""
    f = files.withColumn("inner", F.regexp_extract("path", r"(?:^|/)app/((?:.*/)?)(?:" + ROUTE_FILES + r")\.(?:tsx?|jsx?)$", 1))
    f = f.withColumn("kind", F.regexp_extract("path", r"(?:^|/)app/(?:.*/)?(" + ROUTE_FILES + r")\.(?:tsx?|jsx?)$", 1)).where("kind <> ''")
    parts = F.filter(F.split("inner", "/"), lambda s: s != "")
    shown = F.transform(F.filter(parts, lambda s: ~s.startswith("(")), lambda s: F.regexp_replace(s, r"^\[+(?:\.\.\.)?([^\]]+)\]+$", "[$1]"))
    client = F.col("content").rlike(r"^\s*['\"]use client['\"]")
    group = F.regexp_extract("inner", r"\(([^)]+)\)/[^(]*$", 1)
    return f.select("path", F.concat(F.lit("/"), F.array_join(shown, "/")).alias("route"), "kind", F.nullif(group, F.lit("")).alias("group"), F.col("inner").contains("[").alias("dynamic"), client.alias("client"))


def stories(files: DataFrame) -> DataFrame:
    """(path, title, component, stories) of story files: the meta's title and component, and the exported stories."""
    f = files.where(F.col("path").rlike(r"\.stories\.[jt]sx?$"))
    names = _all("content", r"(?m)^export\s+(?:const|function)\s+([A-Z]\w*)", 1)
    part = lambda p: F.nullif(F.regexp_extract("content", p, 1), F.lit(""))
    return f.select("path", part(r"title:\s*['\"]([^'\"]+)['\"]").alias("title"), part(r"component:\s*(\w+)").alias("component"), names.alias("stories"))


def template_components(files: DataFrame) -> DataFrame:
    """(path, name, dependencies) of templates: a Pascal-case name from the path, and the templates that a file includes or renders."""
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[a-z]+)+$", 1)
    name = F.array_join(F.transform(F.split(stem, r"[-_\s]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 200))), "")
    included = r"""(?:@include\(|@extends\(|\{%-?\s*(?:include|extends|render)\s+|\{\{>\s*|<%-?\s*include\(|<%=\s*render\s+|#include\s+)\s*['"]?([\w./-]+)"""
    return files.select("path", name.alias("name"), F.array_distinct(_all("content", included, 1)).alias("dependencies"))


def _walk(path: str, content: str) -> Iterator[tuple]:
    document = json.loads(content)["document"]
    pages = document.get("children") or []
    named = [p for p in pages if p.get("name", "").lower() == "components"]
    stack = [(n, (), None) for p in reversed(named or pages) for n in reversed(p.get("children") or [])]
    while stack:
        node, above, owner = stack.pop()
        names, kind = (*above, node.get("name", "")), node.get("type")
        if kind in ("COMPONENT", "COMPONENT_SET"):
            options = {k: v.get("variantOptions") or [] for k, v in (node.get("componentPropertyDefinitions") or {}).items()}
            yield node.get("id"), node.get("name"), kind, "/".join(names), owner, list(options), [list(v) for v in options.values()], len(node.get("children") or [])
        inner = node.get("id") if kind == "COMPONENT_SET" else None
        stack += [(c, names, inner) for c in reversed(node.get("children") or [])]


def design_nodes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, errors) of design files' JSON: (path, id, name, type, hierarchy, set_id, props, options, children), of the page named components, else of all."""
    schema = "id string, name string, type string, hierarchy string, set_id string, props array<string>, options array<array<string>>, children int"
    return files_.scan(files, _walk, schema)


def design_problems(nodes: DataFrame) -> DataFrame:
    """(id, problem) of components' properties: names alike but for case, mixed conventions, one option only, numbers as options, reserved and special names."""
    names = F.col("props")
    lower = F.transform(names, F.lower)
    kinds = F.array_distinct(F.filter(F.transform(names, lambda n: F.when(n.contains(" "), "spaced").when(n.contains("-"), "kebab").when(n.contains("_"), "snake").when(n.rlike("^[A-Z]"), "pascal").when(n.rlike("[A-Z]"), "camel")), lambda k: k.isNotNull()))
    problems = {
        "duplicate property": F.size(F.array_distinct(lower)) < F.size(names),
        "mixed conventions": F.size(kinds) > 1,
        "single option": F.exists("options", lambda o: F.size(o) == 1),
        "numeric options": F.exists("options", lambda o: (F.size(o) > 0) & F.forall(o, lambda x: x.rlike(r"^\d+$"))),
        "reserved name": F.exists(lower, lambda n: n.isin("key", "ref", "children")),
        "special characters": F.exists(names, lambda n: n.rlike(r"[^\w\s\-]")),
    }
    found = F.filter(F.array(*[F.when(c, p) for p, c in problems.items()]), lambda p: p.isNotNull())
    return nodes.select("id", F.explode(found).alias("problem"))
