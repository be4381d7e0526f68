"""All styles of a tree in one scan: each file goes to the extractors of its syntax family, and what they find is told apart behind them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.sources import literals, markup

# File endings by syntax family; all other markup is like HTML.
FAMILIES = {"css": "css scss sass less", "jsx": "jsx tsx js ts mdx astro", "vue": "vue", "angular": "component.html component.ts", "svelte": "svelte"}
_ATTRIBUTE = re.compile(r"""(?<![\w:.\]-])style\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_BLOCK = re.compile(r"(?is)<style\b[^>]*>(.*?)</style>")
_OBJECT = {
    "jsx": re.compile(r"\bstyle=\{\s*(?=\{)"),
    "vue": re.compile(r"""(?<!\w)(?:v-bind)?:style=(["'])\s*(?=\{)"""),
    "angular": re.compile(r"""\[ngStyle\]=(["'])\s*(?=\{)"""),
}
_BOUND = {
    "angular": re.compile(r"""\[style\.([\w-]+)(?:\.([\w%]+))?\]=["']'?([^"']+)'?["']"""),
    "svelte": re.compile(r"""\bstyle:([\w-]+)(?:\|important)?=(?:"([^"{]*)"|'([^'{]*)'|\{["']([^"']*)["']\})"""),
}
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_UNITLESS = frozenset("opacity zIndex fontWeight lineHeight flex flexGrow flexShrink order zoom".split())


def family(path: Column | str) -> Column:
    """The syntax family of a file, by its ending; the longest that fits."""
    path = F.col(path) if isinstance(path, str) else path
    out = None
    for name in ("angular", "css", "jsx", "vue", "svelte"):
        hit = path.rlike(rf"\.(?:{'|'.join(re.escape(e) for e in FAMILIES[name].split())})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("html")


def _objects(kind: str, text: str) -> Iterator[tuple[int, str, str]]:
    for m in _OBJECT[kind].finditer(text):
        source = text
        if kind != "jsx":  # the literal ends where the attribute does
            end = text.find(m[1], m.end())
            source = text[: end if end >= 0 else len(text)]
        try:
            tree = literals.Reader(source, m.end()).value()
        except ValueError:
            continue
        for keys, value, literal in literals.leaves(tree):
            number = re.fullmatch(r"-?\d+(?:\.\d+)?", value)
            if len(keys) == 1 and (literal or number):
                unit = "px" if number and not literal and kind == "jsx" and keys[0] not in _UNITLESS and value != "0" else ""
                yield m.start(), keys[0], value + unit


def found(kind: str, text: str) -> Iterator[tuple[int, str, str, str]]:
    """(offset, form, property, value): declarations of objects and bindings, and whole CSS texts with no property."""
    if kind == "css":
        yield 0, "file", "", text
        return
    text = _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for m in _BLOCK.finditer(text):
        yield m.start(1), "block", "", m[1]
    for m in _ATTRIBUTE.finditer(text):
        yield m.start(), "attribute", "", m[1] if m[1] is not None else m[2]
    if kind in _OBJECT:
        for at, name, value in _objects(kind, text):
            yield at, "object", name, value
    if kind == "angular":
        for m in _BOUND[kind].finditer(text):
            yield m.start(), "binding", m[1], m[3] + (m[2] or "")
    if kind == "svelte":
        for m in _BOUND[kind].finditer(text):
            yield m.start(), "binding", m[1], next(g for g in m.groups()[1:] if g is not None)


def scanned(files: DataFrame) -> DataFrame:
    """(path, family, line, form, property, text) of all styles in files (path, content); property is '' where text is CSS with declarations of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, kind, content in pdf[["path", "family", "content"]].itertuples(index=False):
                rows += [(path, kind, content.count("\n", 0, at) + 1, form, name, text) for at, form, name, text in found(kind, content)]
            yield pd.DataFrame(rows, columns=["path", "family", "line", "form", "property", "text"])

    f = files.where("content is not null").select("path", family("path").alias("family"), "content")
    return f.mapInPandas(run, "path string, family string, line int, form string, property string, text string")


def declarations(styles: DataFrame) -> DataFrame:
    """(path, family, line, form, property, value) of scanned() styles: properties in kebab case; declarations of CSS texts count from the line of their text on."""
    bare = F.regexp_replace("text", r"(?s)/\*.*?\*/", "")
    pattern = r"(?:^|[;{}\n])\s*(-{0,2}[a-zA-Z][\w-]*)\s*:\s*([^;{}\n]+)(?=[;}\n]|$)"
    pairs = F.arrays_zip(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all(bare, F.lit(pattern), F.lit(2)).alias("v"))
    own = F.array(F.struct(F.col("property").alias("p"), F.col("text").alias("v")))
    rows = styles.select("path", "family", "line", "form", F.explode(F.when(F.col("property") == "", pairs).otherwise(own)).alias("d"))
    name = F.when(F.col("d.p").startswith("--"), F.col("d.p")).otherwise(markup._kebab(F.col("d.p")))
    return rows.select("path", "family", "line", "form", name.alias("property"), F.trim("d.v").alias("value"))


def signals(files: DataFrame) -> DataFrame:
    """The raw signals (markup.raw_signals) of all files, from one scan of them."""
    return markup.raw_signals(declarations(scanned(files)).select("path", "line", "property", "value"))


def summary(files: DataFrame) -> DataFrame:
    """(family, form, files, declarations) of a tree."""
    per = declarations(scanned(files)).groupBy("family", "form", "path").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("family", "form").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("declarations"))
