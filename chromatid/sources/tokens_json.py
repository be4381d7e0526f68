"""Design-token JSON files (path, content) as token rows, in three formats.

dtcg: ``$value`` and ``$type``, types inherited by groups; tokens-studio: ``value`` with ``type``; style-dictionary: ``value`` alone. Names are the keys
joined by dots. Nesting is of any depth, so each file is walked by a small function in Python; files are scanned in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from chromatid.sources import files as files_

SCHEMA = "name string, value string, type string, category string, format string, description string"


def detect(tree: object) -> str:
    """The format: dtcg if any $value is there, tokens-studio if a type and a value are, else style-dictionary."""
    seen, stack = set(), [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            seen |= x.keys()
            stack += x.values()
    return "dtcg" if "$value" in seen else "tokens-studio" if {"type", "value"} <= seen else "style-dictionary"


def category(kind: str | None, name: str, value: object) -> str:
    """A token's category by its type, else by its value and name."""
    by_type = {"color": "color", "dimension": "spacing", "spacing": "spacing", "sizing": "sizing", "fontFamily": "typography", "fontSize": "typography", "typography": "typography"}
    if kind in by_type | {"shadow": "", "boxShadow": "", "border": ""}:
        return by_type.get(kind) or ("shadow" if "hadow" in kind else "border")
    text, low = str(value), name.lower()
    if text.startswith("#") or "color" in low:
        return "color"
    words = {"spacing": ("spacing", "space", "gap"), "typography": ("font", "text", "type"), "shadow": ("shadow",), "border": ("border", "radius")}
    return next((c for c, ws in words.items() if any(w in low for w in ws)), "other")


def walk(path: str, content: str) -> Iterator[tuple]:
    tree = json.loads(content)
    form = detect(tree)
    key, kind_key = ("$value", "$type") if form == "dtcg" else ("value", "type")

    def visit(node: object, names: tuple[str, ...], inherited: str | None) -> Iterator[tuple]:
        if not isinstance(node, dict):
            return
        kind = node.get(kind_key, inherited) if form == "dtcg" or key in node else inherited
        if key in node and names:
            value, name = node[key], ".".join(names)
            text = value if isinstance(value, str) else json.dumps(value)
            note = node.get("$description", node.get("description"))
            yield name, text, kind, category(kind, name, value), form, note
            return
        for k, child in node.items():
            if not k.startswith("$"):
                yield from visit(child, (*names, k), kind)

    yield from visit(tree, (), None)


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, errors) of token files (path, content)."""
    return files_.scan(files, walk, SCHEMA)


# Categories of token lists by their file's name.
LIST_CATEGORIES = {
    "color": "colors color", "spacing": "spacing space", "typography": "font-sizes fontsizes font-weights fontweights fonts line-heights lineheights letter-spacings letterspacing",
    "shadow": "shadows shadow", "border": "radii radius borders border", "sizing": "sizes size", "motion": "durations duration easings",
}


def walk_list(path: str, content: str) -> Iterator[tuple]:
    stem = path.rsplit("/", 1)[-1].replace(".json", "").lower()
    kind = next((c for c, names in LIST_CATEGORIES.items() if stem in names.split()), "other")
    for name in json.loads(content):
        if isinstance(name, str):
            yield name, name, "raw", kind, "list", f"Token name from {path}"


def read_lists(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens, errors) of files (path, content) that list token names in a JSON array; the category comes from the file's name."""
    return files_.scan(files, walk_list, SCHEMA)
