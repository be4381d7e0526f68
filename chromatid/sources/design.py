"""Design files: components of the node tree with all that their properties, variants and children say, and the tags that quality checks give them.

Files are (path, content), content the JSON of a file. The tree is walked in Python, one row a component; every tag is an expression over that row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.sources import files as files_

# Names of sizes in order, words for states and levels of which two make a scale, names that frameworks reserve.
SIZES = "2xs xxs xsmall xs 2xsmall small sm medium md default large lg xlarge xl 2xl xxl 2xlarge".split()
STATES = ["success warning error info", "valid invalid", "active inactive", "enabled disabled", "positive negative"]
LEVELS = ["primary secondary tertiary", "main alt", "filled outlined", "solid outline ghost", "default outlined text", "contained outlined text"]
SWITCHES = ["true false", "yes no", "on off"]
RESERVED = ["key", "ref", "children"]
TOGGLE = r"^(show|has|hide|display)\s|\svisible$|^(is\s*)?visible$"
SPECIAL = r"[/:@#\[\]{}|\\<>]"
DEPRECATED = (r"\[deprecated\]|deprecated:|^deprecated|do not use", r"^_?deprecated|/_?deprecated/|^old-|^legacy-")
SLOT = r"^\.|_slot$|^placeholder|^slot[-_]"
#: More properties with variants than this are too many; deeper components than this are tagged.
MOST_DIMENSIONS, SHALLOW = 4, 2

_COMPONENT = (
    "id string, name string, type string, hierarchy array<string>, set_id string, definitions array<struct<key: string, type: string, options: array<string>, preset: string>>,"
    " children array<struct<name: string, type: string>>, defined boolean, bound int, key string, description string, published boolean, listed boolean"
)


def _text(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _walk(path: str, content: str) -> Iterator[tuple]:
    file = json.loads(content)
    meta = file.get("components") or {}
    pages = file["document"].get("children") or []
    named = [p for p in pages if p.get("name", "").lower() == "components"]
    stack = [(n, (), None) for p in reversed(named or pages) for n in reversed(p.get("children") or [])]
    while stack:
        node, above, owner = stack.pop()
        names, kind, children = (*above, node.get("name", "")), node.get("type"), node.get("children")
        if kind in ("COMPONENT", "COMPONENT_SET"):
            given, about = node.get("componentPropertyDefinitions"), meta.get(node.get("id")) or {}
            definitions = [{"key": k, "type": d.get("type"), "options": d.get("variantOptions"), "preset": _text(d.get("defaultValue"))} for k, d in (given or {}).items()]
            inner = None if children is None else [{"name": c.get("name", ""), "type": c.get("type")} for c in children]
            yield (
                node.get("id"), node.get("name"), kind, list(names), owner, definitions, inner, given is not None, len(node.get("boundVariables") or {}),
                about.get("key"), about.get("description"), bool(about.get("remote")), bool(about),
            )
        stack += [(c, names, node.get("id") if kind == "COMPONENT_SET" else None) for c in reversed(children or [])]


def components(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, errors) of design files: every component and set of the page named components, else of all pages, with its properties and direct children."""
    return files_.scan(files, _walk, _COMPONENT)


def _lower(words: Column) -> Column:
    return F.transform(words, F.lower)


def _two_of(options: Column, groups: list[str]) -> Column:
    """Whether some group has two words among the options."""
    hit = F.lit(False)
    for group in groups:
        hit = hit | (F.size(F.array_intersect(_lower(options), F.array(*[F.lit(w) for w in group.split()]))) >= 2)
    return hit


def _convention(name: Column) -> Column:
    camel = name.rlike("^[a-z][a-zA-Z0-9]*$") & name.rlike("[A-Z]")
    return F.when(name.contains("-"), "kebab").when(name.rlike("^[A-Z][a-zA-Z0-9]*$"), "pascal").when(camel, "camel").when(name.rlike("^[a-z]+$"), "lower").otherwise("other")


def _switch_form(name: Column) -> Column:
    form = F.when(name.startswith("is"), "is")
    for word in ("has", "show", "hide", "display"):
        form = form.when(name.startswith(word), word)
    return form.when(name.endswith("visible"), "visible").when(name.startswith("with"), "with").otherwise("other")


def _size_place(option: Column) -> Column:
    """Place of the first size that an option is, begins or ends with; 0 for none."""
    hits = F.array(*[option.startswith(s) | option.endswith(s) for s in SIZES])
    return F.coalesce(F.array_position(hits, True), F.lit(0))


def tags(found: DataFrame) -> DataFrame:
    """(path, id, tag) of components(): what stands out in names, properties, variants and the children of sets."""
    c = F.col
    is_set = c("type") == "COMPONENT_SET"
    variants = F.filter("definitions", lambda d: d["type"] == "VARIANT")
    dimensions = F.filter(variants, lambda d: d["options"].isNotNull())
    switches = F.filter("definitions", lambda d: d["type"] == "BOOLEAN")
    keys = F.transform("definitions", lambda d: d["key"])
    members = F.filter("children", lambda n: n["type"] == "COMPONENT")

    def cut(part: Column) -> Column:
        ends = F.split(part, "=")
        return F.struct(F.trim(ends[0]).alias("key"), F.trim(F.get(ends, F.lit(1))).alias("value"))

    said = F.flatten(F.transform(members, lambda n: F.transform(F.split(n["name"], ","), cut)))
    pairs = F.filter("_said", lambda p: (p["key"] != "") & (p["value"] != ""))
    said_keys = F.array_distinct(F.filter(F.transform("_said", lambda p: p["key"]), lambda k: k != ""))
    product = F.aggregate(dimensions, F.lit(1).cast("long"), lambda n, d: n * F.size(d["options"]))

    def value_form(d: Column) -> Column:
        short = F.forall(d["options"], lambda o: o.rlike("^[a-z]{2,4}$"))
        full = F.forall(d["options"], lambda o: o.rlike(r"^[A-Z][a-zA-Z]*(\s[A-Z][a-zA-Z]*)*$") & (F.char_length(o) > 3))
        return F.when(short, "short").when(full, "full").otherwise("mixed")

    forms = F.transform(dimensions, value_form)
    any_options = lambda test: F.exists(dimensions, lambda d: test(d["options"]))

    def of_key(p: Column, test) -> Column:
        return F.exists(dimensions, lambda d: (d["key"] == p["key"]) & test(d["options"]))

    undefined = F.exists(pairs, lambda p: of_key(p, lambda o: ~F.array_contains(_lower(o), F.lower(p["value"]))))
    other_case = F.exists(pairs, lambda p: of_key(p, lambda o: ~F.array_contains(o, p["value"]) & F.array_contains(_lower(o), F.lower(p["value"]))))
    orphan = F.exists(dimensions, lambda d: F.exists(d["options"], lambda o: ~F.exists(pairs, lambda p: (p["key"] == d["key"]) & (F.lower(p["value"]) == F.lower(o)))))
    unknown = F.exists(pairs, lambda p: ~F.array_contains(F.transform(variants, lambda d: F.lower(d["key"])), F.lower(p["key"])))
    numbers = lambda o: F.size(F.filter(o, lambda x: x.rlike(r"^\d+$")))
    single = (F.size("children") == 1) | (F.size(variants) > 0) & F.forall(variants, lambda d: F.coalesce(F.size(d["options"]) == 1, F.lit(False)))
    defaults = F.array_join(F.transform(F.filter(variants, lambda d: d["preset"].isNotNull()), lambda d: F.concat(d["key"], F.lit("="), d["preset"])), ", ")
    sized = F.filter(dimensions, lambda d: (F.lower(d["key"]).contains("size") | (F.lower(d["key"]) == "scale")))
    places = F.filter(F.transform(sized, lambda d: F.filter(F.transform(d["options"], lambda o: _size_place(F.lower(o))), lambda n: n > 0)), lambda n: F.size(n) >= 2)
    first = F.get(places, F.lit(0))
    ordered = first == F.array_sort(first)
    toggles = F.size(F.filter(switches, lambda d: F.lower(d["key"]).rlike(TOGGLE)))
    depth = F.size("hierarchy")
    about, name = F.lower(F.coalesce("description", F.lit(""))), F.lower("name")

    plain = {
        "component-set": is_set,
        "naming-inconsistency": is_set & (F.size(F.array_distinct(_lower(said_keys))) < F.size(said_keys)),
        "empty-component-set": is_set & (F.coalesce(F.size("children"), F.lit(0)) == 0),
        "variant-value-inconsistency": is_set & F.array_contains(forms, "short") & F.array_contains(forms, "full"),
        "mixed-naming-convention": is_set & (F.size(F.array_distinct(F.transform(variants, lambda d: _convention(d["key"])))) > 1),
        "incomplete-variant-matrix": is_set & c("children").isNotNull() & (F.size(dimensions) > 0) & (F.size(members) < product),
        "undefined-variant-values": is_set & undefined,
        "orphan-variant-definitions": is_set & c("children").isNotNull() & orphan,
        "undefined-variant-property": is_set & unknown,
        "variant-value-case-mismatch": is_set & other_case,
        "duplicate-property-name": F.size(F.array_distinct(_lower(keys))) < F.size(keys),
        "published": c("published"),
        "deprecated": about.rlike(DEPRECATED[0]) | name.rlike(DEPRECATED[1]),
        "missing-description": c("listed") & (F.trim(about) == ""),
        "slot-component": name.rlike(SLOT),
        "reserved-property-name": F.size(F.array_intersect(_lower(keys), F.array(*[F.lit(r) for r in RESERVED]))) > 0,
        "numeric-variant-values": is_set & any_options(lambda o: (numbers(o) >= 2) & (numbers(o) * 2 >= F.size(o))),
        "nested-component-set": is_set & c("set_id").isNotNull(),
        "semantic-state-variants": is_set & any_options(lambda o: _two_of(o, STATES)),
        "semantic-hierarchy-variants": is_set & any_options(lambda o: _two_of(o, LEVELS)),
        "special-char-variant-values": is_set & any_options(lambda o: F.exists(o, lambda x: x.rlike(SPECIAL))),
        "single-variant": is_set & single,
        "boolean-variant-antipattern": is_set & any_options(lambda o: (F.size(o) == 2) & _two_of(o, SWITCHES)),
        "excessive-variants": is_set & (F.size(variants) > MOST_DIMENSIONS),
        "inconsistent-boolean-naming": F.size(F.array_distinct(F.transform(switches, lambda d: _switch_form(F.lower(d["key"]))))) > 1,
        "uses-variables": c("bound") > 0,
        "exposes-nested-properties": F.exists(keys, lambda k: k.contains("#")),
        "size-progression": is_set & ordered,
        "unordered-size-variants": is_set & ~ordered,
    }
    told = {
        "default-variant:": F.when(is_set & (defaults != ""), defaults),
        "component-key:": c("key"),
        "parent-component-set:": F.when(~is_set, c("set_id")),
        "hierarchy:": F.array_join("hierarchy", "/"),
        "variant-complexity:": F.when(is_set & (F.size(dimensions) > 0) & (product > 0), product.cast("string")),
        "depth:": F.when(depth > SHALLOW, depth.cast("string")),
        "visibility-toggles:": F.when(toggles > 0, toggles.cast("string")),
        "containing-frame:": F.when(depth >= 2, F.nullif(F.get("hierarchy", depth - 2), F.lit(""))),
    }
    each = F.transform(F.when(is_set, dimensions).otherwise(F.filter(dimensions, lambda d: F.lit(False))), lambda d: F.concat(F.lit("variant-dimension:"), d["key"], F.lit("["), F.size(d["options"]), F.lit("]")))
    one = [F.when(F.coalesce(test, F.lit(False)), F.lit(tag)) for tag, test in plain.items()] + [F.concat(F.lit(tag), value) for tag, value in told.items()]
    all_ = F.concat(F.filter(F.array(*one), lambda t: t.isNotNull()), each)
    return found.withColumn("_said", F.coalesce(said, F.array().cast("array<struct<key: string, value: string>>"))).select("path", "id", F.explode(all_).alias("tag"))
