"""Classes in markup and code: arbitrary values by ordered claims, variants of class helpers, semantic tokens, block-element-modifier names.

Files are (path, content). What needs offsets or balanced literals is found in Python file by file; the rest are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.sources import files as files_
from chromatid.sources import literals

# What a utility's arbitrary value sets, in the order in which the forms claim what they find: (kind, utilities, value, form). The value of a color must
# be one; lengths are numbers of px, rem or em. Forms: a bracket, one that names the type (``color:``), a parenthesis around a variable, a property of its own.
_COLORED = "text bg border fill stroke from via to accent caret decoration shadow"
_SPACED = "p px py pt pr pb pl ps pe m mx my mt mr mb ml ms me gap gap-x gap-y space-x space-y inset inset-x inset-y top right bottom left start end"
_SCROLLED = "scroll-m scroll-mx scroll-my scroll-mt scroll-mr scroll-mb scroll-ml scroll-p scroll-px scroll-py scroll-pt scroll-pr scroll-pb scroll-pl"
_SIZED = "w h min-w max-w min-h max-h size"
_COLOR = r"#[0-9a-fA-F]{3,8}(?=\])|(?:rgba?|hsla?|color)\s*\([^\]]*"
_LENGTH, _NUMBER, _ANY = r"\d+(?:\.\d+)?(?:px|rem|em)", r"\d+(?:\.\d+)?(?:px|rem|em)?", r"[^\]]+"
CLAIMS = [
    ("color", _COLORED, _COLOR, "bracket"),
    ("color", _COLORED, _ANY, "typed"),
    ("size", _SIZED, "", "variable"),
    ("spacing", _SPACED, "", "variable"),
    ("css-property", _COLORED, "", "variable"),
    ("spacing", f"{_SPACED} {_SCROLLED}", _ANY, "bracket"),
    ("size", _SIZED, _ANY, "bracket"),
    ("size", "text", _LENGTH, "bracket"),
    ("grid", "grid-cols grid-rows cols rows auto-cols auto-rows", _ANY, "bracket"),
    ("timing", "duration delay transition ease", _ANY, "bracket"),
    ("other", "drop-shadow", _ANY, "bracket"),
    ("border", "rounded rounded-t rounded-r rounded-b rounded-l rounded-tl rounded-tr rounded-bl rounded-br rounded-s rounded-e rounded-ss rounded-se rounded-es rounded-ee", _ANY, "bracket"),
    ("border", "ring", _NUMBER, "bracket"),
    ("border", "divide-x divide-y", _ANY, "bracket"),
    ("border", "outline outline-offset", _NUMBER, "bracket"),
    ("border", "border border-t border-r border-b border-l border-x border-y border-s border-e", _LENGTH, "bracket"),
    ("layout", "aspect", _ANY, "bracket"),
    ("layout", "z basis grow shrink order columns", _ANY, "bracket"),
    ("transform", "translate-x translate-y rotate scale scale-x scale-y skew-x skew-y origin", _ANY, "bracket"),
    ("filter", "blur brightness contrast saturate hue-rotate invert sepia grayscale", _ANY, "bracket"),
    (
        "filter",
        "backdrop-blur backdrop-brightness backdrop-contrast backdrop-saturate backdrop-hue-rotate backdrop-invert backdrop-sepia backdrop-grayscale backdrop-opacity",
        _ANY,
        "bracket",
    ),
    ("visual", "opacity", _ANY, "bracket"),
    ("typography", "leading tracking", _ANY, "bracket"),
    ("typography", "font", r"\d+", "bracket"),
    ("typography", "line-clamp", _ANY, "bracket"),
    ("visual", "shadow", r"\d[^\]]+", "bracket"),
    ("other", "content", r"'[^']*'|\"[^\"]*\"|[^\]]+", "bracket"),
    ("border", "stroke", _LENGTH, "bracket"),
    ("other", "will-change list", _ANY, "bracket"),
    ("layout", "object", _ANY, "bracket"),
    ("other", "cursor", _ANY, "bracket"),
    ("typography", "underline-offset indent", _ANY, "bracket"),
    ("css-property", "", r"-{0,2}[\w-]+:[^\]]+", "property"),
]
# What may stand before a utility, and the utilities that take a minus.
_MODIFIERS = r"(?:(?:@(?:min|max)-\[[^\]]+\]|@[a-z]+|[a-z0-9-]+|has-\[[^\]]+\]|\[&[^\]]+\]):)*"
_NEGATIVE = frozenset("z basis grow shrink order columns translate-x translate-y rotate scale scale-x scale-y skew-x skew-y origin".split())
# Names of semantic color tokens, and utilities that take them.
SEMANTIC_NAMES = (
    "background foreground card card-foreground popover popover-foreground primary primary-foreground secondary secondary-foreground muted muted-foreground accent accent-foreground"
    " destructive destructive-foreground border input ring sidebar sidebar-foreground sidebar-primary sidebar-primary-foreground sidebar-accent sidebar-accent-foreground sidebar-border"
    " sidebar-ring chart-1 chart-2 chart-3 chart-4 chart-5"
).split()
_TOKEN_UTILITIES = "bg|text|border|ring|outline|shadow|accent|fill|stroke|caret|decoration|divide|placeholder"
# Words that begin a modifier in names of blocks and elements.
MODIFIER_WORDS = "variant|size|orientation|state|color|theme|mode|layout"


def _pattern(utilities: str, value: str, form: str) -> re.Pattern:
    names = "|".join(rf"{'-?' if u in _NEGATIVE else ''}{re.escape(u)}" for u in utilities.split())
    inner = {"bracket": rf"\[({value})\](?:/\d+)?", "typed": rf"\[color:({value})\]", "variable": r"\((--[\w-]+)\)"}.get(form)
    # A form begins where no other word is under way, so none finds the end of another's utility.
    return re.compile(rf"(?<![\w\-\[])({_MODIFIERS}(?:{names})-{inner})" if inner else rf"(\[({value})\])(?!:)")


def claimed(line: str, claims: list[tuple[str, re.Pattern]]) -> list[tuple[int, str, str, str]]:
    """(offset, text, value, kind) of what the forms claim in a line, in its order: earlier forms go first, and nothing that overlaps a claim is claimed again."""
    taken = []
    for kind, pattern in claims:
        for m in pattern.finditer(line):
            low, high = m.span()
            if not any(a < high and low < b for a, b, *_ in taken):
                taken.append((low, high, m[1], m[2], kind))
    return [(low, text, value, kind) for low, _, text, value, kind in sorted(taken)]


def arbitrary_claims(files: DataFrame) -> DataFrame:
    """(path, line, col, full_class, value, kind) of every arbitrary value in a file: where several forms fit, the first claims it, and a class of no form isn't listed."""
    claims = [(kind, _pattern(utilities, value, form)) for kind, utilities, value, form in CLAIMS]

    def parse(path: str, content: str) -> Iterator[tuple]:
        for n, line in enumerate(content.split("\n")):
            if "[" in line or "(--" in line:
                for low, text, value, kind in claimed(line, claims):
                    yield n + 1, low + 1, text, value, kind

    found, _ = files_.scan(files.where(F.col("content").rlike(r"\[|\(--")), parse, "line int, col int, full_class string, value string, kind string")
    return found


def semantic_token(name: Column) -> Column:
    """The semantic token that a class sets a color by (``hover:bg-primary/90``: primary), or null."""
    bare = F.regexp_replace(name, r"^(?:[\w-]+:)+", "")
    token = F.regexp_extract(bare, rf"^(?:{_TOKEN_UTILITIES})-(.+?)(?:/[\d.]+)?$", 1)
    base = F.regexp_replace(token, "-foreground$", "")
    known = token.isin(SEMANTIC_NAMES) | (token.endswith("-foreground") & (base.isin(SEMANTIC_NAMES) | token.rlike(r"^[a-z]+(?:-[a-z]+)*$")))
    return F.when(known, token)


def _classes(text: Column | str) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda c: c != "")


_DEFINED = ["path", "name", "line"]


_IS_OPTION = "literal AND argument = 1 AND keys[0] = 'variants' AND size(keys) BETWEEN 3 AND 4"
_IS_DEFAULT = "literal AND argument = 1 AND keys[0] = 'defaultVariants' AND size(keys) = 2"
_IS_BASE = "literal AND argument = 0"


def variant_options(leaves: DataFrame) -> DataFrame:
    """(path, name, line, axis, option, classes) of the variants in literals.call_leaves(): ``variants: {axis: {option: "classes"}}``, in strings or lists of them."""
    of = leaves.where(_IS_OPTION)
    of = of.groupBy(*_DEFINED, F.col("keys")[1].alias("axis"), F.col("keys")[2].alias("option")).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("parts"))
    return of.select(*_DEFINED, "axis", "option", _classes(F.array_join(F.transform("parts", lambda p: p["value"]), " ")).alias("classes"))


def variant_defaults(leaves: DataFrame) -> DataFrame:
    """(path, name, line, axis, option) of ``defaultVariants``."""
    return leaves.where(_IS_DEFAULT).select(*_DEFINED, F.col("keys")[1].alias("axis"), F.col("value").alias("option"))


def variant_definitions(leaves: DataFrame) -> DataFrame:
    """(path, name, line, base, axes, options, defaults, tokens) of every definition: its base classes, counts, and the semantic tokens of all its classes.

    One grouping, so that files are read once.
    """
    is_option, is_base = F.expr(_IS_OPTION), F.expr(_IS_BASE)
    option = F.struct(F.get("keys", F.lit(1)).alias("axis"), F.get("keys", F.lit(2)).alias("option"))
    of = leaves.groupBy(*_DEFINED).agg(
        F.count_if(F.col("argument").isNull()).alias("n"), F.array_sort(F.collect_list(F.when(is_base, F.struct("seq", "value")))).alias("parts"), F.collect_set(F.when(is_option, option)).alias("said"),
        F.collect_list(F.when(is_option, F.col("value"))).alias("values"), F.count_if(F.coalesce(F.expr(_IS_DEFAULT), F.lit(False))).alias("defaults"),
    )
    of = of.where("n > 0").withColumn("base", _classes(F.array_join(F.transform("parts", lambda p: p["value"]), " ")))
    tokens = F.transform(F.concat("base", _classes(F.array_join("values", " "))), semantic_token)
    axes = F.size(F.array_distinct(F.transform("said", lambda o: o["axis"]))).cast("long")
    return of.select(
        *_DEFINED, "base", F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull()))).alias("tokens"), axes.alias("axes"), F.size("said").cast("long").alias("options"), "defaults",
        F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_of"),
    ).drop("_of")


def definition_tokens(leaves: DataFrame) -> DataFrame:
    """(token, definitions, uses) over all definitions."""
    tokens = leaves.where(f"({_IS_OPTION}) OR ({_IS_BASE})").select(*_DEFINED, F.explode(_classes("value")).alias("class"))
    tokens = tokens.select(*_DEFINED, semantic_token(F.col("class")).alias("token")).where("token is not null")
    per = tokens.groupBy(*_DEFINED, "token").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.count(F.lit(1)).alias("definitions"), F.sum("n").alias("uses"))


# Words that name an element of a block.
ELEMENT_WORDS = (
    "header|footer|content|title|description|body|overlay|trigger|action|cancel|media|list|item|separator|group|text|portal|panel|panels|indicator|input|label|message|icon"
)


def prefixed_classes(files: DataFrame, prefix: str) -> DataFrame:
    """(path, class, line, n, block, element, modifier, component) of classes like ``prefix-block-element-modifier`` in files, by lower case and the first line.

    A modifier begins at the first of its words; before it, all but the last part are the block. Without one, the last word for an element begins the element.
    """
    # What repeats a group keeps what it took (``*+``): going back could find nothing else, and without it every repeat is a call on the task's stack, which a long class overflows.
    names = [rf"(?i)\b({re.escape(prefix)}-[a-z][a-z0-9]*+(?:-[a-z0-9]++)*+)(?=[:\s\"'`]|$)", rf"(?i)\b({re.escape(prefix)}-[a-z][a-z0-9-]*-)(?=:)"]
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).where(F.contains(F.lower("text"), F.lit(f"{prefix.lower()}-")))
    found = F.concat(*[F.regexp_extract_all("text", F.lit(n), F.lit(1)) for n in names])
    rows = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.transform(found, F.lower)).alias("class"))
    rows = rows.groupBy("path", "class").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    body = F.substr(F.col("class"), F.lit(len(prefix) + 2))
    with_modifier = rf"^(?:(.+?)-)??((?:{MODIFIER_WORDS})(?:-.*)?)$"
    before, with_element = F.regexp_extract(body, with_modifier, 1), rf"^(.+)-((?:{ELEMENT_WORDS})(?:-[^-]++)*+)$"
    modified = body.rlike(with_modifier)
    block = F.when(modified & before.contains("-"), F.regexp_extract(before, "^(.*)-", 1)).when(modified, before).when(body.rlike(with_element), F.regexp_extract(body, with_element, 1))
    element = F.when(modified & before.contains("-"), F.substring_index(before, "-", -1)).when(~modified & body.rlike(with_element), F.regexp_extract(body, with_element, 2))
    rows = rows.select("path", "class", "line", "n", F.coalesce(block, body).alias("block"), element.alias("element"), F.when(modified, F.regexp_extract(body, with_modifier, 2)).alias("modifier"))
    return rows.withColumn("component", F.when(F.col("block") != "", F.col("block")).otherwise(F.substring_index(F.substr(F.col("class"), F.lit(len(prefix) + 2)), "-", 1)))


def class_tree(classes: DataFrame) -> DataFrame:
    """(level, block, element, modifier, classes, files, n): the tree of prefixed classes rolled up by block, element and modifier; '' where a class has none, null above."""
    rows = classes.select("path", "class", "n", "block", F.coalesce("element", F.lit("")).alias("element"), F.coalesce("modifier", F.lit("")).alias("modifier"))
    tree = rows.rollup("block", "element", "modifier")
    tree = tree.agg(F.grouping_id().alias("above"), F.countDistinct("class").alias("classes"), F.countDistinct("path").alias("files"), F.sum("n").alias("n"))
    level = F.element_at(F.create_map(*[F.lit(x) for pair in ((7, "all"), (3, "block"), (1, "element"), (0, "modifier")) for x in pair]), F.col("above").cast("int"))
    return tree.select(level.alias("level"), "block", "element", "modifier", "classes", "files", "n")


# Helpers around dynamic classes by the context that they give, and states that short forms name.
_CONTEXTS = {"clsx": "clsx", "cx": "cx", "classnames": "classnames", "classNames": "classnames", "cn": "classnames", "twMerge": "classnames"}
_RENDERERS = ["classNames", "cn", "clsx", "cx", "twMerge"]
UI_STATES = "open checked selected active disabled focus-visible"
DATA_STATES = (
    "open closed active selected highlighted checked unchecked disabled enabled focused pressed expanded collapsed enter leave side align invalid valid indeterminate"
)
ARIA_STATES = (
    "expanded hidden pressed checked disabled readonly required selected invalid busy grabbed current live atomic relevant sort haspopup multiselectable orientation"
)
_TARGET = r"(!?[a-zA-Z][\w/.-]*)"


def _words(names: str) -> str:
    return "|".join(sorted(names.split(), key=len, reverse=True))


# Forms of classes that depend on what is around them: (form, pattern, groups of kind, name, value and what is set).
SELECTOR_FORMS = [
    ("data", r"((?<!\*)\*:data-|group-has-data-|group-data-|has-data-|(?<![\w-])(?<!\*:)data-)\[([a-zA-Z][\w-]*)(?:=([^\]]+))?\](?:/([a-zA-Z][\w-]*))?:", (1, 2, 3, 4)),
    ("headless", rf"\b(ui)-((?:not-)?(?:{_words(UI_STATES)})):{_TARGET}", (1, 2, 0, 3)),
    ("named", r"(?<![\w-])(group|peer|@container)/([a-zA-Z][\w-]*)", (1, 2, 0, 0)),
    ("named-state", rf"\b(group|peer)-([a-zA-Z]\w*)/([a-zA-Z][\w-]*)(?::{_TARGET})?", (1, 3, 2, 4)),
    ("container", rf"@((?!container)[a-z]+)/([a-zA-Z][\w-]*)(?::{_TARGET})?", (1, 2, 0, 3)),
    ("slot", r"(?i)data-slot\s*=\s*[\"']([a-z][a-z0-9-]*)[\"']", (0, 1, 0, 0)),
    ("data-short", rf"(?<![\w-])((?:group-|peer-)?data-)({_words(DATA_STATES)}):([\w/-]+(?:\[[^\]]+\])?)", (1, 2, 0, 3)),
    ("data-dynamic", r"data-([a-zA-Z][\w-]*)\s*=\s*\{([^}]+)\}", (0, 1, 2, 0)),
    ("child", rf"\[&([_>+~])([a-zA-Z*][\w*:-]*)\](?::[\w-]+)*:{_TARGET}", (1, 2, 0, 3)),
    ("child-attribute", rf"\[&_(\[[^\]]+\])\](?::[\w-]+)*:{_TARGET}", (0, 1, 0, 2)),
    ("parent", rf"\[\.([a-zA-Z][\w-]*)\]:{_TARGET}", (0, 1, 0, 2)),
    ("aria", rf"(?i)(?:([a-z]+):)?((?:has-|group-|peer-)?aria)-({_words(ARIA_STATES)})(?:=[^:\s]+)?:{_TARGET}", (2, 3, 1, 4)),
    ("wildcard", rf"(?<!\*)(\*\*?):data-\[([a-zA-Z][\w-]*)(?:=([^\]]+))?\]:{_TARGET}", (1, 2, 3, 4)),
    ("wildcard-within", rf"data-\[[^\]]+\]:(\*):(\[[^\]]+\]):{_TARGET}", (1, 2, 0, 3)),
]


def selector_classes(files: DataFrame) -> DataFrame:
    """(path, line, form, kind, name, value, target) of classes that depend on attributes, states, groups, children, parents or anything within; '' for what a form doesn't say.

    Forms are looked for one by one, so a class that is of two (``*:data-[open]:p-1`` is a wildcard on data) is listed under both; equal ones of a line once.
    """
    lines = files_.spread(files.select("path", "content")).select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")
    said = ("kind", "name", "value", "target")

    def of_form(form: str, pattern: str, groups: tuple[int, ...]) -> Column:
        given = [n for n, g in zip(said, groups, strict=True) if g]
        zipped = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for n, g in zip(said, groups, strict=True) if g])
        parts = lambda x: F.struct(F.lit(form).alias("form"), *[(F.coalesce(x[n], F.lit("")) if n in given else F.lit("")).alias(n) for n in said])
        return F.transform(zipped, parts)

    found = [of_form(*f) for f in SELECTOR_FORMS]
    return lines.select("path", "line", F.explode(F.array_distinct(F.concat(*found))).alias("f")).select("path", "line", "f.*")


_CLASS_CODE = re.compile(r"\bclass(?:Name)?\s*=\s*\{")
_HELPER = re.compile(rf"\s*({'|'.join(_CONTEXTS)})\s*\(")
_PLAIN = re.compile(r"""//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`""", re.S)


def _templates(text: str, at: int, end: int) -> Iterator[tuple[int, list[str], list[str]]]:
    """(offset, static parts, variables) of the template literals between two places, outer ones whole."""
    while (m := _PLAIN.search(text, at)) and m.start() < end:
        at = m.end()
        if m[0] != "`":
            continue
        reader = literals.Reader(text, at)
        reader.at = start = at
        parts, holes, low = [], [], start
        while mark := literals._HOLE.search(text, reader.at):
            if mark[0] == "`":
                break
            reader.at = mark.end()
            if mark[0] == "${":
                parts.append(text[low : mark.start()])
                inner = reader.at
                reader.code()
                holes.append(text[inner : reader.at].strip())
                reader.at += 1
                low = reader.at
        if mark is None:
            return
        yield start - 1, [*parts, text[low : mark.start()]], holes
        at = mark.end()


def dynamic_forms(files: DataFrame) -> DataFrame:
    """(path, line, context, structure, variables, parts) of template literals with something filled in, in class attributes that are code, over any number of lines.

    context is template-literal, or the helper that the attribute calls (clsx, cx, else classnames), or else conditional where the code chooses; structure has names in braces
    for what is filled in.
    """

    def parse(path: str, content: str) -> Iterator[tuple]:
        for m in _CLASS_CODE.finditer(content):
            reader = literals.Reader(content, m.end())
            try:
                while not reader.sees("}"):
                    reader.code()
                    if not reader.takes(",") and not reader.sees("}"):
                        raise ValueError("open attribute")
            except ValueError:
                continue
            end, code = reader.at, content[m.end() : reader.at]
            helper = _HELPER.match(code)
            bare = _PLAIN.sub("", re.sub(r"`(?:\\.|[^`\\])*`", "", code))
            context = _CONTEXTS[helper[1]] if helper else "conditional" if "?" in bare or "&&" in bare else "template-literal"
            for at, parts, holes in _templates(content, m.end(), end):
                if holes:
                    structure = "".join(p + f"{{{h}}}" for p, h in zip(parts, holes, strict=False)) + parts[-1]
                    yield content.count("\n", 0, at) + 1, context, structure, list(dict.fromkeys(holes)), [p for p in parts if p.strip()]

    found, _ = files_.scan(files.where(F.col("content").contains("${")), parse, "line int, context string, structure string, variables array<string>, parts array<string>")
    return found


_RENDERED = re.compile(rf"\bclassName\s*=\s*\{{\s*\(\s*\{{([^}}]+)\}}\s*\)\s*=>\s*({'|'.join(_RENDERERS)})\s*\(")
_QUOTED = r"""["'`]([^"'`]*)["'`]"""


def render_props(files: DataFrame) -> DataFrame:
    """(path, line, helper, parameters, condition, branch, class) of class attributes that are functions of render props: each class with the parameter that it hangs on.

    branch is static, or true or false of ``p ? "a" : "b"`` and ``p && "a"``; conditions that aren't a parameter by itself leave their classes static.
    """

    def parse(path: str, content: str) -> Iterator[tuple]:
        for m in _RENDERED.finditer(content):
            line = content.count("\n", 0, m.start()) + 1
            names = [p.strip() for p in m[1].split(",") if p.strip()]
            try:
                reader = literals.Reader(content, m.end())
                while not reader.sees(")"):
                    reader.code()
                    if not reader.takes(",") and not reader.sees(")"):
                        raise ValueError("open call")
            except ValueError:
                continue
            body, rows = content[m.end() : reader.at], []
            for name in names:
                for form, branches in ((rf"(?<![\w.!]){re.escape(name)}\s*\?\s*{_QUOTED}\s*:\s*{_QUOTED}", ("true", "false")), (rf"(?<![\w.!]){re.escape(name)}\s*&&\s*{_QUOTED}", ("true",))):
                    for hit in re.finditer(form, body):
                        for k, branch in enumerate(branches):
                            rows += [(name, branch, c) for c in hit[k + 1].split()]
                    body = re.sub(form, "", body)
            rows += [(None, "static", c) for text in re.findall(_QUOTED, body) for c in text.split()]
            for condition, branch, name in rows:
                yield line, m[2], names, condition, branch, name

    found, _ = files_.scan(files.where(F.col("content").contains("=>")), parse, "line int, helper string, parameters array<string>, condition string, branch string, class string")
    return found
