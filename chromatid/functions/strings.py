"""Names, classes and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that make a name a component of its own, not a version of another.
SEMANTIC_SUFFIXES = (
    "group list item items container wrapper provider context header footer body content section sidebar panel trigger target overlay portal root slot action actions icon"
    " label text title description separator divider small large mini skeleton placeholder loading error empty input field control message helper hint link menu submenu"
    " tab tabs cell row column columns head view"
).split()
# Suffixes of versions.
VERSION_SUFFIXES = (
    r"New|Old|V\d+|Legacy|Updated|Deprecated|Beta|Alpha|Experimental|Next|Previous|Original|Backup|Copy|Clone|Alt|Alternative|Temp|Temporary|WIP|Draft"
)
# Utility families whose values collapse in tight matching.
SHADOW_SIZES, ROUNDED_SIZES = "none sm md lg xl 2xl", "none sm md lg xl 2xl 3xl full"
TEXT_SIZES = "xs sm base lg xl 2xl 3xl 4xl 5xl 6xl 7xl 8xl 9xl"
SPACED_FAMILIES = "gap p px py pt pr pb pl m mx my mt mr mb ml"
# Words of interactive components.
INTERACTIVE = "button link input select checkbox radio"


def _alternatives(words: str) -> str:
    return "|".join(words.split())


def tight_families() -> list[tuple[str, str]]:
    """(family, pattern) of the utility classes that differ by a value only."""
    sized = [("shadow", SHADOW_SIZES), ("rounded", ROUNDED_SIZES)]
    return (
        [(f, rf"^{f}(-({_alternatives(s)}))?$") for f, s in sized]
        + [(f, rf"^{f}-(\d+|px)$") for f in SPACED_FAMILIES.split()]
        + [("text", rf"^text-({_alternatives(TEXT_SIZES)})$")]
    )


def component_key(name: Column) -> Column:
    """Component name for matching: lower case, without - _ and white space, without a trailing ``component``."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[-_\s]", ""), "component$", "")


def token_key(name: Column) -> Column:
    """Token name for matching: lower case, without - _ . and white space."""
    return F.regexp_replace(F.lower(name), r"[-_\s.]", "")


def dotted_name(name: Column) -> Column:
    """Token name with . for each of . - _, in lower case."""
    return F.translate(F.lower(name), "-_", "..")


def alphanumeric_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def comparison_key(name: Column) -> Column:
    """Without an I/Abstract/Base prefix before a capital, and without a Component/View/Container/Wrapper suffix; lower case without - and _."""
    bare = F.regexp_replace(F.regexp_replace(name, "^(I|Abstract|Base)(?=[A-Z])", ""), "(Component|View|Container|Wrapper)$", "")
    return F.regexp_replace(F.lower(bare), "[-_]", "")


def naming_pattern(name: Column) -> Column:
    """PascalCase, camelCase, kebab-case, snake_case or other; one word in lower case is camelCase."""
    return (
        F.when(name.rlike("^[A-Z][a-zA-Z0-9]*$"), "PascalCase")
        .when(name.rlike("^[a-z][a-zA-Z0-9]*$"), "camelCase")
        .when(name.rlike("^[a-z][a-z0-9-]*$"), "kebab-case")
        .when(name.rlike("^[a-z][a-z0-9_]*$"), "snake_case")
        .otherwise("other")
    )


def has_semantic_suffix(name: Column) -> Column:
    return F.lower(name).rlike(f"[a-z0-9]({'|'.join(SEMANTIC_SUFFIXES)})$")


def has_version_suffix(name: Column) -> Column:
    return ~has_semantic_suffix(name) & name.rlike(f"(?i)({VERSION_SUFFIXES})$")


def base_name(name: Column) -> Column:
    """The name that versions share: itself if it has a semantic suffix, else without its version suffix and digits; lower case."""
    bare = F.regexp_replace(F.regexp_replace(name, f"(?i)({VERSION_SUFFIXES})$", ""), r"\d+$", "")
    return F.when(has_semantic_suffix(name), F.lower(name)).otherwise(F.lower(bare))


def class_list(classes: Column) -> Column:
    return F.filter(F.split(F.trim(classes), r"\s+"), lambda c: c != "")


def class_pattern(classes: Column) -> Column:
    """The classes, sorted."""
    return F.array_join(F.array_sort(class_list(classes)), " ")


def tight_class_pattern(classes: Column) -> Column:
    """As class_pattern, with ``{family}`` for each class of a family."""

    def collapse(c: Column) -> Column:
        out = None
        for family, pattern in tight_families():
            value = F.lit("{" + family + "}")
            out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
        return out.otherwise(c)

    return F.array_join(F.array_sort(F.transform(class_list(classes), collapse)), " ")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def is_interactive(name: Column) -> Column:
    return F.lower(name).rlike(_alternatives(INTERACTIVE))


def is_token_reference(value: Column) -> Column:
    """Whether a value refers to a token: it begins with var(, $, theme. or --, or contains ``token``."""
    return value.rlike(r"^(var\(|\$|theme\.|--)") | F.lower(value).contains("token")


def css_variable(token: Column) -> Column:
    """The CSS variable of a token name: itself if it begins with --, else kebab case."""
    kebab = F.lower(F.regexp_replace(F.replace(token, F.lit("."), F.lit("-")), "([a-z])([A-Z])", "$1-$2"))
    return F.when(token.startswith("--"), token).otherwise(F.concat(F.lit("--"), kebab))


def location_parts(location: Column) -> Column:
    """struct(file, line, column) of ``file:line[:column]``; nulls where it doesn't have that form."""
    pattern = r"^(.+?):(\d+)(?::(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(location, pattern, i), F.lit(""))
    return F.struct(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("column"))


def package_name(source: Column) -> Column:
    """The package of an import: two segments if it is scoped, else one."""
    return F.when(source.startswith("@"), F.substring_index(source, "/", 2)).otherwise(F.substring_index(source, "/", 1))


def glob_regex(glob: str, escape: bool = False) -> str:
    """An anchored regular expression: ** is anything, * anything but /. Without escape, other characters keep their regex meaning."""
    import re

    parts = re.split(r"(\*\*|\*)", glob)
    text = {"**": ".*", "*": "[^/]*"}
    return "^" + "".join(text.get(p) or (re.escape(p) if escape else p) for p in parts) + "$"


def name_match_score(name: Column, wanted: Column) -> Column:
    """Search score: 100 equal; 70 + 50 * length share if one contains the other; 50 + 30 * share of words found; else 0."""
    a, b = F.lower(name), F.lower(wanted)
    words = F.filter(F.split(b, r"[\s\-_]+"), lambda w: w != "")
    found = F.size(F.filter(words, lambda w: F.contains(a, w)))
    share = F.least(F.char_length(a), F.char_length(b)) / F.greatest(F.char_length(a), F.char_length(b))
    return (
        F.when(a == b, F.lit(100.0))
        .when(F.contains(a, b) | F.contains(b, a), 70 + 50 * share)
        .when(found > 0, 50 + 30 * found / F.size(words))
        .otherwise(F.lit(0.0))
    )


# Style properties whose values should be tokens, in kebab case, by what they set.
TOKEN_PROPERTIES = {
    "color": (
        "color", "background-color", "background", "border-color", "fill", "stroke", "outline-color", "text-decoration-color", "caret-color", "accent-color",
    ),
    "spacing": (
        "padding", "padding-top", "padding-right", "padding-bottom", "padding-left", "margin", "margin-top", "margin-right", "margin-bottom", "margin-left", "gap", "row-gap",
        "column-gap", "width", "height", "min-width", "min-height", "max-width", "max-height", "top", "right", "bottom", "left", "inset",
    ),
    "fontSize": ("font-size",),
}
# How hard-coded values of these kinds look.
TOKEN_VALUES = {"color": r"^(#[0-9a-fA-F]{3,8}|rgba?\(|hsla?\(|oklch\()", "spacing": r"^\d+(\.\d+)?(px|rem|em)$", "fontSize": r"^\d+(\.\d+)?(px|rem|em|pt)$"}
# What the beginning of a generated file says, and how much of it is looked at.
GENERATED, GENERATED_HEAD = r"(?i:auto-generated|auto generated|do not edit|this file is generated|generated by|generated file)|@generated", 500
# Ends of files that a check looks at.
SCANNABLE = (".tsx", ".jsx", ".ts", ".js", ".vue", ".svelte", ".component.ts", ".blade.php", ".erb", ".twig", ".njk", ".html", ".css", ".scss", ".json")
# Folders that hold variants of components, the first that fits counts.
VARIANT_FOLDERS = (
    r"registry/([^/]+)/ui/", r"registry/([^/]+)/components/", r"registry/([^/]+)/blocks/", r"themes?/([^/]+)/", r"styles?/([^/]+)/", r"variants?/([^/]+)/", r"platforms?/([^/]+)/",
    r"brands?/([^/]+)/",
)


def hardcoded_type(prop: Column, value: Column) -> Column:
    """color, spacing or fontSize where a style property (in kebab or camel case) has a value that should be a token; else null."""
    plain = F.replace(F.lower(prop), F.lit("-"), F.lit(""))
    out = F.when(is_token_reference(value), F.lit(None).cast("string"))
    for kind, names in TOKEN_PROPERTIES.items():
        camel = [n.split("-")[0] + "".join(w.capitalize() for w in n.split("-")[1:]) for n in names]
        out = out.when((prop.isin([*names, *camel]) | plain.isin(list(names))) & value.rlike(TOKEN_VALUES[kind]), kind)
    return out


def ignore_marked(text: Column, tool: str) -> Column:
    """Whether a text says that a tool is to ignore or disable something there: ``tool-ignore`` or ``tool-disable``."""
    return text.rlike(rf"(?i)\b{tool}-(ignore|disable)")


def is_generated(content: Column) -> Column:
    """Whether a file's first 500 characters say that it was generated."""
    return F.substring(content, 1, GENERATED_HEAD).rlike(GENERATED)


def is_scannable(path: Column) -> Column:
    return path.rlike("(" + "|".join(e.replace(".", r"\.") for e in SCANNABLE) + ")$")


def variant_name(path: Column) -> Column:
    """The variant that a component's path is in; null for none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in VARIANT_FOLDERS])


def hardcoded_value(actual: Column, message: Column) -> Column:
    """A signal's hard-coded value: what it says it found, else the first hex color, rgb color or px length of its message."""
    forms = (r"(#[0-9a-fA-F]{3,8})\b", r"(?i)(rgba?\s*\([^)]+\))", r"\b(\d+(?:\.\d+)?px)\b")
    return F.coalesce(F.nullif(actual, F.lit("")), *[F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in forms])


def dimension(text: Column) -> Column:
    """struct(value, unit) of a number with px, rem, em or no unit (px); 0 px for anything else."""
    pattern = r"^([\d.]+)(px|rem|em)?$"
    number = F.regexp_extract(F.regexp_extract(text, pattern, 1), r"^(\d*\.?\d*)", 1).try_cast("double")
    unit = F.coalesce(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.lit("px"))
    return F.struct(F.coalesce(number, F.lit(0.0)).alias("value"), unit.alias("unit"))
