"""Components in source text, found by regular expressions: names, props, dependencies, hooks, hard-coded styles.

The patterns see declarations, not types: what needs a language's own parser (inferred props, imported types) is out of their reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromatid.operators import fill
from chromatid.session import durable

# How component declarations look, by framework.
DECLARATIONS = {
    "react": r"(?m)^(?:export\s+)?(?:default\s+)?(?:function|const)\s+([A-Z][A-Za-z0-9]*)\b",
    "svelte": r"(?m)^\s*export\s+let\s+([a-zA-Z_$][\w$]*)",
    "angular": r"@Component\s*\([^)]*\)\s*(?:export\s+)?class\s+([A-Z]\w*)",
    "lit": r"@customElement\s*\(\s*['\"]([a-z][\w-]*)['\"]",
    "stencil": r"@Component\s*\(\s*\{[^}]*tag:\s*['\"]([a-z][\w-]*)['\"]",
}
# Attributes that aren't props.
RESERVED = ["key", "ref", "className", "style"]


def declared(files: DataFrame, framework: str) -> DataFrame:
    """(path, name, pos) of the components that files (path, content) declare."""
    if framework in ("vue", "svelte-file"):
        return files.select("path", F.regexp_extract("path", r"([^/]+)\.(?:vue|svelte)$", 1).alias("name"), F.lit(0).alias("pos")).where("name <> ''")
    found = F.regexp_extract_all("content", F.lit(DECLARATIONS[framework]), F.lit(1))
    return files.select("path", F.posexplode(F.array_distinct(found)).alias("pos", "name")).select("path", "name", "pos")


def dependencies(files: DataFrame) -> DataFrame:
    """(path, name, n): capitalized tags that files use."""
    return files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"<([A-Z][A-Za-z0-9.]*)"), F.lit(1))).alias("name")).groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"))


def jsx_props(files: DataFrame) -> DataFrame:
    """(path, component, prop) of props given to capitalized tags, but reserved ones; once each."""
    tag = r"<([A-Z][A-Za-z0-9.]*)((?:\s+[a-zA-Z-]+(?:=(?:\"[^\"]*\"|\{[^}]*\}))?)*)"
    parts = F.arrays_zip(F.regexp_extract_all("content", F.lit(tag), F.lit(1)).alias("c"), F.regexp_extract_all("content", F.lit(tag), F.lit(2)).alias("a"))
    rows = files.select("path", F.explode(parts).alias("x")).select("path", F.col("x.c").alias("component"), F.col("x.a").alias("attributes"))
    bare = F.regexp_replace("attributes", r"=(\"[^\"]*\"|\{[^}]*\})", "")
    names = F.array_except(F.filter(F.split(bare, r"\s+"), lambda a: a != ""), F.array(*[F.lit(r) for r in RESERVED]))
    return rows.select("path", "component", F.explode(names).alias("prop")).distinct()


def hooks(files: DataFrame) -> DataFrame:
    """(hook, n, files): calls of hooks."""
    h = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\b(use[A-Z]\w*)\s*\("), F.lit(1))).alias("hook"))
    return h.groupBy("hook", "path").agg(F.count(F.lit(1)).alias("n")).groupBy("hook").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))


def compounds(components: DataFrame) -> DataFrame:
    """(path, root, member) of components (path, name) of a file whose name begins with another's and goes on with a capital; roots are shortest, with two members at least."""
    c = components.select("path", "name").distinct()
    r, m = c.withColumnRenamed("name", "root"), c.withColumnRenamed("name", "member")
    within = F.col("member").startswith(F.col("root")) & (F.col("member") != F.col("root")) & F.expr("substr(member, char_length(root) + 1, 1) rlike '[A-Z]'")
    pairs = r.join(m, "path").where(within)
    shortest = pairs.withColumn("k", F.row_number().over(Window.partitionBy("path", "member").orderBy(F.char_length("root")))).where("k = 1").drop("k")
    n = shortest.groupBy("path", "root").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    return shortest.join(n, ["path", "root"])


def story_index(entries: DataFrame) -> DataFrame:
    """(key, id, stories) of story entries (id, title, name, type, seq): stories of one title are one component; docs entries don't count."""
    key = F.lower(F.replace("title", F.lit("/"), F.lit("-")))
    by = entries.where(F.coalesce(F.col("type"), F.lit("story")) != "docs").groupBy(key.alias("key"))
    return by.agg(F.min_by("id", "seq").alias("id"), F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("s")).select("key", "id", F.transform("s", lambda s: s["name"]).alias("stories"))


def inherit_props(components: DataFrame) -> DataFrame:
    """components (name, extends, props, seq) where one without props has those of the last one of the name it extends."""
    parent = components.where(F.size("props") > 0).groupBy("name").agg(F.max_by("props", "seq").alias("_p")).withColumnRenamed("name", "_n")
    out = components.join(parent, F.col("extends") == F.col("_n"), "left")
    return out.withColumn("props", F.when((F.size("props") == 0) & F.col("_p").isNotNull(), F.col("_p")).otherwise(F.col("props"))).drop("_p", "_n")


def inherit_in_order(components: DataFrame) -> DataFrame:
    """components (name, extends, props, seq) where one without props has those of the component it extends, over chains of any length.

    A name means the last component of it. A link counts if the one it leads to has props of its own, or comes earlier in the input and so has settled
    before: a chain written from its root downwards passes its props on, one written upwards only those of the next one. seq is unlike; extra columns stay.
    """
    last = components.groupBy("name").agg(F.max(F.struct("seq", (F.size("props") > 0).alias("has"))).alias("l")).select(F.col("name").alias("_n"), F.col("l.seq").alias("_to"), F.col("l.has").alias("_has"))
    linked = components.join(last, F.col("extends") == F.col("_n"), "left")
    counts = (F.size("props") == 0) & (F.col("_has") | (F.col("_to") < F.col("seq")))
    roots = fill.followed(linked.select(F.col("seq").alias("id"), F.when(counts, F.col("_to")).alias("next")))
    held = components.where(F.size("props") > 0).select(F.col("seq").alias("root"), F.col("props").alias("_props"))
    given = roots.join(held, "root").select(F.col("id").alias("_id"), "_props")
    out = components.join(given, F.col("seq") == F.col("_id"), "left")
    return out.withColumn("props", F.coalesce("_props", "props")).select(components.columns)


def _prefix_roots(names: DataFrame, within: str, prefixes: Column, sub: Column) -> DataFrame:
    """(within, name, root) of unlike names: the shortest one that has others below it (sub of name and root) and that the name is or begins with."""
    each = names.select(within, "name").distinct()
    above = each.select(within, "name", F.explode(prefixes).alias("root")).join(each.select(within, F.col("name").alias("root")), [within, "root"])
    having = above.where("name <> root").where(sub).select(within, "root").distinct()
    return above.join(having, [within, "root"]).groupBy(within, "name").agg(F.min_by("root", F.char_length("root")).alias("root"))


def compounds_by_rules(components: DataFrame) -> DataFrame:
    """(path, name, selector, seq, group, root, rule) of components (path, name, selector, seq): three rules claim members in turn, each seeing what is left.

    1. Selectors (the first of a list; of components that share one the last) below the shortest other selector that they begin with, a dash after it.
    2. Names within a file below the shortest name that they begin with and that some name goes on from with a capital.
    3. The same within a folder.

    Groups have two members at least. ``root`` says whether the component is the group's own; ``rule`` is null for what no rule claims, as for components without a
    selector. Prefixes are exploded and joined by equality, so no rule compares all pairs.
    """
    first = F.trim(F.split("selector", ",")[0])
    c = components.select("path", "name", "selector", "seq", F.when(first != "", first).alias("_s"))
    dashed = F.transform(F.sequence(F.lit(1), F.size(F.split("name", "-"))), lambda n: F.array_join(F.slice(F.split("name", "-"), 1, n), "-"))
    owner = c.where("_s is not null").groupBy("_s").agg(F.max("seq").alias("seq"))
    found = _prefix_roots(owner.select(F.lit(0).alias("all"), F.col("_s").alias("name")), "all", dashed, F.lit(True))
    found = owner.join(found.select(F.col("name").alias("_s"), F.col("root").alias("_r")), "_s")
    title = F.array_join(F.transform(F.split("_r", "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")
    claimed = found.select("seq", title.alias("group"), (F.col("_s") == F.col("_r")).alias("root"), F.lit("selector").alias("rule"))
    letters = F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda n: F.substr(F.col("name"), F.lit(1), n))
    capital = F.expr("substr(name, char_length(root) + 1, 1) rlike '^[A-Z]'")
    for rule, within in (("file", F.col("path")), ("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))):
        claimed = durable(claimed)
        left = c.where("_s is not null").join(claimed, "seq", "left_anti").withColumn("_within", within)
        found = left.join(_prefix_roots(left, "_within", letters, capital), ["_within", "name"]).select("_within", "seq", "name", "root")
        some = found.groupBy("_within", "root").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
        found = found.join(some, ["_within", "root"]).select("seq", F.col("root").alias("group"), (F.col("name") == F.col("root")).alias("root"), F.lit(rule).alias("rule"))
        claimed = claimed.union(found)
    out = c.join(durable(claimed), "seq", "left").select("path", "name", "selector", "seq", "group", F.coalesce("root", F.lit(False)).alias("root"), "rule")
    return out
