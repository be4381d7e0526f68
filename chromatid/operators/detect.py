"""Drift detectors: each gives signals (id, type, severity, entity_id, entity_name, location, message, detail).

They compose the joins and aggregates of the other modules; pipelines union them by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromatid.functions import colors, strings
from chromatid.operators import aggregate, match
from chromatid.schemas import default_severity


def signal(df: DataFrame, kind: str, entity_id: Column, entity_name: Column, message: Column, severity: Column | None = None, location: Column | None = None, detail: Column | None = None, suffix: Column | None = None) -> DataFrame:
    parts = [F.lit("drift"), F.lit(kind), entity_id.cast("string"), *([suffix.cast("string")] if suffix is not None else [])]
    return df.select(
        F.concat_ws(":", *parts).alias("id"), F.lit(kind).alias("type"), (severity if severity is not None else default_severity(F.lit(kind))).alias("severity"),
        entity_id.cast("string").alias("entity_id"), entity_name.alias("entity_name"), (location if location is not None else F.lit(None).cast("string")).alias("location"),
        message.alias("message"), (detail.cast("string") if detail is not None else F.lit(None).cast("string")).alias("detail"),
    )


def deprecated(components: DataFrame) -> DataFrame:
    """Components (id, name, deprecated, reason) marked deprecated."""
    c = components.where("deprecated")
    return signal(c, "deprecated-pattern", F.col("id"), F.col("name"), F.format_string('Component "%s" is marked as deprecated', "name"), detail=F.col("reason"))


def naming(components: DataFrame) -> DataFrame:
    o = aggregate.naming_outliers(components)
    text = F.format_string('Component "%s" uses %s but %d%% of components use %s', "name", "pattern", "percent", "dominant_pattern")
    return signal(o, "naming-inconsistency", F.col("id"), F.col("name"), text, detail=F.col("dominant_pattern"))


def prop_types(props: DataFrame) -> DataFrame:
    """Props (component, prop, type, seq) of another type than their name's dominant one."""
    c = aggregate.prop_type_conflicts(props)
    text = F.format_string('Prop "%s" in "%s" uses type "%s" but most use "%s"', "prop", F.col("component").cast("string"), "type", "dominant_type")
    return signal(c, "semantic-mismatch", F.col("component"), F.col("component").cast("string"), text, detail=F.col("dominant_type"), suffix=F.col("prop"))


def handlers(props: DataFrame) -> DataFrame:
    h = aggregate.handler_outliers(props)
    text = F.format_string('"%s" in "%s" - %d%% of click handlers use "%s..." pattern', "prop", F.col("component").cast("string"), "percent", "prefix")
    return signal(h, "naming-inconsistency", F.col("component"), F.col("component").cast("string"), text, detail=F.col("prefix"), suffix=F.col("prop"))


def accessibility(components: DataFrame) -> DataFrame:
    """One signal an issue of interactive components (id, name, props: names, issues) that have neither an aria label nor children."""
    labelled = F.exists("props", lambda p: F.lower(p).contains("arialabel") | F.lower(p).contains("aria-label") | (F.lower(p) == "children"))
    c = components.where(strings.is_interactive(F.col("name")) & ~labelled).withColumn("issue", F.explode("issues"))
    return signal(c, "accessibility-conflict", F.col("id"), F.col("name"), F.format_string('Component "%s": %s', "name", "issue"), detail=F.col("issue"))


def contrast(styles: DataFrame) -> DataFrame:
    p = match.contrast_pairs(styles)
    text = F.format_string("Contrast %.2f of %s on %s is too low", "ratio", "foreground", "background")
    pair = F.concat("foreground", F.lit("/"), "background")
    return signal(p, "color-contrast", F.col("component"), F.col("component").cast("string"), text, detail=F.round("ratio", 2), suffix=pair)


def hardcoded(values: DataFrame) -> DataFrame:
    """One signal a component and kind (colors; sizes) of hard-coded values (component, kind, value) that refer to no token."""
    v = values.where(~strings.is_token_reference(F.col("value"))).withColumn("group", F.when(F.col("kind") == "color", "color").otherwise("size"))
    by = v.groupBy("component", "group").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("value")).alias("values"))
    severity = F.when(F.col("group") == "color", "warning").otherwise("info")
    text = F.format_string('Component "%s" has %d hardcoded %ss', F.col("component").cast("string"), "n", "group")
    return signal(by, "hardcoded-value", F.col("component"), F.col("component").cast("string"), text, severity, detail=F.array_join("values", ", "), suffix=F.col("group"))


def duplicates(components: DataFrame) -> DataFrame:
    g = match.duplicate_groups(components).groupBy("group_id").agg(F.array_sort(F.collect_set("member_id")).alias("members"))
    c = g.join(components.select(F.col("id").alias("group_id"), "name"), "group_id")
    text = F.format_string('%d components look like versions of "%s"', F.size("members"), "name")
    return signal(c, "naming-inconsistency", F.col("group_id"), F.col("name"), text, F.lit("warning"), detail=F.array_join(F.transform("members", lambda m: m.cast("string")), ", "), suffix=F.lit("duplicate"))


def unused(entities: DataFrame, usages: DataFrame, kind: str = "component") -> DataFrame:
    """Components or tokens (id, name) that are never used."""
    u = match.unused(entities, usages)
    return signal(u, f"unused-{kind}", F.col("id"), F.col("name"), F.format_string(f'{kind.capitalize()} "%s" is never used', "name"))


def orphaned(source: DataFrame, target: DataFrame) -> DataFrame:
    """Components without a match: warnings on the source's side, infos on the target's."""
    m = match.exact_components(source, target)
    s, t = match.orphans(source, m, "source_id"), match.orphans(target, m, "target_id")
    a = signal(s, "orphaned-component", F.col("id"), F.col("name"), F.format_string('Component "%s" has no match in design', "name"), F.lit("warning"), suffix=F.lit("source"))
    b = signal(t, "orphaned-component", F.col("id"), F.col("name"), F.format_string('Component "%s" is not implemented', "name"), F.lit("info"), suffix=F.lit("target"))
    return a.unionByName(b)


def token_drift(source: DataFrame, target: DataFrame) -> DataFrame:
    d = match.token_diff(source, target).where("result <> 'equal'")
    diverges = F.col("result") == "divergence"
    one = F.coalesce("id", "target_id")
    a = signal(d.where(diverges), "value-divergence", F.col("id"), F.col("id"), F.format_string('Token "%s" has different values', "id"), detail=F.col("target_id"), suffix=F.col("target_id"))
    b = signal(d.where(~diverges), "orphaned-token", one, one, F.format_string('Token "%s" is on one side only', one), detail=F.col("result"))
    return a.unionByName(b)


def repeated_patterns(occurrences: DataFrame, least: int = 3, tight: bool = False) -> DataFrame:
    p = aggregate.class_patterns(occurrences, least, tight)
    text = F.format_string("Pattern occurs %d times in %d files", "n", "files")
    return signal(p, "repeated-pattern", F.sha2("pattern", 256), F.col("pattern"), text)


def variant_divergence(props: DataFrame) -> DataFrame:
    """(name, a_id, b_id, prop, difference) between the props (name, id, prop, type, seq) of every pair of variants of a component."""
    variants = props.groupBy("name", "id").agg(F.min("seq").alias("seq"))
    pairs = match.variant_pairs(variants)
    last = props.groupBy("id", F.lower("prop").alias("prop")).agg(F.max_by("type", "seq").alias("type"))
    a = pairs.join(last.select(F.col("id").alias("a_id"), "prop", F.col("type").alias("a_type")), "a_id")
    b = pairs.join(last.select(F.col("id").alias("b_id"), "prop", F.col("type").alias("b_type")), "b_id")
    both = a.join(b, ["name", "a_id", "b_id", "prop"], "full_outer")
    kind = F.when(F.col("a_type").isNull() | F.col("b_type").isNull(), "prop-missing").when(F.col("a_type") != F.col("b_type"), "prop-type")
    return both.select("name", "a_id", "b_id", "prop", kind.alias("difference")).where("difference is not null")


def variant_differences(props: DataFrame, variants: DataFrame, styles: DataFrame) -> DataFrame:
    """(name, a_id, b_id, field, difference, severity) between all pairs of variants of a component (name).

    props (name, id, prop, type, required, seq): missing or of another type; variants (id, variant): missing; styles (id, property, value, seq): other values, the last
    of a property. A missing required prop, another type and another value warn.
    """
    pairs = match.variant_pairs(props.groupBy("name", "id").agg(F.min("seq").alias("seq")))

    def sides(rows: DataFrame, what: str) -> DataFrame:
        """Both sides' what by field, for all pairs."""
        a, b = (pairs.join(rows.select(F.col("id").alias(f"{k}_id"), "field", F.col(what).alias(k)), f"{k}_id") for k in "ab")
        return a.join(b, ["name", "a_id", "b_id", "field"], "full_outer")

    last = props.groupBy("id", F.lower("prop").alias("field")).agg(F.max_by(F.struct("type", "required"), "seq").alias("p"))
    p = sides(last, "p")
    missing = F.col("a").isNull() | F.col("b").isNull()
    kind = F.when(missing, "prop-missing").when(F.col("a.type") != F.col("b.type"), "prop-type")
    warns = ~missing | F.coalesce("a.required", "b.required")
    out = p.select("name", "a_id", "b_id", "field", kind.alias("difference"), F.when(warns, "warning").otherwise("info").alias("severity")).where("difference is not null")
    v = sides(variants.select("id", F.lower("variant").alias("field"), F.lit(True).alias("v")).distinct(), "v").where(missing)
    out = out.union(v.select("name", "a_id", "b_id", "field", F.lit("variant-missing"), F.lit("info")))
    s = sides(styles.groupBy("id", F.col("property").alias("field")).agg(F.max_by("value", "seq").alias("s")), "s")
    return out.union(s.where("a <> b and b <> ''").select("name", "a_id", "b_id", "field", F.lit("style-value"), F.lit("warning")))


def example_coverage(components: DataFrame) -> DataFrame:
    """One row of components (name, context: production or example): with and without an example, examples only, per cent covered."""
    by = components.groupBy(F.lower("name").alias("name")).agg(F.bool_or(F.col("context") == "production").alias("p"), F.bool_or(F.col("context") == "example").alias("e"))
    one = by.agg(F.count_if(F.expr("p and e")).alias("with_example"), F.count_if(F.expr("p and not e")).alias("without_example"), F.count_if(F.expr("e and not p")).alias("example_only"))
    n = F.col("with_example") + F.col("without_example")
    return one.withColumn("percent", F.when(n == 0, 100).otherwise(F.floor(F.col("with_example") * 100 / n + 0.5)).cast("int"))


def nearest_color(values: DataFrame, tokens: DataFrame) -> DataFrame:
    """Hard-coded colors with their best token, as suggestions ``value → token (percent)``."""
    s = match.color_suggestions(values, tokens, top=1)
    return s.select("value", F.format_string("%s → %s (%d%%)", "value", "token", F.floor(F.col("confidence") * 100 + 0.5).cast("int")).alias("suggestion"))


def contrast_level(ratio: Column) -> Column:
    """Which contrast a ratio passes: AAA, AA, AA for large text, or none."""
    return F.when(ratio >= 7, "AAA").when(ratio >= colors.MIN_CONTRAST, "AA").when(ratio >= 3, "AA-large").otherwise("fail")


def variant_classes(components: DataFrame, fields: DataFrame) -> DataFrame:
    """(name, field, value, members, first_id, classes) of components (id, name) by what their fields (id, field, value) say, for fields in which variants of a name differ.

    Variants of one class agree and those of unlike classes differ, so this says what all pairs of variants would, in rows of the input's number: what differs are the
    classes of a (name, field), and a variant without the field is of the class without a value.
    """
    named = fields.join(components.select("id", "name"), "id").groupBy("name", "field", "id").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("value"))
    total = components.groupBy("name").agg(F.count(F.lit(1)).alias("variants"))
    held = named.groupBy("name", "field", "value").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id"))
    sums = held.groupBy("name", "field").agg(F.sum("members").alias("with"), F.count(F.lit(1)).alias("n")).join(total, "name")
    without = sums.where(F.col("variants") > F.col("with")).select("name", "field", F.lit(None).cast("string").alias("value"), (F.col("variants") - F.col("with")).alias("members"), F.lit(None).alias("first_id"))
    classes = sums.select("name", "field", (F.col("n") + (F.col("variants") > F.col("with")).cast("long")).alias("classes")).where("classes > 1")
    return held.unionByName(without).join(classes, ["name", "field"])
